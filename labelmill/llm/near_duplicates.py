"""MinHash near-duplicates with an LSH forest.

A document is its set of word shingles, sketched by minimum hashes. Each tree of the forest is an order of all documents by
hashes of its own: rows are sorted by them in ranges, over as many tasks as there are, and a document's candidates are its
neighbours in the order, which share the longest prefix with it. Documents that agree on the first hashes of an order are a
region. Where a region's documents stay apart after the links of neighbours were confirmed, their sketches are compared, in
blocks of bounded size; a region that would take too many blocks is searched deeper instead: its documents alone go to the
next level, with longer prefixes and as many more trees as keep the chance to meet. Links count only when the full shingle
sets confirm them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelmill.llm.common import WordHashes, chunked, gram_hash, joined_hash, mix, narrow, parts, stored, text_key
from labelmill.llm.components import components

SHINGLE, SIMILARITY = 5, 75
# Common prefixes that make a region, level by level, the hashes behind them that order a region, and the chance at most that
# two documents of the least similarity share no region of a level.
DEPTHS, TAIL, MISSED = (2, 4, 8, 16), 2, 2e-6
# Sketches of one block, and by how many standard deviations a pair's equal hashes may fall short of the similarity.
BLOCK, SHORT = 1024, 4.6
# Classes that may be broadcast, about 100 bytes each; more are joined.
BROADCAST_IDS = 250_000
# Rows of orders that are made at once.
ROWS = 100_000


def trees_of(depth: int, similarity: int) -> int:
    """Orders that a level needs: 16 for a prefix of two at a similarity of 0.75."""
    share = min(similarity / 100, 1 - 1e-6) ** depth
    return math.ceil(math.log(MISSED) / math.log1p(-share))


def least_equal(hashes: int, similarity: int) -> int:
    """Equal hashes below which a pair is not confirmed: 32 of 64 at a similarity of 0.75."""
    share = similarity / 100
    return max(0, math.floor(hashes * share - SHORT * math.sqrt(hashes * share * (1 - share))))


def shingle_sets(texts: list[bytes], size: int, hashes: WordHashes) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a text with fewer words has one for its whole sequence."""
    split = [text.lower().split() for text in texts]
    counts = np.array([len(words) for words in split], np.int64)
    ends = np.cumsum(counts)
    units = hashes([word for words in split for word in words])
    grams = gram_hash(units, size)
    out = []
    for count, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if count >= size:
            out.append(np.unique(grams[end - count : end - size + 1]))
        elif count:
            out.append(joined_hash(gram_hash(units[end - count : end], count), np.array([count], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray], count: int, level: int = 0) -> np.ndarray:
    """Minimum hashes of non-empty sets, by functions that differ from level to level."""
    starts = np.cumsum([0] + [len(some) for some in sets[:-1]])
    values = np.concatenate(sets)
    seeds = np.arange(1, count + 1, dtype=np.uint64) + np.uint64(level << 32)
    factors, added = mix(seeds) | np.uint64(1), mix(seeds + np.uint64(1 << 31))
    out = np.empty((len(sets), count), np.uint32)
    for i in range(count):
        out[:, i] = np.minimum.reduceat(((values * factors[i] + added[i]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, text_key)``: id and key of the text tell rows apart, whether ids are null or shared."""
    return narrow(docs).withColumn("text_key", text_key())


def sketch_table(docs: DataFrame, size: int, count: int) -> DataFrame:
    """``(doc_id, text_key, n_shingles, set_key, sketch)``; the keys digest text and set, those of an empty set are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            own = iter(batch.column("text_key").to_pylist())
            for ids, texts in chunked(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                sets = shingle_sets(texts, size, hashes)
                full = [i for i, some in enumerate(sets) if len(some)]
                found: list[bytes | None] = [None] * len(sets)
                if full:
                    for i, row in zip(full, sketches([sets[i] for i in full], count), strict=True):
                        found[i] = row.tobytes()
                keys = [hashlib.blake2b(some.tobytes(), digest_size=16).digest() if len(some) else None for some in sets]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(ids, pa.int64()),
                        "text_key": pa.array([next(own) for _ in ids], pa.binary()),
                        "n_shingles": pa.array(map(len, sets), pa.int64()),
                        "set_key": pa.array(keys, pa.binary()),
                        "sketch": pa.array(found, pa.binary()),
                    }
                )

    return keyed(docs).mapInArrow(run, "doc_id long, text_key binary, n_shingles long, set_key binary, sketch binary")


def _ordered(ids: np.ndarray, sketch: np.ndarray, depth: int, level: int) -> pa.RecordBatch:
    """A row for each document and tree: the region, by the first hashes of the tree's order, and the hashes behind them."""
    trees = sketch.shape[1] // (depth + TAIL)
    rows = sketch.reshape(len(ids), trees, depth + TAIL).astype(np.uint64)
    keys = np.broadcast_to(mix(np.arange(1, trees + 1, dtype=np.uint64) + np.uint64(level << 32)), (len(ids), trees))
    for place in range(depth):
        keys = joined_hash(keys, rows[:, :, place])
    tail = rows[:, :, depth] << np.uint64(32) | rows[:, :, depth + 1]
    columns = {"region": keys.reshape(-1).view(np.int64), "tail": tail.reshape(-1).view(np.int64), "class_id": np.repeat(ids, trees)}
    return pa.RecordBatch.from_pydict({name: pa.array(values, pa.int64()) for name, values in columns.items()})


ORDERS = "region long, tail long, class_id long"


def first_orders(classes: DataFrame) -> DataFrame:
    """The orders of the first level, ``(region, tail, class_id)``, from the sketches of all classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column("class_id").to_pylist(), np.int64)
            if len(ids):
                yield _ordered(ids, np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(len(ids), -1), DEPTHS[0], 0)

    return classes.select("class_id", "sketch").mapInArrow(run, ORDERS)


def deeper_orders(sets: DataFrame, level: int, similarity: int) -> DataFrame:
    """The orders of a further level for the documents of ``sets (class_id, set)``, by hashes made for it."""
    depth = DEPTHS[level]
    trees = trees_of(depth, similarity)
    at_once = max(1, ROWS // trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, some = batch.column("class_id").to_pylist(), batch.column("set").to_pylist()
            for keys, values in chunked(ids, some):
                for start in range(0, len(keys), at_once):
                    own = [np.frombuffer(value, np.uint64) for value in values[start : start + at_once]]
                    yield _ordered(np.array(keys[start : start + at_once], np.int64), sketches(own, trees * (depth + TAIL), level), depth, level)

    return sets.mapInArrow(run, ORDERS)


def neighbours(orders: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` that follow each other in an order, inside one region.

    A region may lie in several ranges of the sorted rows. Each range tells its first and its last row, and pairs across
    a border come from those: two rows a range, whatever the size of a region.
    """
    n = parts(orders.sparkSession)
    order = ("region", "tail", "class_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.stack([batch.column(name).to_numpy() for name in order], axis=1)
            ends = ends or [table[0], table[0]]
            joined = np.vstack([ends[1], table])
            ends[1] = table[-1]
            at = np.flatnonzero((joined[1:, 0] == joined[:-1, 0]) & (joined[1:, 2] != joined[:-1, 2]))
            yield rows(a=joined[at, 2], b=joined[at + 1, 2])
        if ends:
            region, tail, a = np.stack(ends).T
            yield rows(a=a, region=region, tail=tail, last=np.array([False, True]))

    schema = pa.schema([*((name, pa.int64()) for name in ("a", "b", "region", "tail")), ("last", pa.bool_())])

    def rows(a: np.ndarray, **others: np.ndarray) -> pa.RecordBatch:
        columns = {"a": a, **others}
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(a), f.type) for f in schema], schema=schema)

    ranged = orders.repartitionByRange(n, *order).sortWithinPartitions(*order)
    found = stored(ranged.mapInArrow(run, "a long, b long, region long, tail long, last boolean"), "neighbours")
    following = F.lead("a").over(Window.partitionBy("region").orderBy("tail", "a", "last"))
    across = found.where("b IS NULL").withColumn("b", following).where("last AND b IS NOT NULL")
    pairs = found.where("b IS NOT NULL").select("a", "b").unionByName(across.select("a", "b")).where("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _equal_hashes(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Keep the pairs whose sketches make the similarity likely."""
    sides = [classes.select(F.col("class_id").alias(x), F.col("sketch").alias(f"s{x}")) for x in "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(f"s{side}").to_pylist()), np.uint32).reshape(batch.num_rows, -1) for side in "ab")
                yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= least))

    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, similarity: int) -> bool:
    if 100 * min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= similarity * (len(x) + len(y) - common)


def _set_table(ids: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """``(class_id, set)``: full shingle sets of the classes named in ``ids (class_id)``, each from its first row, written once."""
    ids = stored(ids.distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    wanted = classes.join(F.broadcast(ids) if few else ids, "class_id", "left_semi").select("class_id", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    rows = keyed(docs)
    rows = rows.join(F.broadcast(wanted) if few else wanted, rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["text_key"] == F.col("_key")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for keys, texts in chunked(batch.column("class_id").to_pylist(), batch.column("text").to_pylist()):
                found = [some.tobytes() for some in shingle_sets(texts, size, hashes)]
                yield pa.RecordBatch.from_pydict({"class_id": pa.array(keys, pa.int64()), "set": pa.array(found, pa.binary())})

    # repeated rows have one set
    return stored(rows.select("class_id", "text").mapInArrow(sets, "class_id long, set binary").dropDuplicates(["class_id"]), "sets")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, similarity: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets are similar enough; only texts that occur in a pair are looked at."""
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity)
                for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    table = _set_table(pairs.select(F.col("a").alias("class_id")).unionByName(pairs.select(F.col("b").alias("class_id"))), classes, docs, size)
    x, y = (table.select(F.col("class_id").alias(side), F.col("set").alias(name)) for side, name in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(test, "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that follow each other with the same node and pair of blocks."""
    group, held = None, []
    for batch in batches:
        for node, i, j, *row in zip(*(batch.column(name).to_pylist() for name in ("node", "i", "j", *names)), strict=True):
            if (node, i, j) != group:
                if held:
                    yield group, held
                group, held = (node, i, j), []
            held.append(tuple(row))
    if held:
        yield group, held


def _likely(group: tuple, rows: list[tuple], least: int) -> list[tuple[int, int, int]]:
    """Pairs across a group's two blocks that are in different components and likely: equal hashes and both places."""
    own, comps = (np.array([row[k] for row in rows], np.int64) for k in (0, 2))
    table = np.frombuffer(b"".join(row[3] for row in rows), np.uint32).reshape(len(rows), -1)
    left, right = np.flatnonzero(own == group[1]), np.flatnonzero(own == group[2])
    out = []
    for at, x in enumerate(left.tolist()):
        others = left[at + 1 :] if group[1] == group[2] else right
        others = others[comps[others] != comps[x]]
        equal = (table[others] == table[x]).sum(1)
        out += [(int(n), x, int(y)) for n, y in zip(equal[equal >= least], others[equal >= least], strict=True)]
    return out


def undecided(orders: DataFrame, linked: DataFrame) -> DataFrame:
    """``(region, n, class_id, component)``: the documents of the regions that are not one component yet.

    Equal member lists of different trees are one region.
    """
    members = orders.select("region", "class_id").join(linked.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    members = members.withColumn("component", F.coalesce("component", "class_id"))
    regions = members.groupBy("region").agg(
        F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"),
        F.sum(F.xxhash64("class_id").cast("decimal(38,0)")).alias("x"), F.sum(F.xxhash64("class_id", F.lit(1)).cast("decimal(38,0)")).alias("y"),
    )
    regions = regions.where("low <> high").groupBy("n", "x", "y").agg(F.min("region").alias("region")).select("region", "n")
    return members.join(regions, "region").select("region", "n", "class_id", "component")


GROUPS = "node long, i int, j int, own int, class_id long, component long"


def dealt(placed: DataFrame, block: int) -> DataFrame:
    """A region is cut into blocks, and each pair of blocks is a group: a document has a row for every block of its region."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("class_id", F.lit(2)), F.col("blocks")).cast("int")
    placed = placed.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.select(F.col("region").alias("node"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class_id", "component")


def _apart(placed: DataFrame, classes: DataFrame, docs: DataFrame, size: int, similarity: int, least: int, block: int) -> DataFrame:
    """Confirmed links between documents that share a region but were not connected yet, enough to connect them.

    Each pair of a region's blocks is a task's group. A first pass over sketches finds the documents with a likely partner
    in another component; only those come back with their full sets. The second pass tests the likely pairs, best first,
    and leaves out those that its own links have connected. So no list of pairs is ever moved or written.
    """
    n = parts(placed.sparkSession)

    def in_groups(table: DataFrame) -> DataFrame:
        return table.repartition(n, "node", "i", "j").sortWithinPartitions("node", "i", "j", "class_id")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group, held in _groups(batches, ("own", "class_id", "component", "sketch")):
            out += [(*group, *held[k][:3]) for k in sorted({k for _, x, y in _likely(group, held, least) for k in (x, y)})]
            if len(out) >= 10_000:
                yield _batch(out, GROUPS)
                out = []
        yield _batch(out, GROUPS)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group, held in _groups(batches, ("own", "class_id", "component", "sketch", "set")):
            root = {row[2]: row[2] for row in held}

            def top(x, root=root):
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            sets = [np.frombuffer(row[4], np.uint64) for row in held]
            for _, x, y in sorted(_likely(group, held, least), reverse=True):
                a, b = top(held[x][2]), top(held[y][2])
                if a != b and similar(sets[x], sets[y], similarity):
                    root[a] = b
                    out.append((held[x][1], held[y][1]))
        yield _batch(out, "a long, b long")

    sketched = dealt(placed, block).join(classes.select("class_id", "sketch"), "class_id")
    found = stored(in_groups(sketched).mapInArrow(find, GROUPS), "apart")
    sets = _set_table(found.select("class_id"), classes, docs, size)
    full = found.join(classes.select("class_id", "sketch"), "class_id").join(sets, "class_id")
    return stored(in_groups(full).mapInArrow(settle, "a long, b long"), "confirmed")


def linked_classes(classes: DataFrame, docs: DataFrame, size: int, similarity: int, block: int) -> DataFrame:
    """``(node, component)`` of the classes: the forest searched level by level.

    A region goes to the next level when its blocks would give a document more rows than the further trees do; so a
    level's rows grow with the documents that are in such regions, times the level's trees. What is crowded at the last
    depth, too, is compared in blocks: nothing is left out.
    """
    least = least_equal(trees_of(DEPTHS[0], similarity) * (DEPTHS[0] + TAIL), similarity)
    orders, links = stored(first_orders(classes), "orders"), None
    for level, depth in enumerate(DEPTHS):
        pairs = stored(_equal_hashes(neighbours(orders), classes, least), "pairs")
        near = stored(confirmed(pairs, classes, docs, size, similarity), "confirmed")
        linked = components(near if links is None else links.unionByName(near))
        placed = stored(undecided(orders, linked), "undecided")
        crowded = None
        if depth != DEPTHS[-1]:
            limit = block * trees_of(DEPTHS[level + 1], similarity) // trees_of(depth, similarity)
            crowded = placed.where(F.col("n") > limit)
            placed = placed.where(F.col("n") <= limit)
        more = _apart(placed, classes, docs, size, similarity, least, block)
        links = linked.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
        if crowded is None or crowded.isEmpty():
            break
        orders = stored(deeper_orders(_set_table(crowded.select("class_id"), classes, docs, size), level + 1, similarity), "orders")
    return linked if more.isEmpty() else components(links)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [field.split() for field in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([row[k] for row in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def marked(docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """``near_duplicates`` with the key of each row's text: ``(doc_id, text_key, n_shingles, component_id, kept)``."""
    table = stored(sketch_table(docs, size, trees_of(DEPTHS[0], similarity) * (DEPTHS[0] + TAIL)), "sketches")
    full = table.where("set_key IS NOT NULL")
    # the first row of a set: smallest id, null last; classes are numbered by it, as originals mostly come before their copies
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    by_set = full.groupBy("set_key").agg(F.min(F.struct(first.alias("row"), "sketch")).alias("first"))
    by_set = by_set.select("set_key", "first.row.doc_id", "first.row.text_key", "first.sketch").orderBy(F.col("doc_id").isNull(), "doc_id", "text_key")
    by_set = stored(by_set.withColumn("class_id", F.monotonically_increasing_id()), "classes")
    classes = by_set.drop("set_key")
    linked = linked_classes(classes, docs, size, similarity, block)
    linked = linked.select(F.col("node").alias("class_id"), "component")
    members = linked.unionByName(linked.select(F.col("component").alias("class_id"), "component").distinct())
    heads = classes.join(members, "class_id").groupBy("component").agg(F.min(first).alias("head")).select("component", "head")
    found = by_set.select("set_key", "class_id", first.alias("own")).join(members.join(heads, "component"), "class_id", "left")
    found = found.select("set_key", F.coalesce("head", "own").alias("head"))
    # a row without words is a component of its own
    head = F.coalesce("head", first)
    same = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return table.join(found, "set_key", "left").withColumn("head", head).withColumn("component_id", F.col("head.doc_id")).select(
        "doc_id", "text_key", "n_shingles", "component_id", (same & (F.col("doc_id").isNotNull() | (F.col("text_key") == F.col("head.text_key")))).alias("kept")
    )


def near_duplicates(docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every document.

    Documents are linked when 100 * intersection >= ``similarity`` * union of their shingle sets; the component is the
    smallest id reachable. Documents with one set are one class and are compared once. Null and wordless texts have an
    empty set and are linked with nothing. Rows that share an id and differ in text belong each to the class of its own
    set, and all that have the smallest id of their component are kept. Rows without an id are linked like others; a
    component with no id at all has a null ``component_id`` and keeps one text, that with the smallest key. Repeated rows
    share a verdict. An empty table gives no rows. ``block`` bounds the sketches a task holds at once; rows do not depend on it.
    """
    return marked(docs, size, similarity, block).drop("text_key")
