"""Token counts that follow edits.

A document is kept as chunks that no pre-token crosses, grouped into segments; a tree over the segments sums characters
and tokens. An edit looks its segments up from the root, cuts only the chunks it touches and one neighbour on each side
anew, encodes those, and corrects the sums on the way up. Everything else stays as it was counted. Segments and nodes are split
and merged like those of a B-tree, so an edit costs the same however many came before it.

Trees can be stored as a table of segments, which a table of edits joins: only touched segments and their neighbours are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.bpe import Coder, coder, default_path, default_pattern
from labelmill.llm.common import stored

# Chunks in a segment when a document is first cut.
SEGMENT = 32

# A mail address, as the edits of the registered query look for it.
MAIL = "[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\\.[A-Za-z0-9-]++)+"


class _Leaf:
    """A segment."""

    __slots__ = ("chars", "chunks", "next", "parent", "prev", "tokens")

    def __init__(self, chunks: list[str], tokens: int):
        self.chunks, self.tokens, self.chars = chunks, tokens, sum(map(len, chunks))
        self.parent = self.prev = self.next = None


class _Node:
    __slots__ = ("chars", "kids", "parent", "tokens")

    def __init__(self, kids: list):
        self.parent = None
        self.take(kids)

    def take(self, kids: list) -> None:
        self.kids = kids
        for kid in kids:
            kid.parent = self
        self.add()

    def add(self) -> None:
        self.chars, self.tokens = sum(kid.chars for kid in self.kids), sum(kid.tokens for kid in self.kids)


def _shared_out(items: list, most: int) -> list[list]:
    """Consecutive parts of nearly equal size, as few as ``most`` allows, so each holds at least half of it if there are several."""
    parts = max(1, -(-len(items) // most))
    ends = [len(items) * i // parts for i in range(parts + 1)]
    return [items[a:b] for a, b in zip(ends, ends[1:])]


class CountTree:
    """Token count of one text under replacements; ``counted`` chunks have been encoded so far."""

    def __init__(self, text: str, own: Coder, segment: int = SEGMENT):
        self.own, self.counted, self.most = own, 0, 2 * segment
        chunks = own.chunks(text)
        leaves = [_Leaf(chunks[i : i + segment], self._count(chunks[i : i + segment])) for i in range(0, len(chunks), segment)]
        for x, y in zip(leaves, leaves[1:]):
            x.next, y.prev = y, x
        level: list = leaves
        while True:
            level = [_Node(part) for part in _shared_out(level, segment)]
            if len(level) == 1:
                break
        self.root = level[0]

    def _count(self, chunks: list[str]) -> int:
        self.counted += len(chunks)
        return sum(len(self.own.chunk(chunk)) for chunk in chunks)

    @property
    def total(self) -> int:
        return self.root.tokens

    @property
    def length(self) -> int:
        return self.root.chars

    def leaves(self) -> Iterator[_Leaf]:
        at = self.root
        while isinstance(at, _Node):
            at = at.kids[0]
        while at is not None:
            yield at
            at = at.next

    def text(self) -> str:
        return "".join(chunk for leaf in self.leaves() for chunk in leaf.chunks)

    def _at(self, place: int) -> tuple[_Leaf, int]:
        """The segment that holds a character, and the characters before that segment; the end counts as the last."""
        at, before = self.root, 0
        while isinstance(at, _Node):
            for kid in at.kids:
                if before + kid.chars > place:
                    break
                before += kid.chars
            else:
                before -= kid.chars
            at = kid
        return at, before

    def replace(self, start: int, stop: int, new: str) -> int:
        """Replace characters ``start`` to ``stop``; the new token count."""
        if not 0 <= start <= stop <= self.length:
            raise ValueError("the edit lies outside the text")
        leaf, before = self._at(max(0, start - 1))
        while leaf.prev is not None and start - before <= len(leaf.chunks[0]):  # the neighbour on the left
            leaf = leaf.prev
            before -= leaf.chars
        touched, end = [leaf], before + leaf.chars
        while leaf.next is not None and (end <= stop or end - len(leaf.chunks[-1]) <= stop):  # and on the right
            leaf = leaf.next
            touched.append(leaf)
            end += leaf.chars
        stretch = [chunk for leaf in touched for chunk in leaf.chunks]
        low, place = 0, before
        while low + 1 < len(stretch) and place + len(stretch[low]) < start:
            place += len(stretch[low])
            low += 1
        if low:
            low -= 1
            place -= len(stretch[low])
        high, end = low, place
        while high < len(stretch) and end <= stop:
            end += len(stretch[high])
            high += 1
        if high < len(stretch):
            end += len(stretch[high])
            high += 1
        old = "".join(stretch[low:high])
        fresh = self.own.chunks(old[: start - place] + new + old[stop - place :])
        self.counted += len(fresh)
        stretch[low:high] = fresh
        # a segment that has become small is filled from a neighbour
        if len(stretch) < self.most // 4:
            if touched[-1].next is not None:
                touched.append(touched[-1].next)
                stretch += touched[-1].chunks
            elif touched[0].prev is not None:
                touched.insert(0, touched[0].prev)
                stretch = touched[0].chunks + stretch
        self._put(touched, _shared_out(stretch, self.most) if stretch else [])
        return self.total

    def _put(self, old: list[_Leaf], parts: list[list[str]]) -> None:
        """New segments in the place of old ones; known chunks are looked up, not encoded."""
        parts = parts or [[""]]
        fresh = [_Leaf(part, sum(len(self.own.chunk(chunk)) for chunk in part)) for part in parts]
        before, after = old[0].prev, old[-1].next
        for x, y in zip([before, *fresh], [*fresh, after]):
            if x is not None:
                x.next = y
            if y is not None:
                y.prev = x
        by_parent: dict[int, list] = {}
        for leaf in old:
            by_parent.setdefault(id(leaf.parent), [leaf.parent, set()])[1].add(id(leaf))
        first = True
        changed: list[_Node] = []
        for parent, gone in by_parent.values():
            at = next(i for i, kid in enumerate(parent.kids) if id(kid) in gone)
            kids = [kid for kid in parent.kids if id(kid) not in gone]
            parent.take(kids[:at] + fresh + kids[at:] if first else kids)
            first = False
            changed.append(parent)
        self._settle(changed)

    def _settle(self, changed: list[_Node]) -> None:
        """Sizes and sums of changed nodes and all above them, level by level."""
        while changed:
            above: dict[int, _Node] = {}
            for node in changed:
                parent = node.parent
                if parent is None:
                    if len(node.kids) > self.most:
                        self.root = _Node([_Node(part) for part in _shared_out(node.kids, self.most)])
                    else:
                        node.add()
                    continue
                at = next((i for i, kid in enumerate(parent.kids) if kid is node), None)
                if at is None:  # merged into a neighbour already
                    continue
                kids, begin, end = node.kids, at, at + 1
                if len(kids) < self.most // 4 and len(parent.kids) > 1:
                    begin, end = (at, at + 2) if at + 1 < len(parent.kids) else (at - 1, at + 1)
                    kids = [kid for part in parent.kids[begin:end] for kid in part.kids]
                parent.kids[begin:end] = [_Node(part) for part in _shared_out(kids, self.most)] if kids else []
                parent.take(parent.kids)
                above[id(parent)] = parent
            changed = list(above.values())
        while isinstance(self.root.kids[0], _Node) and len(self.root.kids) == 1:
            self.root = self.root.kids[0]
            self.root.parent = None


def checked(edits: list[dict] | None, length: int) -> tuple[list[tuple[int, int, str]], str]:
    """Edits from the last to the first, and ``ok``; or none and what is wrong with them: ``outside`` or ``overlap``."""
    out = []
    for edit in edits or ():
        if edit is None:
            continue
        start, stop = edit["start"], edit["stop"]
        if start is None or stop is None or not 0 <= start <= stop <= length:
            return [], "outside"
        out.append((start, stop, edit["new"] or ""))
    # inserts at one place are applied in the order given
    out = [edit for _, edit in sorted(enumerate(out), key=lambda pair: (pair[1][0], pair[1][1], pair[0]))][::-1]
    if any(later[0] < earlier[1] for later, earlier in zip(out, out[1:])):
        return [], "overlap"
    return out, "ok"


def pattern_edits(text: Column, pattern: str, new: str) -> Column:
    """Edits that replace every match of a pattern: an array of ``(start, stop, new)`` in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,new:string>>").alias("edits"))

    def step(state, pair):
        start = state["at"] + pair["gap"]
        stop = start + F.char_length(pair["found"])
        edit = F.struct(start.alias("start"), stop.alias("stop"), F.lit(new).alias("new"))
        return F.struct(stop.alias("at"), F.concat(state["edits"], F.array(edit)).alias("edits"))

    pairs = F.transform(found, lambda match, i: F.struct(match.alias("found"), F.get(gaps, i).alias("gap")))
    return F.when(F.contains(text, F.lit("@")), F.aggregate(pairs, begin, step, lambda state: state["edits"]))


def count_edited(docs: DataFrame, edits: Column, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Token counts before and after the edits of each row.

    ``edits`` is an array of ``(start, stop, new)`` in code points of the text as it was; they are applied from the last to the
    first. ``(doc_id, n_tokens, n_edits, n_tokens_edited, n_chunks, n_recounted, status)``: chunks of the document, those
    counted again, and ``ok``. A row with an edit that lies outside its text or has a null bound (``outside``) or with two that
    overlap (``overlap``) is not edited: no edits, the count as it was. A null text is empty; null edits are none, a null
    replacement is empty; repeated rows and an empty table give as many rows as they have. No shuffle.
    """
    path, pattern = path or default_path(), pattern or default_pattern()
    names = ("n_tokens", "n_edits", "n_tokens_edited", "n_chunks", "n_recounted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            out = []
            for text, changes in zip(batch.column("text"), batch.column("edits").to_pylist(), strict=True):
                tree = CountTree(text.as_py() or "", own)
                before, chunks = tree.total, tree.counted
                applied, status = checked(changes, tree.length)
                for change in applied:
                    tree.replace(*change)
                out.append((before, len(applied), tree.total, chunks, tree.counted - chunks, status))
            columns = {name: pa.array([row[i] for row in out], pa.int64()) for i, name in enumerate(names)}
            columns["status"] = pa.array([row[-1] for row in out], pa.string())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | columns)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), edits.alias("edits"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{name} long" for name in names) + ", status string")


_SEGMENTS = "doc_id long, segment long, first long, chars long, tokens long, chunks long, text string"


def store_trees(docs: DataFrame, path: str | None = None, pattern: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """Every document as counted segments, written once: ``(doc_id, segment, first, chars, tokens, chunks, text)``.

    ``first`` is where the segment begins. Ids must be unique; rows without one are left out, since no edit can name them. A null or
    empty text is one empty segment.
    """
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        names = [part.split()[0] for part in _SEGMENTS.split(", ")]
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                chunks, rows, first = own.chunks(text or ""), [], 0
                for i in range(0, len(chunks), segment):
                    part = chunks[i : i + segment]
                    size = sum(map(len, part))
                    rows.append((doc_id, i // segment, first, size, sum(len(own.chunk(chunk)) for chunk in part), len(part), "".join(part)))
                    first += size
                kinds = [pa.int64()] * 6 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)], names)

    known = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(known.mapInArrow(run, _SEGMENTS), "token-trees")


def count_stored(trees: DataFrame, edits: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Token counts of the stored documents that edits name: ``(doc_id, n_tokens, n_edits, n_tokens_edited, n_recounted, status)``.

    ``edits`` holds ``(doc_id, start, stop, new)``, rules as of ``count_edited``; edits of unknown documents are left out. Texts
    are read of touched segments and their neighbours only: the cuts at the outer ends of those stay where they are, so the
    rest of the document keeps its counts. A group of the last step is the touched part of one document.
    """
    path, pattern = path or default_path(), pattern or default_pattern()
    sizes = trees.groupBy("doc_id").agg(F.sum("tokens").alias("n_tokens"), F.sum("chars").alias("length"))
    named = edits.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.col("new").cast("string").alias("new"))
    change = F.struct("start", "stop", "new").alias("change")
    wanted = stored(named.join(sizes, "doc_id").groupBy("doc_id", "n_tokens", "length").agg(F.collect_list(change).alias("edits")), "token-edits")
    places = wanted.select("doc_id", F.explode("edits").alias("edit")).select("doc_id", "edit.start", "edit.stop")
    ends = trees.select("doc_id", "segment", "first", (F.col("first") + F.col("chars")).alias("end"))
    # the segments that an edit meets, with the one before and after; an edit at a border meets both sides
    met = ends.join(places, "doc_id").where((F.col("start") <= F.col("end")) & (F.col("stop") >= F.col("first")))
    near = met.select("doc_id", F.explode(F.array(*(F.col("segment") + i for i in (-1, 0, 1)))).alias("segment")).distinct()
    touched = trees.join(near, ["doc_id", "segment"], "left_semi")
    schema = "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_recounted long, status string"

    def run(key: tuple, segments: pa.Table, asked: pa.Table) -> pa.Table:
        own, rows = coder(path, pattern), []
        parts = sorted(segments.select(["segment", "first", "tokens", "text"]).to_pylist(), key=lambda part: part["segment"])
        for doc_id, n_tokens, length, changes in zip(*(asked.column(c).to_pylist() for c in ("doc_id", "n_tokens", "length", "edits")), strict=True):
            applied, status = checked(changes, length)
            total, recounted, waiting = n_tokens, 0, list(applied)
            # from the last run of neighbouring segments to the first
            while parts and waiting:
                stretch = [parts.pop()]
                while parts and parts[-1]["segment"] + 1 == stretch[0]["segment"]:
                    stretch.insert(0, parts.pop())
                first, text, changed = stretch[0]["first"], "".join(part["text"] for part in stretch), False
                while waiting and waiting[0][0] >= first:
                    start, stop, new = waiting.pop(0)
                    text, changed = text[: start - first] + new + text[stop - first :], True
                if changed:
                    chunks = own.chunks(text)
                    recounted += len(chunks)
                    total += sum(len(own.chunk(chunk)) for chunk in chunks) - sum(part["tokens"] for part in stretch)
            rows.append((doc_id, n_tokens, len(applied), total, recounted, status))
        names = [part.split()[0] for part in schema.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.string()]
        return pa.Table.from_arrays([pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)], names)

    return touched.groupBy("doc_id").cogroup(wanted.groupBy("doc_id")).applyInArrow(run, schema)
