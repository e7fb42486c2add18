"""Exact top-k search by inner product with three phases and a uniform threshold.

A vector is cut into ``lists`` stretches of components. Each stretch is a list of its own: a vector's local score there is
the inner product over the stretch, its score the sum over the lists.

1. Every list gives its best local scores; the vectors named are scored in full, and the k-th best full score is a cutoff
   that the answer cannot fall below.
2. A vector whose local scores all lie below ``cutoff / lists`` stays below the cutoff. So that share is broadcast, and every
   list gives all entries that reach it. Entries of one vector are added up; what is known from all lists raises the cutoff.
3. A vector that some list has not given can at most have the share there. Where that could still reach the cutoff, the
   missing local scores are fetched and the sum is exact.

Equal vectors are one candidate with its smallest ids: of more than k copies the others can be in no answer. The same holds
for queries. Queries are taken in passes of bounded size, so that tasks hold a bounded matrix whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.llm.common import stored

# Bytes of query components in one pass, and score cells that one numpy step holds.
PASS_BYTES, CELLS = 16 << 20, 1 << 20

# Components are whole numbers up to this size: beyond it a double has no fractions.
LARGEST = 1 << 53


def components_of(vector: Column, scale: int) -> Column:
    """Components as whole numbers, rounded down; null for a null vector or one that holds null, NaN or infinity."""
    values = vector.cast("array<double>")
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(values, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))))
    return F.when(~bad, scaled)


@dataclass(frozen=True)
class Index:
    """``lists (list, vec, values)``, ``ids (vec, ids)``, ``queries (query_id, vec)`` as stored tables, and the shape."""

    lists: DataFrame
    ids: DataFrame
    queries: DataFrame
    n_lists: int
    width: int
    wide: bool

    @property
    def score_type(self) -> str:
        return "decimal(38,0)" if self.wide else "long"


def build(vectors: DataFrame, is_query: Column, k: int, lists: int, scale: int) -> Index:
    """Distinct vectors with their ``k + 1`` smallest ids, cut into lists, and the rows that ask."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), components_of(F.col("embedding"), scale).alias("values"), is_query.alias("asks"))
    rows = rows.where("values IS NOT NULL").withColumn("h", F.xxhash64("values"))
    smallest = Window.partitionBy("h", "values").orderBy(F.col("vec_id").asc_nulls_last())
    ranked = rows.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1)
    # at most k + 1 ids come together
    distinct = ranked.groupBy("h", "values").agg(F.sort_array(F.collect_list(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id"))).alias("ids"))
    distinct = stored(distinct.withColumn("vec", F.monotonically_increasing_id()), "topk-vectors")
    shape = distinct.select(F.max(F.size("values")), F.max(F.array_max(F.transform("values", F.abs)))).first()
    dim, most = shape[0] or 0, shape[1] or 0
    width = max(1, -(-dim // lists))
    pieces = F.array(*[F.struct(F.lit(j).alias("list"), F.slice("values", j * width + 1, width).alias("values")) for j in range(lists)])
    cut = distinct.select("vec", F.explode(pieces).alias("piece")).select("piece.list", "vec", "piece.values")
    asking = rows.where("asks").select("h", "values", F.col("vec_id").alias("query_id"))
    asking = asking.join(distinct.select("h", "values", "vec"), ["h", "values"]).select("query_id", "vec")
    return Index(
        stored(cut, "topk-lists"),
        distinct.select("vec", F.col("ids.vec_id").alias("ids")),
        stored(asking, "topk-queries"),
        lists,
        width,
        most * most * max(1, dim) >= LARGEST,
    )


class Asked:
    """The query vectors of a pass, as one matrix per list."""

    def __init__(self, vecs: np.ndarray, matrices: list[np.ndarray]):
        self.vecs, self.matrices = vecs, matrices


def matrix(values: pa.Array, width: int, wide: bool) -> np.ndarray:
    """One row per array, zeros behind short ones. Float products and sums are exact unless ``wide``: then Python's integers."""
    ends = values.offsets.to_numpy()
    sizes = np.diff(ends)
    flat = values.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    out = np.zeros((len(sizes), width), object if wide else np.float64)
    if wide:
        out[:] = 0
        flat = np.array([int(x) for x in flat], object)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def collected(index: Index, vecs: DataFrame) -> Asked:
    """The components of the given vectors, on the driver: ``vecs`` is one pass, so at most about ``PASS_BYTES``."""
    table = index.lists.join(F.broadcast(vecs), "vec", "left_semi").orderBy("vec", "list").toArrow()
    n = table.num_rows // index.n_lists
    whole = matrix(table["values"].combine_chunks(), index.width, index.wide)
    order = np.arange(n) * index.n_lists
    return Asked(table["vec"].to_numpy()[order], [whole[order + j] for j in range(index.n_lists)])


def _scalars(values: np.ndarray, wide: bool) -> pa.Array:
    return pa.array([Decimal(int(x)) for x in values], pa.decimal128(38, 0)) if wide else pa.array(values.astype(np.int64), pa.int64())


def _entries(vecs: np.ndarray, list_no: int, q: np.ndarray, vec: np.ndarray, local: np.ndarray, wide: bool) -> pa.RecordBatch:
    columns = {"q": pa.array(vecs[q], pa.int64()), "vec": pa.array(vec, pa.int64()), "list": pa.array(np.full(len(q), list_no), pa.int32())}
    return pa.RecordBatch.from_pydict(columns | {"local": _scalars(local, wide)})


def _local_scores(asked: Asked, batches: Iterator[pa.RecordBatch], index_width: int, wide: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per list and bounded stretch of its rows: the vectors and their local scores for all queries of the pass."""
    step = max(1, CELLS // max(1, len(asked.vecs)))
    for batch in batches:
        number = batch.column("list").to_numpy()
        for j in np.unique(number).tolist():
            some = batch.filter(pa.array(number == j))
            for at in range(0, some.num_rows, step):
                part = some.slice(at, step)
                yield j, part.column("vec").to_numpy(), asked.matrices[j] @ matrix(part.column("values"), index_width, wide).T


_ENTRY = "q long, vec long, list int, local {0}"


def best_local(index: Index, asked, k: int) -> DataFrame:
    """Phase 1: the ``k`` best entries of every list for every query; a task passes on at most ``k`` per list and query."""
    width, wide = index.width, index.wide

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Asked = asked.value
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for j, vec, scores in _local_scores(own, batches, width, wide):
            names = np.broadcast_to(vec, scores.shape)
            if j in held:
                scores, names = np.concatenate((held[j][0], scores), axis=1), np.concatenate((held[j][1], names), axis=1)
            if scores.shape[1] > k:
                top = np.argsort(-scores, axis=1)[:, :k] if wide else np.argpartition(-scores, k - 1, axis=1)[:, :k]
                scores, names = np.take_along_axis(scores, top, axis=1), np.take_along_axis(names, top, axis=1)
            held[j] = scores, names
        for j, (scores, names) in held.items():
            yield _entries(own.vecs, j, np.repeat(np.arange(len(own.vecs)), scores.shape[1]), names.reshape(-1), scores.reshape(-1), wide)

    given = index.lists.mapInArrow(run, _ENTRY.format(index.score_type))
    order = Window.partitionBy("q", "list").orderBy(F.col("local").desc(), "vec")
    return given.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def reaching(index: Index, asked, shares) -> DataFrame:
    """Phase 2: all entries of all lists that reach their query's share of the cutoff."""
    width, wide = index.width, index.wide

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Asked = asked.value
        least = shares.value[:, None]
        for j, vec, scores in _local_scores(own, batches, width, wide):
            q, x = np.nonzero(scores >= least)
            if len(q):
                yield _entries(own.vecs, j, q, vec[x], scores[q, x], wide)

    return index.lists.mapInArrow(run, _ENTRY.format(index.score_type))


def fetched(index: Index, asked, wanted: DataFrame) -> DataFrame:
    """Phase 3: exact local scores of the wanted ``(q, vec, list)``."""
    width, wide = index.width, index.wide

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Asked = asked.value
        order = np.argsort(own.vecs)
        for batch in batches:
            q = order[np.searchsorted(own.vecs[order], batch.column("q").to_numpy())]
            number, vec = batch.column("list").to_numpy(), batch.column("vec").to_numpy()
            for j in np.unique(number).tolist():
                at = np.flatnonzero(number == j)
                values = matrix(batch.column("values").take(pa.array(at)), width, wide)
                yield _entries(own.vecs, j, q[at], vec[at], (own.matrices[j][q[at]] * values).sum(axis=1), wide)

    return wanted.join(index.lists, ["list", "vec"]).select("q", "vec", "list", "values").mapInArrow(run, _ENTRY.format(index.score_type))


def sums(entries: DataFrame, kind: str) -> DataFrame:
    """``(q, vec, known, lists)``: the sum of the known local scores and the lists that gave them."""
    return entries.groupBy("q", "vec").agg(F.sum("local").cast(kind).alias("known"), F.collect_set("list").alias("lists"))


def completed(index: Index, asked, partial: DataFrame) -> DataFrame:
    """``(q, vec, score)``: sums whose missing lists have been fetched. ``partial`` is read twice, so it should be stored."""
    every = F.array(*[F.lit(j) for j in range(index.n_lists)])
    missing = partial.select("q", "vec", F.explode(F.array_except(every, F.col("lists"))).alias("list"))
    more = fetched(index, asked, missing).select("q", "vec", F.col("local").alias("known"))
    added = partial.select("q", "vec", "known").unionByName(more)
    return added.groupBy("q", "vec").agg(F.sum("known").cast(index.score_type).alias("score"))


def kth(scored: DataFrame, k: int) -> DataFrame:
    """``(q, cutoff)`` of the queries that have ``k`` full scores."""
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec")
    return scored.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select("q", F.col("score").alias("cutoff"))


def searched(index: Index, vecs: DataFrame, k: int) -> DataFrame:
    """One pass: full scores of all vectors that can be among the ``k`` best of a query vector: ``(q, vec, score)``."""
    context = index.lists.sparkSession.sparkContext
    here = collected(index, vecs)
    asked = context.broadcast(here)
    seeds = stored(sums(best_local(index, asked, k), index.score_type), "topk-seeds")
    seeded = stored(completed(index, asked, seeds), "topk-seeded")
    # one number per query of the pass; a query with fewer than k vectors has no cutoff and is given everything
    cutoffs = {row["q"]: int(row["cutoff"]) for row in kth(seeded, k).collect()}
    least = -(1 << 125)
    shares = [-(-cutoffs[q] // index.n_lists) if q in cutoffs else least for q in here.vecs.tolist()]
    share = context.broadcast(np.array(shares, object if index.wide else np.float64))
    partial = stored(sums(reaching(index, asked, share), index.score_type), "topk-reaching")
    full = partial.where(F.size("lists") == index.n_lists).select("q", "vec", F.col("known").alias("score"))
    better = kth(seeded.unionByName(full).distinct(), k)
    bounds = share_rows(index, here.vecs, shares).join(better, "q", "left")
    # a list that gave no entry holds less than the share that phase 2 asked for
    most = F.col("known") + (index.n_lists - F.size("lists")) * (F.col("share") - 1)
    hopeful = partial.join(F.broadcast(bounds), "q").where(F.col("cutoff").isNull() | (most >= F.col("cutoff")))
    hopeful = stored(hopeful.select("q", "vec", "known", "lists"), "topk-hopeful")
    return stored(completed(index, asked, hopeful), "topk-scores")


def share_rows(index: Index, vecs: np.ndarray, shares: list[int]) -> DataFrame:
    """``(q, share)`` of one pass."""
    values = pa.array([Decimal(x) for x in shares], pa.decimal128(38, 0))
    table = pa.table({"q": pa.array(vecs, pa.int64()), "share": values if index.wide else values.cast(pa.int64(), safe=False)})
    return index.lists.sparkSession.createDataFrame(table)


def search(vectors: DataFrame, is_query: Column, k: int = 10, lists: int = 2, scale: int = 1024, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The ``k`` rows with the highest integer inner product for every row that ``is_query`` selects, itself left out.

    ``(query_id, rank, vec_id, score)``; all rows if there are fewer than ``k``; ties go to the smaller id, rows without an id
    come last among them. Components are ``floor(scale * x)``. A vector that is null or holds null or a number that is not
    finite takes no part. Missing components of a shorter vector count as 0, an empty vector scores 0. Components are held at
    2**53 and scores at the ends of ``long``. Repeated rows are candidates each; a query row leaves out itself only, and repeated
    query rows give their ranks once each. Rows without an id ask nothing. Other columns, whatever their names, stay behind. An
    empty table, or one without queries, gives no rows.
    """
    spark = vectors.sparkSession
    index = build(vectors, is_query & F.col("vec_id").isNotNull(), k, lists, scale)
    asking = stored(index.queries.select("vec").distinct(), "topk-asking")
    passes = -(-asking.count() * index.width * lists * 8 // pass_bytes)
    found = [searched(index, asking.where(F.pmod(F.xxhash64("vec"), F.lit(passes)) == i), k + 1) for i in range(passes)]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    scored = reduce(DataFrame.unionByName, found).join(index.ids, "vec")
    # the k + 1 best rows of each query vector; one of them may be the asking row itself
    rows = scored.select("q", "vec", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "vec")
    near = rows.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    # at most k + 1 rows come together
    lists_ = near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("n", "vec", "vec_id", "score"))).alias("best"))
    found_for = index.queries.withColumnRenamed("vec", "q").join(lists_, "q")
    own = F.array_position(F.transform("best", lambda x: (x["vec"] == F.col("q")) & (x["vec_id"] == F.col("query_id"))), F.lit(True))
    others = F.slice(F.filter("best", lambda _, i: i + 1 != F.col("own")), 1, k)
    ranked = found_for.withColumn("own", own).select("query_id", F.posexplode(others).alias("at", "row"))
    ends = F.least(F.greatest(F.col("row.score"), F.lit(-(2**63))), F.lit(2**63 - 1)) if index.wide else F.col("row.score")
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("row.vec_id").alias("vec_id"), ends.cast("long").alias("score"))
