"""How a sequence of filters interacts, for every order in which they can be applied.

A document's outcome depends only on the set of filters it fails, its mask. For each mask a big integer is made whose fields
hold, for every order and step, whether such a document is removed there, fails there but was removed earlier, or fails
nothing else. Adding up one integer per document would give all counts at once, and so does adding each mask's integer
times the number of its documents. Fields are as wide as the part's document count, so no field can run over into the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import stored, utf8

# The filters and their limits.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_SHARE, CAPITALS_SHARE, SYMBOLS = 200, 50, 3, b"#$%&*|"

_CAPITALS = bytes(range(65, 91))
# UTF-8 bytes that continue a code point
_LATER_BYTES = bytes(range(0x80, 0xC0))
ORDERS = ["".join(order) for order in permutations(FILTERS)]
# Outcomes of a step: removed here, failing but removed earlier, failing nothing else.
OUTCOMES = 3


def failed(text: bytes) -> int:
    """Bits 0 to 3 for the filters A to D; bit 4, of E, needs the whole table."""
    # bytes.split() cuts at the space and U+0009 to U+000D
    words = text.split()
    points = len(text) if text.isascii() else len(text.translate(None, _LATER_BYTES))
    mask = len(words) < LEAST_WORDS
    mask |= (100 * len(set(words)) < DISTINCT_SHARE * len(words)) << 1
    mask |= (100 * (len(text) - len(text.translate(None, _CAPITALS))) > CAPITALS_SHARE * points) << 2
    return mask | (len(text.translate(None, SYMBOLS)) < len(text)) << 3


@cache
def packed_outcomes(mask: int, width: int) -> int:
    """The outcomes of one document with this mask, as fields of ``width`` bits: by order, step, kind of outcome."""
    total, place = 0, 0
    for order in ORDERS:
        gone = False
        for letter in order:
            bit = 1 << FILTERS.index(letter)
            if mask & bit:
                total |= 1 << place + width * gone
                if mask == bit:
                    total |= 1 << place + 2 * width
                gone = True
            place += OUTCOMES * width
    return total


def unpacked(total: int, width: int) -> list[int]:
    field = (1 << width) - 1
    data = total.to_bytes((len(ORDERS) * len(FILTERS) * OUTCOMES * width + 7) // 8, "little")
    if width % 8 == 0:
        step = width // 8
        return [int.from_bytes(data[at : at + step], "little") for at in range(0, len(ORDERS) * len(FILTERS) * OUTCOMES * step, step)]
    return [total >> width * i & field for i in range(len(ORDERS) * len(FILTERS) * OUTCOMES)]


def audited(part: str, counts: list[tuple[int, int, int, int]]) -> Iterator[tuple]:
    """The 600 rows of a part from ``(mask, documents, of them good, of them toxic)``."""
    documents = sum(n for _, n, _, _ in counts)
    width = 8 * max(1, (documents.bit_length() + 7) // 8)
    sums = [sum(packed_outcomes(mask, width) * each[i] for mask, *each in counts) for i in range(3)]
    every, good, toxic = (unpacked(total, width) for total in sums)
    fields = [(order, step, OUTCOMES * (len(FILTERS) * i + step)) for i, order in enumerate(ORDERS) for step in range(len(FILTERS))]
    shapley = dict.fromkeys(FILTERS, 0)
    for order, step, at in fields:
        shapley[order[step]] += every[at]
    kept = documents
    for order, step, at in fields:
        kept = (kept if step else documents) - every[at]
        yield part, order, step + 1, kept, every[at], every[at + 1], every[at + 2], good[at], toxic[at], shapley[order[step]], order[step]


_SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, "
    "shapley long, filter string"
)


def masks(docs: DataFrame, part: str) -> DataFrame:
    """``(doc_id, part, mask, text_key)``: the filters A to D that a row fails, and a digest of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text"):
                data = text.as_py()
                found.append((failed(data), hashlib.sha256(data).digest()[:16]))
            columns = {"doc_id": batch.column("doc_id"), "part": batch.column("part")}
            columns |= {"mask": pa.array([mask for mask, _ in found], pa.int32()), "text_key": pa.array([key for _, key in found], pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), utf8().alias("text"))
    return narrow.mapInArrow(run, "doc_id long, part string, mask int, text_key binary")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """All orders and steps for every value of the column ``part``, 600 rows each, zeros included.

    ``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley, filter)``. A null part is the
    empty string; a null text is empty, and all empty texts are alike. A row fails E if a row with a smaller id has its text: rows
    without an id neither fail E nor make others fail, and rows that repeat the first id of a text do not fail. A document is good
    or toxic if any of its labels says so; rows that share an id share its labels; null labels and labels without an id say
    nothing. An empty table gives no rows.

    Texts stay where they are read. Rows meet by id and text together, so a text that many rows have is spread out.
    """
    rows = stored(masks(docs, part), "filter-masks")
    # as one value, so that rows are dealt by id and text together
    place = F.struct("doc_id", "text_key").alias("place")
    firsts = rows.where("doc_id IS NOT NULL").groupBy("text_key").agg(F.min("doc_id").alias("doc_id")).select(place, F.lit(0).alias("later"))
    says = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        *(F.max(F.coalesce(F.col(name) == 1, F.lit(False)).cast("int")).alias(name) for name in ("quality", "toxic"))
    )
    named = rows.where("doc_id IS NOT NULL").join(says, "doc_id", "left").withColumn("place", place).join(firsts, "place", "left")
    own = named.select("part", (F.col("mask") + 16 * F.coalesce("later", F.lit(1))).alias("mask"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("quality", "toxic")))
    nameless = rows.where("doc_id IS NULL").select("part", "mask", F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    counts = own.unionByName(nameless).groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("bad"))

    def run(table: pa.Table) -> pa.Table:
        found = list(zip(*(table.column(c).to_pylist() for c in ("mask", "n", "good", "bad")), strict=True))
        out = list(audited(table.column("part")[0].as_py(), found))
        kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[field.split()[1]] for field in _SCHEMA.split(", ")]
        names = [field.split()[0] for field in _SCHEMA.split(", ")]
        return pa.Table.from_arrays([pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)], names)

    # at most 32 rows per part
    return counts.groupBy("part").applyInArrow(run, _SCHEMA)
