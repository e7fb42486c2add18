"""Benchmark decontamination by winnowing.

Every window of a benchmark item has a fingerprint, the smallest hash of its k-grams; so has every window of a document.
Equal windows have equal fingerprints, so a document window whose fingerprint is no benchmark fingerprint needs no
further look: no shared window is missed. Those that pass are compared word by word and extend to hit spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import WordHashes, chunked, gram_hash, joined_hash, narrow, stored, text_key, windowed_min

# Words of a window, words of a fingerprinted gram, and the share of hit words (1 in ...) that contaminates.
WINDOW, GRAM, SHARE = 13, 5, 20
# Windows of the benchmark that may be broadcast (about 100 bytes each); more are joined.
PACK_WINDOWS = 200_000

# Bytes of a word: a-z, 0-9 and all of UTF-8 beyond ASCII.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(WORD_BYTES).split()


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(window, size, items)``: each distinct window of the benchmark, its words, and the sorted ids of its items."""
    spaced = F.regexp_replace(F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")
    texts = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    split = texts.select("item_id", F.array_remove(F.split(spaced, " "), "").alias("words")).where("item_id IS NOT NULL AND size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (window - 1)))
    rows = split.select("item_id", F.least(F.lit(window), F.size("words")).alias("size"), "words", F.explode(starts).alias("start"))
    rows = rows.select("item_id", "size", F.concat_ws(" ", F.slice("words", F.col("start"), F.lit(window))).alias("window"))
    return rows.groupBy("window", "size").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def gram_of(size: int, gram: int) -> int:
    """Words of the fingerprinted grams in windows of ``size`` words."""
    return min(gram, size)


class Pack:
    """The windows of a bounded benchmark, ready for lookup."""

    def __init__(self, rows: list[tuple[str, int, list[str]]], gram: int):
        hashes = WordHashes()
        self.gram = gram
        self.items: dict[int, dict[bytes, list[str]]] = {}
        prints: dict[int, list[int]] = {}
        for window, size, items in rows:
            words = window.encode().split(b" ")
            self.items.setdefault(size, {})[window.encode()] = items
            prints.setdefault(size, []).append(int(gram_hash(hashes(words), gram_of(size, gram)).min()))
        self.prints = {size: np.unique(np.array(found, np.uint64)) for size, found in prints.items()}

    def hits(self, units: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
        """Starts of the windows, over concatenated documents, whose fingerprint is in the benchmark."""
        gram = gram_of(size, self.gram)
        grams = gram_hash(units, gram)
        if len(grams) < size - gram + 1:
            return np.empty(0, np.int64)
        least = windowed_min(grams, size - gram + 1)
        # neighbouring windows mostly share their fingerprint: look each run up once
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        prints = self.prints[size]
        at = np.minimum(np.searchsorted(prints, least[first]), len(prints) - 1)
        found = prints[at] == least[first]
        runs = np.diff(np.concatenate((first, [len(least)])))
        starts = np.flatnonzero(np.repeat(found, runs))
        ends = offsets[np.searchsorted(offsets, starts, side="right")]
        return starts[starts + size <= ends]  # a window lies within its document


def _scan(batches: Iterator[pa.RecordBatch], pack: Pack) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        keys = iter(batch.column("text_key").to_pylist())
        for ids, texts in chunked(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            split = [words_of(text) for text in texts]
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            words = [word for some in split for word in some]
            units = hashes(words)
            spans: list[list[tuple[int, int]]] = [[] for _ in ids]
            items: list[set[str]] = [set() for _ in ids]
            for size, known in pack.items.items():
                for start in pack.hits(units, offsets, size).tolist():
                    found = known.get(b" ".join(words[start : start + size]))
                    if found is not None:
                        doc = int(np.searchsorted(offsets, start, side="right")) - 1
                        begin = start - int(offsets[doc])
                        spans[doc].append((begin, begin + size))
                        items[doc].update(found)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(ids, pa.int64()),
                    "text_key": pa.array([next(keys) for _ in ids], pa.binary()),
                    "n_words": pa.array(sizes, pa.int64()),
                    "spans": pa.array([[list(span) for span in merged(some)] for some in spans], pa.list_(pa.list_(pa.int32()))),
                    "items": pa.array([sorted(some) for some in items], pa.list_(pa.string())),
                }
            )


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal spans of words."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, pack_windows: int = PACK_WINDOWS, keyed: bool = False) -> DataFrame:
    """Hit spans and items of every document: ``(doc_id, text_key, n_words, spans, items)``, one row for each row of ``docs``.

    Up to ``pack_windows`` windows of the benchmark are broadcast and the documents are read once, without a shuffle. More
    are joined on Spark and never pass through the driver. Both give the same rows. The key of the text may be null unless
    ``keyed``.
    """
    windows = item_windows(items, window)
    if windows.count() > pack_windows:
        return _joined_hits(docs, windows, gram)
    pack = docs.sparkSession.sparkContext.broadcast(Pack([(row["window"], row["size"], row["items"]) for row in windows.collect()], gram))

    def scan(batches):
        return _scan(batches, pack.value)

    rows = narrow(docs).withColumn("text_key", text_key() if keyed else F.lit(None).cast("binary"))
    return rows.mapInArrow(scan, "doc_id long, text_key binary, n_words long, spans array<array<int>>, items array<string>")


def window_prints(units: np.ndarray, size: int, gram: int) -> np.ndarray:
    """Fingerprints of all windows of ``size`` words of one text; windows of other sizes have other fingerprints."""
    gram = gram_of(size, gram)
    if len(units) < size:
        return np.empty(0, np.int64)
    least = windowed_min(gram_hash(units, gram), size - gram + 1)
    return joined_hash(least, np.array([size], np.uint64)).view(np.int64)


def _joined_hits(docs: DataFrame, windows: DataFrame, gram: int) -> DataFrame:
    """The hits by joins, for a benchmark of any size.

    Texts go by their key, so neither null nor shared ids mix rows. Fingerprints of the documents meet
    those of the benchmark; only windows with a common one are cut out, and meet the benchmark's windows themselves, each
    at most one. A document has about two fingerprints in ten words, and no row holds more than one document's matches.
    """
    known = stored(windows, "windows")
    sizes = sorted(row["size"] for row in known.select("size").distinct().collect())  # at most as many as words in a window
    key = text_key().alias("text_key")
    rows = narrow(docs)

    def known_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [int(window_prints(hashes(text.encode().split(b" ")), size, gram)[0]) for text, size in zip(batch.column("window").to_pylist(), batch.column("size").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"print": pa.array(found, pa.int64())})

    def own_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for keys, texts in chunked(zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), strict=True), batch.column("text").to_pylist()):
                split = [words_of(text) for text in texts]
                units = [hashes(words) for words in split]
                prints = [np.unique(np.concatenate([window_prints(some, size, gram) for size in sizes])) for some in units]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([key[0] for key in keys], pa.int64()),
                        "text_key": pa.array([key[1] for key in keys], pa.binary()),
                        "n_words": pa.array(map(len, split), pa.int64()),
                        "prints": pa.array(prints, pa.list_(pa.int64())),
                    }
                )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for key, text, prints in zip(*(batch.column(name).to_pylist() for name in ("text_key", "text", "prints")), strict=True):
                words = words_of(text)
                units, prints = hashes(words), np.array(prints, np.int64)
                for size in sizes:
                    starts = np.flatnonzero(np.isin(window_prints(units, size, gram), prints)).tolist()
                    yield pa.RecordBatch.from_pydict(
                        {
                            "text_key": pa.array([key] * len(starts), pa.binary()),
                            "begin": pa.array(starts, pa.int32()),
                            "size": pa.array([size] * len(starts), pa.int32()),
                            "window": pa.array([b" ".join(words[start : start + size]) for start in starts], pa.binary()),
                        }
                    )

    table = stored(rows.select("*", key).mapInArrow(own_prints, "doc_id long, text_key binary, n_words long, prints array<long>"), "prints")
    shared = table.select("text_key", F.explode("prints").alias("print")).join(known.mapInArrow(known_prints, "print long").distinct(), "print", "left_semi")
    shared = shared.groupBy("text_key").agg(F.collect_set("print").alias("prints"))
    places = rows.select("text", key).join(shared, "text_key").mapInArrow(cut, "text_key binary, begin int, size int, window binary")
    hits = places.join(known.select("size", F.col("window").cast("binary").alias("window"), "items"), ["size", "window"])
    # copies of a text bring the same spans and lists of items: sets keep them once
    spans = F.collect_set(F.array("begin", F.col("begin") + F.col("size")))
    hits = hits.groupBy("text_key").agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return table.join(hits, "text_key", "left").select(
        "doc_id",
        "text_key",
        "n_words",
        _merged_column(F.coalesce("spans", F.array().cast("array<array<int>>"))).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _merged_column(spans: Column) -> Column:
    empty = F.array().cast("array<array<int>>")

    def add(out: Column, span: Column) -> Column:
        last = F.element_at(out, -1)
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.array(last[0], F.greatest(last[1], span[1]))))
        return F.when((F.size(out) > 0) & (span[0] <= F.get(last, 1)), joined).otherwise(F.concat(out, F.array(span)))

    return F.aggregate(F.array_sort(spans), empty, add)


def judge(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, share: int = SHARE, pack_windows: int = PACK_WINDOWS, keyed: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans)`` for every document, if ``keyed`` with ``text_key``.

    A document is contaminated if at least one word in ``share`` is hit. Null and wordless texts have no words and are
    clean; wordless items match nothing; items with a null id are left out; repeated items count once per id. Each row is
    judged by its own text, so rows that are repeated, share an id or have none stay apart. An empty benchmark hits nothing.
    """
    hits = find_hits(docs, items, window, gram, pack_windows, keyed)
    n_hit = F.aggregate("spans", F.lit(0), lambda total, span: total + span[1] - span[0]).cast("long")
    counted = hits.withColumn("n_hit", n_hit)
    return counted.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "spans",
        *["text_key"] * keyed,
    )
