"""Helpers shared by the operators: tables, shared scratch data, bounded chunks, byte packing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space that separates words, as bytes or code points: the space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"

# Bytes of text that one numpy pass holds; a longer document is a pass of its own.
CHUNK_BYTES = 2 << 20

Chunk = tuple[list[int], list[bytes]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str = "text") -> Column:
    """The text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"").cast("binary"))


def narrow(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with the text as bytes; other columns, whatever their names, stay behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))


def text_key(column: str = "text") -> Column:
    """16 bytes of the SHA-256 of the text; null is empty. Rows of one id, or none, and one key are one document repeated."""
    return F.unhex(F.substring(F.sha2(utf8(column), 256), 1, 32))


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``, else one under the warehouse."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and (warehouse.startswith("file:") or "://" not in warehouse):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{warehouse}/scratch"


def stored(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    # nothing reads the shuffle files of a finished write again; without this they fill the executors' disks until the
    # driver happens to collect its garbage
    release = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(release, "false")
    spark.conf.set(release, "true")
    try:
        (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    finally:
        spark.conf.set(release, before)
    return spark.read.schema(df.schema).parquet(path)


def without(docs: DataFrame, dropped: DataFrame, bound: int = 250_000) -> DataFrame:
    """The rows of ``docs`` whose id and text are not in ``dropped (doc_id, text_key)``; null ids are equal to each other.

    A row goes by its own text, whoever shares its id. Up to ``bound`` keys are broadcast, more are joined.
    """
    keys = stored(dropped.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "dropped")
    same = docs["doc_id"].cast("long").eqNullSafe(keys["_id"]) & (text_key() == keys["_key"])
    return docs.join(F.broadcast(keys) if keys.count() <= bound else keys, same, "left_anti")


def parts(spark: SparkSession) -> int:
    """Partitions of a shuffle; results do not depend on it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunked(ids: Iterable[int], texts: Iterable[bytes], limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Consecutive documents, together at most ``limit`` bytes unless one alone is longer."""
    some: Chunk = ([], [])
    size = 0
    for key, text in zip(ids, texts, strict=True):
        if some[0] and size + len(text) > limit:
            yield some
            some, size = ([], []), 0
        some[0].append(key)
        some[1].append(text)
        size += len(text)
    if some[0]:
        yield some


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    out = values.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        out ^= out >> np.uint64(shift)
        out *= np.uint64(factor)
    return out ^ (out >> np.uint64(33))


def joined_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit hash of an ordered pair of hashes."""
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93))


def gram_hash(units: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive units, by doubling: about 2 log2(n) passes."""
    length, power, done, result = len(units) - n + 1, units, 1, None
    if length <= 0:
        return np.empty(0, np.uint64)
    offset = 0
    while True:
        if n & done:
            piece = power[offset : offset + length]
            result = piece.copy() if result is None else joined_hash(result, piece)
            offset += done
        if 2 * done > n:
            return result
        power = joined_hash(power[:-done], power[done:])
        done *= 2


def windowed_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` consecutive values, by doubling."""
    power, done = values, 1
    while 2 * done <= width:
        power = np.minimum(power[:-done], power[done:])
        done *= 2
    rest = width - done
    return np.minimum(power[: len(power) - rest], power[rest:]) if rest else power


def give_back() -> None:
    """Memory that this process has freed goes back to the system, which an allocator does not do by itself while the process lives."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_HELD: dict[str, Callable[[], None]] = {}


def hold(owner: str, release: Callable[[], None] | None = None) -> None:
    """Caches of one operator only stay in a Python worker: what the operator before kept in this process is released."""
    for other in [name for name in _HELD if name != owner]:
        _HELD.pop(other)()
        pa.default_memory_pool().release_unused()
    if release:
        _HELD[owner] = release


class WordHashes:
    """64-bit hashes of words by a per-process dictionary of bounded size; equal words, equal hashes, in any process."""

    def __init__(self, bound: int = 400_000):
        hold("words")
        self.bound, self.known = bound, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > self.bound:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
