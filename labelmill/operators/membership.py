"""Membership in a very long list of ids: most rows that are no members never move.

A Bloom filter of the ids is built in the tasks that read them, as bitmaps that are combined by built-in functions. Rows are tested
against it where they are read; only possible members are shuffled for the exact semi join behind it.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.session import materialise

# Bits per id, the largest filter (16 MB), bits of one bitmap, and hashes per id.
BITS_PER_ID, MOST_BITS, BITMAP, HASHES = 12, 1 << 27, 32_768, 4


def _places(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def bloom_filter(ids: DataFrame, key: str, bits: int) -> DataFrame:
    """One row with ``bitmaps``, an array of bitmaps (null where no bit is set); written once. ``bits`` is a multiple of 32768."""
    places = ids.where(F.col(key).isNotNull()).select(F.explode(F.array(*_places(F.col(key), bits))).alias("place"))
    bucketed = places.select(F.expr(f"CAST(place DIV {BITMAP} AS INT)").alias("bucket"), (F.col("place") % BITMAP).alias("bit"))
    maps = bucketed.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    every = ids.sparkSession.range(bits // BITMAP).select(F.col("id").cast("int").alias("bucket"))
    dense = every.join(maps, "bucket", "left").select(F.struct("bucket", "bitmap").alias("entry"))
    # at most MOST_BITS come together
    return materialise(dense.agg(F.transform(F.array_sort(F.collect_list("entry")), lambda entry: entry["bitmap"]).alias("bitmaps")), "bloom")


def possible(filter_: DataFrame, key: Column, bits: int) -> Column:
    """False only for keys that are not in the filter's ids."""
    bitmaps = filter_.select("bitmaps").scalar()

    def is_set(place: Column) -> Column:
        bitmap = F.get(bitmaps, F.floor(place / BITMAP).cast("int"))
        at = (place % BITMAP).cast("int")
        byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        bit = F.pow(F.lit(2), at % 8).cast("int")
        return F.coalesce(byte.bitwiseAND(bit) > 0, F.lit(False))

    return key.isNotNull() & reduce(and_, map(is_set, _places(key, bits)))


def filter_bits(n: int) -> int:
    """Bits for ``n`` ids: whole bitmaps, at most ``MOST_BITS``; beyond that more rows pass the filter, and the join decides."""
    return min(MOST_BITS, BITMAP * max(1, -(-n * BITS_PER_ID // BITMAP)))


def with_listed_ids(metadata: DataFrame, ids: DataFrame, key: str = "application_number", bits: int | None = None) -> DataFrame:
    """The rows of ``with_ids``: those whose id is in ``ids``. Reads ``ids`` for the filter and once more for the join.

    Null ids are members of nothing; repeated ids count once.
    """
    bits = bits or filter_bits(ids.count())
    sieve = bloom_filter(ids, key, bits)
    return metadata.where(possible(sieve, F.col(key), bits)).join(ids.select(key), key, "left_semi")
