"""Seeded pseudo-random keys. A row's key depends on its id and the seed alone, so a recomputed
task, a second scan and another engine all see the same order."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(identifier, seed) -> Column:
    """32 hex digits that order rows at random; ties only between equal ids."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(identifier).cast("string")))


def _leading_digits(key: Column, digits: int) -> Column:
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("long")


def unit_interval(key: Column) -> Column:
    """A double strictly between 0 and 1 from the first 12 hex digits."""
    return (_leading_digits(key, 12) + F.lit(0.5)) / F.lit(float(16**12))


def hash_below(key: Column, share: float) -> Column:
    """True for about ``share`` of the keys, decided from the key alone in steps of 1/10000."""
    return _leading_digits(key, 8) % 10_000 < F.lit(round(share * 10_000))
