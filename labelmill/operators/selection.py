"""Exact counts and exact positions without sorting everything in one task.

A key is cut into buckets that follow its order. One aggregation counts rows per bucket
(combined on the map side), a running sum over those few counts finds the bucket holding the
k-th row, and only that bucket is ranked. What comes back to the rows is one cut key per group,
so the last step is a plain filter: no row-scale shuffle, whatever the size of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hex digits of a seeded key that name its bucket: 16**4 buckets.
BUCKET_DIGITS = 4
MAX_BUCKET_DIGITS = 5


def hex_bucket(key: str, digits: int = BUCKET_DIGITS) -> Column:
    if not 1 <= digits <= MAX_BUCKET_DIGITS:
        raise ValueError(f"digits must be between 1 and {MAX_BUCKET_DIGITS}")
    return F.substring(F.col(key), 1, digits)


def _as_map(df: DataFrame, key: str, value: str) -> Column:
    """``df`` holds one row per group, and groups are few: hand it over as one scalar map."""
    return df.agg(F.map_from_entries(F.collect_list(F.struct(key, value)))).scalar()


def cut_keys(df: DataFrame, key: str, bucket: Column, take: Column, group: Column | None = None) -> Column:
    """Map from group to the key of its ``take``-th smallest row.

    ``take`` may use the column ``total``, the size of the group. Groups must be few (classes or
    splits, not ids), keys unique within a group, and ``bucket`` non-decreasing in the key.
    """
    group = F.lit("all") if group is None else group
    keyed = df.select(group.alias("_group"), F.col(key).alias("_key"), bucket.alias("_bucket"))
    by_bucket = Window.partitionBy("_group").orderBy("_bucket")
    counts = keyed.groupBy("_group", "_bucket").agg(F.count("*").alias("n"))
    boundary = (
        counts.withColumn("total", F.sum("n").over(Window.partitionBy("_group")))
        .withColumn("upto", F.sum("n").over(by_bucket.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("wanted", F.least(take.cast("long"), F.col("total")))
        .where("upto >= wanted AND upto - n < wanted")
        .select("_group", "_bucket", (F.col("wanted") - F.col("upto") + F.col("n")).alias("wanted"))
    )
    # one row per group, so the broadcast is as small as the map that is returned
    ranked = (
        keyed.join(F.broadcast(boundary), ["_group", "_bucket"])
        .withColumn("rank", F.row_number().over(Window.partitionBy("_group").orderBy("_key")))
        .where("rank = wanted")
    )
    return _as_map(ranked, "_group", "_key")


def smallest(df: DataFrame, key: str, bucket: Column, take: Column, group: Column | None = None) -> DataFrame:
    """The ``take`` rows with the smallest keys of each group, exactly."""
    cuts = cut_keys(df, key, bucket, take, group)
    return df.where(F.col(key) <= cuts[F.lit("all") if group is None else group])


def positions(
    df: DataFrame, key: str, digits: int = BUCKET_DIGITS, size: Column | None = None, into: str = "position"
) -> DataFrame:
    """Add the zero-based place of each row in the order of a seeded key.

    With ``size``, rows take up that many places each. Rows shuffle once, to evenly filled
    buckets. The bucket offsets are at most 16**digits narrow rows, which bounds what is
    broadcast. ``df`` is read twice; write it first if that is expensive.
    """
    size = F.lit(1) if size is None else size
    bucketed = df.withColumns({"_bucket": hex_bucket(key, digits), "_size": size.cast("long")})
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy("_bucket")
        .agg(F.sum("_size").alias("n"))
        .select("_bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    place = F.sum("_size").over(inside) - F.col("_size")
    return (
        bucketed.join(F.broadcast(offsets), "_bucket")
        .withColumn(into, F.col("_offset") + place)
        .drop("_bucket", "_offset", "_size")
    )
