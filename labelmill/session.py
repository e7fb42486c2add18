"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every plan here is written for. Joins on metadata keys may meet one key that
# holds a large part of the rows; AQE splits such a partition while the query runs.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # heads of up to this many rows per group are cut before the shuffle
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    # documents are bucketed by application number and looked up by that and the year
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach: the one named in ``spark.checkpoint.dir``, else one in the warehouse."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not context.master.startswith("local") and (warehouse.startswith("file:") or "://" not in warehouse):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{warehouse}/scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core a share of a small input before work that is heavy per row.

    A small file often is a single row group, which one task would process alone. An input
    that already has partitions for all cores, as any large one has, is returned untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(cores, key)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back, so that several branches share one computation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
