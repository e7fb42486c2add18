"""What a run leaves behind. Writers act at once; everything else is lazy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.config import SPLIT_SEED
from labelmill.operators.commits import commit, committed
from labelmill.operators.splits import ID, seeded_shuffle

_METRIC = "run_id string, tag string, step long, value double"


def write_predictions(predictions: DataFrame, path: str) -> None:
    """The ids of correct and of incorrect predictions, as JSON under ``correct=true`` and ``false``."""
    predictions.select(ID, "correct").write.partitionBy("correct").json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{ID} string, correct boolean").json(path)


def metrics_report(metrics: dict[str, DataFrame], run_id: str, step: int) -> DataFrame:
    """One row per number: ``metrics`` maps a prefix to a one-row table of numeric columns."""
    reports = None
    for prefix, table in metrics.items():
        entries = F.array(
            *(F.struct(F.lit(f"{prefix}{name}").alias("tag"), F.col(name).cast("double").alias("value")) for name in table.columns)
        )
        rows = table.select(F.explode(entries).alias("entry")).select(
            F.lit(run_id).alias("run_id"), "entry.tag", F.lit(step).cast("long").alias("step"), "entry.value"
        )
        reports = rows if reports is None else reports.unionByName(rows)
    return reports


def append_metrics(report: DataFrame, path: str) -> None:
    """Append in one commit; a tag of a run and step that is written again replaces what it had."""
    commit(report, path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Committed reports only, each tag of a run and step once."""
    return committed(spark, path, _METRIC, ["run_id", "step", "tag"])


def export_csv(df: DataFrame, path: str) -> None:
    df.write.option("escape", '"').csv(path, header=True)


def materialise_splits(df: DataFrame, path: str) -> None:
    """Both splits as Parquet partitioned by ``split``; files are evenly sized within a split."""
    df.hint("rebalance", "split").write.partitionBy("split").parquet(path)


def assign_batches(df: DataFrame, size: int, seed: int = SPLIT_SEED, identifier: str = ID) -> DataFrame:
    """Shuffle by seed and number consecutive batches of ``size`` rows."""
    placed = seeded_shuffle(df, seed, identifier)
    return placed.withColumn("batch_id", F.floor(F.col("position") / size))


def write_batches(batched: DataFrame, path: str) -> None:
    """Batches in order; one batch lies in one file."""
    batched.repartitionByRange("batch_id").sortWithinPartitions("position").write.parquet(path)


def step_budget(df: DataFrame, batch: int, accumulation: int) -> DataFrame:
    """Optimiser steps one pass over ``df`` allows."""
    return df.agg(F.count("*").alias("rows")).withColumn("max_steps", F.floor(F.col("rows") / (batch * accumulation)))
