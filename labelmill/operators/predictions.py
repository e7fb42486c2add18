"""Sets of predictions against the metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_ids(metadata: DataFrame, ids: DataFrame, key: str = "application_number") -> DataFrame:
    """Metadata rows whose id occurs in ``ids``; a semi join, the list never reaches the driver."""
    return metadata.join(ids.select(key), key, "left_semi")


def tag(df: DataFrame, prediction: str) -> DataFrame:
    return df.withColumn("Prediction", F.lit(prediction))


def tagged_union(correct: DataFrame, incorrect: DataFrame) -> DataFrame:
    return tag(correct, "Correct").unionByName(tag(incorrect, "Incorrect"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Bag union by column name; duplicates stay."""
    return reduce(DataFrame.unionByName, parts)


def with_outcome(metadata: DataFrame, predictions: DataFrame, key: str = "application_number") -> DataFrame:
    """Metadata with its outcome in one join instead of one semi join per outcome; a null ``correct`` is no outcome."""
    predictions = predictions.where(F.col("correct").isNotNull())
    outcome = F.when(F.col("correct"), F.lit("Correct")).otherwise(F.lit("Incorrect"))
    return metadata.join(predictions.select(key, outcome.alias("Prediction")), key)
