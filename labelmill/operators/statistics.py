"""Counts, class weights and the error breakdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.operators.distribution import exact_quantiles, group_map
from labelmill.session import materialise

OUTCOMES = ("Correct", "Incorrect")


def label_stats(df: DataFrame, by: tuple[str, ...] = ("split", "labels")) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def class_weights(df: DataFrame, label: str = "labels") -> DataFrame:
    """Each of the two classes weighs as much as the share of the other one."""
    share = df.agg(F.avg(F.col(label).cast("double")).alias("one"))
    return share.select(
        F.explode(
            F.array(
                F.struct(F.lit(1).alias(label), (1 - F.col("one")).alias("weight")),
                F.struct(F.lit(0).alias(label), F.col("one").alias("weight")),
            )
        ).alias("entry")
    ).select("entry.*")


def with_row_weights(df: DataFrame, label: str = "labels") -> DataFrame:
    """Add the class weight of each row as ``weight``; one scalar, no join."""
    one = df.agg(F.avg(F.col(label).cast("double"))).scalar()
    return df.withColumn("weight", F.when(F.col(label) == 1, 1 - one).otherwise(one))


def outcome_pivot(df: DataFrame, feature: str, fill: bool = True) -> DataFrame:
    """Rows per feature value and outcome; absent cells are 0, or null without ``fill``.

    A null feature value forms no row.
    """
    counts = (
        df.where(F.col(feature).isNotNull()).groupBy(feature).pivot("Prediction", list(OUTCOMES)).agg(F.count(F.lit(1)))
    )
    return counts.fillna(0, list(OUTCOMES)) if fill else counts


def outcome_gap(df: DataFrame, feature: str, threshold: int = 5) -> DataFrame:
    """Feature values whose outcome counts differ by more than ``threshold``."""
    gap = F.abs(F.col("Correct") - F.col("Incorrect"))
    return outcome_pivot(df, feature).withColumn("Difference", gap).where(F.col("Difference") > threshold)


def box_stats(df: DataFrame, feature: str, group: str = "Prediction") -> DataFrame:
    """Quartiles, whiskers within 1.5 interquartile ranges and outlier count of each group."""
    # two narrow columns, written once because the sketch, the brackets and the whiskers read them
    clean = materialise(df.where(F.col(feature).isNotNull()).select(group, F.col(feature).cast("double").alias(feature)), "feature")
    quartiles = exact_quantiles(clean, group, feature, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    fences = quartiles.select(group, "q1", "median", "q3", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))
    boxes = group_map(fences, group, F.struct("q1", "median", "q3", "low", "high"))
    box = F.col("box")
    below, above = F.col("value") < box["low"], F.col("value") > box["high"]
    # a whisker ends at the outermost value inside its fence; a box without one keeps its edge
    return (
        clean.select(group, F.col(feature).alias("value"), boxes[F.col(group)].alias("box"))
        .groupBy(group, "box")
        .agg(
            F.count("*").alias("n"),
            F.min(F.when(~below, F.col("value"))).alias("low"),
            F.max(F.when(~above, F.col("value"))).alias("high"),
            F.count_if(below | above).alias("outliers"),
        )
        .select(
            group, "n", "box.q1", "box.median", "box.q3",
            F.least("low", "box.q1").alias("whislo"),
            F.greatest("high", "box.q3").alias("whishi"),
            "outliers",
        )
    )


def section_length_stats(df: DataFrame, text: str, group: str = "split") -> DataFrame:
    """Longest, mean and median section length per split, in characters."""
    lengths = materialise(df.select(group, F.length(text).cast("long").alias("length")).where("length IS NOT NULL"), "lengths")
    medians = exact_quantiles(lengths, group, "length", {"median_length": 0.5})
    ends = lengths.groupBy(group).agg(F.max("length").alias("max_length"), F.avg("length").alias("mean_length"))
    return medians.join(ends, group)
