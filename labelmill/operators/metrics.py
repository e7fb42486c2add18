"""Evaluation of predictions ``(label, pred, score)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.operators.distribution import cumulative, histogram

CLASSES = (1, 0)
# Probabilities are kept this far from 0 and 1 before taking logs.
CLIP = 1e-12


def _cell(label: int, pred: int) -> Column:
    return F.count_if((F.col("label") == label) & (F.col("pred") == pred))


def _f1() -> Column:
    errors = F.count_if(F.col("label") != F.col("pred"))
    return F.coalesce(F.try_divide(2.0 * _cell(1, 1), 2 * _cell(1, 1) + errors), F.lit(0.0))


def _accuracy_columns() -> list[Column]:
    right = F.count_if(F.col("label") == F.col("pred"))
    return [
        F.count("*").alias("n"),
        right.alias("correct"),
        F.try_divide(right.cast("double"), F.count("*")).alias("accuracy"),
    ]


def _f1_columns() -> list[Column]:
    return [_cell(1, 1).alias("tp"), _cell(0, 1).alias("fp"), _cell(1, 0).alias("fn"), _f1().alias("f1")]


def accuracy(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*_accuracy_columns())


def evaluate(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy and F1 with their counts in one pass over the predictions."""
    return df.groupBy(*by).agg(*_accuracy_columns(), *_f1_columns())


def confusion_matrix(df: DataFrame, classes: tuple[int, ...] = CLASSES) -> DataFrame:
    """``(label, pred, n)`` with every cell present; rows are true, columns predicted."""
    cells = [(label, pred) for label in classes for pred in classes]
    counts = df.agg(*(_cell(label, pred).alias(f"c_{label}_{pred}") for label, pred in cells))
    entries = F.array(
        *(F.struct(F.lit(label).alias("label"), F.lit(pred).alias("pred"), F.col(f"c_{label}_{pred}").alias("n")) for label, pred in cells)
    )
    return counts.select(F.explode(entries).alias("cell")).select("cell.*")


def f1_score(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """F1 of class 1 for binary predictions, 0 when it is not defined."""
    return df.groupBy(*by).agg(*_f1_columns())


def batch_metrics(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    return df.groupBy(batch).agg(*_accuracy_columns(), _f1().alias("f1"))


def average_precision(df: DataFrame, slices: int | None = None) -> DataFrame:
    """Area under the precision-recall curve of ``score``: sum of precision times recall gained.

    Equal scores form one step. Exact for any number of rows.
    """
    hist = histogram(df, [], "score", {"positives": F.col("label").cast("long"), "rows": F.lit(1).cast("long")})
    steps = cumulative(hist, [], "score", ["positives", "rows"], descending=True, slices=slices)
    gained = F.sum(F.col("positives") * F.col("cum_positives") / F.col("cum_rows"))
    return steps.agg(
        F.coalesce(F.sum("positives"), F.lit(0)).alias("positives"),
        F.coalesce(F.try_divide(gained, F.sum("positives")), F.lit(0.0)).alias("auprc"),
    )


def _loss_terms() -> Column:
    p = F.greatest(F.least(F.col("score"), F.lit(1 - CLIP)), F.lit(CLIP))
    return -F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))


def cross_entropy(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Weighted mean of the log loss over all rows: ``score`` is the probability of class 1."""
    total = F.sum("weight")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.try_divide(F.sum(F.col("weight") * _loss_terms()), total).alias("loss")
    )


def accuracy_vs_majority(df: DataFrame) -> DataFrame:
    n = F.count("*").cast("double")
    ones, zeros = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    return df.agg(
        F.try_divide(F.count_if(F.col("label") == F.col("pred")).cast("double"), n).alias("accuracy"),
        F.try_divide(F.greatest(ones, zeros).cast("double"), n).alias("majority"),
    ).withColumn("gain", F.col("accuracy") - F.col("majority"))
