"""Analysis of the metric log ``(run_id, step, value)``; steps are whole and unique in a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.operators.running import running


def with_index(log: DataFrame, keys: list[str], order: str, parts: int | None = None) -> DataFrame:
    """Add ``i``, the zero-based place of each entry in its run."""
    return running(log, keys, order, {"i": ("count", F.lit(1), False)}, parts)


def running_mean(
    log: DataFrame, keys: list[str], order: str, value: str = "value", divide_by_index: bool = False, parts: int | None = None
) -> DataFrame:
    """Mean of the values so far. ``divide_by_index`` divides by ``max(i, 1)`` instead of ``i + 1``."""
    measures = {"i": ("count", F.lit(1), False), "total": ("sum", F.col(value), True)}
    summed = running(log, keys, order, measures, parts)
    divisor = F.greatest("i", F.lit(1)) if divide_by_index else F.col("i") + 1
    return summed.withColumn("running_mean", F.col("total") / divisor)


def best_so_far(log: DataFrame, keys: list[str], order: str, value: str = "value", parts: int | None = None) -> DataFrame:
    """``best`` up to each entry, and ``improved`` where the entry is strictly better than before.

    The first entry has to beat 0.
    """
    before = running(log, keys, order, {"_before": ("max", F.col(value), False)}, parts)
    reached = F.coalesce("_before", F.lit(0.0))
    return before.withColumns(
        {"best": F.greatest(reached, F.col(value)), "improved": F.col(value) > reached}
    ).drop("_before")


def every_nth_step(log: DataFrame, keys: list[str], order: str, n: int, parts: int | None = None) -> DataFrame:
    """Entries at every ``n``-th place of a run, but not the first one."""
    return with_index(log, keys, order, parts).where((F.col("i") % n == 0) & (F.col("i") != 0))


def accumulation_groups(
    log: DataFrame, keys: list[str], order: str, size: int, value: str = "value", complete_only: bool = True, parts: int | None = None
) -> DataFrame:
    """Sum of each ``size`` consecutive values of a run; a shorter last group is left out by default."""
    grouped = (
        with_index(log, keys, order, parts)
        .groupBy(*keys, F.floor(F.col("i") / size).alias("group_id"))
        .agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    )
    return grouped.where(F.col("n") == size) if complete_only else grouped
