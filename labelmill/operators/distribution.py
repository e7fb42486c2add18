"""Cumulative sums and exact quantiles over a numeric value, for groups of any size.

Rows first collapse to one row per distinct value (combined on the map side), so ties cost
nothing. The distinct values are cut into slices of about equal size at approximate quantiles;
cumulative sums run inside a slice and the totals of earlier slices are carried in. The cut
points only decide who does the work, the result is exact.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.session import materialise

# Slices per shuffle partition, and the most cut points the driver may hold.
SLICES_PER_PARTITION, MAX_SLICES = 4, 8192


def group_map(df: DataFrame, group: str, value: Column) -> Column:
    """One scalar map from group to value; ``df`` has one row per group and groups are few."""
    return df.agg(F.map_from_entries(F.collect_list(F.struct(F.col(group), value)))).scalar()


def histogram(df: DataFrame, groups: list[str], value: str, measures: dict[str, Column]) -> DataFrame:
    """One row per group and distinct value, written once because two passes read it."""
    sums = [F.sum(measure).alias(name) for name, measure in measures.items()]
    return materialise(df.groupBy(*groups, value).agg(*sums), "histogram")


def _sliced(hist: DataFrame, value: str, slices: int) -> DataFrame:
    probabilities = [i / slices for i in range(1, slices)]
    points = hist.approxQuantile(value, probabilities, 1.0 / (4 * slices)) if slices > 1 else []
    inner = sorted(set(points) - {float("-inf"), float("inf")})
    if not inner:
        return hist.withColumn("_slice", F.lit(0.0))
    splits = [float("-inf"), *inner, float("inf")]
    slicer = Bucketizer(splits=splits, inputCol="_value", outputCol="_slice", handleInvalid="keep")
    return slicer.transform(hist.withColumn("_value", F.col(value).cast("double"))).drop("_value")


def cumulative(
    hist: DataFrame, groups: list[str], value: str, names: list[str], descending: bool = False, slices: int | None = None
) -> DataFrame:
    """Add ``cum_<name>``, the inclusive sum of each measure over all values up to this one.

    Runs one small job: the cut points, fewer than ``MAX_SLICES`` numbers, come to the driver.
    """
    if slices is None:
        partitions = int(hist.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        slices = min(MAX_SLICES, SLICES_PER_PARTITION * partitions)

    def ordered(column):
        return F.col(column).desc() if descending else F.col(column).asc()

    sliced = _sliced(hist, value, slices)
    group = [*groups, "_slice"]
    earlier = Window.partitionBy(*groups).orderBy(ordered("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*group).orderBy(ordered(value)).rowsBetween(Window.unboundedPreceding, 0)
    totals = sliced.groupBy(*group).agg(*(F.sum(name).alias(f"_total_{name}") for name in names))
    carried = totals.select(
        *group, *(F.coalesce(F.sum(f"_total_{name}").over(earlier), F.lit(0)).alias(f"_carry_{name}") for name in names)
    )
    other = carried.withColumnsRenamed({name: f"_of_{name}" for name in group})
    same = reduce(and_, (F.col(name).eqNullSafe(F.col(f"_of_{name}")) for name in group))
    return (
        sliced.join(other, same)
        .withColumns({f"cum_{name}": F.col(f"_carry_{name}") + F.sum(name).over(inside) for name in names})
        .drop("_slice", *(f"_of_{name}" for name in group), *(f"_carry_{name}" for name in names))
    )


def bracketed(df: DataFrame, group: str, value: str, shares: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """A histogram that is exact around the wanted quantiles only: ``(group, value, rows, own)``, written once.

    A quantile sketch gives a bracket for each quantile, a few times wider than the sketch is off. Values inside a bracket keep a
    row each; all others only count, with the upper end of the bracket before them or minus infinity. ``own`` counts
    the rows that have the value itself. Groups are few; ``df`` is read twice.
    """
    margin = 3.0 / accuracy
    points = [point for share in shares.values() for point in (max(0.0, share - margin), min(1.0, share + margin))]
    number = F.col(value).cast("double")
    sketches = df.groupBy(group).agg(F.percentile_approx(number, points, accuracy).alias("ends"))
    ends = group_map(sketches, group, F.col("ends"))[F.col(group)]
    # one lookup of the group per row, not one per comparison
    rows = df.select(group, number.alias("_value"), ends.alias("_ends"))
    lows, highs = ([F.get("_ends", F.lit(2 * i + side)) for i in range(len(shares))] for side in (0, 1))
    inside = reduce(or_, (F.col("_value").between(low, high) for low, high in zip(lows, highs, strict=True)))
    before = F.greatest(F.lit(float("-inf")), *(F.when(high < F.col("_value"), high) for high in highs))
    cells = rows.select(group, F.when(inside, F.col("_value")).otherwise(before).alias(value), inside.alias("_own"))
    hist = cells.groupBy(group, value).agg(F.count("*").alias("rows"), F.count_if("_own").alias("own"))
    return materialise(hist, "brackets")


def exact_quantiles(df: DataFrame, group: str, value: str, shares: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """``group``, ``n`` and the quantiles by linear interpolation, exactly; no table of all distinct values is made.

    ``df`` has no null values and groups. Should a quantile lie outside its bracket, all distinct values are counted after all.
    """
    hist = bracketed(df, group, value, shares, accuracy)
    found = materialise(quantiles_from(hist, group, value, "rows", shares, own="own"), "quantiles")
    if not found.where("NOT met").isEmpty():
        found = quantiles_from(histogram(df, [group], value, {"rows": F.lit(1)}), group, value, "rows", shares)
    return found.drop("met")


def quantiles_from(
    hist: DataFrame, group: str, value: str, count: str, shares: dict[str, float], slices: int | None = None, own: str | None = None
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group; groups are few.

    ``own`` names how many of a value's rows come first and have the value itself; ``met`` then says whether all places that the
    quantiles need are among those.
    """
    totals = group_map(hist.groupBy(group).agg(F.sum(count).alias("n")), group, F.col("n"))
    placed = cumulative(hist, [group], value, [count], slices=slices).select(
        group,
        *([(F.col(f"cum_{count}") - F.col(count) + F.col(own) - 1).alias("_last_own")] if own else []),
        F.col(value).cast("double").alias("_value"),
        (F.col(f"cum_{count}") - F.col(count)).alias("_first"),
        (F.col(f"cum_{count}") - 1).alias("_last"),
        totals[F.col(group)].alias("n"),
    )

    def value_at(place):
        return F.max(F.when(place.between(F.col("_first"), F.col("_last")), F.col("_value")))

    place = {name: (F.col("n") - 1) * F.lit(share) for name, share in shares.items()}
    picked = placed.groupBy(group, "n").agg(
        *(value_at(F.floor(at)).alias(f"_low_{name}") for name, at in place.items()),
        *(value_at(F.ceil(at)).alias(f"_high_{name}") for name, at in place.items()),
        *([F.bool_and(_met(place.values())).alias("met")] if own else []),
    )
    between = {
        name: F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * (at - F.floor(at))
        for name, at in place.items()
    }
    return picked.select(group, "n", *(column.alias(name) for name, column in between.items()), *(["met"] if own else []))


def _met(places) -> Column:
    """Of the places that fall to this value, none falls behind its own rows."""
    both = [at for place in places for at in (F.floor(place), F.ceil(place))]
    return ~reduce(or_, (at.between(F.col("_first"), F.col("_last")) & (at > F.col("_last_own")) for at in both))
