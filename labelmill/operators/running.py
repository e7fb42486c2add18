"""Running aggregates per key, for keys of any size and any step numbers.

A window partitioned by run puts a whole run into one task. Here rows are dealt to ranges of (run, order), however far
apart the steps lie, and written once with the number of their range; a window sees the rows of one run in one range.
Only the first run of a range can have begun before it, so what earlier ranges carry in is at most one row per range.
Rows without a key are a run of their own. Equal order numbers in a run come in any order.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.session import materialise

_REDUCE = {
    # name: (aggregate of rows, aggregate of block totals, way to join earlier and present)
    "count": (F.count, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b),
    "sum": (F.sum, F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "max": (F.max, F.max, F.greatest),
}


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    measures: dict[str, tuple[str, Column, bool]],
    parts: int | None = None,
) -> DataFrame:
    """Add running aggregates: ``measures`` maps a name to ``(kind, column, include this row)``.

    ``parts`` is the number of ranges, by default that of shuffle partitions; results do not depend on it. Dealing the
    rows out is an action: they are written to the shared folder.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys, order).withColumn("_block", F.spark_partition_id())
    blocked, group = materialise(ranged, "ranges"), [*keys, "_block"]
    totals = blocked.groupBy(*group).agg(
        *(_REDUCE[kind][0](value).alias(f"_total_{name}") for name, (kind, value, _) in measures.items())
    )
    along = Window.partitionBy(*keys).orderBy("_block")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *(F.col(name).alias(f"_of_{name}") for name in group),
        *(_REDUCE[kind][1](f"_total_{name}").over(earlier).alias(f"_carry_{name}") for name, (kind, _, _) in measures.items()),
        F.row_number().over(along).alias("_place"),
    )
    # fewer than ``parts`` rows: a range has at most one run that began before it
    carried = F.broadcast(carried.where("_place > 1").drop("_place"))
    same = reduce(and_, (F.col(name).eqNullSafe(F.col(f"_of_{name}")) for name in group))
    joined = blocked.join(carried, same, "left").drop(*(f"_of_{name}" for name in group))
    inside = Window.partitionBy(*group).orderBy(order)
    columns = {}
    for name, (kind, value, inclusive) in measures.items():
        frame = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        rows, _, combine = _REDUCE[kind]
        columns[name] = combine(F.col(f"_carry_{name}"), rows(value).over(frame))
    return joined.withColumns(columns).drop("_block", *(f"_carry_{name}" for name in measures))
