"""Tables that are appended to in whole writes, and in which a key written again replaces what it had before.

A write has two phases. First its rows go to a folder of their own, ``data/attempt=<name>``, which no reader looks at. Then one
row, the attempt's name and version, is written as one file under ``manifest``; moving that file into place is the commit. A
writer that dies before leaves rows that nobody sees, a writer that is run again replaces its own rows.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelmill.sources.files import located

_MANIFEST = "attempt string, version long"


def stage(df: DataFrame, path: str) -> str:
    """Phase one: the rows of an attempt, whose name is returned. Readers do not see them."""
    attempt = uuid.uuid4().hex
    df.write.parquet(f"{path}/data/attempt={attempt}")
    return attempt


def publish(spark: SparkSession, path: str, attempt: str, version: int | None = None) -> None:
    """Phase two: from now on the attempt's rows count. ``version`` orders writes of one key; the clock, unless given."""
    row = [(attempt, time.time_ns() if version is None else version)]
    spark.createDataFrame(row, _MANIFEST).coalesce(1).write.mode("ignore").parquet(f"{path}/manifest/{attempt}")


def commit(df: DataFrame, path: str, version: int | None = None) -> None:
    """Both phases. Of the writes of a key, the one with the largest version counts; of equal versions, one of them."""
    publish(df.sparkSession, path, stage(df, path), version)


def _exists(path: str) -> bool:
    from pyarrow import fs

    filesystem, inner = located(path)
    return filesystem.get_file_info(inner).type != fs.FileType.NotFound


def committed(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """The rows of published attempts; for each key only those of its last one. Null is a key like any other.

    Attempts are partitions, so the manifest prunes the folders of those that were never published. A table that is not there is
    empty.
    """
    if not _exists(f"{path}/manifest"):
        return spark.createDataFrame([], schema)
    manifest = spark.read.schema(_MANIFEST).option("recursiveFileLookup", True).parquet(f"{path}/manifest").dropDuplicates(["attempt"])
    rows = spark.read.schema(f"{schema}, attempt string").parquet(f"{path}/data").join(manifest, "attempt")
    # rows of one attempt and key stay together, so a rank and not a row number
    place = F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("version"), F.desc("attempt")))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place", "attempt", "version")
