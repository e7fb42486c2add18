"""The stateless part of corpus preparation on a stream.

Nothing here keeps state: the filters, the label and the hash split are the batch expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labelmill.config import CorpusConfig
from labelmill.functions import normalise
from labelmill.operators.examples import map_decision
from labelmill.operators.filters import by_classification, filed_between, keep_decided, matching
from labelmill.operators.splits import hash_split


def prepare_stream(metadata: DataFrame, config: CorpusConfig, text: str | None = None) -> DataFrame:
    """Filter, label, keep decided rows, assign the split; normalise ``text`` if it is given.

    Rows with an unknown decision get a null label and so are not kept: a stream should not
    stop for one row.
    """
    rows = by_classification(metadata, config.ipc_prefix, config.cpc_prefix)
    rows = filed_between(matching(rows, config.query), config.train_start, config.val_end)
    rows = hash_split(keep_decided(map_decision(rows, strict=False)), config.train_share, config.seed)
    return rows.withColumn(text, normalise(F.col(text))) if text else rows


def ingest_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet table partitioned by split, then stop once all input is read."""
    return (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .partitionBy("split")
        .trigger(availableNow=True)
        .start(path)
    )
