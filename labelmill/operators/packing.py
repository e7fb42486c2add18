"""Fixed-length sequences from a stream of encoded documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.config import SPLIT_SEED
from labelmill.functions import seeded_key
from labelmill.operators.selection import BUCKET_DIGITS, positions


def pack_sequences(
    df: DataFrame, length: int, seed: int = SPLIT_SEED, identifier: str = "application_number", digits: int = BUCKET_DIGITS
) -> DataFrame:
    """Lay all documents end to end in seeded order and cut the stream every ``length`` tokens.

    The stream never passes through one task: a document learns its start from the bucket
    offsets and is sliced at the cuts, and a chunk gathers a few slices that hold ``length``
    tokens in all. Only the very last chunk may be shorter.
    """
    size = F.size("input_ids")
    keyed = df.select("input_ids", seeded_key(identifier, seed).alias("_key"))
    laid = positions(keyed, "_key", digits, size, into="start").where(size > 0)
    stop = F.col("start") + size
    chunks = F.sequence(F.floor(F.col("start") / length), F.floor((stop - 1) / length))
    sliced = laid.select("start", "input_ids", stop.alias("stop"), F.explode(chunks).alias("chunk"))
    begin = F.greatest(F.col("chunk") * length, F.col("start"))
    end = F.least((F.col("chunk") + 1) * length, F.col("stop"))
    ids = F.slice("input_ids", (begin - F.col("start") + 1).cast("int"), (end - begin).cast("int"))
    return (
        sliced.select("chunk", F.struct(begin.alias("begin"), ids.alias("ids")).alias("piece"))
        .groupBy("chunk")
        .agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
        .select("chunk", F.flatten(F.transform("pieces", lambda p: p["ids"])).alias("input_ids"))
    )
