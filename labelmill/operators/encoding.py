"""Token ids, padding and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.operators.vocabulary import BROADCAST_ENTRIES, SEP
from labelmill.session import materialise

PAD_ID, UNK_ID = 0, 1
# Copies of each vocabulary entry when a large vocabulary is joined.
JOIN_SALTS = 32


def slotted(vocabulary: DataFrame, slots: int, value: str = "token_id") -> Column:
    """A bounded vocabulary as one value: an array of ``slots`` small maps from token to ``value``, addressed by token hash.

    One map over all entries would be searched from its start for every token; here a token
    meets the one or two entries of its slot.
    """
    entries = vocabulary.select("token", value).groupBy(slot(F.col("token"), slots).alias("slot"))
    filled = entries.agg(F.collect_list(F.struct("token", value)).alias("entries"))
    every = vocabulary.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    empty = F.array().cast(filled.schema["entries"].dataType)
    dense = every.join(filled, "slot", "left").select(F.struct("slot", F.coalesce("entries", empty).alias("entries")).alias("slot"))
    ordered = F.array_sort(F.collect_list("slot"))
    return dense.agg(F.transform(ordered, lambda slot: F.map_from_entries(slot["entries"]))).scalar()


def slot(token: Column, slots: int) -> Column:
    return F.pmod(F.hash(token), F.lit(slots))


def encode(
    df: DataFrame,
    keys: list[str],
    tokens: Column,
    vocabulary: DataFrame,
    max_length: int | None = 512,
    vocab_size: int = 10_000,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``input_ids`` for each row, unknown tokens as ``[UNK]``, cut to ``max_length`` first.

    A vocabulary within ``BROADCAST_ENTRIES`` goes to the tasks as one value and the rows stay
    where they are. A larger one is joined, see :func:`_encode_by_join`.
    """
    tokens = F.coalesce(tokens, F.array().cast("array<string>"))
    if max_length is not None:
        tokens = F.slice(tokens, 1, max_length)
    if vocab_size > BROADCAST_ENTRIES:
        return _encode_by_join(df, keys, tokens, vocabulary, carry)
    slots = 2 * vocab_size
    known = df.select(*keys, *carry, tokens.alias("_tokens")).withColumn("_known", slotted(vocabulary, slots))

    def token_id(token):
        return F.coalesce(F.get("_known", slot(token, slots))[token], F.lit(UNK_ID))

    return known.select(*keys, *carry, F.transform("_tokens", token_id).alias("input_ids"))


def _joined_in_place(rows: DataFrame, items: str, item: str, table: DataFrame, value: str, missing: Column | None) -> DataFrame:
    """``(_row, _values)``: for each row of ``(_row, items)`` its items looked up in a large ``table``, in order.

    Rows are told apart by a number of their own, whatever their keys. A frequent item is a hot key of this join, so each entry
    of the table is spread over ``JOIN_SALTS`` copies. A group of the final aggregation is one row.
    """
    salt = F.pmod(F.hash("_row"), F.lit(JOIN_SALTS)).alias("_salt")
    single = rows.select("_row", salt, F.posexplode(items).alias("_place", item))
    copies = F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))).alias("_salt")
    found = single.join(table.select(item, value, copies), [item, "_salt"], "left")
    looked_up = F.col(value) if missing is None else F.coalesce(value, missing)
    entries = F.array_sort(F.collect_list(F.struct("_place", looked_up.alias("value"))))
    return found.groupBy("_row").agg(F.transform(entries, lambda e: e["value"]).alias("_values"))


def _encode_by_join(df: DataFrame, keys: list[str], tokens: Column, vocabulary: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """Look tokens up in a vocabulary too large to hand out; the rows are written once and numbered, so equal or null keys stay rows of their own."""
    numbered = df.select(*keys, *carry, tokens.alias("_tokens"), F.monotonically_increasing_id().alias("_row"))
    rows = materialise(numbered, "tokens")
    ids = _joined_in_place(rows, "_tokens", "token", vocabulary, "token_id", F.lit(UNK_ID))
    nothing = F.array().cast("array<int>")
    return rows.join(ids, "_row", "left").select(*keys, *carry, F.coalesce("_values", nothing).alias("input_ids"))


def pad_and_mask(df: DataFrame, length: Column | int) -> DataFrame:
    """Right-pad ``input_ids`` to ``length`` and add ``attention_mask``."""
    length = F.lit(length) if isinstance(length, int) else length
    size = F.size("input_ids")
    gap = F.greatest(length - size, F.lit(0))
    return df.withColumns(
        {
            "attention_mask": F.concat(F.array_repeat(F.lit(1), size), F.array_repeat(F.lit(0), gap)),
            "input_ids": F.concat("input_ids", F.array_repeat(F.lit(PAD_ID), gap)),
        }
    )


def pad_batches(df: DataFrame, batches: DataFrame, key: str, batch: str = "batch_id") -> DataFrame:
    """Rows of ``batches (key, batch)`` with their arrays, padded to the longest of the batch.

    Lengths find the longest; the arrays move once, to meet the batch of their row. ``df`` is read twice.
    """
    sizes = df.select(key, F.size("input_ids").alias("_size")).join(batches.select(key, batch), key)
    longest = sizes.withColumn("_longest", F.max("_size").over(Window.partitionBy(batch))).drop("_size")
    return pad_and_mask(df.join(longest, key), F.col("_longest")).drop("_longest")


def pad_longest_in_batch(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Pad each row to the longest one of its batch; a batch has a fixed number of rows."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    return pad_and_mask(df.withColumn("_longest", longest), F.col("_longest")).drop("_longest")


def decode(df: DataFrame, vocabulary: DataFrame, vocab_size: int = 10_000) -> DataFrame:
    """Add ``decoded``: the tokens of ``input_ids`` joined by blanks; an id without a token leaves nothing.

    Ids are positions, so a vocabulary within ``BROADCAST_ENTRIES`` becomes one array to index; a larger one is joined.
    """
    if vocab_size > BROADCAST_ENTRIES:
        rows = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "ids")
        names = _joined_in_place(rows, "input_ids", "token_id", vocabulary, "token", None)
        joined = rows.join(names, "_row", "left")
        text = F.when(F.col("input_ids").isNotNull(), F.coalesce(F.array_join("_values", " "), F.lit("")))
        return joined.withColumn("decoded", text).drop("_row", "_values")
    entries = F.array_sort(F.collect_list(F.struct("token_id", "token")))
    names = vocabulary.agg(F.transform(entries, lambda e: e["token"])).scalar()
    return (
        df.withColumn("_names", names)
        .withColumn("decoded", F.array_join(F.transform("input_ids", lambda i: F.get("_names", i)), " "))
        .drop("_names")
    )


def truncation_stats(df: DataFrame, tokens: Column, max_length: int = 512) -> DataFrame:
    """How many rows a cut at ``max_length`` shortens, and how many tokens it keeps and drops."""
    size = F.size(tokens)
    return df.select(size.alias("n")).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("n") > max_length).alias("truncated_rows"),
        F.coalesce(F.sum(F.least("n", F.lit(max_length))), F.lit(0)).alias("kept_tokens"),
        F.coalesce(F.sum(F.greatest(F.col("n") - max_length, F.lit(0))), F.lit(0)).alias("dropped_tokens"),
    )


def pair_tokens(first: Column, second: Column) -> Column:
    """Two token arrays in one sequence with the separator between them."""
    return F.concat(first, F.array(F.lit(SEP)), second)
