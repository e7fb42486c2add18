"""Word-level vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Special tokens; their position is their id.
PAD, UNK, SEP = "[PAD]", "[UNK]", "[SEP]"
SPECIALS = (PAD, UNK)
PAIR_SPECIALS = (PAD, UNK, SEP)

# Above this many entries a vocabulary is joined without a broadcast hint.
BROADCAST_ENTRIES = 200_000


def token_counts(df: DataFrame, tokens: Column) -> DataFrame:
    """Occurrences of each token; counted inside the tasks before anything moves."""
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def build_vocabulary(
    df: DataFrame,
    tokens: Column,
    size: int = 10_000,
    min_frequency: int = 3,
    specials: tuple[str, ...] = SPECIALS,
) -> DataFrame:
    """``(token, token_id, n)``: specials first, then tokens by count, ties by token.

    ``size`` includes the specials. Ranking touches at most ``size`` rows.
    """
    if size <= len(specials):
        raise ValueError("the vocabulary must have room for more than its special tokens")
    kept = (
        token_counts(df, tokens)
        .where((F.col("n") >= min_frequency) & ~F.col("token").isin(*specials))
        .orderBy(F.desc("n"), F.asc("token"))
        .limit(size - len(specials))
    )
    return ranked_vocabulary(kept, specials)


def ranked_vocabulary(kept: DataFrame, specials: tuple[str, ...]) -> DataFrame:
    """Ids for the ``(token, n)`` that were kept: specials first, then by count, ties by token."""
    rank = F.row_number().over(Window.orderBy(F.desc("n"), F.asc("token")))
    ranked = kept.select("token", (rank + (len(specials) - 1)).alias("token_id"), "n")
    fixed = kept.sparkSession.createDataFrame(
        [(token, i, 0) for i, token in enumerate(specials)], "token string, token_id int, n long"
    )
    return fixed.unionByName(ranked)


def lookup_side(vocabulary: DataFrame, size: int) -> DataFrame:
    """The vocabulary as the small side of a join; ``size`` is the bound it was built with."""
    return F.broadcast(vocabulary) if size <= BROADCAST_ENTRIES else vocabulary
