"""The most frequent tokens, exactly, without counting all others.

A count sketch of fixed size is made first: every row of it hashes tokens to cells and counts per cell, so a token occurs at
most as often as the least of its cells says. Sketches add up cell by cell. Tokens that cannot be frequent enough are ruled
out before they are counted, so what is shuffled is bounded by the sketch and by the tokens that may be in the answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.operators.vocabulary import SPECIALS, ranked_vocabulary
from labelmill.session import materialise

CELLS, ROWS = 1 << 17, 2


def _cell(token: Column, row: int, cells: int) -> Column:
    return F.pmod(F.xxhash64(token, F.lit(row)), F.lit(cells)).cast("int")


def count_sketch(df: DataFrame, tokens: Column, cells: int = CELLS, rows: int = ROWS) -> DataFrame:
    """One row with an array of ``cells`` counts for each row of the sketch, ``counts_0`` on; written once.

    A task passes on at most ``rows * cells`` partial counts.
    """
    token = F.col("token")
    places = F.array(*(_cell(token, row, cells) + row * cells for row in range(rows)))
    hits = df.select(F.explode(tokens).alias("token")).where("token IS NOT NULL").select(F.explode(places).alias("place"))
    counts = hits.groupBy("place").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(rows * cells).select(F.col("id").cast("int").alias("place"))
    dense = every.join(counts, "place", "left").select(F.struct("place", F.coalesce("n", F.lit(0)).alias("n")).alias("cell"))
    # a sketch has a fixed size, so it may come together
    whole = dense.agg(F.transform(F.array_sort(F.collect_list("cell")), lambda cell: cell["n"]).alias("counts"))
    return materialise(whole.select(*(F.slice("counts", row * cells + 1, cells).alias(f"counts_{row}") for row in range(rows))), "sketch")


def at_most(sketch: DataFrame, token: Column, cells: int = CELLS) -> Column:
    """An upper bound of a token's occurrences."""
    return F.least(F.lit(2**62), *(F.get(sketch.select(name).scalar(), _cell(token, row, cells)) for row, name in enumerate(sketch.columns)))


def possible_tokens(df: DataFrame, tokens: Column, sketch: DataFrame, least: int, cells: int = CELLS) -> DataFrame:
    """Exact counts of the tokens whose bound reaches ``least``; the others are dropped inside the tasks that read them."""
    hits = df.select(F.explode(tokens).alias("token")).where("token IS NOT NULL")
    return hits.where(at_most(sketch, F.col("token"), cells) >= least).groupBy("token").agg(F.count("*").alias("n"))


def frequent_vocabulary(
    df: DataFrame,
    tokens: Column,
    size: int = 10_000,
    min_frequency: int = 3,
    specials: tuple[str, ...] = SPECIALS,
    cells: int = CELLS,
    rows: int = ROWS,
) -> DataFrame:
    """The rows of ``build_vocabulary``. ``df`` is read twice, or three times if the first guess of the last place was too high.

    Runs the counting jobs; the driver sees one number per step.
    """
    if size <= len(specials):
        raise ValueError("the vocabulary must have room for more than its special tokens")
    wanted = size - len(specials)
    sketch = count_sketch(df, tokens, cells, rows)
    # about twice as many cells as wanted tokens reach the guess
    guess = sketch.select(F.get(F.sort_array("counts_0", asc=False), F.lit(2 * wanted))).first()[0] or 0
    least = max(min_frequency, guess)

    def counted(bound: int) -> DataFrame:
        found = possible_tokens(df, tokens, sketch, bound, cells)
        return materialise(found.where((F.col("n") >= min_frequency) & ~F.col("token").isin(*specials)), "frequent")

    counts = counted(least)
    if least > min_frequency and counts.where(F.col("n") >= least).count() < wanted:
        # what is counted so far bounds the count in the last place from below
        last = counts.orderBy(F.desc("n")).limit(wanted).agg(F.count("*"), F.min("n")).first()
        counts = counted(last[1] if last[0] == wanted else min_frequency)
    return ranked_vocabulary(counts.orderBy(F.desc("n"), F.asc("token")).limit(wanted), specials)
