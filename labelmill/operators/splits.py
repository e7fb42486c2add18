"""Train/validation splits, class balancing and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.config import SPLIT_SEED, TRAIN_SHARE, CorpusConfig
from labelmill.functions import hash_below, seeded_key, unit_interval
from labelmill.operators.filters import date_literal, filed_between
from labelmill.operators.selection import cut_keys, hex_bucket, positions
from labelmill.session import materialise

ID = "application_number"


def uniform_split(
    df: DataFrame,
    start: str | None = None,
    end: str | None = None,
    share: float = TRAIN_SHARE,
    seed: int = SPLIT_SEED,
    drop_last: bool = False,
    identifier: str = ID,
) -> DataFrame:
    """Exactly ``floor(n * share)`` random rows are ``train``, the others ``validation``.

    ``drop_last`` leaves out the last row of the shuffled order.
    """
    keyed = filed_between(df, start, end).withColumn("_key", seeded_key(identifier, seed))
    take = F.floor(F.col("total") * F.lit(float(share)))
    cut = cut_keys(keyed, "_key", hex_bucket("_key"), take)[F.lit("all")]
    if drop_last:
        keyed = keyed.where(F.col("_key") < keyed.agg(F.max("_key")).scalar())
    split = F.when(F.col("_key") <= cut, F.lit("train")).otherwise(F.lit("validation"))
    return keyed.withColumn("split", split).drop("_key")


def hash_split(df: DataFrame, share: float = TRAIN_SHARE, seed: int = SPLIT_SEED, identifier: str = ID) -> DataFrame:
    """About ``share`` of the rows are ``train``; a row keeps its side when others are added."""
    train = hash_below(seeded_key(identifier, seed), share)
    return df.withColumn("split", F.when(train, F.lit("train")).otherwise(F.lit("validation")))


def date_split(
    df: DataFrame,
    train_start: str | None,
    train_end: str | None,
    val_start: str | None,
    val_end: str | None,
) -> DataFrame:
    """Half-open filing-date windows. They may overlap; such a row comes out once per window.

    ``val_start`` defaults to ``train_end``. One scan serves both windows.
    """
    val_start = val_start or train_end
    if not (train_start and train_end and val_start and val_end):
        raise ValueError("give uniform_split, or the start and end dates of both splits")

    def window(name, start, end):
        inside = (F.col("filing_date") >= date_literal(start)) & (F.col("filing_date") < date_literal(end))
        return inside, F.when(inside, F.lit(name))

    in_train, train = window("train", train_start, train_end)
    in_validation, validation = window("validation", val_start, val_end)
    both = F.array_compact(F.array(train, validation))
    return df.where(in_train | in_validation).withColumn("split", F.explode(both))


def balance_classes(
    df: DataFrame,
    label: str = "decision",
    classes: tuple = ("ACCEPTED", "REJECTED"),
    seed: int = SPLIT_SEED,
    identifier: str = ID,
    only: Column | None = None,
) -> DataFrame:
    """Downsample every class at random to the smallest one; rows of no class are dropped. ``df`` is read twice.

    With ``only``, rows for which it does not hold pass through as they are, in the same scan.
    """
    keyed = df.withColumn("_key", seeded_key(identifier, seed))
    member = F.col(label).isin(list(classes))
    chosen = member if only is None else only & member
    # class and key only, written once: the sizes, the buckets and the ranking read them, not the rows they come from
    part = materialise(keyed.where(chosen).select(label, "_key"), "classes")
    take = part.agg(F.least(*(F.count_if(F.col(label) == F.lit(c)) for c in classes))).scalar()
    cuts = cut_keys(part, "_key", hex_bucket("_key"), take, F.col(label))
    kept = F.coalesce(chosen & (F.col("_key") <= cuts[F.col(label)]), F.lit(False))
    return keyed.where(kept if only is None else kept | ~F.coalesce(only, F.lit(False))).drop("_key")


def head_per_class(
    df: DataFrame,
    label: str = "labels",
    classes: tuple = (1, 0),
    size: int = 500,
    identifier: str = ID,
) -> DataFrame:
    """The first ``size`` rows of each class: whole-number ids by their number, then all others by their text.

    Tasks keep ``size`` rows per class before anything moves, as long as the limit is not above
    ``spark.sql.optimizer.windowGroupLimitThreshold``.
    """
    kept = df.where(F.col(label).isin(list(classes)))
    order = (F.col(identifier).try_cast("long").asc_nulls_last(), F.col(identifier))
    place = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    return kept.withColumn("_place", place).where(F.col("_place") <= size).drop("_place")


def seeded_shuffle(df: DataFrame, seed: int = SPLIT_SEED, identifier: str = ID) -> DataFrame:
    """Every row with its ``position`` in a random order fixed by the seed.

    Ordering the output by ``position`` is left to the writer (``repartitionByRange``).
    """
    return positions(df.withColumn("_key", seeded_key(identifier, seed)), "_key").drop("_key")


def weighted_sample(
    df: DataFrame,
    size: int,
    label: str = "labels",
    seed: int = SPLIT_SEED,
    identifier: str = ID,
    steps: int = 1024,
) -> DataFrame:
    """``size`` rows without replacement, drawn with weight 1 / class frequency.

    Each row gets the key -ln(u)/weight and the smallest keys win (Efraimidis and Spirakis 2006).
    Weights are relative to the rarest class so that keys of all sizes of data share one scale. Rows without a label are a
    class of their own.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("none"))
    drawn = unit_interval(seeded_key(identifier, seed))
    # class and draw only, written once; the rows themselves are read for this and for the result
    narrow = materialise(df.select(name.alias("_class"), drawn.alias("_drawn")), "draws")
    counts = narrow.groupBy("_class").agg(F.count("*").alias("n"))
    found = counts.agg(F.struct(F.map_from_entries(F.collect_list(F.struct("_class", "n"))).alias("n"), F.min("n").alias("rarest"))).scalar()

    def key(draw: Column, class_: Column) -> Column:
        return -F.log(draw) * found["n"][class_] / found["rarest"]

    # on a logarithmic scale a bucket near the k-th smallest key holds about k / steps rows, whatever the number of rows
    bucket = F.floor(F.log(F.greatest(F.col("_sample_key"), F.lit(1e-300))) * steps)
    cut = cut_keys(narrow.select(key(F.col("_drawn"), F.col("_class")).alias("_sample_key")), "_sample_key", bucket, F.lit(size))
    return df.withColumn("sample_key", key(drawn, name)).where(F.col("sample_key") <= cut[F.lit("all")])


def split_corpus(df: DataFrame, config: CorpusConfig, identifier: str = ID) -> DataFrame:
    """Split by configuration and, if asked to, balance the validation part."""
    if config.uniform_split:
        parts = uniform_split(
            df, config.train_start, config.val_end, config.train_share, config.seed, config.drop_last, identifier
        )
    else:
        parts = date_split(df, config.train_start, config.train_end, config.val_start, config.val_end)
    if not config.balance_validation:
        return parts
    return balance_classes(parts, seed=config.seed, identifier=identifier, only=F.col("split") == "validation")
