"""From raw documents to token digests, in five stages: toxic documents, near copies, repeated passages and contaminated
documents go, the rest is encoded. Each stage is written and read again, so a lost executor costs its own tasks only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelmill.llm import bpe, contamination, near_duplicates, suffix_dedup, toxicity
from labelmill.llm.common import stored, table, without


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents predicted toxic go; trained on the labels of the documents that come in."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group of near copies, the document with the smallest id stays, without ids one text of them."""
    return without(docs, near_duplicates.marked(docs).where("NOT kept"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: byte strings that also start in an earlier document are cut out; every document stays."""
    return suffix_dedup.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold too much of the benchmark go."""
    return without(docs, contamination.judge(docs, table(spark, sf_dir, "benchmark"), keyed=True).where("contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: token counts and digests of what is left."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

# Toxicity is a trained model, which SQL does not express; the tests compare with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
