"""The two whole jobs: from raw tables to examples, and from examples to evaluated predictions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.config import CorpusConfig
from labelmill.functions import words_of
from labelmill.operators.examples import join_documents, map_decision, project_examples, select_section
from labelmill.operators.filters import config_years, in_years, keep_decided, select_metadata
from labelmill.operators.models import argmax, score_naive_bayes, train_naive_bayes
from labelmill.operators.predictions import with_outcome
from labelmill.operators.splits import balance_classes, split_corpus
from labelmill.operators.statistics import outcome_gap, outcome_pivot
from labelmill.operators.vocabulary import build_vocabulary
from labelmill.session import materialise


def _pruned(documents: DataFrame, config: CorpusConfig) -> DataFrame:
    years = config_years(config)
    return documents if years is None else in_years(documents, years)


def _balanced(examples: DataFrame, config: CorpusConfig) -> DataFrame:
    if not config.balance_validation:
        return examples
    validation = F.col("split") == "validation"
    return balance_classes(examples, seed=config.seed, identifier="patent_number", only=validation)


def build_examples(metadata: DataFrame, documents: DataFrame, config: CorpusConfig) -> DataFrame:
    """Filter, split, look up, label and balance: ``(patent_number, split, labels, text)``.

    The metadata is cut down first, the years in question prune the documents' partitions, and
    only the columns a section needs are read of them.
    """
    parts = split_corpus(select_metadata(metadata, config), replace(config, balance_validation=False))
    section = ("claims", "examiner_id") if config.section == "examiner" else (config.section,)
    keep = tuple(dict.fromkeys(("decision", *section)))
    documents = _pruned(documents, config)
    joined = join_documents(parts, documents, keep).where("found")
    decision = F.col("doc_decision") if config.decision_from == "document" else F.col("decision")
    examples = joined.select(
        F.col("application_number").alias("patent_number"),
        "split",
        decision.alias("decision"),
        *(F.col(f"doc_{name}").alias(name) for name in section),
    )
    labelled = keep_decided(map_decision(_balanced(examples, config)))
    return select_section(labelled, config.section, carry=("split",))


def full_examples(metadata: DataFrame, documents: DataFrame, config: CorpusConfig) -> DataFrame:
    """All 14 example columns with their split, for materialising a corpus; balanced on the decision that it emits."""
    parts = split_corpus(select_metadata(metadata, config), replace(config, balance_validation=False))
    joined = join_documents(parts, _pruned(documents, config))
    return _balanced(project_examples(joined, config.decision_from, carry=("split",)), config)


def classify(examples: DataFrame, config: CorpusConfig, kind: str = "multinomial") -> DataFrame:
    """Train naive Bayes on the train split and predict both: ``(patent_number, split, label, pred, score)``.

    Vocabulary, training and scoring each read the tokens, so these are written once first.
    """
    tokenised = examples.select("patent_number", "split", "labels", words_of("text").alias("tokens"))
    examples, words = materialise(tokenised, "tokens"), F.col("tokens")
    train = examples.where("split = 'train'")
    vocabulary = build_vocabulary(train, words, config.vocab_size, config.min_frequency)
    model = train_naive_bayes(train, words, vocabulary, kind, vocab_size=config.vocab_size)
    scored = score_naive_bayes(examples, model, words, ["patent_number", "split", "labels"])
    return argmax(scored).select(
        "patent_number", "split", F.col("labels").alias("label"), "pred", F.col("probability").alias("score")
    )


def error_breakdown(metadata: DataFrame, predictions: DataFrame, features: list[str], threshold: int = 5) -> dict[str, DataFrame]:
    """Outcome counts per feature. Features with many values show only clear differences."""
    outcomes = with_outcome(metadata, predictions)
    # The features with many values.
    wide = ("uspc_class", "uspc_subclass", "examiner_full_name")
    return {
        feature: outcome_gap(outcomes, feature, threshold) if feature in wide else outcome_pivot(outcomes, feature, fill=False)
        for feature in features
    }
