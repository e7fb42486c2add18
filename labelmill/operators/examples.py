"""From metadata and documents to labelled examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.functions import decision_label, examiner_text
from labelmill.schemas import DOCUMENT_KEYS, EXAMPLE_COLUMNS, EXAMPLE_SOURCE

_KEYS = ["filing_year", "application_number"]


def join_documents(metadata: DataFrame, documents: DataFrame, keep: tuple[str, ...] = DOCUMENT_KEYS) -> DataFrame:
    """Look up each application's document; ``found`` tells whether there is one.

    Document columns come as ``doc_<key>`` because both sides know a decision and a filing date.
    The year is part of the key so that a table partitioned by it is pruned by the metadata side.
    """
    left = metadata.withColumn("filing_year", F.year("filing_date"))
    right = documents.select(*_KEYS, *(F.col(key).alias(f"doc_{key}") for key in keep), F.lit(True).alias("_hit"))
    return left.join(right, _KEYS, "left").withColumn("found", F.col("_hit").isNotNull()).drop("_hit")


def missing_documents(metadata: DataFrame, documents: DataFrame) -> DataFrame:
    left = metadata.withColumn("filing_year", F.year("filing_date"))
    return left.join(documents.select(*_KEYS), _KEYS, "left_anti")


def project_examples(
    joined: DataFrame, decision_from: str = "document", carry: tuple[str, ...] = ()
) -> DataFrame:
    """The 14 string columns of an example from the output of :func:`join_documents`.

    ``decision_from`` picks the document's decision or the more recent one of the metadata;
    ``carry`` names further columns to keep, such as ``split``.
    """
    columns = []
    for name in EXAMPLE_COLUMNS:
        source = EXAMPLE_SOURCE.get(name, name)
        if name == "patent_number" or (name == "decision" and decision_from == "metadata"):
            column = F.col(source)
        else:
            column = F.col(f"doc_{source}")
        columns.append(column.cast("string").alias(name))
    return joined.where("found").select(*columns, *carry)


def decision_conflicts(joined: DataFrame) -> DataFrame:
    """Applications whose document and metadata disagree about the decision."""
    return joined.where("found AND NOT (decision <=> doc_decision)").select(
        "application_number", "decision", "doc_decision"
    )


def map_decision(df: DataFrame, strict: bool = True) -> DataFrame:
    """Add ``labels``. Unknown decisions fail the query, or get a null label when not ``strict``."""
    return df.withColumn("labels", decision_label(F.col("decision"), strict))


def split_unknown(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled rows, and the rows whose decision is unknown."""
    labelled = map_decision(df, strict=False)
    return labelled.where("labels IS NOT NULL"), labelled.where("labels IS NULL").drop("labels")


def select_section(
    df: DataFrame, section: str = "claims", identifier: str = "patent_number", carry: tuple[str, ...] = ()
) -> DataFrame:
    """Id, label and one text column ``text``; ``examiner`` prefixes the claims with the examiner id."""
    if section == "examiner":
        text = examiner_text(F.col("examiner_id"), F.col("claims"))
    else:
        text = F.col(section)
    return df.select(identifier, *carry, "labels", text.alias("text"))


def reshaped(df: DataFrame, rename: dict[str, str] | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Columns renamed and dropped, all others as they are. A name that is not there, or would be there twice, is an error."""
    rename = rename or {}
    missing = [name for name in (*rename, *drop) if name not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    kept = [(name, rename.get(name, name)) for name in df.columns if name not in drop]
    if len({new for _, new in kept}) < len(kept):
        raise ValueError(f"two columns of one name: {[new for _, new in kept]}")
    return df.select(*(F.col(f"`{name}`").alias(new) for name, new in kept))


def nested_enrichment(joined: DataFrame) -> DataFrame:
    """Each application with its document as one nested column ``comb``."""
    fields = [
        (F.array("application_number") if name == "patent_number" else F.col(f"doc_{EXAMPLE_SOURCE.get(name, name)}")).alias(name)
        for name in EXAMPLE_COLUMNS
    ]
    return joined.where("found").select("application_number", F.struct(*fields).alias("comb"))
