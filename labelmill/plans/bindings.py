"""The driver tables seen through the data model: metadata, documents, predictions, metric log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.functions import DECISION_LABELS
from labelmill.operators.examples import map_decision
from labelmill.operators.filters import keep_decided
from labelmill.operators.splits import hash_split
from labelmill.schemas import DOCUMENT_KEYS
from labelmill.session import scratch_path, spread
from labelmill.sources import write_documents


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _order_decision():
    rank = F.substring("o_orderpriority", 1, 1)
    pending = F.when(rank == "1", "PENDING").when(rank == "2", "CONT-REJECTED").when(rank == "3", "CONT-ACCEPTED")
    pending = pending.when(rank == "4", "CONT-PENDING").otherwise("error")
    status = F.col("o_orderstatus")
    return F.when(status == "F", "ACCEPTED").when(status == "O", "REJECTED").otherwise(pending)


def filings(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata without the classification: one table, no join."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("application_number"),
        F.col("o_orderdate").alias("filing_date"),
        _order_decision().alias("decision"),
        F.concat(F.col("o_custkey").cast("string"), F.lit(".0")).alias("examiner_id"),
        "o_custkey",
        "o_totalprice",
    )


def classified_filings(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata with examiner name and classification codes.

    Customers grow with the data and one may own much of it: the join carries no hint, so AQE
    broadcasts by measured size and splits skewed partitions.
    """
    customers = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return (
        filings(spark, folder)
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "application_number",
            "filing_date",
            "decision",
            F.col("c_mktsegment").alias("main_cpc_label"),
            F.col("n_name").alias("main_ipcr_label"),
            "examiner_id",
            F.col("c_name").alias("examiner_full_name"),
            F.col("c_mktsegment").alias("uspc_class"),
            F.col("n_name").alias("uspc_subclass"),
            F.col("decision").alias("decision_as_of_2020"),
            "o_totalprice",
        )
    )


def decided_filings(spark: SparkSession, folder: str) -> DataFrame:
    """Filings with a known, final decision, as ``labels``."""
    known = filings(spark, folder).where(F.col("decision").isin(list(DECISION_LABELS)))
    return keep_decided(map_decision(known))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """A price rule: dearer orders are predicted to be accepted."""
    scored = decided_filings(spark, folder).select(
        "application_number",
        F.col("labels").alias("label"),
        (F.col("o_totalprice") / 500000.0).alias("score"),
    )
    pred = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return scored.withColumn("pred", pred).withColumn("correct", F.col("label") == F.col("pred"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select(
        F.col("doc_id").cast("string").alias("application_number"), "text", "lang", "source"
    )


def labelled_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a quality label, split by hash."""
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("labels"))
    joined = _documents(spark, folder).join(labels, "doc_id")
    return hash_split(
        joined.select(F.col("doc_id").cast("string").alias("application_number"), "labels", "text")
    )


def application_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in the shape of the JSON format, filed under the year of their order; those without one under 1900."""
    quality = table(spark, folder, "labels").select("doc_id", "quality")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    joined = (
        table(spark, folder, "documents")
        .join(orders, F.col("doc_id") == F.col("o_orderkey"), "left")
        .join(quality, "doc_id", "left")
        .withColumn("o_orderdate", F.coalesce("o_orderdate", F.lit("1900-01-01").cast("timestamp_ntz")))
    )
    decision = F.when(F.col("quality") == 1, "ACCEPTED").when(F.col("quality") == 0, "REJECTED").otherwise("PENDING")
    number = F.col("doc_id").cast("string")
    columns = {
        "decision": decision,
        "title": F.concat("source", F.lit("-"), number),
        "abstract": F.concat("lang", F.lit(" document of "), F.col("n_chars").cast("string"), F.lit(" characters")),
        "claims": F.col("text"),
        "full_description": F.col("text"),
        "background": F.col("source"),
        "summary": F.col("lang"),
        "main_cpc_label": F.col("source"),
        "filing_date": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "patent_issue_date": F.lit(""),
        "date_published": F.date_format("o_orderdate", "yyyyMMdd"),
        "examiner_id": F.concat(F.coalesce(F.col("o_custkey"), F.lit(0)).cast("string"), F.lit(".0")),
        "main_ipcr_label": F.col("lang"),
    }
    return joined.select(
        F.year("o_orderdate").alias("filing_year"),
        number.alias("application_number"),
        *(columns[key].alias(key) for key in DOCUMENT_KEYS),
    )


def json_corpus(spark: SparkSession, folder: str) -> str:
    """Write the documents as JSON files and return the folder.

    Three sources come out damaged, so that each kind of quarantine occurs: documents of src7 are
    cut short, those of src13 are not written, those of src3 lack the key ``summary``.
    """
    source = F.col("main_cpc_label")
    fields = [
        (F.when(source != "src3", F.col(key)) if key == "summary" else F.col(key)).alias(key) for key in DOCUMENT_KEYS
    ]
    body = F.to_json(F.struct(*fields))
    damaged = F.when(source == "src7", F.substring(body, F.lit(1), F.length(body) - 9)).otherwise(body)
    path = scratch_path(spark, "documents")
    rows = application_documents(spark, folder).where(source != "src13")
    write_documents(rows.select("filing_year", "application_number", damaged.alias("body")), path)
    return path


def metric_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as the scalar log of training runs: one run per user, one epoch per day."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("entry"),
        F.date_format("ts", "yyyy-MM-dd").alias("epoch"),
        F.col("event_type").alias("tag"),
        "value",
    )
