"""Queries: sources, filters, projections, joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.config import CorpusConfig, needed_years
from labelmill.operators import examples, filters
from labelmill.operators import predictions as outcome
from labelmill.operators.membership import with_listed_ids
from labelmill.plans import bindings as b
from labelmill.plans.registry import query
from labelmill.plans.views import LABEL, sql
from labelmill.schemas import DOCUMENT_KEYS, EXAMPLE_COLUMNS, METADATA
from labelmill.session import scratch_path
from labelmill.sources import (
    index_batches,
    ingest_documents,
    list_columns,
    looked_up,
    quarantine,
    read_documents,
    read_indexed,
    read_metadata,
    split_unreadable,
    write_arrow,
)

_FORMATS = ("csv", "feather", "parquet", "tsv")


@query(
    "read_metadata_formats",
    sql(
        " UNION ALL ".join(
            f"""SELECT '{suffix}' AS format, count(*) AS n, CAST(sum(CAST(application_number AS BIGINT)) AS BIGINT) AS id_sum,
 strftime(min(filing_date), '%Y-%m-%d') AS first_filed, strftime(max(filing_date), '%Y-%m-%d') AS last_filed,
 count(DISTINCT examiner_full_name) AS examiners, count(DISTINCT main_cpc_label) AS codes FROM classified"""
            for suffix in _FORMATS
        ),
        "classified",
    ),
)
def read_metadata_formats(spark, folder):
    metadata = b.classified_filings(spark, folder).select(*METADATA.fieldNames())
    paths = {suffix: f"{scratch_path(spark, 'metadata')}.{suffix}" for suffix in _FORMATS}
    metadata.write.parquet(paths["parquet"])
    # other formats hold the columns in another order, and one more
    written = spark.read.parquet(paths["parquet"]).select(*reversed(METADATA.names), F.lit("x").alias("further"))
    written.write.option("escape", '"').csv(paths["csv"], header=True)
    written.write.option("escape", '"').csv(paths["tsv"], header=True, sep="\t")
    write_arrow(written, paths["feather"])

    def summary(suffix):
        return read_metadata(spark, paths[suffix]).agg(
            F.lit(suffix).alias("format"),
            F.count("*").alias("n"),
            F.sum(F.col("application_number").cast("long")).alias("id_sum"),
            F.date_format(F.min("filing_date"), "yyyy-MM-dd").alias("first_filed"),
            F.date_format(F.max("filing_date"), "yyyy-MM-dd").alias("last_filed"),
            F.count_distinct("examiner_full_name").alias("examiners"),
            F.count_distinct("main_cpc_label").alias("codes"),
        )

    return reduce(DataFrame.unionByName, map(summary, _FORMATS))


@query(
    "read_json_corpus",
    sql(
        """SELECT filing_year, application_number,
 CASE background WHEN 'src7' THEN 'corrupt' WHEN 'src3' THEN 'absent_key' ELSE 'ok' END AS state,
 CASE background WHEN 'src7' THEN '' ELSE concat_ws('|', decision, title, abstract, examiner_id, filing_date) END AS head,
 CASE background WHEN 'src7' THEN '' ELSE md5(claims) END AS claims_md5 FROM docs WHERE background <> 'src13'""",
        "docs",
    ),
)
def read_json_corpus(spark, folder):
    documents = read_documents(spark, b.json_corpus(spark, folder))
    broken = F.col("problem") == "corrupt"
    head = F.concat_ws("|", "decision", "title", "abstract", "examiner_id", "filing_date")
    return documents.select(
        "filing_year",
        "application_number",
        F.coalesce("problem", F.lit("ok")).alias("state"),
        F.when(broken, "").otherwise(head).alias("head"),
        F.when(broken, "").otherwise(F.md5("claims")).alias("claims_md5"),
    )


@query(
    "quarantine_documents",
    sql(
        """SELECT f.application_number, CASE WHEN d.application_number IS NULL OR d.background = 'src13' THEN 'missing'
 WHEN d.background = 'src7' THEN 'corrupt' ELSE 'absent_key' END AS reason
 FROM filings f LEFT JOIN docs d USING (application_number)
 WHERE d.application_number IS NULL OR d.background IN ('src3', 'src7', 'src13')""",
        "filings",
        "docs",
    ),
)
def quarantine_documents(spark, folder):
    return quarantine(b.filings(spark, folder), read_documents(spark, b.json_corpus(spark, folder)))


@query(
    "documents_by_name",
    sql(
        """SELECT f.application_number, CASE WHEN d.application_number IS NULL OR d.background = 'src13' THEN 'missing'
 WHEN d.background = 'src7' THEN 'corrupt' WHEN d.background = 'src3' THEN 'absent_key' ELSE 'ok' END AS state,
 CASE WHEN d.application_number IS NULL OR d.background IN ('src3', 'src7', 'src13') THEN '' ELSE md5(claims) END AS claims_md5
 FROM filings f LEFT JOIN docs d ON f.application_number = d.application_number AND year(f.filing_date) = d.filing_year
 WHERE f.decision = 'ACCEPTED'""",
        "filings",
        "docs",
    ),
)
def documents_by_name(spark, folder):
    """The documents of accepted filings, opened one by one without a listing, and what became of the others."""
    accepted = b.filings(spark, folder).where("decision = 'ACCEPTED'")
    good, bad = looked_up(spark, accepted, b.json_corpus(spark, folder))
    return good.select("application_number", F.lit("ok").alias("state"), F.md5("claims").alias("claims_md5")).unionByName(
        bad.select("application_number", F.col("reason").alias("state"), F.lit("").alias("claims_md5"))
    )


@query(
    "indexed_month",
    sql(
        """SELECT application_number, strftime(filing_date, '%Y-%m-%d %H:%M:%S') AS filing_date, decision, examiner_full_name FROM classified
 WHERE filing_date >= TIMESTAMP '1996-03-01' AND filing_date < TIMESTAMP '1996-04-01'""",
        "classified",
    ),
)
def indexed_month(spark, folder):
    """One month out of a Feather table whose index rules most batches out."""
    path = f"{scratch_path(spark, 'metadata')}.feather"
    metadata = b.classified_filings(spark, folder).select(*METADATA.fieldNames())
    write_arrow(metadata.repartitionByRange("filing_date").sortWithinPartitions("filing_date"), path)
    index_batches(spark, path)
    columns = ("application_number", "filing_date", "decision", "examiner_full_name")
    month = filters.matching(
        read_indexed(spark, path, columns), "filing_date >= TIMESTAMP_NTZ'1996-03-01' AND filing_date < TIMESTAMP_NTZ'1996-04-01'"
    )
    return month.select("application_number", _stamp(), "decision", "examiner_full_name")


@query(
    "read_metadata_rows",
    sql(
        """SELECT application_number, strftime(filing_date, '%Y-%m-%d %H:%M:%S') AS filing_date, decision, main_cpc_label, main_ipcr_label,
 examiner_id, examiner_full_name, uspc_class, uspc_subclass FROM classified""",
        "classified",
    ),
)
def read_metadata_rows(spark, folder):
    """Every row of the metadata, written as text and read again."""
    path = f"{scratch_path(spark, 'metadata')}.tsv"
    b.classified_filings(spark, folder).select(*METADATA.fieldNames()).write.option("escape", '"').csv(path, header=True, sep="\t")
    good, _ = split_unreadable(read_metadata(spark, path, bad_values="_bad"), "_bad")
    return good.select(
        "application_number", _stamp(), "decision", "main_cpc_label", "main_ipcr_label", "examiner_id", "examiner_full_name", "uspc_class", "uspc_subclass"
    )


_TYPES = [(field.name, field.dataType.simpleString()) for field in METADATA.fields]


@query(
    "schema_listing",
    sql(
        " UNION ALL ".join(
            f"SELECT {i} AS ordinal, '{name}' AS name, '{kind}' AS type, count({name}) AS n_values FROM classified"
            for i, (name, kind) in enumerate(_TYPES)
        ),
        "classified",
    ),
)
def schema_listing(spark, folder):
    return list_columns(b.classified_filings(spark, folder).select(*METADATA.fieldNames()))


@query(
    "ingest_partitioned",
    sql(
        """SELECT filing_year, count(*) AS n, CAST(sum(length(claims)) AS BIGINT) AS claim_chars FROM docs
 WHERE background NOT IN ('src3', 'src7', 'src13') GROUP BY filing_year""",
        "docs",
    ),
)
def ingest_partitioned(spark, folder):
    path = scratch_path(spark, "ingested")
    ingest_documents(read_documents(spark, b.json_corpus(spark, folder)), path)
    stored = spark.read.parquet(path)
    return stored.groupBy("filing_year").agg(F.count("*").alias("n"), F.sum(F.length("claims")).alias("claim_chars"))


@query(
    "filter_ipc_prefix",
    sql("SELECT application_number, main_ipcr_label FROM classified WHERE starts_with(main_ipcr_label, 'NATION_1')", "classified"),
)
def filter_ipc_prefix(spark, folder):
    rows = filters.by_classification(b.classified_filings(spark, folder), ipc="NATION_1", cpc="AUTO")
    return rows.select("application_number", "main_ipcr_label")


@query(
    "filter_cpc_prefix",
    sql("SELECT application_number, main_cpc_label FROM classified WHERE starts_with(main_cpc_label, 'AUTO')", "classified"),
)
def filter_cpc_prefix(spark, folder):
    rows = filters.by_classification(b.classified_filings(spark, folder), cpc="AUTO")
    return rows.select("application_number", "main_cpc_label")


def _stamp():
    return F.date_format("filing_date", "yyyy-MM-dd HH:mm:ss").alias("filing_date")


_EXPRESSION = "decision IN ('PENDING', 'CONT-PENDING') AND o_totalprice > 200000 AND uspc_class <> 'MACHINERY'"


@query(
    "filter_expression",
    sql(f"SELECT application_number, decision, uspc_class FROM classified WHERE {_EXPRESSION}", "classified"),
)
def filter_expression(spark, folder):
    rows = filters.matching(b.classified_filings(spark, folder), _EXPRESSION)
    return rows.select("application_number", "decision", "uspc_class")


@query(
    "filter_date_range",
    sql(
        """SELECT application_number, strftime(filing_date, '%Y-%m-%d %H:%M:%S') AS filing_date FROM filings
 WHERE filing_date >= TIMESTAMP '1996-02-15' AND filing_date <= TIMESTAMP '1998-12-31'""",
        "filings",
    ),
)
def filter_date_range(spark, folder):
    rows = filters.filed_between(b.filings(spark, folder), "1996-2-15", "1998-12-31")
    return rows.select("application_number", _stamp())


@query(
    "slice_years",
    sql(
        "SELECT application_number, strftime(filing_date, '%Y-%m-%d %H:%M:%S') AS filing_date FROM filings WHERE year(filing_date) IN (1995, 1997, 1998)",
        "filings",
    ),
)
def slice_years(spark, folder):
    return filters.in_years(b.filings(spark, folder), [1995, 1997, 1998]).select("application_number", _stamp())


@query(
    "needed_years",
    sql(
        "SELECT CAST(year(filing_date) AS INTEGER) AS filing_year, count(*) AS n FROM filings WHERE year(filing_date) IN (1996, 1997, 1999, 2000) GROUP BY 1",
        "filings",
    ),
)
def needed_years_query(spark, folder):
    config = CorpusConfig(train_start="1996-03-01", train_end="1997-06-30", val_start="1999-01-01", val_end="2000-12-31")
    return filters.count_by_year(filters.in_years(b.filings(spark, folder), needed_years(config)))


@query(
    "default_window",
    sql("SELECT CAST(year(filing_date) AS INTEGER) AS filing_year, count(*) AS n FROM filings GROUP BY 1", "filings"),
)
def default_window(spark, folder):
    """A configuration without bounds or years keeps every filing."""
    return filters.count_by_year(filters.select_metadata(b.filings(spark, folder), CorpusConfig()))


@query(
    "count_by_year",
    sql("SELECT CAST(year(filing_date) AS INTEGER) AS filing_year, count(*) AS n FROM filings GROUP BY 1", "filings"),
)
def count_by_year(spark, folder):
    return filters.count_by_year(b.filings(spark, folder))


def _joined(spark, folder):
    return examples.join_documents(b.filings(spark, folder), b.application_documents(spark, folder))


_EXAMPLE_SQL = {
    "patent_number": "application_number",
    "decision": "doc_decision",
    "description": "full_description",
    "cpc_label": "main_cpc_label",
    "ipc_label": "main_ipcr_label",
    "filing_date": "doc_filing_date",
}


@query(
    "project_examples",
    sql(
        f"SELECT {', '.join(f'{_EXAMPLE_SQL.get(c, c)} AS {c}' for c in EXAMPLE_COLUMNS)} FROM joined WHERE found", "joined"
    ),
)
def project_examples(spark, folder):
    return examples.project_examples(_joined(spark, folder))


@query(
    "decision_conflicts",
    sql("SELECT application_number, decision, doc_decision FROM joined WHERE found AND decision IS DISTINCT FROM doc_decision", "joined"),
)
def decision_conflicts(spark, folder):
    return examples.decision_conflicts(_joined(spark, folder))


@query(
    "map_decision",
    sql(f"SELECT application_number, decision, coalesce(CAST({LABEL} AS VARCHAR), 'unknown') AS labels FROM filings", "filings"),
)
def map_decision(spark, folder):
    known, unknown = examples.split_unknown(b.filings(spark, folder).select("application_number", "decision"))
    return known.withColumn("labels", F.col("labels").cast("string")).unionByName(
        unknown.withColumn("labels", F.lit("unknown"))
    )


@query("keep_decided", sql("SELECT application_number, CAST(labels AS INTEGER) AS labels FROM decided", "decided"))
def keep_decided(spark, folder):
    return b.decided_filings(spark, folder).select("application_number", "labels")


def _labelled_examples(spark, folder):
    rows = examples.project_examples(_joined(spark, folder))
    return filters.keep_decided(examples.map_decision(rows))


_LABELLED_SQL = "CASE doc_decision WHEN 'ACCEPTED' THEN 1 ELSE 0 END AS labels"


@query(
    "select_section",
    sql(
        f"SELECT application_number AS patent_number, {_LABELLED_SQL}, abstract AS text FROM joined WHERE found AND doc_decision <> 'PENDING'",
        "joined",
    ),
)
def select_section(spark, folder):
    return examples.select_section(_labelled_examples(spark, folder), "abstract")


@query(
    "examiner_feature",
    sql(
        f"""SELECT application_number AS patent_number, {_LABELLED_SQL},
 concat('Examiner id: ', substr(examiner_id, 1, greatest(length(examiner_id) - 2, 0)), ' ', claims) AS text
 FROM joined WHERE found AND doc_decision <> 'PENDING'""",
        "joined",
    ),
)
def examiner_feature(spark, folder):
    return examples.select_section(_labelled_examples(spark, folder), "examiner")


@query(
    "nested_enrichment",
    sql(
        "SELECT application_number, application_number AS key, 1 AS n_keys, title, main_cpc_label AS cpc_label, md5(full_description) AS description_md5 FROM joined WHERE found",
        "joined",
    ),
)
def nested_enrichment(spark, folder):
    return examples.nested_enrichment(_joined(spark, folder)).select(
        "application_number",
        F.col("comb.patent_number")[0].alias("key"),
        F.size("comb.patent_number").alias("n_keys"),
        "comb.title",
        "comb.cpc_label",
        F.md5("comb.description").alias("description_md5"),
    )


@query(
    "join_documents",
    sql(
        """SELECT application_number, CAST(filing_year AS INTEGER) AS filing_year, found, coalesce(title, '') AS title,
 CAST(coalesce(length(claims), 0) AS INTEGER) AS claim_chars FROM joined""",
        "joined",
    ),
)
def join_documents(spark, folder):
    return _joined(spark, folder).select(
        "application_number",
        "filing_year",
        "found",
        F.coalesce("doc_title", F.lit("")).alias("title"),
        F.coalesce(F.length("doc_claims"), F.lit(0)).alias("claim_chars"),
    )


@query("missing_documents", sql("SELECT application_number FROM joined WHERE NOT found", "joined"))
def missing_documents(spark, folder):
    missing = examples.missing_documents(b.filings(spark, folder), b.application_documents(spark, folder))
    return missing.select("application_number")


@query(
    "semi_join_predictions",
    sql(
        """SELECT application_number, examiner_full_name, uspc_class FROM classified
 WHERE application_number IN (SELECT application_number FROM predictions WHERE correct)""",
        "classified",
        "predictions",
    ),
)
def semi_join_predictions(spark, folder):
    correct = b.predictions(spark, folder).where("correct")
    rows = outcome.with_ids(b.classified_filings(spark, folder), correct)
    return rows.select("application_number", "examiner_full_name", "uspc_class")


@query(
    "semi_join_listed",
    sql(
        """SELECT application_number, examiner_full_name, uspc_class FROM classified
 WHERE application_number IN (SELECT application_number FROM predictions WHERE NOT correct)""",
        "classified",
        "predictions",
    ),
)
def semi_join_listed(spark, folder):
    """The incorrect list by way of a Bloom filter of its ids."""
    wrong = b.predictions(spark, folder).where("NOT correct")
    return with_listed_ids(b.classified_filings(spark, folder), wrong).select("application_number", "examiner_full_name", "uspc_class")


@query("tagged_union", sql("SELECT application_number, decision, Prediction FROM outcomes", "outcomes"))
def tagged_union(spark, folder):
    metadata = b.filings(spark, folder).select("application_number", "decision")
    scored = b.predictions(spark, folder)
    correct = outcome.with_ids(metadata, scored.where("correct"))
    incorrect = outcome.with_ids(metadata, scored.where("NOT correct"))
    return outcome.tagged_union(correct, incorrect)


@query(
    "union_slices",
    sql(
        """SELECT application_number, strftime(filing_date, '%Y-%m-%d %H:%M:%S') AS filing_date FROM (
 SELECT * FROM filings WHERE year(filing_date) = 1996 UNION ALL SELECT * FROM filings WHERE year(filing_date) BETWEEN 1996 AND 1998)""",
        "filings",
    ),
)
def union_slices(spark, folder):
    rows = b.filings(spark, folder).select("application_number", "filing_date")
    both = outcome.union_all([filters.in_years(rows, [1996]), filters.in_years(rows, [1996, 1997, 1998])])
    return both.select("application_number", _stamp())
