import datetime as dt

import pytest
from pyspark.sql import functions as F

from labelmill.config import CorpusConfig
from labelmill.operators import examples, filters
from labelmill.operators import predictions as outcome
from labelmill.schemas import DOCUMENT_KEYS, EXAMPLE_COLUMNS

STAMPS = ["2014-12-31 23:59:59", "2015-01-01 00:00:00", "2015-02-15 00:00:00", "2015-02-15 10:00:00", "2015-12-31 18:00:00", "2016-01-01 00:00:00"]


@pytest.fixture
def metadata(spark):
    labels = ["G06F17", "G06Q10", "H04L", "G06F3", "A61K", None]
    data = [(str(i), dt.datetime.fromisoformat(s), labels[i], labels[-i - 1], "ACCEPTED" if i % 2 else "REJECTED") for i, s in enumerate(STAMPS)]
    return spark.createDataFrame(data, "application_number string, filing_date timestamp_ntz, main_ipcr_label string, main_cpc_label string, decision string")


def ids(df):
    return sorted(r.application_number for r in df.collect())


def test_classification_prefix(metadata):
    assert ids(filters.by_classification(metadata, ipc="G06F")) == ["0", "3"]
    assert ids(filters.by_classification(metadata, cpc="G06F")) == ["2", "5"]
    assert ids(filters.by_classification(metadata, ipc="G06F", cpc="H04")) == ["0", "3"]
    assert ids(filters.by_classification(metadata)) == list("012345")


def test_expression(metadata):
    assert ids(filters.matching(metadata, "decision = 'ACCEPTED' AND main_ipcr_label LIKE 'G%'")) == ["1", "3"]


def test_date_range_is_inclusive_and_takes_unpadded_dates(metadata):
    assert ids(filters.filed_between(metadata, "2015-1-1", "2015-2-15")) == ["1", "2"]
    assert ids(filters.filed_between(metadata, end="2014-12-31")) == []
    assert ids(filters.filed_between(metadata, start="2016-01-01")) == ["5"]


def test_years_include_the_last_evening(metadata):
    assert ids(filters.in_years(metadata, [2015])) == ["1", "2", "3", "4"]
    assert ids(filters.in_years(metadata, [2014, 2016])) == ["0", "5"]
    assert ids(filters.in_years(metadata, [])) == []
    assert filters.year_spans([2015, 2013, 2014, 2014, 2018]) == [(2013, 2015), (2018, 2018)]
    with_year = metadata.withColumn("filing_year", F.year("filing_date"))
    assert ids(filters.in_years(with_year, [2015])) == ["1", "2", "3", "4"]


def test_select_metadata_and_counts(metadata, rows):
    chosen = filters.select_metadata(metadata, CorpusConfig(ipc_prefix="G06", years=(2015,)))
    assert ids(chosen) == ["1", "3"]
    assert rows(filters.count_by_year(metadata)) == [(2014, 1), (2015, 4), (2016, 1)]


@pytest.fixture
def documents(spark):
    def document(number, year, decision):
        return (year, number, *(decision if key == "decision" else f"{key} {number}" for key in DOCUMENT_KEYS))

    data = [document("0", 2014, "REJECTED"), document("1", 2015, "REJECTED"), document("5", 2015, "ACCEPTED"), document("7", 2016, "PENDING")]
    return spark.createDataFrame(data, "filing_year int, application_number string, " + ", ".join(f"{k} string" for k in DOCUMENT_KEYS))


def test_join_project_and_conflicts(metadata, documents, rows):
    joined = examples.join_documents(metadata, documents)
    assert joined.count() == 6
    assert ids(joined.where("found")) == ["0", "1"]  # 5 lies in the folder of another year
    assert ids(examples.missing_documents(metadata, documents)) == ["2", "3", "4", "5"]
    assert rows(examples.decision_conflicts(joined)) == [("1", "ACCEPTED", "REJECTED")]
    projected = examples.project_examples(joined)
    assert projected.columns == list(EXAMPLE_COLUMNS)
    first = projected.where("patent_number = '1'").first()
    assert first.description == "full_description 1" and first.cpc_label == "main_cpc_label 1" and first.decision == "REJECTED"
    assert examples.project_examples(joined, "metadata").where("patent_number = '1'").first().decision == "ACCEPTED"


def test_nested_enrichment(metadata, documents):
    nested = examples.nested_enrichment(examples.join_documents(metadata, documents)).where("application_number = '0'").first()
    assert nested.comb.patent_number == ["0"] and nested.comb.summary == "summary 0" and len(nested.comb) == 14


def test_unknown_decisions_are_set_apart(spark, rows):
    df = spark.createDataFrame([("1", "ACCEPTED"), ("2", "error"), ("3", None)], "application_number string, decision string")
    known, unknown = examples.split_unknown(df)
    assert rows(known) == [("1", "ACCEPTED", 1)] and ids(unknown) == ["2", "3"]


def test_sections(spark, rows):
    df = spark.createDataFrame([("1", 1, "12345.0", "claim", "short")], "patent_number string, labels int, examiner_id string, claims string, abstract string")
    assert rows(examples.select_section(df)) == [("1", 1, "claim")]
    assert rows(examples.select_section(df, "abstract")) == [("1", 1, "short")]
    assert rows(examples.select_section(df, "examiner")) == [("1", 1, "Examiner id: 12345 claim")]


def test_prediction_sets(metadata, spark, rows):
    predictions = spark.createDataFrame([("0", True), ("1", False), ("9", True)], "application_number string, correct boolean")
    correct = outcome.with_ids(metadata, predictions.where("correct"))
    incorrect = outcome.with_ids(metadata, predictions.where("NOT correct"))
    tagged = outcome.tagged_union(correct, incorrect)
    assert rows(tagged, "application_number", "Prediction") == [("0", "Correct"), ("1", "Incorrect")]
    assert rows(outcome.with_outcome(metadata, predictions), "application_number", "Prediction") == [("0", "Correct"), ("1", "Incorrect")]
    assert outcome.union_all([correct, correct, incorrect]).count() == 3
