"""Documents opened by name, and indexed metadata."""

import json
import os

import pytest
from pyspark.sql import functions as F

from labelmill.schemas import DOCUMENT_KEYS, METADATA
from labelmill.session import scratch_path
from labelmill.sources import (
    index_batches, looked_up, read_arrow, read_documents, read_documents_by_name, read_indexed, read_metadata, split_unreadable,
)


def _body(**changes):
    return {**{key: f"{key} text" for key in DOCUMENT_KEYS}, **changes}


@pytest.fixture
def folder(tmp_path):
    for year in (2015, 2016):
        (tmp_path / str(year)).mkdir()
        for number in range(40):
            (tmp_path / str(year) / f"{number}.json").write_text(json.dumps(_body(title=f"é {year} {number}")))
    (tmp_path / "2015" / "3.json").write_text(json.dumps(_body())[:-9])
    (tmp_path / "2015" / "4.json").write_text(json.dumps({k: v for k, v in _body().items() if k != "summary"}))
    (tmp_path / "2015" / "5.json").write_text("")
    return str(tmp_path)


def _wanted(spark, names):
    return spark.createDataFrame(names, "filing_year int, application_number string")


@pytest.mark.parametrize("per_task", [1, 3, 2_000])
def test_documents_by_name_are_those_of_the_listing(spark, folder, per_task):
    names = [(2015, str(i)) for i in range(8)] + [(2016, "39"), (2016, "39"), (2016, "99"), (2099, "1"), (None, "1"), (2015, None)]
    names += [(2015, "../2016/7"), (2015, ""), (2015, "..")]
    got = {(r.filing_year, r.application_number): tuple(r)[2:] for r in read_documents_by_name(spark, folder, _wanted(spark, names), per_task).collect()}
    listed = {(r.filing_year, r.application_number): tuple(r)[2:] for r in read_documents(spark, folder).collect()}
    expected = {name: listed.get(name, (*[None] * len(DOCUMENT_KEYS), "missing")) for name in names if None not in name}
    # a listing passes over empty files
    expected[2015, "5"] = (*[None] * len(DOCUMENT_KEYS), "corrupt")
    assert got == expected and got[2015, "3"][-1] == got[2015, "5"][-1] == "corrupt" and got[2015, "4"][-1] == "absent_key"


def test_only_the_wanted_files_are_opened(spark, folder):
    """What is not wanted could not be opened at all: it is a folder by that name."""
    for year in (2015, 2016):
        for number in range(100, 130):
            os.makedirs(f"{folder}/{year}/{number}.json")
    documents = read_documents_by_name(spark, folder, _wanted(spark, [(2015, "1"), (2016, "2"), (2016, "555")]), per_task=1)
    assert sorted((r.application_number, r.problem) for r in documents.collect()) == [("1", None), ("2", None), ("555", "missing")]
    # one task per name, none per file of the folder
    assert documents.rdd.getNumPartitions() <= 3 + spark.sparkContext.defaultParallelism


def test_look_up_quarantines_what_is_absent(spark, folder, rows):
    metadata = spark.createDataFrame([("1", "2015-03-01"), ("3", "2015-03-01"), ("77", "2016-01-01"), ("8", None)], "application_number string, day string")
    metadata = metadata.select("application_number", F.col("day").cast("timestamp_ntz").alias("filing_date"))
    good, bad = looked_up(spark, metadata, folder)
    assert rows(good, "filing_year", "application_number", "title") == [(2015, "1", "é 2015 1")]
    assert rows(bad) == [("3", "corrupt"), ("77", "missing")]
    assert looked_up(spark, metadata.limit(0), folder)[0].count() == 0


@pytest.fixture
def feather(spark, tmp_path):
    """A year of filings in batches of 100 rows, in order of their date."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa
    import pyarrow.feather as arrow

    n = 1200
    frame = pd.DataFrame({f.name: [f"{f.name} {i}" for i in range(n)] for f in METADATA.fields if f.name != "filing_date"})
    frame["application_number"] = [str(i) for i in range(n)]
    frame["filing_date"] = pd.to_datetime("2016-01-01") + pd.to_timedelta(np.arange(n) * 7, unit="h")
    frame["decision"] = pd.Categorical(["ACCEPTED" if i % 3 else "REJECTED" for i in range(n)])
    frame["price"] = [float("nan") if i == 350 else i / 2 for i in range(n)]
    frame["small"] = np.arange(n) // 100
    frame.loc[200:299, "examiner_id"] = None
    path = str(tmp_path / "metadata.feather")
    arrow.write_feather(pa.Table.from_pandas(frame, preserve_index=False), path, chunksize=100)
    index_batches(spark, path)
    return path


CONDITIONS = [
    "filing_date >= timestamp_ntz'2016-03-01' AND filing_date < timestamp_ntz'2016-04-01'",
    "small = 3", "small IN (2, 9, 40)", "small > 10", "small <= 0 AND price < 20", "price >= 400", "price = 'NaN'", "small >= 12",
    "decision = 'REJECTED' AND application_number LIKE '11%'", "examiner_id IS NULL", "examiner_id IS NOT NULL AND small < 4",
    "examiner_id > 'examiner_id 5'", "NOT small = 3", "small = 1 OR small = 2", "application_number = '17'", "small = NULL",
]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_pushed_filters_change_no_rows(spark, feather, rows, condition):
    indexed, plain = read_indexed(spark, feather, rows_per_task=100), read_arrow(spark, feather)
    assert indexed.schema == plain.schema
    columns = ("application_number", "filing_date", "decision")
    assert rows(indexed.where(condition), *columns) == rows(plain.where(condition), *columns)


def test_a_month_reads_its_batches_only(spark, feather):
    month = read_indexed(spark, feather, ("application_number", "filing_date"), rows_per_task=100).where(CONDITIONS[0])
    plan = spark._jvm.PythonSQLUtils.explainString(month._jdf.queryExecution(), "formatted")
    # the source takes the filters over: none is left above the scan
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(filing_date" in plan and "Filter (" not in plan
    assert month.columns == ["application_number", "filing_date"]
    # a hundred rows are 29 days
    assert month.rdd.getNumPartitions() <= 3 and read_indexed(spark, feather, rows_per_task=100).rdd.getNumPartitions() == 12
    assert month.count() == round(31 * 24 / 7)


def test_filter_on_a_column_that_is_not_read(spark, feather):
    some = read_indexed(spark, feather, ("application_number", "small"), rows_per_task=500).where("small = 7").select("application_number")
    assert sorted(int(r[0]) for r in some.collect()) == list(range(700, 800))


def test_unreadable_values_are_told_or_set_apart(spark, rows):
    path = f"{scratch_path(spark, 'meta')}.csv"
    lines = [("1", "2015-01-02", "ACCEPTED"), ("2", "not a date", "REJECTED"), ("3", None, "ACCEPTED"), ("4", "2015-13-45", "ACCEPTED")]
    spark.createDataFrame(lines, "application_number string, filing_date string, decision string").write.csv(path, header=True)
    with pytest.raises(Exception, match="filing_date cannot be read from"):
        read_metadata(spark, path).collect()
    good, bad = split_unreadable(read_metadata(spark, path, bad_values="_bad"), "_bad")
    assert rows(good, "application_number") == [("1",)] and good.columns == METADATA.names
    assert rows(bad) == [("2", "unreadable filing_date"), ("3", "no_filing_date"), ("4", "unreadable filing_date")]
