import json

import pytest
from pyspark.sql import functions as F

from labelmill.operators.examples import join_documents
from labelmill.schemas import DOCUMENT_KEYS, METADATA
from labelmill.session import scratch_path
from labelmill.sources import ingest_documents, list_columns, quarantine, read_documents, read_metadata, write_arrow, write_documents


def _body(**changes):
    return {**{key: f"{key} text" for key in DOCUMENT_KEYS}, **changes}


@pytest.fixture
def folder(tmp_path):
    def put(year, number, content):
        (tmp_path / str(year)).mkdir(exist_ok=True)
        (tmp_path / str(year) / f"{number}.json").write_text(content, encoding="utf-8")

    put(2015, 1, json.dumps(_body(title="é\nmulti", extra="ignored"), indent=2))
    put(2015, 2, json.dumps(_body())[:-20])
    put(2016, 3, json.dumps({k: v for k, v in _body().items() if k != "summary"}))
    put(2016, 4, json.dumps(_body(patent_issue_date=None)))
    put(2016, 9, json.dumps(_body()))  # not in the metadata
    put(2014, 6, json.dumps(_body()))  # filed under the wrong year
    (tmp_path / "notes.txt").write_text("no document")
    return str(tmp_path)


def test_read_documents(spark, folder):
    got = {r.application_number: r for r in read_documents(spark, folder).collect()}
    assert {n: r.problem for n, r in got.items()} == {"1": None, "2": "corrupt", "3": "absent_key", "4": None, "9": None, "6": None}
    some = read_documents(spark, folder, years=[2016, 2031])
    assert sorted(r.application_number for r in some.collect()) == ["3", "4", "9"]
    assert got["1"].filing_year == 2015 and got["1"].title == "é\nmulti" and got["4"].patent_issue_date is None


def test_quarantine_has_one_row_per_bad_application(spark, folder, rows):
    metadata = spark.createDataFrame([(str(i), y) for i, y in ((1, 2015), (2, 2015), (3, 2016), (4, 2016), (5, 2016), (6, 2015))], "application_number string, year int")
    metadata = metadata.withColumn("filing_date", F.make_timestamp_ntz("year", F.lit(1), F.lit(2), F.lit(0), F.lit(0), F.lit(0)))
    bad = quarantine(metadata, read_documents(spark, folder))
    assert rows(bad) == [("2", "corrupt"), ("3", "absent_key"), ("5", "missing"), ("6", "missing")]


def test_ingest_keeps_good_documents_partitioned_by_year(spark, folder, tmp_path, rows):
    path = str(tmp_path / "stored")
    ingest_documents(read_documents(spark, folder), path)
    stored = spark.read.parquet(path)
    assert rows(stored, "filing_year", "application_number") == [(2014, "6"), (2015, "1"), (2016, "4"), (2016, "9")]
    plan = stored.where("filing_year = 2015")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(filing_year" in plan


def test_bucketed_documents_stay_in_place(spark, folder, tmp_path, rows):
    path = str(tmp_path / "bucketed")
    with pytest.raises(ValueError):
        ingest_documents(read_documents(spark, folder), path, "documents_test")
    ingest_documents(read_documents(spark, folder), path, "documents_test", buckets=6)
    metadata = spark.createDataFrame([("1", "2015-03-01"), ("4", "2016-03-01"), ("9", "2015-01-01")], "application_number string, day string")
    metadata = metadata.select("application_number", F.col("day").cast("timestamp_ntz").alias("filing_date"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = join_documents(metadata, spark.table("documents_test"), ("title",))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        assert rows(joined, "application_number", "found") == [("1", True), ("4", True), ("9", False)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE documents_test")


def test_written_documents_are_read_back(spark, rows):
    path = scratch_path(spark, "docs")
    body = F.to_json(F.struct(*(F.lit(key).alias(key) for key in DOCUMENT_KEYS)))
    source = spark.range(50).select((2010 + F.col("id") % 3).alias("filing_year"), F.col("id").cast("string").alias("application_number"), body.alias("body"))
    write_documents(source, path)
    write_documents(source, path)  # as a retry would
    back = read_documents(spark, path)
    assert back.count() == 50 and back.where("problem IS NOT NULL").count() == 0


def test_tasks_follow_the_bytes_of_small_files_not_their_number(spark, tmp_path, monkeypatch):
    """Spark's own scan gives a task 32 small files; names are listed by tasks and dealt out evenly."""
    for number in range(600):
        place = tmp_path / str(2010 + number % 2)
        place.mkdir(exist_ok=True)
        (place / f"{number}.json").write_text(json.dumps(dict.fromkeys(DOCUMENT_KEYS, "x")))
    (tmp_path / "2010" / "empty.json").write_text("")
    (tmp_path / "2010" / "_hidden.json").write_text("{}")
    (tmp_path / "2010" / "1 2%.json").write_text("{}")
    read = read_documents(spark, str(tmp_path))
    tasks = read.rdd.getNumPartitions()
    assert tasks <= 2 * spark.sparkContext.defaultParallelism
    assert read.count() == 601 and read.where("application_number = '1 2%' AND problem = 'absent_key' AND filing_year = 2010").count() == 1
    assert read_documents(spark, f"file:{tmp_path}", years=[2011, 2031]).count() == 300
    monkeypatch.setattr("labelmill.sources.documents.PER_TASK", 50)
    assert read_documents(spark, str(tmp_path)).rdd.getNumPartitions() == 13
    # a pattern goes to Spark's scan
    assert read_documents(spark, f"{tmp_path}/20*").where("filing_year = 2011").count() == 300


@pytest.mark.parametrize("suffix", ["parquet", "csv", "tsv", "feather"])
def test_metadata_formats(spark, rows, suffix):
    df = spark.createDataFrame(
        [("1", "2015-01-02 03:04:05", "ACCEPTED", 'quo"te', "tab\tand, comma"), ("2", None, "REJECTED", "line\nbreak", None)],
        "application_number string, filing_date string, decision string, main_cpc_label string, main_ipcr_label string",
    ).withColumn("filing_date", F.col("filing_date").cast("timestamp_ntz"))
    df = df.select(*(F.col(f.name) if f.name in df.columns else F.lit("x").alias(f.name) for f in METADATA.fields)).repartition(2)
    path = f"{scratch_path(spark, 'meta')}.{suffix}"
    if suffix == "parquet":
        df.write.parquet(path)
    elif suffix == "feather":
        write_arrow(df, path)
    else:
        df.write.option("escape", '"').csv(path, header=True, sep="\t" if suffix == "tsv" else ",")
    back = read_metadata(spark, path, line_breaks=True)
    assert back.schema.names == METADATA.names
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}


def test_single_feather_file_with_many_batches(spark, tmp_path):
    import pandas as pd
    import pyarrow as pa
    import pyarrow.feather as feather

    frame = pd.DataFrame({f.name: [str(i) for i in range(1000)] for f in METADATA.fields if f.name != "filing_date"})
    frame["filing_date"] = pd.Timestamp("2016-01-05")
    path = str(tmp_path / "m.feather")
    feather.write_feather(pa.Table.from_pandas(frame, preserve_index=False), path, chunksize=64)
    back = read_metadata(spark, path)
    assert back.agg(F.count("*"), F.count_distinct("application_number"), F.max("filing_date")).first()[:2] == (1000, 1000)
    assert back.select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.parametrize("suffix", ["parquet", "csv", "tsv", "feather"])
def test_metadata_columns_are_found_by_name(spark, suffix):
    """Shuffled columns, one more than declared, one that is declared left out."""
    names = [n for n in reversed(METADATA.names) if n != "examiner_id"]
    df = spark.createDataFrame([("5", "7")], "date_application_published string, application_number string")
    for n in names:
        if n != "application_number":
            df = df.withColumn(n, F.lit("2015-01-02 03:04:05").cast("timestamp_ntz") if n == "filing_date" else F.lit(f"value of {n}"))
    df = df.select("date_application_published", *names)
    path = f"{scratch_path(spark, 'meta')}.{suffix}"
    if suffix == "parquet":
        df.write.parquet(path)
    elif suffix == "feather":
        write_arrow(df, path)
    else:
        df.write.csv(path, header=True, sep="\t" if suffix == "tsv" else ",")
    back = read_metadata(spark, path)
    assert back.columns == [*METADATA.names, "date_application_published"]
    row = back.first().asDict()
    assert row["application_number"] == "7" and row["decision"] == "value of decision" and row["examiner_id"] is None
    assert str(row["filing_date"]) == "2015-01-02 03:04:05" and row["date_application_published"] == "5"


def test_required_columns(spark):
    path = f"{scratch_path(spark, 'meta')}.csv"
    spark.createDataFrame([("1", "ACCEPTED")], "application_number string, decision string").write.csv(path, header=True)
    with pytest.raises(ValueError, match="filing_date"):
        read_metadata(spark, path)


def test_plain_text_metadata_can_be_split(spark, tmp_path):
    lines = ["\t".join(METADATA.names)] + [f"{i}\t2016-01-0{i}T00:00:00\tACCEPTED" + "\tx" * 7 for i in range(1, 6)]
    (tmp_path / "m.tsv").write_text("\n".join(lines))
    back = read_metadata(spark, str(tmp_path / "m.tsv"), line_breaks=False)
    assert back.agg(F.count("filing_date"), F.max("application_number")).first()[:] == (5, "5")


@pytest.mark.parametrize("name", ["x.pickle", "x.xlsx", "x"])
def test_other_formats_are_refused(spark, name):
    with pytest.raises(ValueError, match="metadata"):
        read_metadata(spark, name)


def test_list_columns(spark, rows):
    df = spark.createDataFrame([(1, None), (2, "a")], "n int, s string")
    assert rows(list_columns(df)) == [(0, "n", "int", 2), (1, "s", "string", 1)]
