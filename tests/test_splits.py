import datetime as dt
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from labelmill.operators import sinks, splits
from labelmill.operators.selection import hex_bucket, positions, smallest


def key(i, seed=1729):
    return hashlib.md5(f"{seed}-{i}".encode()).hexdigest()


@pytest.fixture
def filings(spark):
    """1000 rows; a third of all rows is PENDING, the classes are uneven."""
    decision = F.when(F.col("id") % 3 == 0, "PENDING").when(F.col("id") % 10 == 1, "REJECTED").otherwise("ACCEPTED")
    day = F.date_add(F.lit(dt.date(2014, 1, 1)), F.col("id").cast("int")).cast("timestamp_ntz")
    return spark.range(1000).select(F.col("id").cast("string").alias("application_number"), decision.alias("decision"), day.alias("filing_date"))


def ids(df):
    return [r.application_number for r in df.select("application_number").collect()]


def test_uniform_split_is_exact(filings, rows):
    got = dict(rows(splits.uniform_split(filings), "application_number", "split"))
    order = sorted(range(1000), key=key)
    assert {i for i, s in got.items() if s == "train"} == {str(i) for i in order[:850]}
    assert len(got) == 1000 and set(got.values()) == {"train", "validation"}


@pytest.mark.parametrize("n", [0, 1, 2, 7])
def test_uniform_split_of_few_rows(filings, n):
    few = filings.where(F.col("application_number").cast("int") < n)
    got = [r.split for r in splits.uniform_split(few).collect()]
    assert got.count("train") == math.floor(n * 0.85) and len(got) == n


def test_uniform_split_drop_last_and_bounds(filings):
    got = splits.uniform_split(filings, "2014-02-01", "2014-03-01", drop_last=True)
    inside = [i for i in range(1000) if 31 <= i <= 59]
    order = sorted(inside, key=key)
    assert sorted(ids(got)) == sorted(map(str, order[:-1]))
    assert got.where("split = 'train'").count() == math.floor(len(inside) * 0.85)


def test_hash_split_is_stable_when_rows_are_added(filings, rows):
    part = filings.where(F.col("application_number").cast("int") < 500)
    whole = dict(rows(splits.hash_split(filings), "application_number", "split"))
    assert all(whole[i] == s for i, s in rows(splits.hash_split(part), "application_number", "split"))
    assert 800 < sum(s == "train" for s in whole.values()) < 900


def test_date_split_overlaps(filings):
    got = splits.date_split(filings, "2014-01-01", "2014-01-11", "2014-01-09", "2014-01-13")
    assert sorted(int(i) for i in ids(got.where("split = 'train'"))) == list(range(0, 10))
    assert sorted(int(i) for i in ids(got.where("split = 'validation'"))) == [8, 9, 10, 11]


def test_date_split_default_and_missing_bounds(filings):
    got = splits.date_split(filings, "2014-01-01", "2014-01-11", None, "2014-01-13")
    assert sorted(int(i) for i in ids(got.where("split = 'validation'"))) == [10, 11]
    for bounds in ((None, "2014-01-02", "2014-01-02", "2014-02-02"), ("2014-01-01", "2014-01-02", "2014-01-02", None)):
        with pytest.raises(ValueError):
            splits.date_split(filings, *bounds)


def test_balance_classes(filings):
    got = splits.balance_classes(filings).collect()
    by_class = {c: sorted((int(r.application_number) for r in got if r.decision == c), key=key) for c in ("ACCEPTED", "REJECTED")}
    rejected = [i for i in range(1000) if i % 3 and i % 10 == 1]
    accepted = [i for i in range(1000) if i % 3 and i % 10 != 1]
    assert by_class["REJECTED"] == sorted(rejected, key=key)
    assert by_class["ACCEPTED"] == sorted(accepted, key=key)[: len(rejected)]
    assert len(got) == 2 * len(rejected)


def test_balance_equal_and_absent_classes(spark, filings):
    equal = spark.createDataFrame([("1", "ACCEPTED"), ("2", "REJECTED"), ("3", "PENDING")], "application_number string, decision string")
    assert sorted(ids(splits.balance_classes(equal))) == ["1", "2"]
    assert ids(splits.balance_classes(filings.where("decision <> 'REJECTED'"))) == []


def test_balance_leaves_other_rows_alone(filings):
    parts = splits.uniform_split(filings)
    got = splits.balance_classes(parts, only=F.col("split") == "validation")
    assert got.where("split = 'train'").count() == 850
    counts = {r.decision: r["count"] for r in got.where("split = 'validation'").groupBy("decision").count().collect()}
    assert set(counts) == {"ACCEPTED", "REJECTED"} and counts["ACCEPTED"] == counts["REJECTED"]


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_balance_on_top_of_a_join(spark, filings, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        joined = filings.drop("decision").join(filings.select("application_number", "decision"), "application_number")
        expected = sorted(ids(splits.balance_classes(filings)))
        assert sorted(ids(splits.balance_classes(joined))) == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_head_per_class(filings):
    labelled = filings.where("decision <> 'PENDING'").withColumn("labels", F.when(F.col("decision") == "ACCEPTED", 1).otherwise(0))
    got = splits.head_per_class(labelled, size=20).collect()
    for label, wanted in ((1, lambda i: i % 3 and i % 10 != 1), (0, lambda i: i % 3 and i % 10 == 1)):
        expected = [i for i in range(1000) if wanted(i)][:20]
        assert sorted(int(r.application_number) for r in got if r.labels == label) == expected


def test_weighted_sample(filings):
    labelled = filings.where("decision <> 'PENDING'").withColumn("labels", F.when(F.col("decision") == "ACCEPTED", 1).otherwise(0))
    sample = splits.weighted_sample(labelled, 60)
    counts = {r.labels: r["count"] for r in sample.groupBy("labels").count().collect()}
    assert sum(counts.values()) == 60 and sample.distinct().count() == 60
    assert 18 <= counts[0] <= 42  # about even, though class 0 is a tenth of the rows
    assert splits.weighted_sample(labelled, 10**6).count() == labelled.count()


@pytest.mark.parametrize("digits", [1, 3])
def test_smallest_per_group_with_one_dominant_group(spark, digits):
    df = spark.range(900).select("id", F.when(F.col("id") < 800, "big").when(F.col("id") < 895, "mid").otherwise("tiny").alias("g"))
    df = df.withColumn("k", F.md5(F.col("id").cast("string")))
    got = smallest(df, "k", hex_bucket("k", digits), F.lit(50), F.col("g")).collect()
    for name, members in (("big", range(800)), ("mid", range(800, 895)), ("tiny", range(895, 900))):
        expected = sorted(members, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:50]
        assert sorted(r.id for r in got if r.g == name) == sorted(expected)


def test_positions_and_batches(filings, rows):
    order = {str(i): place for place, i in enumerate(sorted(range(1000), key=key))}
    assert dict(rows(splits.seeded_shuffle(filings), "application_number", "position")) == order
    batched = sinks.assign_batches(filings, 64)
    assert all(r.batch_id == order[r.application_number] // 64 for r in batched.collect())
    with pytest.raises(ValueError):
        positions(filings, "application_number", digits=9)


def test_step_budget(filings):
    assert tuple(sinks.step_budget(filings, 8, 8).first()) == (1000, 15)


def test_heads_take_any_id_and_limit_early(spark):
    df = spark.createDataFrame([(i, 1) for i in ("RE0", "10", "9", "D7", "2")], "application_number string, labels int")
    heads = splits.head_per_class(df, size=4)
    assert sorted(r.application_number for r in heads.collect()) == ["10", "2", "9", "D7"]
    assert "WindowGroupLimit" in heads._jdf.queryExecution().executedPlan().toString()


def test_weighted_sample_with_null_labels(spark):
    df = spark.createDataFrame([(str(i), i % 3 if i % 4 else None) for i in range(200)], "application_number string, labels int")
    assert splits.weighted_sample(df, 50).count() == 50
