"""The shape of the plans: what shuffles, what is broadcast, what is pruned."""

import re

import pytest
from pyspark.sql import functions as F

from labelmill.functions import words_of
from labelmill.operators import encoding, filters, models, runlog, sinks, splits
from labelmill.operators.vocabulary import build_vocabulary


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    spark.range(5000).selectExpr(
        "cast(id AS string) AS application_number",
        "cast(date_add(date'2014-01-01', cast(id % 1500 AS int)) AS timestamp_ntz) AS filing_date",
        "if(id % 2 = 0, 'ACCEPTED', 'REJECTED') AS decision",
        "concat('w', id % 7, ' and w', id % 11) AS text",
        "'x' AS main_ipcr_label",
        "cast(id % 2 AS int) AS labels",
    ).write.parquet(str(root / "filings"))
    spark.range(5000).selectExpr("id % 9 AS run_id", "id AS entry", "rand(1) AS value").write.parquet(str(root / "log"))
    return {name: spark.read.parquet(str(root / name)) for name in ("filings", "log")}


@pytest.fixture
def no_auto_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def operators(df):
    """Names of the operators rows pass through; subqueries, one value each, are left out."""
    names, pending = [], [df._jdf.queryExecution().executedPlan()]
    while pending:
        node = pending.pop()
        name = node.nodeName()
        names.append(name)
        if name == "AdaptiveSparkPlan":
            pending.append(node.executedPlan())
        children = node.children()
        pending.extend(children.apply(i) for i in range(children.size()))
    return names


def row_exchanges(plan):
    return re.findall(r"(?<!Reused)Exchange (\w+)", plan)


@pytest.mark.parametrize("split", [splits.uniform_split, splits.balance_classes, splits.hash_split])
def test_splits_filter_rows_without_shuffling_them(tables, split):
    df = split(tables["filings"])
    names = operators(df)
    assert not {"Exchange", "Window", "Sort"} & set(names) and not any("Join" in name for name in names)
    assert sum("Scan" in name for name in names) == 1
    assert "CartesianProduct" not in physical(df) and "NestedLoopJoin" not in physical(df)


def test_no_python_in_core_plans(tables):
    df = splits.uniform_split(tables["filings"])
    assert "Python" not in physical(df) and "BatchEval" not in physical(encoding.pad_and_mask(
        encoding.encode(df, ["application_number"], words_of("text"), build_vocabulary(df, words_of("text"))), 8))


def test_encode_decode_and_padding_leave_rows_in_place(tables):
    df = tables["filings"]
    entries = build_vocabulary(df, words_of("text"))
    encoded = encoding.encode(df, ["application_number"], words_of("text"), entries)
    names = operators(encoding.decode(encoding.pad_and_mask(encoded, 512), entries))
    assert not {"Exchange", "Generate", "Sort"} & set(names) and not any("Join" in name for name in names)


def test_large_vocabularies_are_not_forced_into_a_broadcast(tables, no_auto_broadcast):
    df = tables["filings"]
    entries = build_vocabulary(df, words_of("text"), size=1_000_000)
    plan = physical(encoding.encode(df, ["application_number"], words_of("text"), entries, vocab_size=1_000_000))
    assert "BroadcastExchange" not in plan and "salt" in plan


def test_scoring_sums_up_before_the_shuffle(tables):
    df = tables["filings"]
    model = models.train_naive_bayes(df, words_of("text"), build_vocabulary(df, words_of("text")), "multinomial")
    plan = physical(models.score_naive_bayes(df, model, words_of("text"), ["application_number"]))
    above = plan[: plan.index("BroadcastExchange")]
    assert above.index("partial_sum") > above.index("Exchange hashpartitioning")  # partial below the exchange
    assert above.count("Exchange hashpartitioning") == 1 and "Generate explode" in above


def test_running_windows_partition_by_block(tables, no_auto_broadcast):
    plan = physical(runlog.running_mean(tables["log"], ["run_id"], "entry"))
    assert "Exchange SinglePartition" not in plan
    windows = re.findall(r"windowspecdefinition\(([^)]*)", plan)
    row_windows = [w for w in windows if "entry" in w]
    assert row_windows and all("_block" in w for w in row_windows)


def test_batches_need_one_row_shuffle(tables):
    plan = physical(sinks.assign_batches(tables["filings"].select("application_number"), 16))
    exchanges = row_exchanges(plan[: plan.index("BroadcastExchange")])
    assert exchanges == ["hashpartitioning"]


def test_filters_reach_the_scan(tables):
    plan = physical(filters.by_ipc(tables["filings"], "G06").select("application_number"))
    assert "StringStartsWith(main_ipcr_label,G06)" in plan
    assert "ReadSchema: struct<application_number:string,main_ipcr_label:string>" in plan


def test_date_split_scans_once(tables):
    plan = physical(splits.date_split(tables["filings"], "2014-01-01", "2015-01-01", None, "2016-01-01").select("split"))
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    assert "ReadSchema: struct<filing_date:timestamp_ntz>" in plan


def test_years_prune_partitions(tables, spark, tmp_path):
    path = str(tmp_path / "by_year")
    tables["filings"].withColumn("filing_year", F.year("filing_date")).write.partitionBy("filing_year").parquet(path)
    plan = physical(filters.in_years(spark.read.parquet(path), [2015, 2016]))
    assert re.search(r"PartitionFilters: \[[^]]*filing_year#\d+ IN \(2015,2016\)", plan)
