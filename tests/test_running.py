import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from labelmill.operators import metrics, runlog, statistics
from labelmill.operators.distribution import cumulative, histogram, quantiles_from


@pytest.fixture(scope="module")
def log(spark):
    """Run 0 holds a third of all entries; entries of the runs are interleaved."""
    random.seed(5)
    data = [(0 if random.random() < 0.33 else random.randint(1, 9), n, round(random.uniform(-5, 50), 2)) for n in range(600)]
    df = spark.createDataFrame(data, "run_id long, entry long, value double").repartition(4)
    runs = {}
    for run, entry, value in data:
        runs.setdefault(run, []).append((entry, value))
    return df, runs


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_running_mean(log, parts):
    df, runs = log
    got = {(r.run_id, r.entry): (r.i, r.running_mean) for r in runlog.running_mean(df, ["run_id"], "entry", parts=parts).collect()}
    assert len(got) == 600
    for run, entries in runs.items():
        total = 0.0
        for i, (entry, value) in enumerate(entries):
            total += value
            assert got[run, entry][0] == i and got[run, entry][1] == pytest.approx(total / (i + 1))


def test_running_mean_by_index(log):
    df, runs = log
    got = {(r.run_id, r.entry): r.running_mean for r in runlog.running_mean(df, ["run_id"], "entry", divide_by_index=True, parts=5).collect()}
    for run, entries in runs.items():
        values = [v for _, v in entries]
        for i, (entry, _) in enumerate(entries):
            assert got[run, entry] == pytest.approx(sum(values[: i + 1]) / max(i, 1))


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_best_so_far(log, parts):
    df, runs = log
    got = {(r.run_id, r.entry): (r.best, r.improved) for r in runlog.best_so_far(df, ["run_id"], "entry", parts=parts).collect()}
    for run, entries in runs.items():
        best = 0.0
        for entry, value in entries:
            assert got[run, entry] == (max(best, value), value > best)
            best = max(best, value)


def test_every_nth_and_groups(log):
    df, runs = log
    nth = {(r.run_id, r.entry) for r in runlog.every_nth_step(df, ["run_id"], "entry", 4, parts=16).collect()}
    assert nth == {(run, entry) for run, entries in runs.items() for i, (entry, _) in enumerate(entries) if i and i % 4 == 0}
    groups = {(r.run_id, r.group_id): r.total for r in runlog.accumulation_groups(df, ["run_id"], "entry", 8, parts=16).collect()}
    expected = {(run, g): sum(v for _, v in entries[8 * g : 8 * g + 8]) for run, entries in runs.items() for g in range(len(entries) // 8)}
    assert groups.keys() == expected.keys() and all(groups[k] == pytest.approx(v) for k, v in expected.items())
    everything = runlog.accumulation_groups(df, ["run_id"], "entry", 8, complete_only=False, parts=16)
    assert everything.agg(F.sum("n")).first()[0] == 600


@pytest.mark.parametrize("slices", [1, 3, 40])
def test_quantiles_are_exact(spark, slices):
    random.seed(3)
    data = [("a" if i % 3 else "b", random.choice([1.0, 2.0, random.uniform(-100, 100)])) for i in range(500)]
    df = spark.createDataFrame(data, "g string, x double")
    hist = histogram(df, ["g"], "x", {"rows": F.lit(1)})
    got = {r.g: r for r in quantiles_from(hist, "g", "x", "rows", {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}, slices).collect()}
    for g in "ab":
        values = [x for h, x in data if h == g]
        expected = np.quantile(values, [0, 0.25, 0.5, 0.99, 1.0])
        assert np.allclose([got[g].p0, got[g].p25, got[g].p50, got[g].p99, got[g].p100], expected) and got[g].n == len(values)


@pytest.mark.parametrize("descending", [True, False])
def test_cumulative(spark, descending):
    hist = spark.createDataFrame([(float(i), i) for i in range(50)], "v double, n int")
    got = {r.v: r.cum_n for r in cumulative(hist, [], "v", ["n"], descending, slices=6).collect()}
    assert got == {float(i): sum(range(i, 50)) if descending else sum(range(i + 1)) for i in range(50)}


def test_box_stats(spark):
    values = [1.0, 2.0, 2.0, 3.0, 4.0, 5.0, 100.0, -90.0]
    df = spark.createDataFrame([("Correct", v) for v in values] + [("Incorrect", 7.0), ("Incorrect", None)], "Prediction string, x double")
    got = {r.Prediction: r for r in statistics.box_stats(df, "x").collect()}
    q1, median, q3 = np.quantile(values, [0.25, 0.5, 0.75])
    row = got["Correct"]
    assert (row.n, row.q1, row.median, row.q3, row.whislo, row.whishi, row.outliers) == (8, q1, median, q3, 1.0, 5.0, 2)
    one = got["Incorrect"]
    assert (one.n, one.q1, one.whislo, one.whishi, one.outliers) == (1, 7.0, 7.0, 7.0, 0)


def _average_precision(pairs):
    positives, found, seen, total = sum(label for label, _ in pairs), 0, 0, 0.0
    for score in sorted({s for _, s in pairs}, reverse=True):
        hits = [label for label, s in pairs if s == score]
        seen, found = seen + len(hits), found + sum(hits)
        total += sum(hits) / positives * found / seen
    return total


@pytest.mark.parametrize("slices", [1, 5, 64])
def test_average_precision_with_ties(spark, slices):
    random.seed(11)
    pairs = [(random.randint(0, 1), random.choice([0.5, round(random.random(), 3)])) for _ in range(400)]
    got = metrics.average_precision(spark.createDataFrame(pairs, "label int, score double"), slices).first()
    assert got.positives == sum(p for p, _ in pairs) and got.auprc == pytest.approx(_average_precision(pairs))


def test_average_precision_without_positives(spark):
    none = spark.createDataFrame([(0, 0.2), (0, 0.4)], "label int, score double")
    assert tuple(metrics.average_precision(none).first()) == (0, 0.0)
    assert tuple(metrics.average_precision(none.limit(0)).first()) == (0, 0.0)


def test_rows_without_a_run_stay(spark):
    from labelmill.operators.running import running

    df = spark.createDataFrame([(None if i % 4 == 0 else "a", i) for i in range(20)], "run string, step int")
    out = running(df, ["run"], "step", {"n": ("count", F.col("step"), True)}, parts=4)
    assert out.count() == 20 and out.where("run IS NULL").agg(F.max("n")).first()[0] == 5


def test_sparse_steps(spark):
    """Steps 100,000 apart, most rows in one run, against a plain window."""
    df = spark.range(20_000).selectExpr("if(id % 10 = 0, id % 7, 0) AS run", "id * 100000 AS step", "cast(id % 13 AS double) AS value")
    got = runlog.running_mean(df, ["run"], "step", parts=8).cache()
    window = Window.partitionBy("run").orderBy("step")
    plain = df.withColumns({"place": F.row_number().over(window) - 1, "mean": F.avg("value").over(window)})
    both = got.join(plain.select("run", "step", "place", "mean"), ["run", "step"])
    assert both.count() == 20_000 and both.where("i <> place OR abs(running_mean - mean) > 1e-9").count() == 0
    assert got.select("run", "step").distinct().count() == 20_000
