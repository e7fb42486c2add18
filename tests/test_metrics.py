import math

import pytest

from labelmill.operators import metrics, sinks, statistics


@pytest.fixture
def scored(spark):
    data = [(1, 1, 0.9), (1, 0, 0.3), (0, 0, 0.2), (0, 1, 0.6), (1, 1, 0.7)]
    return spark.createDataFrame(data, "label int, pred int, score double")


def test_accuracy_f1_confusion(scored, rows):
    assert tuple(metrics.accuracy(scored).first()) == (5, 3, 0.6)
    row = metrics.f1_score(scored).first()
    assert (row.tp, row.fp, row.fn) == (2, 1, 1) and row.f1 == pytest.approx(4 / 6)
    assert rows(metrics.confusion_matrix(scored)) == [(0, 0, 1), (0, 1, 1), (1, 0, 1), (1, 1, 2)]
    row = metrics.accuracy_vs_majority(scored).first()
    assert (row.accuracy, row.majority) == (0.6, 0.6) and row.gain == 0


def test_empty_input(scored, rows):
    empty = scored.limit(0)
    assert tuple(metrics.accuracy(empty).first()) == (0, 0, None)
    assert metrics.f1_score(empty).first().f1 == 0.0
    assert sum(n for _, _, n in rows(metrics.confusion_matrix(empty))) == 0
    assert metrics.accuracy_vs_majority(empty).first().accuracy is None


def test_f1_is_zero_when_undefined(scored):
    assert metrics.f1_score(scored.where("label = 0 AND pred = 0")).first().f1 == 0.0


def test_batch_metrics(spark, rows):
    df = spark.createDataFrame([(0, 1, 1), (0, 0, 1), (1, 0, 0)], "batch_id int, label int, pred int")
    assert rows(metrics.batch_metrics(df)) == [(0, 2, 1, 0.5, pytest.approx(2 / 3)), (1, 1, 1, 1.0, 0.0)]


def test_cross_entropy(spark):
    df = spark.createDataFrame([(1, 0.8, 0.25), (0, 0.4, 0.75), (1, 0.0, 0.25)], "label int, score double, weight double")
    losses = [-math.log(0.8), -math.log(0.6), -math.log(1e-12)]
    expected = (0.25 * losses[0] + 0.75 * losses[1] + 0.25 * losses[2]) / 1.25
    assert metrics.cross_entropy(df).first().loss == pytest.approx(expected)


def test_weights(spark, rows):
    df = spark.createDataFrame([(1,), (1,), (1,), (0,)], "labels int")
    assert rows(statistics.class_weights(df)) == [(0, 0.75), (1, 0.25)]
    assert rows(statistics.with_row_weights(df)) == [(0, 0.75), (1, 0.25), (1, 0.25), (1, 0.25)]


def test_outcome_pivot_and_gap(spark, rows):
    data = [("a", "Correct")] * 9 + [("a", "Incorrect")] * 3 + [("b", "Correct")] * 5 + [(None, "Correct")]
    df = spark.createDataFrame(data, "uspc_class string, Prediction string")
    assert rows(statistics.outcome_pivot(df, "uspc_class")) == [("a", 9, 3), ("b", 5, 0)]
    unfilled = {r.uspc_class: r.Incorrect for r in statistics.outcome_pivot(df, "uspc_class", fill=False).collect()}
    assert unfilled == {"a": 3, "b": None}
    assert rows(statistics.outcome_gap(df, "uspc_class")) == [("a", 9, 3, 6)]  # a gap of 5 is not enough
    one_sided = df.where("Prediction = 'Correct'")
    assert rows(statistics.outcome_gap(one_sided, "uspc_class")) == [("a", 9, 0, 9)]


def test_sinks(spark, tmp_path, rows, scored):
    predictions = spark.createDataFrame([("1", True), ("2", False), ("3", True)], "application_number string, correct boolean")
    path = str(tmp_path / "predictions")
    sinks.write_predictions(predictions, path)
    assert rows(sinks.read_predictions(spark, path)) == rows(predictions)

    log = str(tmp_path / "metrics")
    for step in (1, 2):
        sinks.append_metrics(sinks.metrics_report({"val/": metrics.accuracy(scored)}, "r", step), log)
    assert rows(sinks.read_metrics(spark, log))[0] == ("r", "val/accuracy", 1, 0.6)
    assert sinks.read_metrics(spark, log).count() == 6

    parts = spark.createDataFrame([("1", "train"), ("2", "validation")], "application_number string, split string")
    sinks.materialise_splits(parts, str(tmp_path / "splits"))
    assert rows(spark.read.parquet(str(tmp_path / "splits"))) == rows(parts)

    batched = sinks.assign_batches(spark.range(100).selectExpr("cast(id AS string) AS application_number"), 8)
    sinks.write_batches(batched, str(tmp_path / "batches"))
    back = spark.read.parquet(str(tmp_path / "batches")).selectExpr("*", "_metadata.file_path AS file")
    assert back.count() == 100 and back.groupBy("batch_id").agg({"file": "count"}).where("batch_id < 12 AND `count(file)` <> 8").count() == 0
    assert back.select("batch_id", "file").distinct().count() == 13  # one file per batch
