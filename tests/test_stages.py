"""Saved models, models from outside Spark, and the optimum of the linear model."""

import os

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from labelmill.functions import words_of
from labelmill.operators import models
from labelmill.operators.examples import reshaped
from labelmill.operators.stages import TextBayes
from labelmill.operators.vocabulary import build_vocabulary

ROWS = [("good fine good", 1), ("bad awful", 0), ("fine fine bad", 1), ("awful awful good", 0), ("good", 1), (None, 0), ("", 1)]


@pytest.fixture(scope="module")
def train(spark):
    table = spark.createDataFrame([(str(i), t, y) for i, (t, y) in enumerate(ROWS * 3)], "application_number string, text string, labels int")
    return table.withColumn("tokens", words_of("text"))


@pytest.mark.parametrize("kind", ["multinomial", "bernoulli"])
def test_saved_stage_knows_what_it_is(spark, train, tmp_path, kind):
    fitted = Pipeline(stages=[TextBayes(kind=kind, min_frequency=1, vocab_size=50, classes=(1, 0))]).fit(train)
    fitted.save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    stage = loaded.stages[0]
    assert (stage.fitted.kind, stage.fitted.vocab_size, stage.fitted.classes, stage.getOrDefault("kind")) == (kind, 50, (1, 0), kind)
    twice = train.unionByName(train)
    got, before = (sorted(map(repr, map(tuple, m.transform(twice).select("text", "score_1", "score_0", "probability", "pred").collect()))) for m in (loaded, fitted))
    assert got == before and len(got) == 2 * train.count()
    # the same scores as the other way of scoring
    model = models.train_naive_bayes(train, F.col("tokens"), build_vocabulary(train, F.col("tokens"), 50, 1), kind, vocab_size=50)
    other = {r.application_number: r for r in models.score_naive_bayes(train, model, F.col("tokens"), ["application_number"]).collect()}
    for r in loaded.transform(train).collect():
        assert r.score_1 == pytest.approx(other[r.application_number].score_1) and r.probability == pytest.approx(other[r.application_number].probability)
    assert loaded.transform(train).columns == [*train.columns, "score_1", "score_0", "probability", "pred"]


def test_an_external_model_is_loaded_once_per_process(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        open(f"{folder}/{os.getpid()}-{len(os.listdir(folder))}", "w").close()
        return lambda texts: [(len(t), 3) for t in texts]

    rows = spark.range(400).select(F.col("id").cast("string").alias("application_number"), F.lit("abcd").alias("text")).repartition(40)
    for _ in range(2):
        assert {r.pred for r in models.score_external(rows, load, ["application_number"]).collect()} == {0}
    loads = [name.split("-")[0] for name in os.listdir(folder)]
    assert len(loads) == len(set(loads)) <= 2 * spark.sparkContext.defaultParallelism < 40


def test_files_of_a_model_are_shipped(spark, tmp_path):
    (tmp_path / "weights.txt").write_text("7")

    def load():
        from pyspark import SparkFiles

        bias = int(open(SparkFiles.get("weights.txt")).read())
        return lambda texts: [(bias, len(t)) for t in texts]

    rows = spark.createDataFrame([("1", "short"), ("2", "longer than that")], "application_number string, text string")
    got = {r.application_number: r.pred for r in models.score_external(rows, load, ["application_number"], files=(str(tmp_path / "weights.txt"),)).collect()}
    assert got == {"1": 0, "2": 1}


def test_first_order_tells_an_optimum_from_a_guess(train):
    present = train.select("labels", F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>"))).alias("tokens"), F.lit(2.0).alias("weight"))
    options = {"weight": "weight", "standardise": False, "regularisation": 1e-2, "vocabulary": ["good", "bad", "fine", "awful"]}
    ends = {}
    for iterations in (1, 300):
        model = models.train_linear(present, F.col("tokens"), iterations=iterations, tolerance=1e-12, **options)
        found = models.first_order(present, model, F.col("tokens"), weight="weight").collect()
        assert {r.token: r.positive for r in found} == {"good": 6, "bad": 3, "fine": 6, "awful": 0, None: 12}
        ends[iterations] = max(abs(r.gradient) for r in found)
    assert ends[300] < 1e-6 < 1e-3 < ends[1]


def test_columns_renamed_and_dropped(spark):
    df = spark.createDataFrame([(1, "a", 2, "b")], "label int, sentence1 string, idx int, x string")
    out = reshaped(df, {"label": "labels", "x": "label"}, ("idx", "sentence1"))
    assert out.columns == ["labels", "label"] and out.first()[:] == (1, "b")
    for rename, drop in (({"no": "x"}, ()), ({}, ("no",)), ({"label": "x"}, ())):
        with pytest.raises(ValueError):
            reshaped(df, rename, drop)
