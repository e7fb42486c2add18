"""Baseline text models as Spark jobs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.operators.encoding import slot, slotted
from labelmill.operators.vocabulary import lookup_side

# Class order; the first class wins no tie, ties go to the smaller label.
CLASSES = (1, 0)

_ABOUT = "kind string, vocab_size int, classes array<int>"


@dataclass(frozen=True)
class NaiveBayes:
    """``weights``: one row per vocabulary token with a log weight per class, ``w_<class>``.
    ``bias``: one row with ``b_<class>``. Both are lazy plans until something scores with them."""

    kind: str
    vocab_size: int
    weights: DataFrame
    bias: DataFrame
    classes: tuple[int, ...] = CLASSES

    def save(self, path: str) -> None:
        """Weights (with their tokens), bias, and last what the model is: without that, a folder is no model."""
        self.weights.write.parquet(f"{path}/weights")
        self.bias.write.parquet(f"{path}/bias")
        about = [(self.kind, self.vocab_size, list(self.classes))]
        self.bias.sparkSession.createDataFrame(about, _ABOUT).coalesce(1).write.parquet(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> NaiveBayes:
        about = spark.read.schema(_ABOUT).parquet(f"{path}/about").first()
        weights, bias = spark.read.parquet(f"{path}/weights"), spark.read.parquet(f"{path}/bias")
        return NaiveBayes(about.kind, about.vocab_size, weights, bias, tuple(about.classes))


def _events(tokens: Column, kind: str) -> Column:
    """Multinomial counts occurrences, Bernoulli presence."""
    if kind not in ("multinomial", "bernoulli"):
        raise ValueError(f"unknown kind of naive Bayes: {kind!r}")
    return F.array_distinct(tokens) if kind == "bernoulli" else tokens


def train_naive_bayes(
    df: DataFrame,
    tokens: Column,
    vocabulary: DataFrame,
    kind: str = "bernoulli",
    label: str = "labels",
    alpha: float = 1.0,
    vocab_size: int = 10_000,
    classes: tuple[int, ...] = CLASSES,
) -> NaiveBayes:
    """Smoothed token weights and unsmoothed class priors.

    Tokens outside the vocabulary are ignored. The exploded tokens meet the vocabulary inside
    their task and leave it as at most ``vocab_size`` partial counts.
    """
    entries = vocabulary.where("n > 0").select("token")
    events = df.select(label, F.explode(_events(tokens, kind)).alias("token"))
    counts = (
        events.join(lookup_side(entries, vocab_size), "token")
        .groupBy("token")
        .agg(*(F.count_if(F.col(label) == c).alias(f"n_{c}") for c in classes))
    )
    size = F.count("*").cast("double")
    rows = df.agg(
        *(F.count_if(F.col(label) == c).cast("double").alias(f"rows_{c}") for c in classes), size.alias("rows")
    )
    known = rows.select(F.struct("*")).scalar()
    # a class without rows has no logarithm and can never win
    never = F.lit(float("-inf"))
    prior = {c: F.coalesce(F.log(F.col("known")[f"rows_{c}"] / F.col("known")["rows"]), never) for c in classes}
    if kind == "multinomial":
        sums = counts.agg(*(F.sum(f"n_{c}").alias(f"n_{c}") for c in classes), size.alias("entries"))
        totals = sums.select(F.struct("*")).scalar()
        weights = counts.withColumn("totals", totals).select(
            "token",
            *(
                F.log((F.col(f"n_{c}") + alpha) / (F.col("totals")[f"n_{c}"] + alpha * F.col("totals")["entries"])).alias(f"w_{c}")
                for c in classes
            ),
        )
        bias = rows.select(F.struct("*").alias("known")).select(*(prior[c].alias(f"b_{c}") for c in classes))
        return NaiveBayes(kind, vocab_size, weights, bias, classes)

    present = counts.withColumn("known", known).select(
        "token", "known", *(((F.col(f"n_{c}") + alpha) / (F.col("known")[f"rows_{c}"] + 2 * alpha)).alias(f"p_{c}") for c in classes)
    )
    weights = present.select("token", *((F.log(f"p_{c}") - F.log(1 - F.col(f"p_{c}"))).alias(f"w_{c}") for c in classes))
    absent = present.agg(*(F.sum(F.log(1 - F.col(f"p_{c}"))).alias(f"absent_{c}") for c in classes))
    bias = absent.withColumn("known", known).select(*((prior[c] + F.coalesce(F.col(f"absent_{c}"), F.lit(0.0))).alias(f"b_{c}") for c in classes))
    return NaiveBayes(kind, vocab_size, weights, bias, classes)


def score_naive_bayes(
    df: DataFrame,
    model: NaiveBayes,
    tokens: Column,
    keys: list[str],
    classes: tuple[int, ...] | None = None,
) -> DataFrame:
    """``keys`` with the log score of each class, ``score_<class>``, and the probability of class 1.

    All tokens of a document are in one task, which already sums them up: what shuffles is one
    row per document. Documents without a known token keep the class bias.
    """
    classes = model.classes if classes is None else classes
    events = df.select(*keys, F.explode_outer(_events(tokens, model.kind)).alias("token"))
    matched = events.join(lookup_side(model.weights, model.vocab_size), "token", "left")
    sums = matched.groupBy(*keys).agg(*(F.coalesce(F.sum(f"w_{c}"), F.lit(0.0)).alias(f"sum_{c}") for c in classes))
    bias = model.bias.select(F.struct("*")).scalar()
    scored = sums.withColumn("bias", bias).select(
        *keys, *((F.col(f"sum_{c}") + F.col("bias")[f"b_{c}"]).alias(f"score_{c}") for c in classes)
    )
    return _with_probability(scored, classes)


def _with_probability(scored: DataFrame, classes: tuple[int, ...]) -> DataFrame:
    if set(classes) != {0, 1}:
        return scored
    gap = F.greatest(F.least(F.col("score_0") - F.col("score_1"), F.lit(700.0)), F.lit(-700.0))
    return scored.withColumn("probability", 1 / (1 + F.exp(gap)))


def score_in_place(df: DataFrame, model: NaiveBayes, tokens: Column) -> DataFrame:
    """``df`` with ``score_<class>`` and, for two classes, ``probability``; columns and repeated rows stay as they are.

    The weights (bounded by the vocabulary's size) travel as one value, so no row moves and no token is a hot key. Null tokens
    and null arrays count as unknown.
    """
    names = [f"w_{c}" for c in model.classes]
    entries = model.weights.select("token", F.array(*(F.col(name).cast("double") for name in names)).alias("weights"))
    slots = 2 * model.vocab_size
    events = F.coalesce(_events(tokens, model.kind), F.array().cast("array<string>"))
    start = F.array(*(F.col("_bias")[f"b_{c}"] for c in model.classes))

    def added(total: Column, token: Column) -> Column:
        found = F.get("_known", slot(token, slots))[token]
        return F.when(found.isNull(), total).otherwise(F.zip_with(total, found, lambda a, b: a + b))

    known = df.withColumns({"_known": slotted(entries, slots, "weights"), "_bias": model.bias.select(F.struct("*")).scalar()})
    scored = known.withColumn("_scores", F.aggregate(events, start, added))
    columns = {f"score_{c}": F.get("_scores", F.lit(i)) for i, c in enumerate(model.classes)}
    return _with_probability(scored.withColumns(columns).drop("_known", "_bias", "_scores"), model.classes)


def argmax(df: DataFrame, classes: tuple[int, ...] = CLASSES) -> DataFrame:
    """Add ``pred``, the class with the largest ``score_<class>``; the smaller class wins a tie."""
    candidates = [F.struct(F.col(f"score_{c}").alias("score"), F.lit(-c).alias("negated")) for c in classes]
    return df.withColumn("pred", (-F.greatest(*candidates)["negated"]).cast("int"))


def train_linear(
    df: DataFrame,
    tokens: Column,
    label: str = "labels",
    vocab_size: int = 10_000,
    min_documents: int = 3,
    weight: str | None = None,
    iterations: int = 20,
    regularisation: float = 1e-4,
    tolerance: float = 1e-6,
    standardise: bool = True,
    vocabulary: list[str] | None = None,
) -> PipelineModel:
    """Linear bag-of-words model: one weight per token, summed over the text.

    Fitting is an action. The driver holds the bounded vocabulary and one vector of its size. A given ``vocabulary`` stands in
    for the most frequent tokens.
    """
    if vocabulary is None:
        counter = CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=vocab_size, minDF=min_documents)
    else:
        counter = CountVectorizerModel.from_vocabulary(vocabulary, "tokens", "features")
    columns = {"weightCol": weight} if weight else {}
    fitter = LogisticRegression(
        featuresCol="features", labelCol="label", maxIter=iterations, regParam=regularisation, tol=tolerance, standardization=standardise, **columns
    )
    training = df.select(F.col(label).cast("double").alias("label"), tokens.alias("tokens"), *([weight] if weight else []))
    return Pipeline(stages=[counter, fitter]).fit(training)


def score_linear(df: DataFrame, model: PipelineModel, tokens: Column, keys: list[str]) -> DataFrame:
    scored = model.transform(df.select(*keys, tokens.alias("tokens")))
    return scored.select(*keys, vector_to_array("probability")[1].alias("probability"), F.col("prediction").cast("int").alias("pred"))


def first_order(df: DataFrame, model: PipelineModel, tokens: Column, label: str = "labels", weight: str | None = None) -> DataFrame:
    """How far a linear model (fitted without standardising) is from its optimum: ``(token, positive, gradient)``.

    At the optimum the derivative of the mean weighted loss plus penalty is 0 for every token, and for the offset, which comes as
    the null token. ``positive`` counts the token in rows of class 1. The gradient is summed up where the tokens are.
    """
    spark = df.sparkSession
    counter, fitted = model.stages
    rows = df.select(F.col(label).cast("double").alias("label"), tokens.alias("tokens"), (F.col(weight) if weight else F.lit(1.0)).alias("weight"))
    scored = model.transform(rows).select("tokens", "label", "weight", (F.col("weight") * (vector_to_array("probability")[1] - F.col("label"))).alias("off"))
    total = scored.agg(F.sum("weight")).scalar()
    weights = fitted.coefficients.toArray().tolist()
    # as many rows as the vocabulary has entries
    entries = spark.createDataFrame(list(zip(counter.vocabulary, weights, strict=True)), "token string, theta double")
    hits = scored.select(F.explode("tokens").alias("token"), "off", "label").groupBy("token").agg(F.sum("off").alias("off"), F.count_if(F.col("label") == 1).alias("positive"))
    penalty = fitted.getRegParam()
    by_token = entries.join(hits, "token").select("token", "positive", (F.col("off") / total + penalty * F.col("theta")).alias("gradient"))
    offset = scored.agg(F.lit(None).cast("string").alias("token"), F.count_if(F.col("label") == 1).alias("positive"), (F.sum("off") / F.sum("weight")).alias("gradient"))
    return by_token.unionByName(offset)


_LOADED: dict[str, Callable] = {}


def loaded(name: str, load: Callable[[], Callable]) -> Callable:
    """The model of this name in this process; a worker process serves many tasks and keeps one model."""
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = load()
    return _LOADED[name]


def score_external(
    df: DataFrame, load: Callable[[], Callable], keys: list[str], text: str = "text", files: tuple[str, ...] = (), profile: ResourceProfile | None = None
) -> DataFrame:
    """Score with any model from outside Spark.

    ``load`` returns a function from a pandas Series of texts to a list of score lists, one score per class; the first of equal scores
    wins. It runs once per worker process, not per task, as long as that process scores with no other model. ``files`` are
    shipped to every executor once and found there by ``SparkFiles.get``. ``profile`` gives the stage its own resources.
    """
    columns = df.select(*keys, text)
    for path in files:
        df.sparkSession.sparkContext.addFile(path)
    name = hashlib.sha256(cloudpickle.dumps((load, files))).hexdigest()

    def score(batches: Iterator):
        from labelmill.operators import models

        model = models.loaded(name, load)
        for batch in batches:
            out = batch[keys].copy()
            out["scores"] = [list(map(float, row)) for row in model(batch[text])]
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.select(*keys).schema) + ", scores array<double>"
    scored = columns.mapInPandas(score, schema, profile=profile)
    return scored.withColumn("pred", (F.array_position("scores", F.array_max("scores")) - 1).cast("int"))
