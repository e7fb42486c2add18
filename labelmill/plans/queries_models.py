"""Queries: statistics, models, metrics, metric log. Doubles are rounded on both sides."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from labelmill.config import CorpusConfig
from labelmill.functions import words_of
from labelmill.operators import metrics, models, runlog, sinks, splits, statistics
from labelmill.operators import predictions as outcome
from labelmill.operators.examples import split_unknown
from labelmill.operators.filters import keep_decided
from labelmill.operators.stages import TextBayes
from labelmill.operators.vocabulary import build_vocabulary
from labelmill.plans import bindings as b
from labelmill.plans.jobs import build_examples, classify, error_breakdown
from labelmill.plans.registry import query
from labelmill.plans.views import hash_split, key, sql, words
from labelmill.session import materialise, scratch_path



@query(
    "label_stats",
    sql(
        """SELECT split, CAST(labels AS INTEGER) AS labels, count(*) AS n FROM (
 SELECT labels, 'train' AS split FROM decided WHERE filing_date >= TIMESTAMP '1995-01-01' AND filing_date < TIMESTAMP '1998-07-01'
 UNION ALL SELECT labels, 'validation' FROM decided WHERE filing_date >= TIMESTAMP '1998-07-01' AND filing_date < TIMESTAMP '2000-01-01')
 GROUP BY split, labels""",
        "decided",
    ),
)
def label_stats(spark, folder):
    known, _ = split_unknown(b.filings(spark, folder))
    parts = splits.date_split(keep_decided(known), "1995-01-01", "1998-07-01", None, "2000-01-01")
    return statistics.label_stats(parts)


@query(
    "class_weights",
    sql(
        "SELECT 1 AS labels, round(avg(1 - labels), 6) AS weight FROM decided UNION ALL SELECT 0, round(avg(labels), 6) FROM decided",
        "decided",
    ),
)
def class_weights(spark, folder):
    weights = statistics.class_weights(b.decided_filings(spark, folder))
    return weights.select("labels", F.round("weight", 6).alias("weight"))


@query(
    "row_weights",
    sql(
        """SELECT application_number, CAST(labels AS INTEGER) AS labels,
 round(CASE labels WHEN 1 THEN 1 - one ELSE one END, 6) AS weight
 FROM (SELECT *, (SELECT avg(labels) FROM decided) AS one FROM decided)""",
        "decided",
    ),
)
def row_weights(spark, folder):
    weighted = statistics.with_row_weights(b.decided_filings(spark, folder))
    return weighted.select("application_number", "labels", F.round("weight", 6).alias("weight"))


def _outcomes(spark, folder):
    return outcome.with_outcome(b.classified_filings(spark, folder), b.predictions(spark, folder))


_COUNTS = "count(*) FILTER (Prediction = 'Correct') AS Correct, count(*) FILTER (Prediction = 'Incorrect') AS Incorrect"


@query("outcome_pivot", sql(f"SELECT uspc_class, {_COUNTS} FROM outcomes GROUP BY uspc_class", "outcomes"))
def outcome_pivot(spark, folder):
    return statistics.outcome_pivot(_outcomes(spark, folder), "uspc_class")


@query(
    "outcome_gap",
    sql(
        f"""SELECT *, abs(Correct - Incorrect) AS Difference FROM (SELECT examiner_full_name, {_COUNTS} FROM outcomes GROUP BY examiner_full_name)
 WHERE abs(Correct - Incorrect) > 5""",
        "outcomes",
    ),
)
def outcome_gap(spark, folder):
    return statistics.outcome_gap(_outcomes(spark, folder), "examiner_full_name")


@query(
    "outcome_by_decision",
    sql(f"SELECT decision_as_of_2020, {_COUNTS} FROM outcomes GROUP BY decision_as_of_2020", "outcomes"),
)
def outcome_by_decision(spark, folder):
    return statistics.outcome_pivot(_outcomes(spark, folder), "decision_as_of_2020", fill=False)


_WIDE = ("uspc_class", "uspc_subclass", "examiner_full_name")


def _breakdown_sql(feature: str) -> str:
    clear = " HAVING abs(count(*) FILTER (Prediction = 'Correct') - count(*) FILTER (Prediction = 'Incorrect')) > 5" if feature in _WIDE else ""
    return f"SELECT '{feature}' AS feature, {feature} AS value, {_COUNTS} FROM outcomes GROUP BY {feature}{clear}"


@query("error_breakdown", sql(" UNION ALL ".join(map(_breakdown_sql, (*_WIDE, "decision_as_of_2020"))), "outcomes"))
def breakdown(spark, folder):
    """Outcome counts over all four features."""
    features = [*_WIDE, "decision_as_of_2020"]
    tables = error_breakdown(b.classified_filings(spark, folder), b.predictions(spark, folder), features)
    return outcome.union_all(
        [tables[name].select(F.lit(name).alias("feature"), F.col(name).alias("value"), "Correct", "Incorrect") for name in features]
    )


@query(
    "box_stats",
    sql(
        """SELECT Prediction, count(*) AS n, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
 round(whislo, 4) AS whislo, round(whishi, 4) AS whishi, count(*) FILTER (x < whislo OR x > whishi) AS outliers FROM (
 SELECT *, least(min(x) FILTER (x >= q1 - 1.5 * (q3 - q1)) OVER (PARTITION BY Prediction), q1) AS whislo,
  greatest(max(x) FILTER (x <= q3 + 1.5 * (q3 - q1)) OVER (PARTITION BY Prediction), q3) AS whishi FROM (
  SELECT Prediction, power(o_totalprice / 100000, 4) AS x, quantile_cont(power(o_totalprice / 100000, 4), 0.25) OVER (PARTITION BY Prediction) AS q1,
   quantile_cont(power(o_totalprice / 100000, 4), 0.5) OVER (PARTITION BY Prediction) AS median,
   quantile_cont(power(o_totalprice / 100000, 4), 0.75) OVER (PARTITION BY Prediction) AS q3 FROM outcomes))
 GROUP BY Prediction, q1, median, q3, whislo, whishi""",
        "outcomes",
    ),
)
def box_stats(spark, folder):
    # the fourth power skews the prices, so that there are outliers to count
    rows = _outcomes(spark, folder).withColumn("price", F.pow(F.col("o_totalprice") / 100000, 4))
    box = statistics.box_stats(rows, "price")
    rounded = [F.round(c, 4).alias(c) for c in ("q1", "median", "q3", "whislo", "whishi")]
    return box.select("Prediction", "n", *rounded, "outliers")


def _bayes_views(kind: str) -> str:
    """From the view ``labelled`` to the view ``scored``."""
    seen = f"list_distinct({words('text')})" if kind == "bernoulli" else words("text")
    if kind == "multinomial":
        weight = "ln((n{c} + 1.0::DOUBLE) / ((SELECT sum(n{c}) FROM counts) + (SELECT count(*) FROM counts)))"
        bias = "ln(d{c} / d::DOUBLE)"
    else:
        p = "((n{c} + 1.0::DOUBLE) / (d{c} + 2))"
        weight = f"ln({p}) - ln(1 - {p})"
        bias = f"ln(d{{c}} / d::DOUBLE) + (SELECT sum(ln(1 - {p})) FROM counts, sizes)"
    return f"""known AS (SELECT token FROM (SELECT unnest({words('text')}) AS token FROM labelled WHERE split = 'train') GROUP BY token
  HAVING count(*) >= 3 QUALIFY row_number() OVER (ORDER BY count(*) DESC, token) <= 9998),
 seen AS (SELECT application_number, split, labels, unnest({seen}) AS token FROM labelled),
 counts AS (SELECT token, count(*) FILTER (labels = 1) AS n1, count(*) FILTER (labels = 0) AS n0
  FROM seen JOIN known USING (token) WHERE split = 'train' GROUP BY token),
 sizes AS (SELECT count(*) AS d, count(*) FILTER (labels = 1) AS d1, count(*) FILTER (labels = 0) AS d0 FROM labelled WHERE split = 'train'),
 weights AS (SELECT token, {weight.format(c=1)} AS w1, {weight.format(c=0)} AS w0 FROM counts, sizes),
 bias AS (SELECT {bias.format(c=1)} AS b1, {bias.format(c=0)} AS b0 FROM sizes),
 scored AS (SELECT *, CASE WHEN score_1 > score_0 THEN 1 ELSE 0 END AS pred FROM (
  SELECT l.application_number, l.split, l.labels, coalesce(sum(w1), 0) + (SELECT b1 FROM bias) AS score_1,
   coalesce(sum(w0), 0) + (SELECT b0 FROM bias) AS score_0
  FROM labelled l LEFT JOIN seen s ON s.application_number = l.application_number AND s.split = l.split
  LEFT JOIN weights USING (token) GROUP BY l.application_number, l.split, l.labels))"""


def _bayes_sql(kind: str) -> str:
    return sql(
        "SELECT application_number, split, labels, round(score_1, 3) AS score_1, round(score_0, 3) AS score_0, pred FROM scored",
        "labelled",
        extra=_bayes_views(kind),
    )


def _tokenised(spark, folder):
    """Labelled documents as tokens, written once: vocabulary, training and scoring all read them."""
    return materialise(
        b.labelled_texts(spark, folder).select("application_number", "split", "labels", words_of("text").alias("tokens")),
        "tokens",
    )


def _bayes(spark, folder, kind):
    rows, words = _tokenised(spark, folder), F.col("tokens")
    train = rows.where("split = 'train'")
    model = models.train_naive_bayes(train, words, build_vocabulary(train, words), kind)
    return models.argmax(models.score_naive_bayes(rows, model, words, ["application_number", "split", "labels"]))


def _bayes_output(scored):
    rounded = [F.round(c, 3).alias(c) for c in ("score_1", "score_0")]
    return scored.select("application_number", "split", "labels", *rounded, "pred")


@query("nb_multinomial", _bayes_sql("multinomial"))
def nb_multinomial(spark, folder):
    return _bayes_output(_bayes(spark, folder, "multinomial"))


@query("nb_bernoulli", _bayes_sql("bernoulli"))
def nb_bernoulli(spark, folder):
    return _bayes_output(_bayes(spark, folder, "bernoulli"))


_EVALUATION = CorpusConfig(
    years=tuple(range(1995, 2002)),
    train_start="1995-01-01",
    train_end="2000-01-01",
    val_end="2002-01-01",
    balance_validation=True,
)

_EXAMPLES_SQL = f"""parted AS (SELECT *, 'train' AS split FROM joined WHERE filing_date >= TIMESTAMP '1995-01-01' AND filing_date < TIMESTAMP '2000-01-01'
 UNION ALL SELECT *, 'validation' FROM joined WHERE filing_date >= TIMESTAMP '2000-01-01' AND filing_date < TIMESTAMP '2002-01-01'),
 ranked AS (SELECT application_number, split, doc_decision, claims AS text,
  row_number() OVER (PARTITION BY split, doc_decision ORDER BY {key('application_number')}) AS place FROM parted WHERE found),
 labelled AS (SELECT application_number, split, text, CASE doc_decision WHEN 'ACCEPTED' THEN 1 ELSE 0 END AS labels FROM ranked
  WHERE doc_decision IN ('ACCEPTED', 'REJECTED') AND (split = 'train' OR place <= (SELECT least(count(*) FILTER (doc_decision = 'ACCEPTED'),
   count(*) FILTER (doc_decision = 'REJECTED')) FROM ranked WHERE split = 'validation')))"""


@query(
    "corpus_evaluation",
    sql(
        """SELECT split, n, correct, round(correct / n, 6) AS accuracy, tp, fp, fn,
 round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 6)::DOUBLE AS f1 FROM (
 SELECT split, count(*) AS n, count(*) FILTER (labels = pred) AS correct, count(*) FILTER (labels = 1 AND pred = 1) AS tp,
  count(*) FILTER (labels = 0 AND pred = 1) AS fp, count(*) FILTER (labels = 1 AND pred = 0) AS fn FROM scored GROUP BY split)""",
        "joined",
        extra=f"{_EXAMPLES_SQL}, {_bayes_views('multinomial')}",
    ),
)
def corpus_evaluation(spark, folder):
    """The whole way from metadata to metrics per split."""
    examples = build_examples(b.filings(spark, folder), b.application_documents(spark, folder), _EVALUATION)
    rows = metrics.evaluate(classify(examples, _EVALUATION), ("split",))
    return rows.withColumns({"accuracy": F.round("accuracy", 6), "f1": F.round("f1", 6)})


@query("logreg_bow")
def logreg_bow(spark, folder):
    rows, words = _tokenised(spark, folder), F.col("tokens")
    train = statistics.with_row_weights(rows.where("split = 'train'"))
    model = models.train_linear(train, words, weight="weight")
    return models.score_linear(rows, model, words, ["application_number", "split", "labels"])


@query(
    "logreg_optimum",
    sql(
        f"""SELECT token, count(*) FILTER (labels = 1) AS positive, true AS met FROM seen JOIN kept USING (token) GROUP BY token
 UNION ALL SELECT NULL, count(*) FILTER (labels = 1), true FROM labelled WHERE split = 'train'""",
        "labelled",
        extra=f"""seen AS (SELECT labels, unnest(list_distinct({words('text')})) AS token FROM labelled WHERE split = 'train'),
 kept AS (SELECT token FROM seen GROUP BY token HAVING count(*) >= 3 QUALIFY row_number() OVER (ORDER BY count(*) DESC, token) <= 200)""",
    ),
)
def logreg_optimum(spark, folder):
    """The linear model, on the presence of tokens, meets the condition of first order for each of them and for its offset."""
    rows, present = _tokenised(spark, folder), F.array_distinct("tokens")
    train = materialise(statistics.with_row_weights(rows.where("split = 'train'")).select("labels", "weight", present.alias("tokens")), "present")
    # at most 200 entries
    entries = [row.token for row in build_vocabulary(train, F.col("tokens"), size=202).where("n > 0").collect()]
    options = {"iterations": 500, "regularisation": 1e-2, "tolerance": 1e-10, "standardise": False, "vocabulary": entries}
    model = models.train_linear(train, F.col("tokens"), weight="weight", **options)
    found = models.first_order(train, model, F.col("tokens"), weight="weight")
    return found.select("token", "positive", (F.abs("gradient") <= 1e-4).alias("met"))


@query("nb_saved", _bayes_sql("bernoulli"))
def nb_saved(spark, folder):
    """A pipeline with a naive Bayes stage, saved, loaded and applied."""
    rows, path = _tokenised(spark, folder), scratch_path(spark, "pipeline-model")
    Pipeline(stages=[TextBayes(kind="bernoulli")]).fit(rows.where("split = 'train'")).save(path)
    return _bayes_output(PipelineModel.load(path).transform(rows))


def _letter_scores():
    """A stand-in for an external model: class scores are the counts of ``a`` and of ``e``."""
    return lambda texts: [(text.count("a"), text.count("e")) for text in texts]


@query(
    "score_argmax",
    sql(
        """SELECT application_number, a AS score_0, e AS score_1, CASE WHEN e > a THEN 1 ELSE 0 END AS pred FROM (
 SELECT application_number, (length(text) - length(replace(text, 'a', '')))::DOUBLE AS a,
  (length(text) - length(replace(text, 'e', '')))::DOUBLE AS e FROM texts)""",
        "texts",
    ),
)
def score_argmax(spark, folder):
    scored = models.score_external(b.texts(spark, folder), _letter_scores, ["application_number"])
    return scored.select(
        "application_number", F.col("scores")[0].alias("score_0"), F.col("scores")[1].alias("score_1"), "pred"
    )


@query(
    "accuracy",
    sql("SELECT count(*) AS n, count(*) FILTER (correct) AS correct, round(avg(correct::INTEGER), 6) AS accuracy FROM predictions", "predictions"),
)
def accuracy(spark, folder):
    return metrics.accuracy(b.predictions(spark, folder)).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "confusion_matrix",
    sql(
        """SELECT l.v AS label, p.v AS pred, count(application_number) AS n FROM (VALUES (1), (0)) l(v) CROSS JOIN (VALUES (1), (0)) p(v)
 LEFT JOIN predictions x ON x.label = l.v AND x.pred = p.v GROUP BY l.v, p.v""",
        "predictions",
    ),
)
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(b.predictions(spark, folder))


_CELLS = "count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 1 AND pred = 0) AS fn"


@query(
    "f1_score",
    sql(f"SELECT tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6)::DOUBLE AS f1 FROM (SELECT {_CELLS} FROM predictions)", "predictions"),
)
def f1_score(spark, folder):
    return metrics.f1_score(b.predictions(spark, folder)).withColumn("f1", F.round("f1", 6))


@query(
    "batch_metrics",
    sql(
        f"""SELECT batch_id, n, correct, round(correct / n, 6) AS accuracy,
 round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 6)::DOUBLE AS f1 FROM (
 SELECT batch_id, count(*) AS n, count(*) FILTER (correct) AS correct, {_CELLS} FROM (
  SELECT *, CAST(floor((row_number() OVER (ORDER BY {key('application_number')}) - 1) / 32) AS BIGINT) AS batch_id FROM predictions) GROUP BY batch_id)""",
        "predictions",
    ),
)
def batch_metrics(spark, folder):
    batches = metrics.batch_metrics(sinks.assign_batches(b.predictions(spark, folder), 32))
    return batches.select("batch_id", "n", "correct", F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1"))


@query(
    "auprc",
    sql(
        """SELECT CAST(sum(pos) AS BIGINT) AS positives, round(sum(pos * cp / cn) / sum(pos), 6) AS auprc FROM (
 SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn FROM (
  SELECT score, sum(label) AS pos, count(*) AS n FROM predictions GROUP BY score))""",
        "predictions",
    ),
)
def auprc(spark, folder):
    return metrics.average_precision(b.predictions(spark, folder)).withColumn("auprc", F.round("auprc", 6))


@query(
    "cross_entropy",
    sql(
        """SELECT count(*) AS n, round(sum(w * -ln(CASE label WHEN 1 THEN p ELSE 1 - p END)) / sum(w), 6) AS loss FROM (
 SELECT label, least(greatest(score, 1e-12), 1 - 1e-12) AS p,
  CASE label WHEN 1 THEN 1 - (SELECT avg(label) FROM predictions) ELSE (SELECT avg(label) FROM predictions) END AS w FROM predictions)""",
        "predictions",
    ),
)
def cross_entropy(spark, folder):
    weighted = statistics.with_row_weights(b.predictions(spark, folder), "label")
    return metrics.cross_entropy(weighted).withColumn("loss", F.round("loss", 6))


@query(
    "accuracy_vs_majority",
    sql(
        """SELECT round(acc, 6) AS accuracy, round(maj, 6) AS majority, round(acc - maj, 6) AS gain FROM (
 SELECT avg(correct::INTEGER) AS acc, greatest(avg(label), 1 - avg(label)) AS maj FROM predictions)""",
        "predictions",
    ),
)
def accuracy_vs_majority(spark, folder):
    compared = metrics.accuracy_vs_majority(b.predictions(spark, folder))
    return compared.select(*(F.round(c, 6).alias(c) for c in ("accuracy", "majority", "gain")))


RUN, ENTRY = ["run_id"], "entry"


@query(
    "running_mean",
    sql(
        """SELECT run_id, entry, i, round(sum(value) OVER (PARTITION BY run_id ORDER BY entry) / (i + 1) + 1e-9, 6) AS running_mean FROM log""",
        "log",
    ),
)
def running_mean(spark, folder):
    means = runlog.running_mean(b.metric_log(spark, folder), RUN, ENTRY)
    # values have two decimals: the small shift keeps both engines off exact rounding ties
    return means.select("run_id", "entry", "i", F.round(F.col("running_mean") + 1e-9, 6).alias("running_mean"))


@query(
    "running_mean_by_time",
    """SELECT user_id AS run_id, event_id AS entry, epoch_us(ts) AS step,
 round(avg(value) OVER (PARTITION BY user_id ORDER BY ts) + 1e-9, 6) AS running_mean FROM events""",
)
def running_mean_by_time(spark, folder):
    """Steps are event times in microseconds, far apart."""
    log = b.table(spark, folder, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("entry"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("step"),
        "value",
    )
    means = runlog.running_mean(log, RUN, "step")
    return means.select("run_id", "entry", "step", F.round(F.col("running_mean") + 1e-9, 6).alias("running_mean"))


@query(
    "best_so_far",
    sql(
        """SELECT run_id, entry, greatest(coalesce(before, 0), value) AS best, value > coalesce(before, 0) AS improved FROM (
 SELECT *, max(value) OVER (PARTITION BY run_id ORDER BY entry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM log)""",
        "log",
    ),
)
def best_so_far(spark, folder):
    return runlog.best_so_far(b.metric_log(spark, folder), RUN, ENTRY).select("run_id", "entry", "best", "improved")


@query("every_nth_step", sql("SELECT run_id, entry, i, tag, value FROM log WHERE i % 5 = 0 AND i <> 0", "log"))
def every_nth_step(spark, folder):
    return runlog.every_nth_step(b.metric_log(spark, folder), RUN, ENTRY, 5).select("run_id", "entry", "i", "tag", "value")


@query(
    "accumulation_groups",
    """SELECT run_id, epoch, CAST(floor(i / 2) AS BIGINT) AS group_id, count(*) AS n, round(sum(value), 6) AS total FROM (
 SELECT user_id AS run_id, strftime(ts, '%Y-%m-%d') AS epoch, value,
  row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY event_id) - 1 AS i FROM events)
 GROUP BY ALL HAVING count(*) = 2""",
)
def accumulation_groups(spark, folder):
    groups = runlog.accumulation_groups(b.metric_log(spark, folder), ["run_id", "epoch"], ENTRY, 2)
    return groups.withColumn("total", F.round("total", 6))
