"""Queries: splits, sampling, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmill.operators import metrics, sinks, splits, statistics
from labelmill.operators import predictions as outcome
from labelmill.operators.commits import stage
from labelmill.plans import bindings as b
from labelmill.plans.registry import query
from labelmill.plans.views import hash_split, key, sql
from labelmill.session import scratch_path

_KEY = key("application_number")


@query(
    "split_uniform",
    sql(
        f"""SELECT application_number, CASE WHEN row_number() OVER (ORDER BY {_KEY}) <= floor(count(*) OVER () * 0.85::DOUBLE)
 THEN 'train' ELSE 'validation' END AS split FROM filings WHERE filing_date >= TIMESTAMP '1995-06-01'""",
        "filings",
    ),
)
def split_uniform(spark, folder):
    return splits.uniform_split(b.filings(spark, folder), start="1995-06-01").select("application_number", "split")


@query("split_hash", sql(f"SELECT application_number, {hash_split('application_number')} AS split FROM filings", "filings"))
def split_hash(spark, folder):
    return splits.hash_split(b.filings(spark, folder)).select("application_number", "split")


# train and validation overlap on purpose
_WINDOWS = ("1995-01-01", "1998-07-01", "1998-01-01", "2000-01-01")


@query(
    "split_by_date",
    sql(
        """SELECT application_number, 'train' AS split FROM filings WHERE filing_date >= TIMESTAMP '1995-01-01' AND filing_date < TIMESTAMP '1998-07-01'
 UNION ALL SELECT application_number, 'validation' FROM filings WHERE filing_date >= TIMESTAMP '1998-01-01' AND filing_date < TIMESTAMP '2000-01-01'""",
        "filings",
    ),
)
def split_by_date(spark, folder):
    return splits.date_split(b.filings(spark, folder), *_WINDOWS).select("application_number", "split")


@query(
    "balance_classes",
    sql(
        f"""SELECT application_number, decision FROM filings WHERE decision IN ('ACCEPTED', 'REJECTED')
 QUALIFY row_number() OVER (PARTITION BY decision ORDER BY {_KEY}) <= (SELECT least(count(*) FILTER (decision = 'ACCEPTED'), count(*) FILTER (decision = 'REJECTED')) FROM filings)""",
        "filings",
    ),
)
def balance_classes(spark, folder):
    return splits.balance_classes(b.filings(spark, folder)).select("application_number", "decision")


@query(
    "head_per_class",
    sql(
        """SELECT application_number, CAST(labels AS INTEGER) AS labels FROM decided
 QUALIFY row_number() OVER (PARTITION BY labels ORDER BY CAST(application_number AS BIGINT)) <= 500""",
        "decided",
    ),
)
def head_per_class(spark, folder):
    return splits.head_per_class(b.decided_filings(spark, folder)).select("application_number", "labels")


@query(
    "seeded_shuffle",
    sql(f"SELECT application_number, row_number() OVER (ORDER BY {_KEY}) - 1 AS position FROM filings", "filings"),
)
def seeded_shuffle(spark, folder):
    return splits.seeded_shuffle(b.filings(spark, folder)).select("application_number", "position")


@query(
    "weighted_sample",
    sql(
        f"""SELECT application_number, CAST(labels AS INTEGER) AS labels, round(sample_key, 6) AS sample_key FROM (
 SELECT application_number, labels, -ln((('0x' || substr({_KEY}, 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
 * n / min(n) OVER () AS sample_key FROM decided JOIN (SELECT labels, count(*) AS n FROM decided GROUP BY labels) USING (labels))
 ORDER BY sample_key LIMIT 2000""",
        "decided",
    ),
)
def weighted_sample(spark, folder):
    drawn = splits.weighted_sample(b.decided_filings(spark, folder), 2000)
    return drawn.select("application_number", "labels", F.round("sample_key", 6).alias("sample_key"))


@query(
    "assign_batches",
    sql(
        f"""SELECT application_number, p AS position, CAST(floor(p / 64) AS BIGINT) AS batch_id
 FROM (SELECT application_number, row_number() OVER (ORDER BY {_KEY}) - 1 AS p FROM decided)""",
        "decided",
    ),
)
def assign_batches(spark, folder):
    return sinks.assign_batches(b.decided_filings(spark, folder), 64).select("application_number", "position", "batch_id")


@query(
    "step_budget",
    sql("SELECT count(*) AS rows, CAST(floor(count(*) / 64) AS BIGINT) AS max_steps FROM decided", "decided"),
)
def step_budget(spark, folder):
    return sinks.step_budget(b.decided_filings(spark, folder), batch=8, accumulation=8)


@query(
    "write_predictions",
    sql("SELECT correct, count(*) AS n, CAST(sum(CAST(application_number AS BIGINT)) AS BIGINT) AS id_sum FROM predictions GROUP BY correct", "predictions"),
)
def write_predictions(spark, folder):
    path = scratch_path(spark, "predictions")
    sinks.write_predictions(b.predictions(spark, folder), path)
    return sinks.read_predictions(spark, path).groupBy("correct").agg(
        F.count("*").alias("n"), F.sum(F.col("application_number").cast("long")).alias("id_sum")
    )


_F1 = "CASE WHEN 2 * count(*) FILTER (label = 1 AND pred = 1) + count(*) FILTER (label <> pred) = 0 THEN 0.0 ELSE 2.0 * count(*) FILTER (label = 1 AND pred = 1) / (2 * count(*) FILTER (label = 1 AND pred = 1) + count(*) FILTER (label <> pred)) END"


@query(
    "metrics_report",
    sql(
        f"""SELECT 'price_rule' AS run_id, tag, 1::BIGINT AS step, round(value, 6) AS value FROM (
 SELECT 'val/n' AS tag, count(*)::DOUBLE AS value FROM predictions
 UNION ALL SELECT 'val/correct', (count(*) FILTER (label = pred))::DOUBLE FROM predictions
 UNION ALL SELECT 'val/accuracy', avg((label = pred)::INTEGER) FROM predictions
 UNION ALL SELECT 'val/tp', (count(*) FILTER (label = 1 AND pred = 1))::DOUBLE FROM predictions
 UNION ALL SELECT 'val/fp', (count(*) FILTER (label = 0 AND pred = 1))::DOUBLE FROM predictions
 UNION ALL SELECT 'val/fn', (count(*) FILTER (label = 1 AND pred = 0))::DOUBLE FROM predictions
 UNION ALL SELECT 'val/f1', ({_F1})::DOUBLE FROM predictions
 UNION ALL SELECT 'val/loss', sum(w * -ln(CASE label WHEN 1 THEN p ELSE 1 - p END)) / sum(w) FROM (
  SELECT label, least(greatest(score, 1e-12), 1 - 1e-12) AS p,
   CASE label WHEN 1 THEN 1 - (SELECT avg(label) FROM predictions) ELSE (SELECT avg(label) FROM predictions) END AS w FROM predictions)
 UNION ALL SELECT 'val/auprc', sum(pos * cp / cn) / sum(pos) FROM (
  SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn FROM (
   SELECT score, sum(label) AS pos, count(*) AS n FROM predictions GROUP BY score)))""",
        "predictions",
    ),
)
def metrics_report(spark, folder):
    scored = b.predictions(spark, folder)
    path = scratch_path(spark, "metrics")
    report = sinks.metrics_report({"val/": metrics.accuracy(scored)}, "price_rule", 1)
    sinks.append_metrics(report, path)
    # the cells of the confusion matrix that F1 uses; the fourth is n less these
    sinks.append_metrics(sinks.metrics_report({"val/": metrics.f1_score(scored)}, "price_rule", 1), path)
    loss = metrics.cross_entropy(statistics.with_row_weights(scored, "label")).select("loss")
    sinks.append_metrics(sinks.metrics_report({"val/": loss}, "price_rule", 1), path)
    sinks.append_metrics(sinks.metrics_report({"val/": metrics.average_precision(scored).select("auprc")}, "price_rule", 1), path)
    return sinks.read_metrics(spark, path).withColumn("value", F.round("value", 6))


@query(
    "metrics_rewritten",
    sql(
        """SELECT 'price_rule' AS run_id, tag, step, round(value, 6) AS value FROM (
 SELECT 'val/n' AS tag, s AS step, count(*)::DOUBLE AS value FROM predictions, range(1, 3) AS r(s) GROUP BY s
 UNION ALL SELECT 'val/correct', s, (count(*) FILTER (label = pred))::DOUBLE FROM predictions, range(1, 3) AS r(s) GROUP BY s
 UNION ALL SELECT 'val/accuracy', s, avg((label = pred)::INTEGER) FROM predictions, range(1, 3) AS r(s) GROUP BY s)""",
        "predictions",
    ),
)
def metrics_rewritten(spark, folder):
    """A step written twice counts once, with its last values; a writer that dies before it commits is not seen."""
    scored = b.predictions(spark, folder)
    path = scratch_path(spark, "metrics")

    def report(rows, step):
        return sinks.metrics_report({"val/": metrics.accuracy(rows)}, "price_rule", step)

    sinks.append_metrics(report(scored.where("NOT correct"), 1), path)
    sinks.append_metrics(report(scored, 2), path)
    sinks.append_metrics(report(scored, 1), path)
    stage(report(scored, 3), path)
    return sinks.read_metrics(spark, path).withColumn("value", F.round("value", 6))


@query(
    "export_metadata",
    sql("SELECT application_number, examiner_full_name, uspc_class, uspc_subclass, decision, Prediction FROM outcomes", "outcomes"),
)
def export_metadata(spark, folder):
    path = scratch_path(spark, "export")
    columns = ["application_number", "examiner_full_name", "uspc_class", "uspc_subclass", "decision", "Prediction"]
    tagged = outcome.with_outcome(b.classified_filings(spark, folder), b.predictions(spark, folder))
    sinks.export_csv(tagged.select(*columns), path)
    return spark.read.schema(", ".join(f"{c} string" for c in columns)).csv(path, header=True, escape='"')


@query(
    "materialise_splits",
    sql(
        """SELECT split, decision, count(*) AS n, CAST(sum(CAST(application_number AS BIGINT)) AS BIGINT) AS id_sum FROM (
 SELECT *, 'train' AS split FROM filings WHERE filing_date >= TIMESTAMP '1995-01-01' AND filing_date < TIMESTAMP '1998-07-01'
 UNION ALL SELECT *, 'validation' FROM filings WHERE filing_date >= TIMESTAMP '1998-01-01' AND filing_date < TIMESTAMP '2000-01-01')
 GROUP BY split, decision""",
        "filings",
    ),
)
def materialise_splits(spark, folder):
    path = scratch_path(spark, "splits")
    sinks.materialise_splits(splits.date_split(b.filings(spark, folder), *_WINDOWS), path)
    return spark.read.parquet(path).groupBy("split", "decision").agg(
        F.count("*").alias("n"), F.sum(F.col("application_number").cast("long")).alias("id_sum")
    )
