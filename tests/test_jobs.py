import pytest
from pyspark.sql import functions as F

from labelmill.config import CorpusConfig
from labelmill.operators import metrics
from labelmill.plans.jobs import build_examples, classify, error_breakdown, full_examples
from labelmill.schemas import DOCUMENT_KEYS, EXAMPLE_COLUMNS


@pytest.fixture(scope="module")
def corpus(spark):
    metadata = spark.range(400).selectExpr(
        "cast(id AS string) AS application_number",
        "cast(date_add(date'2014-01-01', cast(id * 2 AS int)) AS timestamp_ntz) AS filing_date",
        "if(id % 4 = 0, 'REJECTED', if(id % 9 = 1, 'PENDING', 'ACCEPTED')) AS decision",
        "concat('G06', id % 2) AS main_ipcr_label",
        "'G06F' AS main_cpc_label",
        "concat('class', id % 3) AS uspc_class",
    )
    values = {key: F.concat(F.lit(f"{key} "), "application_number") for key in DOCUMENT_KEYS}
    values["decision"] = F.col("decision")
    values["claims"] = F.when(F.col("decision") == "ACCEPTED", "good new device").otherwise("old known device")
    values["examiner_id"] = F.lit("77.0")
    documents = metadata.where("cast(application_number AS int) % 50 <> 7").select(
        F.year("filing_date").alias("filing_year"), "application_number", *(values[k].alias(k) for k in DOCUMENT_KEYS)
    )
    return metadata, documents


def test_examples_and_classification(corpus):
    metadata, documents = corpus
    config = CorpusConfig(years=(2014, 2015), uniform_split=True, balance_validation=True, min_frequency=1)
    examples = build_examples(metadata, documents, config)
    counts = {(r.split, r.labels): r["count"] for r in examples.groupBy("split", "labels").count().collect()}
    assert counts["validation", 0] == counts["validation", 1] > 0
    scored = classify(examples, config)
    assert scored.count() == sum(counts.values())
    assert all(r.accuracy == 1.0 for r in metrics.accuracy(scored, ("split",)).collect())


def test_examiner_section_and_prefix(corpus):
    metadata, documents = corpus
    config = CorpusConfig(years=(2014,), ipc_prefix="G061", section="examiner", train_start="2014-01-01", train_end="2014-07-01", val_end="2015-01-01")
    rows = build_examples(metadata, documents, config).collect()
    assert rows and all(r.text.startswith("Examiner id: 77 ") and int(r.patent_number) % 2 for r in rows)


def test_full_examples(corpus):
    metadata, documents = corpus
    config = CorpusConfig(years=(2014, 2015), train_start="2014-01-01", train_end="2015-01-01", val_start="2014-12-01", val_end="2015-06-01")
    df = full_examples(metadata, documents, config)
    assert df.columns == [*EXAMPLE_COLUMNS, "split"]
    assert {r.split for r in df.select("split").distinct().collect()} == {"train", "validation"}


def test_error_breakdown(corpus):
    metadata, _ = corpus
    predictions = metadata.selectExpr("application_number", "decision = 'ACCEPTED' AS correct")
    tables = error_breakdown(metadata, predictions, ["uspc_class", "decision"])
    assert {r.uspc_class for r in tables["uspc_class"].collect()} <= {"class0", "class1", "class2"}
    pending = tables["decision"].where("decision = 'PENDING'").first()
    assert pending.Correct is None and pending.Incorrect > 0
