from pyspark.sql import functions as F

from labelmill.config import CorpusConfig
from labelmill.functions import normalise
from labelmill.operators.examples import map_decision
from labelmill.operators.filters import filed_between, keep_decided
from labelmill.operators.splits import hash_split
from labelmill.streaming import ingest_stream, prepare_stream


def test_stream_gives_the_batch_result(spark, tmp_path, rows):
    source = str(tmp_path / "in")
    spark.range(300).selectExpr(
        "cast(id AS string) AS application_number",
        "cast(date_add(date'2014-01-01', cast(id AS int)) AS timestamp_ntz) AS filing_date",
        "element_at(array('ACCEPTED', 'REJECTED', 'PENDING', 'odd'), cast(id % 4 AS int) + 1) AS decision",
        "concat('Été ', id) AS claims",
    ).repartition(3).write.parquet(source)
    batch = spark.read.parquet(source)
    config = CorpusConfig(train_start="2014-02-01", val_end="2014-06-30")
    stream = prepare_stream(spark.readStream.schema(batch.schema).parquet(source), config, text="claims")
    query = ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert query.awaitTermination(120)
    wanted = hash_split(keep_decided(map_decision(filed_between(batch, "2014-02-01", "2014-06-30"), strict=False)))
    wanted = wanted.withColumn("claims", normalise(F.col("claims")))
    columns = ["application_number", "labels", "split", "claims"]
    got = rows(spark.read.parquet(str(tmp_path / "out")), *columns)
    assert got == rows(wanted, *columns) and got
