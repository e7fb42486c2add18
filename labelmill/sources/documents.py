"""Application documents: one JSON object per file under a folder per filing year."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.schemas import DOCUMENT, DOCUMENT_KEYS
from labelmill.session import materialise
from labelmill.sources.files import bounded, entries, files_below, located, write_whole

# Files that one task opens.
PER_TASK = 2_000

_PARSED = T.StructType([*DOCUMENT.fields, T.StructField("_corrupt", T.StringType())])


def read_documents(spark: SparkSession, folder: str, years: Iterable[int] | None = None) -> DataFrame:
    """Every ``{folder}/{year}/{application_number}.json`` as one row.

    With ``years`` only those folders are listed and read; a year without a folder is skipped.
    ``problem`` is null for a good document, ``corrupt`` when the file does not parse and
    ``absent_key`` when one of the expected keys is not there. A key with a JSON null is fine,
    which is why the keys are looked at and not only the typed fields.

    Each folder in ``folder`` is listed by a task, and tasks open ``PER_TASK`` files each, so neither the driver's
    memory nor the number of tasks follows the number of files as in Spark's own file scan, which plans on the
    driver and gives a task 32 small files. Spark's scan serves folders that Arrow cannot open: other file systems,
    relative paths and patterns.
    """
    raw = _opened_in_tasks(spark, folder, years)
    if raw is None:
        path = folder if years is None else f"{folder.rstrip('/')}/{{{','.join(str(year) for year in sorted(set(years)))}}}"
        raw = (
            spark.read.option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.json")
            .text(path, wholetext=True)
            .select("value", F.col("_metadata.file_path").alias("path"))
        )
    named = raw.select(
        F.regexp_extract("path", r"([0-9]{4})/[^/]+\.json$", 1).cast("int").alias("filing_year"),
        F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("application_number"),
        "value",
    )
    return parsed_documents(named)


def _opened_in_tasks(spark: SparkSession, folder: str, years: Iterable[int] | None) -> DataFrame | None:
    """``(value, path)`` of the JSON files that hold something, or nothing if Arrow does not find the folder.

    The names are written once. What reaches the driver is the folders in ``folder``, one for each year.
    """
    import pyarrow as pa
    from pyarrow import fs

    try:
        filesystem, inner = located(folder)
        if filesystem.get_file_info(inner).type != fs.FileType.Directory:
            return None
    except (pa.ArrowException, OSError, ValueError):
        return None
    inner = inner.rstrip("/")
    found = sorted(path for path, is_folder in entries(filesystem, inner) if is_folder)
    if years is None:
        places = [(inner, False), *((path, True) for path in found)]
    else:
        wanted = {f"{inner}/{year}" for year in years}
        places = [(path, True) for path in found if path in wanted]
        if not places:
            return None

    def listing(parts):
        filesystem, _ = located(folder)
        for part in parts:
            for i in part.column(0).to_pylist():
                place, below = places[i]
                files = files_below(filesystem, place) if below else (path for path, is_folder in entries(filesystem, place) if not is_folder)
                named = (path for path in files if path.endswith(".json"))
                while some := list(islice(named, 10_000)):
                    yield pa.RecordBatch.from_pydict({"path": pa.array(some, pa.string())})

    def opened(parts):
        filesystem, _ = located(folder)

        def bodies():
            for part in parts:
                for path in part.column(0).to_pylist():
                    with filesystem.open_input_file(path) as file:
                        yield path, file.read()

        yield from bounded((row for row in bodies() if row[1]), pa.schema([("path", pa.string()), ("value", pa.binary())]))

    names = materialise(spark.range(0, len(places), 1, len(places)).mapInArrow(listing, "path string"), "names")
    tasks = max(spark.sparkContext.defaultParallelism, -(-names.count() // PER_TASK))
    read = names.repartition(tasks).mapInArrow(opened, "path string, value binary")
    return read.select(F.col("value").cast("string").alias("value"), "path")


def parsed_documents(named: DataFrame) -> DataFrame:
    """``(filing_year, application_number, value)`` as rows of documents; a null value is a document that is ``missing``."""
    parsed = named.withColumns(
        {
            "doc": F.from_json("value", _PARSED, {"columnNameOfCorruptRecord": "_corrupt"}),
            "keys": F.json_object_keys("value"),
        }
    )
    required = F.array(*(F.lit(key) for key in DOCUMENT_KEYS))
    broken = F.col("doc").isNull() | F.col("doc._corrupt").isNotNull() | F.col("keys").isNull()
    problem = F.when(F.col("value").isNull(), F.lit("missing")).when(broken, F.lit("corrupt"))
    problem = problem.when(F.size(F.array_except(required, F.col("keys"))) > 0, F.lit("absent_key"))
    return parsed.select(
        "filing_year",
        "application_number",
        *(F.col(f"doc.{key}").alias(key) for key in DOCUMENT_KEYS),
        problem.alias("problem"),
    )


def quarantine(metadata: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per application whose document cannot be used: ``(application_number, reason)``.

    A document is looked up under its filing year, so one filed in another folder is missing.
    """
    keys = ["filing_year", "application_number"]
    known = metadata.select(F.year("filing_date").alias("filing_year"), "application_number")
    states = documents.select(*keys, F.coalesce("problem", F.lit("ok")).alias("state"))
    looked_up = known.join(states, keys, "left")
    reason = F.coalesce("state", F.lit("missing"))
    return looked_up.select("application_number", reason.alias("reason")).where("reason <> 'ok'")


def ingest_documents(documents: DataFrame, path: str, table: str | None = None, buckets: int = 0) -> None:
    """Write usable documents once as Parquet partitioned by filing year.

    The rebalance hint sizes the files and splits a year that holds much of the corpus. With
    ``table`` and ``buckets`` the documents are also bucketed by application number and
    registered: later lookups then move the narrow metadata only, never the texts.
    """
    usable = documents.where("problem IS NULL").drop("problem")
    if table is None:
        usable.hint("rebalance", "filing_year").write.partitionBy("filing_year").parquet(path)
        return
    if buckets < 1:
        raise ValueError("a bucketed table needs a positive number of buckets")
    (
        usable.repartition(buckets, "application_number")
        .write.partitionBy("filing_year")
        .bucketBy(buckets, "application_number")
        .sortBy("application_number")
        .option("path", path)
        .saveAsTable(table, format="parquet")
    )


def write_documents(rows: DataFrame, folder: str) -> None:
    """Write ``(filing_year, application_number, body)`` rows as one file each, inside the tasks.

    Writing the same row twice, as a retried task does, leaves the same file; a file is there whole or not at all.
    """

    def store(parts):
        import pyarrow as pa

        filesystem, inner = located(folder)
        made = set()
        for part in parts:
            for year, number, body in zip(*(part.column(i).to_pylist() for i in range(3))):
                if year not in made:
                    filesystem.create_dir(f"{inner}/{year}", recursive=True)
                    made.add(year)
                write_whole(filesystem, f"{inner}/{year}/{number}.json", body.encode("utf-8"))
            yield pa.RecordBatch.from_pydict({"n": pa.array([part.num_rows], pa.int64())})

    wanted = rows.select(F.col("filing_year").cast("int"), "application_number", "body")
    wanted.mapInArrow(store, "n long").agg(F.sum("n")).collect()
