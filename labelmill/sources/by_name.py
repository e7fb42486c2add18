"""Documents opened by name: a data source whose partitions are planned from the wanted names.

A folder of millions of files is not listed. The wanted names are a Parquet table of ``(filing_year, application_number)``;
planning reads the row counts in its footers only and cuts it into partitions of a bounded number of names, and each
task opens ``{folder}/{year}/{number}.json`` for its own names. A file that is not there gives a row without a body.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from labelmill.session import scratch_path
from labelmill.sources.documents import PER_TASK, parsed_documents
from labelmill.sources.files import bounded, located

FORMAT = "documents_by_name"

SCHEMA = "filing_year int, application_number string, value binary"


class _Names(InputPartition):
    """Rows ``start`` to ``stop`` of one row group."""

    def __init__(self, path: str, group: int, start: int, stop: int):
        self.path, self.group, self.start, self.stop = path, group, start, stop


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.names = options["folder"].rstrip("/"), options["names"]
        self.per_task = int(options.get("per_task", PER_TASK))

    def partitions(self) -> list[_Names]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        filesystem, inner = located(self.names)
        found = filesystem.get_file_info(fs.FileSelector(inner))
        out = []
        for path in sorted(info.path for info in found if info.path.endswith(".parquet")):
            with filesystem.open_input_file(path) as file:
                footer = pq.ParquetFile(file).metadata
                sizes = [footer.row_group(group).num_rows for group in range(footer.num_row_groups)]
            for group, size in enumerate(sizes):
                out += [_Names(path, group, start, min(size, start + self.per_task)) for start in range(0, size, self.per_task)]
        return out or [_Names("", 0, 0, 0)]

    def read(self, partition: _Names) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq

        if not partition.path:
            return
        filesystem, _ = located(self.names)
        with filesystem.open_input_file(partition.path) as file:
            names = pq.ParquetFile(file).read_row_group(partition.group).slice(partition.start, partition.stop - partition.start)
        documents, inner = located(self.folder)
        schema = pa.schema([("filing_year", pa.int32()), ("application_number", pa.string()), ("value", pa.binary())])

        def bodies():
            for year, number in zip(names.column("filing_year").to_pylist(), names.column("application_number").to_pylist(), strict=True):
                try:
                    with documents.open_input_file(f"{inner}/{year}/{number}.json") as document:
                        yield year, number, document.read()
                except FileNotFoundError:
                    yield year, number, None

        yield from bounded(bodies(), schema)


class DocumentsByName(DataSource):
    """Options: ``folder``, ``names`` (a Parquet folder) and ``per_task``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_documents_by_name(spark: SparkSession, folder: str, wanted: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """The documents of the wanted ``(filing_year, application_number)``, one row for each distinct name.

    Columns as of ``read_documents``; ``problem`` may be ``missing`` too. Exactly the wanted files are opened, and no folder is
    listed. Names without a year or a number are left out: no file can have them. Names that leave their folder
    (with a slash, or only dots) are missing, not opened.
    """
    spark.dataSource.register(DocumentsByName)
    path = scratch_path(spark, "wanted-names")
    names = wanted.select(F.col("filing_year").cast("int").alias("filing_year"), F.col("application_number").cast("string").alias("application_number"))
    names = names.where("filing_year IS NOT NULL AND application_number IS NOT NULL").distinct()
    safe = ~F.col("application_number").rlike(r"[/\\\x00]|^\.*$")
    names.where(safe).write.parquet(path)
    opened = spark.read.format(FORMAT).option("folder", folder).option("names", path).option("per_task", str(per_task)).load()
    unsafe = names.where(~safe).withColumn("value", F.lit(None).cast("binary"))
    return parsed_documents(opened.unionByName(unsafe).withColumn("value", F.col("value").cast("string")))


def looked_up(spark: SparkSession, metadata: DataFrame, folder: str, per_task: int = PER_TASK) -> tuple[DataFrame, DataFrame]:
    """The usable documents of the given metadata, and one quarantine row ``(application_number, reason)`` for each other one."""
    documents = read_documents_by_name(spark, folder, metadata.withColumn("filing_year", F.year("filing_date")), per_task)
    return documents.where("problem IS NULL").drop("problem"), documents.where("problem IS NOT NULL").select("application_number", F.col("problem").alias("reason"))
