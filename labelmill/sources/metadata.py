"""Metadata tables in the supported file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.schemas import METADATA
from labelmill.sources.arrow_index import plain
from labelmill.sources.files import located

# Columns without which a table is no metadata table; other declared ones are null where a file lacks them.
REQUIRED = ("application_number", "filing_date", "decision")


def _declared(df: DataFrame, schema: T.StructType, path: str, bad_values: str) -> DataFrame:
    """Declared columns first, found by name and cast; further columns stay as they are.

    ``bad_values`` names a column that gets the declared columns whose value is there but cannot be read as their type, or is empty
    for a table without such a column; then the first such value ends the query.
    """
    missing = [name for name in REQUIRED if name in schema.names and name not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    known = [field for field in schema.fields if field.name in df.columns]
    cast = {field.name: F.col(f"`{field.name}`").try_cast(field.dataType) for field in known}
    unread = {name: F.col(f"`{name}`").isNotNull() & column.isNull() for name, column in cast.items()}
    if not bad_values:
        for name, column in cast.items():
            told = F.concat(F.lit(f"{path}: {name} cannot be read from "), F.col(f"`{name}`").cast("string"))
            cast[name] = F.when(unread[name], F.raise_error(told).cast(schema[name].dataType)).otherwise(column)
    declared = [cast.get(field.name, F.lit(None).cast(field.dataType)).alias(field.name) for field in schema.fields]
    further = [F.col(f"`{name}`") for name in df.columns if name not in schema.names]
    if bad_values:
        names = F.array(*(F.when(bad, F.lit(name)) for name, bad in unread.items()))
        further.append(F.array_compact(names).alias(bad_values))
    return df.select(*declared, *further)


def read_metadata(
    spark: SparkSession, path: str, schema: T.StructType = METADATA, line_breaks: bool = False, bad_values: str = ""
) -> DataFrame:
    """Read a metadata table; the suffix of ``path`` names the format. Columns are found by their names.

    A value that cannot be read as its column's type ends the query, unless ``bad_values`` names a column for it: then the value
    is null and its column's name stands there, and :func:`split_unreadable` sets such rows apart.

    Large text files are split among tasks. Pass ``line_breaks=True`` for text files with line breaks inside quoted fields;
    each of those is read by one task.
    """
    name = path.rstrip("/").lower()
    text = {"header": True, "escape": '"', "multiLine": line_breaks}
    if name.endswith(".parquet"):
        return _declared(spark.read.parquet(path), schema, path, bad_values)
    if name.endswith(".csv"):
        return _declared(spark.read.csv(path, **text), schema, path, bad_values)
    if name.endswith(".tsv"):
        return _declared(spark.read.csv(path, sep="\t", **text), schema, path, bad_values)
    if name.endswith(".feather"):
        return _declared(read_arrow(spark, path), schema, path, bad_values)
    if name.endswith(".pickle"):
        raise ValueError(f"Unpickling runs code, so this metadata file is not read: {path}")
    raise ValueError(f"No metadata format with this suffix: {path}")


def split_unreadable(metadata: DataFrame, bad_values: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose values could all be read, and a quarantine of ``(application_number, reason)`` for the others.

    A row without a filing date belongs to no year and no window; it is quarantined as ``no_filing_date``.
    """
    unread = F.size(bad_values) > 0
    dateless = F.col("filing_date").isNull()
    reason = F.when(unread, F.concat(F.lit("unreadable "), F.array_join(bad_values, ", "))).otherwise(F.lit("no_filing_date"))
    return metadata.where(~unread & ~dateless).drop(bad_values), metadata.where(unread | dateless).select("application_number", reason.alias("reason"))


def _arrow_file(location: str):
    import pyarrow as pa

    filesystem, inner = located(location)
    return pa.ipc.open_file(filesystem.open_input_file(inner))


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC (Feather v2) files, read in parallel by record batch, with the columns of the first file.

    Only paths and batch numbers travel through the first step; every task then opens its
    files and reads single batches, so neither a large file nor a folder of files is held whole.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    # a folder named like x.feather holds the files; a plain file is read alone
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")

    def schema_of(parts):
        for part in parts:
            for location in part.column(0).to_pylist():
                found = _arrow_file(location).schema
                found = pa.schema([(field.name, plain(field.type)) for field in found])
                yield pa.RecordBatch.from_pydict({"schema": pa.array([found.serialize().to_pybytes()], pa.binary())})

    first = files.orderBy("path").limit(1).mapInArrow(schema_of, "schema binary").first()
    if first is None:
        raise ValueError(f"no Arrow file in {path}")
    wanted = pa.ipc.read_schema(pa.py_buffer(bytes(first["schema"])))

    def batches_of(parts):
        for part in parts:
            for location in part.column(0).to_pylist():
                count = _arrow_file(location).num_record_batches
                if count:
                    yield pa.RecordBatch.from_pydict(
                        {"path": [location] * count, "batch": list(range(count))},
                        schema=pa.schema([("path", pa.string()), ("batch", pa.int32())]),
                    )

    def rows_of(parts):
        for part in parts:
            for location, number in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                table = pa.Table.from_batches([_arrow_file(location).get_batch(number)])
                columns = [table.column(f.name).cast(f.type, safe=False) if f.name in table.column_names else pa.nulls(len(table), f.type) for f in wanted]
                yield from pa.table(columns, schema=wanted).to_batches()

    slots = files.mapInArrow(batches_of, "path string, batch int")
    # with a number, adaptive execution does not merge these few small rows into one task
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return slots.repartition(tasks, "path", "batch").mapInArrow(rows_of, from_arrow_schema(wanted))


def write_arrow(df: DataFrame, path: str) -> None:
    """Write ``df`` as a folder of Arrow IPC files, one per task; each is there whole or not at all, and a retry replaces it."""

    def store(parts):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        filesystem, inner = located(path)
        filesystem.create_dir(inner, recursive=True)
        rows, writer = 0, None
        name = f"{inner}/part-{TaskContext.get().partitionId():06d}.feather"
        # Spark's readers pass over names that begin like this
        beside = f"{inner}/_{uuid.uuid4().hex}.part"
        for part in parts:
            if writer is None:
                out = filesystem.open_output_stream(beside)
                writer = pa.ipc.new_file(out, part.schema)
            writer.write_batch(part)
            rows += part.num_rows
        if writer is not None:
            writer.close()
            out.close()
            filesystem.move(beside, name)
        yield pa.RecordBatch.from_pydict({"n": pa.array([rows], pa.int64())})

    df.mapInArrow(store, "n long").agg(F.sum("n")).collect()


def list_columns(df: DataFrame) -> DataFrame:
    """Position, name and type of every column, with the number of values that are not null."""
    entries = F.array(
        *(
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(field.name).alias("name"),
                F.lit(field.dataType.simpleString()).alias("type"),
                F.count(F.col(f"`{field.name}`")).alias("n_values"),
            )
            for i, field in enumerate(df.schema.fields)
        )
    )
    return df.agg(entries.alias("entries")).select(F.explode("entries").alias("entry")).select("entry.*")
