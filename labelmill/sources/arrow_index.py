"""Arrow IPC (Feather) metadata with an index of its record batches: a data source that reads only what a query needs.

Beside the file lies a Parquet table with the smallest and largest value of every comparable column in each batch. Filters that
Spark pushes down rule batches out at planning time and rows out in the tasks; ``columns`` names the columns to read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from labelmill.sources.files import located

FORMAT = "arrow_batches"

# Largest size of a batch that one task reads together with others, in rows.
ROWS_PER_TASK = 1 << 18


def index_path(path: str) -> str:
    return f"{path.rstrip('/')}.index"


def plain(kind):
    """A type that Spark takes: categories as their values, times in microseconds."""
    import pyarrow as pa

    if pa.types.is_dictionary(kind):
        return plain(kind.value_type)
    return pa.timestamp("us", kind.tz) if pa.types.is_timestamp(kind) else kind


def ordered(kind) -> bool:
    """Whether smallest and largest values are kept for a column of this type."""
    import pyarrow as pa

    t = pa.types
    return t.is_integer(kind) or t.is_floating(kind) or t.is_string(kind) or t.is_large_string(kind) or t.is_timestamp(kind) or t.is_date(kind)


def _key(value) -> str | None:
    """A value as text that the index stores whatever the column's type."""
    import datetime
    import json

    if value is None:
        return None
    if isinstance(value, datetime.datetime):
        return json.dumps(["t", value.replace(tzinfo=None).isoformat()])
    if isinstance(value, datetime.date):
        return json.dumps(["d", value.isoformat()])
    return json.dumps(["v", value])


def _clock(value):
    """Times without a zone, as the index holds them: those of UTC."""
    import datetime

    if isinstance(value, datetime.datetime) and value.tzinfo is not None:
        return value.astimezone(datetime.UTC).replace(tzinfo=None)
    return value


def _value(text: str | None):
    import datetime
    import json

    if text is None:
        return None
    kind, value = json.loads(text)
    return {"t": datetime.datetime.fromisoformat, "d": datetime.date.fromisoformat}.get(kind, lambda x: x)(value)


def index_batches(spark: SparkSession, path: str) -> DataFrame:
    """Write the index of a Feather file, or of a folder of them, beside it, and return it: one row per batch and column.

    ``(path, batch, rows, name, low, high, nulls)``. Every batch is read once, by one task. An index that is there is replaced.
    """
    import pyarrow as pa

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def batches_of(parts):
        for part in parts:
            for location in part.column(0).to_pylist():
                filesystem, inner = located(location)
                count = pa.ipc.open_file(filesystem.open_input_file(inner)).num_record_batches
                rows = {"path": [location] * count, "batch": list(range(count))}
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("path", pa.string()), ("batch", pa.int32())]))

    kinds = [("path", pa.string()), ("batch", pa.int32()), ("rows", pa.int64()), ("name", pa.string()), ("low", pa.string()), ("high", pa.string()), ("nulls", pa.int64())]

    def bounds_of(parts):
        import pyarrow.compute as pc

        for part in parts:
            rows = []
            for location, number in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                filesystem, inner = located(location)
                batch = pa.ipc.open_file(filesystem.open_input_file(inner)).get_batch(number)
                for field, column in zip(batch.schema, batch.columns, strict=True):
                    kind = plain(field.type)
                    if ordered(kind):
                        values = column.cast(kind, safe=False)
                        if pa.types.is_floating(kind):
                            values = pc.filter(values, pc.invert(pc.is_nan(values)))
                        ends = pc.min_max(values).as_py()
                        nan = len(values) < len(column)
                        # with a NaN, which Spark orders last, there is no upper bound
                        rows.append((location, number, batch.num_rows, field.name, _key(ends["min"]), None if nan else _key(ends["max"]), column.null_count))
                    else:
                        rows.append((location, number, batch.num_rows, field.name, None, None, column.null_count))
            yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], kind) for i, (_, kind) in enumerate(kinds)], schema=pa.schema(kinds))

    slots = files.mapInArrow(batches_of, "path string, batch int").repartition(tasks, "path", "batch")
    bounds = slots.mapInArrow(bounds_of, "path string, batch int, rows long, name string, low string, high string, nulls long")
    bounds.write.mode("overwrite").parquet(index_path(path))
    return spark.read.parquet(index_path(path))


class _Batches(InputPartition):
    def __init__(self, batches: list[tuple[str, int]]):
        self.batches = batches


def _attribute(filter_) -> str | None:
    return filter_.attribute[0] if len(filter_.attribute) == 1 else None


class _Reader(DataSourceReader):
    """Handled filters are applied in full, by batch and by row; others go back to Spark."""

    KINDS = (ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual, ds.In, ds.IsNotNull, ds.StringStartsWith)

    def __init__(self, options, schema: T.StructType):
        self.path, self.columns = options["path"], schema.names
        self.rows_per_task = int(options.get("rows_per_task", ROWS_PER_TASK))
        self.filters: list[ds.Filter] = []
        # Spark orders NaN behind all numbers, Arrow does not
        self.floats = {field.name for field in schema.fields if isinstance(field.dataType, (T.FloatType, T.DoubleType))}

    def pushFilters(self, filters: list[ds.Filter]):
        for filter_ in filters:
            name = _attribute(filter_) if isinstance(filter_, self.KINDS) else None
            if name in self.columns and name not in self.floats:
                self.filters.append(filter_)
            else:
                yield filter_

    def may_match(self, filter_: ds.Filter, low, high, nulls: int, rows: int) -> bool:
        """Whether a batch with these ends can hold a row that passes; unknown ends never rule it out."""
        if nulls == rows:
            return False
        if isinstance(filter_, ds.IsNotNull):
            return True
        if isinstance(filter_, ds.In):
            values = [_clock(value) for value in filter_.value if value is not None]
            return any((low is None or value >= low) and (high is None or value <= high) for value in values)
        value = _clock(filter_.value)
        if value is None:
            return False
        if isinstance(filter_, ds.StringStartsWith):
            return (high is None or high >= value) and (low is None or low[: len(value)] <= value)
        above = low is None or (value > low if isinstance(filter_, ds.LessThan) else value >= low)
        below = high is None or (value < high if isinstance(filter_, ds.GreaterThan) else value <= high)
        if isinstance(filter_, (ds.LessThan, ds.LessThanOrEqual)):
            return above
        if isinstance(filter_, (ds.GreaterThan, ds.GreaterThanOrEqual)):
            return below
        return above and below

    def partitions(self) -> list[_Batches]:
        import pyarrow.parquet as pq

        filesystem, inner = located(index_path(self.path))
        entries = pq.read_table(inner, filesystem=filesystem).to_pylist()
        sizes: dict[tuple[str, int], int] = {}
        out: set[tuple[str, int]] = set()
        for entry in entries:
            at = entry["path"], entry["batch"]
            sizes[at] = entry["rows"]
            for filter_ in self.filters:
                if _attribute(filter_) == entry["name"] and not self.may_match(filter_, _value(entry["low"]), _value(entry["high"]), entry["nulls"], entry["rows"]):
                    out.add(at)
        parts, some, rows = [], [], 0
        for at in sorted(set(sizes) - out):
            if some and rows + sizes[at] > self.rows_per_task:
                parts.append(_Batches(some))
                some, rows = [], 0
            some.append(at)
            rows += sizes[at]
        return [*parts, _Batches(some)] if some or not parts else parts

    def passing(self, table):
        """The rows that pass all handled filters; a comparison with null passes none."""
        import pyarrow as pa
        import pyarrow.compute as pc

        def typed(value, kind):
            return value if pa.types.is_timestamp(kind) and kind.tz else _clock(value)

        for filter_ in self.filters:
            column = table.column(_attribute(filter_))
            if isinstance(filter_, ds.IsNotNull):
                mask = pc.is_valid(column)
            elif isinstance(filter_, ds.In):
                mask = pc.is_in(column, value_set=pa.array([typed(value, column.type) for value in filter_.value if value is not None], column.type))
            elif isinstance(filter_, ds.StringStartsWith):
                mask = pc.starts_with(column, filter_.value)
            else:
                compare = {ds.EqualTo: pc.equal, ds.GreaterThan: pc.greater, ds.GreaterThanOrEqual: pc.greater_equal, ds.LessThan: pc.less, ds.LessThanOrEqual: pc.less_equal}
                mask = compare[type(filter_)](column, pa.scalar(typed(filter_.value, column.type), column.type))
            table = table.filter(mask)
        return table

    def read(self, partition: _Batches) -> Iterator:
        import pyarrow as pa

        needed = list(dict.fromkeys([*self.columns, *map(_attribute, self.filters)]))
        last, file = None, None
        for location, number in partition.batches:
            if location != last:
                filesystem, inner = located(location)
                file, last = filesystem.open_input_file(inner), location
                names = pa.ipc.open_file(file).schema.names
                chosen = [names.index(name) for name in needed if name in names]
                reader = pa.ipc.open_file(file, options=pa.ipc.IpcReadOptions(included_fields=chosen))
            batch = pa.Table.from_batches([reader.get_batch(number)])
            table = pa.table({name: batch.column(name).cast(plain(batch.schema.field(name).type), safe=False) for name in needed})
            yield from self.passing(table).select(self.columns).to_batches()


class ArrowBatches(DataSource):
    """Options: ``path``; ``columns``, separated by commas (all, if not given); ``rows_per_task``. The index must be there."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        filesystem, inner = located(index_path(self.options["path"]))
        paths = pq.read_table(inner, filesystem=filesystem, columns=["path"]).column("path").unique().to_pylist()
        if not paths:
            raise ValueError(f"no batch in the index of {self.options['path']}")
        files, first = located(min(paths))
        found = pa.ipc.open_file(files.open_input_file(first)).schema
        wanted = [name.strip() for name in self.options.get("columns", "").split(",") if name.strip()] or found.names
        return from_arrow_schema(pa.schema([(name, plain(found.field(name).type)) for name in wanted]))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


def read_indexed(spark: SparkSession, path: str, columns: tuple[str, ...] = (), rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """An indexed Feather table. Comparisons, ``IN``, ``IS NOT NULL`` and prefixes on single columns are pushed down.

    Only ``columns`` (all, if none are given) and those that pushed filters need are read, and only from batches whose smallest and
    largest values allow a match. Rows are the same with and without pushdown.
    """
    spark.dataSource.register(ArrowBatches)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(FORMAT).option("path", path).option("rows_per_task", str(rows_per_task))
    return (reader.option("columns", ",".join(columns)) if columns else reader).load()
