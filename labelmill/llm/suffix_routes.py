"""Blocks from many sources to many targets, without a row for each pair.

With ``n`` targets and as many sources there is a block for nearly each pair. Up to ``fan`` targets they travel as rows. Beyond
that, a source bundles the blocks for a range of targets into one row; a relay takes the bundles that a range of sources
has for such a range, combines the blocks of one target, and bundles again for smaller ranges. With levels of ``fan`` ways each, a
source sends at most ``fan`` rows per level, so rows grow with the sources, and a block with what it holds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 256

Kinds = dict[str, pa.DataType]

_BUNDLE: Kinds = {"range_": pa.int64(), "part": pa.int64(), "blocks": pa.binary()}


def ddl(kinds: Kinds) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{name} {names[kind]}" for name, kind in kinds.items())


def arrow_rows(table: pa.Table, kinds: Kinds) -> list[tuple]:
    return list(zip(*(table.column(name).to_pylist() for name in kinds), strict=True))


def _batch(rows: list[tuple], kinds: Kinds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds.values())], list(kinds))


def _bundled(rows: list[tuple], kinds: Kinds) -> bytes:
    batch, sink = _batch(rows, kinds), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _opened(data: bytes, kinds: Kinds) -> list[tuple]:
    return arrow_rows(pa.ipc.open_stream(data).read_all(), kinds)


@dataclass(frozen=True)
class Routes:
    """From ``sources`` numbered sources to ``targets`` numbered targets."""

    targets: int
    sources: int
    fan: int = FAN

    @property
    def levels(self) -> int:
        levels = 1
        while self.fan**levels < self.targets:
            levels += 1
        return levels

    @property
    def ways(self) -> int:
        """Ranges that a bundle is split into at each level."""
        ways = 1
        while ways**self.levels < self.targets:
            ways += 1
        return ways

    def schema(self, kinds: Kinds, extra: Kinds | None = None) -> Kinds:
        """Columns of what ``sent`` gives; with ``extra``, a column ``kind`` tells blocks (0) and extra rows (1) apart."""
        own = kinds if self.levels == 1 else _BUNDLE
        return own if extra is None else {"kind": pa.int32()} | own | extra

    def _ranged(self, rows: list[tuple], kinds: Kinds, width: int) -> list[tuple]:
        """Rows by the range of ``width`` targets that they go to; the part is the source for now."""
        by_range: dict[int, list[tuple]] = {}
        for row in rows:
            by_range.setdefault(row[0] // width, []).append(row)
        return [(at, some[0][1], _bundled(some, kinds)) for at, some in by_range.items()]

    def sent(self, rows: list[tuple], kinds: Kinds, extra: Kinds | None = None, more: list[tuple] = ()) -> pa.Table:
        """What a source passes on: ``rows`` start with target and source."""
        if self.levels > 1:
            rows = self._ranged(rows, kinds, self.ways ** (self.levels - 1))
        own = kinds if self.levels == 1 else _BUNDLE
        if extra is None:
            return pa.Table.from_batches([_batch(rows, own)])
        full = [(0, *row, *[None] * len(extra)) for row in rows] + [(1, *[None] * len(own), *row) for row in more]
        return pa.Table.from_batches([_batch(full, self.schema(kinds, extra))])

    def delivered(self, sent: DataFrame, kinds: Kinds, combine: Callable[[int, list[tuple]], list[tuple]]) -> DataFrame:
        """The blocks as rows, brought near their targets. ``combine(target, rows)`` gives fewer rows for the same target."""
        for level in range(1, self.levels):
            last = level == self.levels - 1
            nearer = sent.withColumn("part", F.expr(f"part DIV {self.ways}"))
            relay = self._relay(kinds, combine, self.ways ** (self.levels - level - 1), last)
            sent = nearer.groupBy("range_", "part").applyInArrow(relay, ddl(kinds if last else _BUNDLE))
        return sent

    def _relay(self, kinds: Kinds, combine: Callable[[int, list[tuple]], list[tuple]], width: int, last: bool):
        """Opens the bundles of one range and part, combines by target, and bundles for ranges of ``width`` targets."""

        def relay(key: tuple, table: pa.Table) -> pa.Table:
            by_target: dict[int, list[tuple]] = {}
            for data in table.column("blocks").to_pylist():
                for row in _opened(data, kinds):
                    by_target.setdefault(row[0], []).append(row)
            rows = [row for target, some in sorted(by_target.items()) for row in combine(target, some)]
            if last:
                return pa.Table.from_batches([_batch(rows, kinds)])
            bundles = [(at, key[1].as_py(), blocks) for at, _, blocks in self._ranged(rows, kinds, width)]
            return pa.Table.from_batches([_batch(bundles, _BUNDLE)])

        return relay
