"""Katz backoff language model of any order with Good-Turing discounts, in stored tables.

A word after a history it was seen after in training takes its discounted share; otherwise the history's backoff weight
times the word's probability after the history without its first word, and so on down to the word alone. A word not seen
at all takes the mass that the discounts of single words left. Backoff weights are exactly what makes each history's
distribution sum to one.

Texts are read once. A run of documents becomes word numbers, and only runs exchange with the count tables: distinct
words first, then level by level the distinct grams, whose histories are grams of the level before. A table holds
histories, words and counts of the grams seen in training, and each history's mass below, by bucket. The answers go back
to the runs, which evaluate their tokens level by level. Documents that come later ask the same tables. Histories so
frequent that one bucket would hold much of all grams are spread over all buckets, and only their sums are put together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.llm.common import WordHashes, chunked, give_back, parts, stored

# Words of the longest grams, unless asked for: three need more than four times the input of disk.
ORDER = 2
# Counts up to this one are discounted.
RELIABLE = 5
# Bytes of text in a run.
RUN_BYTES = 16 << 20

START, UNKNOWN = 0, 1  # numbers of the history at the start of a text and of what training has not seen; others follow
WORD_BITS = 36  # bits of a word's number beside that of its history
HOT_BIT = 1 << 62  # marks a hot history, of which a bucket has a part

_BLOBS = ("a", "b", "c", "d", "e", "f", "g")
_KIND = {"level": pa.int32(), "kind": pa.int32(), "target": pa.int64(), "run": pa.int64()} | dict.fromkeys(_BLOBS, pa.binary()) | {"stats": pa.list_(pa.float64())}
_SCHEMA = "level int, kind int, target long, run long, " + ", ".join(f"{name} binary" for name in _BLOBS) + ", stats array<double>"
# Kinds of rows: what a run asks a table, a run's documents, a table, answers to a run, statistics, sums of hot histories.
ASK, DOCUMENTS, TABLE, ANSWER, STATS, HOT = range(6)


def _row(level: int, kind: int, target: int, run: int, *blobs: bytes, stats: list[float] | None = None) -> tuple:
    return (level, kind, target, run, *blobs, *(None,) * (len(_BLOBS) - len(blobs)), stats)


def _table(rows: list[tuple], kinds=_KIND) -> pa.Table:
    return pa.table([pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers from a base, byte by byte of equal weight, compressed."""
    if not len(values):
        return b""
    base = int(values.min())
    rest = (values.astype(np.int64) - base).astype("<u8")
    width = max(1, (int(rest.max()).bit_length() + 7) // 8)
    planes = rest.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return base.to_bytes(8, "little", signed=True) + bytes([width]) + zstandard.compress(planes, 3)


def _unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.int64)
    base, width = int.from_bytes(data[:8], "little", signed=True), data[8]
    planes = np.frombuffer(zstandard.decompress(data[9:]), np.uint8).reshape(width, -1)
    rest = np.zeros((planes.shape[1], 8), np.uint8)
    rest[:, :width] = planes.T
    return rest.view("<u8").reshape(-1).astype(np.int64) + base


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=0))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data))


def _pack_floats(values: np.ndarray) -> bytes:
    """Distinct values and which of them each one is."""
    distinct, which = np.unique(values, return_inverse=True)
    return len(distinct).to_bytes(8, "little") + distinct.astype("<f8").tobytes() + _pack(which)


def _unpack_floats(data: bytes) -> np.ndarray:
    end = 8 + 8 * int.from_bytes(data[:8], "little")
    return np.frombuffer(data[8:end], "<f8")[_unpack(data[end:])]


def _pack_heads(heads: np.ndarray, bucket: int, buckets: int) -> tuple[bytes, bytes]:
    """A bucket's sorted histories: the others, which have its remainder in common, and the hot ones."""
    hot = heads >= HOT_BIT
    return _pack_sorted((heads[~hot] - bucket) // buckets), _pack_sorted(heads[hot] - HOT_BIT)


def _unpack_heads(cold: bytes, hot: bytes, bucket: int, buckets: int) -> np.ndarray:
    return np.concatenate((_unpack_sorted(cold) * buckets + bucket, _unpack_sorted(hot) + HOT_BIT))


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


# -- the model -----------------------------------------------------------------------------------------------------


def discounts(counts: list[float]) -> np.ndarray:
    """Good-Turing factors for counts 0 to ``RELIABLE`` from the number of things seen 1 to ``RELIABLE`` + 1 times.

    Where these numbers are too irregular for factors between 0 and 1, half a count is taken off instead.
    """
    out = np.ones(RELIABLE + 1)
    out[0] = 0.0
    n = [0.0, *counts]
    common = (RELIABLE + 1) * n[RELIABLE + 1] / n[1] if n[1] else 0.0
    for r in range(1, RELIABLE + 1):
        factor = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common != 1 else 0.0
        out[r] = factor if 0 < factor < 1 else (r - 0.5) / r
    return out


def discounted(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= RELIABLE, factors[np.minimum(counts, RELIABLE)], 1.0)


@dataclass(frozen=True)
class Model:
    """What all histories share, and the tables.

    ``factors``: discounts by level, of the levels counted so far; ``hot``: by level, sorted numbers of the hot histories and
    their sums, fewer than there are buckets. ``tables`` by level are in shared storage.
    """

    order: int
    buckets: int
    tokens: int
    words: int
    texts: int
    unknown: float
    scale: float
    factors: dict[int, np.ndarray]
    hot: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    tables: dict[int, DataFrame] = field(default_factory=dict)

    def word(self, counts: np.ndarray) -> np.ndarray:
        """Probability of words by their training count; all unknown words are one."""
        return np.where(counts > 0, discounted(counts, self.factors[1]) * self.scale, self.unknown)

    def shared(self) -> Model:
        """Without tables: what tasks get."""
        return replace(self, tables={})


def make_model(order: int, buckets: int, texts: int, tokens: int, words: int, seen: list[float]) -> Model:
    """``seen[r - 1]``: words seen r times, the last entry: all occurrences of words seen more than ``RELIABLE`` times."""
    single = discounts(seen[: RELIABLE + 1])
    kept = sum(single[r] * r * seen[r - 1] for r in range(1, RELIABLE + 1)) + seen[-1]
    unknown = max(1 - kept / tokens, 1 / (tokens + 1)) if tokens else 1.0
    return Model(order, buckets, tokens, words, texts, float(unknown), float((1 - unknown) / kept) if kept else 0.0, {1: single})


def history_weights(factors: np.ndarray, mass: np.ndarray, by_count: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scale of the discounted counts and backoff weight of histories.

    ``by_count[:, r - 1]``: followers seen r times; ``large``: occurrences of followers seen more often; ``mass``: sum of the
    followers' probabilities one level below. A history without followers passes everything on.
    """
    each = np.arange(1, RELIABLE + 1)
    kept, total = by_count @ (factors[1:] * each) + large, by_count @ each + large
    safe = np.maximum(total, 1)
    left = np.maximum(1 - kept / safe, 0.5 / (safe + 1))
    scale = np.where(kept > 0, (1 - left) / np.maximum(kept, 1e-300), 0.0)
    backoff = np.where(total > 0, left / np.maximum(1 - mass, 1e-300), 1.0)
    return scale, backoff


def _small_counts(totals: np.ndarray) -> list[float]:
    """How many things were seen 1 to ``RELIABLE`` + 1 times."""
    return np.bincount(np.minimum(totals, RELIABLE + 2), minlength=RELIABLE + 3)[1 : RELIABLE + 2].astype(float).tolist()


def _changes(sorted_values: np.ndarray) -> np.ndarray:
    """Places where a new value begins."""
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))


# -- runs ----------------------------------------------------------------------------------------------------------


def _make_runs(buckets: int):
    """Level 1 asks: a run's distinct words for a bucket, with their training counts; and its documents as word numbers."""

    def flush(run: int, ids: list, train: list, sizes: list, units: list) -> pa.RecordBatch:
        words, local = np.unique(np.concatenate(units), return_inverse=True)
        # frequent words get small numbers, which pack well
        order = np.argsort(-np.bincount(local), kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        words, local = words[order], rank[local]
        learned = np.repeat(np.array(train), np.array(sizes))
        counts = np.bincount(local[learned], minlength=len(words))
        bucket = (words % np.uint64(buckets)).astype(np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        rows = []
        for part in np.split(by_bucket, _changes(bucket[by_bucket])[1:]):
            rows.append(_row(1, ASK, int(bucket[part[0]]), run, words[part].astype("<u8").tobytes(), _pack(counts[part])))
        flags = np.array(train, np.int64) + 2 * np.array([key is None for key in ids], np.int64)
        documents = (_pack(np.array([key or 0 for key in ids], np.int64)), _pack(flags), _pack(np.array(sizes, np.int64)))
        rows.append(_row(1, DOCUMENTS, run, run, *documents, _pack(local), _pack(bucket)))
        return _table(rows).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hashes = WordHashes()
        base = TaskContext.get().partitionId() << 20
        held, size, number = ([], [], [], []), 0, 0
        for batch in batches:
            flags = iter(batch.column("train").to_pylist())
            for ids, texts in chunked(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words: list[bytes] = []
                for text in texts:
                    some = text.lower().split()
                    words += some
                    words.append(b"\n")  # the end: no word holds a line feed
                    held[2].append(len(some) + 1)
                held[0].extend(ids)
                held[1].extend(next(flags) for _ in ids)
                held[3].append(hashes(words))
                size += sum(map(len, texts))
                if size >= RUN_BYTES:
                    yield flush(base + number, *held)
                    held, size, number = ([], [], [], []), 0, number + 1
        if held[0]:
            yield flush(base + number, *held)
        del hashes, held
        give_back()

    return run


class _Run:
    """A run's documents, evaluated up to the last level that has been counted.

    For the next level, ``history`` is each token's place among the grams that may be its history (-1: none), ``numbers`` and
    ``counts`` are theirs; ``own`` and ``scale`` are count and scale of the token's gram of the last level.
    """

    def __init__(self, documents: pa.Table, answers: pa.Table, model: Model):
        row = documents.to_pylist()[0]
        self.model = model
        self.ids, flags, self.sizes, self.local, bucket = (_unpack(row[name]) for name in "abcde")
        self.train, self.unnamed = flags & 1, flags > 1
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.learned = np.repeat(self.train, self.sizes) > 0
        by_level: dict[int, list[dict]] = {}
        for answer in answers.to_pylist():
            by_level.setdefault(answer["level"], []).append(answer)
        self.word_numbers = np.full(len(bucket), UNKNOWN, np.int64)
        self.word_counts = np.zeros(len(bucket), np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        in_order = bucket[by_bucket]
        for answer in by_level.get(1, []):
            b = answer["run"]
            part = by_bucket[np.searchsorted(in_order, b) : np.searchsorted(in_order, b, "right")]
            self.word_numbers[part], self.word_counts[part] = _numbers(_unpack(answer["a"]), b, model.buckets), _unpack(answer["b"])
        self.own = self.word_counts[self.local]
        self.probability = model.word(self.own)
        self.scale = np.full(len(self.local), model.scale)
        self._precede(self.local + 1, 0)
        self.numbers = np.concatenate(([START], self.word_numbers))
        self.counts = np.concatenate(([model.texts], self.word_counts))
        for level in range(2, max(model.factors) + 1):
            self._take(level, by_level.get(level, []))

    def _precede(self, grams: np.ndarray, at_start: int) -> None:
        self.history = np.concatenate(([at_start], grams[:-1]))
        self.history[self.starts] = at_start

    def grams(self) -> _Grams:
        return _Grams(self)

    def _take(self, level: int, answers: list[dict]) -> None:
        grams, model = self.grams(), self.model
        n = len(grams.h)
        totals, numbers, scale, backoff = np.zeros(n, np.int64), np.full(n, UNKNOWN, np.int64), np.zeros(n), np.ones(n)
        hot_numbers, hot_sums = model.hot[level]
        for answer in answers:
            b = answer["run"]
            part = grams.part(b)
            first = _changes(grams.h[part])
            sums = np.column_stack((_unpack_floats(answer["c"]), _unpack(answer["d"]).reshape(-1, RELIABLE), _unpack(answer["e"])))
            hot = np.flatnonzero(grams.h[part][first] >= HOT_BIT)
            if len(hot):
                # a hot history without followers is in no table
                wanted = grams.h[part][first][hot] - HOT_BIT
                places = np.searchsorted(hot_numbers, wanted)
                found = places < len(hot_numbers)
                found[found] = hot_numbers[places[found]] == wanted[found]
                sums[hot[found]] = hot_sums[places[found]]
            # all followers of a history have one scale a level below
            sums[:, 0] *= self.scale[grams.some[part][first]]
            own_scale, own_backoff = history_weights(model.factors[level], sums[:, 0], sums[:, 1:-1], sums[:, -1])
            lengths = np.diff(first, append=len(part))
            totals[part], scale[part], backoff[part] = _unpack(answer["a"]), np.repeat(own_scale, lengths), np.repeat(own_backoff, lengths)
            if answer["b"]:
                numbers[part] = _numbers(np.where(totals[part] > 0, _unpack_sorted(answer["b"]), -1), b, model.buckets)
        seen = discounted(totals, model.factors[level]) * scale
        self.probability[grams.at] = np.where(totals > 0, seen, backoff * self.probability[grams.some])[grams.inverse]
        self.own, self.scale = np.zeros(len(self.local), np.int64), np.zeros(len(self.local))
        self.own[grams.at], self.scale[grams.at] = totals[grams.inverse], scale[grams.inverse]
        each = np.full(len(self.local), -1, np.int64)
        each[grams.at] = grams.inverse
        self._precede(each, -1)
        self.numbers, self.counts = numbers, totals


class _Grams:
    """A run's distinct grams of the next level whose histories training has seen; others back off with weight one.

    ``at``: tokens that end a gram, ``inverse`` which, ``some``: one token of each. Grams go to a bucket by their history ``h``,
    those of a hot one, with more than a bucket's share of all tokens, by their word.
    """

    def __init__(self, run: _Run):
        buckets = run.model.buckets
        usable = run.history >= 0
        usable[usable] = run.counts[run.history[usable]] > 0
        self.at = np.flatnonzero(usable)
        keys, self.inverse = np.unique(run.history[self.at] << 32 | run.local[self.at], return_inverse=True)
        self.some = np.empty(len(keys), np.int64)
        self.some[self.inverse] = self.at
        self.h, self.w = run.numbers[keys >> 32], run.word_numbers[keys & 0xFFFFFFFF]
        hot = run.counts[keys >> 32] * buckets > run.model.tokens
        bucket = np.where(hot, self.w, self.h) % buckets
        self.h = np.where(hot, self.h + HOT_BIT, self.h)
        self.order = np.lexsort((self.w, self.h, bucket))
        self.in_order = bucket[self.order]

    def part(self, bucket: int) -> np.ndarray:
        """Grams of a bucket by history and word."""
        return self.order[np.searchsorted(self.in_order, bucket) : np.searchsorted(self.in_order, bucket, "right")]


def _numbers(index: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """Numbers of things by their index in a bucket's table."""
    return np.where(index < 0, UNKNOWN, index * buckets + bucket + 2)


def _find(table: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in a sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(wanted), -1, np.int64)
    places = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return np.where(table[places] == wanted, places, -1)


def _ask_grams(level: int, model: Model):
    def run(key: tuple, documents: pa.Table, answers: pa.Table) -> pa.Table:
        give_back()
        if not documents.num_rows:
            return _table([])
        mine = _Run(documents, answers, model)
        grams = mine.grams()
        seen = np.bincount(grams.inverse[mine.learned[grams.at]], minlength=len(grams.h))
        rows = []
        for b in np.unique(grams.in_order).tolist():
            part = grams.part(b)
            h = grams.h[part]
            first = _changes(h)
            cold, hot = _pack_heads(h[first], b, model.buckets)
            lengths = np.diff(first, append=len(part))
            # only grams of training are counted, so only their counts a level below are needed
            own = np.where(seen[part] > 0, mine.own[grams.some[part]], 0)
            rows.append(_row(level, ASK, b, key[0].as_py(), cold, hot, _pack(lengths), _pack(grams.w[part]), _pack(seen[part]), _pack(own)))
        return _table(rows)

    return run


# -- tables --------------------------------------------------------------------------------------------------------


def _words(count: bool):
    """Answers about words: index in the bucket's table and total, the table being counted from all that is asked or given."""

    def run(key: tuple, asked: pa.Table, kept: pa.Table | None) -> pa.Table:
        give_back()
        bucket = key[0].as_py()
        asks = [(r, np.frombuffer(a, "<u8"), b) for r, a, b in zip(*(asked.column(name).to_pylist() for name in ("run", "a", "b")), strict=True)]
        if not asks:
            return _table([])
        rows = []
        if count:
            words, inverse = np.unique(np.concatenate([w for _, w, _ in asks]), return_inverse=True)
            totals = np.bincount(inverse, weights=np.concatenate([_unpack(c) for _, _, c in asks]), minlength=len(words)).astype(np.int64)
            words, totals = words[totals > 0], totals[totals > 0]
            order = np.argsort(-totals, kind="stable")  # frequent words get small numbers
            words, totals = words[order], totals[order]
            rows.append(_row(1, STATS, bucket, 0, stats=[*_small_counts(totals), float(totals[totals > RELIABLE].sum()), float(totals.sum()), float(len(totals))]))
            rows.append(_row(1, TABLE, bucket, 0, words.astype("<u8").tobytes(), _pack(totals)))
        else:
            table = kept.to_pylist()
            words = np.frombuffer(table[0]["a"], "<u8") if table else np.empty(0, "<u8")
            totals = _unpack(table[0]["b"]) if table else np.empty(0, np.int64)
        order = np.argsort(words)
        in_order = words[order]
        for r, mine, _ in asks:
            places = _find(in_order, mine)
            index = np.where(places < 0, -1, order[places]) if len(order) else places
            rows.append(_row(1, ANSWER, r, bucket, _pack(index), _pack(np.where(index < 0, 0, totals[index]) if len(order) else index + 1)))
        return _table(rows)

    return run


class _Counts:
    """A bucket's grams as sorted keys of a history's place and a word, with the histories' sums."""

    def __init__(self, heads: np.ndarray, keys: np.ndarray, totals: np.ndarray, mass: np.ndarray):
        self.heads, self.keys, self.totals, self.mass = heads, keys, totals, mass
        owner, n = keys >> WORD_BITS, len(heads)
        self.by_count = np.stack([np.bincount(owner[totals == r], minlength=n) for r in range(1, RELIABLE + 1)], axis=1)
        self.large = np.bincount(owner, weights=np.where(totals > RELIABLE, totals, 0), minlength=n).astype(np.int64)

    @classmethod
    def counted(cls, asks: list[dict], model: Model, factors: np.ndarray) -> _Counts:
        """From what all runs saw in training. A history's mass is the sum of its followers' discounted counts one level below,
        which runs scale."""
        h, w, seen, own = [], [], [], []
        for ask in asks:
            some = _unpack(ask["e"])
            use = some > 0
            h.append(np.repeat(_heads(ask, model), _unpack(ask["c"]))[use])
            w.append(_unpack(ask["d"])[use])
            seen.append(some[use])
            own.append(_unpack(ask["f"])[use])
        heads, head = np.unique(np.concatenate(h), return_inverse=True)
        keys, inverse = np.unique(head << WORD_BITS | np.concatenate(w), return_inverse=True)
        totals = np.bincount(inverse, weights=np.concatenate(seen), minlength=len(keys)).astype(np.int64)
        below = np.empty(len(keys))
        below[inverse] = discounted(np.concatenate(own), factors)
        return cls(heads, keys, totals, np.bincount(keys >> WORD_BITS, weights=below, minlength=len(heads)))

    @classmethod
    def kept(cls, table: dict | None, model: Model) -> _Counts:
        if table is None:
            return cls(*(np.empty(0, np.int64) for _ in range(3)), np.empty(0))
        heads, lengths = _heads(table, model), _unpack(table["c"])
        return cls(heads, np.repeat(np.arange(len(heads)), lengths) << WORD_BITS | _unpack(table["d"]), _unpack(table["e"]), _unpack_floats(table["f"]))

    def row(self, level: int, bucket: int, model: Model) -> tuple:
        lengths = np.bincount(self.keys >> WORD_BITS, minlength=len(self.heads))
        words = self.keys & ((1 << WORD_BITS) - 1)
        heads = _pack_heads(self.heads, bucket, model.buckets)
        return _row(level, TABLE, bucket, 0, *heads, _pack(lengths), _pack(words), _pack(self.totals), _pack_floats(self.mass))

    def answer(self, level: int, bucket: int, ask: dict, model: Model) -> tuple:
        """Totals of a run's grams, the indices of those that have one, but for the last level, and sums of its histories."""
        heads, lengths = _find(self.heads, _heads(ask, model)), _unpack(ask["c"])
        absent = heads < 0
        index = np.where(np.repeat(absent, lengths), -1, _find(self.keys, np.repeat(heads, lengths) << WORD_BITS | _unpack(ask["d"])))
        if len(self.keys):
            totals = np.where(index < 0, 0, self.totals[index])
            mass, large = np.where(absent, 0.0, self.mass[heads]), np.where(absent, 0, self.large[heads])
            by_count = np.where(absent[:, None], 0, self.by_count[heads])
        else:
            totals, mass, large, by_count = index + 1, np.zeros(len(heads)), heads + 1, np.zeros((len(heads), RELIABLE), np.int64)
        # asks are in the order of the table, so indices ascend
        indices = b"" if level == model.order else _pack_sorted(np.maximum.accumulate(index))
        return _row(level, ANSWER, ask["run"], bucket, _pack(totals), indices, _pack_floats(mass), _pack(by_count.reshape(-1)), _pack(large))


def _heads(row: dict, model: Model) -> np.ndarray:
    return _unpack_heads(row["a"], row["b"], row["target"], model.buckets)


def _count_grams(level: int, model: Model, count: bool):
    """Answers about grams, from a table that is counted or given; with a counted one its statistics and its hot histories."""

    def run(key: tuple, asked: pa.Table, kept: pa.Table | None) -> pa.Table:
        give_back()
        bucket, asks = key[0].as_py(), asked.to_pylist()
        if not asks:
            return _table([])
        if count:
            table = _Counts.counted(asks, model, model.factors[level - 1])
            rows = [_row(level, STATS, bucket, 0, stats=_small_counts(table.totals))]
            for i in np.flatnonzero(table.heads >= HOT_BIT).tolist():
                sums = [float(table.mass[i]), *table.by_count[i].astype(float).tolist(), float(table.large[i])]
                rows.append(_row(level, HOT, int(table.heads[i]) - HOT_BIT, 0, stats=sums))
            rows.append(table.row(level, bucket, model))
        else:
            rows, table = [], _Counts.kept(next(iter(kept.to_pylist()), None), model)
        rows += [table.answer(level, bucket, ask, model) for ask in asks]
        return _table(rows)

    return run


# -- whole tables --------------------------------------------------------------------------------------------------


def _sums(rows: DataFrame, count: int) -> list[float]:
    """Sums over the buckets of their statistics."""
    row = rows.where(F.col("kind") == STATS).agg(*(F.sum(F.col("stats")[i]) for i in range(count))).first()
    return [float(x or 0) for x in row]


def _hot(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and sums of the hot histories, fewer than there are buckets."""
    grouped = rows.where(F.col("kind") == HOT).groupBy("target").agg(*(F.sum(F.col("stats")[i]) for i in range(RELIABLE + 2)))
    found = sorted(tuple(row) for row in grouped.collect())
    return np.array([row[0] for row in found], np.int64), np.array([row[1:] for row in found], float).reshape(-1, RELIABLE + 2)


def _evaluate(docs: DataFrame, train: Column, order: int, model: Model | None) -> tuple[Model, DataFrame]:
    """Scores of the documents, and the model: the given one, or one that is learned from them on the way."""
    spark = docs.sparkSession
    count, buckets = model is None, parts(spark) if model is None else model.buckets
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary")).alias("text"),
        F.coalesce(train, F.lit(False)).alias("train"),
    )
    runs = stored(rows.mapInArrow(_make_runs(buckets), _SCHEMA), "katz-runs", "kind")
    documents, asked = runs.where(F.col("kind") == DOCUMENTS), runs.where(F.col("kind") == ASK)

    def exchange(level: int, asked: DataFrame, work) -> DataFrame:
        grouped = asked.groupBy("target")
        if count:
            rows = grouped.applyInArrow(lambda key, table: work(key, table, None), _SCHEMA)
        else:
            rows = grouped.cogroup(model.tables[level].groupBy("target")).applyInArrow(work, _SCHEMA)
        return stored(rows, f"katz-{level}", "kind")

    found = exchange(1, asked, _words(count))
    if count:
        totals = _sums(found, RELIABLE + 4)
        texts = int(rows.where("train").count())
        model = make_model(order, buckets, texts, int(totals[-2]), int(totals[-1]), totals[:-2])
        model.tables[1] = found.where(F.col("kind") == TABLE)
    answers = found.where(F.col("kind") == ANSWER)
    known = model if count else replace(model, factors={1: model.factors[1]})
    for level in range(2, model.order + 1):
        shared = known.shared()
        asked = documents.groupBy("target").cogroup(answers.groupBy("target")).applyInArrow(_ask_grams(level, shared), _SCHEMA)
        found = exchange(level, asked, _count_grams(level, shared, count))
        factors = discounts(_sums(found, RELIABLE + 1)) if count else model.factors[level]
        hot = _hot(found) if count else model.hot[level]
        known = replace(known, factors=known.factors | {level: factors}, hot=known.hot | {level: hot})
        if count:
            known = replace(known, tables=known.tables | {level: found.where(F.col("kind") == TABLE)})
        answers = answers.unionByName(found.where(F.col("kind") == ANSWER))
    shared = known.shared()
    kinds = {"doc_id": pa.int64(), "train": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}

    def finish(key: tuple, documents: pa.Table, answers: pa.Table) -> pa.Table:
        give_back()
        if not documents.num_rows:
            return _table([], kinds)
        mine = _Run(documents, answers, shared)
        doc = np.repeat(np.arange(len(mine.ids)), mine.sizes)
        counts = mine.word_counts[mine.local]
        base = np.log10((counts + 1) / (shared.tokens + shared.words + 1))
        sums = [np.bincount(doc, weights=some) for some in (base, np.log10(mine.probability))]
        columns = [np.ma.array(mine.ids, mask=mine.unnamed), mine.train, mine.sizes, np.bincount(doc, weights=counts > 0).astype(np.int64), *sums]
        return pa.table([pa.array(column, kind) for column, kind in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    scored = documents.groupBy("target").cogroup(answers.groupBy("target")).applyInArrow(
        finish, "doc_id long, train long, n_tokens long, n_known long, base_score double, score double"
    )
    tokens = F.lit(shared.tokens).cast("long").alias("train_tokens")
    return known, scored.select("doc_id", (F.col("train") == 0).alias("held_out"), "n_tokens", "n_known", tokens, "base_score", "score")


def score(docs: DataFrame, train: Column | None = None, order: int = ORDER) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every document.

    ``train`` says which documents are learned from; by default those whose crc32(doc_id as text) mod 7 is not 2. A null or
    empty text is one token, the end. A null id is kept and dealt like an empty text of it. Rows that are repeated or share
    an id count and are scored each by its own text, as often as they occur; columns of other names are not read; an empty
    table gives no rows; without training documents every word is unknown, with probability one. Words are told apart by
    64-bit hashes.
    """
    return _evaluate(docs, ~held_out() if train is None else train, order, None)[1]


def fit(docs: DataFrame, train: Column | None = None, order: int = ORDER) -> Model:
    """The model of the training documents; its tables are in shared storage."""
    return _evaluate(docs, ~held_out() if train is None else train, order, None)[0]


def score_with(model: Model, docs: DataFrame) -> DataFrame:
    """Rows as ``score`` gives them, for documents that the model's tables were not counted with; nothing is learned, so all
    are ``held_out``. Only the buckets' grams that the documents ask for come back."""
    return _evaluate(docs, F.lit(False), model.order, model)[1]


def save(model: Model, path: str) -> None:
    """Tables as Parquet by level, one row per bucket; what all histories share as one row of JSON, written last."""
    tables = list(model.tables.values())
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table)
    merged.write.partitionBy("level").parquet(f"{path}/tables")
    plain = {name: getattr(model, name) for name in ("order", "buckets", "tokens", "words", "texts", "unknown", "scale")}
    plain["factors"] = {level: values.tolist() for level, values in model.factors.items()}
    plain["hot"] = {level: [numbers.tolist(), sums.tolist()] for level, (numbers, sums) in model.hot.items()}
    merged.sparkSession.createDataFrame([(json.dumps(plain),)], "model string").coalesce(1).write.parquet(f"{path}/model")


def load(spark: SparkSession, path: str) -> Model:
    plain = json.loads(spark.read.parquet(f"{path}/model").first()[0])
    plain["factors"] = {int(level): np.array(values) for level, values in plain["factors"].items()}
    plain["hot"] = {int(level): (np.array(n, np.int64), np.array(sums, float).reshape(-1, RELIABLE + 2)) for level, (n, sums) in plain["hot"].items()}
    tables = spark.read.schema(_SCHEMA).parquet(f"{path}/tables")
    return Model(**plain, tables={level: tables.where(F.col("level") == level) for level in plain["factors"]})
