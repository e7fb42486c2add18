"""Removal of byte strings that also start in an earlier document, by a distributed merge of sorted suffix runs.

A string of ``length`` bytes can be shared only where an anchor is shared: a place whose gram has the smallest hash of all
grams in some window of that length. So suffixes are sorted from anchors only, and only from those whose gram occurs in
two documents or more. A suffix is compared over ``length`` bytes, together with the bytes before the anchor that a
window around it can reach. Runs are sorted where the texts are, exchanged front-coded, and merged with loser trees; in
the merged order equal contexts meet, and all windows around an anchor are judged from the contexts that share its gram.
A run holds a context once, with its smallest document, so that a passage found everywhere costs one entry per run. Equal texts
are judged once.

Groups of documents and buckets of grams are cut by bytes of text, whatever the session's partitions. Where there are many of
them, blocks travel in bundles over several levels (``suffix_routes``), so that rows do not grow with groups times buckets.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import chunked, mix, narrow, shared_root, utf8, windowed_min
from labelmill.llm.common import stored as stored_once
from labelmill.llm.suffix_routes import FAN, Routes, arrow_rows, ddl
from labelmill.llm.suffix_runs import coded_rows, common_prefix, decoded, front_coded, merged, packed, unpacked

LENGTH, GRAM = 50, 20
# Bytes of text in a group of documents, groups that one task reads, and contexts of a gram that are compared pair by pair.
GROUP_BYTES, GROUPS_PER_TASK, FEW = 4 << 20, 4, 8

_PRIME = 2**31 - 1
_UNITS = mix(np.arange(1, 257, dtype=np.uint64))
_HASH_BITS = 48

# Powers of an odd factor and of its inverse modulo 2**64, for one stretch of text.
_STRETCH = 1 << 16
_FACTOR = 0x9E3779B97F4A7C15 | 1


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done, power = 1, factor
    while done < n:
        out[done : 2 * done] = out[: min(done, n - done)] * np.uint64(power)
        done, power = 2 * done, power * power % 2**64
    return out


_UP, _DOWN = _powers(_FACTOR, _STRETCH), _powers(pow(_FACTOR, -1, 2**64), _STRETCH)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all runs of ``gram`` bytes: differences of running sums, brought to the same power."""
    out = np.empty(max(0, len(data) - gram + 1), np.uint64)
    step = _STRETCH - gram
    for at in range(0, len(out), step):
        part = data[at : at + step + gram - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_UNITS[part] * _UP[: len(part)], out=sums[1:])
        n = len(part) - gram + 1
        out[at : at + n] = mix((sums[gram:] - sums[:n]) * _DOWN[:n])
    return out


def group_of(doc_id: Column, groups: int) -> Column:
    """The group that a document belongs to."""
    key = F.pmod(doc_id, F.lit(_PRIME)).cast("long")
    return F.pmod(F.pmod(key * F.lit(48271), F.lit(_PRIME)), F.lit(groups)).cast("int")


def anchors(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all texts, laid end to end: place, text number, gram hash; and where each text begins."""
    sizes = np.array([len(text) for text in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    empty = np.empty(0, np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return empty, empty, empty.astype(np.uint64), starts
    hashes = gram_hashes(data, gram)
    small = np.maximum((hashes >> np.uint64(32)).astype(np.uint32), 1)
    least = windowed_min(small, length - gram + 1)
    # a window counts only within its text; least is 0 elsewhere, which no gram in a counted window falls short of
    inside = np.zeros(len(data) + 1, np.int32)
    full = sizes >= length
    np.add.at(inside, starts[:-1][full], 1)
    np.add.at(inside, starts[1:][full] - length + 1, -1)
    counted = np.cumsum(inside)[: len(least)] > 0
    least = np.where(counted, least, 0)
    # the largest of the smallest hashes of all windows over a gram equals its hash if it is the smallest of one of them
    span = length - gram
    reach = ~windowed_min(np.concatenate((np.full(span, 0xFFFFFFFF, np.uint32), ~least, np.full(span, 0xFFFFFFFF, np.uint32))), span + 1)
    place = np.flatnonzero((reach[: len(small)] == small) & (reach[: len(small)] > 0))
    number = np.searchsorted(starts, place, side="right") - 1
    within = place + gram <= starts[number + 1]
    place, number = place[within], number[within]
    # the hashes of anchors are the small ones; mixed again, they share out evenly among buckets
    return place, number, mix(hashes[place]) >> np.uint64(64 - _HASH_BITS), starts


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes * np.uint64(buckets) >> np.uint64(_HASH_BITS)).astype(np.int64)


def _in_order(table: pa.Table) -> list[tuple[int, bytes]]:
    """The distinct documents of a group in a fixed order; places in it name documents in runs of this group."""
    return sorted(set(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True)))


def _group_anchors(docs: list[tuple[int, bytes]], length: int, gram: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk of a group's texts: the texts, anchor places among them, number in the group, hash, and text starts."""
    at = 0
    for ids, texts in chunked([doc for doc, _ in docs], [text for _, text in docs]):
        place, number, hashes, starts = anchors(texts, length, gram)
        yield texts, place, at + number, hashes, starts
        at += len(ids)


def _several(hashes: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, and whether more than one document has each."""
    order = np.lexsort((number, hashes))
    hashes, number = hashes[order], number[order]
    first = np.concatenate(([True], hashes[1:] != hashes[:-1]))[: len(hashes)]
    heads = np.flatnonzero(first)
    if not len(heads):
        return hashes, first
    last = np.concatenate((heads[1:], [len(hashes)])) - 1
    return hashes[heads], number[heads] != number[last]


# Hashes of a group in a bucket; kind 0: in one document of it, kind 1: in several. ``sources`` names groups where rows were combined.
_PRINTS = {"target": pa.int64(), "source": pa.int64(), "kind": pa.int32(), "hashes": pa.binary(), "sources": pa.binary()}


def _deltas(hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences."""
    return packed(np.concatenate((hashes[:1], np.diff(hashes))).astype(np.int64)[1:]) + hashes[:1].astype("<u8").tobytes()


def _undeltas(data: bytes) -> np.ndarray:
    first = np.frombuffer(data[-8:], "<u8").astype(np.int64)
    return np.cumsum(np.concatenate((first, unpacked(data[:-8])))).astype(np.uint64)


def _fingerprints(routes: Routes, length: int, gram: int):
    """Per group: the hashes of its anchors, by bucket."""

    def run(key: tuple, texts: pa.Table) -> pa.Table:
        group, hashes, numbers = key[0].as_py(), [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for _, _, number, some, _ in _group_anchors(_in_order(texts), length, gram):
            hashes.append(some)
            numbers.append(number)
        values, several = _several(np.concatenate(hashes), np.concatenate(numbers))
        rows = []
        for kind in (0, 1):
            some = values[several == bool(kind)]
            bucket = _bucket_of(some, routes.targets)
            for b, begin, end in _stretches(bucket):
                rows.append((b, group, kind, _deltas(some[begin:end]), b""))
        return routes.sent(rows, _PRINTS)

    return run


def _stretches(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of equal values: the value, begin and end."""
    if len(values):
        heads = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]))
        yield from zip(values[heads[:-1]].tolist(), heads[:-1].tolist(), heads[1:].tolist(), strict=True)


def _prints_of(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of kind 0 with their groups, and hashes of kind 1."""
    one, groups, many = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for _, source, kind, hashes, sources in rows:
        values = _undeltas(hashes)
        if kind:
            many.append(values)
        else:
            one.append(values)
            groups.append(unpacked(sources) if sources else np.full(len(values), source))
    return np.concatenate(one), np.concatenate(groups), np.unique(np.concatenate(many))


def _prints_combined(target: int, rows: list[tuple]) -> list[tuple]:
    one, groups, many = _prints_of(rows)
    order = np.argsort(one, kind="stable")
    out = [(target, 0, 0, _deltas(one[order]), packed(groups[order]))] if len(one) else []
    return out + ([(target, 0, 1, _deltas(many), b"")] if len(many) else [])


_LIVE = {"target": pa.int64(), "source": pa.int64(), "hashes": pa.binary()}


def _live_hashes(routes: Routes):
    """Per bucket: hashes that several documents have, sent to the groups that found them in one."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        one, groups, many = _prints_of(arrow_rows(table, _PRINTS))
        order = np.lexsort((one, groups))
        values, counts = np.unique(one, return_counts=True)
        live = np.union1d(values[counts > 1], many)
        one, groups = one[order], groups[order]
        at = np.minimum(np.searchsorted(live, one), max(0, len(live) - 1))
        found = live[at] == one if len(live) else np.zeros(len(one), bool)
        one, groups = one[found], groups[found]
        return routes.sent([(g, key[0].as_py(), _deltas(one[a:b])) for g, a, b in _stretches(groups)], _LIVE)

    return run


def _live_combined(target: int, rows: list[tuple]) -> list[tuple]:
    return [(target, 0, _deltas(np.sort(np.concatenate([_undeltas(row[2]) for row in rows]))))]


# A block of a sorted run. Entry i comes from place ``first + i`` of group ``source``, or of the group and place that a merged
# block lists. ``docs`` is the smallest document in that group with this context, ``more`` says whether there are others.
_RUN = {
    "target": pa.int64(), "source": pa.int64(), "first": pa.int64(), "count": pa.int64(), "keys": pa.binary(), "docs": pa.binary(),
    "more": pa.binary(), "runs": pa.binary(), "places": pa.binary(),
}
# Where a group's contexts stand: place in the run, document in the group, byte in the document.
_PLACES = {"g": pa.int32(), "at": pa.binary(), "numbers": pa.binary(), "bytes": pa.binary()}


def _contexts(texts: list[bytes], place: np.ndarray, number: np.ndarray, starts: np.ndarray, ahead: int, back: int) -> np.ndarray:
    """One row per anchor: the bytes from it, the bytes before it backwards, both padded, and how many of each there are.

    ``number`` counts within ``texts``.
    """
    width = ahead + back + 2
    out = np.zeros((len(place), width), np.uint8)
    data = np.frombuffer(bytes(back) + b"".join(texts) + bytes(ahead), np.uint8)
    right = np.minimum(ahead, starts[number + 1] - place)
    left = np.minimum(back, place - starts[number])
    columns = np.arange(ahead)
    out[:, :ahead] = np.where(columns < right[:, None], data[back + place[:, None] + columns], 0)
    columns = np.arange(back)
    out[:, ahead : ahead + back] = np.where(columns < left[:, None], data[back + place[:, None] - 1 - columns], 0)
    out[:, -2], out[:, -1] = right, left
    return out


def _sorted_runs(routes: Routes, length: int, gram: int):
    """Per group: its live contexts as a sorted run, cut into a block for each bucket, and which anchors have them."""
    ahead, back = length, length - gram
    width = ahead + back + 2

    def run(key: tuple, texts: pa.Table, live: pa.Table) -> pa.Table:
        group = key[0].as_py()
        docs = _in_order(texts)
        chunks = list(_group_anchors(docs, length, gram))
        values, several = _several(np.concatenate([c[3] for c in chunks] or [np.empty(0, np.uint64)]), np.concatenate([c[2] for c in chunks] or [np.empty(0, np.int64)]))
        known = np.union1d(values[several], np.concatenate([np.empty(0, np.uint64), *(_undeltas(row[2]) for row in arrow_rows(live, _LIVE))]))
        keys, numbers, places, hashes, at = [], [], [], [], 0
        for some, place, number, own, starts in chunks if len(known) else ():
            keep = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
            place, number = place[keep], number[keep]
            keys.append(_contexts(some, place, number - at, starts, ahead, back))
            numbers.append(number)
            places.append(place - starts[number - at])
            hashes.append(own[keep])
            at += len(some)
        if not sum(map(len, keys)):
            return routes.sent([], _RUN, _PLACES, [])
        matrix, number, place = np.concatenate(keys), np.concatenate(numbers), np.concatenate(places)
        bucket = _bucket_of(np.concatenate(hashes), routes.targets)
        order = np.argsort(matrix.view(np.dtype((np.void, width))).ravel(), kind="stable")
        order = order[np.argsort(bucket[order], kind="stable")]
        matrix, number, place, bucket = matrix[order], number[order], place[order], bucket[order]
        differ = matrix[1:] != matrix[:-1]
        head = np.concatenate(([True], differ.any(axis=1)))
        heads = np.flatnonzero(head)
        owner = np.array([doc for doc, _ in docs], np.int64)[number]
        least, most = np.minimum.reduceat(owner, heads), np.maximum.reduceat(owner, heads)
        distinct = matrix[heads]
        shared = np.zeros(len(heads), np.int64)
        shared[1:] = differ[heads[1:] - 1].argmax(axis=1)
        rows = []
        for b, begin, end in _stretches(bucket[heads]):
            coded = coded_rows(distinct[begin:end], shared[begin:end])
            rows.append((b, group, begin, end - begin, coded, packed(least[begin:end]), packed((least != most)[begin:end].astype(np.int64)), b"", b""))
        where = (group, packed(np.cumsum(head) - 1), packed(number), packed(place))
        return routes.sent(rows, _RUN, _PLACES, [where])

    return run


def _entries(rows: list[tuple], width: int):
    """The blocks as sources of a merge; a payload is group, place, document, several."""

    def source(row: tuple):
        _, run, first, count, keys, docs, more, runs, places = row
        run_of = unpacked(runs).tolist() if runs else [run] * count
        place_of = unpacked(places).tolist() if runs else range(first, first + count)
        payload = zip(run_of, place_of, unpacked(docs).tolist(), unpacked(more).tolist(), strict=True)
        for (same, key), entry in zip(decoded(keys, count, width), payload, strict=True):
            yield same, key, entry

    return merged([source(row) for row in rows])


def _runs_combined(width: int):
    def combine(target: int, rows: list[tuple]) -> list[tuple]:
        found = list(_entries(rows, width))
        columns = [packed(np.array([entry[2][i] for entry in found], np.int64)) for i in (2, 3, 0, 1)]
        return [(target, 0, 0, len(found), front_coded([key for _, key, _ in found]), *columns)]

    return combine


_ANSWERS = {"target": pa.int64(), "source": pa.int64(), "places": pa.binary(), "docs": pa.binary(), "masks": pa.binary()}


class Judge:
    """For each context of a gram: the smallest document per window around its anchor.

    An answer is ``(place in the run, document, mask)``: bit o stands for the window that begins o bytes before the anchor.
    """

    def __init__(self, length: int, gram: int):
        self.ahead, self.back = length, length - gram
        self.width = self.ahead + self.back + 2
        self.answers: dict[int, list[tuple[int, int, int]]] = {}

    def offsets(self, key: bytes) -> tuple[int, int]:
        """First and last offset of windows that lie in the text; the last may fall short of the first."""
        return max(0, self.ahead - key[-2]), min(self.back, key[-1])

    def few(self, keys: list[bytes], docs: list[int]) -> list[dict[int, int]]:
        """Masks by document, from the bytes that each two contexts share on both sides."""
        ahead, back = self.ahead, self.back
        ranges = [self.offsets(key) for key in keys]
        claims = [[(doc, low, high)] for doc, (low, high) in zip(docs, ranges, strict=True)]
        for i, x in enumerate(keys):
            for j in range(i):
                if docs[i] != docs[j]:
                    y = keys[j]
                    low = max(ranges[i][0], ranges[j][0], ahead - common_prefix(x[:ahead], y[:ahead], 0))
                    high = min(ranges[i][1], ranges[j][1], common_prefix(x[ahead : ahead + back], y[ahead : ahead + back], 0))
                    if low <= high:
                        later, first = (i, j) if docs[j] < docs[i] else (j, i)
                        claims[later].append((docs[first], low, high))
        out = []
        for own in claims:
            masks: dict[int, int] = {}
            taken = 0
            for doc, low, high in sorted(own):
                if low <= high and (mask := (1 << high + 1) - (1 << low) & ~taken):
                    masks[doc] = masks.get(doc, 0) | mask
                    taken |= mask
            out.append(masks)
        return out

    def many(self, keys: list[bytes], docs: list[int]) -> Iterator[dict[int, int]]:
        """The same from sorted windows, one offset at a time: some hundred bytes per context, however many there are."""
        matrix = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), self.width)
        owner = np.array(docs, np.int64)
        least = np.full((len(keys), self.back + 1), -1, np.int64)
        known = np.zeros(least.shape, bool)
        for o in range(self.back + 1):
            some = np.flatnonzero((matrix[:, -2] >= self.ahead - o) & (matrix[:, -1] >= o))
            if len(some):
                windows = np.concatenate((matrix[some, : self.ahead - o], matrix[some, self.ahead : self.ahead + o]), axis=1)
                _, which = np.unique(np.ascontiguousarray(windows).view(np.dtype((np.void, self.ahead))).ravel(), return_inverse=True)
                smallest = np.full(which.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(smallest, which, owner[some])
                least[some, o], known[some, o] = smallest[which], True
        for row, valid in zip(least, known, strict=True):
            masks: dict[int, int] = {}
            for o in np.flatnonzero(valid).tolist():
                doc = int(row[o])
                masks[doc] = masks.get(doc, 0) | 1 << o
            yield masks

    def gram(self, contexts: list[tuple[bytes, list[tuple]]]) -> None:
        """Answer the entries ``(group, place, document, several)`` of all contexts that share a gram."""
        if len(contexts) == 1:
            key, entries = contexts[0]
            if len(entries) == 1 and not entries[0][3]:
                return
            low, high = self.offsets(key)
            found = [{min(entry[2] for entry in entries): (1 << high + 1) - (1 << low)}] if low <= high else [{}]
        else:
            keys, docs = [key for key, _ in contexts], [min(entry[2] for entry in entries) for _, entries in contexts]
            found = self.few(keys, docs) if len(keys) <= FEW else self.many(keys, docs)
        for (_, entries), masks in zip(contexts, found, strict=True):
            for group, place, first, several in entries:
                for doc, mask in masks.items():
                    if doc < first or several:
                        self.answers.setdefault(group, []).append((place, doc, mask))


def _judged(routes: Routes, length: int, gram: int):
    """Per bucket: merge the runs and judge gram by gram."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        judge = Judge(length, gram)
        contexts: list[tuple[bytes, list]] = []
        for same, context, entry in _entries(arrow_rows(table, _RUN), judge.width):
            if contexts and same >= judge.width:
                contexts[-1][1].append(entry)
                continue
            if contexts and same < gram:
                judge.gram(contexts)
                contexts = []
            contexts.append((context, [entry]))
        if contexts:
            judge.gram(contexts)
        rows = [(g, key[0].as_py(), *(packed(np.array([x[k] for x in some], np.int64)) for k in range(3))) for g, some in sorted(judge.answers.items())]
        return routes.sent(rows, _ANSWERS)

    return run


def _answers_combined(target: int, rows: list[tuple]) -> list[tuple]:
    return [(target, 0, *(packed(np.concatenate([unpacked(row[i]) for row in rows])) for i in (2, 3, 4)))]


def _bits(mask: int) -> Iterator[tuple[int, int]]:
    """Runs of set bits: first and last."""
    at = 0
    while mask:
        skip = (mask & -mask).bit_length() - 1
        mask >>= skip
        at += skip
        run = (~mask & (mask + 1)).bit_length() - 1
        yield at, at + run - 1
        mask >>= run
        at += run


_RESULT = {"doc_id": pa.int64(), "text_key": pa.string(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}


def _removed(length: int, with_text: bool):
    """Per group: the spans to remove, and what is left of each text."""

    def run(key: tuple, texts: pa.Table, marks: pa.Table) -> pa.Table:
        docs = _in_order(texts)
        spans: list[list[tuple[int, int]]] = [[] for _ in docs]
        answers: dict[int, list] = {}
        rows = list(zip(*(marks.column(name).to_pylist() for name in ("kind", "x", "y", "z")), strict=True))
        for kind, *columns in rows:
            if kind == 2:
                for place, doc, mask in zip(*(unpacked(some).tolist() for some in columns), strict=True):
                    answers.setdefault(place, []).append((doc, list(_bits(mask))))
        for kind, *columns in rows:
            if kind == 1 and answers:
                for place, number, p in zip(*(unpacked(some).tolist() for some in columns), strict=True):
                    for doc, bits in answers.get(place, ()):
                        if doc < docs[number][0]:
                            spans[number] += [(p - high, p - low + length) for low, high in bits]
        out = []
        for (doc, text), some in zip(docs, spans, strict=True):
            kept, end, count, removed = [], 0, 0, 0
            start, stop = 0, -1
            for begin, close in sorted(some):
                if begin > stop:
                    count += 1
                    removed += max(0, stop - start)
                    kept.append(text[end:begin])
                    start, stop = begin, close
                else:
                    stop = max(stop, close)
                end = stop
            removed += max(0, stop - start)
            kept.append(text[end:])
            left = b"".join(kept)
            out.append((doc, hashlib.sha256(text).hexdigest(), removed, count, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore").encode() if with_text else None))
        return pa.Table.from_arrays([pa.array([row[i] for row in out], kind) for i, kind in enumerate(_RESULT.values())], list(_RESULT))

    return run


def first_texts(docs: DataFrame, groups: int, tasks: int) -> DataFrame:
    """One document for each distinct text, the one with the smallest id, stored by group so that groups need no shuffle.

    The catalog knows the table only until it has been opened.
    """
    spark = docs.sparkSession
    rows = narrow(docs).where("doc_id IS NOT NULL").withColumn("text_key", F.sha2("text", 256))
    # as one value, so that rows are dealt by id and text together
    place = F.struct("doc_id", "text_key").alias("place")
    firsts = rows.groupBy("text_key").agg(F.min("doc_id").alias("doc_id")).select(place)
    chosen = rows.withColumn("place", place).join(firsts, "place", "left_semi").select(group_of(F.col("doc_id"), groups).alias("g"), "doc_id", "text")
    name = f"first_texts_{uuid.uuid4().hex}"
    writer = chosen.repartition(tasks, "g").write.format("parquet").option("compression", "zstd").option("path", f"{shared_root(spark)}/{name}")
    writer.bucketBy(tasks, "g").saveAsTable(name)
    opened = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return opened


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False, group_bytes: int = GROUP_BYTES, fan: int = FAN) -> DataFrame:
    """What is left of each distinct text: ``(first_id, text_key, n_removed, n_spans, kept_sha256, kept)``.

    ``kept`` (what stays, without the rest of characters that were cut) is null unless asked for. ``text_key`` is the SHA-256 of
    the text's bytes, ``kept_sha256`` that of all bytes that stay.
    """
    total = docs.select(F.sum(F.octet_length(utf8()).cast("long"))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    buckets = max(1, -(-groups // GROUPS_PER_TASK))
    texts = first_texts(docs, groups, buckets)
    out, back = Routes(buckets, groups, fan), Routes(groups, buckets, fan)
    prints = texts.groupBy("g").applyInArrow(_fingerprints(out, length, gram), ddl(out.schema(_PRINTS)))
    prints = out.delivered(prints, _PRINTS, _prints_combined)
    live = prints.groupBy("target").applyInArrow(_live_hashes(back), ddl(back.schema(_LIVE)))
    live = back.delivered(live, _LIVE, _live_combined).withColumn("g", F.col("target").cast("int"))
    made = texts.groupBy("g").cogroup(live.groupBy("g")).applyInArrow(_sorted_runs(out, length, gram), ddl(out.schema(_RUN, _PLACES)))
    made = stored_once(made, "suffix-runs", "kind")
    runs = out.delivered(made.where("kind = 0").select(*out.schema(_RUN)), _RUN, _runs_combined(2 * length - gram + 2))
    answers = runs.groupBy("target").applyInArrow(_judged(back, length, gram), ddl(back.schema(_ANSWERS)))
    answers = back.delivered(answers, _ANSWERS, _answers_combined)
    marks = made.where("kind = 1").select("g", F.lit(1).alias("kind"), F.col("at").alias("x"), F.col("numbers").alias("y"), F.col("bytes").alias("z"))
    marks = marks.unionByName(
        answers.select(F.col("target").cast("int").alias("g"), F.lit(2).alias("kind"), F.col("places").alias("x"), F.col("docs").alias("y"), F.col("masks").alias("z"))
    )
    done = texts.groupBy("g").cogroup(marks.groupBy("g")).applyInArrow(_removed(length, with_text), ddl(_RESULT))
    return done.withColumnRenamed("doc_id", "first_id")


def _free(docs: DataFrame, name: str) -> str:
    taken = {column.lower() for column in docs.columns}
    while name in taken:
        name += "_"
    return name


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_bytes: int = GROUP_BYTES, fan: int = FAN) -> DataFrame:
    """The same rows and columns, repeats cut from ``text``, ``n_chars`` (if there) counted anew; rules as below.

    A character cut in half goes whole. A null text stays null. Columns of any other name stay as they are.
    """
    key, first, left = (_free(docs, name) for name in ("_key", "_first", "_kept"))
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary"))
    found = repeats(docs, length, gram, True, group_bytes, fan).select(F.col("text_key").alias(key), F.col("first_id").alias(first), F.col("kept").cast("string").alias(left))
    joined = docs.withColumn(key, F.sha2(raw, 256)).join(found, key, "left")
    copy = (F.col(first) < F.col("doc_id")) & (F.octet_length(raw) >= length)
    text = F.when(F.col("text").isNull(), F.lit(None)).when(copy, F.lit("")).when(F.col(first) == F.col("doc_id"), F.col(left)).otherwise(F.col("text"))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False, group_bytes: int = GROUP_BYTES, fan: int = FAN
) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for every document, with ``kept`` as of ``repeats``.

    A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller id. A text equal to one
    of a smaller id goes whole, unless it is shorter than ``length``. A null text is empty; rows with a null id take no
    part and keep their text; repeated rows are judged alike, neither before the other. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary")).alias("_text"))
    rows = rows.select("doc_id", F.octet_length("_text").cast("long").alias("n_bytes"), F.sha2("_text", 256).alias("text_key"))
    found = rows.join(repeats(docs, length, gram, with_text, group_bytes, fan), "text_key", "left")
    copy = F.coalesce((F.col("first_id") < F.col("doc_id")) & (F.col("n_bytes") >= length), F.lit(False))
    own = F.coalesce(F.col("first_id") == F.col("doc_id"), F.lit(False))
    nothing = F.sha2(F.lit(b"").cast("binary"), 256)

    def pick(whole: Column, judged: Column, untouched: Column) -> Column:
        return F.when(copy, whole).when(own, judged).otherwise(untouched)

    out = found.select(
        "doc_id",
        "n_bytes",
        pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(nothing, F.col("kept_sha256"), F.col("text_key")).alias("kept_sha256"),
        pick(F.lit(b"").cast("binary"), F.col("kept"), F.lit(None)).alias("kept"),
    )
    return out if with_text else out.drop("kept")
