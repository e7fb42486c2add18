"""Fill-in-the-middle over seekable compressed texts.

A text is stored as zstandard frames that stand alone, each with a fixed number of code points, together with the cumulative
counts of code points before each frame. A place in the text is found by its count, so choosing prefix, middle and suffix
decompresses the two frames that the cuts fall into, and digests of the output and of the restored text read frames in order,
one at a time. Only compressed frames of a document are held whole.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import stored, utf8

# Code points of a frame, and the compression level.
FRAME_UNITS, LEVEL = 1 << 14, 3

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

# How bytes that are no UTF-8 stay themselves, one unit each.
_ODD = "surrogateescape"


@dataclass(frozen=True)
class Rule:
    """Which documents are transformed and how: ``seed`` and id decide by SHA-256; shares are of a hundred."""

    seed: str = "1"
    transformed: int = 90
    suffix_first: int = 20

    def numbers(self, doc_id: int | None) -> tuple[int, int, int, int]:
        """Four unsigned 32-bit numbers; a null id has no digits."""
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
        return tuple(int.from_bytes(digest[4 * i : 4 * i + 4]) for i in range(4))

    def decide(self, doc_id: int | None, units: int, marked: bool) -> tuple[str, int, int]:
        """Form, and where prefix and middle end."""
        first, second, share, order = self.numbers(doc_id)
        if not units or marked or share % 100 >= self.transformed:
            return "plain", 0, 0
        low, high = sorted((first % (units + 1), second % (units + 1)))
        return ("spm" if order % 100 < self.suffix_first else "psm"), low, high


class Frames:
    """Random access to one stored text."""

    def __init__(self, starts: list[int], units: int, frames: list[bytes]):
        self.starts, self.units, self.frames = starts, units, frames
        self._open = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> str:
        return self._open.decompress(self.frames[number]).decode("utf-8", _ODD)

    def pieces(self, start: int, stop: int) -> Iterator[bytes]:
        """UTF-8 of code points ``start`` to ``stop``, a frame at a time; whole frames are passed on as they are."""
        at = max(0, bisect_right(self.starts, start) - 1)
        while at < len(self.frames) and self.starts[at] < stop:
            begin = self.starts[at]
            end = self.starts[at + 1] if at + 1 < len(self.starts) else self.units
            if start <= begin and end <= stop:
                yield self._open.decompress(self.frames[at])
            else:
                yield self.frame(at)[max(0, start - begin) : stop - begin].encode("utf-8", _ODD)
            at += 1


def framed(text: bytes, units: int = FRAME_UNITS, level: int = LEVEL) -> tuple[list[int], int, list[bytes]]:
    """Code points before each frame, of the whole text, and the frames."""
    packer = zstandard.ZstdCompressor(level=level)
    points = text.decode("utf-8", _ODD)
    if len(points) <= units:
        return ([0], len(points), [packer.compress(text)]) if points else ([], 0, [])
    starts = list(range(0, len(points), units))
    return starts, len(points), [packer.compress(points[at : at + units].encode("utf-8", _ODD)) for at in starts]


def store_frames(docs: DataFrame, units: int = FRAME_UNITS, level: int = LEVEL) -> DataFrame:
    """Every document as frames, written once to the shared folder: ``(doc_id, units, marked, starts, frames)``.

    ``marked`` says that the text holds one of the three marks. A null text is empty; an empty text has no frames. Rows are
    neither merged nor shuffled. Invalid bytes count as one unit each and come out unchanged.
    """
    marks = [mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                data = text.as_py()
                starts, total, frames = framed(data, units, level)
                rows.append((total, any(mark in data for mark in marks), starts, frames))
            kinds = {"units": pa.int64(), "marked": pa.bool_(), "starts": pa.list_(pa.int64()), "frames": pa.list_(pa.binary())}
            columns = {name: pa.array([row[i] for row in rows], kind) for i, (name, kind) in enumerate(kinds.items())}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | columns)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    return stored(narrow.mapInArrow(run, "doc_id long, units long, marked boolean, starts array<long>, frames array<binary>"), "text-frames")


def output(form: str, frames: Frames, low: int, high: int) -> Iterator[bytes]:
    """The transformed text in order, in pieces."""
    if form == "plain":
        yield from frames.pieces(0, frames.units)
        return
    prefix, suffix = (PREFIX, 0, low), (SUFFIX, high, frames.units)
    for mark, start, stop in (*((prefix, suffix) if form == "psm" else (suffix, prefix)), (MIDDLE, low, high)):
        yield mark.encode()
        yield from frames.pieces(start, stop)


def rebuilt(form: str, transformed: Iterator[bytes], hold) -> None:
    """Undo the transformation of a stream of pieces, from output and form alone.

    ``hold(section, piece)`` gets the bytes of the sections ``P``, ``S`` and ``M`` as they come; the text is P, M, S. Pieces
    may end anywhere, inside a mark too. The first place a mark stands is where its section begins: texts with marks are plain.
    """
    if form == "plain":
        for piece in transformed:
            hold("P", piece)
        return
    order = [(PREFIX, "P"), (SUFFIX, "S"), (MIDDLE, "M")] if form == "psm" else [(SUFFIX, "S"), (PREFIX, "P"), (MIDDLE, "M")]
    section, rest = None, b""
    for piece in transformed:
        rest += piece
        while order:
            mark, name = order[0][0].encode(), order[0][1]
            at = rest.find(mark)
            if at < 0:
                break
            if section:
                hold(section, rest[:at])
            rest, section = rest[at + len(mark) :], name
            order.pop(0)
        keep = 2 if order else 0
        if section and len(rest) > keep:
            hold(section, rest[: len(rest) - keep])
            rest = rest[len(rest) - keep :]
    if section:
        hold(section, rest)


class _Digest:
    """SHA-256 of P, M, S of a stream in which P comes before M: a suffix that comes too early waits compressed, in frames."""

    def __init__(self):
        self.own, self.waiting = hashlib.sha256(), []
        self._packer = zstandard.ZstdCompressor(level=1)

    def hold(self, section: str, piece: bytes) -> None:
        if section != "S":
            self.own.update(piece)
        elif piece:
            self.waiting.append(self._packer.compress(piece))

    def hexdigest(self) -> str:
        reader = zstandard.ZstdDecompressor()
        for frame in self.waiting:
            self.own.update(reader.decompress(frame))
        return self.own.hexdigest()


def transform(frames: DataFrame, rule: Rule = Rule(), with_text: bool = False) -> DataFrame:
    """Prefix, middle and suffix of every stored document, with digests of the output and of the text rebuilt from it.

    ``(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)``, with ``with_text`` the output itself as
    ``output`` (bytes, whole in memory then). A form ``plain`` has null lengths: empty texts, texts that hold a mark, and
    the share that the rule leaves. Rows that share an id, or have none, are cut at places by the same numbers, each in its own
    text; repeated rows give repeated rows; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, units, marked, starts, packed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "units", "marked", "starts", "frames")), strict=True):
                text = Frames(starts, units, packed)
                form, low, high = rule.decide(doc_id, units, marked)
                whole, own, parts = hashlib.sha256(), _Digest(), []

                def told(pieces: Iterator[bytes], whole=whole, parts=parts) -> Iterator[bytes]:
                    for piece in pieces:
                        whole.update(piece)
                        if with_text:
                            parts.append(piece)
                        yield piece

                if form == "plain":
                    # output and text are the same bytes
                    for _ in told(output(form, text, low, high)):
                        pass
                    restored = whole.hexdigest()
                else:
                    rebuilt(form, told(output(form, text, low, high)), own.hold)
                    restored = own.hexdigest()
                lengths = (None, None) if form == "plain" else (low, high - low)
                rows.append((doc_id, units, form, *lengths, whole.hexdigest(), restored, b"".join(parts) if with_text else None))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, output binary"
    names = [part.split()[0] for part in schema.split(", ")]
    out = frames.mapInArrow(run, schema)
    return out if with_text else out.drop("output")


def restore(transformed: DataFrame) -> DataFrame:
    """``(doc_id, text)`` as bytes, from ``output`` and ``form``; null where either is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for form, data in zip(batch.column("form").to_pylist(), batch.column("output").to_pylist(), strict=True):
                held: dict[str, list[bytes]] = {"P": [], "M": [], "S": []}
                if form is not None and data is not None:
                    rebuilt(form, iter([data]), lambda section, piece, held=held: held[section].append(piece))
                texts.append(None if form is None or data is None else b"".join(piece for section in "PMS" for piece in held[section]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.binary())})

    return transformed.select("doc_id", "form", "output").mapInArrow(run, "doc_id long, text binary")


def slices(frames: DataFrame, ranges: DataFrame) -> DataFrame:
    """``(doc_id, start, stop, text)``: code points ``start`` to ``stop`` of stored documents; other frames stay compressed.

    ``ranges`` holds ``(doc_id, start, stop)``; a range that reaches past the text ends there, a null bound gives no text. A document
    that is stored twice answers twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for start, stop, units, starts, packed in zip(*(batch.column(c).to_pylist() for c in ("start", "stop", "units", "starts", "frames")), strict=True):
                known = start is not None and stop is not None
                texts.append(b"".join(Frames(starts, units, packed).pieces(max(0, start), min(stop, units))) if known else None)
            columns = {c: batch.column(c) for c in ("doc_id", "start", "stop")}
            yield pa.RecordBatch.from_pydict(columns | {"text": pa.array(texts, pa.binary())})

    wanted = ranges.select(*(F.col(c).cast("long").alias(c) for c in ("doc_id", "start", "stop")))
    return wanted.join(frames, "doc_id").select("doc_id", "start", "stop", "units", "starts", "frames").mapInArrow(run, "doc_id long, start long, stop long, text binary")
