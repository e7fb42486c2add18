"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel compares two words by their subsequences of three symbols; a subsequence counts less the longer the stretch it
covers, so inserted characters and gaps weaken a match instead of ending it. Words are mapped to kernel values with
landmark words, whitened by the landmarks' own kernel matrix, and a linear support vector machine is trained there. As
the kernel is a dot product of weighted subsequence counts, the trained machine folds into one weight per subsequence, so
scoring needs no landmark any more. A document scores as its worst word: labels are on documents, so training picks in
each toxic document the word that the machine of the round before finds worst.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import chunked, give_back, hold, narrow

# Symbols of the kernel's alphabet, weight of one step in a stretch, and the longest stretch.
SYMBOLS, DECAY, STRETCH = 64, 0.6, 6
# Symbols of a part, and from one part of a word to the next: a word scores as its worst part, so that an ending does not
# dilute a stem.
PART, STEP = 8, 2
# Bound of the labelled sample: documents of each label. Nothing of a sampled document is left out.
SAMPLE_TOXIC, SAMPLE_CLEAN = 3_000, 6_000
LANDMARKS, ROUNDS = 256, 6
# Log likelihood ratio from which a part counts as a witness by itself.
SURE = 8.0
# Score from which a document is predicted toxic.
THRESHOLD = 0.7
# Word scores a task keeps.
CACHE_WORDS = 1_000_000

_STEPS = [(a, b) for b in range(2, STRETCH) for a in range(1, b)]

# Symbols: 0 pads, 1 to 26 are the letters a to z, 27 any digit, 28 marks word ends; the code points beyond ASCII share the
# rest in turn, so the letters of one alphabet differ from each other.
_DIGIT, _END, _OTHERS = 27, 28, 29


def _symbol(point: int) -> int:
    if point >= 0x80:
        return _OTHERS + point % (SYMBOLS - _OTHERS)
    return point - 96 if 97 <= point <= 122 else _DIGIT


_SYMBOLS = bytes(_symbol(ord(chr(b).lower())) for b in range(0x80)) + bytes(0x80)
# Inside a word, ASCII that is neither letter nor digit is dropped: it only separates the letters of a word.
_DROPPED = bytes(b for b in range(0x80) if not chr(b).isalnum())


def _single(word: bytes) -> bool:
    return len(word) == 1 or 1 < len(word) < 5 and word[0] >= 0xC0 and not any(0xC0 <= b or b < 0x80 for b in word[1:])


def words_of(text: bytes) -> list[bytes]:
    """Words as letters and digits only, lower case; runs of single characters are put together as one word."""
    out: list[bytes] = []
    singles: list[bytes] = []
    lower = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    for word in lower.split():
        word = word.translate(None, _DROPPED)
        if len(word) < 5 and word and _single(word):
            singles.append(word)
            continue
        if singles:
            if len(singles) > 2:
                out.append(b"".join(singles))
            singles = []
        if word:
            out.append(word)
    if len(singles) > 2:
        out.append(b"".join(singles))
    return out


def parts_of(word: bytes) -> list[bytes]:
    """A word's overlapping stretches of symbols, its ends marked, padded to equal length."""
    symbols = word.translate(_SYMBOLS) if word.isascii() else bytes(map(_symbol, map(ord, word.decode("utf-8", "replace"))))
    marked = bytes((_END, *symbols, _END))
    if len(marked) <= PART:
        return [marked.ljust(PART, b"\0")]
    last = len(marked) - PART
    return [marked[start : start + PART] for start in range(0, last, STEP)] + [marked[last:]]


def rows_of(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.uint8).reshape(-1, PART).astype(np.int32)


def _terms(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For every shape of a subsequence: the codes at each place, which of them count, and their weight."""
    for a, b in _STEPS:
        first, middle, last = rows[:, : PART - b], rows[:, a : PART - b + a], rows[:, b:]
        yield (first * SYMBOLS + middle) * SYMBOLS + last, (last > 0) & (first > 0), DECAY**b


def _norms(rows: np.ndarray) -> np.ndarray:
    """Scale of a row, from its length alone: the weight of its subsequences if all were different."""
    total = np.zeros(len(rows))
    for _, counts, weight in _terms(rows):
        total += counts.sum(1) * weight**2
    return np.sqrt(np.maximum(total, 1e-9))


def feature_sums(rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Dot product of each row's scaled subsequence counts with a weight per subsequence."""
    total = np.zeros(len(rows))
    for codes, counts, weight in _terms(rows):
        total += weight * np.where(counts, table[codes], 0.0).sum(1)
    return total / _norms(rows)


def codes_of(rows: np.ndarray) -> np.ndarray:
    """The distinct subsequences of the rows, in order."""
    return np.unique(np.concatenate([codes[counts] for codes, counts, _ in _terms(rows)]))


def features(rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Scaled counts of the given subsequences, a column each; others are left out."""
    out = np.zeros((len(rows), len(codes) + 1))
    every = np.arange(len(rows))[:, None]
    for found, counts, weight in _terms(rows):
        at = np.searchsorted(codes, found)
        known = counts & (codes[np.minimum(at, len(codes) - 1)] == found)
        np.add.at(out, (np.broadcast_to(every, at.shape), np.where(known, at, len(codes))), weight)
    return out[:, :-1] / _norms(rows)[:, None]


@dataclass(frozen=True)
class Model:
    """A weight per subsequence, the offset, and slope and offset of the logistic scale for documents."""

    table: np.ndarray
    offset: float
    slope: float
    shift: float

    def part_scores(self, parts: list[bytes]) -> np.ndarray:
        found = [feature_sums(rows_of(parts[start : start + 16_384]), self.table) for start in range(0, len(parts), 16_384)]
        return np.concatenate(found or [np.empty(0)]) + self.offset

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        parts = list(map(parts_of, words))
        if not parts:
            return np.empty(0)
        starts = np.concatenate(([0], np.cumsum([len(some) for some in parts])[:-1]))
        return np.maximum.reduceat(self.part_scores([part for some in parts for part in some]), starts)

    def probability(self, worst: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.slope * worst + self.shift))))


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 60) -> np.ndarray:
    """Linear machine with squared hinge loss, by Newton steps on the rows inside the margin; last weight: offset."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], 1.0)
    keep[-1] = 1e-6

    def loss(v):
        return 0.5 * keep @ (v * v) + cost @ np.maximum(0.0, 1.0 - y * (x @ v)) ** 2

    for _ in range(steps):
        inside = y * (x @ w) < 1
        a = x[inside] * cost[inside, None]
        gradient = keep * w - 2 * a.T @ (y[inside] - x[inside] @ w)
        step = np.linalg.solve(np.diag(keep) + 2 * a.T @ x[inside], gradient)
        size, now = 1.0, loss(w)
        while loss(w - size * step) > now - 1e-4 * size * gradient @ step and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability, by Newton steps with targets kept off 0 and 1."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -60, 60)))
        r, h = p - target, p * (1 - p) + 1e-9
        g = np.array([r @ x + 1e-3 * a, r.sum()])
        m = np.array([[h @ (x * x) + 1e-3, h @ x], [h @ x, h.sum() + 1e-9]])
        da, db = np.linalg.solve(m, g)
        size = min(1.0, 2.0 / (abs(da) + 1e-9))
        a, b = a - size * da, b - size * db
        if abs(da) + abs(db) < 1e-8:
            break
    return max(a, 1e-3), b


def train(bags: Iterable[list[bytes]], toxic: list[bool], landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Model:
    """From the distinct words of labelled documents. One label only: every document scores 0 or every one 1.

    ``bags`` is read once; what stays of a document is one number per distinct part.
    """
    if not any(toxic) or all(toxic):
        return Model(np.zeros(SYMBOLS**3), 0.0, 0.0, 12.0 if any(toxic) else -12.0)
    units: dict[bytes, int] = {}
    once: set[bytes] = set()
    inside, kept = [], []
    for bag, is_toxic in zip(bags, toxic, strict=True):
        # equal bags of words are one example
        digest = hashlib.sha256(b" ".join([b"01"[is_toxic : is_toxic + 1], *bag])).digest()
        if digest not in once:
            once.add(digest)
            inside.append(np.array(sorted({units.setdefault(part, len(units)) for word in bag for part in parts_of(word)}), np.int32))
            kept.append(is_toxic)
    toxic, label = kept, np.array(kept)
    parts = list(units)
    del units, once
    if not parts:
        return Model(np.zeros(SYMBOLS**3), 0.0, 0.0, -12.0)
    sizes = np.array([len(bag) for bag in inside])
    flat, own = np.concatenate(inside), np.repeat(label, sizes)
    in_toxic, in_clean = (np.bincount(flat[own == side], minlength=len(parts)).astype(float) for side in (True, False))
    share = label.mean()
    rate = np.clip(in_toxic / (in_toxic + in_clean), 1e-9, 1 - 1e-9)
    # log likelihood ratio of a part's toxic share against chance
    surprise = np.where(rate > share, in_toxic * np.log(rate / share) + in_clean * np.log((1 - rate) / (1 - share)), 0.0)
    usual = np.argsort(-in_clean, kind="stable")
    marked = np.argsort(-surprise, kind="stable")[: landmarks // 2]
    chosen = list(dict.fromkeys([*marked.tolist(), *usual.tolist()]))[:landmarks]
    landmark_rows = rows_of([parts[i] for i in chosen])
    # only subsequences that a landmark has count in a kernel with one
    codes = codes_of(landmark_rows)
    z = features(landmark_rows, codes)
    values, vectors = np.linalg.eigh(z @ z.T)
    # the map of a part is its kernel with the landmarks, whitened: column j of this table gives coordinate j
    to_map = z.T @ (vectors / np.sqrt(np.maximum(values, 1e-3)))
    del z

    # in each toxic document, the parts that tell it from chance about as well as its best one does
    sure: dict[int, int] = {}
    for bag, is_toxic in zip(inside, toxic, strict=True):
        if len(bag) and is_toxic:
            best = surprise[bag].max()
            for i in bag[surprise[bag] >= max(SURE, 0.3 * best)].tolist():
                sure[i] = sure.get(i, 0) + 1
    scores, model = surprise, None
    hard: set[int] = set(usual[:2000].tolist())
    for _ in range(rounds):
        picked = dict(sure)
        for bag, is_toxic in zip(inside, toxic, strict=True):
            if len(bag) and is_toxic:
                worst = int(bag[np.argmax(scores[bag])])
                picked[worst] = picked.get(worst, 0) + 1
            elif len(bag) and model:
                hard.update(bag[np.argsort(-scores[bag], kind="stable")[:2]].tolist())
        # a part that is mostly met in clean documents is no witness
        good = [i for i in picked if rate[i] > 0.9]
        bad = sorted(i for i in hard if in_clean[i])
        if not good or not bad:
            break
        rows = rows_of([parts[i] for i in good + bad])
        mapped = np.vstack([features(rows[k : k + 512], codes) @ to_map for k in range(0, len(rows), 512)])
        y = np.concatenate([np.ones(len(good)), -np.ones(len(bad))])
        weight = np.concatenate([np.minimum(20.0, [picked[i] for i in good]), np.minimum(5.0, in_clean[bad])])
        w = _svm(mapped, y, weight)
        table = np.zeros(SYMBOLS**3)
        table[codes] = to_map @ w[:-1]
        model = Model(table, float(w[-1]), 1.0, 0.0)
        scores = model.part_scores(parts)
    if model is None:
        return Model(np.zeros(SYMBOLS**3), 0.0, 0.0, -12.0)
    worst = np.array([scores[bag].max() if len(bag) else -3.0 for bag in inside])
    slope, shift = _logistic(worst, label.astype(float))
    return Model(model.table, model.offset, slope, shift)


def labelled_sample(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> DataFrame:
    """``(doc_id, toxic, text)``: the labelled documents that may be learned from, up to a bound per label, by hash order.

    Rows whose crc32(doc_id as text) mod 3 is 1 are held out. Null labels and ids are no labels. The choice is made on
    the narrow table of labels, so that only chosen texts move.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = known.where("toxic = 1").orderBy(order).limit(toxic).unionByName(known.where("toxic = 0").orderBy(order).limit(clean))
    # at most toxic + clean rows
    return narrow(docs).join(F.broadcast(chosen), "doc_id")


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def fit(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> Model:
    """Train on the bounded labelled sample; only distinct words of the sample come to the driver."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("toxicity")
        for batch in batches:
            found = [b" ".join(sorted(set(words_of(text)))) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "words": pa.array(found, pa.binary())})

    sample = labelled_sample(docs, labels, toxic, clean).select("doc_id", "toxic", "text")
    rows = sorted((row["doc_id"], row["toxic"], bytes(row["words"])) for row in sample.mapInArrow(bags, "doc_id long, toxic int, words binary").collect())
    labels_ = [bool(label) for _, label, _ in rows]
    rows.reverse()
    # a document's words are let go once they are read
    model = train((rows.pop()[2].split() for _ in labels_), labels_)
    give_back()
    return model


def worst_words(texts: list[bytes], model: Model, known: dict[bytes, float]) -> list[tuple[bytes, float] | None]:
    """The word of each text that scores highest, and its score; ``known`` keeps the scores of words.

    The words of a bounded run of texts, or of one longer text, are held at a time.
    """
    out: list[tuple[bytes, float] | None] = []
    for _, some in chunked(range(len(texts)), texts):
        bags = [words_of(text) for text in some]
        if len(known) > CACHE_WORDS:
            known.clear()
        fresh = list({word for bag in bags for word in bag}.difference(known))
        known.update(zip(fresh, model.word_scores(fresh).tolist(), strict=True))
        for bag in bags:
            word = max(bag, key=known.__getitem__) if bag else None
            out.append(None if word is None else (word, known[word]))
    return out


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted, worst_word)`` for every document, whole texts.

    A null, empty or wordless text has no word to blame and scores as the clean side of the scale. Repeated rows give
    repeated rows; an empty table gives none. Nothing is shuffled; the model is a table of fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("toxicity")
        own = shared.value
        known: dict[bytes, float] = {}
        for batch in batches:
            worst = worst_words(batch.column("text").to_pylist(), own, known)
            scores = [0.0 if found is None else own.probability(found[1]) for found in worst]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "score": pa.array(scores, pa.float64()),
                    "worst_word": pa.array([None if found is None else found[0].decode("utf-8", "replace") for found in worst], pa.string()),
                }
            )

    rows = narrow(docs).mapInArrow(run, "doc_id long, score double, worst_word string")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "worst_word")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that are not predicted toxic. Rows are dropped where they are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("toxicity")
        own, known = shared.value, {}
        for batch in batches:
            worst = worst_words([(text or "").encode() for text in batch.column("text").to_pylist()], own, known)
            keep = [found is None or own.probability(found[1]) < threshold for found in worst]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
