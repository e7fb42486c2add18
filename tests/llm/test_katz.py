"""The Katz model against a plain dictionary version, and its normalisation."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmill.llm import katz
from labelmill.llm.common import give_back
from labelmill.llm.katz import RELIABLE


def brute(docs, order=2):
    """Scores from the definition, one token at a time; a gram is a tuple, "<s>" the start of a text, None its end."""
    texts = {i: [*(t or "").encode().lower().split(), None] for i, t in docs}
    train = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i in texts}

    def grams(words, n):
        padded = words if n == 1 else ["<s>", *words]
        return [tuple(padded[k : k + n]) for k in range(len(padded) - n + 1)]

    tables = {n: Counter(g for i, words in texts.items() if train[i] for g in grams(words, n)) for n in range(1, order + 1)}
    total = sum(tables[1].values())
    factors = {}
    for n, table in tables.items():
        seen = Counter(table.values())
        factors[n] = katz.discounts([float(seen[r]) for r in range(1, RELIABLE + 2)])

    def cut(gram):
        c, d = tables[len(gram)][gram], factors[len(gram)]
        return c * (d[c] if c <= RELIABLE else 1.0)

    kept = sum(map(cut, tables[1]))
    unknown = max(1 - kept / total, 1 / (total + 1)) if total else 1.0
    followers, weights = {}, {}
    for n in range(2, order + 1):
        for gram in tables[n]:
            followers.setdefault(gram[:-1], []).append(gram[-1])

    def conditional(h, w):
        if not h:
            return cut((w,)) * (1 - unknown) / kept if tables[1][w,] else unknown
        if h not in weights:
            return conditional(h[1:], w)
        return cut((*h, w)) * weights[h][0] if tables[len(h) + 1][(*h, w)] else weights[h][1] * conditional(h[1:], w)

    for h in sorted(followers, key=len):
        count, own = (sum(f((*h, w)) for w in followers[h]) for f in (tables[len(h) + 1].get, cut))
        left = max(1 - own / count, 0.5 / (count + 1))
        weights[h] = ((1 - left) / own, left / (1 - sum(conditional(h[1:], w) for w in followers[h])))

    out = {}
    for i, words in texts.items():
        base = sum(math.log10((tables[1][w,] + 1) / (total + 1 * (len(tables[1]) + 1))) for w in words)
        padded = ["<s>", *words]
        score = sum(math.log10(conditional(tuple(padded[max(0, k - order + 2) : k + 1]), w)) for k, w in enumerate(words))
        out[i] = (not train[i], len(words), sum(tables[1][w,] > 0 for w in words), total, base, score)
    return out, weights, conditional, [w for (w,) in tables[1]]


def random_docs(seed, n=60, vocabulary=40):
    rng = np.random.default_rng(seed)
    words = [f"w{int(k)}" for k in range(vocabulary)]
    shares = 1 / np.arange(1, vocabulary + 1)
    return [(i, " ".join(rng.choice(words, int(rng.integers(0, 40)), p=shares / shares.sum()))) for i in range(n)]


@pytest.mark.parametrize(("partitions", "order"), [(1, 2), (3, 2), (16, 2), (1, 3), (16, 3), (5, 1), (4, 4)])
def test_like_brute_force(spark, partitions, order):
    docs = [*random_docs(7), (60, None), (61, ""), (62, "Only Once é"), (63, "a " * 500)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = katz.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), order=order).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    expected = brute(docs, order)[0]
    assert len(rows) == len(docs)
    for row in rows:
        assert tuple(row)[1:5] == expected[row.doc_id][:4]
        assert row.base_score == pytest.approx(expected[row.doc_id][4], rel=1e-9)
        assert row.score == pytest.approx(expected[row.doc_id][5], rel=1e-9)


def test_null_and_shared_ids(spark):
    """Each row is scored by its own text, as if all had ids of their own."""
    own = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2]
    texts = [text for _, text in random_docs(5, 24)]
    ids = [None, 0, 7, 7, None, None, *range(10, 28)]
    rows = katz.score(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3), F.lit(True)).collect()
    scores = brute(list(zip(own, texts)), katz.ORDER)[0]
    expected = [(i, *scores[k][:4], round(scores[k][5], 6)) for i, k in zip(ids, own)]
    assert sorted(map(repr, ((*tuple(r)[:5], round(r.score, 6)) for r in rows))) == sorted(map(repr, expected))


@pytest.mark.parametrize("order", [2, 3])
def test_distributions_sum_to_one(order):
    _, weights, conditional, one = brute(random_docs(3), order)
    for history in weights:
        assert sum(conditional(history, w) for w in one) + conditional(history, "never seen") == pytest.approx(1)


def test_empty_and_untrained(spark):
    assert katz.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = [(i, "a b c") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = katz.score(spark.createDataFrame(held, "doc_id long, text string")).collect()
    assert len(rows) == len(held) and all(r.held_out and r.n_known == 0 and r.score == 0 for r in rows)


@pytest.mark.parametrize("order", [2, 3])
def test_stored_tables_score_other_documents(spark, tmp_path, order):
    """A model that was saved and loaded scores documents it was not counted with, as if they had been held out."""
    everything = [*random_docs(11, 90), (90, None), (91, "never seen words"), (92, "w0 w1 never w0 w1 w2")]
    held = {i for i, _ in everything if zlib.crc32(str(i).encode()) % 7 == 2}
    learned = [(i, t) for i, t in everything if i not in held]
    others = [(i, t) for i, t in everything if i in held]
    schema = "doc_id long, text string"
    katz.save(katz.fit(spark.createDataFrame(learned, schema).repartition(3), order=order), str(tmp_path / "model"))
    model = katz.load(spark, str(tmp_path / "model"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 3)  # a model keeps its own buckets
    try:
        rows = katz.score_with(model, spark.createDataFrame(others, schema)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    expected = brute(everything, order)[0]
    assert sorted(r.doc_id for r in rows) == sorted(held)
    for row in rows:
        assert tuple(row)[1:4] == expected[row.doc_id][:3] and row.train_tokens == expected[row.doc_id][3]
        assert row.score == pytest.approx(expected[row.doc_id][5], rel=1e-9)


def test_tables_hold_training_grams_once(spark):
    """Histories, words and counts in the stored tables are those of a plain count."""
    docs = random_docs(13)
    model = katz.fit(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), F.lit(True), order=3)
    for level in (2, 3):
        kept = [katz._Counts.kept(row.asDict(), model) for row in model.tables[level].collect()]
        words = [["<s>", *(t or "").split(), None] for _, t in docs]
        plain = Counter(tuple(some[k : k + level]) for some in words for k in range(len(some) - level + 1))
        assert sorted(int(c) for table in kept for c in table.totals) == sorted(plain.values())
    assert {row["kind"] for row in model.tables[3].collect()} == {katz.TABLE}


def test_repeated_rows_and_clashing_columns(spark):
    text = "one two three one two"
    docs = spark.createDataFrame([(0, text, 1, b"x"), (0, text, 2, b"y"), (8, None, None, None)], "doc_id long, text string, run int, train binary")
    rows = katz.score(docs, F.lit(True)).collect()
    assert len(rows) == 3 and rows[0].train_tokens == 13
    assert len({round(r.score, 9) for r in rows if r.doc_id == 0}) == 1


def test_freed_memory_goes_back_to_the_system():
    """A block at the end of the heap keeps the allocator from returning what was freed before it."""
    psutil = pytest.importorskip("psutil")
    blocks = [np.ones(2_000) for _ in range(15_000)]
    kept = blocks[-1]
    full = psutil.Process().memory_info().rss
    del blocks
    give_back()
    assert full - psutil.Process().memory_info().rss > 150 << 20 and kept.sum() == 2_000
