"""Exact top-k, fill-in-the-middle and the filter audit against plain versions."""

import hashlib
import math
import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from labelmill.llm import exact_topk, fill_middle, filter_audit

VECTORS = "vec_id long, embedding array<double>, vec int, list string, q int, values string, ids int, n int, h string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", None, None, 2, 3, "h") for i, v in rows], VECTORS).repartition(3)


def brute_topk(rows, k, scale=1024, every=100):
    def components(vector):
        if vector is None or any(x is None or not math.isfinite(x) for x in vector):
            return None
        return [max(-(2**53), min(2**53, math.floor(x * scale))) for x in vector]

    known = [(i, components(v)) for i, v in rows]
    known = [(i, v) for i, v in known if v is not None]
    out = []
    for at, (i, vector) in enumerate(known):
        if i is None or i % every:
            continue
        others = [(-sum(x * y for x, y in zip(vector, w)), j is None, j or 0, j) for b, (j, w) in enumerate(known) if b != at]
        for rank, (score, _, _, j) in enumerate(sorted(others, key=lambda o: o[:3])[:k], 1):
            out.append((i, rank, j, max(-(2**63), min(2**63 - 1, -score))))
    return sorted(out, key=repr)


def searched(spark, rows, **options):
    return sorted(map(tuple, exact_topk.search(vectors_of(spark, rows), F.col("vec_id") % 100 == 0, **options).collect()), key=repr)


@pytest.mark.parametrize("lists", [1, 2, 3])
def test_topk_like_brute_force(spark, lists):
    rng = random.Random(lists)
    rows = [(i, [rng.gauss(0, 1) for _ in range(10)]) for i in range(350)]
    hot = [1.0] * 10
    rows += [(i, hot) for i in range(395, 460)]
    # ties, repeated rows, a shared id, rows without an id, and rows that take no part
    rows += [(500, hot), (500, hot), (600, [0.5] * 10), (601, [0.5] * 10), (None, hot), (None, [0.1] * 10), (700, None), (701, [None] * 10)]
    rows += [(800, [math.nan] * 10), (801, [math.inf] + [0.0] * 9), (900, []), (901, [2.0, 3.0]), (1000, [-1.0] * 10)]
    assert searched(spark, rows, k=10, lists=lists) == brute_topk(rows, 10)


def test_topk_in_several_passes_and_small_tables(spark):
    rng = random.Random(9)
    rows = [(100 * i, [float(rng.randrange(3)) for _ in range(4)]) for i in range(60)]
    assert searched(spark, rows, k=5, scale=1, pass_bytes=400) == brute_topk(rows, 5, 1)
    few = [(0, [1.0, 2.0]), (7, [3.0, 1.0])]
    assert searched(spark, few) == brute_topk(few, 10) == [(0, 1, 7, 1024 * 1024 * 5)]
    assert searched(spark, [(0, [1.0])]) == []
    assert exact_topk.search(vectors_of(spark, few).limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert searched(spark, [(1, [1.0]), (2, [2.0])]) == []


def test_topk_of_huge_components(spark):
    rng = random.Random(4)
    rows = [(i * 50, [rng.choice([1e-3, 1.0, 1e9, -1e12, 1e300]) * rng.random() for _ in range(5)]) for i in range(40)]
    assert searched(spark, rows, k=6) == brute_topk(rows, 6)


def test_share_of_the_cutoff_loses_nothing(spark):
    """A vector just above the cutoff whose local scores are as even as can be."""
    rows = [(0, [1.0, 1.0, 1.0]), *[(i, [2.0, 0.0, 0.0]) for i in range(1, 5)], (9, [0.67, 0.67, 0.67]), (10, [0.66, 0.66, 0.66])]
    assert searched(spark, rows, k=5, lists=3, scale=100) == brute_topk(rows, 5, 100)


TEXTS = [
    None, "", "a", "ab", "naïve café ☕ 𝄞𝄞 end", "with <P> inside", "x<S>", "<M>", "<", "<P", "S>", "a<b>c<", "\x00\x01", "é" * 50, "word " * 5000, "<<P<" * 40,
]
WIDE = "doc_id long, text string, frames string, starts int, units int, marked string, form int, output string"


def wide(spark, rows):
    return spark.createDataFrame([(i, t, "f", 1, 2, "m", 3, "o") for i, t in rows], WIDE).repartition(2)


def brute_fim(doc_id, text, rule=fill_middle.Rule()):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:low], text[low:high], text[high:]
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", low, high - low, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", low, high - low, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("units", [1, 3, 1 << 14])
def test_fill_middle(spark, units):
    rows = [(i + 100 * j, t) for i, t in enumerate(TEXTS) for j in range(8)] + [(None, "no id here"), (5, "shared id"), (5, "shared id"), (4, "other text")]
    rows = [(i, t) for i, t in rows if units > 1 or len(t or "") < 1000]
    frames = fill_middle.store_frames(wide(spark, rows), units)
    out = fill_middle.transform(frames, with_text=True)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n, r.form, r.prefix_chars, r.middle_chars, bytes(r.output), r.output_sha256, r.restored_sha256) for r in out.collect())
    expected = []
    for i, t in rows:
        *start, text = brute_fim(i, t)
        data = text.encode()
        expected.append((i is None, i or 0, *start, data, hashlib.sha256(data).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert {row[3] for row in got} == {"plain", "psm", "spm"}
    back = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.text).decode()) for r in fill_middle.restore(out).collect())
    assert back == sorted((i is None, i or 0, t or "") for i, t in rows)
    assert "output" not in fill_middle.transform(frames).columns


def test_frames_are_cut_and_found(spark):
    text = "".join(chr(0x400 + i % 500) for i in range(1000))
    frames = fill_middle.store_frames(wide(spark, [(1, text), (2, None)]), 64)
    row = frames.where("doc_id = 1").first()
    assert row.starts == list(range(0, 1000, 64)) and len(row.frames) == 16 and row.units == 1000
    ranges = spark.createDataFrame([(1, 60, 130), (1, 0, 64), (1, 990, 5000), (1, 7, 7), (1, None, 3), (2, 0, 9), (3, 0, 1)], "doc_id long, start long, stop long")
    got = {(r.doc_id, r.start, r.stop): None if r.text is None else bytes(r.text).decode() for r in fill_middle.slices(frames, ranges).collect()}
    assert got == {(1, 60, 130): text[60:130], (1, 0, 64): text[:64], (1, 990, 5000): text[990:], (1, 7, 7): "", (1, None, 3): None, (2, 0, 9): ""}
    # only the frames that a range touches are opened
    opened = fill_middle.Frames(row.starts, row.units, [bytes(f) if i in (0, 1, 2) else b"not a frame" for i, f in enumerate(row.frames)])
    assert b"".join(opened.pieces(60, 130)).decode() == text[60:130]


def test_fill_middle_of_nothing_and_of_odd_bytes(spark):
    none = wide(spark, [(1, "x")]).limit(0)
    assert fill_middle.transform(fill_middle.store_frames(none)).count() == 0
    odd = spark.createDataFrame([(i, b"ab\xff\xfe" + bytes([0xC3]) + b"z" * i) for i in range(6)], "doc_id long, text binary")
    for r in fill_middle.transform(fill_middle.store_frames(odd, 2)).collect():
        assert r.n == 5 + r.doc_id and r.restored_sha256 == hashlib.sha256(b"ab\xff\xfe\xc3" + b"z" * r.doc_id).hexdigest()


def brute_audit(rows, labels):
    def fails(at):
        i, text, _ = rows[at]
        text = text or ""
        words = text.encode().split()
        later = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)
        return {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": later,
        }

    failing = [fails(at) for at in range(len(rows))]
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, bad in labels if bad == 1 and i is not None}
    out = {}
    for part in {lang or "" for _, _, lang in rows}:
        own = [at for at, row in enumerate(rows) if (row[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = set(own)
            for step, letter in enumerate(order, 1):
                gone = {at for at in left if failing[at][letter]}
                redundant = sum(failing[at][letter] for at in own if at not in left)
                left -= gone
                unique = sum(failing[at][letter] and sum(failing[at].values()) == 1 for at in own)
                shapley[letter] += len(gone)
                lost = [sum(rows[at][0] in which for at in gone) for which in (good, toxic)]
                out[part, "".join(order), step] = [len(left), len(gone), redundant, unique, *lost, letter]
        for (p, _, _), row in out.items():
            if p == part:
                row.insert(6, shapley[row[-1]])
    return {key: tuple(row) for key, row in out.items()}


def audit_rows(seed=3):
    rng = random.Random(seed)

    def text():
        words = [rng.choice(["the", "Sea", "IS", "calm", "a$b", f"w{rng.randrange(400)}"][rng.randrange(2) * 2 :]) for _ in range(rng.choice([5, 150, 199, 200, 300]))]
        return rng.choice([" ", "\n", "  "]).join(words)

    texts = [text() for _ in range(25)]
    rows = [(i, rng.choice([*texts, None, "", " \t"]), rng.choice(["en", "de", None, ""])) for i in range(120)]
    return [*rows, (0, rows[0][1], "en"), (3, "another", "en"), (None, texts[0], "de"), (None, texts[0], "de"), (7, "É" * 300, "fr")]


def audit_table(spark, rows):
    schema = "doc_id long, text string, lang string, part string, mask int, text_key string, quality int, toxic string"
    return spark.createDataFrame([(i, t, lang, "p", 1, "k", 9, "x") for i, t, lang in rows], schema).repartition(3)


def test_filter_audit_like_brute_force(spark):
    rows = audit_rows()
    labels = [(i, (i * 7 % 3 == 0) * 1, (i * 5 % 4 == 0) * 1) for i in range(0, 120, 2)] + [(4, None, 1), (4, 1, None), (None, 1, 1), (9999, 1, 1), (0, 0, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(audit_table(spark, rows), table).collect()}
    assert got == brute_audit(rows, labels)
    assert len(got) == 600 * len({lang or "" for _, _, lang in rows})


def test_packed_outcomes_do_not_run_over():
    """Fields of exactly the width that the count needs, all full."""
    for n in (1, 255, 256, 65_535, 2**40 - 1):
        (_, _, _, kept, removed, *_), *_ = filter_audit.audited("p", [(31, n, n, n)])
        assert (kept, removed) == (0, n)
        rows = list(filter_audit.audited("p", [(31, n, 0, n), (0, 1, 1, 0), (4, 3, 0, 0)]))
        assert len(rows) == 600 and all(row[4] + row[5] == (n + 3 if row[-1] == "C" else n) for row in rows)
        assert all(row[6] == (3 if row[-1] == "C" else 0) for row in rows)


def test_filter_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(audit_table(spark, audit_rows()).limit(0), none).count() == 0
    assert {r.good_lost for r in filter_audit.audit(audit_table(spark, [(1, "a b", "en")]), none).collect()} == {0}
