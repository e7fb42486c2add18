"""Token counts under edits: the tree stays balanced, and stored trees give what a whole recount gives."""

import random

import pytest
from pyspark.sql import functions as F

from labelmill.llm import token_counts
from labelmill.llm.bpe import coder, default_path, default_pattern

BITS = [" ", "  ", "\n", "word", "ing", "é", "1", "23", ".", "Ab", "\t x", "—"]


@pytest.fixture(scope="module")
def own():
    return coder(default_path(), default_pattern())


def any_text(rng, n):
    return "".join(rng.choice(BITS) for _ in range(n))


def sound(tree):
    """Sums, sizes, links and parents of the whole tree."""
    depths = set()

    def walk(node, depth):
        if isinstance(node, token_counts._Leaf):
            depths.add(depth)
            assert node.chars == sum(map(len, node.chunks)) and len(node.chunks) <= tree.most
            return [node]
        assert node.chars == sum(k.chars for k in node.kids) and node.tokens == sum(k.tokens for k in node.kids)
        assert 1 <= len(node.kids) <= tree.most and all(k.parent is node for k in node.kids)
        return [leaf for kid in node.kids for leaf in walk(kid, depth + 1)]

    found = walk(tree.root, 0)
    assert len(depths) == 1 and found == list(tree.leaves())
    assert all(x.next is y and y.prev is x for x, y in zip(found, found[1:])) and found[0].prev is None and found[-1].next is None
    return found


@pytest.mark.parametrize("segment", [2, 4, 32])
def test_random_edits(own, segment):
    rng = random.Random(segment)
    for size in (0, 1, 40, 400):
        text = any_text(rng, size)
        tree = token_counts.CountTree(text, own, segment)
        for step in range(120):
            a = rng.randrange(len(text) + 1)
            b = min(len(text), a + rng.choice([0, 0, 1, 5, 40, 300]))
            new = any_text(rng, rng.choice([0, 1, 3, 30, 200]))
            text = text[:a] + new + text[b:]
            assert tree.replace(a, b, new) == len(own.encode(text))
            if step % 10 == 0:
                assert tree.text() == text
                sound(tree)
        assert tree.replace(0, len(text), "") == 0 and tree.text() == ""
        sound(tree)


def test_ten_thousand_edits_leave_segments_small_and_cheap(own):
    rng = random.Random(1)
    tree = token_counts.CountTree("some words to begin with " * 400, own)
    worst = 0
    for step in range(10_000):
        before = tree.counted
        place = 5_000 if step % 2 else rng.randrange(tree.length)
        tree.replace(place, place + (step % 5 == 0), rng.choice([" ab", "c", " d e", ""]))
        worst = max(worst, tree.counted - before)
    found = sound(tree)
    assert max(len(leaf.chunks) for leaf in found) <= 2 * token_counts.SEGMENT
    assert sum(len(leaf.chunks) < token_counts.SEGMENT // 2 for leaf in found) < 0.2 * len(found)
    assert worst < 12 and tree.total == len(own.encode(tree.text()))


def test_bad_edits_have_a_status(spark):
    text = "one two three four"
    changes = {
        1: [(0, 3, "1")], 2: [(4, 7, "2"), (0, 3, "1")], 3: [(0, 99, "x")], 4: [(-1, 2, "x")], 5: [(0, 5, "x"), (3, 8, "y")], 6: [(5, 2, "x")],
        7: [(None, 2, "x")], 8: None, 9: [], 10: [(3, 3, "a"), (3, 3, "b")], 11: [(0, 3, None)], 12: [None],
    }
    rows = [(i, text, some) for i, some in changes.items()] + [(1, text, changes[1]), (None, None, [(0, 0, "new")])]
    schema = "doc_id long, text string, edits array<struct<start:int,stop:int,new:string>>, status string"
    docs = spark.createDataFrame([(*row, "x") for row in rows], schema)
    own_ = coder(default_path(), default_pattern())
    got = [(r.doc_id, r.status, r.n_edits, r.n_tokens, r.n_tokens_edited) for r in token_counts.count_edited(docs, F.col("edits")).collect()]
    whole = len(own_.encode(text))

    def edited(new):
        return len(own_.encode(new))

    expected = {
        1: ("ok", 1, edited("1 two three four")), 2: ("ok", 2, edited("1 2 three four")), 3: ("outside", 0, whole), 4: ("outside", 0, whole), 5: ("overlap", 0, whole),
        6: ("outside", 0, whole), 7: ("outside", 0, whole), 8: ("ok", 0, whole), 9: ("ok", 0, whole), 10: ("ok", 2, edited("oneab two three four")),
        11: ("ok", 1, edited(" two three four")), 12: ("ok", 0, whole),
    }
    assert sorted(got, key=repr) == sorted([(i, s, n, whole, t) for i, (s, n, t) in [*expected.items(), (1, expected[1])]] + [(None, "ok", 1, 0, edited("new"))], key=repr)
    assert token_counts.count_edited(docs.limit(0), F.col("edits")).count() == 0


@pytest.mark.parametrize("segment", [1, 3, 32])
def test_stored_trees(spark, own, segment):
    rng = random.Random(10 * segment)
    texts = {i: any_text(rng, rng.choice([0, 3, 60, 400])) for i in range(30)} | {40: None, 41: "plain"}
    docs = spark.createDataFrame([*texts.items(), (None, "no id")], "doc_id long, text string").repartition(3)
    trees = token_counts.store_trees(docs, segment=segment)
    rows, expected = [(99, 0, 0, "unknown"), (None, 0, 0, "x")], {}
    for i, text in texts.items():
        text = text or ""
        places = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, rng.choice([0, 1, 2, 6]))))
        edits = [(a, min(a + rng.choice([0, 1, 4]), b), any_text(rng, rng.randrange(4))) for a, b in zip(places, [*places[1:], len(text)])]
        rows += [(i, *edit) for edit in edits]
        if edits:
            new = text
            for a, b, put in edits[::-1]:
                new = new[:a] + put + new[b:]
            expected[i] = (len(own.encode(text)), len(edits), len(own.encode(new)), "ok")
    rows += [(41, 3, 1, "x")]
    expected[41] = (len(own.encode("plain")), 0, len(own.encode("plain")), "outside")
    edits = spark.createDataFrame(rows, "doc_id long, start long, stop long, new string").repartition(3)
    got = {r.doc_id: (r.n_tokens, r.n_edits, r.n_tokens_edited, r.status) for r in token_counts.count_stored(trees, edits).collect()}
    assert got == expected
    assert token_counts.count_stored(trees, edits.limit(0)).count() == 0


def test_stored_trees_recount_touched_segments_only(spark, own):
    text = " ".join(f"word{i}" for i in range(4_000))
    trees = token_counts.store_trees(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    edits = spark.createDataFrame([(1, 20_000, 20_003, "x"), (1, 5, 5, " new")], "doc_id long, start long, stop long, new string")
    (row,) = token_counts.count_stored(trees, edits).collect()
    assert row.n_tokens_edited == len(own.encode(text[:5] + " new" + text[5:20_000] + "x" + text[20_003:])) and row.n_recounted <= 6 * token_counts.SEGMENT + 4
