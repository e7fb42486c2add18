"""The forest of near-duplicates: sorted orders, neighbours across ranges, deeper levels for crowded regions."""

import random

import pytest
from test_operators import brute_components, docs_of, prose

from labelmill.llm import near_duplicates
from labelmill.llm.components import components


def look_alikes(n, rng, words=120, changed=3):
    """Documents made from one page: most pairs are at a similarity of about 0.6, which links nothing."""
    page = [f"p{k}" for k in range(words)]
    out = []
    for i in range(n):
        own = list(page)
        for k in rng.sample(range(2, words - 2, 5), changed):
            own[k] = f"c{i}x{k}"
        out.append(" ".join(own))
    return out


def test_trees_and_equal_hashes_follow_the_similarity():
    assert [near_duplicates.trees_of(depth, 75) for depth in (2, 4)] == [16, 35]
    assert near_duplicates.least_equal(64, 75) == 32
    assert near_duplicates.trees_of(2, 100) >= 1 and near_duplicates.least_equal(64, 100) == 64
    assert near_duplicates.trees_of(2, 50) > near_duplicates.trees_of(2, 75)


@pytest.mark.parametrize("n", [1, 2, 500])
def test_neighbours_join_a_region_over_all_ranges(spark, n):
    """One region of any size is one chain, wherever the ranges of the sorted rows are cut; regions are never mixed."""
    rows = [(7, i % 5, i) for i in range(n)] + [(8, 0, 1000 + i) for i in range(3)] + [(9, 0, 2000)]
    orders = spark.createDataFrame(rows, near_duplicates.ORDERS).repartition(3)
    pairs = near_duplicates.neighbours(orders)
    assert pairs.count() == n - 1 + 2
    got = {r.node: r.component for r in components(pairs).collect()}
    assert got == {**{i: 0 for i in range(1, n)}, 1001: 1000, 1002: 1000}
    assert near_duplicates.neighbours(orders.limit(0)).count() == 0


def test_neighbours_of_equal_rows_are_not_a_pair(spark):
    orders = spark.createDataFrame([(7, 1, 4)] * 9, near_duplicates.ORDERS).repartition(3)
    assert near_duplicates.neighbours(orders).count() == 0


def test_crowded_regions_are_searched_deeper(spark, monkeypatch):
    """Every link is found at every block size, and a level gives a document a bounded number of rows per region."""
    rng = random.Random(4)
    texts = look_alikes(300, rng)
    # near copies of some, and of some of those
    for _ in range(2):
        texts += [text.replace(" p119", f" z{i}") for i, text in enumerate(rng.sample(texts, 20))]
    rng.shuffle(texts)
    levels, rows = [], []
    deeper, dealt = near_duplicates.deeper_orders, near_duplicates.dealt

    def counted(placed, block):
        out = dealt(placed, block)
        rows.append((placed.count(), out.count()))
        return out

    monkeypatch.setattr(near_duplicates, "deeper_orders", lambda sets, level, similarity: levels.append(level) or deeper(sets, level, similarity))
    monkeypatch.setattr(near_duplicates, "dealt", counted)
    docs = docs_of(spark, texts)
    got = {r.doc_id: tuple(r)[1:] for r in near_duplicates.near_duplicates(docs, block=8).collect()}
    assert got == brute_components(list(enumerate(texts)))
    assert levels[:2] == [1, 2]
    trees = [near_duplicates.trees_of(depth, 75) for depth in near_duplicates.DEPTHS]
    for level, (members, made) in enumerate(rows[: len(trees) - 1]):
        assert made <= members * -(-trees[level + 1] // trees[level])
        assert members <= len(texts) * trees[level]
    levels.clear()
    whole = {r.doc_id: tuple(r)[1:] for r in near_duplicates.near_duplicates(docs, block=10_000).collect()}
    assert whole == got and not levels


def test_what_stays_crowded_is_compared_in_blocks(spark, monkeypatch):
    """With one level only, regions of many blocks are compared whole."""
    rng = random.Random(9)
    texts = [*look_alikes(90, rng), "", None, "one two", *[prose(rng, 40) for _ in range(5)]]
    monkeypatch.setattr(near_duplicates, "DEPTHS", (2,))
    got = {r.doc_id: tuple(r)[1:] for r in near_duplicates.near_duplicates(docs_of(spark, texts), block=4).collect()}
    assert got == brute_components(list(enumerate(texts)))
