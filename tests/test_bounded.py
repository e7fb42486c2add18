"""Operators whose memory and shuffles have a bound: commits, frequent tokens, membership, quantiles, large vocabularies."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmill.operators import distribution, encoding, statistics
from labelmill.operators.commits import commit, committed, publish, stage
from labelmill.operators.frequent import at_most, count_sketch, frequent_vocabulary, possible_tokens
from labelmill.operators.membership import BITMAP, bloom_filter, filter_bits, possible, with_listed_ids
from labelmill.operators.predictions import with_ids, with_outcome
from labelmill.operators.vocabulary import build_vocabulary
from labelmill.session import scratch_path

LOG = "run string, step long, value double"


def _log(spark, *rows):
    return spark.createDataFrame(list(rows), LOG)


def test_a_key_written_twice_counts_once(spark, rows):
    path = scratch_path(spark, "log")
    assert committed(spark, path, LOG, ["run", "step"]).count() == 0
    commit(_log(spark, ("a", 1, 0.5), ("a", 2, 0.6), (None, 1, 9.0)), path)
    commit(_log(spark, ("a", 2, 0.7), ("a", 2, 0.8)), path)
    commit(_log(spark, (None, 1, 8.0)), path)
    # two rows of one key in one write are both its rows
    assert set(map(tuple, committed(spark, path, LOG, ["run", "step"]).collect())) == {("a", 1, 0.5), ("a", 2, 0.7), ("a", 2, 0.8), (None, 1, 8.0)}


def test_a_writer_that_dies_between_the_phases_is_not_seen(spark, rows):
    path = scratch_path(spark, "log")
    lost = stage(_log(spark, ("a", 1, 1.0)), path)
    assert committed(spark, path, LOG, ["run", "step"]).count() == 0
    commit(_log(spark, ("a", 1, 2.0)), path, version=10)
    stage(_log(spark, ("a", 1, 3.0)), path)
    assert rows(committed(spark, path, LOG, ["run", "step"])) == [("a", 1, 2.0)]
    # published late with an earlier version, and published again
    publish(spark, path, lost, version=5)
    publish(spark, path, lost, version=50)
    assert rows(committed(spark, path, LOG, ["run", "step"])) == [("a", 1, 2.0)]


def test_a_write_that_fails_leaves_what_was_there(spark, rows):
    path = scratch_path(spark, "log")
    commit(_log(spark, ("a", 1, 2.0)), path)
    broken = spark.range(8).select(F.lit("a").alias("run"), "id", F.raise_error(F.lit("lost")).cast("double").alias("value")).toDF("run", "step", "value")
    with pytest.raises(Exception, match="lost"):
        commit(broken, path)
    assert rows(committed(spark, path, LOG, ["run", "step"])) == [("a", 1, 2.0)]


@pytest.fixture(scope="module")
def tokens(spark):
    rng = random.Random(4)
    texts = [[f"f{min(int(rng.expovariate(0.05)), 200)}" for _ in range(60)] + [f"rare{rng.randrange(10**7)}" for _ in range(60)] for _ in range(200)]
    texts += [[], ["[PAD]"] * 50, ["[UNK]"], ["é"] * 9 + ["e"] * 9, [None, "x"]]
    table = spark.createDataFrame([(t,) for t in texts] + [(None,)], "tokens array<string>").repartition(4)
    return table, Counter(t for text in texts for t in text if t is not None)


@pytest.mark.parametrize(("size", "minimum", "cells", "rows_"), [(50, 1, 64, 1), (50, 3, 1024, 2), (12, 1, 4096, 3), (5_000, 2, 256, 2), (100_000, 1, 128, 2), (20, 60, 512, 2)])
def test_frequent_vocabulary_is_the_vocabulary(tokens, rows, size, minimum, cells, rows_):
    table, _ = tokens
    got = frequent_vocabulary(table, F.col("tokens"), size, minimum, cells=cells, rows=rows_)
    assert rows(got) == rows(build_vocabulary(table, F.filter("tokens", lambda t: t.isNotNull()), size, minimum))


def test_rare_tokens_are_ruled_out_before_the_shuffle(tokens):
    table, counts = tokens
    sketch = count_sketch(table, F.col("tokens"), 4096)
    assert sketch.count() == 1
    possible_ = possible_tokens(table, F.col("tokens"), sketch, 40, 4096)
    found = {r.token: r.n for r in possible_.collect()}
    wanted = {t: n for t, n in counts.items() if n >= 40}
    assert {t: found.get(t) for t in wanted} == wanted and len(counts) > 10_000 and len(found) < 400
    plan = possible_._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning(token") < plan.index("least(")
    bounds = table.select(F.explode("tokens").alias("t")).where("t IS NOT NULL").distinct().select("t", at_most(sketch, F.col("t"), 4096).alias("n"))
    assert all(r.n >= counts[r.t] for r in bounds.collect())


def test_frequent_vocabulary_of_nothing(spark):
    empty = spark.createDataFrame([], "tokens array<string>")
    assert [r.token for r in frequent_vocabulary(empty, F.col("tokens"), 10, 1, cells=64).collect()] == ["[PAD]", "[UNK]"]
    with pytest.raises(ValueError):
        frequent_vocabulary(empty, F.col("tokens"), 2)


def test_members_of_a_long_list(spark, rows):
    metadata = spark.range(5_000).select(F.col("id").cast("string").alias("application_number"), (F.col("id") % 7).alias("x"))
    metadata = metadata.unionByName(spark.createDataFrame([(None, 1), ("17", 2)], "application_number string, x long"))
    ids = spark.range(0, 9_000, 13).select(F.col("id").cast("string").alias("application_number"))
    ids = ids.unionByName(ids.limit(50)).unionByName(spark.createDataFrame([(None,)], "application_number string"))
    expected = rows(with_ids(metadata, ids))
    for bits in (None, BITMAP, 8 * BITMAP):
        assert rows(with_listed_ids(metadata, ids, bits=bits)) == expected
    assert with_listed_ids(metadata, ids.limit(0)).count() == 0
    bits = filter_bits(693)
    sieve = bloom_filter(ids, "application_number", bits)
    passed = metadata.where(possible(sieve, F.col("application_number"), bits)).count()
    assert len(expected) <= passed <= len(expected) + 100


def test_only_possible_members_are_shuffled(spark):
    metadata = spark.range(1000).select(F.col("id").cast("string").alias("application_number"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = with_listed_ids(metadata, metadata.limit(10))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchange = plan.index("Exchange hashpartitioning(application_number")
    assert exchange < plan.index("xxhash64(") and "LeftSemi" in plan


def test_bits_follow_the_list_up_to_a_bound():
    assert filter_bits(0) == BITMAP and filter_bits(10**6) >= 12 * 10**6 and filter_bits(10**12) == 1 << 27


@pytest.mark.parametrize("accuracy", [10, 100, 10_000])
def test_quantiles_from_brackets(spark, accuracy):
    rng = np.random.default_rng(accuracy)
    values = {"a": rng.normal(size=3_000), "b": rng.integers(0, 4, 500).astype(float), "c": np.array([5.0]), "d": np.array([1.0, 1.0, 1.0, 2.0, 7.0])}
    table = spark.createDataFrame([(g, float(x)) for g, xs in values.items() for x in xs], "g string, x double").repartition(5)
    shares = {"p0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "p90": 0.9}
    got = {r.g: r for r in distribution.exact_quantiles(table, "g", "x", shares, accuracy).collect()}
    for g, xs in values.items():
        assert got[g].n == len(xs)
        for name, share in shares.items():
            assert getattr(got[g], name) == pytest.approx(np.quantile(xs, share))


def test_brackets_hold_few_values(spark):
    table = spark.range(200_000).select(F.lit("g").alias("g"), F.rand(3).alias("x"))
    shares = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    table = spark.createDataFrame(table.toPandas())
    hist = distribution.bracketed(table, "g", "x", shares, 1_000)
    assert hist.count() < 200_000 * 3 * 10 / 1_000 and hist.agg(F.sum("rows")).first()[0] == 200_000


def test_a_quantile_outside_its_bracket_is_found_all_the_same(spark, monkeypatch):
    table = spark.createDataFrame([("g", float(x)) for x in range(1000)], "g string, x double")
    real = distribution.bracketed

    def wrong(df, group, value, shares, accuracy):
        return real(df, group, value, {name: 0.99 for name in shares}, accuracy)

    monkeypatch.setattr(distribution, "bracketed", wrong)
    assert distribution.exact_quantiles(table, "g", "x", {"q1": 0.25, "q2": 0.5}).first()[:] == ("g", 1000, 249.75, 499.5)


def test_box_stats_of_ties_and_nulls(spark):
    rows = [("Correct", 1.0)] * 50 + [("Correct", None)] * 5 + [("Incorrect", float(x)) for x in [*range(10), 100]]
    got = {r.Prediction: tuple(r)[1:] for r in statistics.box_stats(spark.createDataFrame(rows, "Prediction string, x double"), "x").collect()}
    assert got == {"Correct": (50, 1.0, 1.0, 1.0, 1.0, 1.0, 0), "Incorrect": (11, 2.5, 5.0, 7.5, 0.0, 9.0, 1)}


def test_a_vocabulary_of_any_size_gives_the_same_rows(spark, rows):
    entries = spark.createDataFrame([("[PAD]", 0, 0), ("[UNK]", 1, 0), *[(f"t{i}", i + 2, 5) for i in range(8)]], "token string, token_id int, n long")
    texts = [(1, ["t0", "zz", "t7"]), (1, ["t0", "zz", "t7"]), (1, ["t3"]), (None, ["t1"] * 400), (None, []), (None, None), (2, [None, "t2"])]
    table = spark.createDataFrame(texts, "k int, tokens array<string>")
    both = []
    for size in (10, 1_000_000):
        encoded = encoding.encode(table, ["k"], F.col("tokens"), entries, 300, vocab_size=size)
        decoded = encoding.decode(encoded, entries, vocab_size=size)
        both.append(sorted(map(repr, map(tuple, decoded.collect()))))
    assert both[0] == both[1] and len(both[0]) == len(texts)


def test_outcomes_that_are_not_known_are_left_out(spark, rows):
    metadata = spark.createDataFrame([("1",), ("2",), ("3",)], "application_number string")
    scored = spark.createDataFrame([("1", True), ("2", None), ("3", False)], "application_number string, correct boolean")
    assert rows(with_outcome(metadata, scored)) == [("1", "Correct"), ("3", "Incorrect")]
