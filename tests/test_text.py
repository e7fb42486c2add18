import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelmill.functions import words_of
from labelmill.operators import conversations, encoding, models
from labelmill.operators.packing import pack_sequences
from labelmill.operators.vocabulary import PAIR_SPECIALS, build_vocabulary

TEXTS = ["the cat sat on the mat", "The dog, the cat.", "a a a b", "", "rare words only"]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "application_number string, text string")


def _vocabulary(size, minimum, specials=2):
    counts = Counter(w for t in TEXTS for w in t.lower().replace(",", " ,").replace(".", " .").split())
    ranked = sorted((w for w, n in counts.items() if n >= minimum), key=lambda w: (-counts[w], w))
    return {w: i + specials for i, w in enumerate(ranked[: size - specials])}


@pytest.mark.parametrize("size,minimum", [(100, 1), (100, 2), (4, 1)])
def test_vocabulary(corpus, size, minimum):
    got = {r.token: r.token_id for r in build_vocabulary(corpus, words_of("text"), size, minimum).collect()}
    assert got == {"[PAD]": 0, "[UNK]": 1, **_vocabulary(size, minimum)}


def test_vocabulary_needs_room(corpus):
    with pytest.raises(ValueError):
        build_vocabulary(corpus, words_of("text"), size=2)


def test_encode_pad_decode(corpus):
    entries = build_vocabulary(corpus, words_of("text"), min_frequency=2)
    known = _vocabulary(10_000, 2)
    encoded = encoding.encode(corpus, ["application_number"], words_of("text"), entries, max_length=5)
    got = {r.application_number: r.input_ids for r in encoded.collect()}
    split = [t.lower().replace(",", " ,").replace(".", " .").split() for t in TEXTS]
    assert got == {str(i): [known.get(w, 1) for w in words[:5]] for i, words in enumerate(split)}

    padded = {r.application_number: r for r in encoding.pad_and_mask(encoded, 5).collect()}
    assert padded["2"].input_ids == got["2"] + [0] and padded["2"].attention_mask == [1, 1, 1, 1, 0]
    assert padded["3"].input_ids == [0] * 5 and padded["3"].attention_mask == [0] * 5

    decoded = {r.application_number: r.decoded for r in encoding.decode(encoded, entries).collect()}
    assert decoded == {str(i): " ".join(w if w in known else "[UNK]" for w in words[:5]) for i, words in enumerate(split)}


def test_large_vocabulary_gives_the_same_ids(corpus, rows):
    entries = build_vocabulary(corpus, words_of("text"), min_frequency=2)
    nulls = corpus.unionByName(corpus.limit(1).selectExpr("'n' AS application_number", "cast(NULL AS string) AS text"))
    small = encoding.encode(nulls, ["application_number"], words_of("text"), entries, None)
    large = encoding.encode(nulls, ["application_number"], words_of("text"), entries, None, vocab_size=1_000_000)
    assert rows(small) == rows(large) and ("n", []) in rows(small)


def test_encode_carries_columns_and_whole_texts(corpus):
    entries = build_vocabulary(corpus, words_of("text"), min_frequency=1)
    extra = corpus.withColumn("labels", F.lit(1))
    got = encoding.encode(extra, ["application_number"], words_of("text"), entries, None, carry=("labels",))
    assert {len(r.input_ids) for r in got.collect()} == {6, 0, 4, 3} and got.select("labels").distinct().count() == 1


def test_pad_longest_in_batch(spark, rows):
    df = spark.createDataFrame([(0, [5]), (0, [5, 6, 7]), (1, [8, 9])], "batch_id int, input_ids array<int>")
    got = sorted((r.batch_id, r.input_ids, r.attention_mask) for r in encoding.pad_longest_in_batch(df).collect())
    assert got == [(0, [5, 0, 0], [1, 0, 0]), (0, [5, 6, 7], [1, 1, 1]), (1, [8, 9], [1, 1])]


def test_truncation_stats(corpus):
    assert tuple(encoding.truncation_stats(corpus, words_of("text"), 4).first()) == (5, 2, 15, 4)


def test_turn_pairs_and_pieces(spark, rows):
    data = [(1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"), (1, 3, "user", "u2"), (1, 4, "user", "u3"), (2, 0, "assistant", "x"), (2, 1, "user", "y")]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    assert rows(conversations.turn_pairs(turns)) == [(1, 1, "u1", "a1")]
    pieces = rows(conversations.render(turns), "conv_id", "turn", "piece")
    assert pieces[:3] == [(1, 0, "s"), (1, 1, "[INST] u1 [/INST]"), (1, 2, "a1")]


def test_pairs_get_a_separator(spark):
    pairs = spark.createDataFrame([(1, 0, "a b", "b c")], "conv_id long, turn long, question string, answer string")
    words = pairs.select(F.concat_ws(" ", "question", "answer").alias("text"))
    entries = build_vocabulary(words, words_of("text"), min_frequency=1, specials=PAIR_SPECIALS)
    both = encoding.pair_tokens(words_of("question"), words_of("answer"))
    encoded = encoding.encode(pairs, ["conv_id", "turn"], both, entries, 4)
    assert encoded.first().input_ids == [4, 3, 2, 3]


@pytest.mark.parametrize("digits", [1, 4])
def test_pack_sequences_lays_documents_end_to_end(spark, digits):
    random.seed(2)
    documents = {str(i): [random.randint(1, 99) for _ in range(random.choice([0, 3, 10, 45]))] for i in range(60)}
    df = spark.createDataFrame(list(documents.items()), "application_number string, input_ids array<int>")
    chunks = pack_sequences(df, length=16, seed=9, digits=digits).collect()
    order = sorted(documents, key=lambda i: hashlib.md5(f"9-{i}".encode()).hexdigest())
    stream = [token for number in order for token in documents[number]]
    expected = {i // 16: stream[i : i + 16] for i in range(0, len(stream), 16)}
    assert {r.chunk: r.input_ids for r in chunks} == expected


TRAIN = [("0", 1, "good fine good"), ("1", 1, "fine day"), ("2", 0, "bad day bad bad"), ("3", 0, "poor")]


def _bayes(kind, vocabulary):
    docs = {label: [t.split() for _, l, t in TRAIN if l == label] for label in (0, 1)}
    weights, bias = {}, {}
    for label, members in docs.items():
        bias[label] = math.log(len(members) / len(TRAIN))
        if kind == "multinomial":
            counts = Counter(w for m in members for w in m if w in vocabulary)
            total = sum(counts.values())
            weights[label] = {w: math.log((counts[w] + 1) / (total + len(vocabulary))) for w in vocabulary}
        else:
            share = {w: (sum(w in m for m in members) + 1) / (len(members) + 2) for w in vocabulary}
            weights[label] = {w: math.log(p) - math.log(1 - p) for w, p in share.items()}
            bias[label] += sum(math.log(1 - p) for p in share.values())
    return weights, bias


@pytest.mark.parametrize("kind", ["multinomial", "bernoulli"])
def test_naive_bayes(spark, tmp_path, kind):
    train = spark.createDataFrame(TRAIN, "application_number string, labels int, text string")
    entries = build_vocabulary(train, words_of("text"), min_frequency=1)
    model = models.train_naive_bayes(train, words_of("text"), entries, kind)
    extra = spark.createDataFrame([("8", None, "unseen tokens"), ("9", None, "")], train.schema)
    scored = models.argmax(models.score_naive_bayes(train.unionByName(extra), model, words_of("text"), ["application_number"]))
    got = {r.application_number: r for r in scored.collect()}
    vocabulary = {w for _, _, t in TRAIN for w in t.split()}
    weights, bias = _bayes(kind, vocabulary)
    for number, text in [(n, t) for n, _, t in TRAIN] + [("8", "unseen tokens"), ("9", "")]:
        words = text.split() if kind == "multinomial" else set(text.split())
        expected = {c: bias[c] + sum(weights[c].get(w, 0) for w in words) for c in (0, 1)}
        assert got[number].score_1 == pytest.approx(expected[1]) and got[number].score_0 == pytest.approx(expected[0])
        assert got[number].pred == (1 if expected[1] > expected[0] + 1e-12 else 0)
    path = str(tmp_path / kind)
    model.save(path)
    again = models.score_naive_bayes(train, models.NaiveBayes.load(spark, path), words_of("text"), ["application_number"])
    assert {r.application_number: round(r.score_1, 9) for r in again.collect()} == {n: round(got[n].score_1, 9) for n, _, _ in TRAIN}


@pytest.mark.parametrize("kind", ["multinomial", "bernoulli"])
def test_naive_bayes_with_one_class(spark, kind):
    train = spark.createDataFrame(TRAIN, "application_number string, labels int, text string").where("labels = 1")
    model = models.train_naive_bayes(train, words_of("text"), build_vocabulary(train, words_of("text"), min_frequency=1), kind)
    scored = models.argmax(models.score_naive_bayes(train, model, words_of("text"), ["application_number"]))
    assert {(r.pred, round(r.probability, 6)) for r in scored.collect()} == {(1, 1.0)}


def test_unknown_kind(spark):
    with pytest.raises(ValueError):
        models._events(F.array(), "gaussian")


def test_argmax_ties_go_to_the_smaller_class(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (1.0, 2.0)], "score_1 double, score_0 double")
    assert [r.pred for r in models.argmax(df).collect()] == [0, 1, 0]


def test_external_model(spark):
    df = spark.createDataFrame([(1, "aab"), (2, "abb"), (3, "ab")], "id long, text string")

    def load():
        return lambda texts: [(t.count("a"), t.count("b")) for t in texts]

    got = {r.id: (r.scores, r.pred) for r in models.score_external(df, load, ["id"]).collect()}
    assert got == {1: ([2.0, 1.0], 0), 2: ([1.0, 2.0], 1), 3: ([1.0, 1.0], 0)}


def test_linear_model_round_trip(spark, tmp_path):
    from pyspark.ml import PipelineModel

    data = [(str(i), i % 2, ("good fine day " if i % 2 else "bad poor day ") * 3) for i in range(40)]
    train = spark.createDataFrame(data, "application_number string, labels int, text string").withColumn("weight", F.lit(0.5))
    model = models.train_linear(train, words_of("text"), weight="weight", min_documents=1)
    scored = models.score_linear(train, model, words_of("text"), ["application_number", "labels"])
    assert scored.where("pred <> labels").count() == 0
    model.write().overwrite().save(str(tmp_path / "linear"))
    again = models.score_linear(train, PipelineModel.load(str(tmp_path / "linear")), words_of("text"), ["application_number"])
    assert again.join(scored.withColumnRenamed("probability", "p"), "application_number").where("abs(p - probability) > 1e-9").count() == 0


def test_large_vocabulary_query_cuts_texts_once(spark, monkeypatch):
    from labelmill.plans import queries_text

    seen = []

    def build(df, tokens, **rest):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return build_vocabulary(df, tokens, **rest)

    monkeypatch.setattr(queries_text, "build_vocabulary", build)
    encoded = queries_text.encode_large_vocabulary(spark, "/root/testdata/sf0.001")
    assert len(seen) == 1 and "regexp_extract_all" not in seen[0] and encoded.count() == 200
