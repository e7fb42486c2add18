import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from labelmill.functions import decision_label, examiner_text, hash_below, normalise, seeded_key, tokens, unit_interval
from labelmill.functions.text import accent_table


def test_decision_label(spark, rows):
    df = spark.createDataFrame([(d,) for d in ("REJECTED", "ACCEPTED", "PENDING", "CONT-REJECTED", "CONT-ACCEPTED", "CONT-PENDING")], "decision string")
    assert rows(df.select(decision_label(F.col("decision")))) == [(i,) for i in range(6)]


@pytest.mark.parametrize("value", ["GRANTED", None])
def test_unknown_decision(spark, value):
    df = spark.createDataFrame([(value,)], "decision string")
    assert df.select(decision_label(F.col("decision"), strict=False)).first()[0] is None
    with pytest.raises(Exception, match="unknown decision"):
        df.select(decision_label(F.col("decision"))).collect()


def test_examiner_text(spark):
    df = spark.createDataFrame([("12345.0", "a"), (".0", "b"), ("7", "c"), ("", "d")], "id string, claims string")
    got = [r[0] for r in df.select(examiner_text(F.col("id"), F.col("claims"))).collect()]
    assert got == ["Examiner id: 12345 a", "Examiner id:  b", "Examiner id:  c", "Examiner id:  d"]


def test_keys_agree_with_plain_python(spark):
    df = spark.range(200).withColumn("key", seeded_key("id", 7)).select("id", "key", unit_interval(F.col("key")).alias("u"), hash_below(F.col("key"), 0.85).alias("t"))
    for row in df.collect():
        key = hashlib.md5(f"7-{row.id}".encode()).hexdigest()
        assert row.key == key
        assert row.u == pytest.approx((int(key[:12], 16) + 0.5) / 16**12, abs=1e-15) and 0 < row.u < 1
        assert row.t == (int(key[:8], 16) % 10_000 < 8500)


SAMPLES = [
    "Plain ASCII text, 42!", "ÀÉÎÕÜ çñ ß ŁØ", "Ελληνικά Άλφα", "Йога и ёлка", "Việt Nam ắ ộ", "ｅ́ ȩ́", "Å Ω", "", "naïve—café…", "कि हिन्दी", "が ぱ",
]


def test_normalise(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, text string")
    got = {r.i: r.out for r in df.select("i", normalise(F.col("text")).alias("out")).collect()}
    for i, sample in enumerate(SAMPLES):
        decomposed = unicodedata.normalize("NFD", sample.lower())
        assert got[i] == "".join(c for c in decomposed if unicodedata.category(c) != "Mn"), sample


def test_accent_table_is_one_to_one():
    source, target = accent_table()
    assert len(set(source)) == len(source) > len(target)
    assert all(ord(c) >= 0x80 for c in source)


def test_tokens(spark):
    text = "don't stop—now...  x_1 ²3 été ok end\u0085last नि"
    got = spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t"))).first()[0]
    assert got == ["don", "'", "t", "stop", "—", "now", "...", "x_1", "²", "3", "été", "ok", "end", "last", "नि"]
    assert re.sub(r"\s", "", text) == "".join(got)


def test_tokens_of_null_and_empty(spark):
    df = spark.createDataFrame([("",), ("   ",), (None,)], "t string")
    assert [r[0] for r in df.select(tokens(normalise(F.col("t")))).collect()] == [[], [], None]
