"""Quality rules: counted base rules and a hashed n-gram likelihood ratio, in DataFrame functions only.

Words and word pairs are hashed to a fixed number of buckets. Two smoothed multinomials over the buckets are counted: one
over the trusted documents, one over the whole corpus. A document's ratio is the mean, over its words and pairs, of the
difference of their log probabilities; a fixed threshold decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import SPACE_RUN, SPACES

# The symbols that the base rules count.
SYMBOLS = "#*$%&|<>"

# Buckets of the multinomials (the model is one array of this size), count added to each, and the decision threshold.
BUCKETS, ADDED, THRESHOLD = 16_384, 1.0, -0.1

# Trusted ids that may be broadcast (8 bytes each); more are joined.
BROADCAST_IDS = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RUN), "")


def with_words(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("words", words_of(F.col("text")))


def pairs_of(words: Column) -> Column:
    """Every word and the next one with a blank between them."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def gram_buckets(words: Column, pairs: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of every word and of every pair of neighbouring words."""

    def bucket(gram: Column) -> Column:
        return F.pmod(F.crc32(gram.cast("binary")), F.lit(buckets)).cast("int")

    return F.concat(F.transform(words, bucket), F.transform(pairs, bucket))


def base_rules(tokens: DataFrame) -> DataFrame:
    """The counted rules; ``_pairs`` stays. Repeated windows are found by sorting the window hashes of a text with their places,
    of the texts that hold a window twice."""
    words, text = F.col("words"), F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda line: F.ltrim(line, F.lit(SPACES)) != "")
    n = F.greatest(F.size(words) - 2, F.lit(0))
    hashes = F.zip_with(F.slice("_pairs", 1, n), F.slice(words, 3, n), lambda pair, word: F.xxhash64(pair, word))
    hashed = tokens.withColumn("_pairs", pairs_of(words)).withColumns({"_lines": lines, "_hashes": hashes})
    windows = F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    sorted_ = hashed.withColumn("_windows", F.when(repeats, F.sort_array(windows)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    w = F.col("_windows")

    def repeated(item: Column, i: Column) -> Column:
        before, after = F.get(w, i - 1)["h"], F.get(w, i + 1)["h"]
        return F.coalesce(before == item["h"], F.lit(False)) | F.coalesce(after == item["h"], F.lit(False))

    places = F.sort_array(F.transform(F.filter(w, repeated), lambda item: item["i"]))
    with_places = sorted_.withColumn("_places", places)
    p = F.col("_places")
    covered = F.aggregate(
        F.transform(p, lambda place, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - place, F.lit(3)))), F.lit(0), lambda a, b: a + b
    )
    counted = with_places.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": covered.cast("long"),
        }
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).drop("_lines", "_hashes", "_windows", "_places")


def ratio_model(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, added: float = ADDED) -> Column:
    """One constant array: per bucket, log probability under the trusted documents minus under the whole corpus.

    ``trusted`` holds ``doc_id``; nulls and repeats there count once or not at all. Runs the counting job; ``buckets``
    numbers come to the driver.
    """
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().withColumn("_trusted", F.lit(1))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    # the buckets of a text are found after the join: a join without broadcast moves texts, not one number per word
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left")
    grams = joined.select(
        F.coalesce("_trusted", F.lit(0)).alias("_trusted"), words_of(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words")
    )
    seen = grams.select("_trusted", F.explode(gram_buckets(F.col("words"), pairs_of(F.col("words")), buckets)).alias("bucket")).groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum("_trusted").alias("good")
    )
    cells = {row["bucket"]: (row["good"], row["n"]) for row in seen.collect()}
    all_good, all_n = (sum(cell[i] for cell in cells.values()) + added * buckets for i in (0, 1))
    values = [
        math.log((cells.get(i, (0, 0))[0] + added) / all_good) - math.log((cells.get(i, (0, 0))[1] + added) / all_n) for i in range(buckets)
    ]
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Base counts, ratio and verdict for every document.

    ``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept)``. A null or blank
    text has no words, ratio 0 and fails the base rules. Without trusted documents the trusted multinomial is uniform.
    Repeated rows give repeated rows; an empty table gives none. Only the counts of the buckets are shuffled, unless
    there are more trusted ids than may be broadcast: then the texts are, once.
    """
    model = ratio_model(docs, trusted, buckets)
    ruled = base_rules(with_words(docs)).withColumn("_grams", gram_buckets(F.col("words"), F.col("_pairs"), buckets))
    total = F.aggregate("_grams", F.lit(0.0), lambda sum_, bucket: sum_ + F.get(model, bucket))
    ratio = F.when(F.size("_grams") == 0, F.lit(0.0)).otherwise(total / F.size("_grams"))
    scored = ruled.withColumn("ratio", F.round(ratio, 6))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio",
        (~F.col("base_failed") & (F.col("ratio") >= threshold)).alias("kept"),
    )
