"""Queries: normalisation, vocabulary, encoding, conversations, packing. Array columns come out as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmill.functions import normalise, words_of
from labelmill.operators import conversations, encoding, sinks, splits, statistics
from labelmill.operators.frequent import frequent_vocabulary
from labelmill.operators.packing import pack_sequences
from labelmill.operators.vocabulary import BROADCAST_ENTRIES, PAIR_SPECIALS, build_vocabulary
from labelmill.plans import bindings as b
from labelmill.plans.registry import query
from labelmill.plans.views import hash_split, key, sql, words
from labelmill.session import materialise

MAX_LENGTH = 512
ID = ["application_number"]


def _joined_ids(name):
    return F.array_join(F.transform(name, lambda i: i.cast("string")), ",")


def _encoded(spark, folder, max_length=MAX_LENGTH):
    rows = b.texts(spark, folder)
    return encoding.encode(rows, ID, words_of("text"), build_vocabulary(rows, words_of("text")), max_length)


@query("normalise_text", sql("SELECT application_number, strip_accents(lower(text)) AS text FROM texts", "texts"))
def normalise_text(spark, folder):
    return b.texts(spark, folder).select("application_number", normalise(F.col("text")).alias("text"))


@query(
    "tokenise",
    sql(
        f"""SELECT application_number, CAST(len(w) AS INTEGER) AS n_tokens, array_to_string(w, ' ') AS tokens
 FROM (SELECT application_number, {words('text')} AS w FROM texts)""",
        "texts",
    ),
)
def tokenise(spark, folder):
    found = b.texts(spark, folder).select("application_number", words_of("text").alias("w"))
    return found.select("application_number", F.size("w").alias("n_tokens"), F.array_join("w", " ").alias("tokens"))


@query(
    "build_vocabulary",
    sql(
        "SELECT '[PAD]' AS token, 0 AS token_id, 0::BIGINT AS n UNION ALL SELECT '[UNK]', 1, 0 UNION ALL SELECT token, token_id, n FROM vocab",
        "vocab",
    ),
)
def vocabulary(spark, folder):
    return build_vocabulary(b.texts(spark, folder), words_of("text"))


@query(
    "frequent_vocabulary",
    sql(
        "SELECT '[PAD]' AS token, 0 AS token_id, 0::BIGINT AS n UNION ALL SELECT '[UNK]', 1, 0 UNION ALL SELECT token, token_id, n FROM vocab",
        "vocab",
    ),
)
def frequent(spark, folder):
    rows = materialise(b.texts(spark, folder).select(words_of("text").alias("tokens")), "tokens")
    return frequent_vocabulary(rows, F.col("tokens"))


@query("encode_large_vocabulary", sql("SELECT application_number, array_to_string(ids, ',') AS input_ids FROM encoded", "encoded"))
def encode_large_vocabulary(spark, folder):
    """The way of a vocabulary that is too large to hand out: rows and entries meet in a join."""
    # texts are cut into tokens once: the vocabulary and the encoding read them written
    rows = materialise(b.texts(spark, folder).select("application_number", words_of("text").alias("tokens")), "tokens")
    entries = materialise(build_vocabulary(rows, F.col("tokens")), "vocabulary")
    encoded = encoding.encode(rows, ID, F.col("tokens"), entries, MAX_LENGTH, vocab_size=BROADCAST_ENTRIES + 1)
    return encoded.select("application_number", _joined_ids("input_ids").alias("input_ids"))


@query("encode_section", sql("SELECT application_number, array_to_string(ids, ',') AS input_ids FROM encoded", "encoded"))
def encode_section(spark, folder):
    return _encoded(spark, folder).select("application_number", _joined_ids("input_ids").alias("input_ids"))


@query(
    "truncation_stats",
    sql(
        f"""SELECT count(*) AS rows, count(*) FILTER (n > 512) AS truncated_rows, CAST(sum(least(n, 512)) AS BIGINT) AS kept_tokens,
 CAST(sum(greatest(n - 512, 0)) AS BIGINT) AS dropped_tokens FROM (SELECT len({words('text')}) AS n FROM texts)""",
        "texts",
    ),
)
def truncation_stats(spark, folder):
    return encoding.truncation_stats(b.texts(spark, folder), words_of("text"), MAX_LENGTH)


@query(
    "pad_and_mask",
    sql(
        """SELECT application_number, array_to_string(ids, ',') || repeat(',0', 512 - len(ids)) AS input_ids,
 CAST(len(ids) AS BIGINT) AS ones, 512 AS length FROM encoded""",
        "encoded",
    ),
)
def pad_and_mask(spark, folder):
    padded = encoding.pad_and_mask(_encoded(spark, folder), MAX_LENGTH)
    return padded.select(
        "application_number",
        _joined_ids("input_ids").alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0).cast("long"), lambda total, bit: total + bit).alias("ones"),
        F.size("attention_mask").alias("length"),
    )


@query(
    "pad_longest_in_batch",
    sql(
        """SELECT application_number, batch_id, CAST(max(len(ids)) OVER (PARTITION BY batch_id) AS INTEGER) AS length,
 array_to_string(ids, ',') || repeat(',0', max(len(ids)) OVER (PARTITION BY batch_id) - len(ids)) AS input_ids
 FROM encoded JOIN batches USING (application_number)""",
        "encoded",
        extra=f"""batches AS (SELECT application_number, CAST(floor((row_number() OVER (ORDER BY {key('application_number')}) - 1) / 16) AS BIGINT) AS batch_id FROM texts)""",
    ),
)
def pad_longest_in_batch(spark, folder):
    # batches are dealt on the ids alone, so that encoding happens once
    batches = sinks.assign_batches(b.texts(spark, folder).select("application_number"), 16)
    padded = encoding.pad_batches(materialise(_encoded(spark, folder), "encoded"), batches, "application_number")
    return padded.select(
        "application_number", "batch_id", F.size("input_ids").alias("length"), _joined_ids("input_ids").alias("input_ids")
    )


@query(
    "decode_ids",
    sql(
        """SELECT application_number, coalesce(string_agg(CASE WHEN token_id IS NULL THEN '[UNK]' ELSE token END, ' ' ORDER BY pos), '') AS decoded
 FROM texts LEFT JOIN (SELECT * FROM tokens WHERE pos <= 512) USING (application_number)
 LEFT JOIN vocab USING (token) GROUP BY application_number""",
        "texts",
        "tokens",
        "vocab",
    ),
)
def decode_ids(spark, folder):
    rows = b.texts(spark, folder)
    entries = build_vocabulary(rows, words_of("text"))
    return encoding.decode(encoding.encode(rows, ID, words_of("text"), entries, MAX_LENGTH), entries).select(
        "application_number", "decoded"
    )


_PAIRS_SQL = f"""pairs AS (SELECT u.conv_id, u.turn, list_concat({words('u.text')}, ['[SEP]'], {words('a.text')}) AS w
 FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
 WHERE u.role = 'user' AND a.role = 'assistant'),
 spoken AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 2 AS token_id FROM (
  SELECT token, count(*) AS n FROM (SELECT unnest({words('text')}) AS token FROM conversations) GROUP BY token HAVING count(*) >= 3)
  QUALIFY row_number() OVER (ORDER BY n DESC, token) <= 9997),
 placed AS (SELECT conv_id, turn, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS pos FROM pairs)"""


@query(
    "encode_pairs",
    sql(
        """SELECT conv_id, turn, string_agg(CASE WHEN token = '[SEP]' THEN 2 ELSE coalesce(token_id, 1) END, ',' ORDER BY pos) AS input_ids
 FROM placed LEFT JOIN spoken USING (token) WHERE pos <= 512 GROUP BY conv_id, turn""",
        extra=_PAIRS_SQL,
    ),
)
def encode_pairs(spark, folder):
    turns = b.table(spark, folder, "conversations")
    entries = build_vocabulary(turns, words_of("text"), specials=PAIR_SPECIALS)
    pairs = conversations.turn_pairs(turns)
    both = encoding.pair_tokens(words_of("question"), words_of("answer"))
    encoded = encoding.encode(pairs, ["conv_id", "turn"], both, entries, MAX_LENGTH)
    return encoded.select("conv_id", "turn", _joined_ids("input_ids").alias("input_ids"))


@query(
    "render_conversations",
    "SELECT conv_id, turn, CASE WHEN role = 'user' THEN concat('[INST] ', text, ' [/INST]') ELSE text END AS piece FROM conversations",
)
def render_conversations(spark, folder):
    return conversations.render(b.table(spark, folder, "conversations")).select("conv_id", "turn", "piece")


@query(
    "pack_sequences",
    sql(
        """SELECT chunk, count(*) AS n, string_agg(coalesce(token_id, 1), ',' ORDER BY place) AS input_ids FROM (
 SELECT token_id, place, CAST(floor(place / 1024) AS BIGINT) AS chunk FROM (
  SELECT token_id, row_number() OVER (ORDER BY k, pos) - 1 AS place FROM laid)) GROUP BY chunk""",
        "tokens",
        "vocab",
        extra=f"laid AS (SELECT {key('application_number')} AS k, pos, token_id FROM tokens LEFT JOIN vocab USING (token))",
    ),
)
def packed(spark, folder):
    encoded = materialise(_encoded(spark, folder, max_length=None), "encoded")
    chunks = pack_sequences(encoded, length=1024)
    return chunks.select("chunk", F.size("input_ids").cast("long").alias("n"), _joined_ids("input_ids").alias("input_ids"))


@query(
    "section_length_stats",
    sql(
        f"""SELECT split, count(*) AS n, round(quantile_cont(l::DOUBLE, 0.5), 4) AS median_length, max(l) AS max_length,
 round(avg(l), 4) AS mean_length FROM (SELECT {hash_split('application_number')} AS split, length(text) AS l FROM texts) GROUP BY split""",
        "texts",
    ),
)
def section_length_stats(spark, folder):
    stats = statistics.section_length_stats(splits.hash_split(b.texts(spark, folder)), "text")
    return stats.select(
        "split", "n", F.round("median_length", 4).alias("median_length"), "max_length", F.round("mean_length", 4).alias("mean_length")
    )
