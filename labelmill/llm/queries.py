"""Registered queries: each operator on its whole table, with its production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from labelmill.llm import (
    bpe,
    contamination,
    exact_topk,
    fill_middle,
    filter_audit,
    html_text,
    katz,
    near_duplicates,
    quality,
    sharding,
    suffix_dedup,
    token_counts,
    toxicity,
)
from labelmill.llm.common import table
from labelmill.llm.registry import ORACLES, QUERIES, query
from labelmill.llm.sql import CRC_TABLE, crc32

__all__ = ["ORACLES", "QUERIES"]

_OP1 = rf"""
WITH {CRC_TABLE},
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
tok AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g') <> '') AS lines
  FROM docs),
windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM tok, unnest(range(1, len(words) - 1)) AS u(i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) AS r(k) GROUP BY doc_id),
grams AS (
  SELECT doc_id, words[i] AS g FROM tok, unnest(range(1, len(words) + 1)) AS u(i)
  UNION ALL SELECT doc_id, words[i] || ' ' || words[i + 1] FROM tok, unnest(range(1, len(words))) AS u(i)),
codes AS (SELECT g, {crc32("g")} % {quality.BUCKETS} AS b FROM (SELECT DISTINCT g FROM grams), crc_table),
hits AS (SELECT doc_id, b FROM grams JOIN codes USING (g)),
trusted AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
cells AS (SELECT b, count(*) AS n, count(trusted.doc_id) AS good FROM hits LEFT JOIN trusted USING (doc_id) GROUP BY b),
totals AS (SELECT sum(n) + {quality.BUCKETS} AS all_n, sum(good) + {quality.BUCKETS} AS all_good FROM cells),
model AS (SELECT b, ln((good + 1.0) / all_good) - ln((n + 1.0) / all_n) AS w FROM cells, totals),
ratios AS (SELECT doc_id, round(sum(w) / count(*), 6) AS ratio FROM hits JOIN model USING (b) GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, coalesce(ratio, 0.0) AS ratio
  FROM tok LEFT JOIN covered USING (doc_id) LEFT JOIN ratios USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, NOT base_failed AND ratio >= {quality.THRESHOLD} AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
"""


@query("op1_quality_rules", _OP1)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.judge(table(spark, sf_dir, "documents"), trusted)


_OP2 = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
places AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM texts, unnest(range(n - 49)) AS u(p) WHERE n >= 50),
firsts AS (SELECT s, min(doc_id) AS first FROM places GROUP BY s),
hits AS (SELECT doc_id, p FROM places JOIN firsts USING (s) WHERE first < doc_id),
edges AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM hits),
heads AS (SELECT *, sum(CASE WHEN before IS NULL OR p > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM edges),
spans AS (SELECT doc_id, span, min(p) AS a, max(p) + 50 AS b FROM heads GROUP BY doc_id, span),
cuts AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS kept_from FROM spans),
pieces AS (
  SELECT doc_id, string_agg(substr(h, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY a) AS kept, max(b) AS rest, count(*) AS n_spans, sum(b - a) AS n_removed
  FROM cuts JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(rest, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN pieces USING (doc_id)
"""


@query("op2_suffix_runs", _OP2)
def op2_suffix_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query("op3_katz")
def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


_OP4 = r"""
WITH lowered AS (
  SELECT 'd' AS kind, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
tok AS (SELECT kind, id, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM lowered),
items AS (SELECT id AS item, words, least(13, len(words)) AS size FROM tok WHERE kind = 'b' AND len(words) > 0),
windows AS (
  SELECT DISTINCT item, size, array_to_string(words[i:i + size - 1], ' ') AS w FROM items, unnest(range(1, len(words) - size + 2)) AS u(i)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT id AS doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') AS w
  FROM tok, sizes, unnest(range(1, len(words) - size + 2)) AS u(i) WHERE kind = 'd' AND len(words) >= size),
hits AS (SELECT doc_id, i, places.size, item FROM places JOIN windows ON places.size = windows.size AND places.w = windows.w),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, range(13) AS r(k) WHERE k < size GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT id AS doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM tok LEFT JOIN covered ON id = covered.doc_id LEFT JOIN named ON id = named.doc_id WHERE kind = 'd'
"""


@query("op4_winnowing", _OP4)
def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


@query("op5_block_rules")
def op5_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op6_string_kernel")
def op6_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document before and after its mail addresses are masked."""
    docs = table(spark, sf_dir, "documents")
    return token_counts.count_edited(docs, token_counts.pattern_edits(F.col("text"), token_counts.MAIL, "[mail]"))


_OP8 = r"""
WITH RECURSIVE tok AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s FROM tok, unnest(range(1, greatest(len(words) - 3, 2))) AS u(i) WHERE len(words) > 0),
sized AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, other) AS (SELECT doc_id, doc_id FROM tok UNION SELECT node, b FROM reach JOIN ways ON other = a),
lowest AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept
FROM tok JOIN lowest ON doc_id = node LEFT JOIN sized USING (doc_id)
"""


@query("op8_lsh_forest", _OP8)
def op8_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


_OP10 = f"""
WITH RECURSIVE {CRC_TABLE},
sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {crc32("coalesce(text, '')")} AS text_crc32, coalesce(sha256(text), '') AS key
  FROM documents, crc_table),
ends AS (SELECT key, (sum(sum(size)) OVER (ORDER BY key))::BIGINT AS upto FROM sized GROUP BY key),
pre AS (SELECT list(upto ORDER BY upto) AS p, max(upto) AS total FROM ends),
search(low, high) AS (
  SELECT 0::BIGINT, total FROM pre
  UNION ALL
  SELECT CASE WHEN fits THEN low ELSE middle + 1 END, CASE WHEN fits THEN middle ELSE high END FROM (
    SELECT low, high, middle, list_reduce(list_concat([0::BIGINT], range(16)),
      lambda pos, k: greatest(pos, coalesce(list_max(list_filter(p, lambda x: x <= pos + middle)), 0))) = total AS fits
    FROM (SELECT low, high, (low + high) // 2 AS middle FROM search WHERE low < high), pre)),
capacity AS (SELECT min(high) AS c FROM search),
cuts(k, pos) AS (
  SELECT 0, 0::BIGINT
  UNION ALL SELECT k + 1, greatest(pos, coalesce(list_max(list_filter(p, lambda x: x <= pos + c)), 0)) FROM cuts, pre, capacity WHERE k < 15),
placed AS (SELECT key, (SELECT count(*) FROM cuts WHERE k > 0 AND pos < upto)::INT AS shard FROM ends)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(doc_id::VARCHAR), doc_id, text_crc32, size) - 1 AS slot, NULL::INT AS grown_shard
FROM sized JOIN placed USING (key)
"""


@query("op10_minimax_shards", _OP10)
def op10_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


_OP11 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query("op11_exact_topk", _OP11)
def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


_OP12 = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS d FROM documents),
numbers AS (SELECT *, list_transform(range(4), lambda i: ('0x' || substr(d, 8 * i + 1, 8))::BIGINT) AS h FROM texts),
cuts AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers),
cut AS (SELECT *, substr(t, 1, low) AS p, substr(t, low + 1, high - low) AS m, substr(t, high + 1) AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(p || m || s) AS restored_sha256
FROM cut
"""


@query("op12_fill_middle", _OP12)
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.transform(fill_middle.store_frames(table(spark, sf_dir, "documents")))


_OP13 = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
says AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
    (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask
  FROM texts LEFT JOIN says USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM masks GROUP BY ALL),
l AS (SELECT unnest(range(5)) AS k),
orders AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (
  SELECT array_to_string(list_transform(o, lambda i: substr('ABCDE', i + 1, 1)), '') AS filter_order, s AS step, 1 << o[s] AS own,
    coalesce(list_sum(list_transform(o[1:s - 1], lambda i: 1 << i)), 0)::BIGINT AS before, substr('ABCDE', o[s] + 1, 1) AS filter
  FROM orders, range(1, 6) AS r(s)),
stepped AS (
  SELECT part, filter_order, step::INT AS step, filter, sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN bad ELSE 0 END)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM stepped
"""


@query("op13_filter_audit", _OP13)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
