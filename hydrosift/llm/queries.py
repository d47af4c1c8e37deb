"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import host_rules as _host_rules
from . import (additive_quality, bpe_automaton, packing, phrase_index, pii, ranked_search, sigtree, site_style_tree,
               spelling, string_kernel, suffix_repeats, warc)
from .common import table


def op1_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "base_failed", "kept", "host_rate"]
    return _host_rules.host_rules(table(spark, sf_dir, "documents")).select(*cols)


def op3_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op4_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtree.jaccard_components(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "class_id")


def op5_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_index.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op6_suffix_tree_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op7_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_exact_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_kernel.identify(table(spark, sf_dir, "documents"))


def op10_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style_tree.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op11_reduced_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    opt = spelling.Spelling(damage=97)
    return spelling.variant_groups(spelling.count_words(table(spark, sf_dir, "documents"), opt), opt)


def op12_tokenization_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe_automaton.decode(bpe_automaton.encode(table(spark, sf_dir, "documents")))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                         F.sha2("text", 256).alias("decoded_sha256"))


def op13_hybrid_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL_OP2 = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS (
  SELECT doc_id, i, w[i:i+4] AS gram, len(w) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
r AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g),
p AS (
  SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS k
  FROM r WHERE c > 1),
rep AS (SELECT doc_id, sum(k) AS k FROM p GROUP BY doc_id),
c AS (
  SELECT w.doc_id, w.source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
         CAST(coalesce(k, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)),
f AS (
  SELECT *, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM c),
h AS (
  SELECT source, count(*) AS n, sum(CAST(base_failed AS BIGINT)) AS f FROM f
  WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT avg(f / n) AS m, avg((f / n) * (f / n)) - avg(f / n) * avg(f / n) AS v FROM h),
s AS (SELECT m, least(greatest(CASE WHEN v > 1e-12 THEN m * (1 - m) / v - 1 ELSE 1000.0 END, 1.0), 1000.0) AS s FROM m),
v AS (SELECT source, round((f + m * s) / (n + s), 6) AS host_rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(host_rate > 0.5, false) AS kept, host_rate
FROM f LEFT JOIN v USING (source)
"""

SQL_OP5 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS p
  FROM (SELECT item_id, w, least(len(w), 10) AS l, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i
        FROM b WHERE len(w) > 0)),
g AS (
  SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS p
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i
        FROM d, (SELECT DISTINCT l FROM win) WHERE len(w) >= l)),
hit AS (SELECT doc_id, item_id, g.l, i FROM g JOIN win ON g.p = win.p AND g.l = win.l),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + l)) AS k FROM (SELECT DISTINCT doc_id, i, l FROM hit)),
n AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""

SQL_OP7 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(p.h) AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h
"""

SQL_OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT row_number() OVER () AS b, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
c AS (SELECT count(*) AS n, sum(len(w)) AS l FROM d WHERE len(w) > 0),
q AS (SELECT b, t, count(*) AS times FROM (SELECT b, unnest(w) AS t FROM b) GROUP BY b, t),
tf AS (
  SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(w) AS t FROM d)
  WHERE t IN (SELECT t FROM q) GROUP BY d, t),
wt AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), c),
m AS (SELECT d, doc_id, 75 + (25 * len(w) * n) // l AS m FROM d, c WHERE len(w) > 0),
s AS (
  SELECT b, d, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (t) JOIN wt USING (t) JOIN m USING (d) GROUP BY b, d),
r AS (
  SELECT b, doc_id, score, row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id) AS rank
  FROM s JOIN d USING (d) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r JOIN b USING (b) WHERE rank <= 20
"""

QUERIES = {
    "op1_additive_quality": op1_additive_quality,
    "op2_host_rules": op2_host_rules,
    "op3_anchor_expansion": op3_anchor_expansion,
    "op4_signature_tree_join": op4_signature_tree_join,
    "op5_phrase_index": op5_phrase_index,
    "op6_suffix_tree_repeats": op6_suffix_tree_repeats,
    "op7_warc_index_merge": op7_warc_index_merge,
    "op8_exact_complement_packing": op8_exact_complement_packing,
    "op9_string_kernel_language": op9_string_kernel_language,
    "op10_site_style_tree": op10_site_style_tree,
    "op11_reduced_alphabet": op11_reduced_alphabet,
    "op12_tokenization_automaton": op12_tokenization_automaton,
    "op13_hybrid_ranking": op13_hybrid_ranking,
}
ORACLES = {
    "op2_host_rules": SQL_OP2,
    "op5_phrase_index": SQL_OP5,
    "op7_warc_index_merge": SQL_OP7,
    "op13_hybrid_ranking": SQL_OP13,
}
