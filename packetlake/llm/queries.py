"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (common, hard_negatives, mixing, multi_index, packing, phrases, pii, simhash_bktree, suffix_dedup, token_counts, topk_segments,
               toxicity_pu, url_filter, weighted_sampling)

# The rules of the URL query.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
TOKEN_LIMIT = 2048
QUERY_EVERY = 100      # searches ask for the rows whose vec_id is divisible by this


def op1_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_bktree.near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_bktree.hex_code("fp").alias("fingerprint"), "component_id")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = toxicity_pu.train(docs, common.table(spark, sf_dir, "labels"))
    return toxicity_pu.score(docs, model).select(
        "doc_id", F.coalesce(toxicity_pu.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= toxicity_pu.THRESHOLD).cast("int").alias("predicted"))


def byte_pieces(docs: DataFrame) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return packing.tokenize(docs, public_tokenizers.path("byte_bpe_50k.json"), ranks=ranks)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return packing.pack(byte_pieces(docs))


def op5_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(common.table(spark, sf_dir, "documents"), everywhere=True)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op6_segment_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_segments.exact_top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return (mixing.taken_words(*mixing.mix(docs))
            .select("doc_id", "size", "source_size", "target", "taken", "source",
                    F.transform("rounds", lambda r: r["slot"]).alias("slots")))


def op8_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {rows} AS rules(action, host, path)")
    return url_filter.judge_urls(common.table(spark, sf_dir, "pages"), rules)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(common.table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % QUERY_EVERY == 0)


def op12_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.fingerprints(common.table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(common.table(spark, sf_dir, "documents"))


_URL_SQL = """
WITH cut AS (
  SELECT page_id, instr(url, '://') AS mark, url FROM pages),
parts AS (
  SELECT page_id,
         CASE WHEN mark > 0 THEN translate(regexp_extract(substr(url, mark + 3), '^([^/?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN mark > 0 THEN regexp_extract(substr(url, mark + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM cut),
rules(action, rhost, rpath) AS (VALUES {rules}),
fits AS (
  SELECT page_id, host, path, rhost || rpath AS rule, action,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS n
  FROM parts, rules
  WHERE (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.n = 1
""".format(rules=", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES))

_TOP_K_SQL = f"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, cast(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON c.vec_id <> q.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0 AND len(q.v) = len(c.v))
SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
"""

_NEGATIVES_SQL = f"""
WITH whole AS (
  SELECT row_number() OVER () AS place, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * cast(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.place, a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same,
         cast(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM whole a JOIN whole c ON c.vec_id <> a.vec_id WHERE a.vec_id % {QUERY_EVERY} = 0 AND len(a.v) = len(c.v)),
positives AS (
  SELECT place, anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS n FROM scored WHERE same),
ranked AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.place, p.n ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s ON s.place = p.place AND NOT s.same
  WHERE p.n <= 5 AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, cast(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""

_PHRASES_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\x09]'), lambda x: x <> '') AS w FROM pieces),
total AS (SELECT lang, cast(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
counted AS (
  SELECT lang, m, phrase, count(*) AS f FROM (
    SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
    FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (SELECT unnest(range(1, 6)) AS m)))
  GROUP BY lang, m, phrase HAVING count(*) >= 100),
kept AS (
  SELECT * FROM counted c WHERE m >= 2 AND NOT EXISTS (
    SELECT 1 FROM counted d WHERE d.lang = c.lang AND d.m > c.m AND d.f >= c.f AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS first, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, t.n,
         cast((cast(1000 AS HUGEINT) * c.a * t.n) // (cast(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = c.first JOIN counted y ON y.lang = c.lang AND y.phrase = c.rest
  JOIN total t ON t.lang = c.lang),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS c FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE c = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_bktree": op1_simhash_bktree,
    "op2_token_counts": op2_token_counts,
    "op3_toxicity_pu": op3_toxicity_pu,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_pii_disclosure": op5_pii_disclosure,
    "op6_segment_top_k": op6_segment_top_k,
    "op7_source_mixing": op7_source_mixing,
    "op8_multi_index_hashing": op8_multi_index_hashing,
    "op9_url_filter": op9_url_filter,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_weighted_sampling": op12_weighted_sampling,
    "op13_phrases": op13_phrases,
}
ORACLES: dict[str, str] = {"op6_segment_top_k": _TOP_K_SQL, "op9_url_filter": _URL_SQL, "op11_hard_negatives": _NEGATIVES_SQL,
                           "op13_phrases": _PHRASES_SQL}
