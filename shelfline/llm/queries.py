"""Registered queries of the corpus operators, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfline.llm.bpe import encode_documents
from shelfline.llm.common import table
from shelfline.llm.filter_audit import audit_documents
from shelfline.llm.html_text import extract_pages
from shelfline.llm.lexical import rank_documents
from shelfline.llm.lm_scoring import score_documents
from shelfline.llm.mixing import taken_words
from shelfline.llm.pii import pseudonymise
from shelfline.llm.quality import judge_quality
from shelfline.llm.secrets import findings
from shelfline.llm.sharding import shard_by_sampled_splitters
from shelfline.llm.simhash import near_duplicates
from shelfline.llm.token_counts import token_counts
from shelfline.llm.topk import top_k_of_every_hundredth

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


@query("op10_sampled_splitters")
def sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_sampled_splitters(table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op8_mixing_blocks")
def mixing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op2_byte_bpe_matrices")
def byte_bpe_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op9_distinct_token_counts")
def distinct_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)


@query("op7_simhash_covering")
def simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op3_robust_outliers")
def robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


@query("op5_segment_topk", """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.vec, x.vec)::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id AND len(q.vec) = len(x.vec) WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
""")
def segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_of_every_hundredth(table(spark, sf_dir, "embeddings"))


@query("op6_forest_secrets")
def forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(table(spark, sf_dir, "documents"))


@query("op4_cross_entropy_difference")
def cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return score_documents(table(spark, sf_dir, "documents"), good)


@query("op1_keyed_surrogates")
def keyed_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents")).select("doc_id", "n_surrogates", "text")


@query("op11_reversed_search", r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), i AS (
  SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)
), q AS (SELECT item_id, text, term, count(*) AS repeats FROM i GROUP BY ALL
), c AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS length FROM d WHERE len(terms) > 0
), t AS (SELECT doc, doc_id, len(terms) AS n, unnest(terms) AS term FROM d
), f AS (SELECT doc, doc_id, n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight
  FROM (SELECT term, count(*) AS df FROM f GROUP BY term), c
), s AS (
  SELECT item_id, text, doc, doc_id, sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN w USING (term), c GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
""")
def reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20).select("item_id", "rank", "doc_id", "score")


@query("op12_composite_density")
def composite_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


@query("op13_filter_paths", r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), b AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    doc_id > min(doc_id) OVER (PARTITION BY text) AS e FROM d
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(e, false)::INT AS failed,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM b LEFT JOIN l USING (doc_id)
), n AS (
  SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL
), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), s AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS state FROM o, range(1, 6) AS r(step)
), k AS (
  SELECT part, filter_order, step, bit,
    sum(n) FILTER (failed & (state | bit) = 0) AS kept, sum(n) FILTER (failed & state = 0 AND failed & bit > 0) AS removed,
    sum(n) FILTER (failed & state > 0 AND failed & bit > 0) AS redundant, sum(n) FILTER (failed = bit) AS unique_fails,
    sum(good) FILTER (failed & state = 0 AND failed & bit > 0) AS good_lost, sum(toxic) FILTER (failed & state = 0 AND failed & bit > 0) AS toxic_lost
  FROM n, s GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM k
""")
def filter_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
