"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spindle.llm import (arrow_ids, content_sort, conversation, merkle, mixing, near_dup, oracles, packing, page_text, sanitise,
                         secret_scan, shard_tree, toxicity, vector_codes)
from spindle.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_site_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.main_text(read_table(spark, sf_dir, "pages"))


@query
def op2_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(read_table(spark, sf_dir, "documents"))


@query
def op3_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("source")


@query
def op4_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_groups(read_table(spark, sf_dir, "documents"))


ORACLES["op4_content_sort"] = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""


@query
def op5_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(read_table(spark, sf_dir, "documents"))


ORACLES["op5_hash_threshold_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS z,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
      FROM d GROUP BY source),
-- sources in the order in which they reach three times their size
o AS (SELECT *, (SELECT sum(z) FROM s)::BIGINT - coalesce(sum(3 * z) OVER b, 0)::BIGINT AS rest,
                sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS weight
      FROM s WINDOW b AS (ORDER BY z / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 3 * z * weight <= rest * w AS capped FROM o),
f AS (SELECT rest, weight FROM c WHERE NOT capped ORDER BY z / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, z, CASE WHEN capped THEN (3 * z)::DOUBLE
                             ELSE (SELECT rest FROM f)::DOUBLE * w / (SELECT weight FROM f)::DOUBLE END AS target FROM c),
q AS (SELECT *, CASE WHEN z = 0 THEN 0 ELSE least(3, floor(target / z)) END::BIGINT AS q FROM t),
r AS (SELECT d.doc_id, d.size, q.z, q.target, q.q, q.target - q.q * q.z AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, z AS source_size, target,
       (q * size + CASE WHEN rest <= 0 OR below >= rest THEN 0 WHEN below + size <= rest THEN size
                        ELSE floor(rest - below) END)::BIGINT AS taken
FROM r
"""


@query
def op6_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return arrow_ids.read_documents(arrow_ids.write_shards(docs, public_tokenizers.path("word_bpe_49k.json")))


@query
def op7_naive_bayes_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


@query
def op8_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(read_table(spark, sf_dir, "documents"))


@query
def op9_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_classes(read_table(spark, sf_dir, "documents"))


@query
def op10_disclosure_sanitiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.personal_spans(read_table(spark, sf_dir, "documents"))


@query
def op11_norm_of_sum_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read_table(spark, sf_dir, "embeddings"))


ORACLES["op11_norm_of_sum_codes"] = oracles.codes_sql()


@query
def op12_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_tree.shards(read_table(spark, sf_dir, "documents"))


_TREE = shard_tree.even_tree()
ORACLES["op12_weighted_hash_tree"] = oracles.shards_sql(_TREE, shard_tree.grown(_TREE, shard_tree.SHARDS))


@query
def op13_run_length_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.repair(read_table(spark, sf_dir, "conversations"))


ORACLES["op13_run_length_repair"] = oracles.repair_sql()
