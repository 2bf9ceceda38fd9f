"""Registered retrieval queries (V1-V6, O2, J1, J2) on B-EMB (+ B-DOC texts).

Queries are derived from the corpus itself: the global centroid (V1), the ten
per-label centroids (V2-V6), and every vector whose id is divisible by 50 (the
``_join`` queries), so the work grows with the whole embeddings table. Texts: documents linked by ``doc_id = vec_id``; the searchable corpus
is the vectors that have a document (J1).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindle.operators import retrieval as R
from spindle.plans import bindings as b
from spindle.plans.registry import r4, register

K = 3

EXPL = "SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"
TEXT_IDS = "SELECT doc_id FROM documents"
LABEL_CENTROIDS = f"SELECT label AS qid, i, avg(v) AS cv FROM ({EXPL}) x GROUP BY label, i"
TEXT_CENTROIDS = f"SELECT label AS qid, i, avg(v) AS cv FROM ({EXPL}) x WHERE vec_id IN ({TEXT_IDS}) GROUP BY label, i"


def dist_sql(queries: str, corpus_filter: str = "") -> str:
    return f"""SELECT c.qid, e.vec_id AS id, sqrt(sum((e.v - c.cv) * (e.v - c.cv))) AS distance
  FROM ({EXPL}) e JOIN ({queries}) c ON e.i = c.i {corpus_filter} GROUP BY c.qid, e.vec_id"""


def ranked_sql(queries: str, corpus_filter: str = "") -> str:
    return f"""SELECT qid, id, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank
  FROM ({dist_sql(queries, corpus_filter)}) d"""


def corpus(spark, sf):
    return b.vectors(spark, sf)


def texts(spark, sf):
    return b.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def searchable(spark, sf):
    """Vectors that have a text."""
    return corpus(spark, sf).join(texts(spark, sf).select("id"), "id", "left_semi")


def label_queries(spark, sf, base=None):
    c = R.centroids(base if base is not None else corpus(spark, sf), "label")
    return c.select(F.col("label").alias("qid"), F.col("vec").alias("qvec"))


@register("v1_top_k_one_query", f"""WITH c AS (SELECT i, avg(v) AS cv FROM ({EXPL}) x GROUP BY i),
d AS (SELECT e.vec_id AS id, sqrt(sum((e.v - c.cv) * (e.v - c.cv))) AS distance FROM ({EXPL}) e JOIN c ON e.i = c.i
      GROUP BY e.vec_id)
SELECT id, round(distance, 4) AS distance FROM d ORDER BY distance, id LIMIT {K}""")
def v1(spark, sf):
    cp = corpus(spark, sf)
    q = R.centroids(cp.withColumn("g", F.lit(0)), "g").first()["vec"]  # one d-length vector
    return R.top_k_one(cp, q, K).select("id", r4("distance").alias("distance"))


@register("v2_knn_batch", f"""SELECT qid, id, round(distance, 4) AS distance, CAST(rank AS INTEGER) AS rank FROM ({ranked_sql(LABEL_CENTROIDS)}) r
WHERE rank <= {K}""")
def v2(spark, sf):
    m = R.knn(label_queries(spark, sf), corpus(spark, sf), K)
    return m.select("qid", "id", r4("distance").alias("distance"), "rank")


SEARCH_FILTER = f"WHERE e.vec_id IN ({TEXT_IDS})"
BEST_SQL = f"""SELECT q.qid AS qid, coalesce(t.text, 'No match found') AS context, coalesce(r.distance, 99.0) AS distance
FROM (SELECT DISTINCT label AS qid FROM embeddings) q
LEFT JOIN ({ranked_sql(LABEL_CENTROIDS, SEARCH_FILTER)}) r ON q.qid = r.qid AND r.rank = 1
LEFT JOIN documents t ON t.doc_id = r.id"""


def _best(spark, sf):
    qs = label_queries(spark, sf)
    m = R.knn(qs, searchable(spark, sf), 1)
    return R.best_match(qs, m, texts(spark, sf))


@register("v3_best_match_with_default", f"SELECT qid, context, round(distance, 4) AS distance FROM ({BEST_SQL}) x")
def v3(spark, sf):
    return _best(spark, sf).select("qid", "context", r4("distance").alias("distance"))


GRADE_SQL = f"""CASE WHEN distance <= {R.DISTANCE_THRESHOLD} THEN 'useful' WHEN retries >= 1 THEN 'too_many_retries'
  ELSE 'not_useful' END"""


@register("v4_grade", f"""SELECT qid, round(distance, 4) AS distance, {GRADE_SQL} AS grade
FROM (SELECT *, 0 AS retries FROM ({BEST_SQL}) x) y""")
def v4(spark, sf):
    g = R.grade(_best(spark, sf))
    return g.select("qid", r4("distance").alias("distance"), "grade")


@register("v5_retry_and_route", f"""WITH first AS (SELECT *, 0 AS retries, {GRADE_SQL} AS grade FROM (SELECT *, 0 AS retries
  FROM ({BEST_SQL}) x) y),
again AS (SELECT qid FROM first WHERE grade = 'not_useful'),
rw AS (SELECT * FROM ({TEXT_CENTROIDS}) c WHERE qid IN (SELECT qid FROM again)),
second AS (SELECT a.qid, coalesce(t.text, 'No match found') AS context, coalesce(r.distance, 99.0) AS distance, 1 AS retries
  FROM again a LEFT JOIN ({ranked_sql('SELECT * FROM rw', SEARCH_FILTER)}) r ON a.qid = r.qid AND r.rank = 1
  LEFT JOIN documents t ON t.doc_id = r.id),
routed AS (SELECT qid, context, distance, retries FROM first WHERE grade <> 'not_useful' UNION ALL SELECT * FROM second)
SELECT qid, round(distance, 4) AS distance, retries, {GRADE_SQL} AS grade FROM routed""")
def v5(spark, sf):
    g = R.grade(_best(spark, sf))
    rewrites = label_queries(spark, sf, base=searchable(spark, sf))
    out = R.retry(g.select("qid", "context", "distance", "grade"), rewrites, searchable(spark, sf), texts(spark, sf))
    return out.select("qid", r4("distance").alias("distance"), "retries", "grade")


@register("v6_prompts", f"""WITH r AS (SELECT * FROM ({ranked_sql(LABEL_CENTROIDS, SEARCH_FILTER)}) x WHERE rank <= {K}),
ctx AS (SELECT r.qid, string_agg(t.text, chr(10) || chr(10) ORDER BY r.rank) AS context
        FROM r JOIN documents t ON t.doc_id = r.id GROUP BY r.qid)
SELECT qid, context, 'Context: ' || context || chr(10) || chr(10) || 'Question: ' || 'documents closest to label '
  || CAST(qid AS VARCHAR) AS prompt FROM ctx""")
def v6(spark, sf):
    qs = label_queries(spark, sf)
    m = R.knn(qs, searchable(spark, sf), K)
    questions = qs.select("qid", F.concat(F.lit("documents closest to label "), F.col("qid").cast("string")).alias("question"))
    return R.prompts(m, texts(spark, sf), questions)


# ------------------------------------------------------------------ every id divisible by 50 as a query

ASKED = f"SELECT vec_id AS qid, i, v AS cv FROM ({EXPL}) x WHERE vec_id % 50 = 0"
BEST_JOIN_SQL = f"""SELECT q.qid AS qid, coalesce(t.text, 'No match found') AS context, coalesce(r.distance, 99.0) AS distance
FROM (SELECT vec_id AS qid FROM embeddings WHERE vec_id % 50 = 0) q
LEFT JOIN ({ranked_sql(ASKED, SEARCH_FILTER + " AND e.vec_id <> c.qid")}) r ON q.qid = r.qid AND r.rank = 1
LEFT JOIN documents t ON t.doc_id = r.id"""


def asked(spark, sf):
    return corpus(spark, sf).filter(F.col("id") % 50 == 0).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), "label")


def others(spark, sf, k):
    """The k nearest of each query's other vectors that have a text: itself is one more."""
    m = R.knn(asked(spark, sf).select("qid", "qvec"), searchable(spark, sf), k + 1).filter(F.col("id") != F.col("qid"))
    w = Window.partitionBy("qid").orderBy("rank")  # k + 1 rows
    return m.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _best_join(spark, sf):
    return R.best_match(asked(spark, sf), others(spark, sf, 1), texts(spark, sf))


@register("v2_knn_join", f"""SELECT qid, id, round(distance, 4) AS distance, CAST(rank AS INTEGER) AS rank FROM ({ranked_sql(ASKED)}) r
WHERE rank <= {K}""")
def v2j(spark, sf):
    m = R.knn(asked(spark, sf).select("qid", "qvec"), corpus(spark, sf), K)
    return m.select("qid", "id", r4("distance").alias("distance"), "rank")


@register("v3_best_match_join", f"SELECT qid, context, round(distance, 4) AS distance FROM ({BEST_JOIN_SQL}) x")
def v3j(spark, sf):
    return _best_join(spark, sf).select("qid", "context", r4("distance").alias("distance"))


@register("v4_grade_join", f"""SELECT qid, round(distance, 4) AS distance, {GRADE_SQL} AS grade
FROM (SELECT *, 0 AS retries FROM ({BEST_JOIN_SQL}) x) y""")
def v4j(spark, sf):
    return R.grade(_best_join(spark, sf)).select("qid", r4("distance").alias("distance"), "grade")


@register("v5_retry_and_route_join", f"""WITH first AS (SELECT *, 0 AS retries, {GRADE_SQL} AS grade FROM (SELECT *, 0 AS retries
  FROM ({BEST_JOIN_SQL}) x) y),
again AS (SELECT f.qid AS qid, e.label AS label FROM first f JOIN embeddings e ON e.vec_id = f.qid WHERE grade = 'not_useful'),
rw AS (SELECT a.qid AS qid, i, cv FROM again a JOIN ({TEXT_CENTROIDS}) c ON c.qid = a.label),
second AS (SELECT a.qid, coalesce(t.text, 'No match found') AS context, coalesce(r.distance, 99.0) AS distance, 1 AS retries
  FROM again a LEFT JOIN ({ranked_sql('SELECT * FROM rw', SEARCH_FILTER)}) r ON a.qid = r.qid AND r.rank = 1
  LEFT JOIN documents t ON t.doc_id = r.id),
routed AS (SELECT qid, context, distance, retries FROM first WHERE grade <> 'not_useful' UNION ALL SELECT * FROM second)
SELECT qid, round(distance, 4) AS distance, retries, {GRADE_SQL} AS grade FROM routed""")
def v5j(spark, sf):
    """A question without a useful match is asked again as the centroid of its label."""
    g = R.grade(_best_join(spark, sf))
    of = label_queries(spark, sf, base=searchable(spark, sf)).select(F.col("qid").alias("label"), "qvec")
    rewrites = asked(spark, sf).select("qid", "label").join(of, "label").select("qid", "qvec")
    out = R.retry(g.select("qid", "context", "distance", "grade"), rewrites, searchable(spark, sf), texts(spark, sf))
    return out.select("qid", r4("distance").alias("distance"), "retries", "grade")


@register("v6_prompts_join", f"""WITH r AS (SELECT * FROM ({ranked_sql(ASKED, SEARCH_FILTER + " AND e.vec_id <> c.qid")}) x WHERE rank <= {K}),
ctx AS (SELECT r.qid, string_agg(t.text, chr(10) || chr(10) ORDER BY r.rank) AS context
        FROM r JOIN documents t ON t.doc_id = r.id GROUP BY r.qid)
SELECT qid, context, 'Context: ' || context || chr(10) || chr(10) || 'Question: ' || 'documents like ' || CAST(qid AS VARCHAR) AS prompt FROM ctx""")
def v6j(spark, sf):
    questions = asked(spark, sf).select("qid", F.concat(F.lit("documents like "), F.col("qid").cast("string")).alias("question"))
    p = R.prompts(others(spark, sf, K), texts(spark, sf), questions)
    return p.filter(F.col("context") != "")


@register("j1_vectors_join_text", """SELECT e.vec_id AS id, d.lang AS lang, d.n_chars AS n_chars
FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id""")
def j1(spark, sf):
    d = b.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "n_chars")
    return corpus(spark, sf).select("id").join(d, "id")


@register("j2_vectors_left_join_text", f"""SELECT e.vec_id AS id, t.doc_id IS NOT NULL AS has_text
FROM embeddings e LEFT JOIN ({TEXT_IDS}) t ON e.vec_id = t.doc_id""")
def j2(spark, sf):
    t = texts(spark, sf).select("id", F.lit(True).alias("has_text"))
    return corpus(spark, sf).select("id").join(t, "id", "left").select("id", F.coalesce("has_text", F.lit(False)).alias("has_text"))
