"""Exact nearest-neighbour retrieval, grading, retry routing and prompt text.

The batch search is a partitioned exact join. A bounded sample of the corpus gives
pivots; every corpus vector belongs to the cell of its nearest pivot. A cell's count
and radius bound, by the triangle inequality, the distance of a query's k-th
neighbour from above, and which cells can hold a nearer one: only those are visited.
Cells and the queries that visit them are dealt into blocks and meet in Spark,
block with block; a task holds one block of either side and returns the k nearest a
query, which are merged per query. Neither side passes through the driver, and no
(query, vector) pair is ever a row. In many dimensions the bounds rule out little,
and the join becomes a blocked nested loop, which is what exactness then costs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.session import cut_lineage, store

from spindle.functions.vectors import distance, literal_vector

# Fixed values of the reference's routing: no-match text and distance, grade threshold.
NO_MATCH_TEXT = "No match found"
NO_MATCH_DISTANCE = 99.0
DISTANCE_THRESHOLD = 1.1

MAX_QUERY_BYTES = 1 << 20    # query vectors of a block
CELL_ROWS = 8192             # corpus vectors of a block
PIVOTS = 32                  # cells; the sample that reaches the driver
CELL = 4_000_000             # differences held at once
QUERY_CELL = 512             # queries of a cell


def top_k_one(corpus: DataFrame, query: Sequence[float], k: int = 1, vec: str = "vec", id_col: str = "id",
              metric: str = "l2") -> DataFrame:
    """V1/O2: top-k of one query vector. The vector is a literal, the distance a
    JVM expression; ``orderBy().limit()`` plans as a per-partition top-k."""
    d = corpus.select(id_col, distance(F.col(vec), literal_vector(query), metric).alias("distance"))
    return d.orderBy(F.col("distance"), F.col(id_col)).limit(k)


def _merge(best_d, best_i, x, ids, qmat, k: int, metric: str):
    """The k nearest per query of what is kept and of the rows ``x``, in cells of at most
    ``CELL`` differences, whatever the number of queries."""
    rows = max(1, min(len(x), CELL // QUERY_CELL // max(1, qmat.shape[1])))
    for lo in range(0, len(x), rows):
        part, part_ids = x[lo:lo + rows], ids[lo:lo + rows]
        dist = np.empty((len(part), len(qmat)))
        for q in range(0, len(qmat), QUERY_CELL):
            c = qmat[q:q + QUERY_CELL]
            if metric == "l2":  # exact differences
                dist[:, q:q + QUERY_CELL] = np.sqrt(((part[:, None, :] - c[None, :, :]) ** 2).sum(axis=2))
            else:
                dist[:, q:q + QUERY_CELL] = 1.0 - (part @ c.T) / (np.linalg.norm(part, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :])
        idm = np.broadcast_to(part_ids[:, None], dist.shape)
        if best_d is not None:
            dist, idm = np.vstack([best_d, dist]), np.vstack([best_i, idm])
        order = np.lexsort((idm, dist), axis=0)[:k]  # (distance, id) per query
        best_d, best_i = np.take_along_axis(dist, order, axis=0), np.take_along_axis(idm, order, axis=0)
    return best_d, best_i


def _unit(x: np.ndarray, metric: str) -> np.ndarray:
    """Where the geometry is that of L2: the vectors, or their directions."""
    if metric == "l2":
        return x
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(((x - p) ** 2).sum(1))
    return out


class Cells:
    """Pivots, and per cell the number of corpus vectors and the radius."""

    def __init__(self, corpus: DataFrame, vec: str, id_col: str, metric: str, pivots: int):
        rows = corpus.orderBy(F.xxhash64(id_col), id_col).select(vec).limit(pivots).collect()  # a bounded sample
        self.metric, self.vec, self.id_col = metric, vec, id_col
        self.pivots = _unit(_matrix([r[vec] for r in rows]), metric) if rows else np.empty((0, 0))
        self.n, self.radius = np.zeros(len(rows), np.int64), np.zeros(len(rows))
        if rows:
            for r in self.placed(corpus).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("r")).collect():  # a row a pivot
                self.n[r["cell"]], self.radius[r["cell"]] = r["n"], r["r"]

    def placed(self, corpus: DataFrame) -> DataFrame:
        """``id, vec, cell, d``: the corpus with the cell of each vector and its distance to the pivot."""
        vec, id_col, pivots, metric = self.vec, self.id_col, self.pivots, self.metric

        def run(batches):
            for pdf in batches:
                if len(pdf):
                    d = _to_pivots(_unit(_matrix(pdf[vec]), metric), pivots)
                    cell = d.argmin(1)
                    yield pdf.assign(cell=cell.astype(np.int32), d=d[np.arange(len(d)), cell])

        return corpus.select(id_col, vec).mapInPandas(run, f"{id_col} {dict(corpus.dtypes)[id_col]}, {vec} array<double>, cell int, d double")

    def visited(self, queries: DataFrame, k: int) -> DataFrame:
        """``qid, qvec, cell``: a row for each cell that may hold one of a query's k nearest."""
        pivots, n, radius, metric = self.pivots, self.n, self.radius, self.metric

        def run(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                d = _to_pivots(_unit(_matrix(pdf["qvec"]), metric), pivots)
                far = np.where(n > 0, d + radius, np.inf)
                order = np.argsort(far, axis=1)
                enough = np.cumsum(n[order], axis=1) >= min(k, n.sum())
                bound = np.take_along_axis(far, np.take_along_axis(order, enough.argmax(1)[:, None], 1), 1)[:, 0]
                near = (n > 0) & (d - radius <= (bound * (1 + 1e-9) + 1e-9)[:, None])
                row, cell = np.nonzero(near)
                yield pd.DataFrame({"qid": pdf["qid"].to_numpy()[row], "qvec": pdf["qvec"].to_numpy()[row], "cell": cell.astype(np.int32)})

        return queries.mapInPandas(run, f"qid {dict(queries.dtypes)['qid']}, qvec array<double>, cell int")


def _sides(queries: DataFrame, corpus: DataFrame, vec: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    q = queries.select("qid", F.col("qvec").cast("array<double>").alias("qvec")).filter(F.col("qvec").isNotNull())
    return q, corpus.select(id_col, F.col(vec).cast("array<double>").alias(vec)).filter(F.col(vec).isNotNull())


def cells_visited(queries: DataFrame, corpus: DataFrame, k: int = 1, vec: str = "vec", id_col: str = "id", metric: str = "l2",
                  pivots: int = PIVOTS) -> DataFrame:
    """``qid, visited, cells, vectors``: how many of the cells, and of the corpus' vectors in them,
    the exact search of each query has to read."""
    q, c = _sides(queries, corpus, vec, id_col)
    cells = Cells(c, vec, id_col, metric, pivots)
    size = F.get(F.array(*[F.lit(int(n)) for n in cells.n] or [F.lit(0)]), F.col("cell"))
    return cells.visited(q, k).groupBy("qid").agg(F.count(F.lit(1)).alias("visited"), F.lit(int((cells.n > 0).sum())).alias("cells"),
                                                  F.sum(size).cast("long").alias("vectors"))


def knn(queries: DataFrame, corpus: DataFrame, k: int = 1, vec: str = "vec", id_col: str = "id",
        metric: str = "l2", max_query_bytes: int = MAX_QUERY_BYTES, pivots: int = PIVOTS) -> DataFrame:
    """V2: exact top-k per query. ``queries(qid, qvec)``, ``corpus(id, vec)``.

    Returns ``(qid, id, distance, rank)`` with ties broken by ``id``. Null vectors
    are left out on both sides. ``max_query_bytes``: query vectors that a task holds at once.
    """
    spark = corpus.sparkSession
    qtype, itype = dict(queries.dtypes)["qid"], dict(corpus.dtypes)[id_col]
    q, c = _sides(queries, corpus, vec, id_col)
    cells = Cells(c, vec, id_col, metric, pivots)
    if not len(cells.pivots):
        return spark.createDataFrame([], f"qid {qtype}, {id_col} {itype}, distance double, rank int")
    wanted = store(cells.visited(q, k))
    visits = np.zeros(len(cells.n), np.int64)
    for r in wanted.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a pivot
        visits[r["cell"]] = r["n"]
    rows = max(1, max_query_bytes // (cells.pivots.shape[1] * 8 + 64))
    of = lambda counts: F.get(F.array(*[F.lit(int(x)) for x in counts]), F.col("cell"))
    c_blocks, q_blocks = of(-(-cells.n // CELL_ROWS)), of(-(-visits // rows))
    none = lambda kind: F.lit(None).cast(kind)
    dealt = lambda blocks: F.explode(F.sequence(F.lit(0), blocks - 1))
    left = (cells.placed(c).filter(q_blocks > 0).withColumn("cb", F.pmod(F.xxhash64(id_col), c_blocks).cast("int")).withColumn("qb", dealt(q_blocks))
                 .select("cell", "cb", "qb", none(qtype).alias("qid"), F.col(id_col).alias("id"), F.col(vec).alias("v"), F.lit(False).alias("asks")))
    right = (wanted.withColumn("qb", F.pmod(F.xxhash64("qid"), q_blocks).cast("int")).withColumn("cb", dealt(c_blocks))
                   .select("cell", "cb", "qb", "qid", none(itype).alias("id"), F.col("qvec").alias("v"), F.lit(True).alias("asks")))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy()
        mine, theirs = pdf[asks], pdf[~asks]
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"qid": mine["qid"][:0], id_col: theirs["id"][:0], "distance": np.empty(0)})
        best_d, best_i = _merge(None, None, _matrix(theirs["v"]), theirs["id"].to_numpy(), _matrix(mine["v"]), k, metric)
        return pd.DataFrame({"qid": np.tile(mine["qid"].to_numpy(), len(best_d)), id_col: best_i.reshape(-1), "distance": best_d.reshape(-1)})

    found = left.unionByName(right).groupBy("cell", "cb", "qb").applyInPandas(block, f"qid {qtype}, {id_col} {itype}, distance double")
    w = Window.partitionBy("qid").orderBy(F.col("distance"), F.col(id_col))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def best_match(questions: DataFrame, matches: DataFrame, texts: DataFrame, id_col: str = "id",
               text_col: str = "content") -> DataFrame:
    """V3: per question the best match that has a text, else the default
    (``No match found``, 99.0). ``matches(qid, id, distance, rank)`` come from
    :func:`knn` over the corpus restricted to vectors with text (J1)."""
    top = matches.filter(F.col("rank") == 1).join(texts.select(id_col, text_col), id_col, "inner")
    j = questions.select("qid").join(top.select("qid", text_col, "distance"), "qid", "left")
    return j.select("qid", F.coalesce(F.col(text_col), F.lit(NO_MATCH_TEXT)).alias("context"),
                    F.coalesce(F.col("distance"), F.lit(NO_MATCH_DISTANCE)).alias("distance"))


def grade(df: DataFrame, threshold: float = DISTANCE_THRESHOLD, retries: str | Column | None = None) -> DataFrame:
    """V4: ``useful`` if distance <= threshold, else ``too_many_retries`` after one
    retry, else ``not_useful``."""
    r = F.lit(0) if retries is None else (F.col(retries) if isinstance(retries, str) else retries)
    g = (F.when(F.col("distance") <= threshold, "useful")
          .when(F.coalesce(r, F.lit(0)) >= 1, "too_many_retries")
          .otherwise("not_useful"))
    return df.withColumn("grade", g)


def retry(graded: DataFrame, rewrites: DataFrame, corpus: DataFrame, texts: DataFrame, k: int = 1,
          threshold: float = DISTANCE_THRESHOLD, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """V5: one retry pass. ``not_useful`` questions are searched again with their
    rewritten vector (``rewrites(qid, qvec)``), graded with ``retries = 1``, and
    routed together with the rows that needed no retry.

    Returns ``(qid, context, distance, retries, grade)``.
    """
    graded = cut_lineage(graded)  # the first pass runs once and feeds both branches
    keep = graded.filter(F.col("grade") != "not_useful").select("qid", "context", "distance") \
                 .withColumn("retries", F.lit(0))
    again = rewrites.join(graded.filter(F.col("grade") == "not_useful").select("qid"), "qid", "left_semi")
    m = knn(again, corpus, k, id_col=id_col)
    second = best_match(again, m, texts, id_col, text_col).withColumn("retries", F.lit(1))
    return grade(keep.unionByName(second), threshold, "retries")


def prompts(matches: DataFrame, texts: DataFrame, questions: DataFrame, id_col: str = "id",
            text_col: str = "content", template: str = "Context: %s\n\nQuestion: %s", sep: str = "\n\n") -> DataFrame:
    """V6: per question the matched texts in rank order joined by ``sep`` and the
    prompt text ``format_string(template, context, question)``."""
    j = matches.join(texts.select(id_col, text_col), id_col)
    ctx = j.groupBy("qid").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", text_col))), lambda s: s[text_col]),
                     sep).alias("context"))
    q = questions.select("qid", "question").join(ctx, "qid", "left")
    q = q.withColumn("context", F.coalesce("context", F.lit("")))
    return q.select("qid", "context", F.format_string(template, F.col("context"), F.col("question")).alias("prompt"))


def centroids(corpus: DataFrame, by: str, vec: str = "vec") -> DataFrame:
    """Mean vector per group ``(by, vec)``: explode positions, average, regroup in order."""
    x = corpus.select(by, F.posexplode(vec).alias("pos", "v"))
    m = x.groupBy(by, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return m.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias(vec))
