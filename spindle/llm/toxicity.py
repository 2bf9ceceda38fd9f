"""Toxicity score (operator 7): a linear classifier over character n-grams whose
features are scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed n-grams of its lower-cased
characters. Over the training rows, Spark counts in how many texts of either
class a feature occurs; the log-count ratio ``r`` of the smoothed counts scales
the feature, and a logistic regression is fitted on the scaled features. The
fit uses at most ``PER_CLASS`` labelled rows a class (those of the smallest
identifier hash; the intercept is then moved by the log odds of the share taken
of either class, so that scores keep the rate of all labelled rows) and every feature
whose ratio differs from chance: its likelihood-ratio statistic is beyond what one
of all counted features would reach by chance (``CHANCE`` of them expected). There is
no bound on their number. Scoring reads every whole text in one pass without a
shuffle.

Empty or null texts score the intercept. Without labelled rows of both classes
there is nothing to tell them apart by and every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import stash, whole_text

SIZES = (3, 4, 5, 6)       # n of the n-grams
BITS = 20                  # hashed features: 2^BITS
PER_CLASS = 8_000          # labelled rows fitted on, of each class at most
CHANCE = 1.0               # features expected to be taken by chance alone
SMOOTH = 1.0
RIDGE = 1e-3
FOLDS = 5
BLOCK = 500_000            # features of rows that a step of the fit holds at once


@dataclass
class Model:
    features: np.ndarray   # sorted hashed ids
    weights: np.ndarray
    intercept: float


def grams(text: str, bits: int = BITS) -> np.ndarray:
    """Hashed ids of all n-grams of a text (with repeats), white space as one space."""
    chars = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le"), "<u4")
    out, h = [], chars
    for n in range(2, max(SIZES) + 1):
        if len(chars) < n:
            break
        h = h[:-1] * np.uint32(0x01000193) + chars[n - 1:]
        if n in SIZES:
            x = (h ^ np.uint32(n * 0x9E37)) * np.uint32(0x85EBCA6B)
            out.append((x ^ (x >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def distinct(ids: np.ndarray, bits: int = BITS) -> np.ndarray:
    seen = np.zeros(1 << bits, bool)
    seen[ids] = True
    return np.flatnonzero(seen).astype("<u4")


def held_out(id_col: str = "doc_id") -> F.Column:
    """crc32 of the identifier as text, modulo 5, is 0 (a null identifier counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def training_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``__id, y``: the labelled identifiers outside the held-out fold."""
    return (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
                  .groupBy(F.col(id_col).alias("__id")).agg((F.max(label_col) > 0).cast("int").alias("y")))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                  per_class: int) -> DataFrame:
    """``__text, y``: at most ``per_class`` labelled rows a class, none of the held-out fold."""
    known = training_labels(labels, id_col, label_col)
    order = [F.xxhash64("__id"), F.col("__id")]
    picked = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(*order).limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 * per_class rows of two numbers: small by construction
    return (docs.select(F.col(id_col).alias("__id"), whole_text(text_col).alias("__text"))
                .join(F.broadcast(picked), "__id").select("__text", "y"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        per_class: int = PER_CLASS, chance: float = CHANCE, bits: int = BITS) -> Model:
    """The model of the labelled rows outside the held-out fold.

    Rows that repeat an identifier are trained on each; a label given twice is toxic if one is.
    An empty table, or labels of one class only, give a model that scores 0.
    """
    rows = training_rows(docs, labels, id_col, text_col, label_col, per_class)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [distinct(grams(t.as_py(), bits), bits).tobytes() for t in part["__text"]]
                yield pa.RecordBatch.from_arrays([part["y"], pa.array(ids, pa.binary())], names=["y", "ids"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << bits), np.int64)
        for b in batches:
            for y, raw in zip(b["y"].to_pylist(), b["ids"].to_pylist(), strict=True):
                seen[y, np.frombuffer(raw, "<u4")] += 1
        at = np.flatnonzero(seen.sum(0))
        for k in range(0, len(at), 50_000):
            i = at[k:k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(seen[0, i]), pa.array(seen[1, i])],
                                             names=["f", "clean", "toxic"])

    table = stash(rows.mapInArrow(featurise, "y int, ids binary"), "toxicity-train")
    n = {r["y"]: r["n"] for r in table.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return Model(np.empty(0, np.uint32), np.empty(0), -np.inf)
    c = stash(table.mapInArrow(counts, "f long, clean long, toxic long").groupBy("f").agg(
        F.sum("clean").alias("c"), F.sum("toxic").alias("t")), "toxicity-counts")  # at most 2^bits features
    limit = NormalDist().inv_cdf(1 - min(0.5, chance / (2 * max(c.count(), 1)))) ** 2 / 2  # 2 g is chi-squared, 1 degree
    p, q = (F.col("t") + SMOOTH) / (n1 + 2 * SMOOTH), (F.col("c") + SMOOTH) / (n0 + 2 * SMOOTH)
    both = (F.col("t") + F.col("c") + 2 * SMOOTH) / (n0 + n1 + 4 * SMOOTH)
    bits_of = lambda k, m, a: k * F.log(a / both) + (m - k) * F.log((1 - a) / (1 - both))
    top = (c.select("f", F.log(p / q).alias("r"), (bits_of(F.col("t"), n1, p) + bits_of(F.col("c"), n0, q)).alias("g"))
            .filter(F.col("g") >= limit).select("f", "r").toPandas().sort_values("f"))
    feats, ratio = top["f"].to_numpy(np.uint32), top["r"].to_numpy(float)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.searchsorted(feats, np.intersect1d(np.frombuffer(x, "<u4"), feats, assume_unique=True)).astype("<u4").tobytes()
                   for x in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["y"], pa.array(ids, pa.binary())], names=["y", "ids"])

    # at most 2 * per_class rows, fetched a partition at a time
    ys, ids = [], []
    for r in table.mapInArrow(narrow, "y int, ids binary").toLocalIterator(prefetchPartitions=False):
        ys.append(r["y"])
        ids.append(np.frombuffer(bytes(r["ids"]), "<u4"))
    weights, intercept = regression(ids, np.array(ys, float), ratio)
    # the rate of all labelled rows that have a document, not of those fitted on
    known = training_labels(labels, id_col, label_col).join(docs.select(F.col(id_col).alias("__id")), "__id")
    of = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    intercept += float(np.log(of[1] / n1) - np.log(of[0] / n0))
    return Model(feats, weights, intercept)


def regression(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, steps: int = 200) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on ``ratio``-scaled binary features (Adam, full batch); a
    block of rows at a time, so that only the features' numbers are held for all of them."""
    size = np.array([len(x) for x in rows], np.int64)
    edges = np.concatenate([[0], np.cumsum(size)])
    col = np.concatenate(rows) if len(rows) else np.empty(0, np.uint32)
    rows.clear()
    cut = np.unique(np.concatenate([np.searchsorted(edges, np.arange(0, edges[-1], BLOCK), side="left"), [len(size)]]))
    blocks = [(a, e) for a, e in zip([0, *cut.tolist()], cut.tolist()) if e > a]
    w, b = np.zeros(len(ratio)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        g, gb, scaled = np.zeros_like(w), 0.0, w * ratio
        for lo, hi in blocks:
            c = col[edges[lo]:edges[hi]]
            row = np.repeat(np.arange(hi - lo), size[lo:hi])
            z = np.bincount(row, scaled[c], minlength=hi - lo) + b
            err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[lo:hi]) / len(y)
            g += np.bincount(c, err[row], minlength=len(w))
            gb += err.sum()
        g = g * ratio + RIDGE * w / max(len(w), 1)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.05 / (1 - 0.9 ** t) * np.sqrt(1 - 0.99 ** t)
        w -= rate * m / (np.sqrt(v) + 1e-8)
        b -= rate * mb / (np.sqrt(vb) + 1e-8)
    return w * ratio, float(b)


class Scorer:
    def __init__(self, model: Model, bits: int = BITS):
        self.bits, self.intercept = bits, model.intercept
        self.weight = np.zeros(1 << bits, np.float32)
        self.weight[model.features] = model.weights

    def __call__(self, text: str | None) -> float:
        ids = grams(text or "", self.bits)
        hit = np.unique(ids[self.weight[ids] != 0])  # only what the model knows
        z = float(self.weight[hit].sum(dtype=np.float64)) + self.intercept
        return float(1 / (1 + np.exp(-max(z, -700.0))))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: ``doc_id, held_out, score, predicted``."""
    src = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), whole_text(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Scorer(model)
        for b in batches:
            s = [of(t.as_py()) for t in b["__text"]]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["held_out"], pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"])

    kind = dict(src.dtypes)["doc_id"]
    return src.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input's rows and columns without the texts the model predicts toxic."""

    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Scorer(model)
        for b in batches:
            yield b.filter(pa.array([of(t.as_py()) < 0.5 for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
