"""Vector distance expressions (JVM-side higher-order functions, no UDF)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def l2_distance(a: str | Column, b: str | Column) -> Column:
    """Euclidean distance of two equal-length arrays, summed in double."""
    sq = F.zip_with(_c(a).cast("array<double>"), _c(b).cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0).cast("double"), lambda acc, v: acc + v))


def dot(a: str | Column, b: str | Column) -> Column:
    pr = F.zip_with(_c(a).cast("array<double>"), _c(b).cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(pr, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: str | Column, b: str | Column) -> Column:
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))


def distance(a: str | Column, b: str | Column, metric: str = "l2") -> Column:
    """``metric``: ``l2`` (what the reference computes, Q21) or ``cosine``."""
    if metric == "l2":
        return l2_distance(a, b)
    if metric == "cosine":
        return cosine_distance(a, b)
    raise ValueError(metric)
