"""Graph algebra: induced subgraphs, merge, disjointness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.operators.graph.frontier import as_nodes


def induced(edges: DataFrame, nodes, by: Sequence[str] = ()) -> DataFrame:
    """Edges with both endpoints in ``nodes`` (semi joins on src and dst).

    ``by``: extra key columns of ``nodes`` (e.g. ``start``) giving one subgraph
    per key -- for G30 pass the reach set ``(start, node)``.
    """
    n = nodes if isinstance(nodes, DataFrame) else as_nodes(edges.sparkSession, nodes, dict(edges.dtypes)["src"])
    if not by:
        n = n.select("node").distinct()
        return (edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi")
                     .join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")
                     .select(*edges.columns))
    keys = list(by)
    a = n.select(*keys, F.col("node").alias("src"))
    b = n.select(*keys, F.col("node").alias("dst"))
    return edges.join(a, "src").join(b, keys + ["dst"], "left_semi").select(*keys, *edges.columns)


def merge_graphs(g1: DataFrame, g2: DataFrame, key: Sequence[str] = ("src", "dst"),
                 attrs: Sequence[str] = ()) -> DataFrame:
    """Union of two edge (or node) tables on ``key``; attributes of ``g2`` win,
    its nulls too."""
    k = list(key)
    a = g1.select(*k, *[F.col(c).alias(f"__a_{c}") for c in attrs])
    b = g2.select(*k, *[F.col(c).alias(f"__b_{c}") for c in attrs]).withColumn("__in_b", F.lit(True))
    j = a.join(b, k, "full")
    return j.select(*k, *[F.when(F.col("__in_b"), F.col(f"__b_{c}")).otherwise(F.col(f"__a_{c}")).alias(c)
                          for c in attrs])


def disjoint(nodes1: DataFrame, nodes2: DataFrame) -> DataFrame:
    """One row ``(shared_nodes, disjoint)``; a semi join, never a collect."""
    shared = nodes1.select("node").distinct().join(nodes2.select("node"), "node", "left_semi")
    return shared.agg(F.count(F.lit(1)).alias("shared_nodes")).withColumn("disjoint", F.col("shared_nodes") == 0)
