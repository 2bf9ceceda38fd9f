"""Edge tables and node profiles.

An edge table is a DataFrame ``(src, dst, attrs...)``; node ids are any
orderable type, the same on both sides. Null endpoints are rejected at build
time (Q15). Everything here is one or two aggregations; no loops.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.operators.graph.frontier import both_ways, is_prepared, undirected_edges


def build_edges(df: DataFrame, src: str | Sequence[str] = "src", dst: str | Sequence[str] = "dst",
                attrs: Sequence[str] = (), order_cols: Sequence[str] | None = None, sep: str = "|") -> DataFrame:
    """Edge table from a mapping table.

    * plain columns -> distinct ``(src, dst)`` (G1);
    * several columns per side -> node ids joined with ``sep``, nulls as empty text (G2);
    * ``attrs`` with ``order_cols`` -> one row per pair, attributes of the last
      row in that order win (G3, ``max_by`` keeps it one aggregation).
    """
    def node(cols):
        if isinstance(cols, str):
            return F.col(cols)
        return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])

    e = df.select(node(src).alias("src"), node(dst).alias("dst"), *attrs)
    e = e.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    if not attrs:
        return e.distinct()
    if order_cols is None:
        raise ValueError("attributes need an explicit order (last row wins)")
    e = df.select(node(src).alias("src"), node(dst).alias("dst"), *attrs, *order_cols) \
          .filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    ordering = F.struct(*[F.col(c) for c in order_cols])
    last = F.max_by(F.struct(*[F.col(a) for a in attrs]), ordering).alias("__last")
    return e.groupBy("src", "dst").agg(last).select("src", "dst", *[F.col(f"__last.{a}").alias(a) for a in attrs])


def plain(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) rows; a table of :func:`~spindle.operators.graph.frontier.prepared_edges` is that already."""
    e = edges.select("src", "dst")
    return e if is_prepared(edges) else e.distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    """Distinct node ids of an edge table, column ``node``."""
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def with_node_attrs(nodes: DataFrame, attrs: DataFrame, key: str = "node") -> DataFrame:
    """Node attributes by left join (unknown node -> nulls)."""
    return nodes.join(attrs, key, "left")


def node_profile(edges: DataFrame, multigraph: bool = False) -> DataFrame:
    """in/out degree, distinct in/out degree and position per node.

    Position: ``Start`` without predecessors, else ``End`` without successors,
    else ``Intermediate``. On the collapsed graph (default) degree equals
    distinct degree (Q23); ``multigraph=True`` counts duplicate rows.
    """
    e = edges.select("src", "dst") if multigraph else plain(edges)
    # pairs with their repeats, then every pair counted at both its ends: sums only, combined map-side
    pairs = e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")) if multigraph else e.withColumn("n", F.lit(1).cast("long"))
    z, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    ends = (pairs.select(F.col("src").alias("node"), z.alias("in_degree"), F.col("n").alias("out_degree"),
                         z.alias("distinct_in_degree"), one.alias("distinct_out_degree"))
                 .unionByName(pairs.select(F.col("dst").alias("node"), F.col("n").alias("in_degree"), z.alias("out_degree"),
                                           one.alias("distinct_in_degree"), z.alias("distinct_out_degree"))))
    counts = ("in_degree", "out_degree", "distinct_in_degree", "distinct_out_degree")
    prof = ends.groupBy("node").agg(*[F.sum(c).alias(c) for c in counts])
    pos = (F.when(F.col("in_degree") == 0, "Start").when(F.col("out_degree") == 0, "End")
            .otherwise("Intermediate"))
    return prof.withColumn("position", pos)


def roots(edges: DataFrame) -> DataFrame:
    """Nodes with in-degree 0 (column ``node``)."""
    return _only(edges, "src", "dst")


def leaves(edges: DataFrame) -> DataFrame:
    """Nodes with out-degree 0 (column ``node``)."""
    return _only(edges, "dst", "src")


def _only(edges: DataFrame, at: str, never: str) -> DataFrame:
    """Nodes at one end of the edges and never at the other: distinct ends on both sides, so
    a hub is one row, and no sort of them. Edges that lie by both their ends are merged as they lie."""
    back = both_ways(edges)
    if back is not None:
        here, there = (edges, back) if at == "src" else (back, edges)
        return (here.select(F.col("src").alias("node"))
                    .join(there.select(F.col("src").alias("node")), "node", "left_anti").distinct())
    return (edges.select(F.col(at).alias("node")).distinct()
                 .join(edges.select(F.col(never).alias("node")).distinct().hint("shuffle_hash"), "node", "left_anti"))


def out_degrees(edges: DataFrame) -> DataFrame:
    return plain(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))


def undirected(edges: DataFrame) -> DataFrame:
    """Symmetric edge table (each edge in both directions, collapsed)."""
    return undirected_edges(edges)


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"),
                        *[c for c in edges.columns if c not in ("src", "dst")])
