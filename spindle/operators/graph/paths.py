"""Path enumeration, path reports, path counting and path compression.

Path enumeration is exponential by nature; :func:`path_counts` tells the number
of paths on acyclic input without enumerating. No operator has a bound unless
the caller gives one, and then the open paths come back flagged.
"""

from __future__ import annotations

import re

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.operators.graph import edges as E
from spindle.operators.graph.frontier import ARROW, Rounds, as_nodes, is_prepared, path_text, prepared_edges, reversed_edges, walk_paths
from spindle.session import cut_lineage, store


def leaf_paths(edges: DataFrame, starts=None, max_levels: int | None = None, emit_truncated: bool = False,
               notes: DataFrame | None = None, hop_notes: DataFrame | None = None) -> DataFrame:
    """All simple paths from each start (default: every node) to a node without successors.

    From every node, the paths grow backwards from the leaves: each path of a round is a
    result and is written once, where a walk from the nodes also carries every open prefix.

    Paths that stop only because every successor is already on the path are
    dropped (Q9) unless ``emit_truncated`` (then flagged ``truncated``). With
    ``max_levels`` the paths that are open at the bound are flagged as well. ``notes`` and
    ``hop_notes``: what :func:`walk_paths` takes along of the nodes and edges of whole paths.
    """
    if starts is None and (max_levels is not None or emit_truncated or notes is not None or hop_notes is not None):
        starts = E.nodes_of(edges)
    if starts is None:
        return _paths_into_leaves(edges)
    return walk_paths(edges, starts, max_levels=max_levels, guard="path", emit="leaf",
                      emit_truncated=emit_truncated, notes=notes, hop_notes=hop_notes)


def _paths_into_leaves(edges: DataFrame) -> DataFrame:
    # edges that lie in no layout yet are laid out by their ends alone
    back = reversed_edges(edges) if is_prepared(edges) else prepared_edges(E.reverse(edges.select("src", "dst")))
    front = store(E.roots(back).select(F.array("node").alias("path")))
    out = []
    while not front.isEmpty():
        out.append(front)
        step = front.withColumn("at", F.element_at("path", 1)).join(back, F.col("at") == back["src"]).filter(~F.array_contains("path", F.col("dst")))
        front = store(step.select(F.array_prepend("path", F.col("dst")).alias("path")))
    return _union_counts(out or [front]).select(F.element_at("path", 1).alias("start"), "path").withColumn("levels", (F.size("path") - 1).cast("int"))


def paths_between(edges: DataFrame, starts, ends, max_levels: int | None = None) -> DataFrame:
    """All simple paths from each start to each end node (a path stops at its end)."""
    spark = edges.sparkSession
    ends_df = as_nodes(spark, ends, dict(edges.dtypes)["src"])
    return walk_paths(edges, starts, max_levels=max_levels, guard="path", emit="end", ends=ends_df) \
        .filter(F.col("levels") > 0)


def prefix_walks(edges: DataFrame, starts, max_levels: int | None = None) -> DataFrame:
    """Every walk prefix from each start with its depth; duplicate edges kept,
    no cycle guard, so a cyclic graph needs ``max_levels`` (Q10)."""
    return walk_paths(edges, starts, max_levels=max_levels, guard="none", emit="all", collapse=False)


def path_report(paths: DataFrame, max_levels: int = 10, path_col: str = "path") -> DataFrame:
    """``path`` text joined by `` -> ``, ``levels``, ``start``, ``end`` and a
    wide ``level_1..level_n`` projection (``overflow`` when a path is longer)."""
    p = F.col(path_col)
    out = paths.select(
        "*",
        path_text(p).alias("path_text"),
        (F.size(p) - 1).cast("int").alias("n_levels"),
        F.element_at(p, 1).cast("string").alias("path_start"),
        F.element_at(p, -1).cast("string").alias("path_end"),
        *[F.get(p, i).cast("string").alias(f"level_{i + 1}") for i in range(max_levels)],
        (F.size(p) > max_levels).alias("overflow"),
    )
    return out


def path_details(paths: DataFrame, id_col: str, details: DataFrame | None = None,
                 edge_attrs: DataFrame | None = None, detail_cols: tuple[str, ...] = (),
                 attr: str | None = None, path_col: str = "path") -> DataFrame:
    """Per path, the node details of every level and ``a -> b`` attribute text
    of every hop, as arrays in path order.

    Paths are numbered and written once. One explode of the paths meets the details and one the
    edge attributes (one row a node or edge, unknown node -> null, Q20); only the levels that
    found something are regrouped, by the path's number, and never a path's text. Never a
    driver loop over levels. Paths that took their ``notes`` or ``hop_notes`` along
    (:func:`node_notes`, :func:`hop_notes`, :func:`leaf_paths`) are not moved at all.
    """
    taken = [c for c in ("notes", "hop_notes") if c in paths.columns]
    if taken:
        if details is not None or edge_attrs is not None:
            raise ValueError("paths with notes need no details")
        def noted(name):
            return lambda x: x[name].cast("string")
        out = [F.col(id_col), *[F.transform("notes", noted(c)).alias(f"{c}_levels") for c in detail_cols]]
        if attr is not None:
            out.append(F.array_join(F.transform("hop_notes", lambda x: F.coalesce(x.cast("string"), F.lit(""))), ARROW).alias(f"{attr}_hops"))
        return paths.select(*out)
    p = store(paths.select(id_col, F.col(path_col).alias("__path"), F.monotonically_increasing_id().alias("__id")))
    x = p.select("__id", "__path", F.posexplode("__path").alias("pos", "node"))
    found = []
    if details is not None:
        # one whole detail row a node: the smallest
        d = store(node_notes(details, detail_cols)).withColumnRenamed("note", "d")
        found.append(x.select("__id", "pos", "node").join(d, "node").groupBy("__id").agg(
            F.map_from_entries(F.collect_list(F.struct("pos", "d"))).alias("__d")))
    if edge_attrs is not None and attr is not None:
        ea = store(hop_notes(edge_attrs, attr).select(F.col("src").alias("node"), F.col("dst").alias("next"), F.col("note").alias("h")))
        hops = x.select("__id", "pos", "node", F.get("__path", F.col("pos") + 1).alias("next")).filter("next IS NOT NULL")
        found.append(hops.join(ea, ["node", "next"]).groupBy("__id").agg(
            F.map_from_entries(F.collect_list(F.struct("pos", "h"))).alias("__h")))
    g = p
    for f in found:
        g = g.join(f, "__id", "left")
    out = [F.col(id_col)]
    at = F.sequence(F.lit(0), F.size("__path") - 1)

    def field(name):
        return lambda i: F.try_element_at("__d", i)[name].cast("string")
    for c in detail_cols:
        out.append(F.transform(at, field(c)).alias(f"{c}_levels"))
    if edge_attrs is not None and attr is not None:
        # hop i belongs to level i: a hop without an attribute keeps its place, empty
        hops = F.transform(F.slice(at, F.lit(1), F.size(at) - 1), lambda i: F.coalesce(F.try_element_at("__h", i).cast("string"), F.lit("")))
        out.append(F.array_join(hops, ARROW).alias(f"{attr}_hops"))
    return g.select(*out)


def node_notes(details: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """``node, note``: one whole detail row a node, the smallest."""
    return details.groupBy("node").agg(F.min(F.struct(*cols)).alias("note"))


def hop_notes(edge_attrs: DataFrame, attr: str) -> DataFrame:
    """``src, dst, note``: the smallest attribute of an edge that has one."""
    return edge_attrs.groupBy("src", "dst").agg(F.min(attr).alias("note")).filter("note IS NOT NULL")


def path_counts(edges: DataFrame, starts=None, max_level: int | None = None) -> DataFrame:
    """On an acyclic graph, per start (default: every node) the number of walks and of
    paths ending in a leaf -- no path is built, and no row per (start, node).

    Counted from the leaves: a node is done when all its successors are, and has the
    sum of their counts, so every edge is read once and a count per node serves all
    starts. Equals the row counts of :func:`prefix_walks` / :func:`leaf_paths` on a DAG.
    Counts are ``decimal(38,0)``. A cycle below a start raises ``ValueError`` (its walks
    have no end), unless ``max_level`` bounds them.
    """
    if max_level is not None:
        return _bounded_counts(edges, starts, max_level)
    number = "decimal(38,0)"
    e = prepared_edges(edges)
    back = reversed_edges(e)
    s = None if starts is None else store(as_nodes(edges.sparkSession, starts, dict(edges.dtypes)["src"]))
    need = e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("need")).persist(StorageLevel.MEMORY_AND_DISK)
    ended = E.leaves(e)
    if s is not None:  # a start may be no node of the edges
        ended = ended.union(s.join(need, "node", "left_anti")).distinct()
    one = F.lit(1).cast(number)
    front = store(ended.select("node", one.alias("walks"), one.alias("leaf_paths")))
    out, waiting, done = [front], None, 0
    while True:
        # the edges lie by their ends: what moves is a sum per node that an edge leads from
        step = back.join(front.withColumnRenamed("node", "src"), "src").select(
            F.col("dst").alias("node"), F.lit(1).cast("long").alias("got"), "walks", "leaf_paths")
        if waiting is not None:  # nodes some of whose successors were done before
            step = step.unionByName(waiting)
        sums = step.groupBy("node").agg(F.sum("got").alias("got"), *[F.sum(c).cast(number).alias(c) for c in ("walks", "leaf_paths")])
        sums = store(sums.hint("shuffle_hash").join(need, "node"))
        waiting = sums.filter("got < need").drop("need")
        front = sums.filter("got = need").select("node", (F.col("walks") + 1).cast(number).alias("walks"), "leaf_paths")
        n = front.count()
        if n == 0:
            break  # what is left lies on cycles or leads to them
        done += n
        out.append(front)
    res, inner = _union_counts(out), need.count()
    need.unpersist()
    if s is not None:
        res = store(res.join(s, "node"))
    if done < inner and (s is None or res.count() < s.count()):
        raise ValueError("path_counts: the graph below the starts has a cycle")
    return res.select(F.col("node").alias("start"), "walks", "leaf_paths")


def _union_counts(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _bounded_counts(edges: DataFrame, starts, max_level: int) -> DataFrame:
    """Walks and leaf paths of at most ``max_level`` edges, level by level from each start."""
    e = prepared_edges(edges)
    s = E.nodes_of(e) if starts is None else as_nodes(edges.sparkSession, starts, dict(edges.dtypes)["src"])
    has_out = e.select(F.col("src").alias("node")).distinct().withColumn("has_out", F.lit(True))
    front = cut_lineage(s.select(F.col("node").alias("start"), "node", F.lit(1).cast("decimal(38,0)").alias("n")))
    totals, level, rounds = [], 0, Rounds()
    while True:
        totals.append(front.join(has_out, "node", "left").groupBy("start").agg(
            F.sum("n").alias("walks"),
            F.sum(F.when(F.col("has_out").isNull(), F.col("n")).otherwise(F.lit(0))).alias("leaf_paths")))
        if level >= max_level:
            break
        nxt = (front.join(e, front.node == e.src).groupBy("start", F.col("dst").alias("node"))
                    .agg(F.sum("n").cast("decimal(38,0)").alias("n")))
        nxt, n = rounds.materialise(nxt)
        if n == 0:
            break
        if rounds.cut_now():
            totals = [cut_lineage(_sum_totals(totals))]
        front = nxt
        level += 1
    res = cut_lineage(_sum_totals(totals))
    rounds.release()
    return res


def _sum_totals(totals):
    allt = _union_counts(totals)
    return allt.groupBy("start").agg(F.sum("walks").cast("decimal(38,0)").alias("walks"),
                                     F.sum("leaf_paths").cast("decimal(38,0)").alias("leaf_paths"))


# Fixed default pattern of a model token: "m" followed by four or more digits.
MODEL_PATTERN = r"m\d{4,}"


def compress_at_models(df: DataFrame, path_col: str, root_col: str | None = None, pattern: str = MODEL_PATTERN,
                       sep: str = "|") -> DataFrame:
    """Cut a delimited path at its model levels.

    Output per input row, one row per segment ``(seg, segment, idx_from, idx_to)``
    with 1-based level positions: first level -> first model, model -> next
    model, last model -> last level; without models the whole path, ``1-n``
    (Q18). The top root is written first only when it differs from level 1.
    """
    lv = F.split(F.col(path_col), re.escape(sep))
    n = F.size(lv)
    pos = F.filter(F.transform(F.sequence(F.lit(1), n), lambda i: F.when(F.element_at(lv, i).rlike(pattern), i)),
                   lambda x: x.isNotNull())
    k = F.size(pos)

    def seg(a: Column, b: Column, text: Column) -> Column:
        return F.struct(text.alias("segment"), a.alias("idx_from"), b.alias("idx_to"))

    def join_slice(a: Column, b: Column) -> Column:
        return F.array_join(F.slice(lv, a, b - a + 1), sep)

    p1 = F.element_at(pos, 1)
    pk = F.element_at(pos, -1)
    first_text = join_slice(F.lit(1), p1)
    if root_col is not None:
        first_text = F.when(F.element_at(lv, 1) == F.col(root_col), first_text) \
                      .otherwise(F.concat_ws(sep, F.col(root_col), first_text))
    middle = F.when(k > 1, F.transform(F.sequence(F.lit(1), k - 1),
                                       lambda j: seg(F.element_at(pos, j), F.element_at(pos, j + 1),
                                                     F.concat_ws(sep, F.element_at(lv, F.element_at(pos, j)),
                                                                 F.element_at(lv, F.element_at(pos, j + 1))))))
    segs = F.when(k == 0, F.array(seg(F.lit(1), n, F.col(path_col)))).otherwise(
        F.concat(F.array(seg(F.lit(1), p1, first_text)),
                 F.coalesce(middle, F.array().cast("array<struct<segment:string,idx_from:int,idx_to:int>>")),
                 F.array(seg(pk, n, join_slice(pk, n)))))
    keep = [c for c in df.columns]
    return df.select(*keep, F.posexplode(segs).alias("seg", "s")).select(
        *keep, (F.col("seg") + 1).alias("seg"), "s.segment", "s.idx_from", "s.idx_to")
