"""Cycle detection and enumeration.

The cycle core and the strongly connected components come from
:mod:`spindle.operators.graph.components`. :func:`one_cycle` follows ``min(dst)``
inside the core -- a functional graph -- with pointer doubling (log2 rounds of a
node-sized self join) instead of a node-by-node walk on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.operators.graph.components import cycle_core, reaching_cycles, strong_components
from spindle.operators.graph.frontier import ARROW, Rounds, walk_paths
from spindle.session import cut_lineage

__all__ = ["cycle_core", "has_cycle", "one_cycle", "simple_cycles", "strong_components"]


def has_cycle(edges: DataFrame) -> bool:
    """True when the graph has a directed cycle (warn-and-continue callers)."""
    return not reaching_cycles(edges).isEmpty()


def one_cycle(edges: DataFrame, core: DataFrame | None = None) -> DataFrame:
    """G26 witness: one cycle as its edges ``(src, dst)`` in order (``pos``).

    Successor f(u) = min(dst) over core edges is total on the core, so
    following it from any node ends in a cycle. Pointer doubling gives, for
    every node, f^(2^k)(u) and the smallest node met on the way; after
    ceil(log2 |V|) rounds every node knows a node on its terminal cycle.
    The witness is the cycle through the smallest such cycle node.
    """
    core = core if core is not None else cycle_core(edges)
    f = cut_lineage(core.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("nxt")))
    nodes = f.count()
    if nodes == 0:
        return core.select("src", "dst").limit(0).withColumn("pos", F.lit(0))
    jump = f.select("node", F.col("nxt").alias("far"))
    steps = 1
    while steps < nodes:
        j2 = jump.alias("a").join(jump.alias("b"), F.col("a.far") == F.col("b.node")) \
                 .select(F.col("a.node").alias("node"), F.col("b.far").alias("far"))
        jump = cut_lineage(j2)
        steps *= 2
    # far = f^(steps)(u) with steps >= |V|: always a node on a cycle
    on_cycle = jump.select(F.col("far").alias("node")).distinct()
    anchor = on_cycle.agg(F.min("node").alias("node"))
    # distance of every node to the anchor, by pointer doubling on the cycle
    fc = cut_lineage(f.join(on_cycle, "node", "left_semi"))
    first = anchor.first()["node"]
    at = F.col("node") == F.lit(first)
    rank = fc.select("node", F.when(at, F.col("node")).otherwise(F.col("nxt")).alias("far"),
                     F.when(at, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("d"))
    steps = 1
    while steps < nodes:
        a, b = rank.alias("a"), rank.alias("b")
        rank = cut_lineage(a.join(b, F.col("a.far") == F.col("b.node")).select(
            F.col("a.node").alias("node"), F.col("b.far").alias("far"), (F.col("a.d") + F.col("b.d")).alias("d")))
        steps *= 2
    mine = rank.filter(F.col("far") == F.lit(first))  # other cycles never meet the anchor
    length = mine.agg(F.max("d")).first()[0] + 1
    return mine.join(fc, "node").select(F.col("node").alias("src"), F.col("nxt").alias("dst"),
                                        F.pmod(F.lit(length) - F.col("d"), F.lit(length)).cast("int").alias("pos"))


def returning(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``start, node``: from which nodes above the start it can be reached over nodes above it."""
    rounds = Rounds()
    seen = cut_lineage(starts.select(F.col("node").alias("start"), "node"))
    front = seen
    while True:
        step = front.join(edges, F.col("node") == F.col("dst")).filter(F.col("src") > F.col("start")).select("start", F.col("src").alias("node")).distinct()
        front, n = rounds.materialise(step.join(seen, ["start", "node"], "left_anti"))
        if n == 0:
            out = cut_lineage(seen)
            rounds.release()
            return out
        seen = seen.unionByName(front)
        if rounds.cut_now():
            seen = cut_lineage(seen)


def simple_cycles(edges: DataFrame, max_length: int | None = None, core: DataFrame | None = None) -> DataFrame:
    """All simple cycles, each once, written from its smallest node
    (``a -> b -> ... -> a``). Walks stay inside a strongly connected component, and
    a walk is dropped as soon as its start can no longer be reached over nodes above it.
    With ``max_length`` the open paths of that many nodes are returned as well, flagged
    ``truncated``."""
    e = core if core is not None else cycle_core(edges)
    of = strong_components(e).filter("size > 1").select("node", "component")
    inside = (e.join(of.select(F.col("node").alias("src"), F.col("component").alias("a")), "src")
               .join(of.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst").filter("a = b").select("src", "dst"))
    inside = cut_lineage(inside.unionByName(e.filter("src = dst").select("src", "dst")).distinct())
    starts = inside.select(F.col("src").alias("node")).distinct()
    alive = returning(inside, starts) if max_length is None else None
    cyc = walk_paths(inside, starts, max_levels=max_length, guard="above_start", emit="cycle", alive=alive)
    text = F.array_join(F.transform("path", lambda x: x.cast("string")), ARROW)
    closed = F.concat(text, F.lit(ARROW), F.col("start").cast("string"))
    if max_length is None:
        return cyc.select(closed.alias("cycle"), F.size("path").alias("length"))
    return cyc.select(F.when(F.col("truncated"), text).otherwise(closed).alias("cycle"), F.size("path").alias("length"), "truncated")
