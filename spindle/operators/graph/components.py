"""Components of a graph (G14, G26, G28): strongly connected, connected, and what is left
when everything that lies on no way between cycles is peeled off.

* :func:`reaching_cycles` -- peeling layer by layer would take a round per node of a
  chain, so a few layers are raked off, then every chain is compressed at once:
  a node with one successor shares that successor's fate, and pointer doubling finds
  the end of all such chains in log2 rounds (rake and compress).
* :func:`strong_components` -- in the peeled core, pass-through nodes (one edge in, one
  out) are contracted the same way; the rest is coloured forward with the largest
  node that reaches it, and each colour's root collects, backward inside its
  colour, exactly its component. One label per node, no (start, node) pairs.
* :func:`connected_components` -- alternating large-star and small-star contraction.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.operators.graph.frontier import Rounds, as_prepared, is_prepared
from spindle.session import discard, store

LAYERS = 3   # layers raked between two compressions


def _plain(edges: DataFrame, loops: bool) -> DataFrame:
    e = edges.select("src", "dst").filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    e = e if loops else e.filter(F.col("src") != F.col("dst"))
    return as_prepared(e if is_prepared(edges) else e.distinct())


def _ends(chain: DataFrame) -> DataFrame:
    """``node, far`` of a table ``node, far`` of single successors: the first node behind it that
    has no row of its own, or null where the chain runs into a ring of them."""
    steps, jump = 0, store(chain.select("node", "far", F.lit(True).alias("open")))
    nodes = jump.count()
    while (1 << steps) <= nodes:
        steps += 1
        a, b = jump.alias("a"), jump.alias("b")
        jump = store(a.join(b, F.col("a.far") == F.col("b.node"), "left").select(
            F.col("a.node").alias("node"), F.coalesce("b.far", "a.far").alias("far"), F.col("b.node").isNotNull().alias("open")))
        if jump.filter("open").isEmpty():
            break
    # steps are enough for any chain: what is still open goes round
    inner = jump.select(F.col("node").alias("far"), F.lit(True).alias("ring"))
    return jump.join(inner, "far", "left").select("node", F.when(F.col("ring").isNull(), F.col("far")).alias("far"))


def reaching_cycles(edges: DataFrame) -> DataFrame:
    """``node``: the nodes from which a cycle can be reached (a loop is one)."""
    cur = store(_plain(edges, loops=True))
    n, rounds, live, shared = cur.count(), Rounds(), [], []
    while n:
        for _ in range(LAYERS):  # edges into nodes without a successor go
            before = n
            cur, n = rounds.materialise(cur.join(cur.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            if n in (0, before):
                break
        if n in (0, before):
            break
        single = cur.groupBy("src").agg(F.count(F.lit(1)).alias("c"), F.min("dst").alias("far")).filter("c = 1 AND src <> far")
        ends = store(_ends(single.select(F.col("src").alias("node"), "far")))
        live.append(ends.filter("far IS NULL").select("node"))
        shared.append(ends.filter("far IS NOT NULL"))
        # edges into a chain lead to its end; into a ring, they lead to a cycle for good: a loop keeps their source
        to = cur.join(ends.select(F.col("node").alias("src")), "src", "left_anti").join(
            ends.select(F.col("node").alias("dst"), "far", F.lit(True).alias("own")), "dst", "left")
        cur, n = rounds.materialise(to.select("src", F.when(F.col("own").isNull(), F.col("dst")).otherwise(F.coalesce("far", "src")).alias("dst")).distinct())
    out = store(reduce(DataFrame.unionByName, [cur.select(F.col("src").alias("node")), *live]).distinct())
    for ends in reversed(shared):  # a chain shares the fate of its end
        out = store(out.unionByName(ends.join(out.withColumnRenamed("node", "far"), "far", "left_semi").select("node")).distinct())
    rounds.release()
    return out


def cycle_core(edges: DataFrame) -> DataFrame:
    """Edges left after repeatedly removing edges whose source has no incoming or whose
    target has no outgoing edge: those on cycles and on ways between them. Empty iff the
    graph is acyclic. (The two peelings do not meet: what one removes, the other's
    answer does not need.)"""
    e = store(_plain(edges, loops=True))
    to = reaching_cycles(e)
    kept = store(e.join(to.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
    if kept.isEmpty():
        return kept
    since = reaching_cycles(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return store(kept.join(since.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst"))


def strong_components(edges: DataFrame) -> DataFrame:
    """``node, component, size``: the smallest node and the number of nodes of the strongly
    connected component of every node of the edges. Loops and repeated edges change nothing."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).filter(F.col("node").isNotNull()).distinct()
    cur, chains = _contracted(cycle_core(_plain(edges, loops=False)))
    label = chains.filter("ring IS NOT NULL").select("node", F.col("ring").alias("label"))
    found = [label]
    while not cur.isEmpty():
        colour = _coloured(cur)
        same = store(cur.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c")), "src")
                              .join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("d")), "dst").filter("c = d").select("src", "dst"))
        part = _behind_roots(same, colour)
        found.append(part.select("node", F.col("colour").alias("label")))
        rest = same.join(part.select(F.col("node").alias("src")), "src", "left_anti").join(part.select(F.col("node").alias("dst")), "dst", "left_anti")
        cur = cycle_core(rest.select("src", "dst"))
    label = store(reduce(DataFrame.unionByName, found))
    # a chain belongs to the component at its ends if that is one
    of = lambda at, name: label.select(F.col("node").alias(at), F.col("label").alias(name))
    inner = (chains.filter("ring IS NULL").join(of("first", "a"), "first").join(of("last", "b"), "last")
                   .filter("a = b").select("node", F.col("a").alias("label")))
    label = label.unionByName(inner)
    named = label.groupBy("label").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("size"))
    label = label.join(named, "label").select("node", "component", "size")
    return nodes.join(label, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"), F.coalesce("size", F.lit(1)).cast("long").alias("size"))


def _contracted(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges with every chain of pass-through nodes as one edge, and for each node of a
    chain the nodes before and behind the chain, or the label of the ring it is."""
    i = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("i"), F.min("src").alias("prev"))
    o = e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("o"), F.min("dst").alias("next"))
    thin = store(i.join(o, "node").filter("i = 1 AND o = 1").select("node", "prev", "next"))
    if thin.isEmpty():
        return e, thin.select("node", F.col("prev").alias("first"), F.col("next").alias("last"), F.col("node").alias("ring"))
    last = _ends(thin.select("node", F.col("next").alias("far"))).withColumnRenamed("far", "last")
    first = _ends(thin.select("node", F.col("prev").alias("far"))).withColumnRenamed("far", "first")
    chains = store(last.join(first, "node"))
    rings = chains.filter("last IS NULL").select("node").join(thin.select("node", "next"), "node")
    if not rings.isEmpty():  # whole rings: every node learns the smallest one
        ring = store(rings.select("node", F.col("next").alias("far"), F.col("node").alias("ring")))
        steps, n = 0, ring.count()
        while (1 << steps) < n:
            steps += 1
            a, b = ring.alias("a"), ring.alias("b")
            ring = store(a.join(b, F.col("a.far") == F.col("b.node")).select(
                F.col("a.node").alias("node"), F.col("b.far").alias("far"), F.least("a.ring", "b.ring").alias("ring")))
        chains = chains.join(ring.select("node", "ring"), "node", "left")
    else:
        chains = chains.withColumn("ring", F.lit(None).cast(dict(thin.dtypes)["node"]))
    inside = thin.select("node")
    kept = e.join(inside.withColumnRenamed("node", "src"), "src", "left_anti").join(inside.withColumnRenamed("node", "dst"), "dst", "left_anti")
    short = chains.filter("last IS NOT NULL").select(F.col("first").alias("src"), F.col("last").alias("dst"))
    chains = store(chains.select("node", "first", "last", "ring"))
    return store(kept.select("src", "dst").unionByName(short).distinct()), chains


def _coloured(e: DataFrame) -> DataFrame:
    """``node, colour``: the largest node that reaches each node."""
    rounds = Rounds()
    colour = store(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("colour", F.col("node")))
    moved = colour
    while True:
        new = e.join(moved.select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("new"))
        both = colour.join(new, "node", "left")
        colour, _ = rounds.materialise(both.select("node", F.greatest("colour", "new").alias("colour"), (F.col("new") > F.col("colour")).alias("up")))
        moved = colour.filter("up").select("node", "colour")
        colour = colour.select("node", "colour")
        if moved.isEmpty():
            out = store(colour)
            rounds.release()
            return out


def _behind_roots(e: DataFrame, colour: DataFrame) -> DataFrame:
    """``node, colour``: the nodes of each colour that reach its root; ``e`` joins one colour only."""
    rounds = Rounds()
    seen = store(colour.filter("node = colour"))
    front = seen
    while True:
        new = (e.join(front.select(F.col("node").alias("dst"), "colour"), "dst").select(F.col("src").alias("node"), "colour").distinct()
                .join(seen.select("node"), "node", "left_anti"))
        front, n = rounds.materialise(new)
        if n == 0:
            out = store(seen)
            rounds.release()
            return out
        seen = seen.unionByName(front)
        if rounds.cut_now():
            seen = store(seen)


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, ignore: DataFrame | None = None) -> DataFrame:
    """``node, component, size`` of the undirected graph, the component named by its
    smallest node; ``nodes`` (also those without an edge) default to the edges' own.

    ``ignore``: nodes that are left out with all their edges. Every step moves each
    edge at most twice, and what is shuffled is the edges, never (start, node) pairs.
    """
    kind = dict(edges.dtypes)["src"]
    e = _plain(edges, loops=False)
    every = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    if nodes is not None:
        every = every.union(nodes.select(F.col(nodes.columns[0]).cast(kind)))
    every = every.filter(F.col("node").isNotNull()).distinct()
    if ignore is not None:
        out = ignore.select(F.col(ignore.columns[0]).alias("node")).distinct()
        every = every.join(out, "node", "left_anti")
        e = e.join(out.withColumnRenamed("node", "src"), "src", "left_anti").join(out.withColumnRenamed("node", "dst"), "dst", "left_anti")
    links = store(e.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    state = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # stored, so that the join reads plain shuffles of both sides and a hub's links are split
        before, low_of = links, store(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        large = store(links.select(F.col("u").alias("w"), F.col("v").alias("u")).join(low_of, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        links = store(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
                                 .filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        discard(before, low_of, large)  # a step's tables go with it
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    labelled = every.join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))
    labelled = store(labelled)
    discard(links)
    return labelled.join(labelled.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").select("node", "component", "size")
