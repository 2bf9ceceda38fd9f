"""The two round loops every graph walk is built on.

* :func:`bfs` -- level-synchronous breadth-first search from many starts at
  once. Each round is one join of the frontier with the edge table, one
  aggregation (first arrival per node, map-side combined so a hub's fan-in
  is pre-reduced in every task) and one anti join against the visited set.
  Each node is expanded once per start.
* :func:`walk_paths` -- path frontier: rows are whole paths (``array``),
  extended by one edge per round, with an exact membership cycle guard.

The driver only decides when to stop: one ``count`` per round, which is also
the job that materialises the round (persisted, spilling to disk). Every few
rounds the state is written to the reliable checkpoint folder, which cuts the
lineage, so a lost executor replays at most a few rounds.
The edge table is prepared once: one shuffle by ``src`` puts repeated edges together
and leaves the table sorted and cached in the layout of the joins, so a round moves
its frontier only. The number of its partitions follows the number of edges, so the
rows of a task do not grow with the graph. Where one node has more edges than a task
should read, the table is spread over (src, dst) instead and AQE splits its hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.operators.ordering import global_positions
from spindle.session import cut_lineage, discard, store

ARROW = " -> "
CHECKPOINT_EVERY = 4
TASK_ROWS = 1 << 20      # rows a task is given of a table that is laid out anew
SLICE_ROWS = 1 << 26     # rows of masks that one shuffle of a round of the search is given, if it has several batches
HUB_SHARE = 2            # a partition of more than so many even shares holds a hub: its edges are spread


class Rounds:
    """Materialises one frame per round with a single job (``count``).

    Frames are persisted (memory, spilling to disk); every ``every`` rounds
    the frame is written to the shared checkpoint folder instead, which
    bounds the lineage a lost executor has to replay. Call :meth:`release`
    when the loop result has been consumed or checkpointed.
    """

    def __init__(self, every: int = CHECKPOINT_EVERY):
        self.every = max(1, every)
        self.k = 0
        self.held: list[DataFrame] = []

    def cut_now(self) -> bool:
        return self.k % self.every == 0

    def materialise(self, df: DataFrame) -> tuple[DataFrame, int]:
        self.k += 1
        if self.cut_now():
            out = store(df)
        else:
            out = df.persist(StorageLevel.MEMORY_AND_DISK)
            self.held.append(out)
        return out, out.count()

    def release(self) -> None:
        for f in self.held:
            f.unpersist()
        self.held = []


def as_nodes(spark, starts, node_type: str | None = None) -> DataFrame:
    """Starts given as DataFrame (column ``node`` or the first column) or a Python list;
    a null is no node."""
    if isinstance(starts, DataFrame):
        col = "node" if "node" in starts.columns else starts.columns[0]
        df = starts.select(F.col(col).alias("node"))
    else:
        df = spark.createDataFrame([(s,) for s in starts], "node string" if node_type is None else f"node {node_type}")
    return df.filter(F.col("node").isNotNull()).distinct()


def task_parts(spark, rows: int, most: int = TASK_ROWS) -> int:
    """Partitions for a table of so many rows: the session's, or more where a task would get over ``most``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // most))


def as_prepared(edges: DataFrame, collapsed: bool = True) -> DataFrame:
    """Marks a table that is distinct and without nulls, so that no operator makes it so again."""
    edges._prepared = collapsed
    return edges


def is_prepared(edges: DataFrame) -> bool:
    return getattr(edges, "_prepared", False) is True


def prepared_edges(edges: DataFrame, collapse: bool = True) -> DataFrame:
    """Edge table for repeated joins: (src, dst), optionally collapsed, cached in the layout of a join
    by ``src``, or spread where a hub would fill a task. A table that it made comes back as it is."""
    if is_prepared(edges):
        return edges
    e = edges.select("src", "dst").filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    rows = e.count()
    parts = task_parts(edges.sparkSession, rows)
    return _laid_out(e.repartition(parts, "src"), rows, parts, collapse)


def _laid_out(e: DataFrame, rows: int, parts: int, collapse: bool) -> DataFrame:
    """Sorts and caches edges that lie by ``src`` in so many partitions, or spreads them for a hub."""
    if collapse:  # the one sort, the window's, also puts repeated edges side by side: no aggregation of both texts before it
        out = e.withColumn("__k", F.row_number().over(Window.partitionBy("src", "dst").orderBy("dst"))).filter("__k = 1").drop("__k")
    else:
        out = e.sortWithinPartitions("src", "dst")
    out, hub = _spread(out.persist(StorageLevel.MEMORY_AND_DISK), rows, parts)
    out._parts = None if hub else parts
    return as_prepared(out, collapse)


def _spread(out: DataFrame, rows: int, parts: int) -> tuple[DataFrame, bool]:
    """A cached layout by ``src``, or its edges spread where one task holds a hub's; and whether it does."""
    largest = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] or 0
    if largest <= HUB_SHARE * rows / parts:
        return out, False
    spread = store(out.repartition("src", "dst"))
    out.unpersist()
    return spread, True


def lies_by_src(edges: DataFrame) -> int | None:
    """The number of partitions of a table that :func:`prepared_edges` laid out by ``src``, if it did."""
    return getattr(edges, "_parts", None)


def reversed_edges(edges: DataFrame) -> DataFrame:
    """A prepared table the other way round, prepared as well; made once a table. What is asked of
    both ends of the edges then needs no shuffle (:func:`both_ways`)."""
    if getattr(edges, "_back", None) is None:
        back = prepared_edges(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), collapse=False)
        as_prepared(back, is_prepared(edges))  # distinct edges are distinct in both directions
        edges._back, back._back = back, edges
    return edges._back


def both_ways(edges: DataFrame) -> DataFrame | None:
    """The reverse of a table if it was made and both lie by ``src`` in the same number of partitions."""
    back = getattr(edges, "_back", None)
    return back if back is not None and lies_by_src(edges) is not None and lies_by_src(edges) == lies_by_src(back) else None


def undirected_edges(edges: DataFrame) -> DataFrame:
    """Prepared edges in both directions; a prepared table and its reverse are merged where they lie."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    if not is_prepared(edges):
        return prepared_edges(both)
    back = reversed_edges(edges)
    parts = lies_by_src(edges)
    if both_ways(edges) is None:
        return prepared_edges(both)
    return _laid_out(edges.select("src", "dst").union(back.select("src", "dst")), 2 * edges.count(), parts, True)


def _union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def bfs(edges: DataFrame, starts, *, per_start: bool = True, max_level: int | None = None,
        targets: DataFrame | None = None, parents: bool = False, prepared: bool = False,
        ignore: DataFrame | None = None) -> DataFrame:
    """Breadth-first levels.

    Returns ``(start, node, level[, parent])`` -- ``start`` only when
    ``per_start`` -- with every reached node once per start at its first level
    (level 0 = the start). ``parent`` is the smallest predecessor on the level
    before (BFS tree).

    ``targets``: a start stops expanding after the level on which it reaches a
    target node; that level is kept complete. ``ignore``: nodes (column ``node``) that are never reached.
    """
    spark = edges.sparkSession
    e = edges if prepared else prepared_edges(edges)
    key = ["start", "node"] if per_start else ["node"]
    s = as_nodes(spark, starts, dict(edges.dtypes)["src"])
    if per_start and not (parents or targets is not None):
        return ms_bfs(e, store(s), max_level=max_level, ignore=ignore)
    if ignore is not None:
        e = e.join(ignore.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
        s = s.join(ignore, "node", "left_anti")
    cols = [F.col("node").alias("start")] if per_start else []
    front = s.select(*cols, "node", F.lit(0).alias("level"))
    if parents:
        front = front.withColumn("parent", F.lit(None).cast(s.schema["node"].dataType))
    front = cut_lineage(front)
    out_cols = front.columns
    visited = front
    done = None
    level = 0
    rounds = Rounds()
    tgt = targets.select(F.col(targets.columns[0]).alias("node")).distinct() if targets is not None else None
    while max_level is None or level < max_level:
        if tgt is not None:
            hit = front.join(tgt, "node", "left_semi")
            if per_start:
                hit = hit.select("start").distinct()
                done = hit if done is None else done.unionByName(hit)
                front = front.join(done, "start", "left_anti")
            elif not hit.isEmpty():
                break
        step = front.join(e, front.node == e.src).select(
            *([F.col("start")] if per_start else []), F.col("dst").alias("node"),
            F.col("node").alias("prev"))
        aggs = [F.min("prev").alias("parent")] if parents else [F.count(F.lit(1)).alias("_n")]
        new = (step.groupBy(*key).agg(*aggs)
                   .join(visited.select(*key), key, "left_anti")
                   .withColumn("level", F.lit(level + 1)))
        new = new.select(*out_cols)
        new, n = rounds.materialise(new)
        if n == 0:
            break
        visited = visited.unionByName(new.select(*out_cols))
        if rounds.cut_now():
            visited = cut_lineage(visited)
            if done is not None:
                done = cut_lineage(done)
        front = new
        level += 1
    visited = cut_lineage(visited)
    rounds.release()
    return visited


def ms_bfs(edges: DataFrame, starts: DataFrame, max_level: int | None = None, width: int = 64, words: int = 8,
           ignore: DataFrame | None = None) -> DataFrame:
    """Per-start BFS levels ``(start, node, level)`` of :func:`mask_levels`: bits
    are expanded to rows where the result is read, the pairs
    themselves are never written or shuffled here.
    """
    levels, ids, masks = mask_levels(edges, starts, max_level, width, words, ignore)
    rows = _union_all([x.select("batch", "node", *masks, F.lit(level).alias("level")) for level, x in enumerate(levels)])
    return with_bits(rows, ids, masks).select("start", "node", "level")


def with_bits(rows: DataFrame, ids: DataFrame, masks: list[str]) -> DataFrame:
    """A row for every bit that is set in the masks, with its ``start`` and its place in them."""
    mask = F.get(F.array(*masks), F.col("word"))
    return rows.join(ids, "batch").filter(F.bit_get(mask, F.col("bit")) == 1)


def mask_levels(edges: DataFrame, starts: DataFrame, max_level: int | None = None, width: int = 64,
                words: int = 8, ignore: DataFrame | None = None) -> tuple[list[DataFrame], DataFrame, list[str]]:
    """Per-start BFS levels with the starts packed into bitmasks (multi-source
    BFS, Then et al., VLDB 2014): a table ``batch, node, masks`` per level of what is found
    there first, the starts' ``batch, word, bit, start`` and the names of the masks.

    Starts are numbered densely (distributed numbering, no single task) and
    split into batches of ``width`` bits times as many words as they fill, ``words``
    at most; a row ``(batch, node, words)`` stands for up to 512 (start, node)
    pairs. Starts of one connected part of the graph are neighbours in the numbering,
    so a batch's rows cover its own parts only. A round joins the frontier with the
    edges and ORs the masks per (batch, node) in an aggregation that combines map-side.
    The levels found are kept in the layout of that aggregation, so what was seen
    is taken off without being shuffled, and a round that reaches nothing reads none of it.
    Nodes of ``ignore`` count as seen by every start from the beginning, so no edge is looked
    up for them. A round whose frontier would send more than ``SLICE_ROWS`` rows along the edges is
    made some batches at a time, each written and its shuffle deleted before the next.
    """
    spark = edges.sparkSession
    if ignore is not None:
        starts = store(starts.join(ignore, "node", "left_anti"))
    n = starts.count()
    if n > width:
        from spindle.operators.graph.components import connected_components
        part = connected_components(edges, nodes=starts).select("node", "component")
        ids = global_positions(store(starts.join(part, "node")), ["component", "node"]).select(
            F.col("__g").alias("sid"), F.col("node").alias("start"))
    else:
        from spindle.operators.inventory import numbered_distinct
        ids = numbered_distinct(starts, "node").select((F.col("n") - 1).alias("sid"), F.col("value").alias("start"))
    words = max(1, min(words, -(-n // width)))
    span = width * words
    masks = [f"m{i}" for i in range(words)]
    ids = store(ids.select(F.floor(F.col("sid") / span).cast("long").alias("batch"),
                           F.floor(F.pmod(F.col("sid"), F.lit(span)) / width).cast("int").alias("word"),
                           F.pmod(F.col("sid"), F.lit(width)).cast("int").alias("bit"), "start"))
    none = F.lit(0).cast("long")
    keys = ["node"] if n <= span else ["batch", "node"]  # of one batch the node alone: the layout of the edges
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def laid(df):
        return df.repartition(parts, *keys).persist(StorageLevel.MEMORY_AND_DISK)

    own = [F.bit_or(F.when(F.col("word") == i, F.expr("shiftleft(CAST(1 AS BIGINT), bit)")).otherwise(none)).alias(m) for i, m in enumerate(masks)]
    first = store(ids.groupBy("batch", F.col("start").alias("node")).agg(*own))
    levels = [first]
    front = laid(first)
    seen = [front]
    if ignore is not None:
        every = F.lit(-1).cast("long")
        seen.append(laid(store(ids.select("batch").distinct().crossJoin(ignore).select("batch", "node", *[every.alias(m) for m in masks]))))
    degree = None

    def reached(front):
        step = front.join(edges, front.node == edges.src).select("batch", F.col("dst").alias("node"), *masks)
        # every key is in one of the batches that its masks are of
        step = step.groupBy(*keys).agg(*([F.min("batch").alias("batch")] if len(keys) == 1 else []), *[F.bit_or(m).alias(m) for m in masks])
        old = _union_all(seen).select(*keys, *[F.col(m).alias(f"old_{m}") for m in masks])
        both = step.hint("shuffle_hash").join(old, keys, "left").groupBy("batch", "node").agg(
            *[F.bit_or(m).alias(m) for m in masks], *[F.coalesce(F.bit_or(f"old_{m}"), none).alias(f"old_{m}") for m in masks])
        found = both.select("batch", "node", *[F.col(m).bitwiseAND(F.bitwise_not(f"old_{m}")).alias(m) for m in masks])
        return store(found.filter(" OR ".join(f"{m} <> 0" for m in masks)))

    while max_level is None or len(levels) <= max_level:
        slices = 1
        if len(keys) > 1:
            if degree is None:
                rows, nodes = edges.agg(F.count(F.lit(1)), F.approx_count_distinct("src")).first()
                degree = rows / max(1, nodes)
            slices = min(-(-n // span), max(1, int(levels[-1].count() * degree / SLICE_ROWS) + 1))
        front = _union_all([reached(front if slices == 1 else front.filter(F.pmod("batch", F.lit(slices)) == i)) for i in range(slices)])
        if front.isEmpty():
            break
        levels.append(front)
        front = laid(front)
        seen.append(front)
        if len(seen) > 2 * CHECKPOINT_EVERY:  # one row per (batch, node) again
            merged = laid(store(_union_all(seen).groupBy("batch", "node").agg(*[F.bit_or(m).alias(m) for m in masks])))
            for x in seen[:-1]:
                x.unpersist()
            seen = [merged]
    for x in seen:
        x.unpersist()
    return levels, ids, masks


def walk_paths(edges: DataFrame, starts, *, max_levels: int | None = None, guard: str = "path", emit: str = "leaf",
               ends: DataFrame | None = None, collapse: bool = True, emit_truncated: bool = False,
               alive: DataFrame | None = None, notes: DataFrame | None = None, hop_notes: DataFrame | None = None) -> DataFrame:
    """Path frontier loop. Returns ``(start, path array, levels[, truncated][, notes][, hop_notes])``.

    guard: ``path`` (no node twice in a path), ``above_start`` (only nodes
    greater than the start, closing back on the start = simple cycles in
    canonical form), or ``none`` (walks; endless on a cyclic graph without a bound).
    emit: ``leaf`` -- paths ending in a node without successors (a start that
    is itself a leaf gives a one-node path); ``end`` -- paths reaching a node of
    ``ends`` (not extended past it); ``all`` -- every prefix, start included;
    ``cycle`` -- closed cycles (with ``above_start``).

    Without ``max_levels`` the loop ends when no path can be extended. With it,
    the paths still open at the bound are returned too, flagged ``truncated``
    (not with ``all``, where every prefix is a result). ``alive``: ``(start, node)``
    pairs; a path of a start is only extended to such nodes. ``notes`` (one row ``node, note``
    a node) and ``hop_notes`` (one row ``src, dst, note`` an edge), for whole leaf paths: arrays of the
    notes of a path's nodes and of its hops, null for those without one.
    """
    spark = edges.sparkSession
    whole = guard == "path" and max_levels is None and not emit_truncated and alive is None and collapse
    if not (whole and emit == "leaf") and (notes is not None or hop_notes is not None):
        raise ValueError("notes are taken along whole leaf paths only")
    e = prepared_edges(edges, collapse=collapse) if hop_notes is None else noted_edges(edges, hop_notes)
    s = as_nodes(spark, starts, dict(edges.dtypes)["src"])
    if whole and emit in ("leaf", "end"):
        return _whole_walks(e, s, None if emit == "leaf" else store(ends.select(F.col(ends.columns[0]).alias("node")).distinct()), notes)
    front = store(s.select(F.col("node").alias("start"), F.array(F.col("node")).alias("path"),
                           F.col("node").alias("last")))
    sinks = None
    if emit == "leaf":
        sinks = e.select(F.col("dst").alias("last")).distinct().join(e.select(F.col("src").alias("last")), "last", "left_anti")
        sinks = cut_lineage(sinks.union(s.select(F.col("node").alias("last")).join(
            e.select(F.col("src").alias("last")), "last", "left_anti")).distinct())
    elif emit == "end":
        sinks = ends.select(F.col(ends.columns[0]).alias("last")).distinct()
    bounded = max_levels is not None and emit != "all"
    flagged = emit_truncated or bounded
    out: list[DataFrame] = []
    if emit == "all":
        out.append(front)
    elif emit == "leaf":
        out.append(front.join(sinks, "last", "left_semi"))
    level = 0
    rounds = Rounds()
    while True:
        if max_levels is not None and level >= max_levels:
            if bounded:
                out.append(_open(front, e, sinks, emit, guard).withColumn("truncated", F.lit(True)))
            break
        step = front.join(e, front["last"] == e["src"])
        if guard == "path":
            step = step.filter(~F.array_contains("path", F.col("dst")))
        elif guard == "above_start":
            if emit == "cycle":
                out.append(step.filter(F.col("dst") == F.col("start")).select("start", "path", F.col("dst").alias("last")))
            step = step.filter((F.col("dst") > F.col("start")) & ~F.array_contains("path", F.col("dst")))
        nxt = step.select("start", F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("last"))
        if alive is not None:
            nxt = nxt.join(alive.withColumnRenamed("node", "last"), ["start", "last"], "left_semi").select("start", "path", "last")
        if emit_truncated and guard == "path":
            stuck = front.join(sinks, "last", "left_anti").join(
                nxt.select("start", F.slice("path", 1, level + 1).alias("path")).distinct(),
                ["start", "path"], "left_anti")
            out.append(stuck.withColumn("truncated", F.lit(True)))
        nxt, n = rounds.materialise(nxt)
        if n == 0:
            break
        level += 1
        if emit == "all":
            out.append(nxt)
        elif emit in ("leaf", "end"):
            out.append(nxt.join(sinks, "last", "left_semi"))
        if emit == "end":
            nxt = nxt.join(sinks, "last", "left_anti")
        if rounds.cut_now() and len(out) > 1:
            out = [store(_union_all([_shape(o, flagged) for o in out]))]
        front = nxt
    res = store(_union_all([_shape(o, flagged) for o in out]))
    rounds.release()
    return res.withColumn("levels", (F.size("path") - 1).cast("int"))


def _whole_walks(e: DataFrame, starts: DataFrame, ends: DataFrame | None, notes: DataFrame | None) -> DataFrame:
    """The simple paths to nodes without successors, or to the first of ``ends`` behind the start. One
    outer join a round tells both the extended paths and the ended ones, and what is known of a
    path's last node is looked up where that join has put the path. A round is written once, as
    paths alone, and goes when the next is written, unless paths end in it: the result is read from these."""
    hops = [c for c in ("hop_note",) if c in e.columns]
    node = starts.schema["node"].dataType.simpleString()
    cols = ["path", *(["notes"] if notes is not None else []), *(["hop_notes"] if hops else [])]
    front = starts.select(F.array("node").alias("path"),
                          *([F.array().cast(f"array<{notes.schema['note'].dataType.simpleString()}>").alias("notes")] if notes is not None else []),
                          *([F.array().cast(f"array<{e.schema['hop_note'].dataType.simpleString()}>").alias("hop_notes")] if hops else []))
    known = notes if ends is None else ends.select("node", F.lit(True).alias("note"))
    out, before, level = [], store(front.withColumn("grown", F.lit(True))), 0
    front = before
    while True:
        here = e
        if ends is not None and level:  # a path stops at its end
            here = e.join(ends.withColumnRenamed("node", "src"), "src", "left_anti").select(*e.columns)
        grown = F.col("src").isNotNull()
        step = front.select(*cols, F.element_at("path", -1).alias("last")).join(here, F.col("last") == F.col("src"), "left")
        step = step.filter(~(grown & F.coalesce(F.array_contains("path", F.col("dst")), F.lit(False))))
        if known is not None:
            step = step.join(known, F.col("last") == F.col("node"), "left")
        if ends is not None:  # of what is not extended, the paths at an end
            step = step.filter(grown if not level else grown | F.col("note"))
        step = store(step.select(
            F.when(grown, F.array_append("path", F.col("dst"))).otherwise(F.col("path")).cast(f"array<{node}>").alias("path"),
            *([F.array_append("notes", F.col("note")).alias("notes")] if notes is not None else []),
            *([F.when(grown, F.array_append("hop_notes", F.col("hop_note"))).otherwise(F.col("hop_notes")).alias("hop_notes")] if hops else []),
            grown.alias("grown")))
        discard(before)
        ended, front, level = step.filter("NOT grown"), step.filter("grown"), level + 1
        some, more = not ended.isEmpty(), not front.isEmpty()
        if some or not more and not out:
            out.append(ended)
        before = None if some else step
        if not more:
            return _union_all(out).select(F.element_at("path", 1).alias("start"), *cols).withColumn("levels", (F.size("path") - 1).cast("int"))


def noted_edges(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """Distinct edges ``src, dst, hop_note`` in the layout of :func:`prepared_edges`; the notes meet
    the edges in the one shuffle of that layout."""
    e = edges.select("src", "dst").filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    count = e.count()
    parts = task_parts(edges.sparkSession, count)
    none = F.lit(None).cast(notes.schema["note"].dataType)
    rows = e.select("src", "dst", none.alias("note"), F.lit(True).alias("edge")).unionByName(
        notes.select("src", "dst", "note", F.lit(False).alias("edge")))
    met = rows.repartition(parts, "src").groupBy("src", "dst").agg(F.max("edge").alias("edge"), F.min("note").alias("hop_note"))
    laid = met.filter("edge").select("src", "dst", "hop_note").sortWithinPartitions("src")
    return _spread(laid.persist(StorageLevel.MEMORY_AND_DISK), count, parts)[0]


def _open(front: DataFrame, e: DataFrame, sinks: DataFrame | None, emit: str, guard: str) -> DataFrame:
    """Paths at the bound that an edge would still extend or close."""
    step = front.join(e, front["last"] == e["src"])
    if guard == "path":
        step = step.filter(~F.array_contains("path", F.col("dst")))
    elif guard == "above_start":
        step = step.filter((F.col("dst") >= F.col("start")) & (~F.array_contains("path", F.col("dst")) | (F.col("dst") == F.col("start"))))
    return step.select("start", "path").distinct()


def _shape(o: DataFrame, emit_truncated: bool) -> DataFrame:
    if emit_truncated:
        if "truncated" not in o.columns:
            o = o.withColumn("truncated", F.lit(False))
        return o.select("start", "path", "truncated")
    return o.select("start", "path")


def path_text(path: str | Column, sep: str = ARROW) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.array_join(F.transform(p, lambda x: x.cast("string")), sep)
