"""What the graph operators leave on disk, and what they write at all."""

import os

import pytest
from pyspark.sql import functions as F

from shapes import edges_df
from spindle.operators.graph import components as GK
from spindle.operators.graph import edges as E
from spindle.operators.graph import frontier as GF
from spindle.operators.graph import paths as GP
from spindle.operators.graph import shortest as GS
from spindle.operators.graph.frontier import path_text, prepared_edges
from spindle.session import discard, store

LADDER = [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("c", "e"), ("d", "r"), ("d", "f"), ("s", "e"), ("e", "f")]


def tables(spark):
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return {x for x in os.listdir(root) if x.startswith("stored-")}


def simple_paths(pairs, start, stop):
    out, todo = [], [[start]]
    while todo:
        p = todo.pop()
        if stop(p):
            out.append(p)
            continue
        todo += [[*p, d] for a, d in sorted(set(pairs)) if a == p[-1] and d not in p]
    return out


def test_a_stored_table_leaves_no_shuffle_and_goes_when_discarded(spark):
    kept = spark.range(100).select((F.col("id") % 7).alias("k")).groupBy("k").count()
    before = tables(spark)
    s = store(kept)
    from spindle.session import SHUFFLE_CLEANUP
    assert spark.conf.get(SHUFFLE_CLEANUP) == "false"  # as it was
    assert len(tables(spark) - before) == 1 and s.count() == 7
    discard(s, kept, None)
    assert tables(spark) == before


def test_a_component_search_leaves_one_table(spark):
    before = tables(spark)
    got = GK.connected_components(prepared_edges(edges_df(spark, [(i, i + 1) for i in range(40)] + [(100, 99)])))
    assert len(tables(spark) - before) == 1
    assert {tuple(r) for r in got.select("component", "size").distinct().collect()} == {(0, 41), (99, 2)}


def test_few_leaves_are_searched_from(spark, monkeypatch):
    def never(*a, **k):
        raise AssertionError("a row a start and node")
    monkeypatch.setattr(GS, "predecessors", never)
    pairs = [(i, j) for i in range(10, 40) for j in (1 + i % 3, 4)] + [(1, 0), (2, 0), (3, 0), (4, 2), (50, 0)]
    want = {}
    for s in range(10, 40):
        want[s, 0] = min((len(p), " -> ".join(map(str, p))) for p in simple_paths(pairs, s, lambda p: p[-1] == 0))
    for e, reverse in ((edges_df(spark, pairs), False), (E.reverse(edges_df(spark, pairs)), True)):
        got = {(r.start, r.leaf_node): (r.path_length + 1, r.path) for r in GS.shortest_paths(e, list(range(10, 40)), reverse=reverse).collect()}
        assert got == want


def test_levels_go_when_texts_are_made(spark):
    before = tables(spark)
    pairs = [(0, 1), (1, 2), (2, 3), (3, 4), (0, 5), (5, 6), (6, 7)]
    got = GS.shortest_paths(edges_df(spark, pairs), [0])
    # starts, leaves, numbers, the starts' level, nodes with edges and the paths: no level's predecessors
    assert len(tables(spark) - before) <= 6
    assert {tuple(r) for r in got.collect()} == {(0, 4, "0 -> 1 -> 2 -> 3 -> 4", 4), (0, 7, "0 -> 5 -> 6 -> 7", 3)}


@pytest.mark.parametrize("ends", [["c", "f"], ["r", "f"], ["d", "zz"]])
def test_paths_to_ends_are_written_as_paths_alone(spark, monkeypatch, ends):
    def never(*a):
        raise AssertionError("a checkpoint of rows")
    monkeypatch.setattr(GF, "cut_lineage", never)
    written = []
    monkeypatch.setattr(GF, "store", lambda df, own=GF.store: written.append(df.columns) or own(df))
    got = GP.paths_between(edges_df(spark, LADDER, "string"), ["r", "s", "c"], ends)
    want = [p for s in "rsc" for p in simple_paths(LADDER, s, lambda p: len(p) > 1 and p[-1] in ends)]
    assert sorted((r.start, r.t, r.levels) for r in got.select("start", path_text("path").alias("t"), "levels").collect()) == sorted(
        (p[0], " -> ".join(p), len(p) - 1) for p in want)
    assert ["path", "grown"] in written and not any("last" in c for c in written)


def test_paths_take_notes_of_their_nodes_and_hops(spark):
    e = edges_df(spark, LADDER, "string")
    notes = GP.node_notes(spark.createDataFrame([("c", "C"), ("f", "F"), ("f", "A"), ("zz", "Z")], "node string, name string"), ("name",))
    hops = GP.hop_notes(spark.createDataFrame([("a", "c", 7), ("a", "c", 3), ("e", "f", None), ("x", "y", 9), ("r", "b", 1)], "src string, dst string, n int"), "n")
    lp = GP.leaf_paths(e, ["r", "s", "f", "q"], notes=notes, hop_notes=hops)
    assert "Exchange" not in lp._jdf.queryExecution().executedPlan().toString()  # nothing is regrouped
    got = {r.id: (r.name_levels, r.n_hops) for r in GP.path_details(lp.withColumn("id", path_text("path")), "id", detail_cols=("name",), attr="n").collect()}
    name, hop = {"c": "C", "f": "A"}, {("a", "c"): "3", ("r", "b"): "1"}
    want = [p for s in "rsfq" for p in simple_paths(LADDER, s, lambda p: p[-1] in "fq")]
    assert got == {" -> ".join(p): ([name.get(x) for x in p], " -> ".join(hop.get(x, "") for x in zip(p, p[1:]))) for p in want}
    with pytest.raises(ValueError):
        GP.leaf_paths(e, ["r"], max_levels=2, notes=notes)


def test_paths_of_every_node_need_one_layout(spark, monkeypatch):
    made = []
    monkeypatch.setattr(GF, "_laid_out", lambda *a, own=GF._laid_out: made.append(1) or own(*a))
    e = edges_df(spark, [*LADDER, LADDER[0]], "string")
    got = sorted(r[0] for r in GP.leaf_paths(e).select(path_text("path")).collect())
    assert len(made) == 1
    nodes = sorted({x for p in LADDER for x in p})
    assert got == sorted(" -> ".join(p) for s in nodes for p in simple_paths(LADDER, s, lambda p: p[-1] == "f"))


def test_a_round_of_many_batches_is_made_some_at_a_time(spark, monkeypatch):
    """80 starts in batches of 4: no shuffle of a round gets more rows than a slice, and the levels are right."""
    pairs = [(i, (i + 1) % 90) for i in range(90)] + [(i, (i * 7 + 3) % 90) for i in range(90)] + [(5, 200)]
    e, starts = edges_df(spark, pairs), spark.range(80).select(F.col("id").cast("int").alias("node"))
    monkeypatch.setattr(GF, "SLICE_ROWS", 100)
    written = []
    monkeypatch.setattr(GF, "store", lambda df, own=GF.store: written.append(own(df)) or written[-1])
    levels, ids, masks = GF.mask_levels(prepared_edges(e), store(starts), 3, width=4, words=1)
    fronts = [f for f in written if "m0" in f.columns]
    assert len(fronts) > 1 + 3 * 2  # of a level several
    got = {(r.start, r.node): i for i, x in enumerate(levels) for r in GF.with_bits(x, ids, masks).select("start", "node").collect()}
    want = {}
    for s in range(80):
        front, seen = {s}, set()
        for level in range(4):
            want |= {(s, x): level for x in front}
            seen |= front
            front = {d for a, d in pairs if a in front} - seen
    assert got == want


def test_labels_of_nodes_that_left_the_graph_prune_nothing(spark, monkeypatch):
    """Only labels of nodes still in the graph are joined: below a first batch of parts no list is followed."""
    from spindle.operators.graph import reach_index as RI
    monkeypatch.setattr(RI, "FIRST", 11)
    met = []
    monkeypatch.setattr(RI, "_not_met", lambda *a, own=RI._not_met: met.append(1) or own(*a))
    written = []
    monkeypatch.setattr(RI, "store", lambda df, own=RI.store: written.append(df.columns) or own(df))
    pairs = [("n", f"c{c}") for c in range(6)] + [(f"c{c}", f"o{c}-{p}") for c in range(6) for p in range(4)]
    pairs += [(f"o{c}-{p}", f"p{p}") for c in range(6) for p in range(4)] + [(f"x{i}", f"p{p}") for p in range(4) for i in range(9)]
    index = RI.reach_index(edges_df(spark, pairs, "string"))
    batches = written.count(["src", "dst"]) - 1
    assert not met and written.count(["hub", "via"]) < 2 * batches  # not for every search
    asked = spark.createDataFrame([("n", "p0"), ("c1", "o1-2"), ("c1", "o2-2"), ("o3-1", "p1"), ("x2", "p3"), ("p1", "n")], "start string, node string")
    assert {(r.start, r.node) for r in RI.reach_pairs(index, asked).collect() if r.reachable} == {("n", "p0"), ("c1", "o1-2"), ("o3-1", "p1"), ("x2", "p3")}
