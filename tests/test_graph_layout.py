"""How the graph operators lay out and read their tables: what is shuffled, and how often."""

import pytest
from pyspark.sql import functions as F

from shapes import edges_df
from spindle.operators.graph import components as GK
from spindle.operators.graph import edges as E
from spindle.operators.graph import paths as GP
from spindle.operators.graph import reach as GR
from spindle.operators.graph import frontier as GF
from spindle.operators.graph import shortest as GS
from spindle.operators.graph.frontier import path_text, prepared_edges, task_parts

RING = [("in", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("b", "x"), ("c", "y")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_are_laid_out_once_and_not_moved_by_a_round(spark):
    e = prepared_edges(edges_df(spark, [(i, i + 1) for i in range(1000)]))
    assert prepared_edges(e) is e
    front = spark.range(500).select(F.col("id").cast("int")).hint("merge").join(e, F.col("id") == e["src"], "left")
    assert plan(front).split("InMemoryRelation")[0].count("Exchange hashpartitioning") == 1  # the frontier's


def test_edges_are_made_distinct_by_the_sort_of_their_layout(spark):
    pairs = [(str(i), str(i + 1)) for i in range(1000)]
    e = prepared_edges(edges_df(spark, [*pairs, (None, "1"), *pairs, ("2", None)], "string"))
    assert sorted(tuple(r) for r in e.collect()) == sorted(pairs)
    assert "Exchange hashpartitioning" in plan(e) and "Aggregate" not in plan(e)
    assert sorted(tuple(r) for r in prepared_edges(edges_df(spark, [(1, 2), (1, 2), (1, 3)])).collect()) == [(1, 2), (1, 3)]  # a hub's
    assert prepared_edges(edges_df(spark, [(1, 2), (1, 2)]), collapse=False).count() == 2


def test_the_layout_sorts_once(spark):
    assert plan(prepared_edges(edges_df(spark, [(i, i + 1) for i in range(1000)]))).split("Initial Plan")[0].count("Sort [") == 1


def test_partitions_follow_the_rows(spark):
    assert task_parts(spark, 10) == 8 and task_parts(spark, 100, most=4) == 25


def test_leaf_paths_of_every_node_equal_those_of_all_starts(spark):
    e = edges_df(spark, RING, "string")
    def rows(df):
        return sorted(tuple(r) for r in df.select("start", path_text("path"), "levels").collect())
    assert rows(GP.leaf_paths(e)) == rows(GP.leaf_paths(e, E.nodes_of(e)))


def test_paths_of_one_id_are_not_mixed(spark):
    p = spark.createDataFrame([("k", ["a", "b"]), ("k", ["b", "c", "d"])], "id string, path array<string>")
    d = spark.createDataFrame([("a", "A"), ("c", "C")], "node string, name string")
    at = spark.createDataFrame([("c", "d", 7)], "src string, dst string, n int")
    got = {(tuple(r[1]), r[2]) for r in GP.path_details(p, "id", d, at, ("name",), "n").collect()}
    assert got == {(("A", None), ""), ((None, "C", None), " -> 7")}


def test_a_profile_joins_and_expands_nothing(spark):
    e = edges_df(spark, [(1, 2), (1, 2), (1, 3), (3, 2)])
    for multigraph in (False, True):
        p = E.node_profile(e, multigraph=multigraph)
        assert "Join" not in plan(p) and "Expand" not in plan(p)
    assert {tuple(r) for r in E.node_profile(e, multigraph=True).collect()} == {
        (1, 0, 3, 0, 2, "Start"), (2, 3, 0, 2, 0, "End"), (3, 1, 1, 1, 1, "Intermediate")}


def test_each_level_of_predecessors_is_a_table(spark):
    e = prepared_edges(edges_df(spark, [(0, 1), (1, 2), (0, 2), (2, 3)], "long"))
    levels = GS.predecessors(e, spark.createDataFrame([(0,)], "node long"), 2)
    assert [sorted((r["node"], r["parent"]) for r in x.collect()) for x in levels] == [[(0, None)], [(1, 0), (2, 0)], [(3, 2)]]


def test_a_star_s_component(spark):
    e = edges_df(spark, [(0, i) for i in range(1, 2000)] + [(5000, 5001)])
    sizes = {tuple(r) for r in GK.connected_components(e).select("component", "size").distinct().collect()}
    assert sizes == {(0, 2000), (5000, 2)}


def test_starts_of_a_component_share_a_row_a_node(spark, monkeypatch):
    """150 starts on a ring with a tail: one row of masks a node and level, right levels on every word."""
    pairs = [(i, (i + 1) % 160) for i in range(160)] + [(0, i) for i in range(10, 160, 10)] + [(7, 500)]
    written = []
    monkeypatch.setattr(GF, "store", lambda df, own=GF.store: written.append(own(df)) or written[-1])
    got = {(r.start, r.node): r.level for r in GF.bfs(edges_df(spark, pairs), list(range(150)), max_level=4).collect()}
    want = {}
    for s in range(150):
        front, level = {s}, 0
        while front and level <= 4:
            for x in front:
                want[s, x] = level
            front = {d for a, d in pairs if a in front} - {x for t, x in want if t == s}
            level += 1
    assert got == want
    fronts = [f for f in written if {"batch", "node"} <= set(f.columns)]
    assert fronts and all(f.count() == f.select("node").distinct().count() for f in fronts)


def test_paths_to_targets_move_no_path_of_another_node(spark, monkeypatch):
    """70 targets behind a ring: smallest of the equally short texts, and a row of masks a node in the search."""
    pairs = [(f"a{i}", f"a{(i + 1) % 9}") for i in range(9)] + [(f"a{i}", f"b{i % 3}") for i in range(9)] + [("a1", "a12"), ("a12", "b2")]
    pairs += [(f"b{i}", f"t{k}") for i in range(3) for k in range(70) if k % 3 != i]
    written = []
    monkeypatch.setattr(GF, "store", lambda df, own=GF.store: written.append(own(df)) or written[-1])
    starts, targets = ["a0", "a1", "a4", "t3", "zz"], [f"t{k}" for k in range(70)]
    for bound in (None, 2):
        got = {(r.start, r.leaf_node): (r.path_length, r.path) for r in GS.shortest_paths_to(edges_df(spark, pairs, "string"), starts, targets, bound).collect()}
        want = {}
        for s in starts:
            front, seen, level = {s: s}, {s}, 0
            while front and (bound is None or level < bound):
                level, new = level + 1, {}
                for x, path in front.items():
                    for a, d in pairs:
                        if a == x and d not in seen:
                            new[d] = min(new.get(d, "~"), f"{path} -> {d}")
                front, seen = new, seen | set(new)
                want.update({(s, d): (level, p) for d, p in new.items() if d in targets})
        assert got == want and got
    masks = [f for f in written if "m0" in f.columns]
    assert masks and all(f.count() == f.select("batch", "node").distinct().count() for f in masks)


def moved(df):
    """The shuffles of a plan, those of the layout of its cached edges not counted."""
    return sum("Exchange hashpartitioning" in x and "ENSURE_REQUIREMENTS" in x for x in plan(df).splitlines())


def test_edges_laid_out_by_both_ends_are_not_moved_for_either(spark):
    e = prepared_edges(edges_df(spark, [(i, i + 1) for i in range(1000)]))
    before = E.roots(e)
    back = GF.reversed_edges(e)
    assert GF.reversed_edges(e) is back and GF.reversed_edges(back) is e and moved(before) > 0
    for df in (E.roots(e), E.leaves(e)):
        assert moved(df) == 0
    assert [tuple(r) for r in E.roots(e).collect()] == [(0,)] and [tuple(r) for r in E.leaves(e).collect()] == [(1000,)]


def test_path_counts_move_no_edges_in_a_round(spark, monkeypatch):
    """A ladder: the sums of a round come from edges that lie by their ends."""
    pairs = [(i, i + 1) for i in range(8)] + [(0, 2), (4, 6)]
    written = []
    monkeypatch.setattr(GP, "store", lambda df, own=GP.store: written.append(df) or own(df))
    monkeypatch.setattr(GF, "HUB_SHARE", 100)
    got = GP.path_counts(prepared_edges(edges_df(spark, pairs)), [0, 4, 77]).collect()
    assert {(r.start, int(r.walks), int(r.leaf_paths)) for r in got} == {(0, 22, 4), (4, 8, 2), (77, 1, 1)}
    rounds = [f for f in written if "need" in f.columns]
    assert [moved(f) for f in rounds] == [1] * 9


@pytest.mark.parametrize("share", [2, 100])
def test_undirected_edges_of_a_prepared_table(spark, monkeypatch, share):
    monkeypatch.setattr(GF, "HUB_SHARE", share)
    pairs = [(i, i + 1) for i in range(50)] + [(1, 0), (7, 7)]
    e = prepared_edges(edges_df(spark, pairs))
    assert sorted(tuple(r) for r in E.undirected(e).collect()) == sorted({*pairs, *((d, a) for a, d in pairs)})


@pytest.mark.parametrize("starts", [[0, 3, 40], list(range(80))])
@pytest.mark.parametrize("per_start", [True, False])
def test_skipped_nodes_are_looked_up_in_no_edge(spark, monkeypatch, starts, per_start):
    """Skipped nodes are seen from the beginning: a round reads the edges as they were laid out."""
    pairs = [(i, i + 1) for i in range(90)] + [(3, 60), (60, 3), (8, 5)]
    skip = spark.createDataFrame([(5,), (40,), (62,), (None,), (999,)], "node int")
    used = []
    monkeypatch.setattr(GF, "mask_levels", lambda e, *a, own=GF.mask_levels: used.append(e) or own(e, *a))
    e = prepared_edges(edges_df(spark, pairs))
    got = {(r["start"] if per_start else None, r["node"], r["level"]) for r in GR.reach(e, starts, ignore=skip, per_start=per_start).collect()}
    want, groups = set(), [[s] for s in starts] if per_start else [starts]
    for g in groups:
        front, seen, level = {s for s in g} - {5, 40, 62}, {5, 40, 62}, 0
        while front:
            want |= {(g[0] if per_start else None, x, level) for x in front}
            seen |= front
            front, level = {d for a, d in pairs if a in front} - seen, level + 1
    assert got == want and all(x is e for x in used) and bool(used) == per_start
