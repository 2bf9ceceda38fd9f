"""Graph operators on small graphs built for each rule, with hand-derived results."""

import pytest
from pyspark.sql import functions as F

from shapes import edges_df
from spindle.operators.graph import algebra as GA
from spindle.operators.graph import components as GK
from spindle.operators.graph import cycles as GC
from spindle.operators.graph import edges as E
from spindle.operators.graph import paths as GP
from spindle.operators.graph import reach as GR
from spindle.operators.graph import shortest as GS
from spindle.operators.graph.frontier import path_text

# one way in (in), a ring a-b-c with a shortcut b-a, two ways out (x, y)
RING = [("in", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("b", "x"), ("c", "y")]


def letters(spark, pairs):
    return edges_df(spark, pairs, "string")


def chain(n):
    return [(i, i + 1) for i in range(n)]


def texts(df, col="path"):
    return sorted(r[0] for r in df.select(path_text(col)).collect())


def test_leaf_paths_leave_the_ring_only_at_leaves(spark):
    e = letters(spark, RING)
    assert texts(GP.leaf_paths(e, ["in"])) == ["in -> a -> b -> c -> y", "in -> a -> b -> x"]
    flagged = GP.leaf_paths(letters(spark, [("a", "b"), ("b", "a")]), ["a"], emit_truncated=True)
    assert [(r["t"], r["truncated"]) for r in flagged.select(path_text("path").alias("t"), "truncated").collect()] == [("a -> b", True)]


def test_bounds_flag_what_they_cut(spark):
    e = edges_df(spark, [*chain(6), (0, 6)])
    rows = {(r["levels"], r["truncated"]) for r in GP.leaf_paths(e, [0], max_levels=3).collect()}
    assert rows == {(1, False), (3, True)}
    assert sorted(r["levels"] for r in GP.leaf_paths(e, [0]).collect()) == [1, 6]
    cycles = GC.simple_cycles(edges_df(spark, [*chain(5), (5, 0), (1, 0)]), max_length=3).collect()
    assert {(r["cycle"], r["truncated"]) for r in cycles} == {("0 -> 1 -> 0", False), ("0 -> 1 -> 2 -> 3", True), ("1 -> 2 -> 3 -> 4", True)}


def test_long_chain_reaches_its_leaf(spark):
    s = GS.shortest_paths(edges_df(spark, chain(45)), [0]).collect()
    assert [(r["leaf_node"], r["path_length"]) for r in s] == [(45, 45)]
    e = edges_df(spark, chain(6))
    assert GS.shortest_paths(e, [0], max_level=5).count() == 0
    assert {(r["start"], r["path_length"]) for r in GS.shortest_paths_to(e, [0, 2], [6]).collect()} == {(0, 6), (2, 4)}


@pytest.mark.parametrize("n", [10, 70])
def test_a_null_start_is_no_start(spark, n):
    e = edges_df(spark, [(i, i + 1) for i in range(100) if i % 5 < 4])
    starts = spark.createDataFrame([(None,), *[(i,) for i in range(n)]], "node int")
    r = GR.reach(e, starts).groupBy("start").count().collect()
    assert {x["start"]: x["count"] for x in r} == {i: 5 - i % 5 for i in range(n)}


def test_a_hub_s_edges_lie_in_many_partitions(spark):
    from spindle.operators.graph.frontier import prepared_edges
    pairs = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("src"), (F.col("id") + 1).alias("dst"))
    for collapse in (True, False):
        e = prepared_edges(pairs, collapse=collapse)
        sizes = [r["count"] for r in e.filter("src = 0").groupBy(F.spark_partition_id()).count().collect()]
        parts = e.rdd.getNumPartitions()
        assert sum(sizes) == 10_000 and (parts == 1 or max(sizes) < 10_000)


def test_cycle_core_and_simple_cycles(spark):
    e = letters(spark, RING)
    core = {tuple(r) for r in GC.cycle_core(e).collect()}
    assert core == {("a", "b"), ("b", "c"), ("c", "a"), ("b", "a")}
    assert sorted(r["cycle"] for r in GC.simple_cycles(e).collect()) == ["a -> b -> a", "a -> b -> c -> a"]
    assert GC.has_cycle(e) and not GC.has_cycle(letters(spark, [("a", "b"), ("b", "c")]))


def test_witness_of_a_long_cycle(spark):
    n = 1000
    ring = [((i * 7) % n, ((i + 1) * 7) % n) for i in range(n)]
    w = GC.one_cycle(edges_df(spark, ring), core=edges_df(spark, ring)).orderBy("pos").collect()
    assert [r["pos"] for r in w] == list(range(n)) and w[0]["src"] == 0 and w[-1]["dst"] == 0
    assert all(a["dst"] == b["src"] for a, b in zip(w, w[1:], strict=False))
    assert GC.one_cycle(edges_df(spark, chain(3))).count() == 0


def test_reach_degrees(spark):
    e = letters(spark, [("top", "l"), ("top", "r"), ("l", "low"), ("r", "low"), ("r", "end")])
    r = {r["node"]: (r["level"], r["in_degree"], r["out_degree"]) for r in GR.reach_with_degrees(e, ["top"]).collect()}
    assert r == {"top": (0, 0, 2), "l": (1, 1, 1), "r": (1, 1, 2), "low": (2, 2, 0), "end": (2, 1, 0)}


def test_bfs_levels_until_target(spark):
    pairs = [(0, 1), (0, 2), (1, 3), (2, 4), (2, 5), (4, 6), (3, 7), (7, 8)]
    tgt = spark.createDataFrame([(6,)], "node int")
    r = {(x["level"], x["node"], x["out_degree"]) for x in GR.bfs_levels(edges_df(spark, pairs), [0], target=tgt).collect()}
    assert r == {(0, 0, 2), (1, 1, 1), (1, 2, 2), (2, 3, 1), (2, 4, 1), (2, 5, 0), (3, 6, 0), (3, 7, 1)}


def test_reach_skipping_nodes_undirected(spark):
    e = E.undirected(letters(spark, [("m", "n"), ("o", "n"), ("o", "p"), ("m", "q")]))
    assert {r["node"] for r in GR.reach(e, ["q"]).collect()} == set("mnopq")
    skip = spark.createDataFrame([("n",)], "node string")
    assert {r["node"] for r in GR.reach(e, ["q"], ignore=skip).collect()} == {"q", "m"}
    assert GR.reach(e, ["n"], ignore=skip).count() == 0


def test_paths_between_and_counts(spark):
    # a ladder: two ways at each of three steps
    pairs = [(f"s{i}", f"{w}{i}") for i in range(3) for w in "uv"] + [(f"{w}{i}", f"s{i + 1}") for i in range(3) for w in "uv"]
    e = letters(spark, pairs)
    assert GP.paths_between(e, ["s0"], ["s3"]).count() == 8
    assert texts(GP.paths_between(e, ["s0"], ["s1"])) == ["s0 -> u0 -> s1", "s0 -> v0 -> s1"]
    c = GP.path_counts(e, ["s0"]).first()
    assert c["leaf_paths"] == 8 and c["walks"] == GP.prefix_walks(e, ["s0"]).count() == 1 + 2 + 2 + 4 + 4 + 8 + 8


def test_path_counts_beyond_64_bits_and_on_cycles(spark):
    wide = range(64)
    pairs = [("s", f"0.{w}") for w in wide] + [(f"{i}.{v}", f"{i + 1}.{w}") for i in range(10) for v in wide for w in wide] + [(f"10.{w}", "t") for w in wide]
    assert int(GP.path_counts(letters(spark, pairs), ["s"]).first()["leaf_paths"]) == 64 ** 11
    with pytest.raises(ValueError, match="cycle"):
        GP.path_counts(letters(spark, [("a", "b"), ("b", "a")]), ["a"])


def test_shortest_paths_tie_rule(spark):
    # two ways of two edges (over "10" and over "9") beat one of three; the smaller text wins
    e = edges_df(spark, [(1, 10), (1, 9), (10, 20), (9, 20), (1, 2), (2, 3), (3, 20), (20, 30)])
    assert [(r["leaf_node"], r["path"], r["path_length"]) for r in GS.shortest_paths(e, [1]).collect()] == [(30, "1 -> 10 -> 20 -> 30", 3)]
    assert [r["path"] for r in GS.shortest_paths_to(e, [1], [30]).collect()] == ["1 -> 10 -> 20 -> 30"]
    assert {r["path"] for r in GS.shortest_paths(e, [30], reverse=True).collect()} == {"30 -> 20 -> 10 -> 1"}


def test_forward_and_backward_shortest_paths_agree(spark):
    pairs = [(i, (i * 5 + 2) % 60) for i in range(60)] + [(i, (i * 11 + 7) % 60) for i in range(60)] + [(i, 100 + k % 3) for k, i in enumerate(range(0, 60, 9))]
    e = edges_df(spark, pairs)
    forward = {tuple(r) for r in GS.shortest_paths(e, [0, 5, 17]).select("start", "leaf_node", "path", "path_length").collect()}
    assert forward == {tuple(r) for r in GS.shortest_paths_to(e, [0, 5, 17], E.leaves(e)).collect()} and len(forward) >= 3


def test_subgraph_and_bfs_tree(spark):
    e = letters(spark, RING)
    assert {tuple(r) for r in GA.induced(e, ["in", "a", "b"]).collect()} == {("in", "a"), ("a", "b"), ("b", "a")}
    tree = {(r["src"], r["dst"], r["level"]) for r in GR.bfs_tree(e, ["b"]).collect()}
    assert tree == {("b", "a", 1), ("b", "c", 1), ("b", "x", 1), ("c", "y", 2)}
    reach = GR.reach(e, ["c"]).select("start", "node")
    assert {(r["src"], r["dst"]) for r in GA.induced(e, reach, by=["start"]).collect()} == {p for p in RING if p[0] != "in"}


def test_node_profile_positions(spark):
    e = letters(spark, [("k", "l"), ("k", "l"), ("l", "m"), ("k", "m")])
    prof = {r["node"]: (r["in_degree"], r["out_degree"], r["position"]) for r in E.node_profile(e).collect()}
    assert prof == {"k": (0, 2, "Start"), "l": (1, 1, "Intermediate"), "m": (2, 0, "End")}
    assert {r["node"]: r["out_degree"] for r in E.node_profile(e, multigraph=True).collect()}["k"] == 3
    assert [r["node"] for r in E.roots(e).collect()] == ["k"] and [r["node"] for r in E.leaves(e).collect()] == ["m"]


def test_build_edges_composite_and_last_wins(spark):
    df = spark.createDataFrame([("db", None, "t", 3, "old"), ("db", None, "t", 8, "new"), (None, "s", "t", 1, "one")],
                               "a string, b string, c string, o int, v string")
    e = E.build_edges(df, ["a", "b"], ["c"], attrs=["v"], order_cols=["o"])
    assert {tuple(r) for r in e.collect()} == {("db|", "t", "new"), ("|s", "t", "one")}


def test_lineage_edges_from_suffix(spark):
    e = letters(spark, [("job.load", "t1"), ("t1", "t2"), ("other", "t3")])
    assert {tuple(r) for r in GR.lineage_edges(e, ".load").collect()} == {("job.load", "t1"), ("t1", "t2")}


def test_hub_descendants(spark):
    e = edges_df(spark, [(1, 2), (9, 2), *[(2, 50 + i) for i in range(11)]])
    assert [(r["node"], r["out_degree"]) for r in GR.hub_descendants(e, [1], out_degree=10).collect()] == [(2, 11)]
    assert GR.hub_descendants(e, [2], out_degree=10).count() == 0  # the start itself is excluded


def test_merge_second_graph_wins_with_its_nulls(spark):
    a = spark.createDataFrame([("p", "q", 4), ("q", "r", 6), ("r", "s", 1)], "src string, dst string, w int")
    b = spark.createDataFrame([("q", "r", None), ("r", "s", 3), ("s", "t", 2)], "src string, dst string, w int")
    m = {tuple(r) for r in GA.merge_graphs(a, b, attrs=["w"]).collect()}
    assert m == {("p", "q", 4), ("q", "r", None), ("r", "s", 3), ("s", "t", 2)}
    nodes = lambda *x: spark.createDataFrame([(v,) for v in x], "node string")
    assert GA.disjoint(nodes("p", "q"), nodes("r")).first()["disjoint"] is True
    assert GA.disjoint(nodes("p", "q"), nodes("q")).first()["shared_nodes"] == 1


def test_compress_at_models(spark):
    rows = [("src.table/load/report", "src.table"), ("raw/step m1001/clean/step m2002 v2/out", "raw"), ("m9999/only/end", "top"), ("a/b m123/c", "a")]
    df = spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(rows)], "id int, lineage string, root string")
    out = GP.compress_at_models(df, "lineage", "root", sep="/").select("id", "seg", "segment", "idx_from", "idx_to").collect()
    got = {}
    for r in sorted(out):
        got.setdefault(r["id"], []).append((r["segment"], r["idx_from"], r["idx_to"]))
    assert got == {0: [("src.table/load/report", 1, 3)],
                   1: [("raw/step m1001", 1, 2), ("step m1001/step m2002 v2", 2, 4), ("step m2002 v2/out", 4, 5)],
                   2: [("top/m9999", 1, 1), ("m9999/only/end", 1, 3)], 3: [("a/b m123/c", 1, 3)]}
    wide = spark.createDataFrame([("x=>m1234=>y",)], "p string")
    assert [r["segment"] for r in GP.compress_at_models(wide, "p", sep="=>").orderBy("seg").collect()] == ["x=>m1234", "m1234=>y"]


def test_path_report_and_details(spark):
    e = spark.createDataFrame([("u", "v", "copy"), ("v", "w", None), ("w", "z", "sum")], "src string, dst string, rule string")
    p = GP.leaf_paths(e, ["u"]).withColumn("pid", F.lit(7))
    rep = GP.path_report(p, 3).first()
    assert (rep["path_text"], rep["n_levels"], rep["path_start"], rep["path_end"]) == ("u -> v -> w -> z", 3, "u", "z")
    assert (rep["level_1"], rep["level_3"], rep["overflow"]) == ("u", "w", True)
    # two detail rows of a node stay whole; a hop without an attribute keeps its place
    det = spark.createDataFrame([("u", "first", "z"), ("u", "second", "a"), ("v", "mid", "m")], "node string, name string, owner string")
    d = GP.path_details(p, "pid", details=det, edge_attrs=e, detail_cols=("name", "owner"), attr="rule").first()
    assert d["name_levels"] == ["first", "mid", None, None] and d["owner_levels"] == ["z", "m", None, None]
    assert d["rule_hops"] == "copy ->  -> sum"


def test_bitmask_bfs_equals_row_bfs(spark):
    from spindle.operators.graph.frontier import bfs, ms_bfs, prepared_edges
    pairs = [(i, (i * 7 + 3) % 90) for i in range(90)] + [(i, (i * 13 + 5) % 90) for i in range(90)] + [(90, 91)]
    e = prepared_edges(edges_df(spark, pairs))
    starts = spark.createDataFrame([(i,) for i in range(0, 92, 1)], "node int")
    rows = {tuple(r) for r in bfs(e, starts, parents=True, prepared=True).select("start", "node", "level").collect()}
    bits = {tuple(r) for r in ms_bfs(e, starts, width=8).collect()}
    assert rows == bits and len(rows) > 92


def plain_components(pairs):
    """Strongly connected components by mutual reachability."""
    nodes = sorted({x for p in pairs for x in p})
    after = {n: {d for s, d in pairs if s == n} for n in nodes}
    reach = {}
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            for d in after[todo.pop()]:
                if d not in seen:
                    seen.add(d)
                    todo.append(d)
        reach[n] = seen
    of = {n: [m for m in nodes if m in reach[n] and n in reach[m]] for n in nodes}
    return {n: (min(c), len(c)) for n, c in of.items()}


@pytest.mark.parametrize("seed", range(4))
def test_strong_components_against_mutual_reachability(spark, seed):
    import random
    rng = random.Random(seed)
    n = 40
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([30, 45, 60]))]
    pairs += [(100 + i, 100 + (i + 1) % 7) for i in range(7)] + [(200, 100), (103, 201), (5, 200), (201, 202), (202, 203), (203, 5), (7, 7)]
    e = edges_df(spark, [*pairs, pairs[0]])
    want = plain_components(pairs)
    assert {r["node"]: (r["component"], r["size"]) for r in GK.strong_components(e).collect()} == want
    cyclic = {x for x, (_, k) in want.items() if k > 1} | {s for s, d in pairs if s == d}
    core, left = set(pairs), None
    while core != left:
        left = core
        core = {(s, d) for s, d in left if any(y == s for _, y in left) and any(x == d for x, _ in left)}
    assert {tuple(r) for r in GC.cycle_core(e).collect()} == core and cyclic <= {x for p in core for x in p}


def test_long_chains_and_rings_take_few_rounds(spark, monkeypatch):
    calls = []
    real = GK.store
    monkeypatch.setattr(GK, "store", lambda df: calls.append(1) or real(df))
    n = 5000
    pairs = [(i, i + 1) for i in range(n)] + [(n, n - 2)] + [(n + 1 + i, n + 2 + i) for i in range(n)] + [(n, n + 1)]
    e = edges_df(spark, pairs)  # a ring of three with a chain into it and a chain out of it
    assert {tuple(r) for r in GC.cycle_core(e).collect()} == {(n - 2, n - 1), (n - 1, n), (n, n - 2)}
    assert len(calls) < 60
    ring = edges_df(spark, [(i, (i + 1) % n) for i in range(n)])
    assert {(r["component"], r["size"]) for r in GK.strong_components(ring).collect()} == {(0, n)}
    assert not GC.has_cycle(edges_df(spark, chain(300))) and GC.strong_components(edges_df(spark, chain(3))).count() == 4


def test_connected_components(spark):
    import random
    rng = random.Random(8)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(60)] + [(500, 500)]
    lone = spark.createDataFrame([(900,), (901,), (None,)], "node int")
    both = pairs + [(b, a) for a, b in pairs]
    want = {n: c for n, c in plain_components(both).items()} | {900: (900, 1), 901: (901, 1)}
    assert {r["node"]: (r["component"], r["size"]) for r in GK.connected_components(edges_df(spark, pairs), lone).collect()} == want
    cut = [p for p in both if 330 not in p]
    want = plain_components([*cut, *[(n, n) for n in want if n != 330]])
    got = GK.connected_components(edges_df(spark, pairs), lone, ignore=spark.createDataFrame([(330,)], "node int"))
    assert {r["node"]: (r["component"], r["size"]) for r in got.collect()} == want


def test_cycles_with_a_long_dead_end(spark):
    # many ways lead on from the ring, none of them back
    ring = [(0, 1), (1, 2), (2, 0), (2, 1)]
    tail = [(2, 10)] + [(10 * i + a, 10 * (i + 1) + b) for i in range(1, 12) for a in range(3) for b in range(3)] + [(10, 11), (10, 12)]
    e = edges_df(spark, ring + tail)
    assert sorted(r["cycle"] for r in GC.simple_cycles(e).collect()) == ["0 -> 1 -> 2 -> 0", "1 -> 2 -> 1"]
    # inside a component: nodes above the start that cannot come back to it are not walked
    e = edges_df(spark, [(0, 5), (5, 6), (6, 0), (5, 7), (7, 8), (8, 0), (8, 7)])
    assert sorted(r["cycle"] for r in GC.simple_cycles(e).collect()) == ["0 -> 5 -> 6 -> 0", "0 -> 5 -> 7 -> 8 -> 0", "7 -> 8 -> 7"]


def test_path_counts_of_all_nodes(spark):
    pairs = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (3, 5), (9, 4)]
    got = {r["start"]: (int(r["walks"]), int(r["leaf_paths"])) for r in GP.path_counts(edges_df(spark, pairs)).collect()}
    assert got == {0: (9, 4), 1: (4, 2), 2: (4, 2), 3: (3, 2), 4: (1, 1), 5: (1, 1), 9: (2, 1)}
    cyclic = edges_df(spark, [*pairs, (20, 21), (21, 20), (21, 0)])
    assert int(GP.path_counts(cyclic, [0]).first()["walks"]) == 9  # the cycle lies above the start
    assert int(GP.path_counts(cyclic, [20], max_level=2).first()["walks"]) == 4


def test_paths_are_numbered_anew_where_digits_run_out(spark, monkeypatch):
    monkeypatch.setattr(GS, "BITS", 24)
    pairs = [(i, (i * 5 + 2) % 60) for i in range(60)] + [(i, (i * 11 + 7) % 60) for i in range(60)] + [(i, 100 + k % 3) for k, i in enumerate(range(0, 60, 9))]
    e = edges_df(spark, pairs)
    forward = {tuple(r) for r in GS.shortest_paths(e, [0, 5, 17]).collect()}
    assert forward == {tuple(r) for r in GS.shortest_paths_to(e, [0, 5, 17], E.leaves(e)).collect()} and len(forward) >= 3
    assert GS.shortest_paths(e, [0], to="all").count() == GR.reach(e, [0], include_start=False).count()
