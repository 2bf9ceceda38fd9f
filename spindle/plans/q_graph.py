"""Registered lineage-graph queries (G1-G36, J3, W1 on paths).

LINEAGE (acyclic) has every row of nation, customer, orders and lineitem as an
edge, EVENTS (cyclic) every user's transitions of event types, PART the
neighbouring parts of every order. Walks start from *all* roots (never a fixed
node); PART starts are the parts of size 1 (they grow with the part table).

Oracles are DuckDB recursive queries: ``USING KEY`` BFS for levels and
shortest paths, ``UNION ALL`` with an exact list guard for path enumeration.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spindle.operators.graph import algebra as GA
from spindle.operators.graph import components as GK
from spindle.operators.graph import cycles as GC
from spindle.operators.graph import edges as E
from spindle.operators.graph import paths as GP
from spindle.operators.graph import reach as GR
from spindle.operators.graph import reach_index as GI
from spindle.operators.graph import shortest as GS
from spindle.operators.graph.frontier import path_text, prepared_edges, reversed_edges, walk_paths
from spindle.plans import bindings as b
from spindle.plans.registry import r4, register
from spindle.session import cut_lineage, store

DAG = b.LINEAGE_SQL
CYC = b.EVENT_SQL


def roots_sql(e: str) -> str:
    return f"SELECT DISTINCT src AS node FROM ({e}) x WHERE src NOT IN (SELECT dst FROM ({e}) y)"


def leaves_sql(e: str) -> str:
    return f"SELECT DISTINCT dst AS node FROM ({e}) x WHERE dst NOT IN (SELECT src FROM ({e}) y)"


def nodes_sql(e: str) -> str:
    return f"SELECT src AS node FROM ({e}) x UNION SELECT dst FROM ({e}) y"


def ptext(col: str) -> str:
    return f"array_to_string(list_transform({col}, lambda x: CAST(x AS VARCHAR)), ' -> ')"


def bfs_sql(e: str, starts: str, per_start: bool = True) -> str:
    """CTE prefix defining ``e``, ``s`` and ``bfs(start, node, level, parent, path)``."""
    if per_start:
        return f"""WITH RECURSIVE e AS ({e}), s AS ({starts}),
bfs(start, node, level, parent, path) USING KEY (start, node) AS (
  SELECT node, node, 0, CAST(NULL AS VARCHAR), CAST(node AS VARCHAR) FROM s
  UNION
  SELECT b.start, e.dst, min(b.level) + 1, CAST(min(b.node) AS VARCHAR), min(b.path || ' -> ' || CAST(e.dst AS VARCHAR))
  FROM bfs b JOIN e ON b.node = e.src
  WHERE NOT EXISTS (SELECT 1 FROM recurring.bfs v WHERE v.start = b.start AND v.node = e.dst)
  GROUP BY b.start, e.dst)"""
    return f"""WITH RECURSIVE e AS ({e}), s AS ({starts}),
bfs(node, level) USING KEY (node) AS (
  SELECT node, 0 FROM s
  UNION
  SELECT e.dst, min(b.level) + 1 FROM bfs b JOIN e ON b.node = e.src
  WHERE e.dst NOT IN (SELECT node FROM recurring.bfs)
  GROUP BY e.dst)"""


def walks_sql(e: str, starts: str, guard: bool = True, max_levels: int | None = None, stop: str | None = None) -> str:
    """CTE prefix defining ``w(start, last, path)``: simple walks (or all walks) from the starts."""
    conds = []
    if guard:
        conds.append("NOT list_contains(w.path, e.dst)")
    if max_levels is not None:
        conds.append(f"len(w.path) <= {max_levels}")
    if stop is not None:
        conds.append(f"(len(w.path) = 1 OR w.last NOT IN ({stop}))")
    where = ("WHERE " + " AND ".join(conds)) if conds else ""
    return f"""WITH RECURSIVE e AS ({e}), s AS ({starts}),
w(start, last, path) AS (
  SELECT node, node, [node] FROM s
  UNION ALL
  SELECT w.start, e.dst, list_append(w.path, e.dst) FROM w JOIN e ON w.last = e.src {where})"""


def dag(spark, sf, both=False):
    """LINEAGE edges, made distinct and laid out once: every loop round and the
    final projections read that table instead of deriving it again. ``both``: also
    by their ends, for queries that ask for both ends of all edges."""
    e = prepared_edges(b.lineage_rows(spark, sf))
    if both:
        reversed_edges(e)
    return e


def cyc(spark, sf):
    return cut_lineage(b.event_edges(spark, sf))


def nation_names(spark, sf, *more):
    return b.table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), "n_name", *more)


def part(spark, sf):
    return store(b.part_edges(spark, sf))


def part_starts(spark, sf):
    return b.table(spark, sf, "part").filter(F.col("p_size") == 1).select(F.col("p_partkey").alias("node"))


PART_STARTS_SQL = "SELECT p_partkey AS node FROM part WHERE p_size = 1"


# ------------------------------------------------------------------ G1-G7

@register("g1_build_edges", """SELECT DISTINCT s_nationkey AS src, c_nationkey AS dst
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey""")
def g1(spark, sf):
    li = b.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    o = b.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = b.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    s = b.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    m = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")) \
          .join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return E.build_edges(m, "s_nationkey", "c_nationkey")


@register("g2_composite_key_edges", """SELECT DISTINCT
  concat_ws('|', coalesce(CAST(c_mktsegment AS VARCHAR), ''), coalesce(CAST(c_nationkey AS VARCHAR), '')) AS src,
  concat_ws('|', coalesce(CAST(o_orderpriority AS VARCHAR), ''), coalesce(CAST(o_orderstatus AS VARCHAR), '')) AS dst
FROM orders JOIN customer ON o_custkey = c_custkey""")
def g2(spark, sf):
    o = b.table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    c = b.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    m = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return E.build_edges(m, ["c_mktsegment", "c_nationkey"], ["o_orderpriority", "o_orderstatus"])


G3_ORDER = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus", "l_shipdate"]


@register("g3_edge_attrs_last_wins", f"""SELECT src, dst, round(l_quantity, 4) AS l_quantity,
  round(l_extendedprice, 4) AS l_extendedprice FROM (
  SELECT l_partkey AS src, l_suppkey AS dst, l_quantity, l_extendedprice,
    row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY {', '.join(c + ' DESC' for c in G3_ORDER)}) AS rn
  FROM lineitem) x WHERE rn = 1""")
def g3(spark, sf):
    li = b.table(spark, sf, "lineitem")
    e = E.build_edges(li, "l_partkey", "l_suppkey", attrs=["l_quantity", "l_extendedprice"], order_cols=G3_ORDER)
    return e.select("src", "dst", r4("l_quantity").alias("l_quantity"), r4("l_extendedprice").alias("l_extendedprice"))


@register("g4_node_attrs", f"""SELECT n.node AS node, na.n_name AS n_name, r.r_name AS r_name
FROM ({nodes_sql(DAG)}) n LEFT JOIN nation na ON n.node = 'n' || na.n_nationkey
LEFT JOIN region r ON na.n_regionkey = r.r_regionkey""")
def g4(spark, sf):
    r = b.table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    attrs = nation_names(spark, sf, "n_regionkey").join(r, "n_regionkey", "left").select("node", "n_name", "r_name")
    return E.with_node_attrs(E.nodes_of(dag(spark, sf)), attrs)


@register("g5_node_profile", f"""WITH e AS ({DAG}),
o AS (SELECT src AS node, count(*) AS out_degree, count(DISTINCT dst) AS distinct_out_degree FROM e GROUP BY 1),
i AS (SELECT dst AS node, count(*) AS in_degree, count(DISTINCT src) AS distinct_in_degree FROM e GROUP BY 1)
SELECT coalesce(o.node, i.node) AS node, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree,
  coalesce(distinct_in_degree, 0) AS distinct_in_degree, coalesce(distinct_out_degree, 0) AS distinct_out_degree,
  CASE WHEN coalesce(in_degree, 0) = 0 THEN 'Start' WHEN coalesce(out_degree, 0) = 0 THEN 'End'
       ELSE 'Intermediate' END AS position
FROM o FULL JOIN i ON o.node = i.node""")
def g5(spark, sf):
    return E.node_profile(dag(spark, sf))


@register("g6_roots", roots_sql(DAG))
def g6(spark, sf):
    return E.roots(dag(spark, sf))


@register("g7_leaves", leaves_sql(DAG))
def g7(spark, sf):
    return E.leaves(dag(spark, sf))


# ------------------------------------------------------------------ reach

@register("g8_descendants", bfs_sql(DAG, roots_sql(DAG)) + " SELECT start, node, level FROM bfs WHERE level > 0")
def g8(spark, sf):
    e = dag(spark, sf)
    return GR.reach(e, E.roots(e), include_start=False)


@register("g8_part_descendants", bfs_sql(b.PART_SQL, PART_STARTS_SQL, per_start=False) + " SELECT node, level FROM bfs")
def g8p(spark, sf):
    return GR.reach(part(spark, sf), part_starts(spark, sf), per_start=False)


FIFTIETH_SQL = "SELECT p_partkey AS node FROM part WHERE p_partkey % 50 = 0"


@register("g8_part_pairs", bfs_sql(b.PART_SQL, FIFTIETH_SQL) + " SELECT start, node, level FROM bfs")
def g8q(spark, sf):
    """Every part whose key is divisible by 50 against all parts."""
    starts = b.table(spark, sf, "part").filter(F.col("p_partkey") % 50 == 0).select(F.col("p_partkey").alias("node"))
    return GR.reach(part(spark, sf), starts).select("start", "node", "level")


# The oracle needs no search: an order lies below its customer's nation and below no other.
@register("g8_supplier_nation_reaches_order", """SELECT DISTINCT 'n' || s_nationkey AS start, 'o' || o_orderkey AS node,
  s_nationkey = c_nationkey AS reachable
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey""")
def g8i(spark, sf):
    """Every (nation of a line's supplier, order) pair, asked of the index of the whole lineage graph."""
    li = b.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    s = b.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    pairs = li.join(s, li.l_suppkey == s.s_suppkey).select(
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("start"),
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("node")).distinct()
    return GI.reach_pairs(GI.reach_index(dag(spark, sf)), pairs)


@register("g9_reach_with_degrees", bfs_sql(DAG, roots_sql(DAG)) + """,
o AS (SELECT src AS node, count(*) AS od FROM e GROUP BY 1), i AS (SELECT dst AS node, count(*) AS idg FROM e GROUP BY 1)
SELECT start, bfs.node AS node, level, coalesce(idg, 0) AS in_degree, coalesce(od, 0) AS out_degree
FROM bfs LEFT JOIN o ON bfs.node = o.node LEFT JOIN i ON bfs.node = i.node""")
def g9(spark, sf):
    e = dag(spark, sf)
    return GR.reach_with_degrees(e, E.roots(e))


@register("g10_leaf_descendants", bfs_sql(DAG, roots_sql(DAG)) +
          " SELECT start, node FROM bfs WHERE level > 0 AND node NOT IN (SELECT src FROM e)")
def g10(spark, sf):
    e = dag(spark, sf)
    return GR.leaf_descendants(e, E.roots(e))


PARTB_STARTS_SQL = "SELECT 'p' || p_partkey AS node FROM part WHERE p_size = 1"


def part_brand(spark, sf):
    e = store(b.part_brand_edges(spark, sf))
    return e, part_starts(spark, sf).select(F.concat(F.lit("p"), F.col("node").cast("string")).alias("node"))


@register("g22_leaf_descendants_cyclic", bfs_sql(b.PARTB_SQL, PARTB_STARTS_SQL, per_start=False) +
          " SELECT node FROM bfs WHERE level > 0 AND node NOT IN (SELECT src FROM e)")
def g22(spark, sf):
    return GR.leaf_descendants(*part_brand(spark, sf), per_start=False)


@register("g22_event_leaf_descendants", bfs_sql(CYC, roots_sql(CYC)) +
          " SELECT start, node FROM bfs WHERE level > 0 AND node NOT IN (SELECT src FROM e)")
def g22e(spark, sf):
    e = cyc(spark, sf)
    return GR.leaf_descendants(e, E.roots(e))


@register("g11_hub_descendants", bfs_sql(b.PART_SQL, PART_STARTS_SQL, per_start=False) + """,
od AS (SELECT src AS node, count(*) AS out_degree FROM e GROUP BY 1)
SELECT bfs.node AS node, od.out_degree AS out_degree FROM bfs JOIN od ON bfs.node = od.node
WHERE level > 0 AND od.out_degree > 10""")
def g11(spark, sf):
    return GR.hub_descendants(part(spark, sf), part_starts(spark, sf), 10, per_start=False)


@register("g11_lineage_hub_descendants", bfs_sql(DAG, roots_sql(DAG)) + """,
od AS (SELECT src AS node, count(*) AS out_degree FROM e GROUP BY 1)
SELECT start, bfs.node AS node, od.out_degree AS out_degree FROM bfs JOIN od ON bfs.node = od.node
WHERE level > 0 AND od.out_degree > 10""")
def g11l(spark, sf):
    """Hubs below every root of the whole lineage."""
    e = dag(spark, sf)
    return GR.hub_descendants(e, E.roots(e), 10).select("start", "node", "out_degree")


@register("g12_bfs_levels_to_target", bfs_sql(DAG, roots_sql(DAG)) + f""",
t AS ({leaves_sql(DAG)}),
stop AS (SELECT start, min(level) AS lv FROM bfs WHERE node IN (SELECT node FROM t) GROUP BY start),
od AS (SELECT src AS node, count(*) AS out_degree FROM e GROUP BY 1)
SELECT bfs.start AS start, bfs.node AS node, level, coalesce(od.out_degree, 0) AS out_degree
FROM bfs LEFT JOIN stop ON bfs.start = stop.start LEFT JOIN od ON bfs.node = od.node
WHERE stop.lv IS NULL OR level <= stop.lv""")
def g12(spark, sf):
    e = dag(spark, sf)
    return GR.bfs_levels(e, E.roots(e), target=E.leaves(e)).select("start", "node", "level", "out_degree")


@register("g12_part_bfs_levels", bfs_sql(b.PART_SQL, PART_STARTS_SQL, per_start=False) + """,
od AS (SELECT src AS node, count(*) AS out_degree FROM e GROUP BY 1)
SELECT level, count(*) AS nodes, CAST(sum(od.out_degree) AS BIGINT) AS out_edges
FROM bfs LEFT JOIN od ON bfs.node = od.node GROUP BY level""")
def g12p(spark, sf):
    e = part(spark, sf)
    r = GR.reach(e, part_starts(spark, sf), per_start=False)
    od = E.out_degrees(e)
    return r.join(od, "node", "left").groupBy("level").agg(F.count(F.lit(1)).alias("nodes"),
                                                           F.sum("out_degree").cast("long").alias("out_edges"))


@register("g13_bfs_tree", bfs_sql(DAG, roots_sql(DAG)) + " SELECT start, parent AS src, node AS dst, level FROM bfs WHERE level > 0")
def g13(spark, sf):
    e = dag(spark, sf)
    return GR.bfs_tree(e, E.roots(e))


SKIP_SQL = "SELECT 'n' || n_nationkey AS node FROM nation WHERE n_regionkey = 2"


@register("g14_undirected_reach_skipping", f"""WITH RECURSIVE e0 AS ({DAG}),
u AS (SELECT src, dst FROM e0 UNION SELECT dst, src FROM e0),
ig AS ({SKIP_SQL}),
e AS (SELECT src, dst FROM u WHERE src NOT IN (SELECT node FROM ig) AND dst NOT IN (SELECT node FROM ig)),
s AS (SELECT node FROM ({roots_sql(DAG)}) r WHERE node NOT IN (SELECT node FROM ig)),
r(start, node) AS (SELECT node, node FROM s UNION SELECT r.start, e.dst FROM r JOIN e ON r.node = e.src)
SELECT start, node FROM r""")
def g14(spark, sf):
    e = dag(spark, sf, both=True)
    ig = b.table(spark, sf, "nation").filter(F.col("n_regionkey") == 2) \
          .select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    return GR.reach(E.undirected(e), E.roots(e), ignore=ig).select("start", "node")


@register("g14_components_skipping", f"""WITH RECURSIVE e0 AS ({DAG}), ig AS ({SKIP_SQL}),
n AS (SELECT node FROM ({nodes_sql(DAG)}) z WHERE node NOT IN (SELECT node FROM ig)),
e AS (SELECT src, dst FROM (SELECT src, dst FROM e0 UNION SELECT dst, src FROM e0) u
      WHERE src NOT IN (SELECT node FROM ig) AND dst NOT IN (SELECT node FROM ig)),
cc(node, component) USING KEY (node) AS (
  SELECT node, node FROM n
  UNION
  SELECT e.dst, min(cc.component) FROM cc JOIN e ON cc.node = e.src JOIN recurring.cc v ON v.node = e.dst
  WHERE cc.component < v.component GROUP BY e.dst)
SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM cc""")
def g14c(spark, sf):
    """Component membership without the skipped nodes: a row a node."""
    ig = b.table(spark, sf, "nation").filter(F.col("n_regionkey") == 2) \
          .select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    return GK.connected_components(dag(spark, sf), ignore=ig)


@register("g15_lineage_edges_from_suffix", f"""WITH RECURSIVE e AS ({DAG}),
first AS (SELECT min(node) AS node FROM ({nodes_sql(DAG)}) n WHERE CAST(node AS VARCHAR) LIKE '%3'),
r(node) AS (SELECT node FROM first WHERE node IS NOT NULL UNION SELECT e.dst FROM r JOIN e ON r.node = e.src)
SELECT DISTINCT src, dst FROM e WHERE src IN (SELECT node FROM r)""")
def g15(spark, sf):
    return GR.lineage_edges(dag(spark, sf), "3")


# ------------------------------------------------------------------ paths

def _leaf_paths_out(p):
    return p.select("start", path_text("path").alias("path_text"), "levels")


@register("g16_leaf_paths", walks_sql(DAG, roots_sql(DAG)) +
          f" SELECT start, {ptext('path')} AS path_text, CAST(len(path) - 1 AS INTEGER) AS levels FROM w WHERE last NOT IN (SELECT src FROM e)")
def g16(spark, sf):
    e = dag(spark, sf)
    return _leaf_paths_out(GP.leaf_paths(e, E.roots(e)))


@register("g17_leaf_paths_all_starts", walks_sql(DAG, nodes_sql(DAG)) +
          f" SELECT start, {ptext('path')} AS path_text, CAST(len(path) - 1 AS INTEGER) AS levels FROM w WHERE last NOT IN (SELECT src FROM e)")
def g17(spark, sf):
    return _leaf_paths_out(GP.leaf_paths(b.lineage_rows(spark, sf)))


@register("g16_leaf_paths_cyclic", walks_sql(CYC, roots_sql(CYC)) +
          f" SELECT start, {ptext('path')} AS path_text, CAST(len(path) - 1 AS INTEGER) AS levels FROM w WHERE last NOT IN (SELECT src FROM e)")
def g16c(spark, sf):
    e = cyc(spark, sf)
    return _leaf_paths_out(GP.leaf_paths(e, E.roots(e)))


JOIN_POINTS = "SELECT dst AS node FROM e GROUP BY dst HAVING count(*) >= 2"


@register("g18_paths_between", walks_sql(DAG, roots_sql(DAG), stop=JOIN_POINTS) +
          f" SELECT start, {ptext('path')} AS path_text, CAST(len(path) - 1 AS INTEGER) AS levels FROM w"
          f" WHERE len(path) > 1 AND last IN ({JOIN_POINTS})")
def g18(spark, sf):
    e = dag(spark, sf)
    ends = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("node")
    return _leaf_paths_out(GP.paths_between(e, E.roots(e), ends))


@register("g19_prefix_walks", walks_sql(DAG, roots_sql(DAG), guard=False) +
          f" SELECT start, {ptext('path')} AS path_text, CAST(len(path) - 1 AS INTEGER) AS depth FROM w")
def g19(spark, sf):
    e = dag(spark, sf)
    return GP.prefix_walks(e, E.roots(e)).select("start", path_text("path").alias("path_text"), F.col("levels").alias("depth"))


REPORT_LEVELS = 10


@register("g20_path_report", walks_sql(DAG, roots_sql(DAG)) + f""" SELECT {ptext('path')} AS path_text,
  CAST(len(path) - 1 AS INTEGER) AS n_levels, CAST(path[1] AS VARCHAR) AS path_start, CAST(path[-1] AS VARCHAR) AS path_end,
  {', '.join(f'CAST(path[{i + 1}] AS VARCHAR) AS level_{i + 1}' for i in range(REPORT_LEVELS))},
  len(path) > {REPORT_LEVELS} AS overflow FROM w WHERE last NOT IN (SELECT src FROM e)""")
def g20(spark, sf):
    e = dag(spark, sf)
    rep = GP.path_report(GP.leaf_paths(e, E.roots(e)), REPORT_LEVELS)
    return rep.select("path_text", "n_levels", "path_start", "path_end",
                      *[f"level_{i + 1}" for i in range(REPORT_LEVELS)], "overflow")


@register("g21_path_details", walks_sql(DAG, roots_sql(DAG)) + f""",
lp AS (SELECT {ptext('path')} AS path_text, path FROM w WHERE last NOT IN (SELECT src FROM e)),
cnt AS (SELECT 'l' || l_orderkey || '-' || l_linenumber AS src, 'p' || l_partkey AS dst, min(CAST(l_quantity AS BIGINT)) AS n
        FROM lineitem GROUP BY 1, 2),
x AS (SELECT path_text, i, path[i] AS node, path[i + 1] AS nxt, len(path) AS k FROM lp, unnest(generate_series(1, len(path))) AS t(i))
SELECT path_text, string_agg(n.n_name, '|' ORDER BY i) AS n_name_levels,
  string_agg(coalesce(CAST(c.n AS VARCHAR), ''), ' -> ' ORDER BY i) FILTER (WHERE i < k) AS n_hops
FROM x LEFT JOIN nation n ON x.node = 'n' || n.n_nationkey LEFT JOIN cnt c ON x.node = c.src AND x.nxt = c.dst
GROUP BY path_text""")
def g21(spark, sf):
    e = dag(spark, sf)
    li = b.table(spark, sf, "lineitem")
    attrs = li.select(F.concat(F.lit("l"), F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("src"),
                      F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.col("l_quantity").cast("long").alias("n"))
    lp = GP.leaf_paths(e, E.roots(e), notes=store(GP.node_notes(nation_names(spark, sf), ("n_name",))), hop_notes=GP.hop_notes(attrs, "n"))
    d = GP.path_details(lp.withColumn("path_text", path_text("path")), "path_text", detail_cols=("n_name",), attr="n")
    return d.select("path_text", F.array_join("n_name_levels", "|").alias("n_name_levels"), "n_hops")


MODEL_NODES = "SELECT dst AS node FROM e GROUP BY dst HAVING count(*) >= 2"


@register("g33_compress_at_models", walks_sql(DAG, roots_sql(DAG)) + f""",
lp AS (SELECT {ptext('path')} AS path_id, path FROM w WHERE last NOT IN (SELECT src FROM e)),
mn AS ({MODEL_NODES}),
rp AS (SELECT path_id, string_agg(CASE WHEN mn.node IS NOT NULL THEN 'm' || lpad(regexp_extract(x.node, '([0-9]+)$', 1), CAST(greatest(4, length(regexp_extract(x.node, '([0-9]+)$', 1))) AS INTEGER), '0')
          ELSE x.node END, '|' ORDER BY i) AS full_lineage
       FROM (SELECT path_id, i, path[i] AS node FROM lp, unnest(generate_series(1, len(path))) AS t(i)) x
       LEFT JOIN mn ON x.node = mn.node GROUP BY path_id),
lv AS (SELECT path_id, full_lineage, string_split(full_lineage, '|') AS lv FROM rp),
ps AS (SELECT *, list_filter(list_transform(generate_series(1, len(lv)),
          lambda i: CASE WHEN regexp_matches(lv[i], 'm\\d{{4,}}') THEN i END), lambda p: p IS NOT NULL) AS pos FROM lv),
sg AS (SELECT path_id, CASE WHEN len(pos) = 0 THEN [{{'segment': full_lineage, 'idx_from': 1, 'idx_to': len(lv)}}]
  ELSE list_concat(
    [{{'segment': array_to_string(lv[1:pos[1]], '|'), 'idx_from': 1, 'idx_to': pos[1]}}],
    list_transform(generate_series(1, len(pos) - 1), lambda j: {{'segment': lv[pos[j]] || '|' || lv[pos[j + 1]],
                   'idx_from': pos[j], 'idx_to': pos[j + 1]}}),
    [{{'segment': array_to_string(lv[pos[-1]:len(lv)], '|'), 'idx_from': pos[-1], 'idx_to': len(lv)}}]) END AS segs
  FROM ps)
SELECT path_id, CAST(seg AS INTEGER) AS seg, s.segment AS segment, CAST(s.idx_from AS INTEGER) AS idx_from,
  CAST(s.idx_to AS INTEGER) AS idx_to
FROM (SELECT path_id, generate_subscripts(segs, 1) AS seg, unnest(segs) AS s FROM sg) q""")
def g33(spark, sf):
    e = dag(spark, sf)
    mn = store(e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("k")).filter("k >= 2").select("node"))
    # a path takes along which of its nodes are models: nothing is regrouped
    lp = GP.leaf_paths(e, E.roots(e), notes=mn.withColumn("note", F.lit(True)))

    def token(node, i):
        number = F.regexp_extract(node, "([0-9]+)$", 1)
        model = F.concat(F.lit("m"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number))
        return F.when(F.get("notes", i), model).otherwise(node)

    rp = lp.select(path_text("path").alias("path_id"), F.array_join(F.transform("path", token), "|").alias("full_lineage"))
    return GP.compress_at_models(rp, "full_lineage").select("path_id", "seg", "segment", "idx_from", "idx_to")


@register("g34_path_counts", walks_sql(DAG, roots_sql(DAG)) + """
SELECT start, count(*) AS walks, count(*) FILTER (WHERE last NOT IN (SELECT src FROM e)) AS leaf_paths
FROM w GROUP BY start""")
def g34(spark, sf):
    e = dag(spark, sf, both=True)
    c = GP.path_counts(e, E.roots(e))
    return c.select("start", F.col("walks").cast("long").alias("walks"), F.col("leaf_paths").cast("long").alias("leaf_paths"))


@register("g34_path_counts_all_nodes", walks_sql(DAG, nodes_sql(DAG)) + """
SELECT start, count(*) AS walks, count(*) FILTER (WHERE last NOT IN (SELECT src FROM e)) AS leaf_paths
FROM w GROUP BY start""")
def g34a(spark, sf):
    c = GP.path_counts(dag(spark, sf))
    return c.select("start", F.col("walks").cast("long").alias("walks"), F.col("leaf_paths").cast("long").alias("leaf_paths"))


# ------------------------------------------------------------------ shortest

@register("g23_shortest_paths", bfs_sql(DAG, roots_sql(DAG)) +
          " SELECT start, node AS leaf_node, path, level AS path_length FROM bfs"
          " WHERE level > 0 AND node NOT IN (SELECT src FROM e)")
def g23(spark, sf):
    e = dag(spark, sf)
    return GS.shortest_paths(e, E.roots(e))


@register("g23_shortest_paths_by_enumeration", walks_sql(DAG, roots_sql(DAG)) + f""",
ranked AS (SELECT start, last AS leaf_node, {ptext('path')} AS path, CAST(len(path) - 1 AS INTEGER) AS path_length,
  row_number() OVER (PARTITION BY start, last ORDER BY len(path), {ptext('path')}) AS rn
  FROM w WHERE len(path) > 1 AND last NOT IN (SELECT src FROM e))
SELECT start, leaf_node, path, path_length FROM ranked WHERE rn = 1""")
def g23e(spark, sf):
    """The reference's formulation: all simple paths, then the first per start and leaf."""
    e = dag(spark, sf)
    p = GP.leaf_paths(e, E.roots(e)).filter("levels > 0").select(
        "start", F.element_at("path", -1).alias("leaf_node"), path_text("path").alias("path"), F.col("levels").alias("path_length"))
    first = F.min(F.struct("path_length", "path")).alias("m")
    return p.groupBy("start", "leaf_node").agg(first).select("start", "leaf_node", "m.path", "m.path_length")


@register("g24_shortest_paths_cap", bfs_sql(DAG, f"SELECT node FROM ({nodes_sql(DAG)}) z WHERE node LIKE 'r%' OR node LIKE 'n%'") +
          " SELECT start, node AS leaf_node, path, level AS path_length FROM bfs"
          " WHERE level > 0 AND level <= 4 AND node NOT IN (SELECT src FROM e)")
def g24(spark, sf):
    """Starts are regions and nations: with four edges the nations reach parts, the regions do not."""
    e = dag(spark, sf)
    starts = E.nodes_of(e).filter(F.col("node").rlike("^[rn]"))
    return GS.shortest_paths(e, starts, max_level=4)


REV_DAG = f"SELECT dst AS src, src AS dst FROM ({DAG}) r"


@register("g25_reverse_shortest_paths", bfs_sql(REV_DAG, leaves_sql(DAG)) +
          " SELECT start, node AS leaf_node, path, level AS path_length FROM bfs"
          " WHERE level > 0 AND node NOT IN (SELECT src FROM e)")
def g25(spark, sf):
    e = dag(spark, sf)
    return GS.shortest_paths(e, E.leaves(e), reverse=True)


@register("g23_part_shortest_paths", f"""WITH RECURSIVE e AS ({b.PARTB_SQL}), t AS ({leaves_sql('SELECT * FROM e')}),
bfs(leaf, node, level, path) USING KEY (leaf, node) AS (
  SELECT node, node, 0, node FROM t
  UNION
  SELECT b.leaf, e.src, min(b.level) + 1, e.src || ' -> ' || min(b.path) FROM bfs b JOIN e ON b.node = e.dst
  WHERE NOT EXISTS (SELECT 1 FROM recurring.bfs v WHERE v.leaf = b.leaf AND v.node = e.src)
  GROUP BY b.leaf, e.src)
SELECT node AS start, leaf AS leaf_node, path, level AS path_length FROM bfs
WHERE level > 0 AND node IN ({PARTB_STARTS_SQL})""")
def g23p(spark, sf):
    e, starts = part_brand(spark, sf)
    return GS.shortest_paths_to(e, starts, E.leaves(e))


# ------------------------------------------------------------------ cycles

CORE_SQL = f"""WITH RECURSIVE e AS ({CYC}),
r(s, n) AS (SELECT src, dst FROM e UNION SELECT r.s, e.dst FROM r JOIN e ON r.n = e.src),
cyc AS (SELECT DISTINCT s AS x FROM r WHERE s = n),
fwd AS (SELECT x FROM cyc UNION SELECT r.n FROM r JOIN cyc ON r.s = cyc.x),
bwd AS (SELECT x FROM cyc UNION SELECT r.s FROM r JOIN cyc ON r.n = cyc.x),
core AS (SELECT DISTINCT src, dst FROM e WHERE src IN (SELECT x FROM fwd) AND dst IN (SELECT x FROM bwd))"""


@register("g26_cycle_core", CORE_SQL + " SELECT src, dst FROM core")
def g26(spark, sf):
    return GC.cycle_core(cyc(spark, sf))


@register("g26_one_cycle", CORE_SQL + """,
f AS (SELECT src AS node, min(dst) AS nxt FROM core GROUP BY src),
fw(s, n, k) AS (SELECT node, nxt, 1 FROM f UNION SELECT fw.s, f.nxt, fw.k + 1 FROM fw JOIN f ON fw.n = f.node
               WHERE fw.k < (SELECT count(*) FROM f)),
oncyc AS (SELECT DISTINCT s AS node FROM fw WHERE s = n),
anchor AS (SELECT min(node) AS node FROM oncyc),
walk(node, pos) USING KEY (node) AS (SELECT node, 0 FROM anchor
   UNION SELECT f.nxt, min(walk.pos) + 1 FROM walk JOIN f ON walk.node = f.node
   WHERE f.nxt NOT IN (SELECT node FROM recurring.walk) GROUP BY f.nxt)
SELECT walk.node AS src, f.nxt AS dst, pos FROM walk JOIN f ON walk.node = f.node""")
def g26w(spark, sf):
    return GC.one_cycle(cyc(spark, sf))


def strong_sql(e: str) -> str:
    """Mutual reachability."""
    return f"""WITH RECURSIVE e AS ({e}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
r(s, t) AS (SELECT node, node FROM n UNION SELECT r.s, e.dst FROM r JOIN e ON r.t = e.src),
m AS (SELECT a.s AS node, a.t AS other FROM r a JOIN r z ON a.s = z.t AND a.t = z.s)
SELECT node, min(other) AS component, count(*) AS size FROM m GROUP BY node"""


@register("g26_strong_components", strong_sql(CYC))
def g26s(spark, sf):
    return GK.strong_components(cyc(spark, sf))


@register("g26_part_strong_components", strong_sql(b.PARTB_SQL))
def g26p(spark, sf):
    """Parts and brands of the whole part graph."""
    return GK.strong_components(store(b.part_brand_edges(spark, sf)))


@register("g28_has_cycle", """SELECT 'lineage' AS graph, false AS has_cycle UNION ALL SELECT 'events', """
          f"""(SELECT count(*) > 0 FROM ({CORE_SQL} SELECT * FROM core) c)""")
def g28(spark, sf):
    rows = [("lineage", GC.has_cycle(dag(spark, sf))), ("events", GC.has_cycle(cyc(spark, sf)))]
    return spark.createDataFrame(rows, "graph string, has_cycle boolean")


@register("g27_simple_cycles", CORE_SQL + f""",
s AS (SELECT DISTINCT src AS node FROM core),
w(start, last, path) AS (SELECT node, node, [node] FROM s
  UNION ALL SELECT w.start, c.dst, list_append(w.path, c.dst) FROM w JOIN core c ON w.last = c.src
  WHERE c.dst > w.start AND NOT list_contains(w.path, c.dst))
SELECT {ptext('w.path')} || ' -> ' || CAST(w.start AS VARCHAR) AS cycle, CAST(len(w.path) AS INTEGER) AS length
FROM w JOIN core c ON w.last = c.src AND c.dst = w.start""")
def g27(spark, sf):
    return GC.simple_cycles(cyc(spark, sf))


# ------------------------------------------------------------------ algebra

REGION01 = "SELECT 'n' || n_nationkey AS node FROM nation WHERE n_regionkey IN (0, 1) UNION ALL SELECT 'c' || c_custkey FROM customer"


@register("g29_induced_subgraph", f"""SELECT src, dst FROM ({DAG}) e
WHERE src IN ({REGION01}) AND dst IN ({REGION01})""")
def g29(spark, sf):
    n = b.table(spark, sf, "nation").filter(F.col("n_regionkey").isin(0, 1))
    nodes = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node")).unionByName(
        b.table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node")))
    return GA.induced(dag(spark, sf), nodes)


@register("g30_induced_reach_subgraph", bfs_sql(DAG, roots_sql(DAG)) + """
SELECT a.start AS start, e.src AS src, e.dst AS dst FROM e JOIN bfs a ON e.src = a.node
JOIN bfs z ON e.dst = z.node AND z.start = a.start""")
def g30(spark, sf):
    e = dag(spark, sf)
    r = GR.reach(e, E.roots(e))
    return GA.induced(e, r.select("start", "node"), by=["start"])


@register("g31_merge_graphs", f"""WITH c AS ({b.FLOW_BASE_SQL}),
g1 AS (SELECT src, dst, n AS w FROM c WHERE src <= dst),
g2 AS (SELECT src, dst, CASE WHEN n % 2 = 0 THEN n * 2 END AS w FROM c WHERE src >= dst)
SELECT coalesce(g1.src, g2.src) AS src, coalesce(g1.dst, g2.dst) AS dst,
  CASE WHEN g2.src IS NOT NULL THEN g2.w ELSE g1.w END AS w
FROM g1 FULL JOIN g2 ON g1.src = g2.src AND g1.dst = g2.dst""")
def g31(spark, sf):
    """Both orders of all nation pairs; they meet on the diagonal, where the second graph's nulls win, too."""
    c = cut_lineage(b.flow_counts(spark, sf))
    g1 = c.filter("src <= dst").select("src", "dst", F.col("n").alias("w"))
    g2 = c.filter("src >= dst").select("src", "dst", F.when(F.col("n") % 2 == 0, F.col("n") * 2).alias("w"))
    return GA.merge_graphs(g1, g2, attrs=["w"])


@register("g32_disjoint", f"""SELECT count(*) AS shared_nodes, count(*) = 0 AS disjoint FROM (
  SELECT DISTINCT src FROM ({DAG}) a WHERE src IN (SELECT dst FROM ({DAG}) z)) x""")
def g32(spark, sf):
    e = dag(spark, sf)
    return GA.disjoint(e.select(F.col("src").alias("node")), e.select(F.col("dst").alias("node")))


# ------------------------------------------------------------------ J3 in SQL

@register("j3_recursive_cte_walks", walks_sql(CYC, roots_sql(CYC)) +
          f" SELECT start, {ptext('path')} AS path_text, CAST(len(path) - 1 AS INTEGER) AS depth FROM w")
def j3(spark, sf):
    """J3 as Spark SQL ``WITH RECURSIVE`` (UNION ALL cannot deduplicate visited
    nodes, and Spark bounds the recursion's levels and rows, so this form is for
    small path problems: the event graph; the DataFrame loops are the scalable form."""
    e = cyc(spark, sf)
    view = f"event_graph_{abs(hash(sf)) % 10**8}"
    e.createOrReplaceTempView(view)
    return spark.sql(f"""
        WITH RECURSIVE w(start, last, path) AS (
          SELECT src, src, array(src) FROM (SELECT DISTINCT src FROM {view} a
                                            LEFT ANTI JOIN {view} b ON a.src = b.dst)
          UNION ALL
          SELECT w.start, e.dst, array_append(w.path, e.dst) FROM w JOIN {view} e ON w.last = e.src
          WHERE NOT array_contains(w.path, e.dst))
        SELECT start, array_join(transform(path, x -> CAST(x AS STRING)), ' -> ') AS path_text,
               size(path) - 1 AS depth FROM w""")


@register("j3_walks_to_fixpoint", walks_sql(CYC, roots_sql(CYC)) +
          f" SELECT start, {ptext('path')} AS path_text, CAST(len(path) - 1 AS INTEGER) AS depth FROM w")
def j3f(spark, sf):
    """J3 as a DataFrame loop to its fixpoint: no bound on levels or rows."""
    e = cyc(spark, sf)
    w = walk_paths(e, E.roots(e), guard="path", emit="all")
    return w.select("start", path_text("path").alias("path_text"), F.col("levels").alias("depth"))
