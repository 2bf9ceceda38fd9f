"""Registered quality / reconciliation / join queries.

The quality frame is a wide "path report" built from whole tables: one row per
four line numbers of an order, ``level_i`` / ``bus_Elem_i`` / ``pde_Elem_i`` /
``trans_i`` from the ``i``-th of them, null where the order lacks that line.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spindle.operators import quality as q
from spindle.plans import bindings as b
from spindle.plans.registry import r4, register

WIDTH = 4  # line numbers of a row; every line lands in one


def quality_frame(spark, sf):
    li = b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                               "l_returnflag", "l_linestatus")
    slot, block = F.pmod(F.col("l_linenumber") - 1, F.lit(WIDTH)) + 1, F.floor((F.col("l_linenumber") - 1) / WIDTH)
    aggs = []
    for i in range(1, WIDTH + 1):
        on = slot == i
        aggs += [F.min(F.when(on, F.col("l_partkey"))).alias(f"level{i}"),
                 F.min(F.when(on, F.col("l_suppkey"))).alias(f"bus_Elem{i}"),
                 F.max(F.when(on, F.col("l_suppkey"))).alias(f"pde_Elem{i}")]
    aggs += [F.max(F.when(slot == 1, F.col("l_returnflag"))).alias("trans1"),
             F.max(F.when(slot == 2, F.col("l_linestatus"))).alias("trans2")]
    return li.groupBy("l_orderkey", block.alias("block")).agg(*aggs).drop("block")


def _qf_sql() -> str:
    parts, slot = [], f"((l_linenumber - 1) % {WIDTH} + 1)"
    for i in range(1, WIDTH + 1):
        parts += [f"min(CASE WHEN {slot} = {i} THEN l_partkey END) AS level{i}",
                  f"min(CASE WHEN {slot} = {i} THEN l_suppkey END) AS bus_Elem{i}",
                  f"max(CASE WHEN {slot} = {i} THEN l_suppkey END) AS pde_Elem{i}"]
    parts += [f"max(CASE WHEN {slot} = 1 THEN l_returnflag END) AS trans1",
              f"max(CASE WHEN {slot} = 2 THEN l_linestatus END) AS trans2"]
    return f"SELECT l_orderkey, {', '.join(parts)} FROM lineitem GROUP BY l_orderkey, (l_linenumber - 1) // {WIDTH}"


QF = _qf_sql()
BUS = [f"bus_Elem{i}" for i in range(1, WIDTH + 1)]
PDE = [f"pde_Elem{i}" for i in range(1, WIDTH + 1)]
DOMAIN = ("A", "R")
R1 = q.Rule("r1_bus_not_null", "not_null", tuple(BUS))
R3 = q.Rule("r3_trans1_domain", "in_list", ("trans1",), DOMAIN)
R4 = q.Rule("r4_bus_pde_match", "pair_match", tuple(BUS), other=tuple(PDE))


def _r5():
    cond = (F.col("trans1") == "R") & ((F.col("trans2") == "F") | (F.col("level2") < F.col("level1")))
    return q.Rule("r5_level4_when", "cond_not_null", ("level4",), when=cond)


def _sum(exprs):
    return " + ".join(exprs)


R1_SQL = (f"SELECT 'r1_bus_not_null' AS rule, CAST({_sum(f'count({c})' for c in BUS)} AS BIGINT) AS pass_count, "
          f"CAST({_sum(f'count(*) - count({c})' for c in BUS)} AS BIGINT) AS fail_count FROM ({QF}) qf")
R3_SQL = (f"SELECT 'r3_trans1_domain' AS rule, CAST(count_if(coalesce(trans1 IN ('A', 'R'), false)) AS BIGINT) AS pass_count, "
          f"CAST(count_if(NOT coalesce(trans1 IN ('A', 'R'), false)) AS BIGINT) AS fail_count FROM ({QF}) qf")
R4_SQL = (f"SELECT 'r4_bus_pde_match' AS rule, "
          f"CAST({_sum(f'count_if(coalesce({a} = {p}, false))' for a, p in zip(BUS, PDE))} AS BIGINT) AS pass_count, "
          f"CAST({_sum(f'count_if(NOT coalesce({a} = {p}, false))' for a, p in zip(BUS, PDE))} AS BIGINT) AS fail_count "
          f"FROM ({QF}) qf")
R5_COND = "coalesce(trans1 = 'R' AND (trans2 = 'F' OR level2 < level1), false)"
R5_SQL = (f"SELECT 'r5_level4_when' AS rule, CAST(count_if({R5_COND} AND level4 IS NOT NULL) AS BIGINT) AS pass_count, "
          f"CAST(count_if({R5_COND} AND level4 IS NULL) AS BIGINT) AS fail_count FROM ({QF}) qf")


@register("d1_not_null_family", R1_SQL)
def d1(spark, sf):
    return q.check(quality_frame(spark, sf), [R1])


@register("a9_null_totals", f"""SELECT CAST({_sum(f'count(*) - count({c})' for c in BUS)} AS BIGINT) AS null_cells,
  CAST({_sum(f'count({c})' for c in BUS)} AS BIGINT) AS non_null_cells FROM ({QF}) qf""")
def a9(spark, sf):
    from spindle.operators.inventory import null_counts
    return null_counts(quality_frame(spark, sf), "bus_Elem")


@register("d2_fill_missing", f"""SELECT l_orderkey, coalesce(trans1, 'Not Applicable') AS trans1,
  coalesce(trans2, 'Not Applicable') AS trans2 FROM ({QF}) qf""")
def d2(spark, sf):
    return q.fill_missing(quality_frame(spark, sf), "trans").select("l_orderkey", "trans1", "trans2")


@register("d3_domain_rule", R3_SQL)
def d3(spark, sf):
    return q.check(quality_frame(spark, sf), [R3])


@register("d4_pair_rule", R4_SQL)
def d4(spark, sf):
    return q.check(quality_frame(spark, sf), [R4])


@register("d5_conditional_not_null", R5_SQL)
def d5(spark, sf):
    return q.check(quality_frame(spark, sf), [_r5()])


@register("d1_d5_all_rules_one_pass", "\nUNION ALL\n".join([R1_SQL, R3_SQL, R4_SQL, R5_SQL]))
def d_all(spark, sf):
    return q.check(quality_frame(spark, sf), [R1, R3, R4, _r5()])


SMALL_PARTS = "SELECT p_partkey FROM part WHERE p_size <= 5"
META_SQL = """SELECT DISTINCT elem, elem_ait, elem_col FROM (
  SELECT l_partkey AS elem, l_returnflag AS elem_ait, l_linenumber AS elem_col FROM lineitem
  UNION ALL SELECT l_suppkey, l_linestatus, l_linenumber FROM lineitem) u"""


def _meta(spark, sf):
    li = b.table(spark, sf, "lineitem")
    return q.element_metadata(li, [{"l_partkey": "elem", "l_returnflag": "elem_ait", "l_linenumber": "elem_col"},
                                   {"l_suppkey": "elem", "l_linestatus": "elem_ait", "l_linenumber": "elem_col"}])


def _small_parts(spark, sf):
    return b.table(spark, sf, "part").filter(F.col("p_size") <= 5).select("p_partkey")


@register("u2_element_metadata", META_SQL)
def u2(spark, sf):
    return _meta(spark, sf)


@register("d6_membership_flag", f"""SELECT elem, elem_ait, elem_col,
  CASE WHEN elem IN ({SMALL_PARTS}) THEN 'Yes' ELSE 'No' END AS matched_or_not FROM ({META_SQL}) m""")
def d6(spark, sf):
    return q.flag_member(_meta(spark, sf), "elem", _small_parts(spark, sf))


@register("d6_membership_flag_list", f"""SELECT elem, elem_ait, elem_col,
  CASE WHEN elem IN (1, 2, 3) THEN 'Yes' ELSE 'No' END AS matched_or_not FROM ({META_SQL}) m""")
def d6l(spark, sf):
    return q.flag_member(_meta(spark, sf), "elem", [1, 2, 3])


@register("d7_first_match_column", f"""SELECT l_orderkey, l_linenumber,
  CASE WHEN l_partkey IN ({SMALL_PARTS}) THEN 'l_partkey' WHEN l_suppkey IN ({SMALL_PARTS}) THEN 'l_suppkey'
  ELSE NULL END AS match_src FROM lineitem""")
def d7(spark, sf):
    li = b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return q.first_match(li, ["l_partkey", "l_suppkey"], _small_parts(spark, sf)) \
            .select("l_orderkey", "l_linenumber", "match_src")


@register("u3_reconcile_summary", f"""
WITH v AS (SELECT DISTINCT p_partkey AS value FROM part WHERE p_size <= 5),
pool AS (SELECT l_partkey AS value FROM lineitem UNION SELECT l_suppkey FROM lineitem),
flags AS (SELECT CASE WHEN l_partkey IN (SELECT value FROM v) THEN 'l_partkey'
                      WHEN l_suppkey IN (SELECT value FROM v) THEN 'l_suppkey' END AS m FROM lineitem)
SELECT 'matches_' || m AS metric, count(*) AS n FROM flags WHERE m IS NOT NULL GROUP BY m
UNION ALL
SELECT CASE WHEN value IN (SELECT value FROM pool) THEN 'matched_inputs' ELSE 'unmatched_inputs' END AS metric,
       count(*) AS n FROM v GROUP BY 1""")
def u3(spark, sf):
    li = b.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    _, summary = q.reconcile(li, ["l_partkey", "l_suppkey"], _small_parts(spark, sf))
    return summary


@register("u3_reconcile_per_value", """
SELECT DISTINCT p_partkey AS value, p_partkey IN (SELECT l_partkey FROM lineitem UNION SELECT l_suppkey FROM lineitem)
  AS matched FROM part WHERE p_size <= 5""")
def u3v(spark, sf):
    li = b.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    per_value, _ = q.reconcile(li, ["l_partkey", "l_suppkey"], _small_parts(spark, sf))
    return per_value


@register("u1_union_all", """SELECT c_nationkey AS nationkey, 'customer' AS side FROM customer
UNION ALL SELECT s_nationkey, 'supplier' FROM supplier""")
def u1(spark, sf):
    c = b.table(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey"), F.lit("customer").alias("side"))
    s = b.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.lit("supplier").alias("side"))
    return c.unionByName(s)


@register("d8_drop_null_rows", f"SELECT * FROM ({QF}) qf WHERE {' AND '.join(f'level{i} IS NOT NULL' for i in range(1, WIDTH + 1))} "
          f"AND {' AND '.join(f'bus_Elem{i} IS NOT NULL AND pde_Elem{i} IS NOT NULL' for i in range(1, WIDTH + 1))} "
          "AND trans1 IS NOT NULL AND trans2 IS NOT NULL")
def d8(spark, sf):
    return quality_frame(spark, sf).na.drop()


@register("c2_mask_columns", """SELECT c_custkey, sha256(c_name) AS c_name_sha256, to_base64(encode(c_name)) AS c_name_b64,
  decode(from_base64(to_base64(encode(c_name)))) = c_name AS roundtrip_ok FROM customer""")
def c2(spark, sf):
    cu = b.table(spark, sf, "customer").select("c_custkey", "c_name")
    m = q.mask(cu, {"c_name": "sha256"})
    m = q.mask(m, {"c_name": "base64"})
    return m.select("c_custkey", "c_name_sha256", "c_name_b64",
                    (q.unmask_base64("c_name_b64") == F.col("c_name")).alias("roundtrip_ok"))


@register("c1_string_scalars", """SELECT p_partkey, string_split(p_type, ' ')[-1] AS last_word,
  array_to_string(string_split(p_type, ' '), '|') AS joined, replace(p_name, ' ', '_') AS replaced,
  ends_with(p_brand, '1') AS ends1, starts_with(p_type, 'PROMO') AS promo, contains(p_name, 'green') AS has_green,
  regexp_matches(p_name, '^[a-m]') AS first_half, p_brand || '~' || p_type AS concatenated FROM part""")
def c1(spark, sf):
    p = b.table(spark, sf, "part")
    return p.select("p_partkey", F.element_at(F.split("p_type", " "), -1).alias("last_word"),
                    F.array_join(F.split("p_type", " "), "|").alias("joined"),
                    F.replace("p_name", F.lit(" "), F.lit("_")).alias("replaced"),
                    F.col("p_brand").endswith("1").alias("ends1"), F.col("p_type").startswith("PROMO").alias("promo"),
                    F.col("p_name").contains("green").alias("has_green"), F.col("p_name").rlike("^[a-m]").alias("first_half"),
                    F.concat_ws("~", "p_brand", "p_type").alias("concatenated"))


@register("c4_number_scalars", """SELECT l_returnflag, round(sum(l_quantity), 4) AS sum_qty, round(avg(l_extendedprice), 4) AS mean_price,
  round(min(l_discount), 4) AS min_disc, round(max(l_tax), 4) AS max_tax,
  CAST(sum(l_partkey & 7) AS BIGINT) AS sum_low_bits FROM lineitem GROUP BY 1""")
def c4(spark, sf):
    li = b.table(spark, sf, "lineitem")
    return li.groupBy("l_returnflag").agg(r4(F.sum("l_quantity")).alias("sum_qty"), r4(F.avg("l_extendedprice")).alias("mean_price"),
                                          r4(F.min("l_discount")).alias("min_disc"), r4(F.max("l_tax")).alias("max_tax"),
                                          F.sum(F.col("l_partkey").bitwiseAND(F.lit(7))).cast("long").alias("sum_low_bits"))


@register("a10_conditional_count", """SELECT CAST(count_if(l_discount > 0.05) AS BIGINT) AS n FROM lineitem""")
def a10(spark, sf):
    from spindle.operators.inventory import count_where
    return count_where(b.table(spark, sf, "lineitem"), F.col("l_discount") > 0.05)


@register("w1_latest_order_per_customer", """SELECT o_custkey, o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) x WHERE rn = 1""")
def w1(spark, sf):
    o = b.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return q.first_row(o, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")]) \
            .select("o_custkey", "o_orderkey", r4("o_totalprice").alias("o_totalprice"))


@register("o1_order_by", """SELECT c_custkey, round(c_acctbal, 4) AS c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey""")
def o1(spark, sf):
    c = b.table(spark, sf, "customer")
    return c.select("c_custkey", r4("c_acctbal").alias("c_acctbal")).orderBy(F.col("c_acctbal").desc(), "c_custkey")


@register("j4_orders_without_lines", """SELECT o_orderkey FROM orders o
  WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)""")
def j4(spark, sf):
    o = b.table(spark, sf, "orders").select("o_orderkey")
    li = b.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(li, "o_orderkey", "left_anti")


@register("j5_customers_with_orders", """SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def j5(spark, sf):
    c = b.table(spark, sf, "customer").select("c_custkey")
    o = b.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi")


@register("j6_lookup_first_detail", """SELECT l.l_orderkey, l.l_linenumber, d.p_name FROM lineitem l LEFT JOIN (
  SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY p_name) AS rn FROM part) x
  WHERE rn = 1) d ON l.l_partkey = d.p_partkey""")
def j6(spark, sf):
    li = b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    p = b.table(spark, sf, "part").select("p_partkey", "p_name")
    return q.lookup_first(li, p, "p_partkey", "p_name", ["p_name"], left_key="l_partkey") \
            .select("l_orderkey", "l_linenumber", "p_name")
