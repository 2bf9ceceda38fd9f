"""Mergeable rollup states, retention policies, distinct sketches and the forest's node table."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shapes import SF_SMALL
from spindle.operators import forest as M
from spindle.operators import inventory as inv
from spindle.operators import timeseries as ts
from spindle.plans import bindings as b

DAY = dt.datetime(2024, 3, 1)


def points(spark, rows):
    return spark.createDataFrame([(DAY + dt.timedelta(minutes=m), tag, v) for m, tag, v in rows], "ts timestamp_ntz, tag string, value double")


def told(states):
    return {(r["bucket"].hour * 60 + r["bucket"].minute, r["tag"]): (r["sum"], r["count"], r["min"], r["max"], r["mean"]) for r in ts.mean_of(states).collect()}


ROWS = [(1, "a", 2.0), (4, "a", 4.0), (12, "a", -1.0), (59, "a", 8.0), (61, "a", 1.0), (3, None, 5.0), (70, "b", None)]


def test_coarse_states_come_from_fine_ones(spark):
    fine = ts.rollup_states(points(spark, ROWS), "ts", "10 minutes", ["tag"])
    want = {(0, "a"): (13.0, 4, -1.0, 8.0, 3.25), (60, "a"): (1.0, 1, 1.0, 1.0, 1.0), (0, None): (5.0, 1, 5.0, 5.0, 5.0), (60, "b"): (None, 0, None, None, None)}
    assert told(ts.merge_states(fine, ["tag"], "1 hour")) == want == told(ts.rollup_states(points(spark, ROWS), "ts", "1 hour", ["tag"]))


def test_late_points_change_their_buckets_alone(spark):
    stored = ts.rollup_states(points(spark, ROWS), "ts", "10 minutes", ["tag"]).withColumn("sum", F.col("sum") + 0.0)
    late = points(spark, [(2, "a", 100.0), (5, None, 1.0), (200, "c", 7.0)])
    both = told(ts.add_late(stored, late, "ts", "10 minutes", ["tag"]))
    assert both == told(ts.rollup_states(points(spark, ROWS).union(late), "ts", "10 minutes", ["tag"]))
    assert both[(0, "a")][:2] == (106.0, 3) and both[(200, "c")][0] == 7.0 and both[(10, "a")][0] == -1.0


def test_retention_policies_are_altered(spark):
    p = ts.set_policy(spark.createDataFrame([("short", 7)], "name string, days int"), "long", 7)
    p = ts.set_policy(p, "long", 14)
    assert {tuple(r) for r in p.collect()} == {("short", 7), ("long", 14)}
    df = spark.createDataFrame([(i, DAY - dt.timedelta(days=i), ("short", "long", "none")[i % 3]) for i in range(30)], "i int, ts timestamp_ntz, policy string")
    kept = {r["i"] for r in ts.retained(df, "ts", p, "2024-03-01 00:00:00", policy_col="policy").collect()}
    assert kept == {i for i in range(30) if i % 3 == 0 and i <= 7 or i % 3 == 1 and i <= 14}
    assert ts.retained(df, "ts", p, "2024-03-01 00:00:00", policy="short").count() == 8


def test_sketches_united_at_read(spark):
    df = spark.range(60_000).select((F.col("id") % 7).alias("day"), (F.col("id") % 20_000).alias("user"))
    s = inv.distinct_sketches(df, "user", ["day"])
    assert s.count() == 7 and abs(inv.distinct_of_sketches(s).first()["estimate"] - 20_000) < 1000


def test_node_table_scores_like_the_library(spark, tmp_path):
    v = b.vectors(spark, SF_SMALL)
    data = M.features(v, array_col="vec").select("id", "features", F.col("label").cast("double").alias("label"))
    model = M.fit_forest(data, "label", num_trees=7, seed=3)
    nodes = M.tree_table(model, str(tmp_path / "forest"))
    assert nodes.select("tree").distinct().count() == 7 and nodes.filter("feature IS NULL AND left IS NOT NULL").count() == 0
    want = {r["id"]: r["prediction"] for r in model.transform(data).select("id", "prediction").collect()}
    assert {r["id"]: r["prediction"] for r in M.score_by_joins(v, nodes, model.getOrDefault("maxDepth")).collect()} == want
    assert want and pytest.approx(M.accuracy(model.transform(data), "label")) == M.accuracy_df(model.transform(data), "label").first()["accuracy"]
