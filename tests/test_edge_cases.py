"""Option paths not exercised by the registered queries."""

from pyspark.sql import functions as F

from spindle.operators import inventory as inv
from spindle.operators import quality as q
from spindle.operators import timeseries as ts
from spindle.operators.graph import paths as GP
from spindle.sources import files as IO


def test_fill_missing_treat_blank(spark):
    df = spark.createDataFrame([(1, None, " "), (2, "x", "")], "id int, trans1 string, trans2 string")
    plain = {r["id"]: (r["trans1"], r["trans2"]) for r in q.fill_missing(df, "trans").collect()}
    blank = {r["id"]: (r["trans1"], r["trans2"]) for r in q.fill_missing(df, "trans", treat_blank=True).collect()}
    assert plain == {1: ("Not Applicable", " "), 2: ("x", "")}
    assert blank == {1: ("Not Applicable", "Not Applicable"), 2: ("x", "Not Applicable")}


def test_compress_custom_pattern_and_root(spark):
    df = spark.createDataFrame([("a|M1|b|M2|c", "root")], "p string, r string")
    rows = GP.compress_at_models(df, "p", "r", pattern=r"^M\d$").orderBy("seg").collect()
    assert [(r["segment"], r["idx_from"], r["idx_to"]) for r in rows] == \
        [("root|a|M1", 1, 2), ("M1|M2", 2, 4), ("M2|c", 4, 5)]


def test_route_first_match_wins(spark):
    df = spark.createDataFrame([("No such file x",), ("Permission denied y",), ("ok z",)], "msg string")
    parts = IO.route(df, {"missing": F.col("msg").contains("No such"), "any_x": F.col("msg").contains("x")})
    assert [r["msg"] for r in parts["missing"].collect()] == ["No such file x"]
    assert parts["any_x"].count() == 0 and parts["other"].count() == 2
    assert sorted(r[0] for r in df.select(IO.error_class("msg")).collect()) == ["denied", "missing", "other"]


def test_age_days_and_unique_ts_unpartitioned(spark):
    df = spark.createDataFrame([(1, 86400 * 10, 86400 * 12)], "id int, mtime long, atime long")
    r = inv.age_days(df, 86400 * 15).collect()[0]
    assert (r["mtime_text"], r["mtime_days"], r["atime_days"]) == ("1970-01-11 00:00:00", 5, 3)
    u = inv.unique_ts(spark.range(5), 100, ["id"]).select("ts_ns").collect()
    assert len({x[0] for x in u}) == 5 and min(x[0] for x in u) >= 100


def test_retention_and_since(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-08 00:00:00",), ("2024-01-09 12:00:00",)], "t string") \
              .select(F.to_timestamp_ntz("t").alias("ts"))
    assert ts.apply_retention(df, "ts", "7 DAYS", "2024-01-10 00:00:00").count() == 2
    assert ts.since(df, "ts", "2024-01-10 00:00:00", "1 DAY").count() == 1
