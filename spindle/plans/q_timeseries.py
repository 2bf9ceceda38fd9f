"""Registered time-series queries (T1-T3, T5, F10, A8) on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindle.operators import timeseries as ts
from spindle.plans import bindings as b
from spindle.plans.registry import r4, register, ts_text
from spindle.session import store

# Fixed as-of instant for relative-time rules (the data covers January 2024).
ASOF = "2024-01-31 00:00:00"


@register("t1_tumbling_10m_mean", """
SELECT strftime(time_bucket(INTERVAL '10 minutes', ts), '%Y-%m-%d %H:%M:%S') AS bucket,
       round(avg(value), 4) AS mean_value
FROM events GROUP BY 1""")
def t1(spark, sf):
    pts = b.event_points(spark, sf)
    out = ts.downsample(pts, "ts", "10 minutes", (), {"mean_value": ("mean", "value")})
    return out.select(ts_text("bucket").alias("bucket"), r4("mean_value").alias("mean_value"))


@register("t2_hourly_by_tag", """
SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS bucket,
       event_type AS tag,
       round(avg(value), 4) AS mean_value, round(min(value), 4) AS min_value,
       round(max(value), 4) AS max_value
FROM events GROUP BY 1, 2""")
def t2(spark, sf):
    pts = b.event_points(spark, sf)
    out = ts.downsample(pts, "ts", "1 hour", ["tag"], {
        "mean_value": ("mean", "value"), "min_value": ("min", "value"), "max_value": ("max", "value")})
    return out.select(ts_text("bucket").alias("bucket"), "tag", r4("mean_value").alias("mean_value"),
                      r4("min_value").alias("min_value"), r4("max_value").alias("max_value"))


@register("t3_hourly_mean_into_rollup", """
SELECT strftime(time_bucket(INTERVAL '2 hours', time_bucket(INTERVAL '1 hour', ts)), '%Y-%m-%d %H:%M:%S') AS shard,
       strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS bucket,
       event_type AS tag, round(avg(value), 4) AS mean_value
FROM events GROUP BY 1, 2, 3""")
def t3(spark, sf):
    """Hourly mean per tag, with the 2 h shard bucket it is stored under (rollup target form)."""
    pts = b.event_points(spark, sf)
    out = ts.downsample(pts, "ts", "1 hour", ["tag"], {"mean_value": ("mean", "value")})
    out = out.withColumn("shard", ts.shard_bucket(F.col("bucket"), 7200))
    return out.select(ts_text("shard").alias("shard"), ts_text("bucket").alias("bucket"), "tag",
                      r4("mean_value").alias("mean_value"))


@register("t5_retention_7d", f"""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type AS tag, round(value, 4) AS value
FROM events WHERE ts >= TIMESTAMP '{ASOF}' - INTERVAL 7 DAY""")
def t5(spark, sf):
    ev = b.table(spark, sf, "events").select("event_id", "ts", F.col("event_type").alias("tag"), "value")
    kept = ts.apply_retention(ev, "ts", "7 DAYS", ASOF)
    return kept.select("event_id", ts_text("ts").alias("ts"), "tag", r4("value").alias("value"))


@register("f10_last_hour_sum_by_tag", f"""
SELECT event_type AS tag, round(sum(value), 4) AS sum_value, count(*) AS n
FROM events WHERE ts >= TIMESTAMP '{ASOF}' - INTERVAL 1 DAY - INTERVAL 1 HOUR
  AND ts < TIMESTAMP '{ASOF}' - INTERVAL 1 DAY
GROUP BY 1""")
def f10(spark, sf):
    """Relative-time window `time >= asof - 1h` (asof = one day before the data end)."""
    asof = "2024-01-30 00:00:00"
    ev = b.event_points(spark, sf)
    recent = ts.since(ev, "ts", asof, "1 HOUR").filter(F.col("ts") < F.lit(asof).cast("timestamp_ntz"))
    return recent.groupBy("tag").agg(r4(F.sum("value")).alias("sum_value"), F.count(F.lit(1)).alias("n"))


@register("a8_min_max_mean_by_tag", """
SELECT event_type AS tag, round(avg(value), 4) AS mean_value, round(min(value), 4) AS min_value,
       round(max(value), 4) AS max_value, count(*) AS n
FROM events GROUP BY 1""")
def a8(spark, sf):
    ev = b.event_points(spark, sf)
    return ev.groupBy("tag").agg(r4(F.avg("value")).alias("mean_value"), r4(F.min("value")).alias("min_value"),
                                 r4(F.max("value")).alias("max_value"), F.count(F.lit(1)).alias("n"))


BY_TAG = """SELECT strftime(time_bucket(INTERVAL '{w}', ts), '%Y-%m-%d %H:%M:%S') AS bucket, event_type AS tag, round(sum(value), 2) AS sum_value,
       round(min(value), 4) AS min_value, round(max(value), 4) AS max_value, count(value) AS n FROM events GROUP BY 1, 2"""


def _told(states):
    m = ts.mean_of(states).filter(F.abs(F.col("mean") * F.col("count") - F.col("sum")) < 1e-6)
    return m.select(ts_text("bucket").alias("bucket"), "tag", F.round("sum", 2).alias("sum_value"), r4("min").alias("min_value"),
                    r4("max").alias("max_value"), F.col("count").alias("n"))


@register("t3_hourly_from_10m_states", BY_TAG.format(w="1 hour"))
def t3_cascade(spark, sf):
    """The hourly class merged from stored states of the 10-minute class."""
    fine = store(ts.rollup_states(b.event_points(spark, sf), "ts", "10 minutes", ["tag"]))
    return _told(ts.merge_states(fine, ["tag"], "1 hour"))


@register("t3_late_points", BY_TAG.format(w="10 minutes"))
def t3_late(spark, sf):
    """Every tenth event comes late: its buckets are merged anew, the stored others stay."""
    ev = b.table(spark, sf, "events").select("event_id", "ts", F.col("event_type").alias("tag"), "value")
    stored = store(ts.rollup_states(ev.filter("event_id % 10 <> 0"), "ts", "10 minutes", ["tag"]))
    return _told(ts.add_late(stored, ev.filter("event_id % 10 = 0"), "ts", "10 minutes", ["tag"]))


@register("t5_retention_altered", f"""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events
WHERE ts >= TIMESTAMP '{ASOF}' - CASE WHEN event_type IN ('purchase', 'signup') THEN INTERVAL 14 DAY ELSE INTERVAL 7 DAY END""")
def t5_altered(spark, sf):
    """Two policies of 7 days; one is altered to 14 before the points are filtered by theirs."""
    policies = spark.createDataFrame([("short", 7), ("long", 7)], "name string, days int")
    ev = b.table(spark, sf, "events").select("event_id", "ts", F.when(F.col("event_type").isin("purchase", "signup"), "long").otherwise("short").alias("policy"))
    kept = ts.retained(ev, "ts", ts.set_policy(policies, "long", 14), ASOF, policy_col="policy")
    return kept.select("event_id", ts_text("ts").alias("ts"))
