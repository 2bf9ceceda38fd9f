"""Tumbling-window downsampling and retention (continuous-query semantics).

``GROUP BY time(w), tag`` is a tumbling ``window`` plus the tag columns: one
hash aggregate with a map-side partial step, so a hot tag is pre-aggregated
inside every task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AGGS = {
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "count": F.count,
}


def downsample(df: DataFrame, ts: str, width: str, by: Sequence[str] = (),
               aggs: Mapping[str, tuple[str, str]] | None = None, bucket: str = "bucket") -> DataFrame:
    """Tumbling aggregates per ``width`` bucket and tag.

    ``aggs`` maps output name -> (function, input column), functions are
    mean/min/max/sum/count. Output: ``bucket`` (window start), tags, aggregates.
    """
    aggs = aggs or {"mean_value": ("mean", "value")}
    exprs: list[Column] = [_AGGS[fn](F.col(col)).alias(name) for name, (fn, col) in aggs.items()]
    return (df.groupBy(F.window(F.col(ts), width).start.alias(bucket), *[F.col(c) for c in by])
              .agg(*exprs))


def since(df: DataFrame, ts: str, asof: str, interval: str) -> DataFrame:
    """Relative time filter ``ts >= asof - interval`` with an explicit as-of (no now())."""
    lower = F.lit(asof).cast("timestamp_ntz") - F.expr(f"INTERVAL {interval}")
    return df.filter(F.col(ts) >= lower)


def apply_retention(df: DataFrame, ts: str, duration: str, asof: str) -> DataFrame:
    """Keep points younger than ``duration`` before ``asof`` (retention policy)."""
    return since(df, ts, asof, duration)


def shard_bucket(ts: Column, width_seconds: int) -> Column:
    """Storage bucket (shard) for a timestamp: start of its ``width_seconds`` interval.

    Used as the partition column of a rollup table, so retention becomes
    partition deletion and time filters prune partitions.
    """
    secs = F.unix_seconds(ts.cast("timestamp"))
    return F.timestamp_seconds(secs - F.pmod(secs, F.lit(width_seconds))).cast("timestamp_ntz")


# ------------------------------------------------------------------ rollup cascade (T3) and retention policies (T5)

STATE = ("sum", "count", "min", "max")


def rollup_states(points: DataFrame, ts: str, width: str, by: Sequence[str] = (), value: str = "value", bucket: str = "bucket") -> DataFrame:
    """Mergeable states ``bucket, by..., sum, count, min, max`` per bucket of ``width``: what a
    rollup stores, so that coarser rollups and late points need no raw point again."""
    v = F.col(value)
    return points.groupBy(F.window(F.col(ts), width).start.alias(bucket), *[F.col(c) for c in by]).agg(
        F.sum(v).alias("sum"), F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"))


def merge_states(states: DataFrame, by: Sequence[str] = (), width: str | None = None, bucket: str = "bucket") -> DataFrame:
    """States of equal buckets as one; with ``width`` of the coarser buckets that hold them
    (an hourly class from a 10-minute one). ``width`` must be a multiple of the states' own."""
    at = F.col(bucket) if width is None else F.window(F.col(bucket), width).start
    return states.groupBy(at.alias(bucket), *[F.col(c) for c in by]).agg(
        F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"))


def mean_of(states: DataFrame) -> DataFrame:
    """States with their ``mean`` (null where no value was)."""
    return states.withColumn("mean", F.when(F.col("count") > 0, F.col("sum") / F.col("count")))


def add_late(states: DataFrame, late: DataFrame, ts: str, width: str, by: Sequence[str] = (), value: str = "value",
             bucket: str = "bucket") -> DataFrame:
    """The stored states with late points: only the buckets that they fall into are merged anew,
    the others pass through untouched."""
    new = rollup_states(late, ts, width, by, value, bucket)
    touched = [bucket, *by]
    cond = [states[c].eqNullSafe(new[c]) for c in touched]
    kept, old = states.join(new, cond, "left_anti"), states.join(new, cond, "left_semi")
    return kept.unionByName(merge_states(old.unionByName(new), by, bucket=bucket))


def set_policy(policies: DataFrame, name: str, days: int) -> DataFrame:
    """The retention policies ``name, days`` with one created or altered."""
    spark = policies.sparkSession
    return policies.filter(F.col("name") != name).unionByName(spark.createDataFrame([(name, days)], "name string, days int"))


def retained(points: DataFrame, ts: str, policies: DataFrame, asof: str, policy: str | None = None, policy_col: str | None = None) -> DataFrame:
    """Points that their retention policy still keeps: one policy for all, or the one that
    ``policy_col`` names per point (unknown ones keep nothing)."""
    keep = policies.select(F.col("name").alias("__name"), (F.lit(asof).cast("timestamp_ntz") - F.make_dt_interval("days")).alias("__from"))
    on = F.lit(policy) if policy_col is None else F.col(policy_col)
    return points.join(keep, on == F.col("__name")).filter(F.col(ts) >= F.col("__from")).drop("__name", "__from")
