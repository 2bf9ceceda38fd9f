"""Structured Streaming: continuous line-protocol source, routing sink, rollup stream."""

import os
import pathlib
import tempfile

import pytest
from pyspark.sql import functions as F

from spindle.sources import files as IO
from spindle.streaming import rollup as SR


def test_stream_points_and_route(spark):
    src = tempfile.mkdtemp(prefix="spindle-lp-")
    with open(os.path.join(src, "a.txt"), "w") as f:
        f.write("cpu,host=a usage=1.5 1000000000\ncpu,host=b usage=2.5 2000000000\nbroken line\n")
    with open(os.path.join(src, "b.txt"), "w") as f:
        f.write("cpu,host=a usage=3.5 3000000000\n")
    pts, rej = SR.stream_points(spark, src, measurement="cpu_renamed", max_files_per_trigger=1)
    out = tempfile.mkdtemp(prefix="spindle-route-")
    sinks = {"a": lambda d: d.write.mode("append").parquet(f"{out}/a"),
             "other": lambda d: d.write.mode("append").parquet(f"{out}/other")}
    fn = IO.for_each_route({"a": F.col("tags")["host"] == "a"}, sinks)
    q = (pts.writeStream.foreachBatch(fn).option("checkpointLocation", f"{out}/ckpt")
            .trigger(availableNow=True).start())
    q.awaitTermination()
    a = spark.read.parquet(f"{out}/a")
    assert a.count() == 2 and {r["measurement"] for r in a.collect()} == {"cpu_renamed"}
    assert spark.read.parquet(f"{out}/other").count() == 1
    rq = rej.writeStream.format("memory").queryName("rejects_t").trigger(availableNow=True).start()
    rq.awaitTermination()
    assert spark.sql("SELECT * FROM rejects_t").collect()[0]["value"] == "broken line"


def test_rollup_stream_closed_windows(spark):
    rows = [("2024-01-01 00:05:00", "x", 1.0), ("2024-01-01 00:50:00", "x", 3.0), ("2024-01-01 01:10:00", "x", 5.0),
            ("2024-01-01 02:30:00", "y", 7.0)]
    src = tempfile.mkdtemp(prefix="spindle-ev-")
    spark.createDataFrame(rows, "ts string, tag string, value double") \
        .select(F.to_timestamp_ntz(F.col("ts")).alias("ts"), "tag", "value").write.mode("overwrite").parquet(src)
    schema = spark.read.parquet(src).schema
    sdf = spark.readStream.schema(schema).parquet(src)
    plan = SR.downsample_stream(sdf, "ts", "1 hour", ["tag"], {"mean_value": ("mean", "value")}, "10 minutes")
    out = tempfile.mkdtemp(prefix="spindle-t4-")
    SR.start_rollup(plan, out, out + "-ckpt").awaitTermination()
    got = {(str(r["bucket"]), r["tag"], r["mean_value"]) for r in spark.read.parquet(out).collect()}
    # windows closed by the watermark (max ts 02:30 - 10 min): 00:00 and 01:00; 02:00 stays open
    assert got == {("2024-01-01 00:00:00", "x", 2.0), ("2024-01-01 01:00:00", "x", 5.0)}


def test_retention_prunes_partitions(spark):
    ev = spark.createDataFrame([("2024-01-01", "a", 1.0), ("2024-01-05", "a", 2.0), ("2024-01-09", "b", 3.0)],
                               "day string, tag string, v double")
    out = tempfile.mkdtemp(prefix="spindle-rollup-")
    IO.write_rollup(ev, out, "day")
    kept = IO.drop_expired(spark, out, "day", "2024-01-05")
    assert sorted(str(r["day"]) for r in kept.collect()) == ["2024-01-05", "2024-01-09"]  # inferred as date
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan  # the expiry test is a partition filter, pruned at the scan
    left = IO.drop_expired(spark, out, "day", "2024-01-05", delete=True)
    assert sorted(str(r["day"]) for r in left.collect()) == ["2024-01-05", "2024-01-09"]
    assert sorted(p.name for p in pathlib.Path(out).glob("day=*")) == ["day=2024-01-05", "day=2024-01-09"]


def test_a_route_without_a_sink_is_an_error():
    with pytest.raises(ValueError, match="without a sink"):
        IO.for_each_route({"bad": F.lit(True)}, {"bad": lambda df: None})
