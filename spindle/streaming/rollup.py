"""Always-on downsampling (T4) and the continuous line-protocol source.

The continuous query becomes a Structured Streaming aggregation: event-time
``window`` + tag, a watermark so closed windows are emitted once in append
mode and their state is dropped, checkpointed in the shared folder so a
restarted query resumes exactly where it stopped. The reference has no
late-data rule; rows later than the watermark are dropped (our explicit
addition). ``timestamp_ntz`` columns are cast to ``timestamp`` first (the
watermark rejects ``timestamp_ntz``), with the session time zone UTC.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spindle.operators.timeseries import _AGGS
from spindle.sources.line_protocol import read_line_protocol


def downsample_stream(sdf: DataFrame, ts: str, width: str, by: Sequence[str] = (),
                      aggs: Mapping[str, tuple[str, str]] | None = None, watermark: str = "10 minutes",
                      bucket: str = "bucket") -> DataFrame:
    """T4 plan: watermarked tumbling aggregate of a streaming DataFrame."""
    aggs = aggs or {"mean_value": ("mean", "value")}
    s = sdf.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    exprs = [_AGGS[fn](F.col(c)).alias(name) for name, (fn, c) in aggs.items()]
    g = s.groupBy(F.window(F.col(ts), width).alias("__w"), *[F.col(c) for c in by]).agg(*exprs)
    return g.select(F.col("__w.start").alias(bucket), *by, *aggs.keys())


def start_rollup(plan: DataFrame, sink_path: str, checkpoint: str, trigger: Mapping[str, object] | None = None,
                 partition_by: Sequence[str] = (), fmt: str = "parquet") -> StreamingQuery:
    """Run the plan into a parquet rollup (append, exactly-once file sink).

    ``trigger``: e.g. ``{"processingTime": "1 hour"}`` (always on, one run per
    bucket) or ``{"availableNow": True}`` (catch up and stop).
    """
    w = plan.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start(sink_path)


def stream_points(spark: SparkSession, source_dir: str, measurement: str | None = None,
                  max_files_per_trigger: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Tail a folder of line-protocol text files as a stream of points.

    New files are picked up once each (no whole-file re-read per interval);
    ``measurement`` renames every point (``name_override``). Returns
    (points, rejects) streams.
    """
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = r.load(source_dir)
    points, rejects = read_line_protocol(lines)
    if measurement is not None:
        points = points.withColumn("measurement", F.lit(measurement))
    return points, rejects
