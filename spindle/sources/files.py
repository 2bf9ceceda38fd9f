"""File sources and sinks.

Writes are ordinary partitioned DataFrame writes: every task writes its own
part files, so no result ever sits whole in one task or on the driver (the
reference's batched CSV append becomes the task-wise write). Scratch output
of round-trip checks goes under the session's shared checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spindle.session import checkpoint_dir


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/io-{name}-{uuid.uuid4().hex[:12]}"


def read_delimited(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",",
                   header: bool = True) -> DataFrame:
    """CSV / tab text with an explicit schema (no inference pass over the data)."""
    return spark.read.schema(schema).option("header", header).option("sep", sep).csv(path)


def write_csv(df: DataFrame, path: str, max_levels: int | None = None, level_col: str = "path",
              mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """CSV sink. With ``max_levels``, an array column becomes its whole text
    (levels joined by ``|``), ``level_1..n`` text columns and an ``overflow``
    flag (Q19), arrays being unrepresentable in CSV."""
    out = df
    if max_levels is not None:
        p = F.col(level_col)
        out = out.select(*[c for c in df.columns if c != level_col],
                         F.array_join(F.transform(p, lambda x: x.cast("string")), "|").alias(level_col),
                         *[F.get(p, i).cast("string").alias(f"level_{i + 1}") for i in range(max_levels)],
                         (F.size(p) > max_levels).alias("overflow"))
    w = out.write.mode(mode).option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Graph as JSON lines in ``path/nodes`` and ``path/edges`` (one JSON
    document would need a single task)."""
    nodes.write.mode(mode).json(f"{path}/nodes")
    edges.write.mode(mode).json(f"{path}/edges")


def read_graph_json(spark: SparkSession, path: str, node_schema: str, edge_schema: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(node_schema).json(f"{path}/nodes"), spark.read.schema(edge_schema).json(f"{path}/edges")


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` rows (``LIMIT n``)."""
    return df.limit(n)


def measurements(points: DataFrame, col: str = "measurement") -> DataFrame:
    """``SHOW MEASUREMENTS`` -- distinct measurement names."""
    return points.select(col).distinct()


def write_rollup(df: DataFrame, target: str, bucket_col: str, mode: str = "overwrite") -> None:
    """``SELECT ... INTO target`` -- parquet partitioned by the time bucket,
    so retention drops partitions and time filters prune them. Dynamic
    partition overwrite replaces only the buckets present in ``df``."""
    # one task a bucket (large buckets are split): not tasks x buckets small files
    df = df.hint("rebalance", bucket_col)
    (df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
       .partitionBy(bucket_col).parquet(target))


def drop_expired(spark: SparkSession, target: str, bucket_col: str, keep_from: str, delete: bool = False) -> DataFrame:
    """T5 storage form: the rollup without buckets older than ``keep_from``
    (a partition filter -- pruned at the scan, nothing else is read).

    With ``delete`` the expired partitions' folders are removed as well; give
    that only for a target this library's :func:`write_rollup` has written.
    """
    kept = spark.read.parquet(target).filter(F.col(bucket_col) >= F.lit(keep_from))
    if not delete:
        return kept
    root = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    # folders of a partitioned table, one a bucket
    old = (spark.read.parquet(target).filter(F.col(bucket_col) < F.lit(keep_from))
                .select(F.regexp_replace(F.input_file_name(), "/[^/]*$", "").alias("folder")).distinct())
    for r in old.toLocalIterator():
        path = spark._jvm.org.apache.hadoop.fs.Path(r["folder"])
        if not path.getName().startswith(f"{bucket_col}="):
            raise ValueError(f"not a {bucket_col} partition: {r['folder']}")
        fs.delete(path, True)
    return spark.read.parquet(target)


def append_vectors(df: DataFrame, path: str) -> None:
    """Append ``(id, vec array<float>, ...)`` rows to a parquet vector table."""
    df.withColumn("vec", F.col("vec").cast("array<float>")).write.mode("append").parquet(path)


def route(df: DataFrame, routes: Mapping[str, Column], default: str = "other") -> dict[str, DataFrame]:
    """Split rows by predicates, first match wins; the rest go to ``default``.

    Returns one filtered DataFrame per route (each written by its own sink);
    :func:`route_label` gives the route as a column for a single partitioned write.
    """
    label = route_label(routes, default)
    tagged = df.withColumn("__route", label)
    out = {name: tagged.filter(F.col("__route") == name).drop("__route") for name in list(routes) + [default]}
    return out


def route_label(routes: Mapping[str, Column], default: str = "other") -> Column:
    expr = F.lit(default)
    for name, pred in reversed(list(routes.items())):
        expr = F.when(F.coalesce(pred, F.lit(False)), F.lit(name)).otherwise(expr)
    return expr


def error_class(msg: str | Column) -> Column:
    """Error class of a ``find``/``stat`` message line."""
    m = F.col(msg) if isinstance(msg, str) else msg
    return (F.when(m.contains("No such file"), "missing")
             .when(m.contains("Permission denied"), "denied")
             .otherwise("other"))


def for_each_route(routes: Mapping[str, Column], sinks: Mapping[str, Callable[[DataFrame], None]],
                   default: str = "other") -> Callable[[DataFrame, int], None]:
    """S13 streaming form: a ``foreachBatch`` function writing each route to its sink."""
    if lost := {*routes, default} - set(sinks):
        raise ValueError(f"routes without a sink lose rows: {sorted(lost)}")

    def run(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()  # read once, not once per sink
        try:
            parts = route(batch, routes, default)
            for name, sink in sinks.items():
                sink(parts[name])
        finally:
            batch.unpersist()
    return run
