"""Row numbering and neighbours in an order, without a whole group in one task.

``row_number() OVER (PARTITION BY g ORDER BY o)`` sends every row of a group to
one task; a group holding a third of the table then runs on one core. Here
the rows are range-partitioned on ``(g, o)`` -- a hot group spreads over many
partitions -- and sorted; each row gets its global position from a
per-partition count table (one row per partition) and its group's first
position from a partially aggregated ``min``. Position minus group start is
the row number. ``lead`` is then an equi join on position + 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.session import store


def global_positions(df: DataFrame, order: Sequence[str | Column], partitions: int | None = None,
                     out: str = "__g") -> DataFrame:
    """Adds ``out``: 0-based position of each row in the total order ``order``."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
           .withColumn("__pid", F.spark_partition_id())
           .withColumn("__mid", F.monotonically_increasing_id()))
    s = store(s)  # the partition and place that the positions are computed from are columns of it
    counts = s.groupBy("__pid").agg(F.count(F.lit(1)).alias("__c"))
    offsets = counts.select("__pid", (F.sum("__c").over(Window.orderBy("__pid")) - F.col("__c")).alias("__off"))
    local = F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)
    return (s.join(F.broadcast(offsets), "__pid")  # one row per partition: bounded
             .withColumn(out, F.col("__off") + local)
             .drop("__pid", "__mid", "__off"))


def row_numbers(df: DataFrame, partition_cols: Sequence[str], order_cols: Sequence[str | Column],
                out: str = "rn") -> DataFrame:
    """``row_number()`` per group in an order (1-based), from distributed positions, so
    a hot group is spread over many tasks. Ties in ``order_cols`` are broken by
    the sort, as with the window form.
    """
    keys = [*partition_cols, *order_cols]
    g = global_positions(df, keys)
    if not partition_cols:
        return g.withColumn(out, F.col("__g") + 1).drop("__g")
    first = g.groupBy(*partition_cols).agg(F.min("__g").alias("__g0"))
    # null-safe equality so a null group is numbered like the window form does
    cond = [g[c].eqNullSafe(first[c]) for c in partition_cols]
    j = g.join(first, cond).select(g["*"], first["__g0"])
    return j.withColumn(out, F.col("__g") - F.col("__g0") + 1).drop("__g", "__g0")


def lead_pairs(df: DataFrame, partition_cols: Sequence[str], order_cols: Sequence[str | Column],
               value: str, out: tuple[str, str] = ("src", "dst")) -> DataFrame:
    """``(value, lead(value))`` pairs of consecutive rows per group (rows with a successor).

    A join of each row with the row at the next global position in the same group.
    """
    names = dict.fromkeys([*partition_cols, *[c for c in order_cols if isinstance(c, str)], value])
    g = global_positions(df.select(*names),
                         [*partition_cols, *order_cols])
    a = g.select(*partition_cols, F.col(value).alias(out[0]), (F.col("__g") + 1).alias("__next"))
    b = g.select(*[F.col(c).alias(f"__b_{c}") for c in partition_cols], F.col(value).alias(out[1]),
                 F.col("__g").alias("__next"))
    j = a.join(b, "__next")
    for c in partition_cols:
        j = j.filter(F.col(c).eqNullSafe(F.col(f"__b_{c}")))
    return j.select(out[0], out[1])
