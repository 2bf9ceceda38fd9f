"""Exact de-duplication by content sort (operator 4, native).

Texts are compared after lower-casing A-Z only. Rows are range-partitioned by
sampled splitters on a bounded sort key of the normalised bytes (first bytes,
then digest), sorted on disk-backed sorters inside each partition by the whole
normalised text, and neighbouring rows are compared in full: equal neighbours
form a run, the row with the largest identifier stays.

Splitters are taken on the bounded key, not on the texts, so the sample that
reaches the driver is bounded by the number of partitions. A text with a large
share of all rows would put its whole run into one range; such texts (at most
``4 n`` of them, found by a pre-aggregated count) get a salt as last part of
the key, and their partial runs, one per salt, are merged by the full text.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.llm.common import partitions, stash, whole_text

PREFIX = 32   # leading code points of the normalised text in the splitter key


def normalise(text: str | Column) -> Column:
    """Null as empty; A-Z lower-cased and nothing else."""
    t = whole_text(text)
    # for pure ASCII the built-in lower() does the same and is faster
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(
        F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


def sorted_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                carry: list[str] | None = None) -> DataFrame:
    """One row per input row: ``__id, __sha, keep_id, group_size, kept`` and the
    ``carry`` columns as the struct ``__row``.

    Null texts equal empty ones. Null identifiers rank below all others; a
    group of nothing but null identifiers has a null ``keep_id``. Of rows that
    repeat an identifier and a text one stays. An empty table gives no rows.
    """
    spark = df.sparkSession
    n = partitions(spark)
    row = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(0)
    base = df.select(F.col(id_col).alias("__id"), normalise(text_col).alias("__norm"), row.alias("__row"))
    keyed = (base.withColumn("__sha", F.sha2(F.col("__norm"), 256))
                 .withColumn("__prefix", F.substring("__norm", 1, PREFIX)))

    # texts that hold more than a quarter of a partition's share of the rows: at most 4 n
    limit = max(2, df.count() // (4 * n))
    hot = (keyed.groupBy("__sha").agg(F.count(F.lit(1)).alias("__c"))
                .filter(F.col("__c") > limit).select("__sha", F.lit(True).alias("__hot")))
    keyed = (keyed.join(F.broadcast(hot), "__sha", "left")  # at most 4 n rows
                  .withColumn("__hot", F.coalesce("__hot", F.lit(False)))
                  .withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64("__id"), F.lit(n))).otherwise(F.lit(0))))

    ranged = keyed.repartitionByRange(n, "__prefix", "__sha", "__salt")
    run = Window.partitionBy("__prefix", "__sha", "__salt", "__norm").orderBy(F.col("__id").desc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = (ranged.withColumn("__rn", F.row_number().over(run))
                  .withColumn("__keep", F.first("__id").over(whole))
                  .withColumn("__size", F.count(F.lit(1)).over(whole)))
    # the text itself is only needed once per partial run of a salted text
    runs = stash(runs.withColumn("__norm", F.when(F.col("__hot") & (F.col("__rn") == 1), F.col("__norm")))
                     .drop("__prefix"), "content-runs")

    heads = runs.filter(F.col("__hot") & (F.col("__rn") == 1))
    merged = heads.groupBy("__sha", "__norm").agg(
        F.max("__keep").alias("keep_id"), F.sum("__size").alias("group_size"),
        F.max(F.struct(F.col("__keep").isNotNull().alias("has"), F.col("__keep").alias("id"),
                       F.col("__salt").alias("salt"))).alias("__best"))
    merged = (heads.select("__sha", "__norm", "__salt", F.col("__keep").alias("__part"))
                   .join(merged, ["__sha", "__norm"])
                   .select("__sha", "__salt", "__part", "keep_id", "group_size",
                           (F.col("__best.salt") == F.col("__salt")).alias("__wins")))
    cold = runs.filter(~F.col("__hot")).select(
        "__id", "__sha", "__row", F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"),
        (F.col("__rn") == 1).alias("kept"))
    r, m = runs.filter("__hot").alias("r"), merged.alias("m")
    salted = (r.join(m, (F.col("r.__sha") == F.col("m.__sha")) & (F.col("r.__salt") == F.col("m.__salt"))
                     & F.col("r.__keep").eqNullSafe(F.col("m.__part")))
               .select("r.__id", "r.__sha", "r.__row", "m.keep_id", "m.group_size",
                       ((F.col("r.__rn") == 1) & F.col("m.__wins")).alias("kept")))
    return cold.unionByName(salted)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: its id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    return sorted_runs(df, id_col, text_col).select(
        F.col("__id").alias(id_col), "keep_id", "group_size", "kept", F.col("__sha").alias("text_sha256"))


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns without all but one row of equal texts."""
    return sorted_runs(df, id_col, text_col, df.columns).filter("kept").select("__row.*")
