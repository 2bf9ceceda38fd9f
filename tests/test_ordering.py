"""Distributed row numbering and lead equal their window forms, also with one hot group."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindle.operators.ordering import lead_pairs, row_numbers


def skewed(spark):
    # group 0 holds about half of the rows
    return spark.range(0, 4000).select(
        F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 37).alias("g"),
        ((F.col("id") * 7919) % 1000).alias("o"), F.col("id").alias("v"))


def test_row_numbers_match_window(spark):
    df = skewed(spark)
    mine = {(r["v"], r["rn"]) for r in row_numbers(df, ["g"], ["o", "v"]).collect()}
    w = Window.partitionBy("g").orderBy("o", "v")
    ref = {(r["v"], r["rn"]) for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert mine == ref


def test_lead_pairs_match_window(spark):
    df = skewed(spark)
    mine = sorted(tuple(r) for r in lead_pairs(df, ["g"], ["o", "v"], "v").collect())
    w = Window.partitionBy("g").orderBy("o", "v")
    ref = sorted(tuple(r) for r in df.select(F.col("v").alias("src"), F.lead("v").over(w).alias("dst"))
                 .filter("dst IS NOT NULL").collect())
    assert mine == ref

