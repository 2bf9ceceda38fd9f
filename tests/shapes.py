"""Small inputs shared by the tests."""

SF_SMALL = "/root/testdata/sf0.001"


def edges_df(spark, pairs, typ="int"):
    return spark.createDataFrame(pairs, f"src {typ}, dst {typ}")
