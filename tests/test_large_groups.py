"""Rows of large keys stay where they are."""

import math

import pytest
from pyspark.sql import functions as F

from echograin.operators import image_stats as st
from echograin.operators import joins as jn


@pytest.mark.parametrize("large", [0, 1, 2, 10])
def test_groups_meet_their_rows_whatever_their_size(spark, large):
    df = spark.createDataFrame([("a", 1, n) for n in range(9)] + [("b", 1, n) for n in range(4)] + [("c", 2, n) for n in range(4)] + [("d", 3, 0), (None, 1, 5)], "k string, g int, n int")
    groups = df.groupBy("k", "g").agg(F.max("n").alias("most"), F.count("*").alias("rows"))
    got = sorted(tuple(r) for r in jn.join_large_groups(df, groups, ["k", "g"], "rows", large).collect())
    assert got == sorted([("a", 1, n, 8) for n in range(9)] + [(k, g, n, 3) for k, g in (("b", 1), ("c", 2)) for n in range(4)] + [("d", 3, 0, 0)])


def test_mutual_information_leaves_rows_of_large_keys_in_place(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 8 == 0, "b").otherwise("a").alias("k"), (F.col("id") % 16).cast("double").alias("x"), (F.col("id") % 32).cast("double").alias("y"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = st.normalized_mutual_information(df, "x", "y", ["k"], bins=32)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r["k"]: r["nmi"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" in plan
    # y fixes x: 2 Hx / (Hx + Hy)
    assert abs(got["a"] - 2 * math.log(14) / (math.log(14) + math.log(28))) < 1e-9 and abs(got["b"] - 2 * math.log(2) / (math.log(2) + math.log(4))) < 1e-9
    assert st.normalized_mutual_information(df, "x", "x", ["k"]).count() == 2
