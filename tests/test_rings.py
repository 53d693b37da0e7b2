"""Rings as column expressions."""

from pyspark.sql import functions as F

from echograin.functions import geo


def test_a_ring_is_made_once_a_row(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)],), (None,), ([],)], "p array<struct<lon: double, lat: double>>")
    out = df.select(geo.wkt_of_ring(geo.ordered_ring(F.col("p"))).alias("wkt"))
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("atan2") == 1 and plan.count("array_distinct") == 1
    assert out.first()["wkt"] == "POLYGON ((0.0 0.0, 1.0 0.0, 1.0 1.0, 0.0 1.0, 0.0 0.0))" and out.collect()[1]["wkt"] is None
    texts = spark.createDataFrame([("1,2 3,4", "1 2 3 4 5"), (" ", "1"), (None, None)], "g string, q string")
    got = texts.select(geo.ring_of_gml(F.col("g")), geo.ring_of_pos_list(F.col("q"))).collect()
    assert got[0][0] == got[0][1] == [(2.0, 1.0), (4.0, 3.0)] and got[1][:] == ([], None) and got[2][:] == (None, None)
