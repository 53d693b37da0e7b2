"""Looks beside their product."""

from echograin.operators import product_ops as po


def test_looks_meet_each_row_of_the_product(spark):
    product = spark.createDataFrame([(0, 0, 1.5), (0, 0, 2.5), (0, 1, 3.5), (1, 0, None), (None, 2, 4.5)], "r int, c int, i double")
    looks = spark.createDataFrame([(0, 0, 1, 1.0, 10.0), (0, 0, 2, 2.0, 20.0), (0, 0, 2, 3.0, 5.0), (1, 0, 2, 7.0, None), (None, 2, 1, 8.0, 80.0), (9, 9, 1, 9.0, 90.0)], "r long, c int, look int, i double, q double")
    out = po.merge_iq(product, looks, ["r", "c"])
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [("r", "int"), ("c", "int"), ("i", "double"), *((f"{b}_SA{n}", "double") for n in (1, 2) for b in "iq")]
    none = (None,) * 4
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == sorted([(0, 0, 1.5, 1.0, 10.0, 3.0, 20.0), (0, 0, 2.5, 1.0, 10.0, 3.0, 20.0), (0, 1, 3.5, *none), (1, 0, None, None, None, 7.0, None), (None, 2, 4.5, *none)], key=str)


def test_looks_need_no_hash_tables(spark):
    """One sort of product and looks holds less of a task's memory than tables of all keys, and can spill."""
    rows = spark.range(100).selectExpr("id AS r", "id % 7 AS c", "cast(id as double) AS i")
    looks = rows.selectExpr("r", "c", "explode(array(1, 2)) AS look", "i", "i + 1 AS q")
    plan = po.merge_iq(rows, looks, ["r", "c"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "Join" not in plan
