"""Values at places between pixels."""

from echograin.operators import geometry as gm


def test_sampled_targets_move_once_and_keep_their_number(spark):
    image = spark.createDataFrame([("a", r, c, 10.0 * r + c) for r in range(4) for c in range(5) if (r, c) != (3, 0)] + [("a", 3, 0, None), ("b", 0, 0, 7.0)], "k string, r int, c int, v double")
    places = [("a", 0.5, 1.25), ("a", 0.5, 1.25), ("a", 3.0, 4.0), ("a", 2.5, 0.5), ("a", -0.5, 1.0), ("a", 3.0, 1.5), ("b", 0.0, 0.0), ("b", 0.0, 0.1), (None, 0.0, 0.0), ("a", None, 1.0), ("a", 2.0, 0.0)]
    targets = spark.createDataFrame([(*p, float(n)) for n, p in enumerate(places)], "k string, y double, x double, other double")
    out = gm.sampled(image, targets, "r", "c", "v", keys=["k"])
    assert out.columns == ["k", "y", "x", "other", "v"]
    got = {r["other"]: r["v"] for r in out.collect()}
    assert got == {0.0: 6.25, 1.0: 6.25, 2.0: 34.0, 3.0: None, 4.0: None, 5.0: 31.5, 6.0: 7.0, 7.0: None, 8.0: None, 10.0: 20.0}
    # equal targets are rows of their own, each with the value
    twice = gm.sampled(image, targets.where("k = 'a' AND y = 0.5").drop("other"), "r", "c", "v", keys=["k"]).collect()
    assert [r["v"] for r in twice] == [6.25, 6.25]
    plan = out.drop("other")._jdf.queryExecution().optimizedPlan().toString()
    assert "other" not in plan.split("Join")[0] and not any("other#" in line for line in plan.splitlines() if "Aggregate" in line or "Generate" in line)
