"""Geometry of two passes, three-pass phases and spectral diversity with planted shifts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from echograin.operators import geometry, interferometry as itf

P, V = np.array([4963800.0, 697600.0, 4982300.0]), np.array([-5251.0, -738.0, 5303.0])


def orbit(spark, start):
    rows = [("p", float(t), *map(float, start + V * t), *map(float, V)) for t in (-20, -10, 0, 10, 20)]
    return spark.createDataFrame(rows, "product string, t double, x double, y double, z double, vx double, vy double, vz double")


def test_baselines_and_phase_of_two_passes(spark):
    square = np.cross(V, P)
    up, side = P / np.linalg.norm(P), square / np.linalg.norm(square)
    ground = spark.createDataFrame([("p", r, c, 45 - r * 0.01, 10 + c * 0.01, 100.0 * c) for r in range(4) for c in range(5)], "product string, row int, col int, lat double, lon double, height double")
    for move in (150 * up, -80 * up + 60 * side):
        got = itf.interferometric_geometry(ground, orbit(spark, P), orbit(spark, P + move), ["product"], 0.056).collect()
        assert len(got) == 20
        for r in got:
            lat, lon, h = math.radians(r["lat"]), math.radians(r["lon"]), r["height"]
            n = 6378137.0 / math.sqrt(1 - itf.earth_fixed.__globals__["E2"] * math.sin(lat) ** 2)
            x = np.array([(n + h) * math.cos(lat) * math.cos(lon), (n + h) * math.cos(lat) * math.sin(lon), (n * (1 - itf.earth_fixed.__globals__["E2"]) + h) * math.sin(lat)])
            near = [p + V * ((x - p) @ V) / (V @ V) for p in (P, P + move)]
            d = [np.linalg.norm(x - s) for s in near]
            look = (x - near[0]) / d[0]
            base = near[1] - near[0]
            assert r["slant_range"] == pytest.approx(d[0], abs=1e-4) and r["phase"] == pytest.approx(-4 * math.pi / 0.056 * (d[0] - d[1]), abs=2e-2)
            assert r["parallel"] == pytest.approx(base @ look, abs=1e-5)
            top = np.array([math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)])
            want = np.linalg.norm(base - (base @ look) * look) * (1 if base @ top - (base @ look) * (look @ top) >= 0 else -1)
            assert r["perpendicular"] == pytest.approx(want, abs=1e-4) and r["incidence"] == pytest.approx(math.degrees(math.acos(-look @ top)), abs=1e-6)


def test_topography_is_taken_out(spark):
    df = spark.createDataFrame([(h, 8e5 + h, 30.0 + h / 100, 120.0) for h in (0.0, 50.0, 400.0, -10.0)], "h double, slant double, inc double, b double")
    phase = itf.topographic_phase(F.col("h"), 0.056, F.col("slant"), F.col("inc"), F.col("b"))
    back = geometry.phase_to_height(F.col("p"), 0.056, F.col("slant"), F.col("inc"), 120.0)
    assert all(abs(r["h"] - r["back"]) < 1e-9 for r in df.withColumn("p", phase).withColumn("back", back).collect())
    got = itf.without_phase(df.withColumns({"re": F.cos(phase + 0.4), "im": F.sin(phase + 0.4)}), "re", "im", phase).collect()
    assert all(abs(math.atan2(r["im"], r["re"]) - 0.4) < 1e-9 for r in got)
    row = spark.createDataFrame([(2.0, 3.0, 40.0, 120.0), (2.0, 3.0, 40.0, 0.0)], "d double, t double, bd double, bt double")
    assert [r[0] for r in row.select(itf.three_pass(F.col("d"), F.col("t"), F.col("bd"), F.col("bt"))).collect()] == [1.0, None]


def test_planted_shifts_come_back(spark):
    rng, line_time = np.random.default_rng(6), 0.00205
    images = {"a": 0.0, "b": 0.0213, "c": -0.0172, "d": 0.004}
    gaps = {0: 4500.0, 1: 4700.0, 2: 4500.0}
    rows = []
    for i, j in (("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("b", "d")):
        tau = (images[j] - images[i]) * line_time
        for b in range(4):
            centre = sum(gaps[k] for k in range(b))  # each burst's Doppler centroid falls by the gap
            for line in range(b * 10, b * 10 + 14):
                for c in range(30):
                    noisy = 20 <= c  # the last block has no coherence
                    phase = rng.uniform(-math.pi, math.pi) if noisy else 0.3 * c - 2 * math.pi * centre * tau + rng.normal(0, 0.05)
                    rows.append((i, j, b, line, c, math.cos(phase), math.sin(phase)))
    df = spark.createDataFrame(rows, "first string, second string, burst int, line int, col int, re double, im double").repartition(6)
    over = itf.overlap_phases(df, ["first", "second"], "burst", "line", "col", "re", "im", 10)
    assert over.count() == 5 * 3 * 3 and over.agg(F.sum("n")).first()[0] == 5 * 3 * 4 * 30
    gap = F.when(F.col("burst") == 1, 4700.0).otherwise(4500.0)
    pairs = itf.azimuth_shifts(over, ["first", "second"], gap, line_time, 0.6)
    for r in pairs.collect():
        assert abs(r["shift"] - (images[r["second"]] - images[r["first"]])) < 1e-3
    pairs = pairs.withColumn("stack", F.lit("s"))
    for norm in ("l2", "l1"):
        got = {r["image"]: r["shift"] for r in itf.network_shifts(pairs, ["stack"], "first", "second", norm).collect()}
        assert all(abs(got[k] - images[k]) < 1e-3 for k in images)


def test_networks_with_an_outlier_and_a_part_of_its_own(spark):
    rows = [("s", "a", "b", 1.0, 1.0), ("s", "b", "c", 1.0, 1.0), ("s", "a", "c", 2.0, 1.0), ("s", "c", "d", 1.0, 1.0), ("s", "b", "d", 9.0, 0.5), ("s", "a", "d", 3.0, 1.0), ("s", "x", "y", 1.0, 1.0), ("s", "a", "b", float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "stack string, first string, second string, shift double, weight double")
    got = {r["image"]: r["shift"] for r in itf.network_shifts(df, ["stack"], "first", "second", "l1").collect()}
    assert all(abs(got[k] - v) < 1e-4 for k, v in {"a": 0, "b": 1, "c": 2, "d": 3}.items()) and all(got[k] is None or math.isnan(got[k]) for k in "xy")
    with pytest.raises(ValueError):
        itf.network_shifts(df, ["stack"], "first", "second", "l0")
