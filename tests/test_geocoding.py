"""Orbits, zero-Doppler positions and what rests on them, against a circular orbit that is known in closed form."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from echograin.operators import geocoding as gc

RADIUS, RATE = 7071000.0, 0.00106
START, LINE, NEAR, SPACING = -3.0, 0.002, 700000.0, 2.3
STATES = "product string, t double, x double, y double, z double, vx double, vy double, vz double"


def circular(t, tilt):
    """(position, velocity) on a circle whose plane is tilted against the equator, over lat 45, lon 10 near t = 0."""
    t = np.atleast_1d(np.asarray(t, float))
    u = np.array([math.cos(math.radians(45)) * math.cos(math.radians(10)), math.cos(math.radians(45)) * math.sin(math.radians(10)), math.sin(math.radians(45))])
    north = np.array([0, 0, 1.0]) - u[2] * u
    north /= np.linalg.norm(north)
    w = math.cos(tilt) * north + math.sin(tilt) * np.cross(north, u)
    a = RATE * t[:, None]
    return RADIUS * (np.cos(a) * u + np.sin(a) * w), RADIUS * RATE * (-np.sin(a) * u + np.cos(a) * w)


TILTS = {"one": 0.2, "two": -0.3}


@pytest.fixture(scope="module")
def orbits(spark):
    rows = []
    for product, tilt in TILTS.items():
        times = np.arange(-40.0, 41.0, 10.0)
        p, v = circular(times, tilt)
        rows += [(product, float(t), *map(float, a), *map(float, b)) for t, a, b in zip(times, p, v, strict=True)]
    return spark.createDataFrame(rows, STATES)


def surface(lat, lon):
    return 300 + 200 * np.sin(40 * np.radians(lat) * 20) * np.cos(35 * np.radians(lon) * 20)


def ecef(lat, lon, h):
    lat, lon = np.radians(lat), np.radians(lon)
    n = gc.A / np.sqrt(1 - gc.E2 * np.sin(lat) ** 2)
    return np.stack([(n + h) * np.cos(lat) * np.cos(lon), (n + h) * np.cos(lat) * np.sin(lon), (n * (1 - gc.E2) + h) * np.sin(lat)], -1)


@pytest.fixture(scope="module")
def ground(spark):
    rows = []
    for product in TILTS:
        for r in range(20):
            for c in range(30):
                lat, lon = 45.05 - r * 0.004, 13.5 + c * 0.004
                rows.append((product, r, c, lat, lon, float(surface(lat, lon))))
    return spark.createDataFrame(rows, "product string, row int, col int, lat double, lon double, height double").repartition(5)


def exact(point, tilt):
    """(time, range) of the closest approach on the circle itself, by bisection."""
    low, high = -40.0, 40.0
    f = lambda t: float((point - circular(t, tilt)[0][0]) @ circular(t, tilt)[1][0])
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) > 0 else (low, mid)
    return low, float(np.linalg.norm(point - circular(low, tilt)[0][0]))


def test_positions_of_the_ground(spark, ground, orbits):
    got = gc.radar_positions(ground, orbits, ["product"]).collect()
    assert len(got) == 1200
    for r in got[::37]:
        t, slant = exact(ecef(r["lat"], r["lon"], r["height"]), TILTS[r["product"]])
        assert abs(r["azimuth_time"] - t) / LINE < 1e-3 and abs(r["slant_range"] - slant) / SPACING < 1e-3
    # the ground of these positions is where they came from
    back = gc.ground_positions(gc.radar_positions(ground, orbits, ["product"]).withColumnsRenamed({"lat": "lat0", "lon": "lon0"}), orbits, ["product"]).collect()
    assert max(abs(r["lat"] - r["lat0"]) + abs(r["lon"] - r["lon0"]) for r in back) < 1e-8
    # the other side of the flight sees other ground
    left = gc.ground_positions(gc.radar_positions(ground, orbits, ["product"]).withColumnsRenamed({"lat": "lat0", "lon": "lon0"}), orbits, ["product"], right=False)
    assert left.select(F.min(F.abs(F.col("lon") - F.col("lon0")))).first()[0] > 1


def test_pixels_without_a_place(spark, orbits):
    odd = spark.createDataFrame([("one", 0, 0, 45.0, 13.5, None), ("one", 0, 1, -80.0, 13.5, 0.0), ("none", 0, 0, 45.0, 13.5, 0.0), (None, 0, 0, 45.0, 13.5, 0.0), ("one", 0, 2, 45.0, 13.5, 0.0)], "product string, row int, col int, lat double, lon double, height double")
    got = {(r["product"], r["col"]): r["azimuth_time"] for r in gc.radar_positions(odd, orbits, ["product"]).collect()}
    assert len(got) == 5 and got["one", 2] is not None and all(got[k] is None for k in got if k != ("one", 2))
    assert gc.radar_positions(odd.limit(0), orbits, ["product"]).count() == 0


def test_terrain_correction_samples_each_products_image(spark, ground, orbits):
    placed = gc.radar_positions(ground, orbits, ["product"])
    first, near = -15.0, 700000.0
    line, spacing = 1.0, 5000.0  # a coarse image, whose values are linear in its pixels
    image = spark.range(40).selectExpr("cast(id as int) AS row").crossJoin(spark.range(60).selectExpr("cast(id as int) AS col"))
    image = image.withColumn("product", F.explode(F.array(*[F.lit(p) for p in TILTS]))).withColumn("value", 2.0 * F.col("row") - 0.5 * F.col("col") + F.when(F.col("product") == "two", 100).otherwise(0))
    got = gc.terrain_corrected(image, ground, orbits, ["product"], "value", first, line, near, spacing).collect()
    want = {(r["product"], r["row"], r["col"]): ((r["azimuth_time"] - first) / line, (r["slant_range"] - near) / spacing) for r in placed.collect()}
    assert len(got) == 1200 and sum(r["value"] is not None for r in got) > 600
    for r in got:
        y, x = want[r["product"], r["row"], r["col"]]
        assert abs(r["y"] - y) + abs(r["x"] - x) < 1e-9
        if 0 <= y <= 39 and 0 <= x <= 59:
            assert abs(r["value"] - (2 * y - 0.5 * x + (100 if r["product"] == "two" else 0))) < 1e-6
        else:
            assert r["value"] is None
    flat = gc.ellipsoid_corrected(image, ground.drop("height"), orbits, ["product"], "value", first, line, near, spacing, height=0.0).collect()
    moved = {(r["product"], r["row"], r["col"]): r["x"] for r in flat}
    assert min(moved[k] - want[k][1] for k in moved) * spacing > 50  # heights come nearer to the sensor


def test_radar_pixels_on_an_elevation_model(spark, orbits):
    """Pixels go to the ground by rounds and come back to their own times and ranges; the second orbit sees them in its own."""
    lat0, lon0, step = 46.2, 12.5, 0.004
    wave = lambda x, k: F.sin(k * F.radians(x) * 20)
    elevation = spark.range(600 * 600).selectExpr("cast(id div 600 as int) AS row", "cast(id % 600 as int) AS col")
    elevation = elevation.withColumn("height", 75 + 50 * wave(lat0 - F.col("row") * step, 40) * F.cos(35 * F.radians(lon0 + F.col("col") * step) * 20)).cache()
    pixels = spark.createDataFrame([("one", r, c, -4.0 + r * 0.5, 760000.0 + c * 2000.0) for r in range(8) for c in range(10)], "product string, row int, col int, azimuth_time double, slant_range double")
    found = gc.geocoded_pixels(pixels, orbits, ["product"], elevation, lat0, lon0, -step, step, rounds=4).cache()
    rows = found.collect()
    assert len(rows) == 80
    again = gc.radar_positions(found.withColumnsRenamed({"azimuth_time": "t0", "slant_range": "r0"}), orbits, ["product"]).collect()
    assert max(abs(r["azimuth_time"] - r["t0"]) / LINE + abs(r["slant_range"] - r["r0"]) / SPACING for r in again) < 1e-3
    heights = gc.with_heights(found.withColumnRenamed("height", "h0"), elevation, lat0, lon0, -step, step).collect()
    assert max(abs(r["height"] - r["h0"]) for r in heights) < 0.1
    second = gc.radar_positions(found.drop("azimuth_time", "slant_range").withColumn("product", F.lit("two")), orbits, ["product"]).collect()
    for r in second[::9]:
        t, slant = exact(ecef(r["lat"], r["lon"], r["height"]), TILTS["two"])
        assert abs(r["azimuth_time"] - t) / LINE < 1e-3 and abs(r["slant_range"] - slant) / SPACING < 1e-3


def test_simulated_image_of_flat_and_sloping_ground(spark, orbits):
    def grid(slope):
        rows = [("one", r, c, 45.05 - r * 0.0009, 13.5 + c * 0.00127, slope * c * 100.0) for r in range(12) for c in range(12)]
        return spark.createDataFrame(rows, "product string, row int, col int, lat double, lon double, height double")

    first, line, near, spacing = -40.0, 1.0, 600000.0, 1e6  # one pixel a line sees everything
    sums = {}
    for slope in (-0.2, 0.0, 0.2):
        got = gc.simulated_image(grid(slope), orbits, ["product"], 100.0, first, line, near, spacing).collect()
        assert sum(r["n"] for r in got) == 121
        sums[slope] = sum(r["value"] for r in got) / 121
    cosine = []
    for r in range(0, 11, 5):
        p = ecef(45.05 - r * 0.0009, 13.5 + 0.006, 0.0)
        t, slant = exact(p, TILTS["one"])
        up = np.array([math.cos(math.radians(45.05)) * math.cos(math.radians(13.506)), math.cos(math.radians(45.05)) * math.sin(math.radians(13.506)), math.sin(math.radians(45.05))])
        cosine.append(float((circular(t, TILTS["one"])[0][0] - p) @ up / slant))
    c = np.mean(cosine)
    want = 0.0133 * c / (math.sqrt(1 - c * c) + 0.1 * c) ** 3
    assert abs(sums[0.0] / want - 1) < 0.02
    # the sensor lies to the west: ground that falls to the west faces it
    assert sums[0.2] > 1.3 * sums[0.0] > 1.3 * sums[-0.2]


def test_steps_of_recipes(spark, ground, orbits):
    from echograin.plans import recipes

    image = spark.range(40).selectExpr("'one' AS product", "cast(id as int) AS row").crossJoin(spark.range(60).selectExpr("cast(id as int) AS col")).withColumns({"i": F.col("row") * 2.0, "q": F.col("col") * 1.0})
    place = {"first_time": -15.0, "line_time": 1.0, "near_range": 700000.0, "spacing": 5000.0}
    own = ground.where("product = 'one'")
    aside = {"ground": own, "orbits": orbits}
    got = recipes.run(image, [recipes.back_geocode("ground", "orbits", ["product"], ["i", "q"], **place)], **aside).collect()
    assert len(got) == 600 and all(r["i"] is None or abs(r["i"] / 2 - r["y"]) < 1e-9 and abs(r["q"] - r["x"]) < 1e-9 for r in got) and any(r["i"] is not None for r in got)
    one = recipes.run(image, recipes.from_json('[{"terrain_correct": {"ground": "ground", "orbits": "orbits", "keys": ["product"], "band": "q", "first_time": -15.0, "line_time": 1.0, "near_range": 700000.0, "spacing": 5000.0}}]'), **aside)
    assert {(r["row"], r["col"]): r["q"] for r in one.collect()} == {(r["row"], r["col"]): r["q"] for r in got}
    flat = recipes.run(image, [recipes.ellipsoid_correct("ground", "orbits", ["product"], "q", **place, height=50.0)], ground=own.drop("height"), orbits=orbits).collect()
    assert len(flat) == 600 and all(r["height"] == 50.0 for r in flat)
