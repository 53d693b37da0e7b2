"""Hulls, manifests, annotations and bounding polygons."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echograin.operators import footprints as fp
from echograin.sources import hdf5


def test_hulls_in_any_deal(spark):
    rng = np.random.default_rng(3)
    data, want = [], {}
    for k in range(6):
        p = rng.normal(size=(200, 2)) if k else np.array([(x, y) for x in range(5) for y in range(4)], float)
        data += [(k, float(x), float(y)) for x, y in np.concatenate([p, p[:9]])]
        c = p.mean(0)
        # a point is a corner if some half plane has it alone at its edge: the extremes over many directions
        turns = np.stack([np.cos(np.linspace(0, 2 * np.pi, 20001)), np.sin(np.linspace(0, 2 * np.pi, 20001))])
        want[k] = {tuple(p[i]) for i in np.unique(np.argmax((p - c) @ turns, 0))} if k else {(0, 0), (4, 0), (4, 3), (0, 3)}
    data += [(8, 1.0, 2.0), (8, 2.0, 4.0), (8, 3.0, 6.0), (9, None, 1.0), (7, float("nan"), 0.0), (7, 5.0, 5.0)]
    for parts in (1, 13):
        df = spark.createDataFrame(data, "k int, x double, y double").repartition(parts)
        got = {r["k"]: r["ring"] for r in fp.convex_hull(df, ["k"], "x", "y").collect()}
        assert sorted(got) == [0, 1, 2, 3, 4, 5, 7, 8] and got[8] is None and got[7] is None
        for k, corners in want.items():
            ring = [(p["x"], p["y"]) for p in got[k]]
            assert ring[0] == ring[-1] and set(ring) == corners and len(ring) == len(corners) + 1
            assert ring[0] == min(ring, key=lambda p: (p[1], p[0]))
            assert sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) < 0
    square = fp.convex_hull(df.where("k = 0"), ["k"], "x", "y").select(fp.ring_wkt(F.col("ring")), fp.ring_area(F.col("ring"))).first()
    assert square[0] == "POLYGON ((0 0, 0 3, 4 3, 4 0, 0 0))" and square[1] == 12


def manifest(*rings, tag="coordinates"):
    inner = "".join(f"<safe:footPrint><gml:{tag}>{r}</gml:{tag}></safe:footPrint>" for r in rings)
    return f'<x xmlns:safe="http://www.esa.int/safe/sentinel-1.0" xmlns:gml="http://www.opengis.net/gml">{inner}</x>'


def test_manifests(spark):
    one = manifest("45.5,10 45,10.5 44,10 44.5,9.25")
    data = [("one", one), ("list", manifest("45 10 45 11 44 11 45 10", tag="posList")), ("two", manifest("0,0 0,1 1,1 1,0", "0,3 1,3 1,4")), ("none", "<x/>"), ("short", manifest("1,2 3,4")), ("bad", "<x"), ("null", None)]
    df = spark.createDataFrame(data, "path string, value string")
    got = {r[0]: r[1] for r in fp.manifest_footprints(df).select("path", fp.ring_wkt(F.col("ring"))).collect()}
    assert got["one"] == "POLYGON ((10 45.5, 10.5 45, 10 44, 9.25 44.5, 10 45.5))" and got["list"] == "POLYGON ((10 45, 11 45, 11 44, 10 45))"
    assert got["two"] == "POLYGON ((0 0, 0 1, 4 1, 3 0, 0 0))" and [got[k] for k in ("none", "short", "bad", "null")] == [None] * 4
    swapped = fp.manifest_footprints(df.where("path = 'list'"), latitude_first=False).select(fp.ring_wkt(F.col("ring"))).first()[0]
    assert swapped == "POLYGON ((45 10, 45 11, 44 11, 45 10))"


def annotation(points):
    return "<product><geolocationGrid>" + "".join(f"<geolocationGridPoint><line>{k}</line><pixel>{k}</pixel><latitude>{a}</latitude><longitude>{b}</longitude></geolocationGridPoint>" for k, (a, b) in enumerate(points)) + "</geolocationGrid></product>"


def test_swaths(spark):
    grid = [(45 + i * 0.1, 10 + j * 0.2) for i in range(4) for j in range(5)]
    data = [("/d/P1.SAFE/annotation/s1a-iw1-slc-vv.xml", annotation(grid)), ("/d/P1.SAFE/annotation/s1a-iw1-slc-vh.xml", annotation([(46.0, 10.4)])), ("/d/P1.SAFE/annotation/s1a-iw2-slc-vv.xml", annotation([(0, 0)])), ("/d/P2.SAFE/annotation/s1a-iw1-slc-vv.xml", annotation(grid[:3])[:-20]), ("/d/P3.SAFE/annotation/s1a-IW1.xml", "<a/>")]
    df = spark.createDataFrame(data, "path string, value string")
    got = {r[0]: r[1] for r in fp.swath_footprints(df, "IW1").select("product", fp.ring_wkt(F.col("ring"))).collect()}
    assert got["P1.SAFE"] == "POLYGON ((10 45, 10 45.3, 10.4 46, 10.8 45.3, 10.8 45, 10 45))" and got.get("P2.SAFE") is None and "P3.SAFE" not in got
    points = fp.annotation_points(df).where("path LIKE '%iw1%vv.xml'")
    assert points.count() == 23 and points.where("height IS NULL").count() == 23


@pytest.mark.parametrize("whole", [False, True])
def test_bounding_polygons(spark, tmp_path, whole):
    wkt = "POLYGON ((10.5 45.25 12.0,11 45 -3, 11  44 0 ,10.5 45.25 12.0))"
    (tmp_path / "n.h5").write_bytes(hdf5.hdf5_bytes({"science/LSAR/identification/boundingPolygon": np.array(wkt.encode()), "science/LSAR/identification/other": np.array([b"a", b"b"])}))
    got = hdf5.read_h5_texts(spark, str(tmp_path), "identification/", whole).select("name", fp.flat_wkt(F.col("value"))).collect()
    assert [tuple(r) for r in got] == [("science/LSAR/identification/boundingPolygon", "POLYGON ((10.5 45.25, 11 45, 11 44, 10.5 45.25))")]
