"""GeoTIFF strips by ranges, plans of stages, and fills of rasters by vectors and tiles of elevation."""

import struct
import zlib

import numpy as np
import pytest

from echograin.plans import stages
from echograin.sources import grids


def striped(a: np.ndarray, rows: int, deflate: bool, order: str = "<") -> bytes:
    """A TIFF image of one band in strips of some rows."""
    strips = [a[r : r + rows].astype(order + "i2").tobytes() for r in range(0, len(a), rows)]
    strips = [zlib.compress(s) for s in strips] if deflate else strips
    head = 8
    places = [head + sum(map(len, strips[:k])) for k in range(len(strips))]
    lists = struct.pack(f"{order}{len(strips)}I", *places), struct.pack(f"{order}{len(strips)}I", *map(len, strips))
    body = b"".join(strips)
    at = [head + len(body), head + len(body) + len(lists[0])]
    tags = [(256, 3, 1, a.shape[1]), (257, 3, 1, a.shape[0]), (258, 3, 1, 16), (259, 3, 1, 8 if deflate else 1), (273, 4, len(strips), at[0]), (277, 3, 1, 1), (278, 3, 1, rows), (279, 4, len(strips), at[1]), (339, 3, 1, 2)]
    entries = b"".join(struct.pack(f"{order}HHI", t, k, n) + (struct.pack(f"{order}HH", v, 0) if k == 3 else struct.pack(f"{order}I", v)) for t, k, n, v in tags)
    directory = at[1] + len(lists[1])
    return (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, directory) + body + b"".join(lists) + struct.pack(f"{order}H", len(tags)) + entries + b"\0\0\0\0"


@pytest.mark.parametrize(("deflate", "order"), [(True, "<"), (False, ">")])
def test_strips_are_read_by_ranges(spark, tmp_path, monkeypatch, deflate, order):
    monkeypatch.setattr(grids, "STRIP_BYTES", 300)
    images = {name: np.random.default_rng(k).integers(-900, 900, (61 + k, 37)) for k, name in enumerate(("a.tif", "b.tif"))}
    for name, a in images.items():
        (tmp_path / name).write_bytes(striped(a, 7, deflate, order))
    for whole in (False, True):
        got = {(r["path"].split("/")[-1], r["row"], r["col"]): r["value"] for r in grids.read_geotiff(spark, str(tmp_path), whole).collect()}
        assert len(got) == sum(a.size for a in images.values())
        assert all(got[name, *k] == a[k] for name, a in images.items() for k in np.ndindex(a.shape))
    info = {r["path"].split("/")[-1]: (r["height"], r["width"], r["x0"]) for r in grids.geotiff_info(spark, str(tmp_path)).collect()}
    assert info == {"a.tif": (61, 37, None), "b.tif": (62, 37, None)}


def test_plans():
    assert stages.tops_split(1).name == "topsar_split_applyorbit" and stages.tops_split(3) == stages.plan("topsar_assemble_split_applyorbit")
    assert stages.tops_pair(1, 1, True).name == "topsar_coreg_ifg_subset_no_esd_ext_dem" and "enhanced_spectral_diversity" not in stages.tops_pair(1, 1).stages
    assert stages.tops_pair(2, 4).stages == ("back_geocoding", "enhanced_spectral_diversity", "deburst", "interferogram", "deburst") and stages.tops_pair(1, 4).stages[-2:] == ("topo_phase_removal", "subset")
    assert stages.tops_export(1, True).name == "topsar_export" and stages.tops_export(2, True).name == "topsar_export_mergeiw_subset_ext_dem" and stages.tops_export(2).takes == stages.MULTI
    assert stages.strip_pair(True).name == "stripmap_dem_assisted_coregistration_ext_dem" and stages.strip_interferogram().stages == ("interferogram", "topo_phase_removal")
    assert len(stages.names()) == 19 and len(stages.names("stripmap")) == 6 and stages.plan("stripmap_export").takes == stages.PAIR
    for bad in (lambda: stages.tops_split(0), lambda: stages.tops_pair(1, 0), lambda: stages.tops_export(0)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(LookupError, match="stripmap_subset"):
        stages.plan("nothing")
    assert stages.missing_for_export(["Phase_ifg_VV_x", "elevation", "orthorectifiedLat", "orthorectifiedLon"]) == []
    assert stages.missing_for_export(["i_ifg", "my_elevation", "latitude", "plateau_lon"]) == ["Phase_ifg_*", "elevation", "orthorectified latitude/longitude"]
    assert stages.missing_for_export(["lat", "lon"], phase=False, elevation=False) == []


# vectors


def even_odd(rings, r, c):
    x, y, inside = c + 0.5, r + 0.5, False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay <= y) != (by <= y) and ax + (y - ay) * (bx - ax) / (by - ay) <= x:
                inside = not inside
    return inside


def test_polygons_by_scan_lines(spark):
    from echograin.operators import vectors

    rng, h, w = np.random.default_rng(2), 30, 41
    star = [(20 + 18 * float(np.cos(4 * np.pi * k / 5)), 15 + 14 * float(np.sin(4 * np.pi * k / 5))) for k in range(5)]
    polygons = {"square": [[(3.0, 2.0), (9.0, 2.0), (9.0, 6.0), (3.0, 6.0), (3.0, 2.0)]], "hole": [[(1.0, 1.0), (40.0, 1.0), (40.0, 29.0), (1.0, 29.0)], [(10.2, 5.3), (30.1, 6.0), (20.7, 25.5)]], "star": [star], "over": [[(-50.0, -9.0), (90.0, 10.0), (17.0, 70.0)]], "line": [[(1.0, 1.0), (5.0, 5.0)]], "away": [[(100.0, 3.0), (120.0, 3.0), (110.0, 9.0)]]}
    polygons |= {f"r{k}": [[(float(x), float(y)) for x, y in rng.uniform(-5, 45, (7, 2))]] for k in range(6)}
    df = spark.createDataFrame([(k, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for k, rings in polygons.items()], "name string, rings array<array<struct<x: double, y: double>>>")
    got = [tuple(r) for r in vectors.rasterized(df, ["name"], "rings", h, w).select("name", "row", "col").collect()]
    want = {(k, r, c) for k, rings in polygons.items() if len(rings[0]) > 2 for r in range(h) for c in range(w) if even_odd(rings, r, c)}
    assert len(got) == len(set(got)) and set(got) == want
    assert {k for k, *_ in got} >= {"square", "hole", "star", "over"} and sum(k == "square" for k, *_ in got) == 24
    image = spark.range(h * w).selectExpr("'hole' AS name", f"cast(id div {w} as int) AS row", f"cast(id % {w} as int) AS col")
    burned = vectors.burned(image, df, ["name"], "rings", h, w).collect()
    assert len(burned) == h * w and all(r["inside"] == (("hole", r["row"], r["col"]) in want) for r in burned)


def test_tie_points_there_and_back(spark):
    from echograin.operators import vectors

    step_r, step_c = 10.0, 15.0
    where = lambda r, c: (45 - 0.01 * r + 0.002 * c + 1e-5 * r * c / 50, 10 + 0.013 * c + 0.003 * r - 2e-5 * c * r / 40)
    points = [("p", i, j, i * step_r, j * step_c, *where(i * step_r, j * step_c)) for i in range(5) for j in range(4)]
    ties = spark.createDataFrame(points, "product string, i int, j int, row double, col double, lat double, lon double")
    pixels = spark.createDataFrame([("p", r, c) for r in range(0, 41, 3) for c in range(0, 46, 4)] + [("q", 0, 0)], "product string, row int, col int")
    ground = vectors.placed_on_ground(pixels, ties, ["product"], step_r, step_c)
    rows = {(r["product"], r["row"], r["col"]): (r["lat"], r["lon"]) for r in ground.collect()}
    assert rows["q", 0, 0] == (None, None) and all(np.allclose(rows["p", r, c], where(r, c), atol=1e-12) for k, r, c in rows if k == "p")
    more = ground.withColumnsRenamed({"row": "r0", "col": "c0"})
    back = vectors.placed_in_image(more, ties, ["product"], 0.1).collect()
    assert len(back) == len(rows) and all(abs(r["y"] - r["r0"]) < 1e-6 and abs(r["x"] - r["c0"]) < 1e-6 for r in back if r["product"] == "p")
    away = vectors.placed_in_image(spark.createDataFrame([("p", 50.0, 10.0), ("p", 44.99, 9.99)], "product string, lat double, lon double"), ties, ["product"], 0.1).collect()
    assert [r["y"] for r in away] == [None, None]


def test_elevation_over_tile_borders(spark):
    from pyspark.sql import functions as F

    from echograin.operators import geocoding, vectors

    n = 20
    height = lambda lat, lon: 100 + 30 * np.sin(lat * 3) + 20 * np.cos(lon * 4)
    rows = []
    for lat0, lon0, priority in ((45, 10, 1), (45, 11, 0), (44, 10, 2), (44, 11, 3)):
        for r in range(n + 1):  # edges are in both neighbours
            for c in range(n + 1):
                wrong = 50.0 if priority and (c == n or r == 0) and lon0 == 10 and lat0 == 45 and c == n else 0.0
                value = -32768.0 if (lat0, lon0, r, c) == (44, 10, 3, 4) else float(height(lat0 + 1 - r / n, lon0 + c / n)) + wrong
                rows.append((lat0, lon0, r, c, value, priority))
    tiles = spark.createDataFrame(rows, "lat0 int, lon0 int, row int, col int, height double, priority int").repartition(5)
    model = vectors.elevation_model(tiles, n, -32768.0)
    assert model.count() == (2 * n + 1) ** 2 - 1
    at = spark.createDataFrame([(45.013, 10.98), (44.99, 11.002), (45.0, 11.0), (44.975, 10.31), (44.86, 10.21), (30.0, 10.0)], "lat double, lon double")
    got = {(r["lat"], r["lon"]): r["height"] for r in geocoding.with_heights(at, model.withColumn("height", F.col("height")), 90.0, -180.0, -1 / n, 1 / n).collect()}
    for (lat, lon), h in got.items():
        if lat == 30.0 or (lat, lon) == (44.86, 10.21):  # no tile, and beside the missing height
            assert h is None
            continue
        y, x = (90 - lat) * n, (lon + 180) * n
        r0, c0 = np.floor(y + 1e-9), np.floor(x + 1e-9)
        v, u = y - r0, x - c0
        corner = lambda i, j: height(90 - (r0 + i) / n, (c0 + j) / n - 180)  # noqa: B023, E731
        want = (1 - v) * ((1 - u) * corner(0, 0) + u * corner(0, 1)) + v * ((1 - u) * corner(1, 0) + u * corner(1, 1))
        assert abs(h - want) < 1e-6
