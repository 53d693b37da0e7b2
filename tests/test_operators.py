"""Operators against numpy and small cases."""

import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from echograin.functions import geo, products
from echograin.functions import packets as pk
from echograin.operators import classifiers, kernels, polarimetry, relational
from echograin.operators import tile_checks as tc
from echograin.operators import image_stats as st
from echograin.operators import neighbourhoods as nb
from echograin.plans import recipes
from echograin.sources import grids, readers
from echograin.streaming import windows


def raster(spark, a):
    rows = [(0, int(i), int(j), float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])]
    return spark.createDataFrame(rows, "tile int, r int, c int, v double")


def as_array(df, shape, value):
    out = np.full(shape, np.nan)
    for x in df.collect():
        out[x["r"], x["c"]] = x[value]
    return out


@pytest.mark.parametrize("size", [3, 4, 5])
def test_box_mean_repeats_edges(spark, size):
    a = np.random.default_rng(0).normal(size=(9, 7))
    half = size // 2
    p = np.pad(a, ((half, size - 1 - half), (half, size - 1 - half)), "edge")
    want = np.array([[p[i : i + size, j : j + size].mean() for j in range(7)] for i in range(9)])
    assert np.allclose(as_array(nb.box_mean_2d(raster(spark, a), ["tile"], "r", "c", ["v"], size), a.shape, "v"), want)


def test_unwrap_is_numpy(spark):
    p = np.angle(np.exp(1j * np.cumsum(np.random.default_rng(1).normal(0, 2, 200))))
    df = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(p)], "k int, i int, p double")
    got = [r[0] for r in nb.unwrap_phase(df, ["k"], ["i"], "p").orderBy("i").select("unwrapped").collect()]
    assert np.allclose(got, np.unwrap(p))


def test_fft_2d_is_numpy(spark):
    a = np.random.default_rng(2).normal(size=(6, 5))
    df = raster(spark, a).select("tile", "r", "c", F.col("v").alias("re"), F.lit(0.0).alias("im"))
    out = kernels.fft_2d(df, ["tile"], "r", "c", "re", "im")
    assert np.allclose(as_array(out, a.shape, "re") + 1j * as_array(out, a.shape, "im"), np.fft.fft2(a))


def test_looks_add_up(spark):
    a = np.random.default_rng(3).normal(size=(2, 12))
    df = raster(spark, a).select("tile", "r", "c", F.col("v").alias("re"), F.lit(0.0).alias("im"))
    looks = kernels.sublooks(df, ["tile"], "r", "c", "re", "im", 3).withColumn("re", F.col("re") / 3**0.5)
    assert np.allclose(as_array(looks.groupBy("r", "c").agg(F.sum("re").alias("v")), a.shape, "v"), a)


def test_compression_peaks_at_the_echo(spark):
    chirp = kernels.chirp(1e-5, 1e12, 0.0, 2e7)
    line = np.zeros(512, complex)
    line[100 : 100 + len(chirp)] = chirp
    df = spark.createDataFrame([(line.real.tolist(), line.imag.tolist())], "re array<double>, im array<double>")
    z = df.select(kernels.pulse_compressed(chirp)(F.col("re"), F.col("im")).alias("z")).first()["z"]
    assert np.argmax(np.hypot(z["re"], z["im"])) == 100


def test_a_point_is_focused(spark):
    """Echoes of one point, with its range migration, come together in one pixel."""
    from echograin.operators import focusing

    height, width, fs, prf, wave, v, near = 128, 128, 20e6, 300.0, 0.03, 100.0, 5000.0
    c = 299792458.0
    replica = kernels.chirp(2e-6, 5e12, -5e6, fs)
    at_row, at_col = 64, 50
    r0 = near + at_col * c / (2 * fs)
    raw = np.zeros((height, width), complex)
    t = np.arange(width) / fs
    for k in range(height):
        eta = (k - at_row) / prf
        r = np.hypot(r0, v * eta)
        delay = 2 * (r - near) / c
        u = t - delay - 1e-6  # the pulse is centred half its length after its start
        on = np.abs(u) <= 1e-6
        raw[k] = on * np.exp(2j * np.pi * ((-5e6 + 5e12 * 1e-6) * u + 2.5e12 * u * u)) * np.exp(-4j * np.pi * r / wave)
    rows = [(0, int(i), int(j), float(raw[i, j].real), float(raw[i, j].imag)) for i in range(height) for j in range(width)]
    df = spark.createDataFrame(rows, "tile int, r int, c int, re double, im double")
    stages = focusing.focus_stages(df, ["tile"], "r", "c", "re", "im", height, width, replica, fs, prf, wave, v, near)
    assert list(stages) == ["compressed", "migrated", "focused"]
    image = np.abs(as_array(stages["focused"], raw.shape, "re") + 1j * as_array(stages["focused"], raw.shape, "im"))
    peak = np.unravel_index(image.argmax(), image.shape)
    assert abs(peak[0] - at_row) <= 1 and abs(peak[1] - at_col) <= 1
    assert image.max() > 20 * np.median(image)
    assert [f[2] for f in focusing.look_frequencies(3, 300.0)] == [-100.0, 0.0, 100.0] and focusing.energy_scale(50, 2) == 5.0


def test_images_on_other_grids(spark):
    """A plane is a plane on every grid; a shift that offsets find is taken back."""
    from echograin.operators import geometry, product_ops

    a = np.add.outer(3.0 * np.arange(40), 2.0 * np.arange(50))
    image = raster(spark, a).drop("tile")
    got = geometry.shifted_onto(image, "r", "c", "v", 40, 50, 1.5, -2.25)
    back = as_array(got, a.shape, "v")
    assert np.allclose(back[:38, 3:], (a + 4.5 - 4.5)[:38, 3:]) and np.isnan(back[39]).all() and np.isnan(back[:, 0]).all()
    ground = as_array(geometry.ground_range(image, "r", "c", "v", 40, 20, 1000.0, 10.0, 800.0, 20.0), (40, 20), "v")
    slant = np.hypot(np.sqrt(1000.0**2 - 800.0**2) + 20.0 * np.arange(20), 800.0)
    assert np.allclose(ground[5], 15 + 2 * (slant - 1000) / 10)
    # degrees to metres and the same place back
    lat0, lon0, step = 45.0, 9.5, 0.001
    east, north = geo.utm_forward(F.lit(lat0 - 0.02), F.lit(lon0 + 0.02), F.lit(32))
    e, n = spark.range(1).select(east, north).first()
    utm = as_array(geometry.reprojected(image, "r", "c", "v", 32, False, (e, n), (50.0, 50.0), (3, 3), lon0, lat0, step, -step), (3, 3), "v")
    assert np.isclose(utm[0, 0], 3 * 20 + 2 * 20, atol=1e-3) and utm[0, 1] > utm[0, 0] and utm[1, 0] > utm[0, 0]
    rng = np.random.default_rng(4)
    b = rng.normal(size=(32, 32))
    both = raster(spark, b).join(raster(spark, np.roll(b, (2, -3), (0, 1))).withColumnRenamed("v", "w"), ["tile", "r", "c"]).select("tile", "r", "c", F.col("v").alias("a"), F.col("w").alias("b"))
    assert geometry.common_shift(product_ops.offsets(both, ["tile"], "r", "c")) == (2.0, -3.0)
    with pytest.raises(ValueError, match="method"):
        geometry.shifted_onto(image, "r", "c", "v", 4, 4, 0, 0, "cubic")


def test_summaries(spark):
    from echograin.operators import summaries as sm

    files = spark.createDataFrame([(f"/x/IW1/L3_W5/p_TC.data/{n}",) for n in ("coh_VV.tif", "cov_VH.tif", "lat.tif", "coh_VV_old.tif", "coh_VV.tif")], "path string")
    got = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["left_out"], r["settings"]["lookset"], r["settings"]["pol"]) for r in sm.selected_paths(files, [".tif"], ["old"]).collect()}
    assert got == {"coh_VV.tif": ("coherence", None, "L3", "VV"), "cov_VH.tif": ("covariance", None, "L3", "VH"), "lat.tif": ("other", "kind other", "L3", None)}
    bands = spark.createDataFrame([("s", b) for b in ("i_IW1_VV_SA1", "q_IW1_VV_SA1", "i_IW1_VV_SA2", "q_IW1_VV_SA2", "i_IW1_VV_SA3", "i_VH_SA1", "q_VH_SA1", "Sigma0")], "lookset string, band string")
    assert [tuple(r) for r in sm.look_sets(bands).collect()] == [("s", "IW1", "VV", [1, 2])]
    with pytest.raises(ValueError, match="mean_nmi"):
        sm.known_settings(spark.createDataFrame([("a",)], "kind string"))
    fails = spark.createDataFrame([(i,) for i in range(9)], "tile int")
    assert [tuple(r) for r in sm.issue_lines(fails, ["tile"], 2).collect()] == [(0, 7), (1, 7)]
    ring = [{"lon": 0.0, "lat": 0.0}]
    layers = sm.status_layers(spark.createDataFrame([("a", "success"), ("b", "odd"), ("c", "failed")], "tile string, status string"), spark.createDataFrame([("a", ring), ("b", ring), ("c", None)], "tile string, ring array<struct<lon: double, lat: double>>"))
    assert sorted((r["layer"], r["tile"]) for r in layers.collect()) == [("other", "b"), ("success", "a")]
    a = np.arange(30.0).reshape(5, 6)
    assert np.array_equal(as_array(sm.core(raster(spark, a), "r", "c", 1, 2, 3, 3), (3, 3), "v"), a[1:4, 2:5])


def test_mean_discrepancy_is_its_formula(spark):
    from echograin.operators import domain_losses as dl

    rng = np.random.default_rng(6)
    centres = (np.arange(16) + 0.5) / 16
    p, t = rng.choice(centres, 60), rng.choice(centres[8:], 60)
    p[0], t[0] = 0.0, 1.0  # the ends of the range
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, t, strict=True)], "p double, t double")
    near = lambda x: (np.minimum(15, np.floor(x * 16)) + 0.5) / 16
    x, y = near(p), near(t)
    k = lambda a, b: np.exp(-np.abs(a[:, None] - b[None, :]) / 0.5)
    want = (k(x, x).sum() - 60) / (60 * 59) + (k(y, y).sum() - 60) / (60 * 59) - 2 * k(x, y).mean()
    assert np.isclose(dl.mean_discrepancy(df, [], "p", "t", 0.5, 16, "laplacian").first()["loss"], want)
    with pytest.raises(ValueError, match="odd"):
        dl.line_similarity_loss(df, [], "p", "p", "t", 4)
    same = spark.createDataFrame([(0, i, float(i % 5), 0.5) for i in range(40)], "k int, i int, re double, im double")
    assert abs(dl.similarity_combined(same, ["k"], "i", ["re", "im", "re", "im"]).first()["loss"]) < 1e-3


def test_grids_and_products_together(spark):
    from echograin.operators import grid_ops as go

    a = spark.createDataFrame([(0, 0, 1.0, 9.0), (0, 1, 2.0, 9.0)], "row int, col int, i double, q double")
    b = spark.createDataFrame([(0, 0, 5.0, 7.0), (0, 1, 6.0, 8.0)], "row int, col int, q double, z double")
    assert sorted(map(tuple, go.bands_added(a, b, ["row", "col"], ["q", "z"]).collect())) == [(0, 0, 1.0, 5.0, 7.0), (0, 1, 2.0, 6.0, 8.0)]
    with pytest.raises(ValueError, match="grids differ"):
        go.bands_added(a, b.where("col = 0"), ["row", "col"], ["z"])
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    boxes = spark.createDataFrame([("in", 1.0, 1.0, 2.0, 2.0), ("around", -1.0, -1.0, 9.0, 9.0), ("cross", -1.0, 1.0, 5.0, 2.0), ("touch", 4.0, 1.0, 5.0, 2.0), ("out", 4.5, 1.0, 5.0, 2.0)], "n string, x0 double, y0 double, x1 double, y1 double")
    got = boxes.where(go.box_meets_ring(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], ring)).select("n").collect()
    assert {r["n"] for r in got} == {"in", "around", "cross", "touch"}
    t = spark.range(1).select(go.pixel_transform(F.struct(F.lit(10.0).alias("min_x"), F.lit(20.0).alias("min_y"), F.lit(110.0).alias("max_x"), F.lit(70.0).alias("max_y")), 50, 25)).first()[0]
    assert tuple(t) == (10.0, 2.0, 70.0, -2.0)
    box = spark.range(1).select(go.cell_box(F.lit(45.0), F.lit(9.0), F.lit(32))).first()[0]
    assert np.isclose(box["min_x"], 500000.0) and np.isclose(box["max_y"] - box["min_y"], 10000.0)
    names = spark.range(1).select(go.expected_bands(F.array(F.lit("b"), F.lit("a"), F.lit("b")), F.array(F.lit("z"))), go.expected_bands(F.array().cast("array<string>"), F.array(F.lit("z")))).first()
    assert names[:] == (["a", "b"], ["z"])
    rows = go.by_rows(spark.createDataFrame([(1, 3.0), (1, -2.0), (2, 0.0)], "row int, lon double")).collect()
    assert sorted(map(tuple, rows)) == [(1, 2, -2.0, 3.0), (2, 1, 0.0, 0.0)]


def test_pair_workflow(spark):
    """A shifted image with a phase ramp is brought back, its interferogram is the ramp, and the coherence near 1."""
    from echograin.plans import workflows

    rng = np.random.default_rng(9)
    z = rng.normal(size=(64, 64)) + 1j * rng.normal(size=(64, 64))
    ramp = np.exp(0.01j * np.arange(64))[None, :]
    other = np.roll(z * ramp, (3, -2), (0, 1))
    image = lambda a: spark.createDataFrame([(i, j, float(a[i, j].real), float(a[i, j].imag)) for i in range(64) for j in range(64)], "row int, col int, i double, q double")
    got = workflows.pair_workflow(image(z), image(other), 64, 64)
    phase = {(r["row"], r["col"]): r["phase"] for r in got["interferogram"].collect()}
    assert len(phase) == 61 * 62 and np.allclose([phase[20, c] for c in range(10, 50)], [-0.01 * c for c in range(10, 50)], atol=1e-6)
    assert got["coherence"].where("row between 10 and 50 and col between 10 and 50").agg(F.min("coherence")).first()[0] > 0.99
    smooth = workflows.pair_workflow(image(z), image(other), 64, 64, smooth=1.0)["interferogram"]
    assert smooth.columns == ["row", "col", "re", "im", "phase"]


def test_tiles_and_swaths(spark):
    from echograin.plans import recipes, workflows

    a = np.arange(1.0, 101.0).reshape(10, 10)
    a[0, 0] = 0
    image = raster(spark, a).withColumnsRenamed({"r": "row", "c": "col"}).drop("tile")
    tiles = spark.createDataFrame([("a", 0, 0, 4, 4), ("b", 3, 5, 4, 4), ("c", 8, 8, 4, 4), ("d", 40, 0, 4, 4)], "tile string, row0 int, col0 int, height int, width int")
    cut = workflows.cut_into_tiles(image, tiles, ["v"])
    assert np.array_equal(as_array(cut.where("tile = 'b'").withColumnsRenamed({"row": "r", "col": "c"}), (4, 4), "v"), a[3:7, 5:9])
    assert {r["tile"]: (r["pixels"], r["valid"], r["status"]) for r in workflows.tile_outcomes(cut, tiles, "v").collect()} == {"a": (16, 15, "partial"), "b": (16, 16, "success"), "c": (4, 4, "partial"), "d": (0, 0, "skipped")}
    product = spark.createDataFrame([("IW1", 2.0), ("IW2", 3.0), ("IW3", 4.0)], "swath string, amplitude double")
    got = workflows.by_swath(product, ["IW1", "IW3"], [recipes.calibrate("amplitude", 1.0, "s")])
    assert sorted((r["swath"], r["s"]) for r in got.collect()) == [("IW1", 4.0), ("IW3", 16.0)]
    assert workflows.export_problems({"x": product})["x"] == ["i", "q", "height", "lat", "lon"]


def test_asof_over_ranges_and_null_keys(spark):
    rng = np.random.default_rng(12)
    left = [(k, int(t)) for k in (None, "a") for t in rng.integers(0, 1000, 300)]
    right = [(k, int(t), float(t) / 10) for k in (None, "a", "b") for t in sorted(set(rng.integers(200, 900, 40).tolist()))]
    got = nb.asof_join(spark.createDataFrame(left, "k string, t int"), spark.createDataFrame(right, "k string, u int, v double"), ["k"], "t", "u", "v", "last").collect()
    for r in got:
        known = [v for k, u, v in right if k == r["k"] and u <= r["t"]]
        assert r["last"] == (max(known) if known else None)
    assert len(got) == len(left)
    one = nb.without_mean(spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, v double"), ["k"], "v").collect()
    assert sorted(r["detrended"] for r in one) == [-1.0, 0.0, 1.0]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    import sys

    from echograin.__main__ import main

    spark.createDataFrame([(2.0,)], "amplitude double").write.parquet(str(tmp_path / "in"))
    monkeypatch.setattr(sys, "argv", ["echograin", "recipe", "json", str(tmp_path / "in"), str(tmp_path / "out"), "--json", '[{"calibrate": {"band": "amplitude", "gain": 1.0, "out": "s"}}]'])
    main()
    assert spark.read.parquet(str(tmp_path / "out")).first()["s"] == 4.0
    monkeypatch.setattr(sys, "argv", ["echograin", "list"])
    main()
    assert "recipe tops" in capsys.readouterr().out


def test_multiplied_by_an_axis(spark):
    from echograin.operators import focusing

    df = spark.createDataFrame([(0, 0, 1.0, 2.0), (0, 1, 3.0, 4.0)], "r int, c int, re double, im double")
    w = spark.createDataFrame([(0, 0.0, 1.0), (1, 2.0, 0.0)], "c int, w_re double, w_im double")
    assert sorted((x["c"], x["re"], x["im"]) for x in focusing.multiplied(df, w, ["c"], "re", "im").collect()) == [(0, -2.0, 1.0), (1, 6.0, 8.0)]


def test_filters_keep_their_band(spark):
    t = np.arange(256)
    slow, fast = np.sin(2 * np.pi * 0.02 * t), np.sin(2 * np.pi * 0.3 * t)
    df = spark.createDataFrame([((slow + fast).tolist(),)], "x array<double>")
    low, high = df.select(kernels.lowpass(0.1, 1.0)("x"), kernels.highpass(0.1, 1.0)("x")).first()
    assert np.corrcoef(low, slow)[0, 1] > 0.99 and np.corrcoef(high, fast)[0, 1] > 0.99


def test_cfar_finds_the_ship(spark):
    a = np.ones((15, 15))
    a[7, 7] = 50
    hits = nb.cfar(raster(spark, a), ["tile"], "r", "c", "v", 3, 9, 5.0).where("detected").collect()
    assert [(h["r"], h["c"]) for h in hits] == [(7, 7)]


def test_interpolation_holds_the_ends(spark):
    left = spark.createDataFrame([(1, t) for t in (-1.0, 0.5, 2.0, 9.0)], "k int, t double")
    right = spark.createDataFrame([(1, 0.0, 10.0), (1, 1.0, 20.0), (1, 3.0, 40.0)], "k int, u double, v double")
    got = {r["t"]: r["y"] for r in nb.interpolate(left, right, ["k"], "t", "u", "v", "y").collect()}
    assert got == {-1.0: 10.0, 0.5: 15.0, 2.0: 30.0, 9.0: 40.0}


def test_pareto_front_over_partitions(spark):
    rng = np.random.default_rng(4)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 40, size=(300, 2)))]
    got = {r["i"] for r in relational.pareto_front(spark.createDataFrame(pts, "i int, x double, y double").repartition(5), "x", "y").collect()}
    want = {i for i, x, y in pts if not any(u >= x and v >= y and (u > x or v > y) for _, u, v in pts)}
    assert got == want


def test_pairs_of_null_groups(spark):
    rows = [("a", None, 1, 50.0), ("b", None, 2, None), ("c", "x", 5, 90.0), ("d", "x", 4, 10.0), ("e", "y", 9, 99.0)]
    g = relational.select_pairs(spark.createDataFrame(rows, "id string, k string, t int, cov double"), ["k"], "t", "cov", "id")
    assert {(r["k"], r["master"], r["slave"]) for r in g.collect()} == {(None, "b", "a"), ("x", "c", "d")}
    assert relational.best_pair(g).first()["master"] == "c"


def test_packet_samples_and_codes(spark):
    samples = [5, -3, 511, -511, 0, 77]
    bits = "".join(f"{(512 if s < 0 else 0) + abs(s):010b}" for s in samples) + "0000"
    data = int(bits, 2).to_bytes(len(bits) // 8, "big") + b"\0"
    df = spark.createDataFrame([(bytearray(data),)], "b binary")
    assert df.select(pk.bypass_samples(F.col("b"), 6)).first()[0] == samples
    with pytest.raises(Exception, match="range decimation"):
        spark.range(1).select(pk.sample_rate(F.lit(2))).collect()


def test_packet_reader(spark, tmp_path):
    body = bytes(62) + b"abcdef"
    (tmp_path / "x.dat").write_bytes((struct.pack(">HHH", 0x0C1C, 0xC000, len(body) - 1) + body) * 3)
    rows = readers.read_packets(spark, str(tmp_path / "x.dat")).collect()
    assert len(rows) == 3 and bytes(rows[1]["user_data"]) == b"abcdef" and len(rows[2]["secondary"]) == 62


def test_raster_files_round_trip(spark, tmp_path):
    a = np.arange(6, dtype="float32").reshape(2, 3)
    image, header = readers.envi_bytes(a, "i")
    (tmp_path / "x.img").write_bytes(image)
    assert np.array_equal(_band(readers.read_envi(spark, str(tmp_path / "x.img"), readers.envi_header(header)), a.shape), a)
    cells = spark.createDataFrame([("t", "B", i, j, float(a[i, j])) for i in range(2) for j in range(3)], "tile string, band string, row int, col int, value double")
    payload = bytes(readers.tile_payloads(cells, "tile").first()["payload"])
    assert np.array_equal(np.load(io.BytesIO(payload))["B"], a)
    (tmp_path / "x.npz").write_bytes(payload)
    assert np.array_equal(_band(readers.read_npz(spark, str(tmp_path / "x.npz")), a.shape), a)
    assert readers.tile_format("hdf5") == "h5"
    with pytest.raises(ValueError, match="no such"):
        readers.tile_format("png")
    assert readers.tile_format(None) == "npz" and readers.tile_format(" TIFF") == "geotiff"
    assert spark.range(1).select(readers.tile_path("/a/", F.lit("t1"), "tif")).first()[0] == "/a/t1.tif"


@pytest.mark.parametrize("codec", [None, "zlib", "gzip"])
@pytest.mark.parametrize("order", ["C", "F"])
def test_zarr_chunks(spark, tmp_path, codec, order):
    import gzip
    import json
    import zlib

    a = (np.arange(7 * 9).reshape(7, 9) * 1.5).astype("<f4")
    (tmp_path / "z").mkdir()
    about = {"zarr_format": 2, "shape": [7, 9], "chunks": [4, 5], "dtype": "<f4", "fill_value": 0, "order": order, "filters": None, "compressor": codec and {"id": codec, "level": 1}}
    (tmp_path / "z" / ".zarray").write_text(json.dumps(about))
    (tmp_path / "z" / ".zattrs").write_text('{"unit": "1"}')
    for i in range(2):
        for j in range(2):
            chunk = np.zeros((4, 5), "<f4")
            part = a[4 * i : 4 * i + 4, 5 * j : 5 * j + 5]
            chunk[: part.shape[0], : part.shape[1]] = part
            raw = chunk.tobytes(order)
            if (i, j) != (1, 0):  # a chunk that isn't there
                (tmp_path / "z" / f"{i}.{j}").write_bytes({None: lambda x: x, "zlib": zlib.compress, "gzip": gzip.compress}[codec](raw))
    a[4:, :5] = 0
    got = grids.read_zarr(spark, str(tmp_path / "z"))
    assert np.array_equal(_band(got, a.shape), a)
    assert grids.zarr_attributes(spark, str(tmp_path / "z")) == {"unit": "1"}
    about["compressor"] = {"id": "blosc"}
    (tmp_path / "z" / ".zarray").write_text(json.dumps(about))
    with pytest.raises(NotImplementedError, match="blosc"):
        grids.read_zarr(spark, str(tmp_path / "z"))


def test_geotiff_files(spark, tmp_path):
    a, b = np.random.default_rng(1).normal(size=(2, 11, 6)).astype("float32")
    (tmp_path / "x.tif").write_bytes(grids.geotiff_bytes([a, b], (500000.0, 4100000.0), (10.0, 10.0)))
    got = grids.read_geotiff(spark, str(tmp_path / "x.tif"))
    for name, want in (("band_1", a), ("band_2", b)):
        assert np.array_equal(_band(got.where(F.col("band") == name), want.shape), want)
    assert grids.geotiff_info(spark, str(tmp_path / "x.tif")).first()[1:] == (11, 6, 2, 500000.0, 4100000.0, 10.0, -10.0)
    assert grids.geotiff_info(spark, str(tmp_path / "x.tif")).first()[0].endswith("x.tif")
    cells = spark.createDataFrame([("t", "B", i, j, float(a[i, j])) for i in range(11) for j in range(6)], "tile string, band string, row int, col int, value double")
    (tmp_path / "y.tif").write_bytes(bytes(readers.tile_payloads(cells, "tile", "geotiff").first()["payload"]))
    assert np.array_equal(_band(grids.read_geotiff(spark, str(tmp_path / "y.tif")), a.shape), a)


def test_tiff_tiles_predictor_and_byte_order():
    """Big-endian tiles of 16-bit samples side by side, deflated after horizontal differences."""
    import zlib

    a = np.random.default_rng(2).integers(0, 60000, (5, 7, 2)).astype(">u2")
    padded = np.zeros((8, 8, 2), ">u2")
    padded[:5, :7] = a
    blocks = []
    for i in (0, 4):
        for j in (0, 4):
            t = padded[i : i + 4, j : j + 4].astype("u2")
            blocks.append(zlib.compress(np.diff(t, axis=1, prepend=np.zeros((4, 1, 2), "u2")).astype(">u2").tobytes()))
    entries = [(256, 3, (7,)), (257, 3, (5,)), (258, 3, (16, 16)), (259, 3, (8,)), (277, 3, (2,)), (317, 3, (2,)), (322, 3, (4,)), (323, 3, (4,)), (324, 4, None), (325, 4, tuple(map(len, blocks))), (339, 3, (1, 1))]
    start = 8 + 2 + 12 * len(entries) + 4
    at = start + 32
    places = []
    for x in blocks:
        places.append(at)
        at += len(x)
    out, extra = struct.pack(">2sHIH", b"MM", 42, 8, len(entries)), b""
    for tag, kind, v in entries:
        v = tuple(places) if v is None else v
        raw = struct.pack(f">{len(v)}{'H' if kind == 3 else 'I'}", *v)
        out += struct.pack(">HHI", tag, kind, len(v)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(">I", start + len(extra)))
        extra += raw if len(raw) > 4 else b""
    content = out + b"\0" * 4 + extra.ljust(32, b"\0") + b"".join(blocks)
    got = np.zeros((5, 7, 2))
    for band, r, c, x in grids.tiff_blocks(content):
        got[r : r + x.shape[0], c : c + x.shape[1], band] = x
    assert np.array_equal(got, a)
    with pytest.raises(ValueError, match="not a TIFF"):
        grids.tiff_tags(b"nothing")


def test_parts_of_arrays(spark):
    a = np.arange(80.0).reshape(8, 10)
    cells = raster(spark, a).withColumnsRenamed({"r": "row", "c": "col", "v": "value"})
    dense = lambda df, shape: as_array(df.withColumnsRenamed({"row": "r", "col": "c", "value": "v"}), shape, "v")
    assert np.array_equal(dense(grids.array_slice(cells, (1, 8, 3), (2, 9, 2)), (3, 4)), a[1:8:3, 2:9:2])
    assert np.array_equal(dense(grids.array_without(cells, (2, 5), [0, 3, 9]), (5, 7)), np.delete(np.delete(a, range(2, 5), 0), [0, 3, 9], 1))
    assert grids.array_block(cells, 8, 3, 2).agg(F.min("row"), F.max("row")).first()[:] == (4, 7)
    assert grids.array_info(cells, ["tile"]).first()[:] == (0, 8, 10, 80)
    box = grids.cut_by_box(cells, (23.0, 71.0, 48.0, 88.0), 0.0, 100.0, 10.0, -10.0)
    assert box.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()[:] == (1, 2, 2, 4)
    cut = grids.cut_by_ring(cells, [(15.0, 95.0), (45.0, 95.0), (45.0, 55.0), (15.0, 55.0)], 0.0, 100.0, 10.0, -10.0).where("not isnan(value)")
    assert {(r["row"], r["col"]) for r in cut.collect()} == {(r, c) for r in (1, 2, 3, 4) for c in (2, 3, 4)}


def test_raw_files_by_polarisation(spark, tmp_path):
    for name in ("a/x-vv-1.dat", "a/b/y-vh-2.dat", "a/b/z-vv-3.dat", "a/vv.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    got = readers.find_raw_files(spark, str(tmp_path / "a"), "VV").collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in got) == ["x-vv-1.dat", "z-vv-3.dat"]


def test_tiles_of_the_fixture(spark):
    """A tile with a missing band, blank attributes and another shape; quality and structure of groups."""
    meta = {k: "x" for k in products.CORE_KEYS}
    tiles = spark.createDataFrame([("a", meta), ("b", {**meta, "quality_flag": " "}), ("c", None), ("d", {k: v for k, v in meta.items() if k != "PASS"})], "tile string, metadata map<string,string>")
    full = dict.fromkeys(tc.BAND_ATTRIBUTES, "1")
    bands = [(t, n, 2, 2, full) for t in "acd" for n in ("Band_A", "Band_B")] + [("b", "Band_A", 2, 2, {**full, "unit": ""}), ("b", "Band_C", 3, 0, {k: v for k, v in full.items() if k != "CLASS"})]
    got = {r["tile"]: r for r in tc.validated_tiles(tiles, spark.createDataFrame(bands, "tile string, band string, height int, width int, attrs map<string,string>"), ["Band_A", "Band_B"]).collect()}
    assert got["a"]["status"] == "success" and got["a"]["bands"] == ["Band_A", "Band_B"]
    b = got["b"]
    assert (b["missing_bands"], b["extra_bands"], b["blank_metadata"], b["shapes_differ"], b["status"]) == (["Band_B"], ["Band_C"], ["quality_flag"], True, "failed")
    assert b["band_issues"] == ["Band_A: blank unit", "Band_C: without CLASS; shape 3 x 0"]
    assert got["c"]["no_metadata"] and got["c"]["bands_ok"] and not got["c"]["metadata_ok"] and len(got["c"]["missing_core"]) == len(products.CORE_KEYS)
    assert got["d"]["missing_core"] == ["PASS"] and got["d"]["status"] == "failed"
    empty = tc.validated_tiles(tiles.limit(0), spark.createDataFrame([], "tile string, band string, height int, width int, attrs map<string,string>"), ["Band_A"])
    assert empty.count() == 0
    status = spark.createDataFrame([(4, 1, 3), (4, 4, 0), (4, 0, 4), (0, 0, 0)], "t int, v int, n int").select(tc.quality_status(F.col("t"), F.col("v"), F.col("n")))
    assert [r[0] for r in status.collect()] == ["partial", "success", "failed", "failed"]


def test_tile_databases(spark, tmp_path):
    results = spark.createDataFrame([("a", "IW1", {"MISSION": "S", "first_line_time": "02-MAR-2025 10:00:00.5"}), ("b", None, None)], "tile string, swath string, metadata map<string,string>")
    rows = tc.core_rows(results)
    path = tc.write_tile_database(tc.merged_rows(rows, rows.drop("SWATH").where("ID = 'a'")), str(tmp_path), "product")
    assert path.endswith("product_core_metadata.parquet")
    got = spark.read.parquet(path).orderBy("ID", "SWATH").select("ID", "SWATH", "MISSION", "first_line_time").collect()
    assert [tuple(r) for r in got] == [("a", None, "S", "2025-03-02T10:00:00.500000Z"), ("a", "IW1", "S", "2025-03-02T10:00:00.500000Z"), ("b", None, None, None)]


def _band(df, shape):
    out = np.zeros(shape, "float32")
    for r in df.collect():
        out[r["row"], r["col"]] = r["value"]
    return out


def test_grid_geojson(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "a"}, "geometry": {"type": "Point", "coordinates": [12.5, 41.9]}}]}')
    assert readers.read_grid_geojson(spark, str(tmp_path / "g.json")).first().asDict() == {"name": "a", "lon": 12.5, "lat": 41.9}


def test_geometry(spark):
    one = spark.range(1)
    zone = lambda lat, lon: one.select(geo.utm_epsg(F.lit(float(lat)), F.lit(float(lon)))).first()[0]
    assert [zone(-1, -174.34), zone(48, -4), zone(78, 13), zone(-34, 19.7), zone(60, 4)] == [32701, 32630, 32633, 32734, 32632]
    assert one.select(geo.move_down(F.lit("0U")), geo.move_up(F.lit("1D")), geo.move_left(F.lit("0R"))).first()[:] == ("1D", "0U", "1L")
    cells = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)], "row int, col int")
    assert [tuple(r) for r in geo.rectangles(cells).collect()] == [(0, 0)]
    assert one.select(geo.wkt_of_ring(geo.ring_of_pos_list(F.lit("1 2 3 4 5 6")))).first()[0] == "POLYGON ((2.0 1.0, 4.0 3.0, 6.0 5.0, 2.0 1.0))"
    points = geo.grid_points(spark, 1000.0, (0, 20), (0, 30))
    assert points.where("name = '0U_0R' and lat = 0 and lon = 0").count() == 1


def test_timestamps(spark):
    df = spark.createDataFrame([("30-JAN-2026 15:26:10.271545",), ("2025-03-01T00:00:00Z",), ("2025-03-01T00:00:00.1234567",), ("soon",), ("  ",), (None,)], "t string")
    got = [r[0] for r in df.select(products.normalize_timestamp(F.col("t"))).collect()]
    assert got == ["2026-01-30T15:26:10.271545Z", "2025-03-01T00:00:00.000000Z", "2025-03-01T00:00:00.123456Z", "soon", None, None]


def test_statistics_on_constants(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 4, "x double, y double")
    r = df.agg(st.amplitude_correlation(F.col("x"), F.col("y")).alias("c"), st.psnr(F.col("x"), F.col("x")).alias("p"), st.dispersion_ratio(F.col("x")).alias("d")).first()
    assert r["c"] == 0.0 and r["p"] == float("inf") and r["d"] == 0.0
    assert np.isnan(st.normalized_mutual_information(df, "x", "y").first()["nmi"])
    with pytest.raises(ValueError, match="no such loss"):
        st.get_loss("nothing")


def test_entropy_alpha_of_one_scatterer(spark):
    r = spark.range(1).select(polarimetry.entropy_alpha2(F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("h")).first()["h"]
    assert abs(r["entropy"]) < 1e-9 and abs(r["alpha"]) < 1e-6 and r["anisotropy"] == 1.0


def test_recipes(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 0.0)], "k int, amplitude double")
    steps = recipes.from_json('[{"calibrate": {"band": "amplitude", "gain": 1.0, "out": "s"}}, {"put_aside": {"name": "cal"}}, {"to_db": {"bands": ["s"]}}, {"subset": {"condition": "s > 0"}}]')
    assert [round(r["s_db"], 4) for r in recipes.run(df, steps).collect()] == [6.0206]
    back = recipes.run(df, [*steps, recipes.take_up("cal"), recipes.stack(["more"], ["k"])], more=df.select("k", "amplitude"))
    assert sorted((r["k"], r["s"], r["amplitude_more"]) for r in back.collect()) == [(1, 4.0, 2.0), (2, 0.0, 0.0)]
    gamma = recipes.run(df.withColumn("angle", F.lit(45.0)), [recipes.calibrate("amplitude", 2.0, "g", "gamma0", "angle"), recipes.remove_noise("g", 0.25)])
    assert [round(r["g"], 9) for r in gamma.orderBy("k").collect()] == [0.75, 0.0]
    with pytest.raises(ValueError, match="no operator"):
        recipes.from_json('[{"nothing": {}}]')
    with pytest.raises(ValueError, match="one operator"):
        recipes.from_json('["to_db"]')
    with pytest.raises(LookupError):
        recipes.run(df, [recipes.take_up("nothing")])
    with pytest.raises(LookupError):
        recipes.recipe("nothing")
    assert recipes.recipe("S1TOPS") is recipes.RECIPES["tops"]


def test_every_recipe_runs(spark):
    """On tables of the bands that it names."""
    rng = np.random.default_rng(5)
    rows = [("t", "IW1", b, "VV", b * 20 + line, line, c, *map(float, rng.uniform(1, 2, 7))) for b in range(2) for line in range(20) for c in range(8)]
    df = spark.createDataFrame(rows, "tile string, swath string, burst int, pol string, row int, line int, col int, amplitude double, hh double, hv double, vv double, i double, q double, z double")
    looks = df.select("row", "col", F.explode(F.array(F.lit(1), F.lit(2))).alias("look"), "i", "q")
    for name, steps in recipes.RECIPES.items():
        assert recipes.run(df, steps, other=df, looks=looks).count() > 0, name


def test_border_noise_and_flattening(spark):
    df = spark.createDataFrame([("t", 0, c, 0.1, 2.0, 1.0) for c in range(10)] + [("t", 1, 3, 5.0, 0.0, 1.0)], "tile string, row int, col int, v double, lit double, flat double")
    got = recipes.run(df, [recipes.trim_border_noise(["tile"], "row", "col", "v", 1.0, 2), recipes.flatten_terrain("v", "g", "lit", "flat")])
    assert sorted((r["row"], r["col"], r["v"], r["g"]) for r in got.where("v is not null").collect()) == [*((0, c, 0.1, 0.05) for c in range(2, 8)), (1, 3, 5.0, None)]


def test_products_by_their_names(spark):
    names = ["/d/S1A_IW_SLC__1SDV.SAFE", "/d/S1B_S3_SLC_.zip", "S1C_EW_GRDM/", "/x/TSX1_SAR__SSC.xml", "TDX1_a.xml", "CSKS4_b.h5", "CSG_SSAR2_c.h5", "BIO_S1_d", "NISAR_L1_PR.h5", "/d/other.tif", None, "/d/a_b_tc.dim", "a.dim", "/d/x_y.z_tc.dim"]
    got = spark.createDataFrame([(n,) for n in names], "p string").select(products.product_mode(F.col("p")).alias("m"), products.product_id(F.col("p")).alias("i")).collect()
    assert [r["m"] for r in got] == ["S1TOPS", "S1STRIP", "S1TOPS", "TSX", "TSX", "CSG", "CSG", "BM", "NISAR", None, None, None, None, None]
    assert [r["i"] for r in got] == [None] * 11 + ["a_b", None, "x_y.z"]


def test_bursts_of_unequal_heights(spark):
    from echograin.operators import product_ops as po

    heights = {1: 10, 2: 14, 5: 12}  # burst 3 and 4 aren't there
    rows = [("IW1", b, line, 100 * b + line) for b, h in heights.items() for line in range(h)]
    got = sorted((r["line"], r["v"]) for r in po.debursted(spark.createDataFrame(rows, "swath string, burst int, line int, v int"), ["swath"], 4).collect())
    assert got == [*((k, 100 + k) for k in range(8)), *((6 + k, 200 + k) for k in range(2, 12)), *((16 + k, 500 + k) for k in range(2, 12))]


def test_looks_become_bands(spark):
    from echograin.operators import product_ops as po

    product = spark.createDataFrame([(0, 0, 1.0, 9.0), (0, 1, 2.0, 9.0)], "row int, col int, i double, i_SA2 double")
    looks = spark.createDataFrame([(0, 0, 1, 3.0, 4.0), (0, 0, 2, 5.0, 6.0), (0, 1, 1, 7.0, 8.0)], "row int, col int, look int, i double, q double")
    got = po.merge_iq(product, looks, ["row", "col"])
    assert got.columns == ["row", "col", "i", "i_SA2", "i_SA1", "q_SA1", "q_SA2"]
    assert sorted(map(tuple, got.collect())) == [(0, 0, 1.0, 9.0, 3.0, 4.0, 6.0), (0, 1, 2.0, 9.0, 7.0, 8.0, None)]
    assert po.merge_iq(product, looks.limit(0), ["row", "col"]).columns == product.columns


def test_scaled_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0), ("a", 2.0), ("b", None), ("b", float("nan")), ("b", 4.0), ("b", 8.0)], "k string, v double")
    got = [(r["k"], r["v"], r["s"]) for r in relational.scaled(df, ["k"], "v", "s").collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(None, 1.0, 0.0), (None, 3.0, 1.0), ("a", 2.0, 1.0), ("a", 2.0, 1.0), ("b", None, None), ("b", float("nan"), float("nan")), ("b", 4.0, 0.0), ("b", 8.0, 1.0)]))
    assert sorted(r["s"] for r in relational.scaled(df.where("k = 'b' and v > 0 and not isnan(v)"), [], "v", "s").collect()) == [0.0, 1.0]


def test_utm_is_near_the_series_of_the_eccentricity(spark):
    import math

    def snyder(lat, lon):
        e2, a, k0 = 0.00669437999014, 6378137.0, 0.9996
        f, ep = math.radians(lat), e2 / (1 - e2)
        n, t, c, x = a / math.sqrt(1 - e2 * math.sin(f) ** 2), math.tan(f) ** 2, ep * math.cos(f) ** 2, math.cos(f) * math.radians(lon - 9)
        m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * f - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * f) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * f) - 35 * e2**3 / 3072 * math.sin(6 * f))
        return 500000 + k0 * n * (x + (1 - t + c) * x**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * x**5 / 120), k0 * (m + n * math.tan(f) * (x * x / 2 + (5 - t + 9 * c + 4 * c * c) * x**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * x**6 / 720))

    points = [(float(lat), lon) for lat in range(0, 80, 7) for lon in (6.1, 8.0, 9.0, 11.9)]
    east, north = geo.utm_forward(F.col("lat"), F.col("lon"), F.lit(32))
    for r in spark.createDataFrame(points, "lat double, lon double").select("lat", "lon", east.alias("e"), north.alias("n")).collect():
        assert np.allclose((r["e"], r["n"]), snyder(r["lat"], r["lon"]), atol=0.05)


def test_learners(spark):
    df = spark.createDataFrame([(float(i % 2) * 10 + i * 0.01, 1.0, i % 2) for i in range(40)], "a double, b double, label int")
    assert classifiers.k_means(df, ["a", "b"], 2).select("cluster").distinct().count() == 2
    assert classifiers.gaussian_mixture(df, ["a"], 2).count() == 40
    assert classifiers.decision_tree(df, df, ["a"], "label").where("class = label").count() == 40


def test_stream_is_the_batch(spark, tmp_path):
    rows = [(i, f"2025-01-01 0{i % 9}:{i % 60:02d}:00", i % 3, "ab"[i % 2], float(i)) for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windows.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("tumbling").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("tumbling").collect())) == sorted(map(tuple, windows.tumbling(events).collect()))


def test_product_operators(spark):
    from echograin.operators import product_ops as po

    rng = np.random.default_rng(5)
    a = rng.integers(0, 4, (6, 7))
    g = po.glcm(raster(spark, a).withColumn("g", F.col("v").cast("int")), ["tile"], "r", "c", "g").first()
    pairs = np.zeros((4, 4))
    for x, y in zip(a[:, :-1].ravel(), a[:, 1:].ravel(), strict=True):
        pairs[x, y] += 1
        pairs[y, x] += 1
    p = pairs / pairs.sum()
    i, j = np.indices(p.shape)
    assert np.isclose(g["contrast"], (p * (i - j) ** 2).sum()) and np.isclose(g["energy"], (p * p).sum())
    b = rng.normal(size=(32, 32))
    shifted = raster(spark, b).withColumnRenamed("v", "a").join(raster(spark, np.roll(b, (3, -2), (0, 1))).withColumnRenamed("v", "b"), ["tile", "r", "c"])
    s = po.offsets(shifted, ["tile"], "r", "c").first()
    assert (s["row_shift"], s["col_shift"]) == (3, -2)
    same = raster(spark, b).withColumn("w", F.col("v"))
    assert np.isclose(po.ssim(same, ["tile"], "r", "c", "v", "w").first()["ssim"], 1)
    small = po.resampled_nearest(raster(spark, a), "r", "c", 6, 7, 3, 14)
    assert small.count() == 42 and small.select(F.max("r"), F.max("c")).first()[:] == (2, 13)
    z = raster(spark, np.zeros((32, 32))).select("tile", "r", "c", F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    assert abs(po.goldstein_filter(z, ["tile"], "r", "c").agg(F.avg("re")).first()[0] - 1) < 1e-9
    joined = po.assembled_slices([raster(spark, a), raster(spark, a[:2])], "r")
    assert joined.count() == 56 and joined.agg(F.max("r")).first()[0] == 7
    spectra = spark.createDataFrame([([1.0, 0.1],), ([0.1, 1.0],)], "x array<double>")
    assert [r[0] for r in spectra.select(po.nearest_class(F.col("x"), {"red": [1.0, 0.0], "blue": [0.0, 1.0]})).collect()] == ["red", "blue"]
    packets = spark.createDataFrame([("f", k, 0 if k != 3 else 1, 10 if k < 6 else 12) for k in range(9)], "path string, n int, kind int, quads int").withColumn("quads", F.when(F.col("n") == 6, 11).otherwise(F.col("quads")))
    assert sorted((r["burst"], r["quads"], r["first"], r["last"], r["n"], r["offset"]) for r in po.echo_bursts(packets, "n", "kind", "quads").collect()) == [(0, 10, 0, 5, 5, 0), (1, 12, 7, 8, 2, 5)]


def test_missing_bands(spark):
    from echograin.operators import validation as va

    bands = spark.createDataFrame([("g", "a", "x"), ("g", "a", "y"), ("g", "b", "x"), ("h", "c", "z")], "grp string, tile string, band string")
    assert [tuple(r) for r in va.missing_bands(bands).collect()] == [("g", "b", "y")]
    assert [r["band"] for r in va.sample_bands(bands, {"z": 0}, 2).collect()] == ["z", "x"]
    rows = spark.createDataFrame([(1, " ", None), (2, None, "q"), (3, "p", None)], "n int, a string, b string")
    assert va.first_known(rows, "n", ["a", "b"]).first()["n"] == 2


def test_model_slots(spark):
    from echograin.operators import slots

    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double")
    run = slots.processor("biophysical", lambda p: p["a"] + p["b"])
    assert [r["lai"] for r in run(df, ["a", "b"], "lai").collect()] == [3.0, 7.0]
    with pytest.raises(NotImplementedError, match="coefficient"):
        slots.processor("smac_op")


def test_focus_measures(spark):
    from echograin.operators import focus as fo

    rng = np.random.default_rng(6)
    a, b = rng.uniform(0, 1, (6, 5)), rng.uniform(0, 1, (6, 5))
    df = raster(spark, a).join(raster(spark, b).withColumnRenamed("v", "t"), ["tile", "r", "c"])
    i, j = np.indices(a.shape)
    s = a.sum()
    want = sum((a * (k - (a * k).sum() / s) ** 2).sum() / s for k in (i, j))
    assert np.isclose(fo.centroid_variance(df, ["tile"], "r", "c", "v").first()["variance"], want, atol=1e-6)
    p = a.ravel() / s
    assert np.isclose(df.agg(fo.normalized_entropy(F.col("v"))).first()[0], -(p * np.log(p)).sum() / np.log(p.size))
    d = a - b
    assert np.isclose(fo.gradient_matching(df, ["tile"], "r", "c", "v", "t").first()["loss"], (np.diff(d, axis=0) ** 2).mean() + (np.diff(d, axis=1) ** 2).mean())
    assert np.isclose(fo.symmetry_loss(df, ["tile"], "r", "c", "v").first()["loss"], ((a - a[:, ::-1]) ** 2).mean())
    z = (b - b.mean()) / (b.std(ddof=1) + 1e-8)
    assert np.isclose(fo.distribution_aware_mse(df, ["tile"], "v", "t").first()["loss"], (d**2 * z**2).mean())
    lo, hi = min(a.min(), b.min()), max(a.max(), b.max())
    h = [np.histogram(x, bins=100, range=(lo, hi))[0] for x in (a, b)]
    assert np.isclose(fo.histogram_l1(df, ["tile"], "v", "t").first()["l1"], np.abs(h[0] - h[1]).sum() / a.size, atol=0.08)
    assert df.agg(fo.moments_loss(F.col("v"), F.col("v"))).first()[0] == 0
    assert fo.patch_windows(spark, 2500, 2100).count() == 4 and fo.patch_windows(spark, 2500, 2100, drop_incomplete=False).count() == 9
    looks = spark.createDataFrame([(k, i, c, float(k + 1), 0.0) for k in range(3) for i in range(4) for c in range(3)], "look int, row int, col int, re double, im double")
    assert {round(r["re"], 6) for r in fo.row_balance(looks, [], "row", "look", "re", "im").collect()} == {2.0}
    v = spark.range(1).select(fo.effective_velocity(F.lit(7.07e6), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(7500.0), F.lit(0.0), 850e3)).first()[0]
    assert 7000 < v < 7500
