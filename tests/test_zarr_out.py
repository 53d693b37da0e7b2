"""Zarr arrays and groups written from cells, read back, and left alone by writes that fail."""

import json
import os
from enum import Enum

import numpy as np
import pytest
from pyspark.sql import functions as F

from echograin.sources import grids, hdf5, zarr_out


def cells(spark, a, parts=5):
    return spark.createDataFrame([(r, c, float(a[r, c].real), float(a[r, c].imag)) for r in range(a.shape[0]) for c in range(a.shape[1])], "row int, col int, value double, imag double").repartition(parts)


def read(spark, path, component="real"):
    return {(r["row"], r["col"]): r["value"] for r in grids.read_zarr(spark, str(path), component=component).collect()}


@pytest.mark.parametrize("codec", grids.ZARR_CODECS)
def test_written_arrays_come_back(spark, tmp_path, codec):
    a = np.random.default_rng(2).normal(size=(23, 37)).astype("f4")
    a[3, 4] = np.nan
    path = tmp_path / "z"
    zarr_out.write_zarr(cells(spark, a), str(path), a.shape, (5, 16), codec=codec, attributes={"unit": "dB", "n": np.int64(3), "bad": float("nan")})
    got = read(spark, path)
    assert len(got) == a.size and all(got[k] == a[k] or np.isnan(a[k]) and np.isnan(got[k]) for k in np.ndindex(a.shape))
    assert sorted(f for f in os.listdir(path) if f[0] != ".") == sorted(f"{r}.{c}" for r in range(5) for c in range(3))
    assert grids.zarr_attributes(spark, str(path)) == {"unit": "dB", "n": 3, "bad": None}
    with pytest.raises(FileExistsError):
        zarr_out.write_zarr(cells(spark, a), str(path), a.shape)
    zarr_out.export_slice(spark, str(path), str(tmp_path / "part"), (2, 20, 3), (1, 30, 1))
    part = read(spark, tmp_path / "part")
    assert len(part) == 6 * 29 and all(part[r, c] == a[2 + 3 * r, 1 + c] or np.isnan(a[2 + 3 * r, 1 + c]) for r, c in part)


def test_missing_cells_hold_the_fill_value(spark, tmp_path):
    a = np.arange(36.0).reshape(6, 6)
    some = cells(spark, a).where("row < 2 AND col > 3")
    zarr_out.write_zarr(some, str(tmp_path / "z"), (6, 6), (3, 3), dtype="<f8", fill_value=float("nan"))
    assert sorted(f for f in os.listdir(tmp_path / "z") if f[0] != ".") == ["0.1"]
    got = read(spark, tmp_path / "z")
    assert len(got) == 9 and sum(np.isnan(v) for v in got.values()) == 5 and got[1, 5] == 11
    assert json.loads((tmp_path / "z" / ".zarray").read_text())["fill_value"] == "NaN"


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    a = np.ones((8, 8))
    path = tmp_path / "z"
    broken = cells(spark, a).withColumn("value", F.when(F.col("row") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        zarr_out.write_zarr(broken, str(path), a.shape, (4, 4))
    assert os.listdir(tmp_path) == []
    zarr_out.write_zarr(cells(spark, a), str(path), a.shape, (4, 4))
    for bad in (broken, cells(spark, np.ones((9, 8)))):
        with pytest.raises(Exception, match="lost|outside"):
            zarr_out.write_zarr(bad, str(path), a.shape, (4, 4), overwrite=True)
    assert len(read(spark, path)) == 64 and os.listdir(tmp_path) == ["z"]
    zarr_out.write_zarr(cells(spark, 2 * a), str(path), a.shape, (8, 8), overwrite=True)
    assert set(read(spark, path).values()) == {2.0} and sorted(os.listdir(path)) == [".zarray", ".zattrs", "0.0"]
    # what a killed write leaves has no metadata yet
    zarr_out._write_files(zarr_out.zarr_chunks(cells(spark, a), zarr_out.array_about((8, 8), (4, 4), "<f4")), str(tmp_path / "killed"))
    with pytest.raises(Exception, match="zarray"):
        grids.read_zarr(spark, str(tmp_path / "killed"))


def test_focused_products(spark, tmp_path):
    z = np.random.default_rng(4).normal(size=(10, 12)) + 1j * np.random.default_rng(5).normal(size=(10, 12))
    result = {k: (cells(spark, z * (i + 1)), z.shape) for i, k in enumerate(zarr_out.STAGES)}
    with pytest.raises(ValueError, match="metadata, ephemeris"):
        zarr_out.write_focused(result, str(tmp_path / "f"))
    meta = spark.createDataFrame([(1, 2.5, float("nan")), (2, 3.5, None)], "coarse_time int, rx_gain double, odd double")
    zarr_out.write_focused({**result, "metadata": meta, "ephemeris": {"x": [1, 2]}}, str(tmp_path / "f"), chunks=(4, 5))
    for i, k in enumerate(zarr_out.STAGES):
        re, im = (read(spark, tmp_path / "f" / k, c) for c in ("real", "imag"))
        assert all(np.isclose(re[p] + 1j * im[p], z[p] * (i + 1)) for p in np.ndindex(z.shape))
    about = grids.zarr_attributes(spark, str(tmp_path / "f"))
    assert about["metadata"]["data"] == [{"coarse_time": 1, "rx_gain": 2.5, "odd": None}, {"coarse_time": 2, "rx_gain": 3.5, "odd": None}] and about["ephemeris"]["data"] == {"x": [1, 2]}


def test_a_tile_in_hdf5_becomes_a_group(spark, tmp_path):
    a = np.arange(12, dtype="f4").reshape(3, 4)
    (tmp_path / "t.h5").write_bytes(hdf5.hdf5_bytes({"bands/A": a, "bands/B": 2 * a}, {"": {"tile": "t1"}, "bands/A": {"unit": "m"}, "metadata/Abstracted_Metadata": {"MISSION": "S1A"}}))
    zarr_out.h5_to_zarr(spark, str(tmp_path / "t.h5"), str(tmp_path / "t.zarr"), chunks=(2, 3))
    assert read(spark, tmp_path / "t.zarr/bands/B")[2, 3] == 22 and grids.zarr_attributes(spark, str(tmp_path / "t.zarr/bands/A")) == {"unit": "m"}
    assert grids.zarr_attributes(spark, str(tmp_path / "t.zarr/metadata/Abstracted_Metadata")) == {"MISSION": "S1A"} and grids.zarr_attributes(spark, str(tmp_path / "t.zarr")) == {"tile": "t1"}
    assert (tmp_path / "t.zarr/bands/.zgroup").exists() and (tmp_path / "t.zarr/metadata/.zgroup").exists()


def test_chunks_and_plain_values():
    assert zarr_out.square_chunks((10000, 3000)) == (512, 512) and zarr_out.square_chunks((100, 3000)) == (64, 64) and zarr_out.square_chunks((600, 900)) == (150, 150)
    assert zarr_out.tile_chunks((5000, 30)) == (4096, 30) and zarr_out.tile_chunks((5, 30), (8, 8)) == (5, 8) and zarr_out.tile_chunks((2, 5, 30), (4, 8)) == (1, 4, 8) and zarr_out.tile_chunks((7,), (4, 5)) == (5,)
    for bad in ((0, 4), (3,), (1, 2, 3)):
        with pytest.raises(ValueError):
            zarr_out.tile_chunks((5, 5), bad)

    class Colour(Enum):
        RED = np.float32(1.5)

    assert zarr_out.plain({"a": Colour.RED, 1: [b"x", np.arange(2), float("inf"), None, True]}) == {"a": 1.5, "1": ["x", [0, 1], None, None, True]}
