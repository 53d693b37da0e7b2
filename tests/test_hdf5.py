"""HDF5 files: written by hand and read back, in tables and by parts of the format."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from echograin.sources import hdf5
from echograin.sources.ranges import Content


def quality_file(tmp_path, name="tile.h5"):
    a, b = np.array([[0, np.nan], [1, 2]], "f4"), np.array([[0, 3], [1, np.nan]], "f4")
    attributes = {
        "": {"root_attr": "root"}, "bands/Band_A": {"CLASS": "BAND", "IMAGE_VERSION": "1.0", "log10_scaled": False, "raster_height": 2, "raster_width": 2, "scaling_factor": 1.0, "unit": "amplitude"},
        "metadata/Abstracted_Metadata": {"quality_flag": "good", "MISSION": "SENTINEL-1A", "antenna_pointing": "right", "calib": 1.25, "incidence": [30.1, 45.2]}, "metadata/Quality": {"state": "ok"},
    }
    path = tmp_path / name
    path.write_bytes(hdf5.hdf5_bytes({"bands/Band_A": a, "bands/Band_B": b, "geolocation/latitude": np.arange(4.0).reshape(2, 2)}, attributes))
    return path


def table(df):
    return {(r["band"], r["row"], r["col"]): r["value"] for r in df.collect()}


@pytest.mark.parametrize("whole", [False, True])
def test_a_tile_and_its_metadata(spark, tmp_path, whole):
    path = str(quality_file(tmp_path))
    cells = hdf5.read_h5(spark, path, whole=whole)
    got = table(cells)
    assert got["bands/Band_A", 1, 1] == 2 and np.isnan(got["bands/Band_A", 0, 1]) and got["bands/Band_B", 0, 1] == 3 and got["geolocation/latitude", 1, 0] == 2 and len(got) == 12
    objects = {r["name"]: r for r in hdf5.read_h5_objects(spark, path, whole=whole).collect()}
    assert objects[""]["attributes"] == {"root_attr": "root"} and objects["metadata/Quality"]["attributes"] == {"state": "ok"}
    assert objects["bands/Band_A"]["shape"] == [2, 2] and objects["bands/Band_A"]["type"] == "<f4" and objects["bands/Band_A"]["kind"] == "dataset"
    assert objects["bands/Band_A"]["attributes"]["unit"] == "amplitude" and objects["bands/Band_A"]["attributes"]["log10_scaled"] == "0"
    meta = objects["metadata/Abstracted_Metadata"]["attributes"]
    assert meta["MISSION"] == "SENTINEL-1A" and float(meta["calib"]) == 1.25 and meta["incidence"] == "[30.1, 45.2]"
    # the counts of the tile's quality follow from the cells
    pixel = cells.where("band LIKE 'bands/%'").groupBy("row", "col").agg(F.max(F.isnan("value")).alias("nan"), F.max(F.abs("value")).alias("most"))
    counts = pixel.agg(F.count("*"), F.sum((F.col("most") == 0).cast("int")), F.sum(F.col("nan").cast("int"))).first()
    assert tuple(counts) == (4, 1, 2)


def test_kinds_shapes_and_filters(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = {
        "whole": rng.integers(-9, 9, (37, 53)).astype("<i2"), "big": rng.normal(size=(300, 211)), "swapped": rng.normal(size=(5, 6)).astype(">f4"), "complex": (rng.normal(size=(20, 9)) + 1j * rng.normal(size=(20, 9))).astype("<c8"),
        "line": np.arange(70.0), "cube": np.arange(60, dtype="<u4").reshape(3, 4, 5), "one": np.float64(4.5), "names": np.array(["ab", "c"]), "none": np.zeros((0, 4)), "half": np.arange(6, dtype="<f2").reshape(2, 3),
    }
    data |= {f"many/d{k:03}": np.full((2, 2), k, "<u2") for k in range(300)}
    for chunks, shuffle in ((None, False), ((7, 16), True)):
        content = hdf5.hdf5_bytes(data, {"many": {"n": 300}, "leaf": {"x": "y"}}, chunks, shuffle=shuffle)
        path = tmp_path / f"kinds{shuffle}.h5"
        path.write_bytes(content)
        walker = hdf5.Walker(Content(content))
        objects = {name: (about, d) for name, about, d in walker.objects()}
        assert objects["many"][0] == {"n": 300} and objects["leaf"] == ({"x": "y"}, None)
        for name, a in data.items():
            d = objects[name][1]
            assert d.shape == np.shape(a) and (d.kind == np.asarray(a).dtype.str or name == "names")
            out = np.zeros(d.shape, d.kind)
            for first, extent, at, size, mask, inline in walker.pieces(d):
                part = hdf5.piece_values(d.kind, hdf5.json.dumps(d.filters), mask, extent, inline or content[at : at + size])
                where = tuple(slice(f, f + e) for f, e in zip(first, extent, strict=True))
                out[where] = part[tuple(slice(0, n) for n in out[where].shape)]
            assert (np.char.decode(out).tolist() if name == "names" else out.tolist()) == np.asarray(a).tolist(), name
        got = table(hdf5.read_h5(spark, str(path), "complex", "imag"))
        assert len(got) == 180 and got["complex", 7, 3] == pytest.approx(float(data["complex"][7, 3].imag))
        cube = table(hdf5.read_h5(spark, str(path), "cube"))
        assert cube["cube", 2 * 4 + 1, 3] == data["cube"][2, 1, 3] and len(cube) == 60
        assert hdf5.read_h5(spark, str(path)).count() == sum(np.size(a) for n, a in data.items() if n != "names")


def later_file(a: np.ndarray, paged: bool) -> bytes:
    """A file of the newer form: superblock 2, object headers with link messages, and a fixed array of deflated chunks."""
    out = bytearray(b"\0" * 48)

    def put(data: bytes) -> int:
        out.extend(data)
        return len(out) - len(data)

    def header(messages) -> int:
        body = b"".join(struct.pack("<BHB", k, len(d), 0) + d for k, d in messages)
        return put(b"OHDR" + struct.pack("<BBI", 2, 2, len(body)) + body + b"sums")

    ch, cw = 4, 5
    entries = b""
    for r in range(0, a.shape[0], ch):
        for c in range(0, a.shape[1], cw):
            part = np.zeros((ch, cw), a.dtype)
            own = a[r : r + ch, c : c + cw]
            part[: own.shape[0], : own.shape[1]] = own
            raw = zlib.compress(part.tobytes())
            entries += struct.pack("<QHI", put(raw), len(raw), 0)
    n = len(entries) // 14
    bits = 2 if paged else 10
    block = b"FADB" + struct.pack("<BBQ", 0, 1, 0)
    if paged:
        pages = -(-n // 4)
        block += bytes([0xFF] * -(-pages // 8)) + b"sums" + b"".join(entries[56 * k : 56 * (k + 1)] + b"sums" for k in range(pages))
    else:
        block += entries + b"sums"
    at = put(block)
    index = put(b"FAHD" + struct.pack("<BBBBQQ", 0, 1, 14, bits, n, at) + b"sums")
    space = struct.pack("<BBBB2Q", 2, 2, 0, 1, *a.shape)
    kind = hdf5._Writer.datatype(a.dtype)
    layout = struct.pack("<BBBBBHHHBBQ", 4, 2, 0, 3, 2, ch, cw, a.itemsize, 3, bits, index)
    attribute = struct.pack("<BBHHHB", 3, 0, 2, 8, 4, 0) + b"u\0" + struct.pack("<BBBBI", 0x13, 0, 0, 0, 3) + struct.pack("<BBBB", 2, 0, 0, 0) + b"deg"
    data = header([(1, space), (3, kind), (11, struct.pack("<BBHHHI", 2, 1, 1, 0, 1, 4)), (8, layout), (12, attribute)])
    inner = header([(6, struct.pack("<BBB", 1, 0, 4) + b"data" + struct.pack("<Q", data))])
    link = struct.pack("<BBB", 1, 0, 2) + b"in" + struct.pack("<Q", inner)
    more = put(b"OCHK" + struct.pack("<BHB", 6, len(link), 0) + link + b"sums")
    root = header([(16, struct.pack("<QQ", more, len(out) - more))])
    out[:48] = hdf5.SIGNATURE + struct.pack("<BBBBQQQQI", 2, 8, 8, 0, 0, hdf5.NOWHERE, len(out), root, 0)
    return bytes(out)


@pytest.mark.parametrize("paged", [False, True])
def test_newer_files(spark, tmp_path, paged):
    a = np.random.default_rng(3).normal(size=(19, 23)).astype("<f4")
    path = tmp_path / "later.h5"
    path.write_bytes(later_file(a, paged))
    got = table(hdf5.read_h5(spark, str(path)))
    assert len(got) == a.size and all(got["in/data", r, c] == a[r, c] for r in range(19) for c in range(23))
    assert {r["name"]: r["attributes"] for r in hdf5.read_h5_objects(spark, str(path)).collect()}["in/data"] == {"u": "deg"}


def test_odd_files():
    with pytest.raises(ValueError, match="not an HDF5 file"):
        hdf5.Walker(Content(b"plain text"))
    content = hdf5.hdf5_bytes({"a": np.ones((3, 3))})
    with pytest.raises(ValueError, match="ends too early"):
        list(hdf5.Walker(Content(content[:200])).objects())
    with pytest.raises(NotImplementedError, match="filter 32015"):
        hdf5.unfiltered(b"x", [(32015, [])], 0, 4)
    assert hdf5.unfiltered(b"x", [(32015, [])], 1, 4) == b"x"


def test_nisar(spark, tmp_path):
    grid = hdf5.nisar_grid()
    data = {f"{grid}/{p}": (np.arange(12).reshape(3, 4) * (1 + 2j) + k).astype("<c8") for k, p in enumerate(("VV", "HH"))}
    data |= {f"{grid}/xCoordinates": np.array([10.0, 12.5, 15.0, 17.5]), f"{grid}/yCoordinates": np.array([9.0, 8.0, 7.0]), f"{grid}/projection": np.int64(32633)}
    for name, own in (("full.h5", data), ("bare.h5", {f"{grid}/HV": np.ones((2, 1), "<c8")})):
        (tmp_path / name).write_bytes(hdf5.hdf5_bytes(own, {f"{grid}/projection": {"epsg_code": 4326}} if name == "full.h5" else {}))
    path = str(tmp_path)
    rows = hdf5.nisar_metadata(hdf5.read_h5_objects(spark, path), hdf5.read_h5(spark, path)).collect()
    got = {r["path"].split("/")[-1]: r.asDict() for r in rows}
    full, bare = got["full.h5"], got["bare.h5"]
    assert full["polarizations"] == ["HH", "VV"] and (full["height"], full["width"], full["epsg"]) == (3, 4, 32633)
    assert [full[k] for k in ("x_min", "x_max", "y_min", "y_max", "x_spacing", "y_spacing")] == [10.0, 17.5, 7.0, 9.0, 2.5, 1.0]
    assert bare["epsg"] is None and [bare[k] for k in ("x_min", "x_max", "y_min", "y_max", "x_spacing", "y_spacing")] == [0.0, 1.0, 0.0, 2.0, 1.0, 1.0]
    cells = table(hdf5.read_nisar(spark, f"{path}/full.h5", [" hh"], component="imag"))
    assert cells == {("HH", r, c): 2.0 * (4 * r + c) for r in range(3) for c in range(4)}
    for bad in ([], [" "]):
        with pytest.raises(ValueError):
            hdf5.read_nisar(spark, path, bad)
