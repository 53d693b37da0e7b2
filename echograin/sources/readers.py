"""Readers and writers of raster and packet files, through Spark's own file access so that any store works."""

from __future__ import annotations

import io
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "path string, band string, row int, col int, value float"


def read_grid_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of a FeatureCollection of points: their properties and lon, lat."""
    features = spark.read.option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return features.select("f.properties.*", F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"))


def read_xml_leaves(spark: SparkSession, path: str) -> DataFrame:
    """(path, leaves): tag -> text of every leaf of XML files, the last of a tag wins."""

    @F.pandas_udf("map<string, string>")
    def leaves(texts: pd.Series) -> pd.Series:
        import xml.etree.ElementTree as ET

        return pd.Series([{e.tag: (e.text or "").strip() for e in ET.fromstring(t).iter() if not len(e)} for t in texts])

    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), leaves("value").alias("leaves"))


def band_names(xml: DataFrame, column: str = "value") -> DataFrame:
    """Band names of DIMAP documents, in their order."""
    return xml.select("*", F.xpath(F.col(column), F.lit("//Spectral_Band_Info/BAND_NAME/text()")).alias("bands"))


def read_npz(spark: SparkSession, path: str, rows_per_batch: int = 256) -> DataFrame:
    """Cells of every two-dimensional array of npz files."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, content in zip(files["path"], files["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as arrays:
                    for band in arrays.files:
                        a = arrays[band]
                        if a.ndim == 2:
                            yield from _cells(name, band, a, rows_per_batch)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cells, CELLS)


def _cells(path: str, band: str, a: np.ndarray, step: int) -> Iterator[pd.DataFrame]:
    for r in range(0, a.shape[0], step):
        part = a[r : r + step]
        rows, cols = np.indices(part.shape)
        yield pd.DataFrame({"path": path, "band": band, "row": (rows + r).ravel().astype("int32"), "col": cols.ravel().astype("int32"), "value": part.ravel().astype("float32")})


def cell_batch(path: str, band: str, rows: np.ndarray, cols: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """Cells as an Arrow batch, in which NaN stays NaN."""
    same = lambda x: pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(rows), np.int32)), pa.array([x])).cast(pa.string())
    columns = [same(path), same(band), pa.array(rows.astype(np.int32)), pa.array(cols.astype(np.int32)), pa.array(values.astype(np.float32))]
    return pa.RecordBatch.from_arrays(columns, names=["path", "band", "row", "col", "value"])


def envi_header(text: str) -> dict[str, str]:
    """Fields of an ENVI header, braces joined."""
    joined = re.sub(r"\{([^}]*)\}", lambda m: " ".join(m[1].split()), text)
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition("=") for x in joined.splitlines()) if k.strip() and v.strip()}


def read_envi(spark: SparkSession, path: str, header: dict[str, str], rows_per_batch: int = 256) -> DataFrame:
    """Cells of an ENVI band-sequential float32 image with this header."""
    height, width, bands = int(header["lines"]), int(header["samples"]), int(header.get("bands", 1))
    kind = (">" if header.get("byte order", "0") == "1" else "<") + "f4"

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, content in zip(files["path"], files["content"], strict=True):
                a = np.frombuffer(content, kind).reshape(bands, height, width)
                for b in range(bands):
                    yield from _cells(name, f"band_{b + 1}", a[b], rows_per_batch)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cells, CELLS)


def envi_bytes(a: np.ndarray, band: str, byte_order: int = 1) -> tuple[bytes, str]:
    """(image, header) of one real band."""
    header = f"ENVI\nsamples = {a.shape[1]}\nlines = {a.shape[0]}\nbands = 1\nheader offset = 0\nfile type = ENVI Standard\ndata type = 4\ninterleave = bsq\nbyte order = {byte_order}\nband names = {{{band}}}\n"
    return a.astype(">f4" if byte_order else "<f4").tobytes(), header


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """(path, number, primary, secondary, user_data) of every packet of raw files, cut by the lengths in their headers."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, content in zip(files["path"], files["content"], strict=True):
                out, at = [], 0
                while at + 6 <= len(content):
                    size = struct.unpack_from(">H", content, at + 4)[0] + 1
                    body = content[at + 6 : at + 6 + size]
                    out.append((name, len(out), content[at : at + 6], body[:62], body[62:]))
                    at += 6 + size
                yield pd.DataFrame(out, columns=["path", "number", "primary", "secondary", "user_data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cut, "path string, number long, primary binary, secondary binary, user_data binary")


def tile_payloads(cells: DataFrame, tile: str, writer: str = "npz") -> DataFrame:
    """(tile, payload): each tile's bands as one npz, npy, json, GeoTIFF or HDF5 document (bands/NAME).  A tile is bounded by the grid; its cells meet in one task."""
    if writer not in TILE_FORMATS:
        raise ValueError(f"no such tile writer: {writer}")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        arrays = {}
        for band, part in pdf.groupby("band"):
            a = np.full((part["row"].max() + 1, part["col"].max() + 1), np.nan, "float32")
            a[part["row"], part["col"]] = part["value"]
            arrays[band] = a
        out = io.BytesIO()
        if writer == "npz":
            np.savez(out, **arrays)
        elif writer == "npy":
            np.save(out, np.stack([arrays[b] for b in sorted(arrays)]))
        elif writer == "geotiff":
            from .grids import geotiff_bytes

            out.write(geotiff_bytes([arrays[b] for b in sorted(arrays)]))
        elif writer == "h5":
            from .hdf5 import hdf5_bytes

            out.write(hdf5_bytes({f"bands/{b}": a for b, a in sorted(arrays.items())}, {"": {"tile": str(pdf[tile].iloc[0])}}))
        else:
            out.write(json.dumps({b: a.tolist() for b, a in sorted(arrays.items())}).encode())
        return pd.DataFrame({tile: [pdf[tile].iloc[0]], "payload": [out.getvalue()]})

    return cells.select(tile, "band", "row", "col", "value").groupBy(tile).applyInPandas(pack, f"{tile} string, payload binary")


def write_tiles(cells: DataFrame, path: str, tile: str = "tile") -> None:
    """Cells as Parquet in a folder a tile: the working format of this engine."""
    cells.write.partitionBy(tile).mode("overwrite").parquet(path)


#: Names of tile formats and their endings.
TILE_FORMATS = {"npz": ".npz", "npy": ".npy", "json": ".json", "geotiff": ".tif", "h5": ".h5"}
_ALIASES = {"numpy": "npy", "tif": "geotiff", "tiff": "geotiff", "gtiff": "geotiff", "hdf5": "h5"}


def tile_format(name: str | None) -> str:
    """The format that a name stands for, npz without one."""
    plain = (name or "npz").strip().lower().lstrip(".")
    found = _ALIASES.get(plain, plain)
    if found not in TILE_FORMATS:
        raise ValueError(f"no such tile format: {name}; there are {', '.join(TILE_FORMATS)}")
    return found


def tile_path(folder: str, tile, writer: str | None = None):
    """Column of the path of a tile's file."""
    return F.concat(F.lit(folder.rstrip("/") + "/"), tile, F.lit(TILE_FORMATS[tile_format(writer)]))


def find_raw_files(spark: SparkSession, folder: str, pol: str) -> DataFrame:
    """Paths of the .dat files of a polarisation anywhere under a folder: the second last letters group of their names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.dat").load(folder).select("path")
    return files.where(F.lower(F.element_at(F.split("path", "/"), -1)).rlike(rf"(^|[^a-z]){re.escape(pol.lower())}([^a-z]|$)"))
