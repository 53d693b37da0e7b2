"""Partitioned readers of chunked and stripped raster files, from their public formats alone.

Zarr arrays (version 2) are read a chunk a row and GeoTIFF images a strip or
tile a batch; both give cells (path, band, row, col, value), so filters and
aggregations follow as on any table.  Only whole files that Spark's own file
access lists are read, so any store works.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import Content, File, list_files
from .readers import CELLS, cell_batch


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text, hidden names included."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


#: Codecs that chunks are read and written with.
ZARR_CODECS = (None, "zlib", "gzip", "zstd")


def zarr_info(spark: SparkSession, path: str) -> dict:
    """shape, chunks, dtype, fill_value, order and codec of a Zarr array; a codec that isn't one of ZARR_CODECS is an error."""
    about = json.loads(read_text(spark, f"{path.rstrip('/')}/.zarray"))
    codec = (about.get("compressor") or {}).get("id")
    if codec not in ZARR_CODECS or about.get("filters"):
        raise NotImplementedError(f"{path}: codec {codec} or filters; arrays without a codec, with zlib, gzip and zstd are read")
    return {**{k: about[k] for k in ("shape", "chunks", "dtype", "fill_value")}, "order": about.get("order", "C"), "separator": about.get("dimension_separator", "."), "codec": codec}


def zarr_attributes(spark: SparkSession, path: str) -> dict:
    """The user attributes of an array or group."""
    return json.loads(read_text(spark, f"{path.rstrip('/')}/.zattrs"))


def _inflated(content: bytes, codec: str | None) -> bytes:
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(content)
    return content if codec is None else zlib.decompress(content, 47 if codec == "gzip" else 15)


def deflated(content: bytes, codec: str | None, level: int) -> bytes:
    """A chunk's bytes in a codec."""
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=level).compress(content)
    if codec is None:
        return content
    maker = zlib.compressobj(level, zlib.DEFLATED, 31 if codec == "gzip" else 15)
    return maker.compress(content) + maker.flush()


def zarr_cells(chunks: DataFrame, info: dict, path: str, band: str = "data", component: str = "real") -> DataFrame:
    """Cells (path, band, row, col, value) of chunks (name, content) of a two-dimensional array; names that aren't a
    chunk's give none."""
    if len(info["shape"]) != 2:
        raise ValueError(f"{path}: an array of {len(info['shape'])} dimensions")
    (height, width), (ch, cw) = info["shape"], info["chunks"]
    name = re.compile(rf"(?:^|/)(\d+){re.escape(info['separator'])}(\d+)$")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = name.search(file)
                if at is None:
                    continue
                a = np.frombuffer(_inflated(content, info["codec"]), info["dtype"]).reshape((ch, cw), order=info["order"])
                r0, c0 = int(at[1]) * ch, int(at[2]) * cw
                a = getattr(a[: max(0, height - r0), : max(0, width - c0)], component)
                for r in range(0, len(a), 256):
                    rows, cols = np.indices(a[r : r + 256].shape)
                    yield cell_batch(path, band, (rows + r + r0).ravel(), (cols + c0).ravel(), a[r : r + 256].ravel())

    return chunks.mapInArrow(cells, CELLS)


def read_zarr(spark: SparkSession, path: str, band: str = "data", component: str = "real") -> DataFrame:
    """Cells of a two-dimensional Zarr array, a row of its folder's listing (a chunk) at a time.

    Chunks that aren't there hold the fill value and give no cells.  Of complex
    values ``component`` (real or imag) is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return zarr_cells(files, zarr_info(spark, path), path, band, component)


#: Fixed values of the TIFF format: bytes and letter of field types, letters of sample formats.
_FIELD = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
_SAMPLE = {1: "u", 2: "i", 3: "f", 6: "c"}
_WIDTH, _HEIGHT, _BITS, _CODEC, _OFFSETS, _PER_PIXEL, _ROWS, _COUNTS, _PLANAR, _PREDICTOR, _TILE_W, _TILE_H, _TILE_AT, _TILE_N, _FORMAT, _SCALE, _TIE = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339, 33550, 33922


def tiff_tags(source: Content | File | bytes) -> tuple[str, dict[int, tuple]]:
    """(byte order, tag -> values) of the first image of a TIFF file; of a File only its directory is read."""
    source = Content(source) if isinstance(source, bytes) else source
    head = source.read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8 or struct.unpack_from(order + "H", head, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(order + "I", head, 4)[0]
    n = struct.unpack(order + "H", source.read(at, 2))[0]
    entries, tags = source.read(at + 2, 12 * n), {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", entries, 12 * k)
        if kind not in _FIELD:
            continue
        size, letter = _FIELD[kind]
        raw = entries[12 * k + 8 : 12 * k + 12] if size * count <= 4 else source.read(struct.unpack_from(order + "I", entries, 12 * k + 8)[0], size * count)
        tags[tag] = struct.unpack_from(f"{order}{count}{letter}", raw)
    return order, tags


class TiffLayout:
    """Where the strips or tiles of an image lie and how they are coded; none and deflate are its codecs."""

    def __init__(self, source: Content | File | bytes):
        self.order, tags = tiff_tags(source)
        one = lambda tag, other: tags.get(tag, (other,))[0]
        self.height, self.width, self.bands, self.planar = one(_HEIGHT, 0), one(_WIDTH, 0), one(_PER_PIXEL, 1), one(_PLANAR, 1)
        self.deflated, self.steps = one(_CODEC, 1) != 1, one(_PREDICTOR, 1) == 2
        if one(_CODEC, 1) not in (1, 8, 32946) or one(_PREDICTOR, 1) not in (1, 2):
            raise NotImplementedError(f"TIFF codec {one(_CODEC, 1)} with predictor {one(_PREDICTOR, 1)}; images without a codec and deflated ones are read")
        self.kind = np.dtype(f"{self.order}{_SAMPLE[one(_FORMAT, 1)]}{one(_BITS, 8) // 8}")
        tiled = _TILE_AT in tags
        self.block = (one(_TILE_H, 0), one(_TILE_W, 0)) if tiled else (min(self.height, one(_ROWS, self.height)), self.width)
        self.places = list(zip(tags[_TILE_AT if tiled else _OFFSETS], tags[_TILE_N if tiled else _COUNTS], strict=True))

    def values(self, k: int, raw: bytes) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(band, first row, first column, values) of the k-th strip or tile."""
        bh, bw = self.block
        across, down = -(-self.width // bw), -(-self.height // bh)
        per_block = self.bands if self.planar == 1 else 1
        plane, place = divmod(k, across * down)
        r0, c0 = place // across * bh, place % across * bw
        a = np.frombuffer(zlib.decompress(raw) if self.deflated else raw, self.kind)
        a = a.reshape(-1, bw, per_block)[: min(bh, self.height - r0)]
        if self.steps:
            a = np.cumsum(a, 1, dtype=a.dtype)
        for b in range(per_block):
            yield (plane if self.planar != 1 else b), r0, c0, a[:, : self.width - c0, b]


def tiff_blocks(content: bytes) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(band, first row, first column, values) of the strips or tiles of a TIFF image."""
    layout = TiffLayout(content)
    for k, (at, n) in enumerate(layout.places):
        yield from layout.values(k, content[at : at + n])


#: Stored bytes of strips or tiles that a task reads together.
STRIP_BYTES = 4 << 20


def read_geotiff(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Cells of all bands (band_1, band_2, ...) of GeoTIFF files.

    The directory of each file is read first; its strips or tiles, listed with
    their places, are dealt over tasks, which read their own ranges.  ``whole``
    gives tasks whole files through Spark, for stores that only Spark reads.
    """

    def cells(file: str, blocks: Iterator[tuple[int, int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for band, r0, c0, a in blocks:
            for r in range(0, len(a), 256):
                rows, cols = np.indices(a[r : r + 256].shape)
                yield cell_batch(file, f"band_{band + 1}", (rows + r + r0).ravel(), (cols + c0).ravel(), a[r : r + 256].real.ravel())

    def from_contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from cells(file, tiff_blocks(content))

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                source = File(file)
                sizes = np.array([n for _, n in TiffLayout(source).places], np.int64)
                source.close()
                part = (np.cumsum(sizes) - sizes) // STRIP_BYTES
                first = np.flatnonzero(np.diff(part, prepend=-1))
                last = np.append(first[1:], len(sizes))
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(first)), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["path", "first", "last"])

    def from_strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                source = File(file)
                layout = TiffLayout(source)
                for k in range(first, last):
                    yield from cells(file, layout.values(k, source.read(*layout.places[k])))
                source.close()

    if whole:
        return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(from_contents, CELLS)
    parts = list_files(spark, path).select("path").mapInArrow(strips, "path string, first long, last long")
    return parts.repartition("path", "first").mapInArrow(from_strips, CELLS)


def geotiff_info(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, bands, x0, y0, dx, dy) of GeoTIFF files by their directories; origin and pixel size are null without a map."""

    def about(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            rows = []
            for file in files["path"]:
                source = File(file)
                _, tags = tiff_tags(source)
                source.close()
                dx, dy = tags[_SCALE][:2] if _SCALE in tags else (None, None)
                x0, y0 = tags[_TIE][3:5] if _TIE in tags else (None, None)
                rows.append((file, tags[_HEIGHT][0], tags[_WIDTH][0], tags.get(_PER_PIXEL, (1,))[0], x0, y0, dx, -dy if dy is not None else None))
            yield pd.DataFrame(rows, columns=["path", "height", "width", "bands", "x0", "y0", "dx", "dy"])

    schema = "path string, height int, width int, bands int, x0 double, y0 double, dx double, dy double"
    return list_files(spark, path).select("path").mapInPandas(about, schema)


def geotiff_bytes(arrays: list[np.ndarray], origin: tuple[float, float] | None = None, pixel: tuple[float, float] = (1.0, 1.0)) -> bytes:
    """A GeoTIFF file of float32 bands, one deflated strip each, on a map if an origin (x, y of the upper left corner) is given."""
    height, width = arrays[0].shape
    strips = [zlib.compress(np.ascontiguousarray(a, "<f4").tobytes(), 6) for a in arrays]
    n = len(arrays)
    tags: list[tuple[int, str, tuple]] = [
        (_WIDTH, "I", (width,)), (_HEIGHT, "I", (height,)), (_BITS, "H", (32,) * n), (_CODEC, "H", (8,)), (262, "H", (1,)), (_OFFSETS, "I", (0,) * n), (_PER_PIXEL, "H", (n,)),
        (_ROWS, "I", (height,)), (_COUNTS, "I", tuple(map(len, strips))), (_PLANAR, "H", (2,)), (_FORMAT, "H", (3,) * n),
    ]
    if origin is not None:
        tags += [(_SCALE, "d", (pixel[0], abs(pixel[1]), 0.0)), (_TIE, "d", (0.0, 0.0, 0.0, *origin, 0.0))]
    kinds = {"H": 3, "I": 4, "d": 12}
    at = 8 + 2 + 12 * len(tags) + 4
    values = [struct.pack(f"<{len(v)}{c}", *v) for _, c, v in tags]
    places = []
    for raw in values:
        places.append(at if len(raw) > 4 else None)
        at += len(raw) + len(raw) % 2 if len(raw) > 4 else 0
    offsets = []
    for s in strips:
        offsets.append(at)
        at += len(s)
    values[5] = struct.pack(f"<{n}I", *offsets)
    head = struct.pack("<2sHIH", b"II", 42, 8, len(tags))
    for (tag, c, v), raw, place in zip(tags, values, places, strict=True):
        head += struct.pack("<HHI", tag, kinds[c], len(v)) + (raw.ljust(4, b"\0") if place is None else struct.pack("<I", place))
    body = b"".join(raw + b"\0" * (len(raw) % 2) for raw, place in zip(values, places, strict=True) if place is not None)
    return head + b"\0\0\0\0" + body + b"".join(strips)


# parts of arrays that are tables of cells


def array_slice(cells: DataFrame, rows: tuple[int, int, int] | None = None, cols: tuple[int, int, int] | None = None) -> DataFrame:
    """Cells within ranges (start, stop, step) of rows and columns, numbered from 0 there."""
    for name, span in (("row", rows), ("col", cols)):
        if span is not None:
            start, stop, step = span
            c = F.col(name)
            cells = cells.where((c >= start) & (c < stop) & ((c - start) % step == 0)).withColumn(name, F.floor((c - start) / step).cast("int"))
    return cells


def array_without(cells: DataFrame, rows: tuple[int, int] | list[int] | None = None, cols: tuple[int, int] | list[int] | None = None) -> DataFrame:
    """Cells without a range (start, stop) or a list of rows and columns; those left are numbered on."""
    for name, gone in (("row", rows), ("col", cols)):
        if gone is None:
            continue
        c = F.col(name)
        if isinstance(gone, tuple):
            start, stop = gone
            cells = cells.where((c < start) | (c >= stop)).withColumn(name, F.when(c >= stop, c - (stop - start)).otherwise(c))
        else:
            order = sorted(set(gone))
            before = sum((F.when(c > g, 1).otherwise(0) for g in order), F.lit(0))
            cells = cells.where(~c.isin(*order)).withColumn(name, c - before)
    return cells


def array_block(cells: DataFrame, height: int, blocks: int, index: int) -> DataFrame:
    """Rows of one of ``blocks`` equal parts; the last one takes the remainder."""
    size = height // blocks
    last = height if index == blocks - 1 else (index + 1) * size
    return cells.where((F.col("row") >= index * size) & (F.col("row") < last))


def array_info(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Height, width and number of cells of each array."""
    return cells.groupBy(*keys).agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"), F.count("*").alias("cells"))


def with_coordinates(cells: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """Map coordinates of each cell's upper left corner."""
    return cells.withColumns({"x": x0 + F.col("col") * dx, "y": y0 + F.col("row") * dy})


def cut_by_box(cells: DataFrame, box: tuple[float, float, float, float], x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """Cells whose corners lie in the pixel window of a box (min_x, min_y, max_x, max_y): its edges rounded outwards, so that
    the filter is on rows and columns alone; a box beside the raster is an error only where it is looked at."""
    min_x, min_y, max_x, max_y = box
    c0, c1 = int(np.floor((min_x - x0) / dx)), int(np.ceil((max_x - x0) / dx))
    r0, r1 = sorted((int(np.floor((max_y - y0) / dy)), int(np.ceil((min_y - y0) / dy))))
    return cells.where((F.col("col") >= max(0, c0)) & (F.col("col") < c1) & (F.col("row") >= max(0, r0)) & (F.col("row") < r1))


def cut_by_ring(cells: DataFrame, ring: list[tuple[float, float]], x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """Cells in the pixel window of a polygon; values whose corner is outside of it are NaN."""
    from ..functions.geo import inside

    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    part = with_coordinates(cut_by_box(cells, (min(xs), min(ys), max(xs), max(ys)), x0, y0, dx, dy), x0, y0, dx, dy)
    return part.withColumn("value", F.when(inside(F.col("x"), F.col("y"), ring), F.col("value")).otherwise(F.lit(float("nan")).cast("float"))).drop("x", "y")
