"""Zarr arrays (version 2) and groups written from tables of cells.

Cells are dealt to tasks by their chunk; a task encodes a chunk and writes its
file under a name of its own, then moves it into place, so a task that runs
twice leaves one whole file.  All of it goes to a stage folder beside the
target; metadata comes last there, and only then the stage takes the target's
place.  A write that fails or is killed leaves the target as it was, and what
it left in the stage has no metadata and can't be read as an array.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator, Mapping, Sequence
from datetime import date, datetime
from enum import Enum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .grids import ZARR_CODECS, array_slice, deflated, read_zarr, zarr_info
from .hdf5 import read_h5, read_h5_objects
from .ranges import file_system


def square_chunks(shape: Sequence[int]) -> tuple[int, int]:
    """Chunks of a single image: a quarter of the shorter side, from 64 to 512."""
    side = max(64, min(512, shape[0] // 4, shape[1] // 4))
    return side, side


def tile_chunks(shape: Sequence[int], chunks: Sequence[int] | str | None = "auto") -> tuple[int, ...]:
    """Chunks asked for, cut to the array; ``auto`` and None are up to 4096 a side.  Two positive numbers are needed."""
    if chunks is None or chunks == "auto":
        return tuple(min(n, 4096) for n in shape)
    values = tuple(int(c) for c in chunks)
    if len(values) != 2 or min(values) <= 0:
        raise ValueError(f"chunks have to be two positive whole numbers, not {chunks!r}")
    if len(shape) == 1:
        return (min(values[1], shape[0]),)
    return (*(1 for _ in shape[:-2]), min(values[0], shape[-2]), min(values[1], shape[-1]))


def plain(value):
    """A value as JSON can hold it: enumerations by their value, dates as text, missing and non-finite numbers as None."""
    if isinstance(value, Enum):
        return plain(value.value)
    if isinstance(value, Mapping):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if isinstance(value, bytes):
        return value.decode("utf-8", "replace")
    if isinstance(value, np.ndarray):
        return plain(value.tolist())
    if isinstance(value, np.generic):
        return plain(value.item())
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)


def array_about(shape: Sequence[int], chunks: Sequence[int], dtype: str, codec: str | None = "zlib", level: int = 5, fill_value: float = 0) -> dict:
    """The .zarray document of an array."""
    if codec not in ZARR_CODECS:
        raise ValueError(f"no such codec: {codec}")
    fill = fill_value if math.isfinite(fill_value) else "NaN" if math.isnan(fill_value) else "Infinity" if fill_value > 0 else "-Infinity"
    if np.dtype(dtype).kind == "c" and fill_value != 0:
        raise ValueError("complex arrays are filled with 0")
    return {"zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": np.dtype(dtype).str, "fill_value": 0 if np.dtype(dtype).kind == "c" else fill, "order": "C", "filters": None, "compressor": codec and {"id": codec, "level": level}}


def zarr_chunks(cells: DataFrame, about: dict, value: str = "value", imag: str | None = None) -> DataFrame:
    """(name, content): the encoded chunks of cells (row, col, value[, imag]).  Cells outside of the array are an error;
    cells that aren't there hold the fill value, and a chunk without cells isn't written."""
    (height, width), (ch, cw) = about["shape"], about["chunks"]
    codec, level = ((about["compressor"] or {}).get(k) for k in ("id", "level"))
    dtype, fill = np.dtype(about["dtype"]), about["fill_value"]

    def encode(table: pa.Table) -> pa.Table:
        rows, cols = table["row"].to_numpy().astype(np.int64), table["col"].to_numpy().astype(np.int64)
        if rows.min() < 0 or rows.max() >= height or cols.min() < 0 or cols.max() >= width:
            raise ValueError(f"cells outside of an array of {height} x {width}")
        r, c = int(rows[0] // ch), int(cols[0] // cw)
        a = np.full((ch, cw), float(fill) if isinstance(fill, str) else fill, dtype)
        values = table["value"].to_numpy()
        if imag is not None:
            values = values + 1j * table["imag"].to_numpy()
        a[rows - r * ch, cols - c * cw] = values
        return pa.table({"name": [f"{r}.{c}"], "content": [deflated(a.tobytes(), codec, level)]})

    columns = [F.col("row"), F.col("col"), F.col(value).cast("double").alias("value"), *([F.col(imag).cast("double").alias("imag")] if imag else [])]
    keyed = cells.select(*columns, F.floor(F.col("row") / ch).alias("__r"), F.floor(F.col("col") / cw).alias("__c"))
    return keyed.groupBy("__r", "__c").applyInArrow(encode, "name string, content binary")


def _write_files(chunks: DataFrame, folder: str) -> None:
    """Writes (name, content) as files of a folder, each in one move."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = file_system(folder)
        system.create_dir(inner, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = f"{inner}/.{name}-{uuid.uuid4().hex}"
                with system.open_output_stream(own) as out:
                    out.write(content)
                system.move(own, f"{inner}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    chunks.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    import pyarrow.fs as pafs

    system, inner = file_system(folder)
    for left in system.get_file_info(pafs.FileSelector(inner, allow_not_found=True)):  # of attempts that were lost
        if left.base_name.startswith("."):
            system.delete_file(left.path)


def _write_json(folder: str, name: str, document: dict) -> None:
    system, inner = file_system(folder)
    system.create_dir(inner, recursive=True)
    with system.open_output_stream(f"{inner}/{name}") as out:
        out.write(json.dumps(document, indent=1).encode())


class _Stage:
    """A folder beside the target that takes its place when all went well."""

    def __init__(self, path: str, overwrite: bool):
        self.path = path.rstrip("/")
        self.system, self.inner = file_system(self.path)
        if self._there(self.inner) and not overwrite:
            raise FileExistsError(f"{path} is there already")
        parent, _, name = self.path.rpartition("/")
        self.folder = f"{parent}/_stage-{name}-{uuid.uuid4().hex}"

    def _there(self, inner: str) -> bool:
        return self.system.get_file_info(inner).type.name != "NotFound"

    def __enter__(self) -> str:
        return self.folder

    def __exit__(self, kind, *_) -> None:
        stage = file_system(self.folder)[1]
        if kind is not None:
            if self._there(stage):
                self.system.delete_dir(stage)
            return
        if self._there(self.inner):
            self.system.delete_dir(self.inner)
        self.system.move(stage, self.inner)


def _write_array(folder: str, cells: DataFrame, about: dict, attributes: dict, value: str = "value", imag: str | None = None) -> None:
    _write_files(zarr_chunks(cells, about, value, imag), folder)
    _write_json(folder, ".zattrs", plain(attributes))
    _write_json(folder, ".zarray", about)


def write_zarr(cells: DataFrame, path: str, shape: Sequence[int], chunks: Sequence[int] | str | None = None, dtype: str = "<f4", codec: str | None = "zlib", level: int = 5, fill_value: float = 0, attributes: dict | None = None, value: str = "value", imag: str | None = None, overwrite: bool = False) -> None:
    """One array of cells (row, col, value[, imag]); chunks None: square_chunks()."""
    about = array_about(shape, square_chunks(shape) if chunks is None else tile_chunks(shape, chunks), dtype, codec, level, fill_value)
    with _Stage(path, overwrite) as folder:
        _write_array(folder, cells, about, attributes or {}, value, imag)


def write_zarr_group(arrays: dict[str, tuple[DataFrame, Sequence[int]]], path: str, attributes: dict | None = None, array_attributes: dict[str, dict] | None = None, groups: dict[str, dict] | None = None, chunks="auto", dtype: str = "<f4", codec: str | None = "zlib", level: int = 5, imag: str | None = None, overwrite: bool = False) -> None:
    """Arrays (cells, shape) by their paths in a group, with attributes of the group, its arrays and further groups."""
    with _Stage(path, overwrite) as folder:
        inner = {name.rpartition("/")[0] for name in arrays} | set(groups or ())
        inner |= {"/".join(name.split("/")[:k]) for name in inner for k in range(1, name.count("/") + 1)}
        for name, (cells, shape) in arrays.items():
            _write_array(f"{folder}/{name}", cells, array_about(shape, tile_chunks(shape, chunks), dtype, codec, level), (array_attributes or {}).get(name, {}), imag=imag)
        for name in sorted(inner - {""}):
            _write_json(f"{folder}/{name}", ".zattrs", plain((groups or {}).get(name, {})))
            _write_json(f"{folder}/{name}", ".zgroup", {"zarr_format": 2})
        _write_json(folder, ".zattrs", plain(attributes or {}))
        _write_json(folder, ".zgroup", {"zarr_format": 2})


#: Stages of focusing that a result holds, fixed by its readers.
STAGES = ("raw", "rc", "rcmc", "az")


def write_focused(result: dict, path: str, chunks="auto", level: int = 5, overwrite: bool = True) -> None:
    """The stages of focusing, (cells (row, col, value, imag), shape) each, with the tables of metadata and ephemeris as
    records in the group's attributes."""
    missing = [k for k in (*STAGES, "metadata", "ephemeris") if k not in result]
    if missing:
        raise ValueError(f"a result without {', '.join(missing)}")
    records = {k: {"data": [r.asDict(recursive=True) for r in result[k].collect()] if isinstance(result[k], DataFrame) else result[k]} for k in ("metadata", "ephemeris")}
    write_zarr_group({k: result[k] for k in STAGES}, path, records, chunks=chunks, dtype="<c8", level=level, imag="imag", overwrite=overwrite)


def export_slice(spark: SparkSession, path: str, to: str, rows: tuple[int, int, int], cols: tuple[int, int, int], overwrite: bool = False) -> None:
    """A part (start, stop, step) of an array as an array of its own, in the same codec."""
    info = zarr_info(spark, path)
    rows, cols = (slice(*s).indices(n) for s, n in zip((rows, cols), info["shape"], strict=True))
    shape = [len(range(*rows)), len(range(*cols))]
    cells = array_slice(read_zarr(spark, path), rows, cols)
    imag = None
    if np.dtype(info["dtype"]).kind == "c":
        more = array_slice(read_zarr(spark, path, component="imag"), rows, cols).select("row", "col", F.col("value").alias("imag"))
        cells, imag = cells.join(more, ["row", "col"]), "imag"
    write_zarr(cells, to, shape, [min(c, n) for c, n in zip(info["chunks"], shape, strict=True)], info["dtype"], info["codec"], imag=imag, overwrite=overwrite)


def h5_to_zarr(spark: SparkSession, path: str, to: str, chunks="auto", overwrite: bool = False, whole: bool = False) -> None:
    """A tile in HDF5 as a Zarr group of the same arrays, groups and attributes; its bands are few, its cells stay in tables."""
    objects = read_h5_objects(spark, path, whole).select("name", "kind", "shape", "type", "attributes").collect()
    cells = read_h5(spark, path, whole=whole)
    arrays = {o["name"]: (cells.where(F.col("band") == o["name"]), o["shape"]) for o in objects if o["kind"] == "dataset" and len(o["shape"]) == 2}
    about = {o["name"]: o["attributes"] for o in objects}
    groups = {o["name"]: o["attributes"] for o in objects if o["kind"] == "group" and o["name"]}
    write_zarr_group(arrays, to, about[""], about, groups, chunks, overwrite=overwrite)
