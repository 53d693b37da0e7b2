"""Footprints of products: hulls of points, rings of manifests, swath grids of annotations.

A hull is made in two passes: every task keeps the hull of the points that it
sees of each key, and the hulls of a key meet in one task, so what is sent
follows the number of tasks and not of points.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def hull_of(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, clockwise from the lowest (then leftmost) point; collinear points are no corners."""
    p = np.unique(points, axis=0)  # by x, then y
    if len(p) < 3:
        return p

    def chain(q: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for x, y in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x - out[-2][0]) >= 0:
                out.pop()
            out.append((x, y))
        return out[:-1]

    q = list(map(tuple, p.tolist()))
    corners = chain(q) + chain(q[::-1])  # left to right over the top, and back
    start = min(range(len(corners)), key=lambda k: (corners[k][1], corners[k][0]))
    return np.array(corners[start:] + corners[:start])


def convex_hull(points: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, ring) of the points of each key: the hull closed, clockwise; null for fewer than three corners.  Points
    without finite coordinates are left out."""
    good = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf")))
    rows = good.select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            order = table.append_column("__i", pa.array(np.arange(len(table)))).group_by(list(keys)).aggregate([("__i", "list")])
            xy = np.stack([batch.column("__x").to_numpy(), batch.column("__y").to_numpy()], 1)
            keep = []
            for members in order["__i_list"].to_pylist():
                own = xy[members]
                corners = set(map(tuple, hull_of(own).tolist()))
                for k in members:  # one row of each corner
                    if tuple(xy[k].tolist()) in corners:
                        corners.discard(tuple(xy[k].tolist()))
                        keep.append(k)
            yield batch.take(pa.array(keep, pa.int64()))

    def whole(table: pa.Table) -> pa.Table:
        corners = hull_of(np.stack([table["__x"].to_numpy(), table["__y"].to_numpy()], 1))
        ring = [{"x": float(a), "y": float(b)} for a, b in [*corners, corners[0]]] if len(corners) > 2 else None
        return table.select(list(keys)).slice(0, 1).append_column("ring", pa.array([ring], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))

    partial = rows.mapInArrow(of_batch, rows.schema)
    return partial.groupBy(*keys).applyInArrow(whole, T.StructType([*(points.schema[k] for k in keys), T.StructField("ring", _RING)]))


def ring_area(ring: Column) -> Column:
    """Area of a closed ring."""
    steps = F.sequence(F.lit(0), F.size(ring) - 2)
    twice = F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.get(ring, i)["x"] * F.get(ring, i + 1)["y"] - F.get(ring, i + 1)["x"] * F.get(ring, i)["y"])
    return F.abs(twice) / 2


def ring_wkt(ring: Column) -> Column:
    """POLYGON text of a ring."""
    number = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    return F.concat(F.lit("POLYGON (("), F.array_join(F.transform(ring, lambda p: F.concat(number(p["x"]), F.lit(" "), number(p["y"]))), ", "), F.lit("))"))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def manifest_rings(text: str, latitude_first: bool = True) -> list[list[tuple[float, float]]]:
    """Rings (lon, lat) of the footPrint elements of a manifest, by pairs with commas or one list of numbers; closed;
    those of fewer than three points are left out."""
    out = []
    for footprint in (e for e in ElementTree.fromstring(text).iter() if _local(e.tag) == "footPrint"):
        found = {_local(e.tag): e.text for e in footprint.iter() if e.text and e.text.strip()}
        numbers = [float(x) for x in (found.get("coordinates") or found.get("posList") or "").replace(",", " ").split()]
        pairs = list(zip(numbers[::2], numbers[1::2], strict=False))
        ring = [(b, a) if latitude_first else (a, b) for a, b in pairs]
        if len(ring) >= 3:
            out.append(ring if ring[0] == ring[-1] else [*ring, ring[0]])
    return out


def manifest_footprints(manifests: DataFrame, path: str = "path", text: str = "value", latitude_first: bool = True) -> DataFrame:
    """(path, ring) of manifests: their one ring, or the hull of several; null without any, or without readable XML."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings = []
            for content in batch.column(1).to_pylist():
                try:
                    found = manifest_rings(content, latitude_first)
                except (ElementTree.ParseError, ValueError, TypeError):
                    found = []
                ring = found[0] if len(found) == 1 else None
                if len(found) > 1:
                    corners = hull_of(np.array([p for r in found for p in r]))
                    ring = [*map(tuple, corners), tuple(corners[0])] if len(corners) > 2 else None
                rings.append(ring and [{"x": float(a), "y": float(b)} for a, b in ring])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rings, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))], names=["path", "ring"])

    schema = T.StructType([T.StructField("path", manifests.schema[path].dataType), T.StructField("ring", _RING)])
    return manifests.select(path, text).mapInArrow(parse, schema)


def annotation_points(annotations: DataFrame, path: str = "path", text: str = "value") -> DataFrame:
    """(path, line, pixel, lat, lon, height) of the grid points of annotation files, streamed out of the XML; a file that
    can't be read gives the points before its fault."""
    names = ("line", "pixel", "latitude", "longitude", "height")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                try:
                    for _, e in ElementTree.iterparse(io.BytesIO((content or "").encode())):
                        if _local(e.tag) == "geolocationGridPoint":
                            own = {_local(c.tag): c.text for c in e}
                            if own.get("latitude") and own.get("longitude"):
                                rows.append(tuple(float(own[n]) if own.get(n) else None for n in names))
                            e.clear()
                except (ElementTree.ParseError, ValueError):
                    pass
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), *(pa.array(c, pa.float64()) for c in columns)], names=["path", "line", "pixel", "lat", "lon", "height"])

    return annotations.select(path, text).mapInArrow(parse, "path string, line double, pixel double, lat double, lon double, height double")


def swath_footprints(annotations: DataFrame, swath: str, path: str = "path", text: str = "value") -> DataFrame:
    """(product, ring): the hull of the grid points of a swath's annotations by product (the folder that ends in .SAFE)."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    own = annotations.where(name.contains(swath.lower()) & name.endswith(".xml"))
    points = annotation_points(own, path, text).withColumn("product", F.regexp_extract("path", r"([^/]+\.(?i:SAFE))/", 1))
    return convex_hull(points, ["product"], "lon", "lat")


def flat_wkt(wkt: Column) -> Column:
    """WKT without heights: the first two numbers of each point."""
    point = F.regexp_replace(wkt, r"([-+0-9.eE]+)[ \t\n]+([-+0-9.eE]+)(?:[ \t\n]+[-+0-9.eE]+)*", "$1 $2")
    return F.regexp_replace(point, r"\s*,\s*", ", ")
