"""Polygons on rasters by scan lines, tie-point grids, and elevation tiles as one model.

No pixel meets a polygon that it isn't in: edges become the rows that they
cross, the crossings of a row are sorted, and every second gap between them is
a run of pixels.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# polygons


def raster_runs(polygons: DataFrame, keys: Sequence[str], rings: str, height: int, width: int) -> DataFrame:
    """(keys, row, first, last): runs of the pixels whose centres are inside polygons, by the even-odd rule over all their
    rings (arrays of x, y in pixels, whose corners are whole numbers; closed or not).  Polygons may be given in parts,
    a row each; centres on a left or upper edge are inside, on a right or lower one outside."""
    ring = polygons.select(*keys, F.explode(rings).alias("__ring")).where(F.size("__ring") > 2)
    n = F.size("__ring")
    edge = ring.select(*keys, "__ring", n.alias("__n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("__i"))
    a, b = F.get("__ring", F.col("__i")), F.get("__ring", (F.col("__i") + 1) % F.col("__n"))
    edge = edge.select(*keys, a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    top, end = F.greatest(F.ceil(low - 0.5), F.lit(0)), F.least(F.ceil(high - 0.5), F.lit(height)) - 1
    lines = edge.where(top <= end).select("*", F.explode(F.sequence(top, end)).alias("row"))
    across = F.col("ax") + (F.col("row") + 0.5 - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    crossings = lines.select(*keys, "row", across.alias("__x")).groupBy(*keys, "row").agg(F.sort_array(F.collect_list("__x")).alias("__x"))
    pair = F.transform(F.sequence(F.lit(0), F.size("__x") - 2, F.lit(2)), lambda i: F.struct(F.get("__x", i).alias("a"), F.get("__x", i + 1).alias("b")))
    runs = crossings.where(F.size("__x") > 1).select(*keys, "row", F.explode(pair).alias("__p"))
    first, last = F.greatest(F.ceil(F.col("__p.a") - 0.5), F.lit(0)), F.least(F.ceil(F.col("__p.b") - 0.5), F.lit(width)) - 1
    return runs.select(*keys, F.col("row").cast("int").alias("row"), first.cast("int").alias("first"), last.cast("int").alias("last")).where("first <= last")


def rasterized(polygons: DataFrame, keys: Sequence[str], rings: str, height: int, width: int) -> DataFrame:
    """(keys, row, col) of the pixels of raster_runs()."""
    return raster_runs(polygons, keys, rings, height, width).select(*keys, "row", F.explode(F.sequence("first", "last")).alias("col"))


def burned(image: DataFrame, polygons: DataFrame, keys: Sequence[str], rings: str, height: int, width: int, row: str = "row", col: str = "col", out: str = "inside") -> DataFrame:
    """image with whether each pixel is in any polygon of its keys."""
    pixels = rasterized(polygons, keys, rings, height, width).select(*keys, F.col("row").alias(row), F.col("col").alias(col)).distinct().withColumn(out, F.lit(True))
    return image.join(pixels, [*keys, row, col], "left").withColumn(out, F.coalesce(out, F.lit(False)))


# tie points


def tie_cells(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, i, j, c00, c01, c10, c11): the cells between tie points (keys, i, j, row, col, lat, lon), by four equi joins of
    the grid with itself; corners are structs (row, col, lat, lon)."""
    own = points.select(*keys, "i", "j", F.struct("row", "col", "lat", "lon").alias("c"))
    moved = lambda di, dj, name: own.select(*keys, (F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("c").alias(name))
    out = moved(0, 0, "c00")
    for di, dj, name in ((0, 1, "c01"), (1, 0, "c10"), (1, 1, "c11")):
        out = out.join(moved(di, dj, name), [*keys, "i", "j"])
    return out


def _between(name: str, v: Column, u: Column) -> Column:
    c = lambda k: F.col(f"{k}.{name}")
    return (1 - v) * ((1 - u) * c("c00") + u * c("c01")) + v * ((1 - u) * c("c10") + u * c("c11"))


def placed_on_ground(pixels: DataFrame, points: DataFrame, keys: Sequence[str], row_step: float, col_step: float, row: str = "row", col: str = "col") -> DataFrame:
    """pixels with lat and lon, bilinear between tie points that lie every row_step rows and col_step columns from 0 on;
    pixels beyond the last points go with the last cell, others without a cell are null."""
    grid = points.groupBy(*keys).agg((F.max("i") - 1).alias("__ni"), (F.max("j") - 1).alias("__nj"))
    cells = tie_cells(points, keys)
    p = (pixels.join(grid, list(keys), "left") if keys else pixels.crossJoin(F.broadcast(grid)))  # without keys the grid is one row
    i, j = F.least(F.floor(F.col(row) / row_step), F.col("__ni")), F.least(F.floor(F.col(col) / col_step), F.col("__nj"))
    p = p.withColumns({"i": i.cast(points.schema["i"].dataType), "j": j.cast(points.schema["j"].dataType)}).join(cells, [*keys, "i", "j"], "left")
    v, u = F.col(row) / row_step - F.col("i"), F.col(col) / col_step - F.col("j")
    return p.select(*pixels.columns, _between("lat", v, u).alias("lat"), _between("lon", v, u).alias("lon"))


def placed_in_image(ground: DataFrame, points: DataFrame, keys: Sequence[str], bin_deg: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """ground with y and x, the row and column where it lies between the tie points; null outside of all cells.

    Cells are listed under the squares of bin_deg degrees that they touch and meet
    ground points by an equi join on these; the bilinear map of each candidate is
    inverted by Newton steps, and the cell that holds the point counts (the first one of two that share an edge).
    """
    cells = tie_cells(points, keys)
    corners = ("c00", "c01", "c10", "c11")
    edge = lambda f, name: F.floor(f(*[F.col(f"{c}.{name}") for c in corners]) / bin_deg)
    cells = cells.withColumn("__a", F.explode(F.sequence(edge(F.least, "lat"), edge(F.greatest, "lat")))).withColumn("__o", F.explode(F.sequence(edge(F.least, "lon"), edge(F.greatest, "lon"))))
    targets = ground.withColumn("__id", F.xxhash64(*keys, lat, lon))
    met = targets.select(*keys, lat, lon, "__id").distinct().withColumns({"__a": F.floor(F.col(lat) / bin_deg), "__o": F.floor(F.col(lon) / bin_deg)}).join(cells, [*keys, "__a", "__o"])
    flat = [F.col(f"{c}.{n}").cast("double").alias(f"{c}_{n}") for c in corners for n in ("row", "col", "lat", "lon")]
    met = met.select(*keys, lat, lon, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), *flat)
    schema = T.StructType([*(met.schema[k] for k in keys), met.schema[lat], met.schema[lon], *(T.StructField(n, T.LongType()) for n in "ij"), *(T.StructField(n, T.DoubleType()) for n in "yx")])

    def invert(batches):
        for batch in batches:
            c = {n: batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in [lat, lon, *(f"{k}_{n}" for k in corners for n in ("row", "col", "lat", "lon"))]}
            mix = lambda n, v, u: (1 - v) * ((1 - u) * c[f"c00_{n}"] + u * c[f"c01_{n}"]) + v * ((1 - u) * c[f"c10_{n}"] + u * c[f"c11_{n}"])  # noqa: B023, E731
            slope = lambda n, v, u: ((1 - u) * (c[f"c10_{n}"] - c[f"c00_{n}"]) + u * (c[f"c11_{n}"] - c[f"c01_{n}"]), (1 - v) * (c[f"c01_{n}"] - c[f"c00_{n}"]) + v * (c[f"c11_{n}"] - c[f"c10_{n}"]))  # noqa: B023, E731
            v = u = np.full(batch.num_rows, 0.5)
            with np.errstate(divide="ignore", invalid="ignore"):
                for _ in range(25):
                    ra, ro = c[lat] - mix("lat", v, u), c[lon] - mix("lon", v, u)
                    (av, au), (ov, ou) = slope("lat", v, u), slope("lon", v, u)
                    det = av * ou - au * ov
                    dv, du = (ra * ou - au * ro) / det, (av * ro - ra * ov) / det
                    v, u = v + dv, u + du
                    if not len(v) or np.nanmax(np.abs(dv) + np.abs(du)) < 1e-13:
                        break
                good = (v >= -1e-9) & (v <= 1 + 1e-9) & (u >= -1e-9) & (u <= 1 + 1e-9)
            keep = pa.array(np.flatnonzero(good))
            own = [batch.column(n).take(keep) for n in [*keys, lat, lon, "i", "j"]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(mix("row", v, u)[good]), pa.array(mix("col", v, u)[good])], names=[f.name for f in schema])

    found = met.mapInArrow(invert, schema).groupBy(*keys, lat, lon).agg(F.min(F.struct("i", "j", "y", "x")).alias("__f"))
    return ground.join(found, [*keys, lat, lon], "left").select(*ground.columns, F.col("__f.y").alias("y"), F.col("__f.x").alias("x"))


# elevation


def elevation_model(tiles: DataFrame, per_degree: int, nodata: float | None = None) -> DataFrame:
    """(row, col, height) of one model from tiles (lat0, lon0: the lower left corner in whole degrees; row, col from the upper
    left; height; priority): row 0 lies at latitude 90, column 0 at longitude -180, both grow by 1 / per_degree degrees.
    Where tiles overlap, as at shared edges, the known height of the least priority counts."""
    row = (90 - F.col("lat0") - 1) * per_degree + F.col("row")
    col = (F.col("lon0") + 180) * per_degree + F.col("col")
    known = F.col("height").isNotNull() & ~F.isnan("height") & (F.lit(True) if nodata is None else F.col("height") != nodata)
    placed = tiles.where(known).select(row.cast("long").alias("row"), col.cast("long").alias("col"), "height", "priority", "lat0", "lon0")
    return placed.groupBy("row", "col").agg(F.min_by("height", F.struct("priority", "lat0", "lon0")).alias("height"))
