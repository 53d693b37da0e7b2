"""Between the ground and radar images: orbits, zero-Doppler times, terrain correction and coregistration by geometry.

Orbits, elevations and images are tables.  An orbit is a few states a product;
it goes to the blocks of its product's pixels, and a task solves one block at
a time with numpy, all pixels at once, by Newton steps.  Positions are ordinary
columns from there on, and values come to them by equi joins of pixel numbers
(geometry.sampled), so neither an image nor an elevation model is in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .geometry import sampled
from .neighbourhoods import slope_aspect

#: WGS 84: semi-major axis and flattening.
A, FLATTENING = 6378137.0, 1 / 298.257223563
B = A * (1 - FLATTENING)
E2 = FLATTENING * (2 - FLATTENING)
#: Pixels of a block, each way.
BLOCK = 256
STEPS = 30


def earth_fixed(lat: Column, lon: Column, height: Column) -> tuple[Column, Column, Column]:
    """Earth-fixed coordinates in metres of degrees and metres."""
    lat, lon = F.radians(lat), F.radians(lon)
    n = A / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    return (n + height) * F.cos(lat) * F.cos(lon), (n + height) * F.cos(lat) * F.sin(lon), (n * (1 - E2) + height) * F.sin(lat)


def geodetic(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(latitude, longitude, height) of earth-fixed points, one a row."""
    x, y, z = points.T
    p = np.hypot(x, y)
    lat = np.arctan2(z, p * (1 - E2))
    for _ in range(8):
        n = A / np.sqrt(1 - E2 * np.sin(lat) ** 2)
        lat = np.arctan2(z + E2 * n * np.sin(lat), p)
    n = A / np.sqrt(1 - E2 * np.sin(lat) ** 2)
    polar = np.abs(lat) > 1.4
    height = np.where(polar, np.abs(z) / np.where(polar, np.abs(np.sin(lat)), 1) - n * (1 - E2), p / np.where(polar, 1, np.cos(lat)) - n)
    return np.degrees(lat), np.degrees(np.arctan2(y, x)), height


class Orbit:
    """States (times, positions, velocities) between which a cubic keeps both at its ends."""

    def __init__(self, times: np.ndarray, positions: np.ndarray, velocities: np.ndarray):
        order = np.argsort(times, kind="stable")
        self.t, first = np.unique(np.asarray(times, float)[order], return_index=True)
        if len(self.t) < 2:
            raise ValueError("an orbit of fewer than two states")
        self.p, self.v = np.asarray(positions, float)[order][first], np.asarray(velocities, float)[order][first]

    def at(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, velocity, acceleration) at times; beyond the states the last cubic goes on."""
        k = np.clip(np.searchsorted(self.t, t, "right") - 1, 0, len(self.t) - 2)  # NaN times give NaN
        h = (self.t[k + 1] - self.t[k])[:, None]
        s = (t - self.t[k])[:, None] / h
        p0, p1, v0, v1 = self.p[k], self.p[k + 1], self.v[k] * h, self.v[k + 1] * h
        c2, c3 = 3 * (p1 - p0) - 2 * v0 - v1, 2 * (p0 - p1) + v0 + v1
        return p0 + s * (v0 + s * (c2 + s * c3)), (v0 + s * (2 * c2 + 3 * s * c3)) / h, (2 * c2 + 6 * s * c3) / (h * h)

    def zero_doppler(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(time, slant range) at which each point is square to the flight; NaN outside of the states' times."""
        t = np.empty(len(points))
        for a in range(0, len(points), 4096):
            part = points[a : a + 4096]
            t[a : a + 4096] = self.t[np.argmin(((part[:, None, :] - self.p[None]) ** 2).sum(2), 1)]
        for _ in range(STEPS):
            p, v, acc = self.at(t)
            d = points - p
            step = (d * v).sum(1) / ((v * v).sum(1) - (d * acc).sum(1))
            t = t + step
            if np.abs(step).max(initial=0.0) < 1e-11:
                break
        p, _, _ = self.at(t)
        reach = 1e-6 * (self.t[-1] - self.t[0])
        away = (t < self.t[0] - reach) | (t > self.t[-1] + reach)
        return np.where(away, np.nan, t), np.where(away, np.nan, np.sqrt(((points - p) ** 2).sum(1)))

    def ground(self, t: np.ndarray, slant: np.ndarray, height: np.ndarray, right: bool = True) -> np.ndarray:
        """Earth-fixed points at times, slant ranges and heights over the ellipsoid, on one side of the flight."""
        p, v, _ = self.at(t)
        up = p / np.linalg.norm(p, axis=1)[:, None]
        side = np.cross(v, up) * (1 if right else -1)
        side /= np.linalg.norm(side, axis=1)[:, None]
        radius = np.linalg.norm(p, axis=1)
        # on a sphere of the earth's radius below
        earth = A * (1 - FLATTENING * up[:, 2] ** 2) + height
        cosine = np.clip((radius**2 + slant**2 - earth**2) / (2 * radius * slant), -1, 1)
        x = p + slant[:, None] * (-up * cosine[:, None] + side * np.sqrt(1 - cosine**2)[:, None])
        extra = np.array(height, float)
        for _ in range(4):  # the height over the ellipsoid isn't quite the axes' growth
            for _ in range(STEPS):
                d = x - p
                axes = np.stack([A + extra, A + extra, B + extra], 1)
                f = np.stack([(d * d).sum(1) - slant**2, (d * v).sum(1), ((x / axes) ** 2).sum(1) - 1], 1)
                step = np.linalg.solve(np.stack([2 * d, v, 2 * x / axes**2], 1), f[:, :, None])[:, :, 0]
                x = x - step
                if np.abs(step).max(initial=0.0) < 1e-6:
                    break
            extra = extra + height - geodetic(x)[2]
        return x


_STATES = ("t", "x", "y", "z", "vx", "vy", "vz")


def _by_blocks(pixels: DataFrame, orbits: DataFrame, keys: Sequence[str], row: str, col: str, needs: Sequence[str], adds: Sequence[str], solve: Callable[[Orbit, dict[str, np.ndarray]], Sequence[np.ndarray]], grid: DataFrame | None = None) -> DataFrame:
    """pixels with columns ``adds`` that solve(orbit, needed columns) makes, a block of a product's pixels at a time.
    grid: a table with the same keys, rows and columns that names the blocks, where pixels are costly to make twice."""
    br, bc = F.floor(F.col(row) / BLOCK).alias("__br"), F.floor(F.col(col) / BLOCK).alias("__bc")
    placed = pixels.select("*", br, bc)
    own = orbits.select(*keys, *_STATES)
    group = [*keys, "__br", "__bc"]
    named = [f"__of_{g}" for g in group]
    blocks = (placed if grid is None else grid.select(*keys, br, bc)).select(*group).distinct().join(own, list(keys)).select(*(F.col(g).alias(n) for g, n in zip(group, named, strict=True)), *_STATES)
    schema = T.StructType([*pixels.schema, *(T.StructField(a, T.DoubleType()) for a in adds)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = left.drop_columns(["__br", "__bc"])
        if not len(left):
            columns = [np.zeros(0)] * len(adds)
        elif not len(right):
            columns = [np.full(len(left), np.nan)] * len(adds)
        else:
            s = {c: right[c].to_numpy().astype(float) for c in _STATES}
            orbit = Orbit(s["t"], np.stack([s["x"], s["y"], s["z"]], 1), np.stack([s["vx"], s["vy"], s["vz"]], 1))
            given = {c: left[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in needs}
            good = np.isfinite(np.stack(list(given.values()))).all(0)
            columns = [np.full(len(left), np.nan) for _ in adds]
            if good.any():
                for c, found in zip(columns, solve(orbit, {k: v[good] for k, v in given.items()}), strict=True):
                    c[good] = found
        for name, c in zip(adds, columns, strict=True):
            out = out.append_column(name, pa.array(c, pa.float64(), mask=np.isnan(c)))
        return out

    return placed.groupBy(*group).cogroup(blocks.groupBy(*named)).applyInArrow(run, schema)


def radar_positions(ground: DataFrame, orbits: DataFrame, keys: Sequence[str], row: str = "row", col: str = "col", lat: str = "lat", lon: str = "lon", height: str = "height", sensor: bool = False) -> DataFrame:
    """ground with azimuth_time and slant_range of its pixels; null without a height or an orbit, and beyond its times.
    orbits: (keys, t, x, y, z, vx, vy, vz), the states of each product.  sensor: also its place then, sensor_x, _y, _z."""
    x, y, z = earth_fixed(F.col(lat), F.col(lon), F.col(height))

    def solve(orbit: Orbit, c: dict[str, np.ndarray]) -> Sequence[np.ndarray]:
        t, slant = orbit.zero_doppler(np.stack([c["__x"], c["__y"], c["__z"]], 1))
        return (t, slant, *(orbit.at(t)[0].T if sensor else ()))

    adds = ["azimuth_time", "slant_range", *(["sensor_x", "sensor_y", "sensor_z"] if sensor else [])]
    found = _by_blocks(ground.withColumns({"__x": x, "__y": y, "__z": z}), orbits, keys, row, col, ["__x", "__y", "__z"], adds, solve)
    return found.drop("__x", "__y", "__z")


def ground_positions(pixels: DataFrame, orbits: DataFrame, keys: Sequence[str], row: str = "row", col: str = "col", time: str = "azimuth_time", slant: str = "slant_range", height: str = "height", right: bool = True, grid: DataFrame | None = None) -> DataFrame:
    """pixels of a radar image with lat and lon of the ground that they see at their height; grid as in _by_blocks."""

    def solve(orbit: Orbit, c: dict[str, np.ndarray]) -> Sequence[np.ndarray]:
        return geodetic(orbit.ground(c[time], c[slant], c[height], right))[:2]

    return _by_blocks(pixels, orbits, keys, row, col, [time, slant, height], ["lat", "lon"], solve, grid)


def image_place(first_time: float | Column, line_time: float | Column, near_range: float | Column, spacing: float | Column) -> tuple[Column, Column]:
    """(y, x) in a radar image's pixels of azimuth_time and slant_range."""
    return (F.col("azimuth_time") - first_time) / line_time, (F.col("slant_range") - near_range) / spacing


def terrain_corrected(image: DataFrame, ground: DataFrame, orbits: DataFrame, keys: Sequence[str], value: str, first_time, line_time, near_range, spacing, row: str = "row", col: str = "col", method: str = "bilinear", **names) -> DataFrame:
    """ground pixels (keys, row, col, lat, lon, height) with the radar image's value at their place, and that place (y, x).
    A constant height makes it the correction to the ellipsoid."""
    y, x = image_place(first_time, line_time, near_range, spacing)
    placed = radar_positions(ground, orbits, keys, row, col, **names).withColumns({"y": y, "x": x})
    return sampled(image, placed, row, col, value, method=method, keys=keys)


def ellipsoid_corrected(image: DataFrame, ground: DataFrame, orbits: DataFrame, keys: Sequence[str], value: str, first_time, line_time, near_range, spacing, height: float = 0.0, **more) -> DataFrame:
    """Range-Doppler correction onto the ellipsoid, or a surface at one height over it."""
    return terrain_corrected(image, ground.withColumn("height", F.lit(float(height))), orbits, keys, value, first_time, line_time, near_range, spacing, **more)


def with_heights(pixels: DataFrame, elevation: DataFrame, lat0: float, lon0: float, dlat: float, dlon: float, lat: str = "lat", lon: str = "lon", height: str = "height") -> DataFrame:
    """pixels with the elevation (row, col, height; centre of 0, 0 at lat0, lon0) at their place, bilinear."""
    own = [c for c in pixels.columns if c != height]
    placed = pixels.select(*own).withColumns({"__y": (F.col(lat) - lat0) / dlat, "__x": (F.col(lon) - lon0) / dlon})
    return sampled(elevation, placed, "row", "col", "height", "__y", "__x").withColumnRenamed("height", height).drop("__y", "__x")


def geocoded_pixels(pixels: DataFrame, orbits: DataFrame, keys: Sequence[str], elevation: DataFrame, lat0: float, lon0: float, dlat: float, dlon: float, rounds: int = 6, start: float = 0.0, right: bool = True, row: str = "row", col: str = "col") -> DataFrame:
    """Radar pixels (keys, row, col, azimuth_time, slant_range) with lat, lon and height on an elevation model: each round
    looks up the height where the one before put the pixel."""
    out = pixels.withColumn("height", F.lit(float(start)))
    for _ in range(rounds):
        out = ground_positions(out, orbits, keys, row, col, right=right, grid=pixels)
        out = with_heights(out, elevation, lat0, lon0, dlat, dlon).drop("lat", "lon")
    return ground_positions(out, orbits, keys, row, col, right=right, grid=pixels)


def back_geocoded(image: DataFrame, reference: DataFrame, orbits: DataFrame, keys: Sequence[str], value: str, first_time, line_time, near_range, spacing, row: str = "row", col: str = "col", method: str = "bilinear") -> DataFrame:
    """A second image on the pixels of a reference image by geometry alone: ``reference`` holds the reference's pixels with
    their ground (lat, lon, height; see geocoded_pixels), orbits and the times and ranges are the second image's.  Its
    place there is (y, x)."""
    return terrain_corrected(image, reference, orbits, keys, value, first_time, line_time, near_range, spacing, row, col, method)


def backscatter_of_incidence(cosine: Column) -> Column:
    """Muhleman's law: backscatter of the cosine of the local incidence angle, 0 where the ground looks away."""
    sine = F.sqrt(F.greatest(1 - cosine * cosine, F.lit(0.0)))
    return F.when(cosine > 0, 0.0133 * cosine / F.pow(sine + 0.1 * cosine, 3)).otherwise(0.0)


def simulated_image(ground: DataFrame, orbits: DataFrame, keys: Sequence[str], cell_m: float, first_time, line_time, near_range, spacing, row: str = "row", col: str = "col") -> DataFrame:
    """(keys, row, col, value, n) of the radar image that a surface would give: every ground cell adds Muhleman's
    backscatter to the pixel that sees it, and n of them do; more than one is layover."""
    slopes = slope_aspect(ground, keys, row, col, "height", cell_m).select(*keys, row, col, "slope", "aspect")
    found = radar_positions(ground, orbits, keys, row, col)
    # the look direction on the ground comes from the change of range over the surface: its gradient along rows and columns
    flat = radar_positions(ground.withColumn("height", F.lit(0.0)), orbits, keys, row, col).select(*keys, row, col, F.col("slant_range").alias("__flat"))
    east = flat.select(*keys, row, (F.col(col) - 1).cast(flat.schema[col].dataType).alias(col), F.col("__flat").alias("__east"))
    south = flat.select(*keys, (F.col(row) - 1).cast(flat.schema[row].dataType).alias(row), col, F.col("__flat").alias("__south"))
    j = found.join(flat, [*keys, row, col]).join(east, [*keys, row, col], "left").join(south, [*keys, row, col], "left").join(slopes, [*keys, row, col], "left")
    ge, gs = (F.col("__east") - F.col("__flat")) / cell_m, (F.col("__south") - F.col("__flat")) / cell_m
    sine = F.least(F.sqrt(ge * ge + gs * gs), F.lit(1.0))  # of the incidence on flat ground
    s, a = F.radians(F.coalesce("slope", F.lit(0.0))), F.radians(F.coalesce("aspect", F.lit(0.0)))
    # the surface's normal is (east, north, up); the sensor lies against the growth of range
    cosine = F.sqrt(1 - sine * sine) * F.cos(s) + F.sin(s) * (-ge * F.sin(a) + gs * F.cos(a))
    y, x = image_place(first_time, line_time, near_range, spacing)
    seen = j.where("azimuth_time IS NOT NULL AND __east IS NOT NULL AND __south IS NOT NULL")
    seen = seen.select(*keys, F.floor(y + 0.5).cast("int").alias("__r"), F.floor(x + 0.5).cast("int").alias("__c"), backscatter_of_incidence(cosine).alias("__b"))
    return seen.groupBy(*keys, F.col("__r").alias(row), F.col("__c").alias(col)).agg(F.sum("__b").alias("value"), F.count("*").alias("n"))
