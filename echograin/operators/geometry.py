"""Images on other grids, and filters and masks that go with them.

Resampling is an equi join: each pixel of the new grid says where it lies on the
old one, takes the pixel there (or the four around, with their weights), and a
sum by pixel puts them together.  Nothing holds an image.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import utm_inverse
from .focusing import rotated
from .kernels import complex_kernel, transformed_lines
from .neighbourhoods import box_mean_2d, slope_aspect

C_LIGHT = 299792458.0


def grid(spark: SparkSession, height: int, width: int, row: str = "row", col: str = "col") -> DataFrame:
    """All pixels of a grid; rows come from a range and explode into their columns on the executors."""
    return spark.range(height).select(F.col("id").cast("int").alias(row), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias(col))


def sampled(image: DataFrame, targets: DataFrame, row: str, col: str, value: str, y: str = "y", x: str = "x", method: str = "bilinear", keys: Sequence[str] = ()) -> DataFrame:
    """targets with the image's value at their place (y, x) in its pixels; null beyond its edge or beside a missing pixel.

    keys: columns of both that name the image of a stack.  nearest: halves go up.  bilinear: weights by the distance to the four pixels around; pixels of weight 0 aren't needed.
    """
    source = image.select(*keys, F.col(row).cast("long").alias("__i"), F.col(col).cast("long").alias("__j"), F.col(value).alias("__v"))
    fy, fx = F.floor(y), F.floor(x)
    if method == "nearest":
        placed = targets.withColumns({"__i": F.floor(F.col(y) + 0.5), "__j": F.floor(F.col(x) + 0.5)})
        return placed.join(source, [*keys, "__i", "__j"], "left").select(*targets.columns, F.col("__v").alias(value))
    if method != "bilinear":
        raise ValueError(f"no such method: {method}")
    wy, wx = F.col(y) - fy, F.col(x) - fx
    # a pixel goes to the four cells that it is a corner of; a target meets its cell once, so its own columns move once
    corners = [(i, j) for i in (0, 1) for j in (0, 1)]
    spread = source.withColumn("__c", F.explode(F.array(*[F.struct((F.col("__i") - i).alias("i"), (F.col("__j") - j).alias("j"), F.lit(1 << k).alias("k")) for k, (i, j) in enumerate(corners)])))
    own = [F.when(F.col("__c.k") == 1 << k, F.col("__v")) for k in range(4)]
    unknown = F.bit_or(F.when(F.col("__v").isNull(), F.col("__c.k")).otherwise(0))
    cells = spread.groupBy(*keys, F.col("__c.i").alias("__i"), F.col("__c.j").alias("__j")).agg(*[F.sum(v).alias(f"__v{k}") for k, v in enumerate(own)], unknown.alias("__unknown"))
    placed = targets.where(F.col(y).isNotNull() & F.col(x).isNotNull()).withColumns({"__i": fy, "__j": fx})
    whole = F.lit(0.0)
    for k, (i, j) in enumerate(corners):
        w = (wy if i else 1 - wy) * (wx if j else 1 - wx)
        whole = whole + F.when(w > 0, w * F.when(F.col("__unknown").bitwiseAND(1 << k) == 0, F.col(f"__v{k}"))).otherwise(0.0)
    return placed.join(cells, [*keys, "__i", "__j"], "left").select(*targets.columns, whole.alias(value))


def warped(image: DataFrame, row: str, col: str, value: str, height: int, width: int, y: Column, x: Column, method: str = "bilinear") -> DataFrame:
    """An image on a new grid whose pixels (row, col) lie at (y, x) of the old one."""
    return sampled(image, grid(image.sparkSession, height, width, row, col).withColumns({"y": y, "x": x}), row, col, value, method=method).drop("y", "x")


def reprojected(image: DataFrame, row: str, col: str, value: str, zone: int, south: bool, origin: tuple[float, float], spacing: tuple[float, float], size: tuple[int, int], lon0: float, lat0: float, dlon: float, dlat: float, method: str = "bilinear") -> DataFrame:
    """An image in degrees (centre of pixel 0, 0 at lon0, lat0) on a UTM grid (centre of pixel 0, 0 at the origin, rows to the south)."""
    east, north = origin[0] + F.col(col) * spacing[0], origin[1] - F.col(row) * spacing[1]
    lat, lon = utm_inverse(east, north, F.lit(zone), F.lit(south))
    return warped(image, row, col, value, *size, (lat - lat0) / dlat, (lon - lon0) / dlon, method)


def shifted_onto(image: DataFrame, row: str, col: str, value: str, height: int, width: int, rows: float, cols: float, method: str = "bilinear") -> DataFrame:
    """An image moved by a shift that offsets to a reference image gave: the pixel at (row + rows, col + cols) comes to (row, col)."""
    return warped(image, row, col, value, height, width, F.col(row) + rows, F.col(col) + cols, method)


def common_shift(offsets: DataFrame, least_peak: float = 0.0) -> tuple[float, float]:
    """The median shift (rows, columns) of the cells of an offset table whose peak is high enough."""
    found = offsets.where(F.col("peak") >= least_peak).agg(F.median("row_shift"), F.median("col_shift")).first()
    return float(found[0] or 0.0), float(found[1] or 0.0)


def ground_range(image: DataFrame, row: str, col: str, value: str, height: int, width: int, near_range_m: float, slant_spacing_m: float, altitude_m: float, ground_spacing_m: float, method: str = "bilinear") -> DataFrame:
    """Slant range to ground range over flat ground: columns at equal distances on the ground from the near edge on."""
    near_ground = math.sqrt(near_range_m**2 - altitude_m**2)
    g = near_ground + F.col(col) * ground_spacing_m
    slant = F.sqrt(g * g + altitude_m * altitude_m)
    return warped(image, row, col, value, height, width, F.col(row).cast("double"), (slant - near_range_m) / slant_spacing_m, method)


# phases


def demodulated(df: DataFrame, re: str, im: str, time_s: Column, centre_hz: float) -> DataFrame:
    """A band moved to the zero frequency."""
    return rotated(df, re, im, -2 * math.pi * centre_hz * time_s)


def deramped(df: DataFrame, re: str, im: str, time_s: Column, rate_hz_s: float, reference_s: float = 0.0) -> DataFrame:
    """A burst without the quadratic phase of its antenna's steering."""
    t = time_s - reference_s
    return rotated(df, re, im, -math.pi * rate_hz_s * t * t)


def phase_to_height(phase: Column, wavelength_m: float, slant_range_m: Column, incidence_deg: Column, baseline_m: float) -> Column:
    """Height over the reference by an unwrapped phase and the perpendicular baseline."""
    return -phase * wavelength_m * slant_range_m * F.sin(F.radians(incidence_deg)) / (4 * math.pi * baseline_m)


def band_limited(df: DataFrame, keys: Sequence[str], line: str, at: str, re: str, im: str, low: float, high: float, rate: float, alpha: float = 1.0) -> DataFrame:
    """Lines of which only the band [low, high] stays, for example the one that two images share, weighted by a Hamming
    window of alpha over the band; along columns it is an azimuth filter, along rows a range filter."""

    def run(z: np.ndarray) -> np.ndarray:
        f = np.fft.fftfreq(len(z), 1 / rate)
        u = np.clip((f - low) / max(high - low, 1e-30), 0, 1)
        return np.fft.ifft(np.fft.fft(z) * ((f >= low) & (f <= high)) * (alpha - (1 - alpha) * np.cos(2 * np.pi * u)))

    return transformed_lines(df, keys, line, at, re, im, complex_kernel(run))


# heights, speckle


def filled_holes(df: DataFrame, keys: Sequence[str], row: str, col: str, value: str, size: int = 3) -> DataFrame:
    """Missing heights by the mean of the known ones in a window, edge pixels repeated; those without any stay missing."""
    known = F.col(value).isNotNull() & ~F.isnan(value)
    parts = df.select(*keys, row, col, F.when(known, F.col(value)).otherwise(0.0).alias("__v"), F.when(known, 1.0).otherwise(0.0).alias("__n"))
    m = box_mean_2d(parts, keys, row, col, ["__v", "__n"], size)
    found = F.when(known, F.col(value)).when(F.col("__n") > 1e-9, F.col("__v") / F.col("__n"))
    return df.join(m, [*keys, row, col]).withColumn(value, found).drop("__v", "__n")


def terrain_mask(df: DataFrame, keys: Sequence[str], row: str, col: str, height: str, spacing: float, least_height: float = 40.0, least_slope: float = 0.0) -> DataFrame:
    """df with masked: pixels that are high enough and steep enough to be relief."""
    s = slope_aspect(df, keys, row, col, height, spacing).select(*keys, row, col, F.coalesce("slope", F.lit(0.0)).alias("__slope"))
    return df.join(s, [*keys, row, col]).withColumn("masked", (F.col(height) >= least_height) & (F.col("__slope") >= least_slope)).drop("__slope")


def speckle_divergence(df: DataFrame, keys: Sequence[str], row: str, col: str, intensity: str, size: int = 15, looks: float = 1.0) -> DataFrame:
    """How far the local variation of intensity is from that of speckle alone: (variance / mean^2 - 1 / looks) / (1 + 1 / looks)."""
    v = F.col(intensity)
    m = box_mean_2d(df.select(*keys, row, col, v.alias("m"), (v * v).alias("q")), keys, row, col, ["m", "q"], size)
    c2 = (F.col("q") - F.col("m") * F.col("m")) / (F.col("m") * F.col("m"))
    return m.select(*keys, row, col, F.when(F.col("m") > 0, (c2 - 1 / looks) / (1 + 1 / looks)).alias("divergence"))


def averaged_matrix(df: DataFrame, keys: Sequence[str], row: str, col: str, elements: Sequence[str], size: int = 5) -> DataFrame:
    """A polarimetric matrix averaged over a window, all elements alike, so that it stays one."""
    return box_mean_2d(df.select(*keys, row, col, *elements), keys, row, col, list(elements), size)
