"""Focus measures, distribution and gradient losses, patches, velocities and row balance."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.complexes import conj_product, phase
from ..functions.guards import nan


def centroid_variance(df: DataFrame, keys: Sequence[str], row: str, col: str, magnitude: str, normalized: bool = False) -> DataFrame:
    """Spread about the weighted centroid, in pixels, or on axes from 0 to 1: second moments by sums, one pass."""
    y, x, m = F.col(row).cast("double"), F.col(col).cast("double"), F.col(magnitude)
    s = F.sum(m) + 1e-8
    var = lambda a: F.sum(m * a * a) / s - (F.sum(m * a) / s) * (F.sum(m * a) / s) * (2 - F.sum(m) / s)
    scale = lambda a: F.greatest(F.max(a) * F.max(a), F.lit(1.0)) if normalized else F.lit(1.0)
    return df.groupBy(*keys).agg((var(y) / scale(y) + var(x) / scale(x)).alias("variance"))


def normalized_entropy(x: Column, eps: float = 1e-8) -> Column:
    """Entropy of shares over the logarithm of their number."""
    s = F.sum(x) + eps
    h = F.log(s) - F.sum(F.when(x > 0, x * F.log(x)).otherwise(0.0)) / s
    return F.when(F.count(x) > 1, h / F.log(F.count(x).cast("double"))).otherwise(0.0)


def moments_loss(p: Column, t: Column) -> Column:
    """Squared differences of mean, deviation, skewness and kurtosis, weighted 2, 2, 0.5 and 0.5."""
    sq = lambda a, b: (a - b) * (a - b)
    return 2 * sq(F.avg(p), F.avg(t)) + 2 * sq(F.stddev_pop(p), F.stddev_pop(t)) + 0.5 * sq(F.skewness(p), F.skewness(t)) + 0.5 * sq(F.kurtosis(p), F.kurtosis(t))


def histogram_l1(df: DataFrame, keys: Sequence[str], p: str, t: str, bins: int = 100) -> DataFrame:
    """L1 distance of the two value histograms over their common range; counts hold at most ``bins`` rows a key."""
    ends = df.groupBy(*keys).agg(F.least(F.min(p), F.min(t)).alias("__lo"), F.greatest(F.max(p), F.max(t)).alias("__hi"), F.count("*").alias("__n"))
    long = df.select(*keys, F.explode(F.array(F.struct(F.col(p).alias("v"), F.lit(1).alias("s")), F.struct(F.col(t).alias("v"), F.lit(-1).alias("s")))).alias("__x")).join(ends, list(keys))
    b = F.when(F.col("__hi") > F.col("__lo"), F.least(F.lit(bins - 1), F.floor((F.col("__x.v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins))).otherwise(0)
    cells = long.groupBy(*keys, "__n", b.alias("__b")).agg(F.sum("__x.s").alias("d"))
    return cells.groupBy(*keys).agg(F.sum(F.abs("d") / F.col("__n")).alias("l1"))


def distribution_aware_mse(df: DataFrame, keys: Sequence[str], p: str, t: str) -> DataFrame:
    """Squared error weighted by the squared standard score of the target (sample deviation)."""
    s = df.groupBy(*keys).agg(F.avg(t).alias("__m"), F.stddev_samp(t).alias("__s"))
    z = (F.col(t) - F.col("__m")) / (F.col("__s") + 1e-8)
    return df.join(s, list(keys)).groupBy(*keys).agg(F.avg((F.col(p) - F.col(t)) * (F.col(p) - F.col(t)) * z * z).alias("loss"))


def gradient_matching(df: DataFrame, keys: Sequence[str], row: str, col: str, p: str, t: str) -> DataFrame:
    """Mean squared difference of gradients along rows plus along columns."""
    across, down = W.partitionBy(*keys, row).orderBy(col), W.partitionBy(*keys, col).orderBy(row)
    d = F.col(p) - F.col(t)
    df = df.withColumn("__d", d)
    gx, gy = F.lead("__d").over(across) - F.col("__d"), F.lead("__d").over(down) - F.col("__d")
    return df.select(*keys, (gx * gx).alias("x"), (gy * gy).alias("y")).groupBy(*keys).agg((F.avg("x") + F.avg("y")).alias("loss"))


def phase_smoothness(df: DataFrame, keys: Sequence[str], row: str, col: str, re: str, im: str) -> DataFrame:
    """Mean squared phase step to the next column plus to the next row."""
    across, down = W.partitionBy(*keys, row).orderBy(col), W.partitionBy(*keys, col).orderBy(row)

    def step(w) -> Column:
        a = phase(*conj_product(F.lead(re).over(w), F.lead(im).over(w), F.col(re), F.col(im)))
        return a * a

    return df.select(*keys, step(across).alias("x"), step(down).alias("y")).groupBy(*keys).agg((F.avg("x") + F.avg("y")).alias("loss"))


def symmetry_loss(df: DataFrame, keys: Sequence[str], row: str, col: str, value: str) -> DataFrame:
    """Mean squared difference to the image mirrored left to right: an equi join of a pixel with its mirror."""
    width = df.groupBy(*keys).agg(F.max(col).alias("__w"))
    df = df.join(width, list(keys))
    other = df.select(*keys, row, (F.col("__w") - F.col(col)).alias(col), F.col(value).alias("__o"))
    j = df.join(other, [*keys, row, col])
    return j.groupBy(*keys).agg(F.avg((F.col(value) - F.col("__o")) * (F.col(value) - F.col("__o"))).alias("loss"))


def resolution_gain(df: DataFrame, keys: Sequence[str], line: str, original: str, sharper: str, threshold: float = 0.5) -> DataFrame:
    """Ratio of the main-lobe lengths of two autocorrelations above a threshold, averaged over lines of arrays."""

    @F.pandas_udf("double")
    def lobe(x: pd.Series) -> pd.Series:
        def length(v: np.ndarray) -> float:
            v = np.abs(np.asarray(v, float) - np.mean(v))
            a = np.correlate(v, v, "full")[len(v) - 1 :]
            return float(np.argmax(np.append(a / max(a[0], 1e-30) < threshold, True)))

        return x.map(length)

    lobes = df.select(*keys, lobe(original).alias("o"), lobe(sharper).alias("s"))
    return lobes.groupBy(*keys).agg(F.when(F.avg("s") > 0, F.avg("o") / F.avg("s")).otherwise(nan()).alias("gain"))


def patch_windows(spark: SparkSession, height: int, width: int, size: int | tuple[int, int] = 1024, drop_incomplete: bool = True) -> DataFrame:
    """(row, col, height, width) of the patches of a raster, square ones or of size (height, width)."""
    down, across = (size, size) if isinstance(size, int) else size
    rows = spark.range(0, height, down).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(width - 1), F.lit(across))).alias("col"))
    out = rows.select("row", F.col("col").cast("long").alias("col"), F.least(F.lit(down), height - F.col("row")).alias("height"), F.least(F.lit(across), width - F.col("col")).cast("long").alias("width"))
    return out.where((F.col("height") == down) & (F.col("width") == across)) if drop_incomplete else out


def clamped_window(col: Column, row: Column, width: Column, height: Column, max_width: int, max_height: int) -> Column:
    """A window cut to the raster."""
    c0, r0 = F.greatest(F.lit(0), col), F.greatest(F.lit(0), row)
    return F.struct(c0.alias("col"), r0.alias("row"), F.greatest(F.lit(0), F.least(F.lit(max_width), col + width) - c0).alias("width"), F.greatest(F.lit(0), F.least(F.lit(max_height), row + height) - r0).alias("height"))


def row_balance(df: DataFrame, keys: Sequence[str], row: str, look: str, re: str, im: str, smooth: int = 5, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Looks with the root mean square of each row brought to the median over looks, by a smoothed gain within limits."""
    power = df.groupBy(*keys, look, row).agg(F.sqrt(F.avg(F.col(re) * F.col(re) + F.col(im) * F.col(im))).alias("__rms"))
    ref = power.groupBy(*keys, row).agg(F.median("__rms").alias("__ref"))
    gain = power.join(ref, [*keys, row]).withColumn("__g", F.when(F.col("__rms") > 0, F.col("__ref") / F.col("__rms")).otherwise(1.0))
    half = smooth // 2
    w = W.partitionBy(*keys, look).orderBy(row).rowsBetween(-half, half)
    gain = gain.withColumn("__g", F.least(F.lit(high), F.greatest(F.lit(low), F.avg("__g").over(w)))).select(*keys, look, row, "__g")
    return df.join(gain, [*keys, look, row]).withColumn(re, F.col(re) * F.col("__g")).withColumn(im, F.col(im) * F.col("__g")).drop("__g")


def spectrum_normalized(df: DataFrame, keys: Sequence[str], frequency: str, magnitude: str) -> DataFrame:
    """Magnitudes over the mean of their frequency row (zero counts as 1e-6), times the median of these means."""
    means = df.groupBy(*keys, frequency).agg(F.avg(magnitude).alias("__mean")).withColumn("__mean", F.when(F.col("__mean") == 0, 1e-6).otherwise(F.col("__mean")))
    mid = means.groupBy(*keys).agg(F.median("__mean").alias("__mid"))
    return df.join(means, [*keys, frequency]).join(mid, list(keys)).withColumn(magnitude, F.col(magnitude) / F.col("__mean") * F.col("__mid")).drop("__mean", "__mid")


def effective_velocity(x: Column, y: Column, z: Column, vx: Column, vy: Column, vz: Column, slant_range_m: float) -> Column:
    """Effective velocity of a platform over the WGS84 ellipsoid: root of platform speed times the speed of its ground point."""
    a, b = 6378137.0, 6356752.314245
    r = F.sqrt(x * x + y * y + z * z)
    v = F.sqrt(vx * vx + vy * vy + vz * vz)
    lat = F.asin(z / r)
    c, s = F.cos(lat), F.sin(lat)
    local = F.sqrt(((a * a * c) * (a * a * c) + (b * b * s) * (b * b * s)) / ((a * c) * (a * c) + (b * s) * (b * s)))
    cos_beta = (local * local + r * r - slant_range_m * slant_range_m) / (2 * local * r)
    return F.sqrt(v * (v / r * local * cos_beta))


def rfi_pulses(n: int, rate_hz: float, low_hz: float, high_hz: float, seed: int = 0) -> np.ndarray:
    """A chirped interference pulse for tests of filters."""
    t = np.arange(n) / rate_hz
    start = np.random.default_rng(seed).uniform(0, 2 * math.pi)
    return np.exp(1j * (start + 2 * math.pi * (low_hz * t + (high_hz - low_hz) * t * t * rate_hz / (2 * n))))
