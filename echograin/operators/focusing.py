"""From raw echoes to an image, and the spectra of sub-apertures: passes over lines and expressions over cells.

Rows are azimuth (slow time), columns range (fast time).  A pass along one axis
works on whole lines, of which a task holds some; multiplications by filters
are expressions over single cells.  Numbers of bins follow the usual order of a
discrete spectrum: the zero frequency first, negative ones in the upper half.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kernels import azimuth_phase, complex_kernel, fft_1d, ifft_1d, matched_filter, migration_phase, transformed_lines

C_LIGHT = 299792458.0


def frequency(bin_: Column, n: int, rate_hz: float) -> Column:
    """Frequency of a bin of an n-point spectrum."""
    return F.when(bin_ < (n + 1) // 2, bin_).otherwise(bin_ - n) * (rate_hz / n)


def centred_bin(bin_: Column, n: int) -> Column:
    """Place of a bin with the zero frequency in the middle."""
    return (bin_ + n // 2) % n


def rotated(df: DataFrame, re: str, im: str, phase: Column) -> DataFrame:
    """Values times exp(i phase)."""
    a, b, c, s = F.col(re), F.col(im), F.cos(phase), F.sin(phase)
    return df.withColumns({re: a * c - b * s, im: a * s + b * c})


def multiplied(df: DataFrame, weights: DataFrame, on: Sequence[str], re: str, im: str) -> DataFrame:
    """Values times complex weights (on..., w_re, w_im), for example one for each column: an equi join by the axis."""
    a, b, c, d = F.col(re), F.col(im), F.col("w_re"), F.col("w_im")
    return df.join(weights, list(on)).withColumns({re: a * c - b * d, im: a * d + b * c}).drop("w_re", "w_im")


def range_pass(df: DataFrame, keys: Sequence[str], row: str, col: str, re: str, im: str, inverse: bool = False) -> DataFrame:
    return transformed_lines(df, keys, row, col, re, im, ifft_1d() if inverse else fft_1d())


def azimuth_pass(df: DataFrame, keys: Sequence[str], row: str, col: str, re: str, im: str, inverse: bool = False) -> DataFrame:
    return transformed_lines(df, keys, col, row, re, im, ifft_1d() if inverse else fft_1d())


def padded(df: DataFrame, keys: Sequence[str], row: str, col: str, re: str, im: str, height: int, width: int, left: int = 0, right: int = 0, top: int = 0, bottom: int = 0) -> DataFrame:
    """An image with zeros around it, numbered from the new corner; the margin is made on the executors."""
    spark = df.sparkSession
    full = spark.range(height + top + bottom).select(F.col("id").cast("int").alias(row), F.explode(F.sequence(F.lit(0), F.lit(width + left + right - 1))).alias(col))
    margin = full.where((F.col(row) < top) | (F.col(row) >= top + height) | (F.col(col) < left) | (F.col(col) >= left + width))
    images = df.select(*keys).distinct() if keys else None
    margin = (images.crossJoin(margin) if images is not None else margin).withColumns({re: F.lit(0.0), im: F.lit(0.0)})
    moved = df.select(*keys, (F.col(row) + top).alias(row), (F.col(col) + left).alias(col), re, im)
    return moved.unionByName(margin)


def trimmed(df: DataFrame, row: str, col: str, height: int, width: int, left: int = 0, right: int = 0, top: int = 0, bottom: int = 0) -> DataFrame:
    """An image without its margin."""
    r, c = F.col(row), F.col(col)
    return df.where((r >= top) & (r < height - bottom) & (c >= left) & (c < width - right)).withColumns({row: r - top, col: c - left})


def range_compressed_spectrum(df: DataFrame, keys: Sequence[str], row: str, col: str, re: str, im: str, replica: np.ndarray, window: str = "hamming") -> DataFrame:
    """Lines to their range spectra times the matched filter of a replica."""

    def run(x: np.ndarray) -> np.ndarray:
        whole = np.zeros(len(x), complex)
        n = min(len(x), len(replica))
        whole[:n] = replica[:n]
        return np.fft.fft(x) * matched_filter(whole, window)

    return transformed_lines(df, keys, row, col, re, im, complex_kernel(run))


def focus_stages(df: DataFrame, keys: Sequence[str], row: str, col: str, re: str, im: str, height: int, width: int, replica: np.ndarray, sample_hz: float, prf_hz: float, wavelength_m: float, velocity: float, near_range_m: float, window: str = "hamming") -> dict[str, DataFrame]:
    """The image after each step of range-Doppler focusing: ``compressed`` in range (range and azimuth spectrum),
    ``migrated`` with range migration corrected at the middle of the swath (azimuth spectrum), and ``focused``."""
    args = (keys, row, col, re, im)
    compressed = azimuth_pass(range_compressed_spectrum(df, *args, replica, window), *args)
    doppler = frequency(F.col(row), height, prf_hz)
    middle = near_range_m + width / 2 * C_LIGHT / (2 * sample_hz)
    moved = rotated(compressed, re, im, migration_phase(frequency(F.col(col), width, sample_hz), doppler, middle, wavelength_m, velocity))
    migrated = range_pass(moved, *args, inverse=True)
    slant = near_range_m + F.col(col) * (C_LIGHT / (2 * sample_hz))
    focused = azimuth_pass(rotated(migrated, re, im, azimuth_phase(doppler, slant, wavelength_m, velocity)), *args, inverse=True)
    return {"compressed": compressed, "migrated": migrated, "focused": focused}


def convolved_2d(df: DataFrame, keys: Sequence[str], row: str, col: str, value: str, weights: Sequence[Sequence[float]]) -> DataFrame:
    """Linear convolution with a small kernel, of the image's size: each pixel gives a share to its neighbours, summed with a map-side part."""
    h, w = len(weights), len(weights[0])
    shares = F.array(*[F.struct(F.lit(i - h // 2).alias("i"), F.lit(j - w // 2).alias("j"), F.lit(float(x)).alias("w")) for i, line in enumerate(weights) for j, x in enumerate(line)])
    spread = df.select(*keys, row, col, value, F.explode(shares).alias("__s"))
    moved = spread.select(*keys, (F.col(row) + F.col("__s.i")).alias(row), (F.col(col) + F.col("__s.j")).alias(col), (F.col(value) * F.col("__s.w")).alias("__v"))
    sums = moved.groupBy(*keys, row, col).agg(F.sum("__v").alias(value))
    return sums.join(df.select(*keys, row, col), [*keys, row, col], "left_semi")


# sub-apertures


def look_frequencies(looks: int, bandwidth_hz: float, centre_hz: float = 0.0) -> list[tuple[int, float, float, float]]:
    """(look, lowest, centre, highest frequency) of equal parts of a band, from the lowest on."""
    step = bandwidth_hz / looks
    low = centre_hz - bandwidth_hz / 2
    return [(k, low + k * step, low + (k + 0.5) * step, low + (k + 1) * step) for k in range(looks)]


def spectral_profile(df: DataFrame, keys: Sequence[str], bin_: str, re: str, im: str) -> DataFrame:
    """(keys, bin, power): mean power of each frequency over the image."""
    return df.groupBy(*keys, bin_).agg(F.avg(F.col(re) * F.col(re) + F.col(im) * F.col(im)).alias("power"))


def smoothed_profile(profile: DataFrame, keys: Sequence[str], bin_: str, size: int) -> DataFrame:
    """power as a running sum over ``size`` bins (one more if that is even) over their number, with zeros beyond the ends; a
    profile has a row a bin, so its windows are small."""
    size += 1 - size % 2
    w = W.partitionBy(*keys).orderBy(bin_).rowsBetween(-(size // 2), size // 2)
    return profile.withColumn("power", F.sum("power").over(w) / size)


def central_bin(profile: DataFrame, keys: Sequence[str], bin_: str, bins: int, share: float = 0.8) -> DataFrame:
    """(keys, centre): the bin of most power among the middle ``share`` of the bins."""
    edge = int(bins * (1 - share) / 2)
    inner = profile.where((F.col(bin_) >= edge) & (F.col(bin_) < bins - edge))
    return inner.groupBy(*keys).agg(F.max_by(bin_, F.struct("power", -F.col(bin_))).alias("centre"))


def spectral_support(profile: DataFrame, keys: Sequence[str], bin_: str, threshold_db: float = -25.0, least: float = 0.15) -> DataFrame:
    """(keys, start, stop, peak, shift): the bins around the strongest one that stay above a threshold relative to it, counted
    after the profile is rolled by ``shift`` so that the strongest bin lies in the middle; at least a share ``least`` of all
    bins, and an even number of them.  Two aggregations over the profile, whose bins are numbered from 0."""
    tops = profile.groupBy(*keys).agg(F.max_by(bin_, F.struct("power", -F.col(bin_))).alias("peak"), F.max("power").alias("__top"), (F.max(bin_) + 1).alias("__n"))
    p = profile.join(tops, list(keys)) if keys else profile.join(F.broadcast(tops), F.lit(True))
    middle = F.floor(F.col("__n") / 2).cast("int")
    shift = middle - F.col("peak")
    b = F.pmod(F.col(bin_) + shift, F.col("__n"))
    weak = (F.col("power") < F.col("__top") * 10 ** (threshold_db / 10)) | (F.col("__top") <= 0)
    ends = p.groupBy(*keys, "peak", "__n", "__top").agg(F.max(F.when(weak & (b < middle), b)).alias("__below"), F.min(F.when(weak & (b > middle), b)).alias("__above"))
    n = F.col("__n")
    ends = ends.select(*keys, "peak", "__n", shift.alias("shift"), F.coalesce(F.col("__below") + 1, F.lit(0)).alias("__l"), F.coalesce(F.col("__above") - 1, n - 1).alias("__r"))
    size = F.greatest(F.lit(2), F.bround(least * n).cast("int"))
    size = size + size % 2
    narrow = F.col("__r") - F.col("__l") + 1 < size
    left = F.greatest(F.lit(0), middle - F.floor(size / 2).cast("int"))
    ends = ends.select(*keys, "peak", "__n", "shift", F.when(narrow, left).otherwise(F.col("__l")).alias("__l"), F.when(narrow, F.least(n - 1, left + size - 1)).otherwise(F.col("__r")).alias("__r"))
    odd, room = (F.col("__r") - F.col("__l") + 1) % 2 == 1, F.col("__r") < n - 1
    start = F.when(odd & ~room & (F.col("__l") > 0), F.col("__l") - 1).otherwise(F.col("__l"))
    stop = F.when(odd & room, F.col("__r") + 1).otherwise(F.col("__r")) + 1
    return ends.select(*keys, start.alias("start"), stop.alias("stop"), "peak", "shift")


def energy_scale(full: int, part: int) -> float:
    """Factor that keeps the energy of a look that is cut from a longer spectrum."""
    return float(np.sqrt(full / max(1, part)))


def rolled_to(df: DataFrame, bin_: str, bins: int, centre: Column) -> DataFrame:
    """Bins renumbered so that ``centre`` lies in the middle."""
    return df.withColumn(bin_, F.pmod(F.col(bin_) - centre + bins // 2, F.lit(bins)))


def look_of_bin(bin_: Column, start: Column, stop: Column, looks: int) -> Column:
    """Which of the equal parts of [start, stop) a bin is in; null outside."""
    part = F.floor((bin_ - start) * looks / (stop - start)).cast("int")
    return F.when((bin_ >= start) & (bin_ < stop), part)
