"""Phases that follow from geometry, three-pass interferometry, and azimuth shifts by spectral diversity.

Two passes meet in joins on the pixel; burst overlaps meet in a self join on
burst, line and column, and what is left of them are sums a block.  Only the
network of a stack's pairs, a few rows a stack, is solved in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .focusing import rotated
from .geocoding import earth_fixed, radar_positions

# geometry


def interferometric_geometry(ground: DataFrame, first: DataFrame, second: DataFrame, keys: Sequence[str], wavelength_m: float, row: str = "row", col: str = "col") -> DataFrame:
    """ground with slant_range, incidence (degrees, on the ellipsoid), the parallel and perpendicular baseline of a second pass
    against the first (positive towards the ground and away from it), and phase, -4 pi / wavelength times the difference
    of their ranges: flat earth and topography of first * conj(second).  first and second are orbits."""
    a = radar_positions(ground, first, keys, row, col, sensor=True)
    b = radar_positions(ground, second, keys, row, col, sensor=True).select(*keys, row, col, *(F.col(c).alias(f"__{c}") for c in ("slant_range", "sensor_x", "sensor_y", "sensor_z")))
    j = a.join(b, [*keys, row, col])
    point = earth_fixed(F.col("lat"), F.col("lon"), F.col("height"))
    lat, lon = F.radians("lat"), F.radians("lon")
    up = (F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))
    look = [(p - F.col(f"sensor_{c}")) / F.col("slant_range") for p, c in zip(point, "xyz", strict=True)]
    base = [F.col(f"__sensor_{c}") - F.col(f"sensor_{c}") for c in "xyz"]
    dot = lambda u, v: sum(x * y for x, y in zip(u, v, strict=True))
    down = dot(look, up)
    j = j.withColumns({"__par": dot(base, look), "__down": down, "__b2": dot(base, base), "__up": dot(base, up)})
    # the part of the baseline square to the look, with the sign of its part upwards
    square = F.sqrt(F.greatest(F.col("__b2") - F.col("__par") * F.col("__par"), F.lit(0.0)))
    sign = F.when(F.col("__up") - F.col("__par") * F.col("__down") < 0, -1.0).otherwise(1.0)
    phase = -4 * math.pi / wavelength_m * (F.col("slant_range") - F.col("__slant_range"))
    return j.select(*ground.columns, "slant_range", F.degrees(F.acos(-F.col("__down"))).alias("incidence"), F.col("__par").alias("parallel"), (sign * square).alias("perpendicular"), phase.alias("phase"))


def topographic_phase(height: Column, wavelength_m: float, slant_range_m: Column, incidence_deg: Column, baseline_m: Column | float) -> Column:
    """Phase of a height over the reference by the perpendicular baseline; the inverse of geometry.phase_to_height."""
    return -4 * math.pi * baseline_m * height / (wavelength_m * slant_range_m * F.sin(F.radians(incidence_deg)))


def without_phase(df: DataFrame, re: str, im: str, phase: Column) -> DataFrame:
    """An interferogram without a phase, such as that of the topography."""
    return rotated(df, re, im, -phase)


def three_pass(deformation: Column, topography: Column, deformation_baseline: Column, topography_baseline: Column) -> Column:
    """Phase of a pair without the topography that another pair's unwrapped phase shows, by the ratio of their
    perpendicular baselines; null where the other pair has no baseline."""
    return F.when(topography_baseline != 0, deformation - deformation_baseline / topography_baseline * topography)


# enhanced spectral diversity


def overlap_phases(interferograms: DataFrame, keys: Sequence[str], burst: str, line: str, col: str, re: str, im: str, block: int) -> DataFrame:
    """(keys, burst, block, phase, coherence, n): the double difference of each burst's interferogram and the next one's over
    the lines and columns that both cover, in blocks of columns.  Coherence is that of the difference, from 0 to 1."""
    own = interferograms.select(*keys, burst, line, col, re, im)
    after = interferograms.select(*keys, (F.col(burst) - 1).cast(own.schema[burst].dataType).alias(burst), line, col, F.col(re).alias("__re"), F.col(im).alias("__im"))
    j = own.join(after, [*keys, burst, line, col])
    a, b, c, d = (F.col(x).cast("double") for x in (re, im, "__re", "__im"))
    j = j.select(*keys, burst, F.floor(F.col(col) / block).alias("block"), (a * c + b * d).alias("__x"), (b * c - a * d).alias("__y"))
    sums = j.groupBy(*keys, burst, "block").agg(F.sum("__x").alias("__x"), F.sum("__y").alias("__y"), F.sum(F.hypot("__x", "__y")).alias("__a"), F.count("*").alias("n"))
    coherence = F.when(F.col("__a") > 0, F.hypot("__x", "__y") / F.col("__a")).otherwise(0.0)
    return sums.select(*keys, burst, "block", F.atan2("__y", "__x").alias("phase"), F.least(coherence, F.lit(1.0)).alias("coherence"), "n")


def azimuth_shifts(overlaps: DataFrame, keys: Sequence[str], frequency_gap_hz: Column, line_time_s: float, least_coherence: float = 0.3) -> DataFrame:
    """(keys, shift, weight): the shift in lines of each pair's second image that its overlap phases show; frequency_gap_hz
    is the difference of the Doppler centroids of the two bursts.  Phases are averaged as vectors, blocks below a
    coherence are left out, and the others weighted by coherence^2 / (1 - coherence^2), the inverse of their phase's variance."""
    g2 = F.least(F.col("coherence") * F.col("coherence"), F.lit(1 - 1e-6))
    good = overlaps.where(F.col("coherence") >= least_coherence).withColumns({"__w": F.col("n") * g2 / (1 - g2), "__f": frequency_gap_hz})
    # bursts of one gap first, whose phases may be averaged; then their shifts
    one = good.groupBy(*keys, "__f").agg(F.sum(F.col("__w") * F.cos("phase")).alias("__x"), F.sum(F.col("__w") * F.sin("phase")).alias("__y"), F.sum("__w").alias("__w"))
    shift = F.atan2("__y", "__x") / (2 * math.pi * F.col("__f") * line_time_s)
    weight = F.col("__w") * F.col("__f") * F.col("__f")
    return one.groupBy(*keys).agg((F.sum(weight * shift) / F.sum(weight)).alias("shift"), F.sum("__w").alias("weight"))


def network_shifts(pairs: DataFrame, keys: Sequence[str], first: str, second: str, norm: str = "l2", rounds: int = 30) -> DataFrame:
    """(keys, image, shift): the shift of every image of a stack from those of its pairs (keys, first, second, shift,
    weight), the one of the smallest name being 0; weighted least squares, or least absolute differences (l1) by reweighting.
    Images that no pair joins to that one have a null shift.  A stack's pairs are a few rows an image."""
    if norm not in ("l1", "l2"):
        raise ValueError(f"no such norm: {norm}")
    kinds = "".join(f"{c} {pairs.schema[c].dataType.simpleString()}, " for c in keys)

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf[first]) | set(pdf[second]))
        at = {n: i for i, n in enumerate(names)}
        a, b, d, w = pdf[first].map(at).to_numpy(), pdf[second].map(at).to_numpy(), pdf["shift"].to_numpy(float), pdf["weight"].to_numpy(float)
        good = np.isfinite(d) & (w > 0)
        a, b, d, w = a[good], b[good], d[good], w[good]
        design = np.zeros((len(d), len(names)))
        design[np.arange(len(d)), b] += 1
        design[np.arange(len(d)), a] -= 1
        joined = {0}
        while True:  # images that the pairs join to the first
            more = {y for x, y in [*zip(a.tolist(), b.tolist(), strict=True), *zip(b.tolist(), a.tolist(), strict=True)] if x in joined} - joined
            if not more:
                break
            joined |= more
        use = sorted(joined - {0})
        rows = np.isin(a, list(joined))
        x, scale = np.zeros(len(names)), np.sqrt(w[rows])
        if use:
            m, t = design[rows][:, use], d[rows]
            for _ in range(rounds if norm == "l1" else 1):
                x[use] = np.linalg.lstsq(m * scale[:, None], t * scale, rcond=None)[0]
                scale = np.sqrt(w[rows] / np.maximum(np.abs(m @ x[use] - t), 1e-9)) if norm == "l1" else scale
        x[[i for i in range(len(names)) if i not in joined]] = np.nan
        return pd.DataFrame([(*key, n, float(x[i])) for n, i in at.items()])

    image = pairs.schema[first].dataType.simpleString()
    return pairs.select(*keys, first, second, "shift", "weight").groupBy(*keys).applyInPandas(solve, f"{kinds}image {image}, shift double")
