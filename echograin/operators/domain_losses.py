"""Losses between two images that look at edges, local structure, distributions, channels or features.

An image pair is a table of pixels with the prediction and the target as
columns; keys tell images apart.  Losses that need a network take its output as
columns or arrays, which ``slots.apply_model`` fills.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.complexes import magnitude
from .image_stats import loss_bce, loss_mag_l1, loss_phase_masked, loss_split_mse


def edge_loss(df: DataFrame, keys: Sequence[str], row: str, col: str, p: str, t: str) -> DataFrame:
    """Mean absolute difference of the steps along rows plus along columns."""
    across, down = W.partitionBy(*keys, row).orderBy(col), W.partitionBy(*keys, col).orderBy(row)
    d = df.withColumn("__d", F.col(p) - F.col(t))
    x, y = F.abs(F.lead("__d").over(across) - F.col("__d")), F.abs(F.lead("__d").over(down) - F.col("__d"))
    return d.select(*keys, x.alias("x"), y.alias("y")).groupBy(*keys).agg((F.avg("x") + F.avg("y")).alias("loss"))


def gaussian_weights(size: int, sigma: float | None = None) -> list[float]:
    """Weights of a symmetric window, 1 in all; sigma is half the size if it isn't given."""
    s = 0.5 * size if sigma is None else sigma
    raw = [math.exp(-((k - (size - 1) / 2) ** 2) / (2 * s * s)) for k in range(size)]
    return [v / sum(raw) for v in raw]


def line_similarity_loss(df: DataFrame, keys: Sequence[str], at: str, p: str, t: str, size: int = 11, sigma: float | None = None, top: float = 1.0, eps: float = 1e-6) -> DataFrame:
    """1 less the mean structural similarity along lines (one line a key), under a Gaussian window with zeros beyond the
    ends; similarities are held within 0 and 1, variances not below 0."""
    if size % 2 == 0:
        raise ValueError("the window has an odd number of samples")
    w, half = W.partitionBy(*keys).orderBy(at), size // 2
    weights = gaussian_weights(size, sigma)
    df = df.withColumns({"__x": F.col(p), "__y": F.col(t), "__xx": F.col(p) * F.col(p), "__yy": F.col(t) * F.col(t), "__xy": F.col(p) * F.col(t)})

    def local(name: str) -> Column:
        return sum((g * F.lag(name, k - half, 0.0).over(w) for k, g in enumerate(weights)), F.lit(0.0))

    m = df.select(*keys, *[local(f"__{n}").alias(n) for n in ("x", "y", "xx", "yy", "xy")])
    c1, c2 = (0.01 * top) ** 2, (0.03 * top) ** 2
    x, y = F.col("x"), F.col("y")
    vx, vy, cxy = F.greatest(F.lit(0.0), F.col("xx") - x * x), F.greatest(F.lit(0.0), F.col("yy") - y * y), F.col("xy") - x * y
    s = (2 * x * y + c1) * (2 * cxy + c2) / ((x * x + y * y + c1) * (vx + vy + c2) + eps)
    return m.groupBy(*keys).agg((1 - F.avg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)))).alias("loss"))


def robust_loss(pr: Column, pi: Column, tr: Column, ti: Column, mode: str = "logcosh") -> Column:
    """Mean of the logarithm of cosh, or of the fourth power, of the size of the difference."""
    d = magnitude(pr - tr, pi - ti)
    if mode not in ("logcosh", "quartic"):
        raise ValueError(f"no such mode: {mode}")
    return F.avg(F.log(F.cosh(d)) if mode == "logcosh" else d * d * d * d)


def symmetry_constrained(pr: Column, pi: Column, tr: Column, ti: Column, weight: float = 1.0) -> Column:
    """Squared error plus that of the prediction to its own conjugate."""
    return loss_split_mse(pr, pi, tr, ti) + weight * F.avg(4 * pi * pi)


def polarimetric_loss(channels: Sequence[tuple[Column, Column, Column, Column]]) -> Column:
    """Mean over pixels of the squared complex differences summed over polarimetric channels (re, im, re and im of the target)."""
    return F.avg(sum((a - c) * (a - c) + (b - d) * (b - d) for a, b, c, d in channels))


def channels_loss(pairs: Sequence[tuple[Column, Column, Column, Column]]) -> Column:
    """Sum over polarimetric channels of the mean squared errors."""
    return sum((loss_split_mse(*p) for p in pairs), F.lit(0.0))


def similarity_combined(df: DataFrame, keys: Sequence[str], at: str, columns: Sequence[str], size: int = 11, weights: tuple[float, float, float, float] = (0.0, 1.0, 1.0, 0.1)) -> DataFrame:
    """Weighted squared error, magnitude difference, line similarity of magnitudes and masked phase error; not below 0."""
    c = [F.col(x) for x in columns]
    sums = df.groupBy(*keys).agg((weights[0] * loss_split_mse(*c) + weights[1] * loss_mag_l1(*c) + weights[3] * loss_phase_masked(*c)).alias("__s"))
    lines = line_similarity_loss(df.withColumns({"__p": magnitude(c[0], c[1]), "__t": magnitude(c[2], c[3])}), keys, at, "__p", "__t", size)
    return sums.join(lines, list(keys)).select(*keys, F.greatest(F.lit(0.0), F.col("__s") + weights[2] * F.col("loss")).alias("loss"))


def _bins(df: DataFrame, keys: Sequence[str], p: str, t: str, bins: int, low: Column, high: Column) -> DataFrame:
    """(keys, bin, n_p, n_t, low, high): counts of both columns in equal bins of [low, high]; at most ``bins`` rows a key."""
    ends = df.groupBy(*keys).agg(low.alias("low"), high.alias("high")).withColumnsRenamed({k: f"__{k}" for k in keys})
    both = F.array(F.struct(F.col(p).alias("v"), F.lit(1).alias("p"), F.lit(0).alias("t")), F.struct(F.col(t).alias("v"), F.lit(0).alias("p"), F.lit(1).alias("t")))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    long = df.select(*keys, F.explode(both).alias("x")).join(ends if keys else F.broadcast(ends), same)
    at = F.when(F.col("high") > F.col("low"), F.least(F.lit(bins - 1), F.floor((F.col("x.v") - F.col("low")) / (F.col("high") - F.col("low")) * bins))).otherwise(0)
    return long.groupBy(*keys, at.alias("bin"), "low", "high").agg(F.sum("x.p").alias("n_p"), F.sum("x.t").alias("n_t"))


def histogram_matching(df: DataFrame, keys: Sequence[str], p: str, t: str, bins: int = 64) -> DataFrame:
    """Squared distance of the shares of two histograms over one range that holds zero."""
    b = _bins(df, keys, p, t, bins, F.least(F.lit(0.0), F.min(p), F.min(t)), F.greatest(F.max(p), F.max(t)))
    n = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    d = (F.col("n_p") - F.col("n_t")) / (F.col("__n") + 1e-8)
    return b.join(n if keys else F.broadcast(n), list(keys) if keys else F.lit(True)).groupBy(*keys).agg(F.sum(d * d).alias("loss"))


def mean_discrepancy(df: DataFrame, keys: Sequence[str], p: str, t: str, bandwidth: float = 1.0, bins: int = 256, kernel: str = "gaussian") -> DataFrame:
    """Maximum mean discrepancy of two value distributions, without the diagonal, on the centres of ``bins`` equal bins: all
    pixels count, and pairs are those of bins, bins * bins a key whatever the number of pixels."""
    b = _bins(df, keys, p, t, bins, F.least(F.min(p), F.min(t)), F.greatest(F.max(p), F.max(t)))
    b = b.withColumn("at", F.col("low") + (F.col("bin") + 0.5) * (F.col("high") - F.col("low")) / bins).select(*keys, "at", "n_p", "n_t")
    # the bins of a key as one array, so that a row meets them all without a join of pairs
    others = b.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.collect_list(F.struct("at", "n_p", "n_t")).alias("__all"), F.sum("n_p").cast("double").alias("__n"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    d = lambda o: F.col("at") - o["at"]
    near = {"gaussian": lambda o: F.exp(-d(o) * d(o) / (2 * bandwidth * bandwidth)), "laplacian": lambda o: F.exp(-F.abs(d(o)) / bandwidth)}[kernel]
    total = lambda n: F.aggregate("__all", F.lit(0.0), lambda s, o: s + o[n] * near(o))
    n = F.max("__n")
    own = lambda c: (F.sum(F.col(c) * F.col(f"k_{c}")) - n) / (n * (n - 1))
    j = b.join(others if keys else F.broadcast(others), same).withColumns({"k_n_p": total("n_p"), "k_n_t": total("n_t")})
    return j.groupBy(*keys).agg((own("n_p") + own("n_t") - 2 * F.sum(F.col("n_p") * F.col("k_n_t")) / (n * n)).alias("loss"))


def feature_loss(p: Column, t: Column) -> Column:
    """Mean squared difference of feature arrays that a network gave for prediction and target."""
    d = F.zip_with(p, t, lambda a, b: (a - b) * (a - b))
    return F.avg(F.aggregate(d, F.lit(0.0), lambda s, v: s + v) / F.size(p))


def generator_loss(score: Column, real: float = 1.0) -> Column:
    """Cross-entropy of a discriminator's logits on predictions against the label of real images."""
    return loss_bce(score, F.lit(real))


def discriminator_loss(on_real: Column, on_fake: Column, real: float = 1.0, fake: float = 0.0) -> Column:
    """Mean of the cross-entropies on real images and on predictions."""
    return (loss_bce(on_real, F.lit(real)) + loss_bce(on_fake, F.lit(fake))) / 2
