"""Statistics, comparison metrics and losses as aggregate expressions.

Each function returns an aggregate Column for ``groupBy().agg()``; all are sums
with a map-side part.  Population moments throughout, as array libraries have
them, unless a name says sample.  Complex values are pairs of columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.complexes import conj_product, magnitude, phase, power, wrap
from ..functions.guards import nan
from .joins import join_large_groups

EPS = 1e-12

# one image


def enl(x: Column, eps: float = EPS) -> Column:
    """Equivalent number of looks."""
    return F.avg(x) * F.avg(x) / (F.var_pop(x) + eps)


def dispersion_ratio(x: Column, eps: float = EPS) -> Column:
    return F.var_pop(x) / (F.avg(x) * F.avg(x) + eps)


def variation(x: Column, eps: float = EPS) -> Column:
    """Coefficient of variation."""
    return F.stddev_pop(x) / (F.abs(F.avg(x)) + eps)


def phase_variance(re: Column, im: Column) -> Column:
    """1 minus the length of the mean unit vector."""
    a = phase(re, im)
    return 1 - F.sqrt(F.avg(F.cos(a)) * F.avg(F.cos(a)) + F.avg(F.sin(a)) * F.avg(F.sin(a)))


def rms(re: Column, im: Column) -> Column:
    return F.sqrt(F.avg(power(re, im)))


def contrast(x: Column, eps: float = 1e-8) -> Column:
    """Sample deviation over mean."""
    return F.stddev_samp(x) / (F.avg(x) + eps)


def raw_kurtosis(x: Column) -> Column:
    """Fourth standardised moment, not in excess of the normal one."""
    m1, m2, m3, m4 = F.avg(x), F.avg(x * x), F.avg(x * x * x), F.avg(x * x * x * x)
    var = m2 - m1 * m1
    fourth = m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1
    return fourth / ((var + 1e-8) * (var + 1e-8))


def entropy_of_shares(x: Column, eps: float = 1e-8) -> Column:
    """Shannon entropy of non-negative values taken as shares of their sum: log S - sum(x log x) / S."""
    s = F.sum(x)
    return F.log(s + eps) - F.sum(F.when(x > 0, x * F.log(x)).otherwise(0.0)) / (s + eps)


def db_ratio(signal: Column, noise: Column) -> Column:
    """10 log10 of mean powers, infinite without noise."""
    return F.when(F.avg(noise) == 0, float("inf")).otherwise(10 * F.log10(F.avg(signal) / F.avg(noise)))


# two images


def coherence(ar: Column, ai: Column, br: Column, bi: Column, eps: float = EPS) -> Column:
    re, im = conj_product(ar, ai, br, bi)
    top = F.sqrt(F.avg(re) * F.avg(re) + F.avg(im) * F.avg(im))
    return top / (F.sqrt(F.avg(power(ar, ai)) * F.avg(power(br, bi))) + eps)


def phase_coherence(ar: Column, ai: Column, br: Column, bi: Column) -> Column:
    """Length of the mean unit vector of the phase differences."""
    d = phase(*conj_product(ar, ai, br, bi))
    return F.sqrt(F.avg(F.cos(d)) * F.avg(F.cos(d)) + F.avg(F.sin(d)) * F.avg(F.sin(d)))


def mse(ar: Column, ai: Column, br: Column, bi: Column) -> Column:
    return F.avg(power(ar - br, ai - bi))


def rmse(ar: Column, ai: Column, br: Column, bi: Column) -> Column:
    return F.sqrt(mse(ar, ai, br, bi))


def mae(ar: Column, ai: Column, br: Column, bi: Column) -> Column:
    return F.avg(magnitude(ar - br, ai - bi))


def psnr(ref: Column, pred: Column) -> Column:
    """dB of the largest reference value over the mean squared error; infinite without error, 0 without signal."""
    e, top = F.avg((ref - pred) * (ref - pred)), F.max(ref)
    return F.when(e == 0, float("inf")).when(top == 0, 0.0).otherwise(10 * F.log10(top * top / e))


def amplitude_correlation(ref: Column, pred: Column) -> Column:
    """Pearson's correlation, 0 where it isn't defined."""
    d = F.stddev_pop(ref) * F.stddev_pop(pred)
    return F.when(d == 0, 0.0).otherwise(F.covar_pop(ref, pred) / d)


def phase_mae(pa: Column, pb: Column) -> Column:
    return F.avg(F.abs(wrap(pa - pb)))


def phase_rmse(pa: Column, pb: Column) -> Column:
    return F.sqrt(F.avg(wrap(pa - pb) * wrap(pa - pb)))


def luminance(x: Column, y: Column, k: float = 0.01) -> Column:
    c = F.pow(k * (F.greatest(F.max(x), F.max(y)) - F.least(F.min(x), F.min(y))), F.lit(2))
    return (2 * F.avg(x) * F.avg(y) + c) / (F.avg(x) * F.avg(x) + F.avg(y) * F.avg(y) + c)


def ssim_contrast(x: Column, y: Column, k: float = 0.03) -> Column:
    c = F.pow(k * (F.greatest(F.max(x), F.max(y)) - F.least(F.min(x), F.min(y))), F.lit(2))
    return (2 * F.stddev_pop(x) * F.stddev_pop(y) + c) / (F.var_pop(x) + F.var_pop(y) + c)


def structure(x: Column, y: Column, k: float = 0.03) -> Column:
    c = F.pow(k * (F.greatest(F.max(x), F.max(y)) - F.least(F.min(x), F.min(y))), F.lit(2)) / 2
    return (F.covar_pop(x, y) + c) / (F.stddev_pop(x) * F.stddev_pop(y) + c)


# losses: prediction p against target t


def loss_split_mse(pr: Column, pi: Column, tr: Column, ti: Column) -> Column:
    return F.avg((pr - tr) * (pr - tr)) + F.avg((pi - ti) * (pi - ti))


def loss_mag_l1(pr: Column, pi: Column, tr: Column, ti: Column) -> Column:
    return F.avg(F.abs(magnitude(pr, pi) - magnitude(tr, ti)))


def loss_mag_l2(pr: Column, pi: Column, tr: Column, ti: Column) -> Column:
    d = magnitude(pr, pi) - magnitude(tr, ti)
    return F.avg(d * d)


def loss_log_mag(pr: Column, pi: Column, tr: Column, ti: Column, eps: float = 1e-6) -> Column:
    d = F.log(magnitude(pr, pi) + eps) - F.log(magnitude(tr, ti) + eps)
    return F.avg(d * d)


def loss_log1p_mag(pr: Column, pi: Column, tr: Column, ti: Column, alpha: float = 1.0) -> Column:
    d = F.log(1 + alpha * magnitude(pr, pi)) - F.log(1 + alpha * magnitude(tr, ti))
    return F.avg(d * d)


def loss_log_cosh(pr: Column, pi: Column, tr: Column, ti: Column) -> Column:
    return F.avg(F.log(F.cosh(magnitude(pr, pi) - magnitude(tr, ti))))


def loss_amp_phase(pr: Column, pi: Column, tr: Column, ti: Column, w_phase: float = 1.0) -> Column:
    d = phase(*conj_product(pr, pi, tr, ti))
    return loss_mag_l2(pr, pi, tr, ti) + w_phase * F.avg(d * d)


def loss_power(pr: Column, pi: Column, tr: Column, ti: Column) -> Column:
    d = F.sum(power(pr, pi)) - F.sum(power(tr, ti))
    return d * d


def loss_phase_l1(pr: Column, pi: Column, tr: Column, ti: Column) -> Column:
    return F.avg(F.abs(phase(*conj_product(pr, pi, tr, ti))))


def loss_phase_l2(pr: Column, pi: Column, tr: Column, ti: Column) -> Column:
    d = phase(*conj_product(pr, pi, tr, ti))
    return F.avg(d * d)


def loss_phase_correlation(pr: Column, pi: Column, tr: Column, ti: Column) -> Column:
    return 1 - phase_coherence(pr, pi, tr, ti)


def loss_coherence(pr: Column, pi: Column, tr: Column, ti: Column) -> Column:
    return 1 - coherence(pr, pi, tr, ti)


def loss_speckle_nll(pr: Column, pi: Column, tr: Column, ti: Column, variance: float = 1.0) -> Column:
    return mse(pr, pi, tr, ti) / variance


def loss_huber(p: Column, t: Column, delta: float = 1.0) -> Column:
    d = F.abs(p - t)
    return F.avg(F.when(d <= delta, 0.5 * d * d).otherwise(delta * (d - 0.5 * delta)))


def loss_focal(p: Column, t: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """p: logit, t: 0 or 1."""
    ce = F.greatest(p, F.lit(0.0)) - p * t + F.log(1 + F.exp(-F.abs(p)))
    pt = F.exp(-ce)
    return F.avg(alpha * (1 - pt) * (1 - pt) * ce if gamma == 2.0 else alpha * F.pow(1 - pt, F.lit(gamma)) * ce)


def loss_bce(p: Column, t: Column) -> Column:
    """Binary cross-entropy on logits, as real / fake losses use it."""
    return F.avg(F.greatest(p, F.lit(0.0)) - p * t + F.log(1 + F.exp(-F.abs(p))))


def loss_phase_masked(pr: Column, pi: Column, tr: Column, ti: Column, threshold: float = 0.1) -> Column:
    """1 - cos of the phase error over targets above the threshold; at least one counts as the divisor."""
    on = magnitude(tr, ti) > threshold
    d = phase(*conj_product(pr, pi, tr, ti))
    return F.sum(F.when(on, 1 - F.cos(d)).otherwise(0.0)) / F.greatest(F.sum(F.when(on, 1).otherwise(0)), F.lit(1))


LOSSES = {
    "split_mse": loss_split_mse, "complex_l2": mse, "complex_l1": mae, "mag_l1": loss_mag_l1, "mag_l2": loss_mag_l2, "log_mag": loss_log_mag,
    "log1p_mag": loss_log1p_mag, "log_cosh": loss_log_cosh, "amp_phase": loss_amp_phase, "power": loss_power, "phase_l1": loss_phase_l1,
    "phase_l2": loss_phase_l2, "phase_correlation": loss_phase_correlation, "coherence": loss_coherence, "speckle_nll": loss_speckle_nll,
    "phase_masked": loss_phase_masked,
}


def get_loss(name: str):
    """A loss by its name; an unknown name is an error."""
    if name not in LOSSES:
        raise ValueError(f"no such loss: {name}; there are {', '.join(sorted(LOSSES))}")
    return LOSSES[name]


def composite_loss(weights: dict[str, float], *columns: Column) -> Column:
    """Weighted sum of named losses."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + w * get_loss(name)(*columns)
    return total


# information between two variables


def bin_index(x: Column, low: Column, high: Column, bins: int) -> Column:
    """0 to bins - 1; the upper bound falls in the last bin."""
    part = F.when(high > low, (x - low) / (high - low)).otherwise(0.0)
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(part * bins).cast("int")))


def normalized_mutual_information(df: DataFrame, x: str, y: str, keys: list[str] | None = None, bins: int = 64) -> DataFrame:
    """2 (Hx + Hy - Hxy) / (Hx + Hy) by keys, over equal-width bins; NaN if one variable doesn't vary.

    Passes for the ranges and for the joint counts, which hold at most bins *
    bins rows a key, whatever the input is; rows of large keys aren't shuffled.
    """
    keys = keys or []
    ranges = df.groupBy(*keys).agg(F.min(x).alias("lx"), F.max(x).alias("hx"), F.min(y).alias("ly"), F.max(y).alias("hy"), F.count("*").alias("__rows"))
    df = df.select(*dict.fromkeys([*keys, x, y]))
    df = join_large_groups(df, ranges, keys, "__rows") if keys else df.withColumn("every", F.lit(1)).join(F.broadcast(ranges.withColumn("every", F.lit(1))), "every")
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, bin_index(F.col(x), F.col("lx"), F.col("hx"), bins).alias("bx"), bin_index(F.col(y), F.col("ly"), F.col("hy"), bins).alias("by")).agg(F.count("*").alias("n"))

    def entropy(counts: DataFrame, name: str) -> DataFrame:
        s = F.sum("n").cast("double")
        return counts.groupBy(*keys).agg((F.log(s) - F.sum(F.col("n") * F.log("n")) / s).alias(name))

    hx = entropy(cells.groupBy(*keys, "bx").agg(F.sum("n").alias("n")), "h_x")
    hy = entropy(cells.groupBy(*keys, "by").agg(F.sum("n").alias("n")), "h_y")
    hxy = entropy(cells, "h_xy")
    if not keys:
        hx, hy, hxy = (h.withColumn("every", F.lit(1)) for h in (hx, hy, hxy))
    out = hx.join(hy, keys or "every").join(hxy, keys or "every").drop("every")
    flat = (F.col("h_x") < 1e-12) | (F.col("h_y") < 1e-12)
    return out.withColumn("nmi", F.when(flat, nan()).otherwise(2 * (F.col("h_x") + F.col("h_y") - F.col("h_xy")) / (F.col("h_x") + F.col("h_y"))))
