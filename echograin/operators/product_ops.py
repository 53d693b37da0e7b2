"""Operators over whole products: stacking, mosaics, bursts, interferograms, textures, resampling.

A product is (tile..., row, col, band values); a stack has a further key such
as date or look.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.complexes import conj_product
from .neighbourhoods import box_mean_2d

# bands


def converted(value: Column, low: Column, high: Column, kind: str = "uint8", scaling: str = "linear") -> Column:
    """A band cast to an integer type: truncated, or scaled linearly or by logarithm from [low, high] to the type's range."""
    top = {"uint8": 255, "int16": 32767, "uint16": 65535, "int32": 2147483647}[kind]
    if scaling == "truncate":
        out = value
    elif scaling == "linear":
        out = F.when(high > low, (value - low) / (high - low)).otherwise(0.0) * top
    elif scaling == "log":
        out = F.when((high > low) & (value >= low), F.log(1 + value - low) / F.log(1 + high - low)).otherwise(0.0) * top
    else:
        raise ValueError(f"no such scaling: {scaling}")
    return F.greatest(F.lit(0 if kind.startswith("u") else -top - 1), F.least(F.lit(top), F.floor(out))).cast("long")


def without_nodata(df: DataFrame, bands: Sequence[str], nodata: float = 0.0) -> DataFrame:
    """No-data values as null."""
    return df.withColumns({b: F.when(F.col(b) != nodata, F.col(b)) for b in bands})


def masked(df: DataFrame, bands: Sequence[str], keep: Column) -> DataFrame:
    """Bands as null where the mask doesn't hold (land or sea masks, shapes)."""
    return df.withColumns({b: F.when(keep, F.col(b)) for b in bands})


def with_class(df: DataFrame, classes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Land-cover class or elevation of each pixel by key."""
    return df.join(classes, list(keys), "left")


# stacks and mosaics


def stack_average(df: DataFrame, keys: Sequence[str], value: str, statistic: str = "mean") -> DataFrame:
    f = {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_pop, "median": F.median, "coefficient": lambda c: F.stddev_pop(c) / F.avg(c)}[statistic]
    return df.groupBy(*keys).agg(f(value).alias("value"))


def temporal_percentile(df: DataFrame, keys: Sequence[str], value: str, percent: float) -> DataFrame:
    return df.groupBy(*keys).agg(F.percentile(value, F.lit(percent / 100)).alias("value"))


def mosaic(products: DataFrame, keys: Sequence[str], value: str, source: str, combine: str = "first") -> DataFrame:
    """Products of one table on one grid: the valid value of the smallest source, or the mean; one aggregation over all sources."""
    valid = products.where(F.col(value).isNotNull() & ~F.isnan(value))
    out = {"first": F.min_by(value, source), "mean": F.avg(value)}[combine]
    return valid.groupBy(*keys).agg(out.alias("value"))


def merge_iq(product: DataFrame, looks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A product with the complex bands of its sub-aperture looks (look, i, q) as further bands i_SA<look> and q_SA<look>.

    Product and looks are one table, sorted once by key, in which each row of the
    product takes its looks' bands; a small job finds the looks' distinct numbers.
    Bands that the product has already stay as they are.
    """
    numbers = sorted(r[0] for r in looks.select("look").distinct().collect())  # a few sub-apertures
    new = [(b, n) for n in numbers for b in ("i", "q") if f"{b}_SA{n}" not in product.columns]
    if not new:
        return product
    both = product.withColumn("__own", F.lit(True)).unionByName(looks.select(*keys, *[F.col(c).alias(f"__{c}") for c in ("look", "i", "q")]), allowMissingColumns=True)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()  # a row without a key has no looks
    alike = W.partitionBy(*keys)
    bands = [F.when(known, F.max(F.when(F.col("__look") == n, F.col(f"__{b}"))).over(alike)).alias(f"{b}_SA{n}") for b, n in new]
    own = [*keys, *[c for c in product.columns if c not in keys]]
    return both.select(*own, "__own", *bands).where("__own").drop("__own").select(*[F.col(k).cast(product.schema[k].dataType).alias(k) for k in keys], *own[len(keys) :], *[f"{b}_SA{n}" for b, n in new])


def assembled_slices(slices: Sequence[DataFrame], row: str) -> DataFrame:
    """Slices one below the other, rows numbered on."""
    every = None
    for k, s in enumerate(slices):
        part = s.withColumn("__slice", F.lit(k))
        every = part if every is None else every.unionByName(part)
    heights = every.groupBy("__slice").agg((F.max(row) + 1).alias("__h"))  # a row a slice
    start = F.coalesce(F.sum("__h").over(W.orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return every.join(F.broadcast(heights.select("__slice", start.alias("__start"))), "__slice").withColumn(row, F.col(row) + F.col("__start")).drop("__slice", "__start")


# bursts


def split_bursts(df: DataFrame, swath: str, first: int, last: int, pols: Sequence[str]) -> DataFrame:
    """One sub-swath's bursts and polarisations."""
    return df.where((F.col("swath") == swath) & F.col("burst").between(first, last) & F.col("pol").isin(*pols))


def debursted(df: DataFrame, keys: Sequence[str], overlap: int, line: str = "line", burst: str = "burst") -> DataFrame:
    """Bursts joined: half of the overlap goes at each inner edge, lines are numbered on.  Bursts may differ in height
    and their numbers may have gaps; the table of their heights is one row a burst."""
    heights = df.groupBy(*keys, burst).agg((F.max(line) + 1).alias("__h"))
    w = W.partitionBy(*keys).orderBy(burst)
    start = F.coalesce(F.sum(F.col("__h") - overlap).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edges = heights.select(*keys, burst, "__h", start.alias("__start"), F.lag("__h").over(w).isNotNull().alias("__inner"), F.lead("__h").over(w).isNotNull().alias("__more"))
    df = df.join(edges, [*keys, burst])
    cut_top = F.when(F.col("__inner"), overlap // 2).otherwise(0)
    cut_end = F.when(F.col("__more"), overlap - overlap // 2).otherwise(0)
    kept = df.where((F.col(line) >= cut_top) & (F.col(line) < F.col("__h") - cut_end))
    return kept.withColumn(line, F.col("__start") + F.col(line)).drop("__h", "__start", "__inner", "__more", burst)


def echo_bursts(packets: DataFrame, order: str, signal_type: str, quads: str, echo: int = 0) -> DataFrame:
    """Echo packets in two runs: those with as many quads as the first echo of their file, and those with as many as its last.

    A row a file and run (burst 0 and, if its number of quads is another one, 1):
    quads, first and last packet, number of packets, and ``offset``, the packets
    of the runs before it.  The ends of a file come by one aggregation; no window
    runs over all its packets.
    """
    echoes = packets.where(F.col(signal_type) == echo)
    ends = echoes.groupBy("path").agg(F.min_by(quads, order).alias("__first"), F.max_by(quads, order).alias("__last"))
    kept = echoes.join(ends, "path").where((F.col(quads) == F.col("__first")) | (F.col(quads) == F.col("__last")))
    runs = kept.withColumn("burst", F.when(F.col(quads) == F.col("__first"), 0).otherwise(1))
    out = runs.groupBy("path", "burst", quads).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    # at most two rows a file
    return out.withColumn("offset", F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("burst").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


# interferometry


def interferogram(df: DataFrame, flat_phase: Column | None = None) -> DataFrame:
    """a conj(b) of (ar, ai, br, bi), less a flat-earth phase, with its phase."""
    re, im = conj_product(*(F.col(c) for c in ("ar", "ai", "br", "bi")))
    if flat_phase is not None:
        re, im = re * F.cos(flat_phase) + im * F.sin(flat_phase), im * F.cos(flat_phase) - re * F.sin(flat_phase)
    return df.select(*[c for c in df.columns if c not in ("ar", "ai", "br", "bi")], re.alias("re"), im.alias("im"), F.atan2(im, re).alias("phase"))


def double_difference(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wrapped phase difference of two interferograms."""
    j = first.select(*keys, F.col("phase").alias("p")).join(second.select(*keys, F.col("phase").alias("q")), list(keys))
    return j.select(*keys, F.atan2(F.sin(F.col("p") - F.col("q")), F.cos(F.col("p") - F.col("q"))).alias("phase"))


def goldstein_filter(df: DataFrame, keys: Sequence[str], row: str, col: str, alpha: float = 1.0, block: int = 32) -> DataFrame:
    """Each block's spectrum weighted by its own magnitude to the power alpha.  A block is one group of bounded size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.zeros((block, block), complex)
        r, c = pdf[row].to_numpy() % block, pdf[col].to_numpy() % block
        z[r, c] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        s = np.fft.fft2(z)
        weight = np.abs(s) ** alpha
        out = np.fft.ifft2(s * weight / max(weight.max(), 1e-30))
        return pdf[[*keys, row, col]].assign(re=out[r, c].real, im=out[r, c].imag)

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (*keys, row, col))
    blocks = df.withColumn("__br", F.floor(F.col(row) / block)).withColumn("__bc", F.floor(F.col(col) / block))
    return blocks.groupBy(*keys, "__br", "__bc").applyInPandas(run, f"{kinds}, re double, im double")


def offsets(df: DataFrame, keys: Sequence[str], row: str, col: str, cell: int = 32) -> DataFrame:
    """Shift of b against a in each cell by the peak of their cross-correlation."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = np.zeros((cell, cell)), np.zeros((cell, cell))
        r, c = pdf[row].to_numpy() % cell, pdf[col].to_numpy() % cell
        a[r, c], b[r, c] = pdf["a"], pdf["b"]
        x = np.fft.ifft2(np.fft.fft2(b - b.mean()) * np.conj(np.fft.fft2(a - a.mean()))).real
        i, j = np.unravel_index(int(np.argmax(x)), x.shape)
        wrap = lambda k: int(k - cell if k > cell // 2 else k)
        return pd.DataFrame([(*key, wrap(i), wrap(j), float(x.max()))])

    kinds = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in keys)
    cells = df.withColumn("cell_row", F.floor(F.col(row) / cell)).withColumn("cell_col", F.floor(F.col(col) / cell))
    return cells.groupBy(*keys, "cell_row", "cell_col").applyInPandas(run, f"{kinds}cell_row long, cell_col long, row_shift int, col_shift int, peak double")


# texture, resampling, comparison


def glcm(df: DataFrame, keys: Sequence[str], row: str, col: str, level: str, step: tuple[int, int] = (0, 1)) -> DataFrame:
    """Textures of grey levels from co-occurring pairs at a step, both ways: one equi join and sums."""
    there = df.select(*keys, (F.col(row) - step[0]).alias(row), (F.col(col) - step[1]).alias(col), F.col(level).alias("__j"))
    pairs = df.select(*keys, row, col, F.col(level).alias("__i")).join(there, [*keys, row, col]).groupBy(*keys, "__i", "__j").agg(F.count("*").alias("n"))
    both = pairs.unionByName(pairs.select(*keys, F.col("__j").alias("__i"), F.col("__i").alias("__j"), "n")).groupBy(*keys, "__i", "__j").agg(F.sum("n").alias("n"))
    p = F.col("n") / F.sum("n").over(W.partitionBy(*keys))
    d = F.col("__i") - F.col("__j")
    return both.withColumn("p", p).groupBy(*keys).agg(F.sum(F.col("p") * d * d).alias("contrast"), F.sum(F.col("p") * F.abs(d)).alias("dissimilarity"), F.sum(F.col("p") / (1 + d * d)).alias("homogeneity"), F.sum(F.col("p") * F.col("p")).alias("energy"), (-F.sum(F.col("p") * F.log("p"))).alias("entropy"))


def resampled_nearest(df: DataFrame, row: str, col: str, height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """Nearest neighbour to another size: a pixel goes to all new cells whose centre it holds."""
    reach = lambda c, n, m: F.sequence(F.ceil(F.col(c) * (m / n) - 0.5), F.ceil((F.col(c) + 1) * (m / n) - 0.5) - 1)
    some = lambda c, n, m: F.ceil((F.col(c) + 1) * (m / n) - 0.5) > F.ceil(F.col(c) * (m / n) - 0.5)
    df = df.where(some(row, height, new_height) & some(col, width, new_width))
    return df.withColumn("__r", F.explode(reach(row, height, new_height))).withColumn("__c", F.explode(reach(col, width, new_width))).drop(row, col).withColumnsRenamed({"__r": row, "__c": col})


def ssim(df: DataFrame, keys: Sequence[str], row: str, col: str, x: str, y: str, size: int = 7) -> DataFrame:
    """Mean structural similarity over box windows, edge pixels repeated."""
    a, b = F.col(x), F.col(y)
    parts = df.select(*keys, row, col, a.alias("x"), b.alias("y"), (a * a).alias("xx"), (b * b).alias("yy"), (a * b).alias("xy"))
    m = box_mean_2d(parts, keys, row, col, ["x", "y", "xx", "yy", "xy"], size)
    top = df.groupBy(*keys).agg(F.max(x).alias("__top"))
    m = m.join(top, list(keys))
    c1, c2 = (0.01 * F.col("__top")) * (0.01 * F.col("__top")), (0.03 * F.col("__top")) * (0.03 * F.col("__top"))
    vx, vy, cxy = F.col("xx") - F.col("x") * F.col("x"), F.col("yy") - F.col("y") * F.col("y"), F.col("xy") - F.col("x") * F.col("y")
    return m.groupBy(*keys).agg(F.avg((2 * F.col("x") * F.col("y") + c1) * (2 * cxy + c2) / ((F.col("x") * F.col("x") + F.col("y") * F.col("y") + c1) * (vx + vy + c2))).alias("ssim"))


def peaks(df: DataFrame, keys: Sequence[str], value: str, percent: float = 99.0) -> DataFrame:
    """Pixels above a percentile of their group."""
    limits = df.groupBy(*keys).agg(F.percentile(value, F.lit(percent / 100)).alias("__limit"))
    return df.join(limits, list(keys)).where(F.col(value) > F.col("__limit")).drop("__limit")


def array_stats(df: DataFrame, keys: Sequence[str], re: str, im: str) -> DataFrame:
    """Mean, deviation and range of parts and magnitude."""
    mag = F.sqrt(F.col(re) * F.col(re) + F.col(im) * F.col(im))
    ph = F.atan2(im, re)
    return df.groupBy(*keys).agg(F.avg(re).alias("re_mean"), F.avg(im).alias("im_mean"), F.avg(mag).alias("mag_mean"), F.stddev_pop(mag).alias("mag_std"), F.min(mag).alias("mag_min"), F.max(mag).alias("mag_max"), F.stddev_pop(ph).alias("phase_std"))


def unmixed(spectrum: Column, endmembers: Sequence[Sequence[float]]) -> Column:
    """Least-squares shares of endmembers in an array of bands: the pseudo-inverse is a constant of the plan."""
    inverse = np.linalg.pinv(np.asarray(endmembers, float).T)
    dot = lambda w: F.aggregate(F.zip_with(spectrum, F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.array(*[dot(w) for w in inverse])


def nearest_class(spectrum: Column, references: dict[str, Sequence[float]], limit: float = math.inf) -> Column:
    """Name of the reference of the smallest spectral angle, null beyond the limit."""
    from .polarimetry import spectral_angle

    best = F.least(*[F.struct(spectral_angle(spectrum, list(r)).alias("angle"), F.lit(n).alias("name")) for n, r in sorted(references.items())]) if len(references) > 1 else F.struct(spectral_angle(spectrum, list(next(iter(references.values())))).alias("angle"), F.lit(next(iter(references))).alias("name"))
    return F.when(best["angle"] <= limit, best["name"])


def wishart_class(c11: Column, c22: Column, c12_re: Column, c12_im: Column, centres: dict[str, tuple[float, float, float, float]]) -> Column:
    """Class of the smallest Wishart distance between a 2 x 2 covariance and class means."""

    def distance(m: tuple[float, float, float, float]) -> Column:
        a, b, x, y = m
        det = a * b - x * x - y * y
        return math.log(det) + (b * c11 + a * c22 - 2 * (x * c12_re + y * c12_im)) / det

    return F.least(*[F.struct(distance(m).alias("d"), F.lit(n).alias("name")) for n, m in sorted(centres.items())])["name"]
