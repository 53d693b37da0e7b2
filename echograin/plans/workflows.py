"""Workflows over whole products: pairs of acquisitions, swaths, and cutting into validated tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import geometry as gm
from ..operators import neighbourhoods as nb
from ..operators import product_ops as po
from ..operators.grid_ops import PAIR_KEYS, checked_pairs
from .recipes import Step, recipe, run

#: Bands that an export for time series needs.
EXPORT_BANDS = ("i", "q", "height", "lat", "lon")


def pair_workflow(master: DataFrame, slave: DataFrame, height: int, width: int, cell: int = 32, window: int = 5, least_peak: float = 0.0, smooth: float | None = None) -> dict[str, DataFrame]:
    """Two complex images (row, col, i, q) to ``coregistered``, ``interferogram`` and ``coherence``.

    The shift is the median over cells of the peaks of the correlation of
    amplitudes (two numbers, found by a small job); the slave is resampled by
    it, bilinearly for parts of a pixel.
    """
    amplitude = lambda df, name: df.select("row", "col", F.sqrt(F.col("i") * F.col("i") + F.col("q") * F.col("q")).alias(name))
    both = amplitude(master, "a").join(amplitude(slave, "b"), ["row", "col"])
    rows, cols = gm.common_shift(po.offsets(both, [], "row", "col", cell), least_peak)
    moved = [gm.shifted_onto(slave.select("row", "col", band), "row", "col", band, height, width, rows, cols) for band in ("i", "q")]
    coregistered = moved[0].join(moved[1], ["row", "col"]).where("i is not null and q is not null")
    pair = master.select("row", "col", F.col("i").alias("ar"), F.col("q").alias("ai")).join(coregistered.select("row", "col", F.col("i").alias("br"), F.col("q").alias("bi")), ["row", "col"])
    interferogram = po.interferogram(pair)
    if smooth is not None:
        z = po.goldstein_filter(interferogram, [], "row", "col", smooth, cell)
        interferogram = z.withColumn("phase", F.atan2("im", "re"))
    return {"coregistered": coregistered, "interferogram": interferogram, "coherence": nb.windowed_coherence(pair, [], "row", "col", window)}


def matching_pairs(rows: DataFrame, keys: Sequence[str] = PAIR_KEYS) -> DataFrame:
    """Pairs (master, slave) of acquisitions, and an error in a column where their keys differ."""
    return checked_pairs(rows, keys).withColumn("problem", F.when(~F.col("matches"), F.concat(F.lit("pair differs in "), F.array_join("differ", ", "))))


def by_swath(product: DataFrame, swaths: Sequence[str], steps: Sequence[Step] | str) -> DataFrame:
    """A recipe run on each swath of a product apart, the results one below the other with their swath."""
    steps = recipe(steps) if isinstance(steps, str) else steps
    parts = [run(product.where(F.col("swath") == s), steps) for s in swaths]
    parts = [p if "swath" in p.columns else p.withColumn("swath", F.lit(s)) for p, s in zip(parts, swaths, strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def cut_into_tiles(image: DataFrame, tiles: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Pixels of the tiles (tile, row0, col0, height, width) that they lie in, numbered from each tile's corner.

    Tiles of one size on a grid meet a pixel by its block of that size: an equi
    join on the blocks a tile touches, then a filter; no join by ranges.
    """
    size = tiles.agg(F.max("height").alias("h"), F.max("width").alias("w")).first()
    h, w = int(size["h"] or 1), int(size["w"] or 1)
    block = lambda c, n: F.floor(F.col(c) / n)
    spread = tiles.withColumn("__br", F.explode(F.sequence(F.floor(F.col("row0") / h), F.floor((F.col("row0") + F.col("height") - 1) / h)))).withColumn("__bc", F.explode(F.sequence(F.floor(F.col("col0") / w), F.floor((F.col("col0") + F.col("width") - 1) / w))))
    met = image.withColumns({"__br": block("row", h), "__bc": block("col", w)}).join(spread, ["__br", "__bc"])
    r, c = F.col("row") - F.col("row0"), F.col("col") - F.col("col0")
    return met.where((r >= 0) & (r < F.col("height")) & (c >= 0) & (c < F.col("width"))).select("tile", r.alias("row"), c.alias("col"), *bands)


def tile_outcomes(cut: DataFrame, tiles: DataFrame, band: str, nodata: float = 0.0) -> DataFrame:
    """(tile, pixels, valid, status) of every tile: skipped if no pixel of the image is in it, failed without a valid one, partial if some are missing or without data."""
    valid = F.col(band).isNotNull() & ~F.isnan(band) & (F.col(band) != nodata)
    counts = cut.groupBy("tile").agg(F.count("*").alias("pixels"), F.sum(valid.cast("long")).alias("valid"))
    out = tiles.select("tile", (F.col("height") * F.col("width")).alias("__all")).join(counts, "tile", "left").fillna(0, ["pixels", "valid"])
    status = F.when(F.col("pixels") == 0, "skipped").when(F.col("valid") == 0, "failed").when(F.col("valid") < F.col("__all"), "partial").otherwise("success")
    return out.select("tile", "pixels", "valid", status.alias("status"))


def export_problems(products: dict[str, DataFrame], needed: Sequence[str] = EXPORT_BANDS) -> dict[str, list[str]]:
    """Bands that products lack for an export, by product; empty where none is missing."""
    return {name: [b for b in needed if b not in df.columns] for name, df in products.items()}
