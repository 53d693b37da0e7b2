"""Recipes: sequences of steps over lazy DataFrames.

A step is a function of a Workspace (the table in hand and the tables put
aside) that gives the next one.  Operators with their arguments bound are
steps, so a recipe is a plain tuple that can be cut, joined and run on part;
running it only builds a plan, of which Catalyst sees the whole.  A recipe can
also be written as JSON: a list of objects with one operator and its arguments.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce, wraps
from types import MappingProxyType
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guards import to_db as decibels
from ..operators import geocoding as gc
from ..operators import interferometry as itf
from ..operators import neighbourhoods as nb
from ..operators import product_ops as po
from ..operators import relational as rl
from ..operators import unwrapping as uw


class Workspace(NamedTuple):
    """The table that steps work on, and those kept beside it by name."""

    table: DataFrame
    aside: Mapping[str, DataFrame] = MappingProxyType({})

    def other(self, name: str) -> DataFrame:
        try:
            return self.aside[name]
        except KeyError:
            raise LookupError(f"no table was put aside as {name!r}; there are {sorted(self.aside)}") from None


Step = Callable[[Workspace], Workspace]
#: Operators that JSON recipes can name: each takes its arguments and gives a step.
OPERATORS: dict[str, Callable[..., Step]] = {}


def step(f: Callable[..., DataFrame]) -> Callable[..., Step]:
    """Makes f(workspace, ...) -> DataFrame an operator that binds its arguments and gives a step."""

    @wraps(f)
    def bind(*args: Any, **named: Any) -> Step:
        return lambda w: w._replace(table=f(w, *args, **named))

    OPERATORS[f.__name__] = bind
    return bind


def put_aside(name: str) -> Step:
    """The table in hand is kept under a name, and stays in hand."""
    return lambda w: w._replace(aside={**w.aside, name: w.table})


def take_up(name: str) -> Step:
    """A table put aside is the one in hand again."""
    return lambda w: w._replace(table=w.other(name))


OPERATORS |= {"put_aside": put_aside, "take_up": take_up}


def run(table: DataFrame, recipe: Iterable[Step], **aside: DataFrame) -> DataFrame:
    """The table after all steps; further tables are aside from the start."""
    return reduce(lambda w, s: s(w), recipe, Workspace(table, aside)).table


def from_json(text: str) -> tuple[Step, ...]:
    """Steps of a text like ``[{"to_db": {"bands": ["vv"]}}, {"put_aside": {"name": "db"}}]``."""
    out = []
    for entry in json.loads(text):
        if not isinstance(entry, dict) or len(entry) != 1:
            raise ValueError(f"a step is an object with one operator, not {entry!r}")
        ((name, arguments),) = entry.items()
        if name not in OPERATORS:
            raise ValueError(f"no operator {name!r}; there are {', '.join(sorted(OPERATORS))}")
        out.append(OPERATORS[name](**(arguments or {})))
    return tuple(out)


# bands and pixels


@step
def select(w: Workspace, columns: Sequence[str]) -> DataFrame:
    return w.table.select(*columns)


@step
def band_select(w: Workspace, pattern: str, keep: Sequence[str] = ()) -> DataFrame:
    """Columns whose name holds the pattern, and those to keep."""
    return w.table.select(*[c for c in w.table.columns if c in keep or re.search(pattern, c)])


@step
def band_maths(w: Workspace, expressions: Mapping[str, str]) -> DataFrame:
    """New bands by SQL expressions."""
    return w.table.withColumns({k: F.expr(v) for k, v in expressions.items()})


@step
def subset(w: Workspace, condition: str) -> DataFrame:
    return w.table.where(condition)


@step
def no_data(w: Workspace, bands: Sequence[str], value: float = 0.0) -> DataFrame:
    return po.without_nodata(w.table, bands, value)


@step
def mask(w: Workspace, bands: Sequence[str], keep: str) -> DataFrame:
    """Bands as null where a SQL condition (land, sea, a shape) doesn't hold."""
    return po.masked(w.table, bands, F.expr(keep))


@step
def convert(w: Workspace, band: str, low: float, high: float, kind: str = "uint8", scaling: str = "linear") -> DataFrame:
    return w.table.withColumn(band, po.converted(F.col(band), F.lit(low), F.lit(high), kind, scaling))


# radiometry


def _noise(noise: str | float) -> Column:
    return F.col(noise) if isinstance(noise, str) else F.lit(float(noise))


@step
def calibrate(w: Workspace, band: str, gain: float | str, out: str, kind: str = "sigma0", incidence: str | None = None) -> DataFrame:
    """Amplitude to backscatter: amplitude squared over the squared gain (a number or a column of the look-up table);
    beta0 as it is, sigma0 times the sine of the incidence angle and gamma0 times its tangent, in degrees, if one is given."""
    scale = {"beta0": None, "sigma0": F.sin, "gamma0": F.tan}[kind]
    value = F.col(band) * F.col(band) / (_noise(gain) * _noise(gain))
    return w.table.withColumn(out, value * scale(F.radians(incidence)) if scale and incidence else value)


@step
def remove_noise(w: Workspace, band: str, noise: str | float, floor: float = 0.0) -> DataFrame:
    """Power less the noise power, a column of the noise table or a number, not below the floor."""
    return w.table.withColumn(band, F.greatest(F.lit(floor), F.col(band) - _noise(noise)))


@step
def flatten_terrain(w: Workspace, band: str, out: str, local_area: str, reference_area: str) -> DataFrame:
    """Backscatter over the ratio of the lit area of the terrain to that of flat ground (columns of a simulated image)."""
    return w.table.withColumn(out, F.when(F.col(local_area) > 0, F.col(band) * F.col(reference_area) / F.col(local_area)))


@step
def to_db(w: Workspace, bands: Sequence[str]) -> DataFrame:
    return w.table.withColumns({f"{b}_db": decibels(F.col(b)) for b in bands})


@step
def trim_border_noise(w: Workspace, keys: Sequence[str], row: str, col: str, band: str, limit: float, width: int) -> DataFrame:
    """Pixels within ``width`` columns of a line's ends are null if they are below the limit: the ends come by one aggregation a line."""
    ends = w.table.groupBy(*keys, row).agg(F.min(col).alias("__first"), F.max(col).alias("__last"))
    near = (F.col(col) < F.col("__first") + width) | (F.col(col) > F.col("__last") - width)
    both = w.table.join(ends, [*keys, row])
    return both.withColumn(band, F.when(~near | (F.col(band) >= limit), F.col(band))).drop("__first", "__last")


# neighbourhoods


@step
def multilook(w: Workspace, keys: Sequence[str], row: str, col: str, value: str, n_row: int, n_col: int) -> DataFrame:
    return nb.multilook(w.table, keys, row, col, value, n_row, n_col)


@step
def despeckle(w: Workspace, keys: Sequence[str], row: str, col: str, value: str, size: int = 5) -> DataFrame:
    return nb.lee_filter(w.table, keys, row, col, value, size)


@step
def coherence(w: Workspace, keys: Sequence[str], row: str, col: str, size: int) -> DataFrame:
    return nb.windowed_coherence(w.table, keys, row, col, size)


# bursts and interferometry


@step
def split_bursts(w: Workspace, swath: str, first: int, last: int, pols: Sequence[str]) -> DataFrame:
    return po.split_bursts(w.table, swath, first, last, pols)


@step
def deburst(w: Workspace, keys: Sequence[str], overlap: int) -> DataFrame:
    return po.debursted(w.table, keys, overlap)


@step
def pair_with(w: Workspace, other: str, keys: Sequence[str]) -> DataFrame:
    """The bands i and q of the table in hand and of another one by key, as (ar, ai, br, bi)."""
    a = w.table.select(*keys, F.col("i").alias("ar"), F.col("q").alias("ai"))
    return a.join(w.other(other).select(*keys, F.col("i").alias("br"), F.col("q").alias("bi")), list(keys))


@step
def interfere(w: Workspace, flat_phase: str | None = None) -> DataFrame:
    return po.interferogram(w.table, F.col(flat_phase) if flat_phase else None)


@step
def smooth_phase(w: Workspace, keys: Sequence[str], row: str, col: str, alpha: float = 1.0, block: int = 32) -> DataFrame:
    return po.goldstein_filter(w.table, keys, row, col, alpha, block)


# geometry; orbits, elevation and ground are tables put aside


@step
def terrain_correct(w: Workspace, ground: str, orbits: str, keys: Sequence[str], band: str, first_time: float, line_time: float, near_range: float, spacing: float, method: str = "bilinear") -> DataFrame:
    """The band on ground pixels (row, col, lat, lon, height) by zero-Doppler positions over the orbits."""
    return gc.terrain_corrected(w.table, w.other(ground), w.other(orbits), keys, band, first_time, line_time, near_range, spacing, method=method)


@step
def ellipsoid_correct(w: Workspace, ground: str, orbits: str, keys: Sequence[str], band: str, first_time: float, line_time: float, near_range: float, spacing: float, height: float = 0.0) -> DataFrame:
    """The band on ground pixels (row, col, lat, lon) at one height over the ellipsoid."""
    return gc.ellipsoid_corrected(w.table, w.other(ground), w.other(orbits), keys, band, first_time, line_time, near_range, spacing, height)


@step
def back_geocode(w: Workspace, reference: str, orbits: str, keys: Sequence[str], bands: Sequence[str], first_time: float, line_time: float, near_range: float, spacing: float) -> DataFrame:
    """Bands of a second image on the pixels of a reference whose ground is known (row, col, lat, lon, height)."""
    parts = [gc.back_geocoded(w.table.select(*keys, "row", "col", b), w.other(reference), w.other(orbits), keys, b, first_time, line_time, near_range, spacing) for b in bands]
    return reduce(lambda a, b: a.join(b.select(*keys, "row", "col", b.columns[-1]), [*keys, "row", "col"]), parts)


@step
def remove_topography(w: Workspace, heights: str, keys: Sequence[str], wavelength: float, slant_range: str = "slant_range", incidence: str = "incidence", baseline: str = "perpendicular") -> DataFrame:
    """An interferogram (re, im) without the phase of the heights that a table holds with their geometry; its phase follows."""
    own = w.other(heights).select(*keys, itf.topographic_phase(F.col("height"), wavelength, F.col(slant_range), F.col(incidence), F.col(baseline)).alias("__topography"))
    out = itf.without_phase(w.table.join(own, list(keys)), "re", "im", F.col("__topography")).drop("__topography")
    return out.withColumn("phase", F.atan2("im", "re"))


@step
def unwrap(w: Workspace, keys: Sequence[str], row: str = "row", col: str = "col", phase: str = "phase") -> DataFrame:
    return uw.unwrapped(w.table, keys, row, col, phase)


@step
def displacement(w: Workspace, phase: str, wavelength: float, out: str = "displacement") -> DataFrame:
    return w.table.withColumn(out, nb.phase_to_displacement(F.col(phase), wavelength))


# tables beside each other


@step
def merge(w: Workspace, other: str, keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """Bands of the table in hand, and of another one where they are missing."""
    return rl.merge_first_valid(w.table, w.other(other), keys, bands)


@step
def merge_iq(w: Workspace, other: str, keys: Sequence[str]) -> DataFrame:
    return po.merge_iq(w.table, w.other(other), keys)


@step
def stack(w: Workspace, others: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Tables put aside beside the one in hand by key; their other columns get the table's name."""
    out = w.table
    for name in others:
        other = w.other(name)
        out = out.join(other.select(*keys, *[other[c].alias(f"{c}_{name}") for c in other.columns if c not in keys]), list(keys), "left")
    return out


@step
def tile_cells(w: Workspace, row: str, col: str, size: int) -> DataFrame:
    """Which tile of ``size`` rows and columns each pixel is in, and its place there."""
    r, c = F.floor(F.col(row) / size), F.floor(F.col(col) / size)
    return w.table.withColumns({"tile_row": r, "tile_col": c, "in_row": F.col(row) - r * size, "in_col": F.col(col) - c * size})


@step
def write(w: Workspace, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Written as Parquet; the table stays in hand."""
    w.table.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return w.table


def _strip(keys: Sequence[str]) -> tuple[Step, ...]:
    """Calibrated, despeckled stripmap backscatter in dB, in tiles."""
    return (calibrate("amplitude", 1.0, "sigma0"), despeckle(keys, "row", "col", "sigma0"), to_db(["filtered"]), tile_cells("row", "col", 512))


#: Recipes over tables of pixels (tile, row, col, bands), by name; steps that need orbits, elevation or trained models aren't part of them.
RECIPES: dict[str, tuple[Step, ...]] = {
    "backscatter_db": (calibrate("amplitude", 1.0, "sigma0"), to_db(["sigma0"])),
    "strip": _strip(["tile"]),
    "spotlight": _strip(["tile"]),
    "tops": (deburst(["swath"], 10), calibrate("amplitude", 1.0, "sigma0"), to_db(["sigma0"])),
    "tops_split": (split_bursts("IW1", 1, 3, ["VV"]),),
    "tops_interferogram": (pair_with("other", ["swath", "burst", "line", "col"]), interfere(), deburst(["swath"], 10)),
    "strip_interferogram": (pair_with("other", ["row", "col"]), interfere(), smooth_phase([], "row", "col")),
    "subset_strip": (subset("row BETWEEN 0 AND 1023 AND col BETWEEN 0 AND 1023"),),
    "looks_into_product": (merge_iq("looks", ["row", "col"]),),
    "l_band": (no_data(["hh", "hv"]), calibrate("hh", 1.0, "hh"), calibrate("hv", 1.0, "hv"), to_db(["hh", "hv"]), tile_cells("row", "col", 512)),
    "p_band": (no_data(["hh", "hv", "vv"]), to_db(["hh", "hv", "vv"]), tile_cells("row", "col", 512)),
}
#: Which recipe a family of products (functions.products.product_mode) starts with.
RECIPE_OF_MODE = {"S1STRIP": "strip", "S1TOPS": "tops", "TSX": "spotlight", "CSG": "spotlight", "NISAR": "l_band", "BM": "p_band"}


def recipe(name: str) -> tuple[Step, ...]:
    """A recipe by its name or by the mode of a product."""
    found = RECIPES.get(RECIPE_OF_MODE.get(name, name))
    if found is None:
        raise LookupError(f"no recipe {name!r}; there are {', '.join(sorted([*RECIPES, *RECIPE_OF_MODE]))}")
    return found
