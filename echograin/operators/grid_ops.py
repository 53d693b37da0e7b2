"""Which cells of a grid a footprint meets, boxes and transforms of cells, and pairs of products that may be put together."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_KM, grid_rows, inside, utm_forward

Ring = list[tuple[float, float]]


def _turn(ax: Column | float, ay: Column | float, bx: Column | float, by: Column | float, cx: Column | float, cy: Column | float) -> Column:
    """Twice the signed area of a triangle."""
    return (F.lit(bx) - ax) * (F.lit(cy) - ay) - (F.lit(by) - ay) * (F.lit(cx) - ax)


def edges_cross(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """Whether the segments a b and c d share a point; ends that touch count."""
    d1, d2, d3, d4 = _turn(*c, *d, *a), _turn(*c, *d, *b), _turn(*a, *b, *c), _turn(*a, *b, *d)
    span = lambda p, q, r, s: (F.greatest(F.lit(p), F.lit(q)) >= F.least(F.lit(r), F.lit(s))) & (F.greatest(F.lit(r), F.lit(s)) >= F.least(F.lit(p), F.lit(q)))
    return (d1 * d2 <= 0) & (d3 * d4 <= 0) & span(a[0], b[0], c[0], d[0]) & span(a[1], b[1], c[1], d[1])


def box_meets_ring(x0: Column, y0: Column, x1: Column, y1: Column, ring: Ring) -> Column:
    """Whether a box meets a polygon that the plan knows: a corner of one lies in the other, or edges cross."""
    closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    found = inside(x0, y0, ring) | inside(x1, y0, ring) | inside(x1, y1, ring) | inside(x0, y1, ring)
    for x, y in closed[:-1]:
        found = found | ((x0 <= x) & (x1 >= x) & (y0 <= y) & (y1 >= y))
    for p, q in zip(closed[:-1], closed[1:], strict=True):
        for a, b in zip(corners, [*corners[1:], corners[0]], strict=True):
            found = found | edges_cross(a, b, p, q)
    return found


def cells_on(cells: DataFrame, ring: Ring, margin: float = 1.0) -> DataFrame:
    """Cells (name, epsg, lon, lat, lon1, lat1) that meet a footprint, each name once; cells without a name, a code or a
    corner are left out.  The footprint's box with a margin is a plain filter that reaches the scan."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    whole = F.col("name").isNotNull() & F.col("epsg").isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull()
    near = cells.where(F.col("lon").between(min(xs) - margin, max(xs) + margin) & F.col("lat").between(min(ys) - margin, max(ys) + margin) & whole)
    met = near.where(box_meets_ring(F.col("lon"), F.col("lat"), F.col("lon1"), F.col("lat1"), ring))
    return first_of_name(met, ["lat", "lon"])


def first_of_name(cells: DataFrame, order: Sequence[str], name: str = "name") -> DataFrame:
    """One row a name, the first in order; an aggregation, no sort of all rows."""
    rest = [c for c in cells.columns if c != name]
    return cells.groupBy(name).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(name, "__r.*").select(*cells.columns)


def cell_box(lat: Column, lon: Column, zone: Column, size_m: float = 10_000.0) -> Column:
    """(min_x, min_y, max_x, max_y) of a cell of the grid in its zone, from its lower left point."""
    x, y = utm_forward(lat, lon, zone)
    return F.struct(x.alias("min_x"), y.alias("min_y"), (x + size_m).alias("max_x"), (y + size_m).alias("max_y"))


def pixel_transform(box: Column, width: Column | int, height: Column | int) -> Column:
    """(x0, dx, y0, dy) of a raster that covers a box; dy is negative."""
    w, h = F.lit(width), F.lit(height)
    return F.struct(box["min_x"].alias("x0"), ((box["max_x"] - box["min_x"]) / w).alias("dx"), box["max_y"].alias("y0"), ((box["min_y"] - box["max_y"]) / h).alias("dy"))


def circumference_km(lat: Column) -> Column:
    """Length of the circle of a latitude."""
    return 2 * math.pi * EARTH_RADIUS_KM * F.cos(F.radians(lat))


def within_longitudes(cells: DataFrame, low: float, high: float, lon: str = "lon") -> DataFrame:
    """Cells between two longitudes going east; a range over the date line has low above high."""
    c = F.col(lon)
    return cells.where(c.between(low, high) if low <= high else (c >= low) | (c <= high))


def place_of(row: Column, col: Column, dist_km: float) -> Column:
    """(lat, lon) of the lower left point of a cell by its numbers from the equator and the zero meridian."""
    lat = row * (180.0 / grid_rows(dist_km))
    return F.struct(lat.alias("lat"), (col * (360.0 / F.ceil(circumference_km(lat) / dist_km))).alias("lon"))


def by_rows(points: DataFrame, row: str = "row", lon: str = "lon") -> DataFrame:
    """(row, points, west, east): number and ends of the points of each row."""
    return points.groupBy(row).agg(F.count("*").alias("points"), F.min(lon).alias("west"), F.max(lon).alias("east"))


# products that go together

#: What two acquisitions of a burst have in common.
PAIR_KEYS = ("BurstId", "SwathIdentifier", "RelativeOrbitNumber", "OrbitDirection", "PolarisationChannels")


def checked_pairs(pairs: DataFrame, keys: Sequence[str] = PAIR_KEYS) -> DataFrame:
    """Pairs (master, slave as structs) with the keys in which they differ (nulls are alike) and whether there are none."""
    wrong = F.filter(F.array(*[F.when(~F.col("master")[k].eqNullSafe(F.col("slave")[k]), F.lit(k)) for k in keys]), lambda x: x.isNotNull())
    return pairs.withColumn("differ", wrong).withColumn("matches", F.size("differ") == 0)


def bands_added(product: DataFrame, source: DataFrame, keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """A product with bands of another one on the same grid; another size is an error.  Bands of the same name are replaced."""
    size = lambda df: df.agg(F.count("*"), *[F.max(k) for k in keys]).first()  # noqa: E731  one row
    a, b = size(product), size(source)
    if tuple(a) != tuple(b):
        raise ValueError(f"the grids differ: {tuple(a)} and {tuple(b)} (pixels, largest {', '.join(keys)})")
    left = product.drop(*bands)
    return left.join(source.select(*keys, *bands), list(keys))


def source_of_zone(zones: DataFrame, products: DataFrame) -> DataFrame:
    """(epsg, path, action): for each zone that tiles need, the product that is in it already, or what to reproject."""
    native = products.where("native").agg(F.first("path").alias("__native"))  # one row
    found = zones.select("epsg").distinct().join(products.groupBy("epsg").agg(F.min_by("path", ~F.col("native")).alias("path"), F.max("native").alias("native")), "epsg", "left")
    action = F.when(F.col("native"), "source").when(F.col("path").isNotNull(), "cached").otherwise("reproject")
    return found.join(F.broadcast(native), F.lit(True)).select("epsg", F.coalesce("path", "__native").alias("path"), action.alias("action"))


def swath_products(files: DataFrame, swaths: Sequence[str]) -> DataFrame:
    """(swath, paths): product folders by the swath that their names hold."""
    name = F.element_at(F.split("path", "/"), -1)
    found = F.regexp_extract(name, rf"(?:^|[_.-])({'|'.join(swaths)})(?:$|[_.-])", 1)
    return files.withColumn("swath", found).where("swath <> ''").groupBy("swath").agg(F.sort_array(F.collect_set("path")).alias("paths"))


def expected_bands(materialised: Column, declared: Column) -> Column:
    """Sorted band names of a product: those whose files are there, else those that its document declares."""
    known = F.filter(materialised, lambda b: b.isNotNull())
    return F.sort_array(F.array_distinct(F.when(F.size(known) > 0, known).otherwise(declared)))
