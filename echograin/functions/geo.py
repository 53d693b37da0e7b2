"""Map geometry as column expressions: UTM zones, the global grid, footprints, DEM cells."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6378.137


def utm_zone(lat: Column, lon: Column) -> Column:
    """Zone number, with the exceptions of southern Norway and Svalbard."""
    plain = (F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1).cast("int")
    norway = (lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12)
    svalbard = (lat >= 72) & (lat < 84)
    return (
        F.when(norway, 32)
        .when(svalbard & (lon >= 0) & (lon < 9), 31)
        .when(svalbard & (lon >= 9) & (lon < 21), 33)
        .when(svalbard & (lon >= 21) & (lon < 33), 35)
        .when(svalbard & (lon >= 33) & (lon < 42), 37)
        .otherwise(plain)
    )


def utm_epsg(lat: Column, lon: Column) -> Column:
    return F.when(lat < 0, 32700).otherwise(32600) + utm_zone(lat, lon)


#: WGS84, and the scale and false origin of UTM.
WGS84_A, WGS84_F, UTM_K0, UTM_E0 = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0


def utm_forward(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """(easting, northing) by Krueger's series to third order."""
    n = WGS84_F / (2 - WGS84_F)
    a = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    k = 2 * math.sqrt(n) / (1 + n)
    t = F.sinh(F.atanh(F.sin(phi)) - k * F.atanh(k * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    e, nn = eta, xi
    for j, c in enumerate(alpha, 1):
        e = e + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        nn = nn + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return UTM_E0 + UTM_K0 * a * e, F.when(lat < 0, 10000000.0).otherwise(0.0) + UTM_K0 * a * nn


def utm_inverse(easting: Column, northing: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """(lat, lon) of UTM coordinates."""
    n = WGS84_F / (2 - WGS84_F)
    a = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi = (northing - F.when(south, 10000000.0).otherwise(0.0)) / (UTM_K0 * a)
    eta = (easting - UTM_E0) / (UTM_K0 * a)
    x, y = xi, eta
    for j, c in enumerate(beta, 1):
        x = x - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi
    for j, c in enumerate(delta, 1):
        lat = lat + c * F.sin(2 * j * chi)
    return F.degrees(lat), F.degrees(F.atan2(F.sinh(y), F.cos(x))) + zone * 6 - 183


def dem_tile_name(lat: Column, lon: Column, resolution_m: int = 30) -> Column:
    """Name of the 1 degree elevation cell whose south-west corner is (lat, lon), whole degrees."""
    code = {30: "10", 90: "30"}[resolution_m]
    ns, ew = F.when(lat < 0, "S").otherwise("N"), F.when(lon < 0, "W").otherwise("E")
    pad = lambda x, k: F.lpad(F.abs(x).cast("int").cast("string"), k, "0")
    return F.concat(F.lit(f"Copernicus_DSM_COG_{code}_"), ns, pad(lat, 2), F.lit("_00_"), ew, pad(lon, 3), F.lit("_00_DEM"))


def bounding_cells(min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column) -> Column:
    """South-west corners of the 1 degree cells that a box meets, as an array of (lat, lon)."""
    lats = F.sequence(F.floor(min_lat).cast("int"), F.greatest(F.floor(min_lat), F.ceil(max_lat) - 1).cast("int"))
    lons = F.sequence(F.floor(min_lon).cast("int"), F.greatest(F.floor(min_lon), F.ceil(max_lon) - 1).cast("int"))
    return F.flatten(F.transform(lats, lambda a: F.transform(lons, lambda o: F.struct(a.alias("lat"), o.alias("lon")))))


# the global grid


def grid_rows(dist_km: float) -> int:
    """Rows from pole to pole."""
    return math.ceil(math.pi * EARTH_RADIUS_KM / dist_km)


def grid_columns(lat: Column, dist_km: float) -> Column:
    """Cells around the circle of a latitude."""
    return F.ceil(2 * math.pi * EARTH_RADIUS_KM * F.cos(F.radians(lat)) / dist_km)


def grid_cell(lat: Column, lon: Column, dist_km: float) -> Column:
    """Struct of the cell that holds a point: row and column numbers from the equator and the zero meridian, names, and
    the cell's south-west corner.  Rows go up (U) and down (D), columns right (R) and left (L) from 0U and 0R."""
    size = 180.0 / grid_rows(dist_km)
    # lines lie at whole multiples of the cell size from the equator and the zero meridian
    row = F.floor(lat / size + 1e-9).cast("int")
    row_lat = row * size
    width = F.lit(360.0) / grid_columns(row_lat, dist_km)
    col = F.floor(lon / width + 1e-9).cast("int")
    name = lambda x, up, down: F.concat(F.abs(x).cast("string"), F.when(x < 0, down).otherwise(up))
    return F.struct(row.alias("row"), col.alias("col"), F.concat(name(row, "U", "D"), F.lit("_"), name(col, "R", "L")).alias("name"), row_lat.alias("lat"), (col * width).alias("lon"))


def step_name(name: Column, by: int, up: str, down: str) -> Column:
    """A row or column name moved by a number of cells: 1D is south of 0U."""
    n = F.regexp_extract(name, r"^(\d+)", 1).cast("int")
    moved = F.when(name.endswith(down), -n).otherwise(n) + by
    return F.concat(F.abs(moved).cast("string"), F.when(moved < 0, down).otherwise(up))


def move_up(row: Column) -> Column:
    return step_name(row, 1, "U", "D")


def move_down(row: Column) -> Column:
    return step_name(row, -1, "U", "D")


def move_right(col: Column) -> Column:
    return step_name(col, 1, "R", "L")


def move_left(col: Column) -> Column:
    return step_name(col, -1, "R", "L")


def rectangles(contained: DataFrame, row: str = "row", col: str = "col") -> DataFrame:
    """Cells whose upper, upper right and right neighbours are contained too: three equi joins by number."""
    at = contained.select(row, col).distinct()
    out = at
    for dr, dc in ((1, 0), (1, 1), (0, 1)):
        out = out.join(at.select((F.col(row) - dr).alias(row), (F.col(col) - dc).alias(col)), [row, col], "left_semi")
    return out


# polygons: arrays of (lon, lat)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value made once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def ring_of_wkt(wkt: Column) -> Column:
    """Points of the outer ring of a POLYGON text."""
    body = F.regexp_extract(wkt, r"\(\(([^()]*)\)", 1)
    pairs = F.filter(F.split(body, r"\s*,\s*"), lambda p: F.length(F.trim(p)) > 0)
    point = lambda q: F.struct(F.element_at(q, 1).cast("double").alias("lon"), F.element_at(q, 2).cast("double").alias("lat"))
    return F.transform(pairs, lambda p: _once(F.split(F.trim(p), r"\s+"), point))


def ring_of_gml(text: Column, lat_first: bool = True) -> Column:
    """Points of `lat,lon lat,lon` text."""
    a, b = (2, 1) if lat_first else (1, 2)
    point = lambda q: F.struct(F.element_at(q, a).cast("double").alias("lon"), F.element_at(q, b).cast("double").alias("lat"))
    return F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda p: p.contains(",")), lambda p: _once(F.split(p, ","), point))


def ring_of_pos_list(text: Column, lat_first: bool = True) -> Column:
    """Points of flat numbers."""
    numbers = F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda p: p != ""), lambda p: p.cast("double"))
    first, second = (1, 0) if lat_first else (0, 1)
    point = lambda x, i: F.struct(F.get(x, 2 * i + first).alias("lon"), F.get(x, 2 * i + second).alias("lat"))
    return _once(numbers, lambda x: F.when(F.size(x) >= 2, F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / 2).cast("int") - 1), lambda i: point(x, i))))


def wkt_of_ring(ring: Column) -> Column:
    """POLYGON text of a ring, closed if it isn't."""

    def text(r: Column) -> Column:
        pairs = F.array_join(F.transform(r, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string"))), ", ")
        first = F.get(r, 0)
        end = F.when(first == F.try_element_at(r, F.lit(-1)), "").otherwise(F.concat(F.lit(", "), first["lon"].cast("string"), F.lit(" "), first["lat"].cast("string")))
        return F.concat(F.lit("POLYGON (("), pairs, end, F.lit("))"))

    return _once(ring, text)


def ordered_ring(points: Column) -> Column:
    """Distinct points counter-clockwise around their mean."""

    def ordered(p: Column) -> Column:
        mean = lambda f: F.try_divide(F.aggregate(p, F.lit(0.0), lambda s, x: s + x[f]), F.size(p))
        angle = lambda x, m: F.struct(F.atan2(x["lat"] - m["lat"], x["lon"] - m["lon"]).alias("a"), x["lon"].alias("lon"), x["lat"].alias("lat"))
        return _once(F.struct(mean("lon").alias("lon"), mean("lat").alias("lat")), lambda m: F.sort_array(F.transform(p, lambda x: angle(x, m))))

    return F.transform(_once(F.array_distinct(points), ordered), lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat")))


def inside(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point is strictly within a ring that the plan knows: a count of crossings, and it lies on no edge.

    An edge is the line lon - slope * lat = limit with constants of the plan, so a point that lies on it by that sum is on it.
    """
    crossings, on_edge = F.lit(0), F.lit(False)
    closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
    for (x0, y0), (x1, y1) in zip(closed, closed[1:], strict=False):
        if y0 == y1:
            on_edge = on_edge | ((lat == y0) & lon.between(min(x0, x1), max(x0, x1)))
            continue
        slope = (x1 - x0) / (y1 - y0)
        at, limit = lon - lat * slope, x0 - y0 * slope
        on_edge = on_edge | ((at == limit) & lat.between(min(y0, y1), max(y0, y1)))
        crossings = crossings + F.when((lat > min(y0, y1)) & (lat <= max(y0, y1)) & (at < limit), 1).otherwise(0)
    return (crossings % 2 == 1) & ~on_edge


def points_within(points: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """Points (lon, lat) inside a ring; its box is a plain filter that reaches the scan."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    return points.where(F.col("lon").between(min(xs), max(xs)) & F.col("lat").between(min(ys), max(ys))).where(inside(F.col("lon"), F.col("lat"), ring))


def pixel_region(min_x: Column, min_y: Column, max_x: Column, max_y: Column, x0: float, y0: float, dx: float, dy: float) -> Column:
    """(col, row, width, height) of a box in a raster of origin and pixel size; halves round to even."""
    col, row = F.bround((min_x - x0) / dx).cast("int"), F.bround((y0 - max_y) / dy).cast("int")
    return F.struct(col.alias("col"), row.alias("row"), F.bround((max_x - min_x) / dx).cast("int").alias("width"), F.bround((max_y - min_y) / dy).cast("int").alias("height"))


def region_within(region: Column, width: int, height: int) -> Column:
    return (region["col"] >= 0) & (region["row"] >= 0) & (region["col"] + region["width"] <= width) & (region["row"] + region["height"] <= height)


def grid_points(spark: SparkSession, dist_km: float, lat_range: tuple[float, float] = (-85, 85), lon_range: tuple[float, float] = (-180, 180)) -> DataFrame:
    """All grid points within the ranges: rows come from a range, each explodes into its own columns on the executors."""
    n = grid_rows(dist_km)
    rows = spark.range(-(n // 2), n - n // 2).select(F.col("id").cast("int").alias("row")).withColumn("lat", F.col("row") * (180.0 / n)).where(F.col("lat").between(*lat_range))
    spread = rows.withColumn("n_cols", grid_columns(F.col("lat"), dist_km)).withColumn("col", F.explode(F.sequence(-F.floor(F.col("n_cols") / 2), F.ceil(F.col("n_cols") / 2) - 1)))
    spread = spread.withColumn("lon", F.col("col") * 360.0 / F.col("n_cols")).where(F.col("lon").between(*lon_range))
    name = lambda x, up, down: F.concat(F.abs(x).cast("string"), F.when(x < 0, down).otherwise(up))
    return spread.select(F.concat(name(F.col("row"), "U", "D"), F.lit("_"), name(F.col("col"), "R", "L")).alias("name"), "row", F.col("col").cast("int").alias("col"), "lat", "lon", utm_epsg(F.col("lat"), F.col("lon")).alias("epsg"))
