"""Queries over raster formats and over the geometry of radar images; the pixels are those of the events (see queries_signal)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import domain_losses as dl
from ..operators import footprints as fp
from ..operators import geocoding as gc
from ..operators import geometry as gm
from ..operators import interferometry as itf
from ..operators import unwrapping as uw
from ..operators import vectors as vc
from ..sources import grids, hdf5, zarr_out
from ..sources import readers as rd
from . import recipes as rc
from . import stages
from .queries_signal import _RASTER, _raster
from .register import query


def _tiles(spark, d: str) -> DataFrame:
    """The rasters as cells: (tile, band, row, col, value)."""
    return _raster(spark, d).select(F.col("tile").cast("string").alias("tile"), F.lit("v").alias("band"), F.col("r").alias("row"), F.col("c").alias("col"), F.col("v").cast("float").alias("value"))


@query("h5_tiles", f"SELECT tile::VARCHAR AS tile, 'bands/v' AS band, r AS row_, c AS col_, round(v::FLOAT::DOUBLE, 4) AS value FROM {_RASTER}")
def h5_tiles(spark, d) -> DataFrame:
    """Every tile written as an HDF5 document and read back to cells."""
    files = rd.tile_payloads(_tiles(spark, d), "tile", "h5").select(F.col("tile").alias("path"), F.col("payload").alias("content"))
    cells = hdf5.cells_of(hdf5.pieces_of(files, "bands/"))
    return cells.select(F.col("path").alias("tile"), "band", F.col("row").alias("row_"), F.col("col").alias("col_"), F.round(F.col("value").cast("double"), 4).alias("value"))


@query("h5_objects", f"""
WITH t AS (SELECT tile::VARCHAR AS tile, max(r) + 1 AS h, max(c) + 1 AS w FROM {_RASTER} GROUP BY 1)
SELECT tile, '' AS name, 'group' AS kind, NULL::BIGINT AS height, NULL::BIGINT AS width, tile AS attribute FROM t
UNION ALL SELECT tile, 'bands', 'group', NULL, NULL, NULL FROM t UNION ALL SELECT tile, 'bands/v', 'dataset', h, w, NULL FROM t""")
def h5_objects(spark, d) -> DataFrame:
    """Groups, data sets and attributes of the tiles' HDF5 documents."""
    files = rd.tile_payloads(_tiles(spark, d), "tile", "h5").select(F.col("tile").alias("path"), F.col("payload").alias("content"))
    size = lambda k: F.get("shape", F.lit(k)).alias(("height", "width")[k])
    return hdf5.objects_of(files).select(F.col("path").alias("tile"), "name", "kind", size(0), size(1), F.col("attributes")["tile"].alias("attribute"))


@query("zarr_chunks", "SELECT (event_id // 50)::INT AS row_, (event_id % 50)::INT AS col_, round((value / 100)::FLOAT::DOUBLE, 4) AS value FROM events")
def zarr_chunks(spark, d) -> DataFrame:
    """All rasters below one another as the chunks of one array, encoded and read back."""
    e = F.col("event_id")
    events = spark.read.parquet(f"{d}/events.parquet").select(F.floor(e / 50).alias("row"), (e % 50).alias("col"), (F.col("value") / 100).alias("value"))
    about = zarr_out.array_about((1 << 31, 50), (512, 16), "<f4", "zlib")  # as tall as row numbers go; chunks without cells aren't made
    chunks = zarr_out.zarr_chunks(events, about)
    read = grids.zarr_cells(chunks, {**about, "separator": ".", "codec": "zlib"}, "events")
    # a chunk holds the fill value where there was no cell, as in the last, lower part
    known = events.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))
    return read.join(known, ["row", "col"], "left_semi").select(F.col("row").alias("row_"), F.col("col").alias("col_"), F.round(F.col("value").cast("double"), 4).alias("value"))


# the sensor passes in a straight line over each tile, so that SQL knows its closest approach in closed form

_P, _V = (4963800.0, 697600.0, 4982300.0), (-5251.0, -738.0, 5303.0)
#: First line's time, line time, near range, spacing of the image.
_IMAGE = (-0.6, 0.0149, 734600.0, 40.0)


def _ground(spark, d: str) -> DataFrame:
    return _raster(spark, d).select("tile", "r", "c", (45 - F.col("r") * 0.001).alias("lat"), (10 + F.col("c") * 0.001).alias("lon"), (F.col("v") * 5).alias("height"))


def _orbits(spark, d: str) -> DataFrame:
    t = (F.col("k") * 4.0).alias("t")
    place = lambda i: (_P[i] + (F.col("tile") * 10 if i == 0 else 0) + _V[i] * F.col("k") * 4.0).alias("xyz"[i])
    states = _raster(spark, d).select("tile").distinct().withColumn("k", F.explode(F.sequence(F.lit(-3), F.lit(3))))
    return states.select("tile", t, *(place(i) for i in range(3)), *(F.lit(_V[i]).alias(n) for i, n in enumerate(("vx", "vy", "vz"))))


_PLACES = f"""
g AS (SELECT tile, r, c, radians(45 - r * 0.001) AS lat, radians(10 + c * 0.001) AS lon, v * 5 AS h, {gc.A} / sqrt(1 - {gc.E2!r} * sin(lat) * sin(lat)) AS n FROM {_RASTER}),
x AS (SELECT tile, r, c, h, (n + h) * cos(lat) * cos(lon) - ({_P[0]} + tile * 10) AS x, (n + h) * cos(lat) * sin(lon) - {_P[1]} AS y, (n * (1 - {gc.E2!r}) + h) * sin(lat) - {_P[2]} AS z FROM g),
t AS (SELECT *, (x * {_V[0]}::DOUBLE + y * {_V[1]}::DOUBLE + z * {_V[2]}::DOUBLE) / {sum(v * v for v in _V)!r}::DOUBLE AS t FROM x),
p AS (SELECT tile, r, c, h, t, sqrt((x - {_V[0]}::DOUBLE * t) ** 2 + (y - {_V[1]}::DOUBLE * t) ** 2 + (z - {_V[2]}::DOUBLE * t) ** 2) AS slant FROM t)"""


@query("radar_positions", f"WITH {_PLACES} SELECT tile, r, c, round(t, 8) AS azimuth_time, round(slant, 4) AS slant_range FROM p")
def radar_positions(spark, d) -> DataFrame:
    """Zero-Doppler times and slant ranges of all pixels' ground."""
    found = gc.radar_positions(_ground(spark, d), _orbits(spark, d), ["tile"], "r", "c")
    return found.select("tile", "r", "c", F.round("azimuth_time", 8).alias("azimuth_time"), F.round("slant_range", 4).alias("slant_range"))


@query("terrain_correction", f"""
WITH {_PLACES},
q AS (SELECT tile, r, c, (t - {_IMAGE[0]}::DOUBLE) / {_IMAGE[1]}::DOUBLE AS y, (slant - {_IMAGE[2]}::DOUBLE) / {_IMAGE[3]}::DOUBLE AS x FROM p),
k AS (SELECT q.*, floor(y)::BIGINT + i AS ki, floor(x)::BIGINT + j AS kj, (CASE WHEN i = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN j = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w
  FROM q, (SELECT unnest([0, 0, 1, 1]) AS i, unnest([0, 1, 0, 1]) AS j) o),
s AS (SELECT k.tile, k.r, k.c, any_value(y) AS y, any_value(x) AS x, CASE WHEN count(m.v) = count(*) THEN sum(w * m.v) END AS value FROM k LEFT JOIN {_RASTER} m ON m.tile = k.tile AND m.r = k.ki AND m.c = k.kj WHERE w > 0 GROUP BY 1, 2, 3)
SELECT tile, r, c, round(y, 5) AS y, round(x, 5) AS x, round(value, 4) AS value FROM s""")
def terrain_correction(spark, d) -> DataFrame:
    """Every tile's image on its ground, bilinear; null where the ground lies outside of the image."""
    image = _raster(spark, d).select("tile", "r", "c", "v")
    found = gc.terrain_corrected(image, _ground(spark, d), _orbits(spark, d), ["tile"], "v", *_IMAGE, row="r", col="c")
    return found.select("tile", "r", "c", F.round("y", 5).alias("y"), F.round("x", 5).alias("x"), F.round("v", 4).alias("value"))


# phases


def _wrap(x: str) -> str:
    return f"({x}) - 2 * pi() * round(({x}) / (2 * pi()), 0)"


@query("unwrapped_2d", f"""
WITH z AS (SELECT tile, r, c, 0.7 * r + 0.4 * c + v * 0.05 AS z FROM {_RASTER}), f AS (SELECT tile, arg_min(z, r * 50 + c) AS z0 FROM z GROUP BY tile)
SELECT tile, r, c, round(z - z0 + {_wrap('z0')}, 6) AS unwrapped FROM z JOIN f USING (tile)""")
def unwrapped_2d(spark, d) -> DataFrame:
    """The tiles' surfaces of known phase, wrapped and unwrapped in blocks."""
    z = 0.7 * F.col("r") + 0.4 * F.col("c") + F.col("v") * 0.05
    wrapped = _raster(spark, d).select("tile", "r", "c", uw.wrapped(z).alias("phase"))
    return uw.unwrapped(wrapped, ["tile"], "r", "c", "phase", block=16).select("tile", "r", "c", F.round("unwrapped", 6).alias("unwrapped"))


@query("phase_residues", f"""
WITH p AS (SELECT tile, r, c, {_wrap('v * 0.7')} AS p FROM {_RASTER}),
q AS (SELECT a.tile, a.r, a.c, {_wrap('b.p - a.p')} AS top, {_wrap('e.p - b.p')} AS right_, {_wrap('e.p - x.p')} AS low, {_wrap('x.p - a.p')} AS left_
  FROM p a JOIN p b ON b.tile = a.tile AND b.r = a.r AND b.c = a.c + 1 JOIN p x ON x.tile = a.tile AND x.r = a.r + 1 AND x.c = a.c JOIN p e ON e.tile = a.tile AND e.r = a.r + 1 AND e.c = a.c + 1)
SELECT tile, r, c, round((top + right_ - low - left_) / (2 * pi()), 0)::INT AS residue FROM q""")
def phase_residues(spark, d) -> DataFrame:
    """Residues of the tiles' phases."""
    p = _raster(spark, d).select("tile", "r", "c", uw.wrapped(F.col("v") * 0.7).alias("phase"))
    return uw.residues(p, ["tile"], "r", "c", "phase")


_SECOND = (25.0, 90.0, 60.0)  #: place of the second pass against the first


@query("interferometric_geometry", f"""
WITH {_PLACES},
n AS (SELECT tile, r, c, h, x - ({_SECOND[0]}) AS x, y - ({_SECOND[1]}) AS y, z - ({_SECOND[2]}) AS z, x AS x1, y AS y1, z AS z1, t FROM t),
m AS (SELECT *, (x * {_V[0]}::DOUBLE + y * {_V[1]}::DOUBLE + z * {_V[2]}::DOUBLE) / {sum(v * v for v in _V)!r}::DOUBLE AS t2 FROM n),
k AS (SELECT tile, r, c, sqrt((x1 - {_V[0]}::DOUBLE * t) ** 2 + (y1 - {_V[1]}::DOUBLE * t) ** 2 + (z1 - {_V[2]}::DOUBLE * t) ** 2) AS s1, sqrt((x - {_V[0]}::DOUBLE * t2) ** 2 + (y - {_V[1]}::DOUBLE * t2) ** 2 + (z - {_V[2]}::DOUBLE * t2) ** 2) AS s2,
  {_SECOND[0]} + {_V[0]}::DOUBLE * (t2 - t) AS bx, {_SECOND[1]} + {_V[1]}::DOUBLE * (t2 - t) AS by_, {_SECOND[2]} + {_V[2]}::DOUBLE * (t2 - t) AS bz, x1 - {_V[0]}::DOUBLE * t AS lx, y1 - {_V[1]}::DOUBLE * t AS ly, z1 - {_V[2]}::DOUBLE * t AS lz FROM m)
SELECT tile, r, c, round(-4 * pi() / 0.0555 * (s1 - s2), 1) AS phase, round((bx * lx + by_ * ly + bz * lz) / s1, 3) AS parallel FROM k""")
def interferometric_geometry(spark, d) -> DataFrame:
    """Phase and parallel baseline of a second pass over all pixels' ground."""
    first = _orbits(spark, d)
    second = first.select("tile", "t", *((F.col(c) + s).alias(c) for c, s in zip("xyz", _SECOND, strict=True)), "vx", "vy", "vz")
    found = itf.interferometric_geometry(_ground(spark, d), first, second, ["tile"], 0.0555, "r", "c")
    return found.select("tile", "r", "c", F.round("phase", 1).alias("phase"), F.round("parallel", 3).alias("parallel"))


@query("three_pass", """
SELECT event_id, round(-4 * pi() * 110 * value / (0.0555 * (800000 + event_id % 5000) * sin(radians(30 + event_id % 15))), 8) AS topography, round(value / 100 - CASE WHEN event_id % 9 = 0 THEN NULL ELSE 60.0 / (event_id % 9 * 20) END * (event_id % 100) / 7, 8) AS deformation FROM events""")
def three_pass(spark, d) -> DataFrame:
    """Phases of heights, and phases of pairs without another pair's topography."""
    e = F.col("event_id")
    topography = itf.topographic_phase(F.col("value"), 0.0555, 800000 + e % 5000, 30 + e % 15, 110.0)
    deformation = itf.three_pass(F.col("value") / 100, (e % 100) / 7, F.lit(60.0), e % 9 * 20)
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.round(topography, 8).alias("topography"), F.round(deformation, 8).alias("deformation"))


@query("burst_overlaps", """
WITH b AS (SELECT event_id // 500 AS burst, event_id // 500 * 7 + event_id % 500 // 50 AS line, event_id % 50 AS col, cos(value / 40 + event_id // 500 * 0.31) AS re, sin(value / 40 + event_id // 500 * 0.31) AS im FROM events),
j AS (SELECT a.burst, a.col // 10 AS block, a.re * n.re + a.im * n.im AS x, a.im * n.re - a.re * n.im AS y FROM b a JOIN b n ON n.burst = a.burst + 1 AND n.line = a.line AND n.col = a.col)
SELECT burst, block, round(atan2(sum(y), sum(x)), 6) AS phase, round(sqrt(sum(x) ** 2 + sum(y) ** 2) / sum(sqrt(x * x + y * y)), 6) AS coherence, count(*) AS n FROM j GROUP BY 1, 2""")
def burst_overlaps(spark, d) -> DataFrame:
    """Double differences of the bursts' overlaps."""
    e, v = F.col("event_id"), F.col("value") / 40
    burst = F.floor(e / 500)
    b = spark.read.parquet(f"{d}/events.parquet").select(burst.alias("burst"), (burst * 7 + F.floor(e % 500 / 50)).alias("line"), (e % 50).alias("col"), F.cos(v + burst * 0.31).alias("re"), F.sin(v + burst * 0.31).alias("im"))
    return itf.overlap_phases(b, [], "burst", "line", "col", "re", "im", 10).select("burst", "block", F.round("phase", 6).alias("phase"), F.round("coherence", 6).alias("coherence"), "n")


@query("warped_tiles", f"""
WITH g AS (SELECT tile, r, c, r * 0.7 + 0.21 + tile * 0.1 AS y, c * 0.6 - 0.33 AS x FROM {_RASTER}),
k AS (SELECT g.*, floor(y)::BIGINT + i AS pr, floor(x)::BIGINT + j AS pc, CASE i WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END * CASE j WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END AS w FROM g, (SELECT unnest([0, 1]) AS i) m, (SELECT unnest([0, 1]) AS j) n)
SELECT k.tile, k.r, k.c, round(CASE WHEN count(p.v) = count(*) THEN sum(w * p.v) END, 9) AS v FROM k LEFT JOIN {_RASTER} p ON p.tile = k.tile AND p.r = pr AND p.c = pc WHERE w > 0 GROUP BY 1, 2, 3""")
def warped_tiles(spark, d) -> DataFrame:
    """All tiles on other pixels, each by a shift of its own, in one plan."""
    image = _raster(spark, d).select("tile", "r", "c", "v")
    targets = image.select("tile", "r", "c", (F.col("r") * 0.7 + 0.21 + F.col("tile") * 0.1).alias("y"), (F.col("c") * 0.6 - 0.33).alias("x"))
    return gm.sampled(image, targets, "r", "c", "v", keys=["tile"]).select("tile", "r", "c", F.round("v", 9).alias("v"))


# recipes over the tiles' pixels; the amplitude is v + 1


def _pixels(spark, d: str) -> DataFrame:
    return _raster(spark, d).select("tile", F.col("r").alias("row"), F.col("c").alias("col"), (F.col("v") + 1).alias("amplitude"))


def _recipe(name: str, sql: str, table, **aside):
    """Registers the recipe of a name as a query over table(spark, d), with further tables put aside."""

    def run(spark, d) -> DataFrame:
        out = rc.run(table(spark, d), rc.RECIPES[name], **{k: f(spark, d) for k, f in aside.items()})
        kinds = dict(out.dtypes)
        return out.select(*[F.round(c, 6).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in out.columns])

    query(f"recipe_{name}", sql)(run)


_recipe("backscatter_db", f"SELECT tile, r AS row, c AS col, round(v + 1, 6) AS amplitude, round((v + 1) ** 2, 6) AS sigma0, round(10 * log10((v + 1) ** 2), 6) AS sigma0_db FROM {_RASTER}", _pixels)

_recipe("subset_strip", f"SELECT tile, r AS row, c AS col, round(v + 1, 6) AS amplitude FROM {_RASTER} WHERE r <= 1023 AND c <= 1023", _pixels)


def _l_band(spark, d: str) -> DataFrame:
    v = F.col("amplitude")
    return _pixels(spark, d).select("tile", "row", "col", F.when(F.col("col") % 7 == 0, 0.0).otherwise(v).alias("hh"), (v * 2).alias("hv"), (v * 3).alias("vv"))


_TILED = "0::BIGINT AS tile_row, 0::BIGINT AS tile_col, r::BIGINT AS in_row, c::BIGINT AS in_col"
_recipe("l_band", f"""
WITH p AS (SELECT *, CASE WHEN c % 7 <> 0 THEN (v + 1) ** 2 END AS hh, (2 * (v + 1)) ** 2 AS hv FROM {_RASTER})
SELECT tile, r AS row, c AS col, round(hh, 6) AS hh, round(hv, 6) AS hv, round(3 * (v + 1), 6) AS vv, round(10 * log10(hh), 6) AS hh_db, round(10 * log10(hv), 6) AS hv_db, {_TILED} FROM p""", _l_band)

_recipe("p_band", f"""
WITH p AS (SELECT *, CASE WHEN c % 7 <> 0 THEN v + 1 END AS hh FROM {_RASTER})
SELECT tile, r AS row, c AS col, round(hh, 6) AS hh, round(2 * (v + 1), 6) AS hv, round(3 * (v + 1), 6) AS vv, round(10 * log10(hh), 6) AS hh_db, round(10 * log10(2 * (v + 1)), 6) AS hv_db, round(10 * log10(3 * (v + 1)), 6) AS vv_db, {_TILED} FROM p""", _l_band)


def _bursts(spark, d: str) -> DataFrame:
    """Tiles as bursts of three swaths: (swath, burst, pol, line, col, amplitude, i, q)."""
    p, t = _pixels(spark, d), F.col("tile")
    return p.select(F.concat(F.lit("IW"), (t % 3 + 1).cast("string")).alias("swath"), F.floor(t / 3).alias("burst"), F.when(F.col("col") % 2 == 0, "VV").otherwise("VH").alias("pol"), F.col("row").alias("line"), "col", "amplitude", F.cos("amplitude").alias("i"), F.sin("amplitude").alias("q"))


_BURSTS = f"(SELECT 'IW' || (tile % 3 + 1) AS swath, tile // 3 AS burst, CASE WHEN c % 2 = 0 THEN 'VV' ELSE 'VH' END AS pol, r AS line, c AS col, v + 1 AS amplitude, cos(v + 1) AS i, sin(v + 1) AS q FROM {_RASTER})"
#: Bursts joined: lines of half of an overlap of 10 go at inner edges, later bursts start that much earlier.
_JOINED = f"""
h AS (SELECT swath, burst, max(line) + 1 AS h FROM {_BURSTS} GROUP BY 1, 2),
s AS (SELECT *, coalesce(sum(h - 10) OVER (PARTITION BY swath ORDER BY burst ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, lag(h) OVER (PARTITION BY swath ORDER BY burst) IS NOT NULL AS inner_, lead(h) OVER (PARTITION BY swath ORDER BY burst) IS NOT NULL AS more FROM h)"""
_KEPT = "line >= CASE WHEN inner_ THEN 5 ELSE 0 END AND line < h - CASE WHEN more THEN 5 ELSE 0 END"

_recipe("tops_split", f"SELECT swath, burst, pol, line, col, round(amplitude, 6) AS amplitude, round(i, 6) AS i, round(q, 6) AS q FROM {_BURSTS} WHERE swath = 'IW1' AND burst BETWEEN 1 AND 3 AND pol = 'VV'", _bursts)

_recipe("tops", f"""
WITH {_JOINED}
SELECT swath, pol, (start + line)::BIGINT AS line, col, round(amplitude, 6) AS amplitude, round(i, 6) AS i, round(q, 6) AS q, round(amplitude * amplitude, 6) AS sigma0, round(10 * log10(amplitude * amplitude), 6) AS sigma0_db
FROM {_BURSTS} b JOIN s USING (swath, burst) WHERE {_KEPT}""", _bursts)


def _other(spark, d: str) -> DataFrame:
    return _bursts(spark, d).withColumns({"i": F.cos(F.col("amplitude") * 0.9 + 0.2), "q": F.sin(F.col("amplitude") * 0.9 + 0.2)})


_recipe("tops_interferogram", f"""
WITH {_JOINED}, p AS (SELECT *, cos(amplitude * 0.9 + 0.2) AS bi, sin(amplitude * 0.9 + 0.2) AS bq FROM {_BURSTS}),
x AS (SELECT *, i * bi + q * bq AS re, q * bi - i * bq AS im FROM p)
SELECT swath, (start + line)::BIGINT AS line, col, round(re, 6) AS re, round(im, 6) AS im, round(atan2(im, re), 6) AS phase FROM x JOIN s USING (swath, burst) WHERE {_KEPT}""", _bursts, other=_other)


def _looks(spark, d: str) -> DataFrame:
    p = _pixels(spark, d).withColumn("row", F.col("tile") * 40 + F.col("row"))
    return p.select("row", "col", F.explode(F.array(F.lit(1), F.lit(2))).alias("look"), "amplitude").withColumns({"i": F.col("amplitude") * F.col("look"), "q": F.col("amplitude") - F.col("look")}).drop("amplitude")


_recipe("looks_into_product", f"""
SELECT tile * 40 + r AS row, c AS col, round(v + 1, 6) AS amplitude, round(v + 1, 6) AS "i_SA1", round(v, 6) AS "q_SA1", round(2 * (v + 1), 6) AS "i_SA2", round(v - 1, 6) AS "q_SA2" FROM {_RASTER}""",
        lambda spark, d: _pixels(spark, d).select((F.col("tile") * 40 + F.col("row")).alias("row"), "col", "amplitude"), looks=_looks)


@query("export_plans", """
SELECT event_id, 'topsar_coreg_ifg' || CASE WHEN event_id % 2 = 0 THEN '_subset' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN '_no_esd' ELSE '' END || CASE WHEN event_id % 5 = 0 THEN '_ext_dem' ELSE '' END AS plan,
  CASE WHEN event_id % 3 = 0 THEN 4 ELSE 5 END + CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS stages FROM events""")
def export_plans(spark, d) -> DataFrame:
    """Plans of pairs by their numbers of sub-swaths and bursts."""
    rows = [(m == 1, b == 1, e, *(lambda p: (p.name, len(p.stages)))(stages.tops_pair(m, b, e))) for m in (1, 2) for b in (1, 2) for e in (False, True)]
    table = spark.createDataFrame(rows, "one boolean, burst boolean, dem boolean, plan string, stages int")
    e = F.col("event_id")
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", (e % 2 == 0).alias("one"), (e % 3 == 0).alias("burst"), (e % 5 == 0).alias("dem"))
    return events.join(F.broadcast(table), ["one", "burst", "dem"]).select("event_id", "plan", "stages")


# vectors, tie points, elevation, hulls


_STAR = "list_transform(range(5), lambda k: {'x': 25 + 20 * cos(4 * pi() * k / 5 + tile * 0.3), 'y': 20 + 17 * sin(4 * pi() * k / 5 + tile * 0.3)})"


@query("rasterized_stars", f"""
WITH t AS (SELECT tile, {_STAR} AS p FROM (SELECT DISTINCT tile FROM {_RASTER}) z), e AS (SELECT tile, p[i + 1] AS a, p[(i + 1) % 5 + 1] AS b FROM t, (SELECT unnest(range(5)) AS i) k),
x AS (SELECT q.tile, q.r, q.c, count(*) FILTER (WHERE (a.y <= r + 0.5) <> (b.y <= r + 0.5) AND a.x + (r + 0.5 - a.y) * (b.x - a.x) / (b.y - a.y) <= c + 0.5) AS n FROM {_RASTER} q JOIN e ON e.tile = q.tile GROUP BY 1, 2, 3)
SELECT tile, r, c, n % 2 = 1 AS inside FROM x""")
def rasterized_stars(spark, d) -> DataFrame:
    """A star over each tile by scan lines, its middle left out by the even-odd rule."""
    image = _raster(spark, d).select("tile", "r", "c")
    turn = lambda k: 4 * 3.141592653589793 * k / 5 + F.col("tile") * 0.3
    ring = F.array(*[F.struct((25 + 20 * F.cos(turn(k))).alias("x"), (20 + 17 * F.sin(turn(k))).alias("y")) for k in range(5)])
    stars = image.select("tile").distinct().select("tile", F.array(ring).alias("rings"))
    return vc.burned(image, stars, ["tile"], "rings", 40, 50, "r", "c")


_TIE_LAT, _TIE_LON = "45 - {r} * 0.01 + {c} * 0.002 + tile", "10 + {c} * 0.013 + {r} * 0.003 - {r} * {c} * 0.00001"


@query("tie_points", f"SELECT tile, r, c, round(({_TIE_LAT.format(r='r::DOUBLE', c='c::DOUBLE')})::DOUBLE, 8) AS lat, round(({_TIE_LON.format(r='r::DOUBLE', c='c::DOUBLE')})::DOUBLE, 8) AS lon, r::DOUBLE AS y, c::DOUBLE AS x FROM {_RASTER}")
def tie_points(spark, d) -> DataFrame:
    """All pixels on the ground by tie points of each tile, and back in the image."""
    pixels = _raster(spark, d).select("tile", "r", "c")
    ties = pixels.select("tile").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(5))))
    ties = ties.withColumns({"row": F.col("i") * 10.0, "col": F.col("j") * 10.0})
    ties = ties.withColumns({"lat": F.expr(_TIE_LAT.format(r="row", c="col")), "lon": F.expr(_TIE_LON.format(r="row", c="col"))})
    ground = vc.placed_on_ground(pixels, ties, ["tile"], 10.0, 10.0, "r", "c")
    back = vc.placed_in_image(ground, ties, ["tile"], 0.1)
    return back.select("tile", "r", "c", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), F.round("y", 5).alias("y"), F.round("x", 5).alias("x"))


@query("elevation_model", """
WITH t AS (SELECT event_id, event_id % 6 AS k, value FROM events), c AS (SELECT 40 + k // 3 AS lat0, 10 + k % 3 AS lon0, (event_id // 6) % 13 AS r, (event_id // 78) % 13 AS col, CASE WHEN event_id % 11 <> 0 THEN value END AS h, event_id AS p FROM t),
g AS (SELECT (90 - lat0 - 1) * 12 + r AS row_, (lon0 + 180) * 12 + col AS col_, h, p, lat0, lon0 FROM c WHERE h IS NOT NULL)
SELECT row_, col_, round(arg_min(h, p), 6) AS height FROM g GROUP BY 1, 2""")
def elevation_model(spark, d) -> DataFrame:
    """Tiles of 12 steps a degree, edges in both neighbours, as one model."""
    e, v = F.col("event_id"), F.col("value")
    k = e % 6
    tiles = spark.read.parquet(f"{d}/events.parquet").select((40 + F.floor(k / 3)).alias("lat0"), (10 + k % 3).alias("lon0"), (F.floor(e / 6) % 13).alias("row"), (F.floor(e / 78) % 13).alias("col"), F.when(e % 11 != 0, v).alias("height"), e.alias("priority"))
    return vc.elevation_model(tiles, 12).select(F.col("row").alias("row_"), F.col("col").alias("col_"), F.round("height", 6).alias("height"))


@query("hulls", """
WITH p AS (SELECT event_id // 12 AS k, event_id, value AS x, (user_id * 7919 % 10007)::DOUBLE + event_id % 12 * 0.01 AS y FROM events),
e AS (SELECT a.k, a.event_id AS a, b.event_id AS b, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM p a JOIN p b ON a.k = b.k AND a.event_id <> b.event_id),
h AS (SELECT e.k, a, b, any_value(ax) AS ax, any_value(ay) AS ay, any_value(bx) AS bx, any_value(by_) AS by_ FROM e JOIN p c ON c.k = e.k AND c.event_id <> a AND c.event_id <> b GROUP BY e.k, a, b HAVING max((bx - ax) * (c.y - ay) - (by_ - ay) * (c.x - ax)) < 0)
SELECT k, count(*)::INT AS corners, round(abs(sum(ax * by_ - bx * ay)) / 2, 5) AS area FROM h GROUP BY k HAVING count(*) > 2""")
def hulls(spark, d) -> DataFrame:
    """The convex hull of every twelve events by value and user."""
    e = F.col("event_id")
    points = spark.read.parquet(f"{d}/events.parquet").select(F.floor(e / 12).alias("k"), F.col("value").alias("x"), ((F.col("user_id") * 7919 % 10007).cast("double") + e % 12 * 0.01).alias("y"))
    ring = fp.convex_hull(points, ["k"], "x", "y").where("ring IS NOT NULL")
    return ring.select("k", (F.size("ring") - 1).alias("corners"), F.round(fp.ring_area(F.col("ring")), 5).alias("area"))


@query("manifest_footprints", """
SELECT event_id, 'POLYGON ((' || (event_id % 90) || ' ' || (event_id % 50) || ', ' || (event_id % 90 + 1) || ' ' || (event_id % 50) || ', ' || (event_id % 90 + 1) || ' ' || (event_id % 50 + 2) || ', ' || (event_id % 90) || ' ' || (event_id % 50) || '))' AS wkt FROM events""")
def manifest_footprints(spark, d) -> DataFrame:
    """Footprints out of a manifest's XML for every event."""
    e = F.col("event_id")
    a, o = (e % 50).cast("string"), (e % 90).cast("string")
    more = lambda c, n, k: (e % n + k).cast("string")
    coords = F.concat_ws(" ", F.concat(a, F.lit(","), o), F.concat(a, F.lit(","), more(o, 90, 1)), F.concat(more(a, 50, 2), F.lit(","), more(o, 90, 1)))
    text = F.concat(F.lit('<x xmlns:s="http://www.esa.int/safe/sentinel-1.0" xmlns:g="http://www.opengis.net/gml"><s:footPrint><g:coordinates>'), coords, F.lit("</g:coordinates></s:footPrint></x>"))
    files = spark.read.parquet(f"{d}/events.parquet").select(e.cast("string").alias("path"), text.alias("value"))
    return fp.manifest_footprints(files).select(F.col("path").cast("long").alias("event_id"), fp.ring_wkt(F.col("ring")).alias("wkt"))


@query("polarimetric_loss", """
SELECT l_returnflag, round(avg((l_discount - l_tax) ** 2 + (l_tax - l_discount * 0.5) ** 2 + (l_quantity / 50 - l_tax) ** 2 + (l_discount - 0.05) ** 2), 8) AS loss FROM lineitem GROUP BY 1""")
def polarimetric_loss(spark, d) -> DataFrame:
    """Loss of two polarimetric channels by flag."""
    a, b, q = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50
    return spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_returnflag").agg(F.round(dl.polarimetric_loss([(a, b, b, a * 0.5), (q, a, b, F.lit(0.05))]), 8).alias("loss"))


@query("displacement_chain", f"""
WITH z AS (SELECT tile, r, c, 0.5 * r + 0.3 * c + v * 0.04 AS z FROM {_RASTER}), f AS (SELECT tile, arg_min(z, r * 50 + c) AS z0 FROM z GROUP BY tile)
SELECT tile, r, c, round(-0.0555 * (z - z0 + {_wrap('z0')}) / (4 * pi()), 7) + 0.0 AS displacement FROM z JOIN f USING (tile)""")
def displacement_chain(spark, d) -> DataFrame:
    """An interferogram freed of the phase of heights, unwrapped, as displacement: steps of one recipe."""
    pixels = _raster(spark, d).select("tile", F.col("r").alias("row"), F.col("c").alias("col"), "v")
    heights = pixels.select("tile", "row", "col", (F.col("v") * 30).alias("height"), F.lit(8e5).alias("slant_range"), F.lit(35.0).alias("incidence"), F.lit(90.0).alias("perpendicular"))
    topography = itf.topographic_phase(F.col("v") * 30, 0.0555, F.lit(8e5), F.lit(35.0), F.lit(90.0))
    phase = 0.5 * F.col("row") + 0.3 * F.col("col") + F.col("v") * 0.04 + topography
    made = pixels.select("tile", "row", "col", F.cos(phase).alias("re"), F.sin(phase).alias("im"))
    steps = (rc.remove_topography("heights", ["tile", "row", "col"], 0.0555), rc.unwrap(["tile"]), rc.displacement("unwrapped", 0.0555))
    out = rc.run(made, steps, heights=heights)
    return out.select("tile", F.col("row").alias("r"), F.col("col").alias("c"), (F.round("displacement", 7) + 0.0).alias("displacement"))
