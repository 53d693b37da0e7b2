"""Queries of column expressions: indices, packets, strings, geometry."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import complexes as cx
from ..functions import geo, guards
from ..functions import indices as ix
from ..functions import packets as pk
from ..functions import products as pr
from ..operators import polarimetry as pol
from .register import query


def _table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(x, digits: int = 6):
    return F.round(x, digits)


def _unsigned(sql: str) -> str:
    """Zero without a sign, as Spark's round() gives it."""
    return re.sub(r", (\d+)\) AS", r", \1) + 0.0 AS", sql)


_PIXEL = "l_orderkey, l_linenumber"


@query("idx_radar", _unsigned(f"""
WITH p AS (SELECT {_PIXEL}, l_discount AS vv, l_tax AS vh, l_discount + 0.01 AS hh FROM lineitem)
SELECT {_PIXEL},
  round(CASE WHEN vv + vh > 0 THEN 4 * vh / (vv + vh) ELSE 'NaN'::DOUBLE END, 6) AS rvi, round(CASE WHEN vv + vh > 0 THEN 4 * vh / (vv + vh) ELSE 'NaN'::DOUBLE END, 6) AS dprvi_vv,
  round(CASE WHEN hh + vh > 0 THEN 4 * vh / (hh + vh) ELSE 'NaN'::DOUBLE END, 6) AS dprvi_hh, round((vv + vh) / sqrt(2.0), 6) AS dpdd,
  round(CASE WHEN vv + vh <> 0 THEN (vv - vh) / (vv + vh) ELSE 'NaN'::DOUBLE END, 6) AS ndpoll, round(CASE WHEN hh + vv + 2 * vh <> 0 THEN 8 * vh / (hh + vv + 2 * vh) ELSE 'NaN'::DOUBLE END, 6) AS qprvi,
  round(CASE WHEN hh + vh <> 0 THEN (hh - vh) / (hh + vh) ELSE 'NaN'::DOUBLE END, 6) AS rfdi, round(CASE WHEN vv <> 0 THEN (vv + vh) / vv ELSE 'NaN'::DOUBLE END, 6) AS vddpi,
  round(vh - vv, 6) AS vhvvd, round(vh * vv, 6) AS vhvvp, round(CASE WHEN vv <> 0 THEN vh / vv ELSE 'NaN'::DOUBLE END, 6) AS vhvvr,
  round(vv - vh, 6) AS vvvhd, round(CASE WHEN vh <> 0 THEN vv / vh ELSE 'NaN'::DOUBLE END, 6) AS vvvhr, round(vv + vh, 6) AS vvvhs
FROM p"""))  # fmt: skip
def idx_radar(spark, d):
    vv, vh, hh = F.col("l_discount"), F.col("l_tax"), F.col("l_discount") + 0.01
    found = {
        "rvi": ix.rvi(vv, vh), "dprvi_vv": ix.dprvi_vv(vv, vh), "dprvi_hh": ix.dprvi_hh(hh, vh), "dpdd": ix.dpdd(vv, vh), "ndpoll": ix.ndpoll(vv, vh),
        "qprvi": ix.qprvi(hh, vv, vh), "rfdi": ix.rfdi(hh, vh), "vddpi": ix.vddpi(vv, vh), "vhvvd": ix.vhvvd(vh, vv), "vhvvp": ix.vhvvp(vh, vv),
        "vhvvr": ix.vhvvr(vh, vv), "vvvhd": ix.vvvhd(vv, vh), "vvvhr": ix.vvvhr(vv, vh), "vvvhs": ix.vvvhs(vv, vh),
    }
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[_r(c).alias(k) for k, c in found.items()])


_OPT = f"(SELECT {_PIXEL}, l_tax + 0.05 AS red, l_discount + 0.3 AS nir, l_tax * 0.5 + 0.04 AS green, l_discount * 0.5 + 0.02 AS blue, l_quantity / 200 + 0.01 AS mir FROM lineitem)"


@query("idx_vegetation", _unsigned(f"""
SELECT {_PIXEL}, round((nir - red) / (nir + red), 6) AS ndvi, round(1.5 * (nir - red) / (nir + red + 0.5), 6) AS savi,
  round(0.5 * (nir - 0.5 * red - 0.5) / (0.5 * nir + red - 0.25 + 0.08 * 1.25), 6) AS tsavi,
  round((2 - (nir - red) / (nir + red) * (nir - 0.5 * red)) * (nir - red) / (nir + red + 1 - (nir - red) / (nir + red) * (nir - 0.5 * red)), 6) AS msavi,
  round((2 * nir + 1 - sqrt((2 * nir + 1) * (2 * nir + 1) - 8 * (nir - red))) / 2, 6) AS msavi2, round(nir - 0.5 * red, 6) AS wdvi,
  round(sqrt((nir - red) / (nir + red) + 0.5), 6) AS tndvi, round((nir - (2 * red - blue)) / (nir + 2 * red - blue), 6) AS arvi, round(nir - red, 6) AS dvi,
  round((2 * (nir * nir - red * red) + 1.5 * nir + 0.5 * red) / (nir + red + 0.5) * (1 - 0.25 * (2 * (nir * nir - red * red) + 1.5 * nir + 0.5 * red) / (nir + red + 0.5)) - (red - 0.125) / (1 - red), 6) AS gemi,
  round((nir - green) / (nir + green), 6) AS gndvi, round(nir / (nir + red), 6) AS ipvi, round(((mir - red) - 0.2 * (mir - green)) * (mir / red), 6) AS mcari,
  round(nir / red, 6) AS ratio_vi, round((nir - red) / (mir / green), 6) AS ireci, round((mir - red) / (mir + red), 6) AS ndi45, round(nir / red, 6) AS pssra,
  round((nir - red) * sqrt(0.5), 6) AS pvi
FROM {_OPT}"""))  # fmt: skip
def idx_vegetation(spark, d):
    red, nir, green, blue, mir = F.col("l_tax") + 0.05, F.col("l_discount") + 0.3, F.col("l_tax") * 0.5 + 0.04, F.col("l_discount") * 0.5 + 0.02, F.col("l_quantity") / 200 + 0.01
    found = {
        "ndvi": ix.ndvi(red, nir), "savi": ix.savi(red, nir), "tsavi": ix.tsavi(red, nir), "msavi": ix.msavi(red, nir), "msavi2": ix.msavi2(red, nir), "wdvi": ix.wdvi(red, nir),
        "tndvi": ix.tndvi(red, nir), "arvi": ix.arvi(red, nir, blue), "dvi": ix.dvi(red, nir), "gemi": ix.gemi(red, nir), "gndvi": ix.gndvi(green, nir), "ipvi": ix.ipvi(red, nir),
        "mcari": ix.mcari(red, mir, green), "ratio_vi": ix.ratio_vi(red, nir), "ireci": ix.ireci(red, mir, green, nir), "ndi45": ix.ndi45(red, mir), "pssra": ix.pssra(red, nir), "pvi": ix.pvi(red, nir),
    }
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[_r(c).alias(k) for k, c in found.items()])


@query("idx_water_soil", _unsigned(f"""
SELECT {_PIXEL}, round((green - mir) / (green + mir), 6) AS mndwi, round((nir - mir) / (nir + mir), 6) AS ndwi, round((green - nir) / (green + nir), 6) AS ndwi2,
  round((mir - green) / (mir + green), 6) AS ndpi, round((red - green) / (red + green), 6) AS ndti, round(sqrt((red * red + green * green) / 2), 6) AS bi,
  round(sqrt((red * red + green * green + nir * nir) / 3), 6) AS bi2, round((red - green) / (red + green), 6) AS ci, round(red * red / (green * green * green), 6) AS ri,
  round(700 + 40 * ((red + nir) / 2 - green) / (mir + 1 - green), 6) AS reip, round(705 + 35 * ((nir + red) / 2 - green) / (mir + 1 - green), 6) AS s2rep,
  round((nir - mir - 1) / (mir + 1 - red), 6) AS mtci, round(green - 1.005 * (blue + (red - blue) * (20.0 / 60.0)), 6) AS flh
FROM {_OPT}"""))  # fmt: skip
def idx_water_soil(spark, d):
    red, nir, green, blue, mir = F.col("l_tax") + 0.05, F.col("l_discount") + 0.3, F.col("l_tax") * 0.5 + 0.04, F.col("l_discount") * 0.5 + 0.02, F.col("l_quantity") / 200 + 0.01
    found = {
        "mndwi": ix.mndwi(green, mir), "ndwi": ix.ndwi(nir, mir), "ndwi2": ix.ndwi2(green, nir), "ndpi": ix.ndpi(green, mir), "ndti": ix.ndti(red, green), "bi": ix.bi(red, green),
        "bi2": ix.bi2(red, green, nir), "ci": ix.ci(red, green), "ri": ix.ri(red, green), "reip": ix.reip(red, green, mir + 1, nir), "s2rep": ix.s2rep(red, green, mir + 1, nir),
        "mtci": ix.mtci(red, mir + 1, nir), "flh": ix.flh(blue, green, red, 660.0, 680.0, 720.0),
    }
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[_r(c).alias(k) for k, c in found.items()])


_WORD = "((event_id * 2654435761) % 65536)"


@query("packet_primary", f"""
WITH w AS (SELECT event_id, {_WORD}::BIGINT AS a, ((event_id * 40503) % 65536)::BIGINT AS b, (event_id % 60000)::BIGINT AS c FROM events)
SELECT event_id, a >> 13 AS packet_version_number, (a >> 12) & 1 AS packet_type, (a >> 11) & 1 AS secondary_header_flag, (a >> 4) & 127 AS process_id,
       a & 15 AS packet_category, b >> 14 AS sequence_flags, b & 16383 AS packet_sequence_count, c + 1 AS packet_data_length, (a >> 13) = 0 AS valid_version FROM w""")  # fmt: skip
def packet_primary(spark, d):
    e = F.col("event_id")
    word = lambda x: F.lpad(F.hex(x.cast("long")), 4, "0")
    header = F.unhex(F.concat(word((e * 2654435761) % 65536), word((e * 40503) % 65536), word(e % 60000)))
    h = _table(spark, d, "events").select("event_id", pk.primary_header(header).alias("h")).select("event_id", "h.*")
    return h.withColumn("valid_version", pk.valid_packet_version(F.col("packet_version_number")))


@query("packet_secondary", """
WITH w AS (SELECT event_id, (event_id * 7919) % 256 AS x FROM events),
b AS (SELECT event_id, x::BIGINT AS b0, ((x + 31) % 256)::BIGINT AS b31, ((x + 35) % 256)::BIGINT AS b35, ((x + 36) % 256)::BIGINT AS b36, ((x + 37) % 256)::BIGINT AS b37, ((x + 53) % 256)::BIGINT AS b53, ((x + 57) % 256)::BIGINT AS b57,
      ((x + 4) % 256)::BIGINT AS b4, ((x + 5) % 256)::BIGINT AS b5, ((x + 1) % 256)::BIGINT AS b1, ((x + 2) % 256)::BIGINT AS b2, ((x + 3) % 256)::BIGINT AS b3, ((x + 44) % 256)::BIGINT AS b44, ((x + 45) % 256)::BIGINT AS b45, ((x + 46) % 256)::BIGINT AS b46 FROM w)
SELECT event_id, ((b0 * 256 + b1) * 256 + b2) * 256 + b3 AS coarse_time, round((b4 * 256 + b5 + 0.5) / 65536, 9) AS fine_time, b31 >> 7 AS error_flag, b31 & 31 AS baq_mode,
       round(b35 * (-0.5)::DOUBLE, 6) + 0.0 AS rx_gain, round((CASE WHEN b36 >= 128 THEN 1 ELSE -1 END) * (((b36 & 127) * 256 + b37) * (37.53472224e6 * 37.53472224e6 / 2097152)), 0) AS tx_pulse_ramp_rate,
       round(((b44 * 256 + b45) * 256 + b46) / 37.53472224e6, 9) AS pri, b53 >> 7 AS sas_ssb_flag, (b53 >> 4) & 7 AS polarisation, (b53 >> 2) & 3 AS temperature_compensation,
       b57 >> 4 AS signal_type, b57 & 1 AS swap_flag, (b31 & 31) IN (0, 3, 4, 5, 12, 13, 14) AS valid_baq FROM b""")  # fmt: skip
def packet_secondary(spark, d):
    x = (F.col("event_id") * 7919) % 256
    header = F.unhex(F.concat(*[F.lpad(F.hex(((x + k) % 256).cast("long")), 2, "0") for k in range(62)]))
    h = _table(spark, d, "events").select("event_id", header.alias("b")).select("event_id", pk.secondary_header(F.col("b")).alias("h"))
    return h.select("event_id", "h.coarse_time", _r(F.col("h.fine_time"), 9).alias("fine_time"), "h.error_flag", "h.baq_mode", _r(F.col("h.rx_gain")).alias("rx_gain"), _r(F.col("h.tx_pulse_ramp_rate"), 0).alias("tx_pulse_ramp_rate"), _r(F.col("h.pri"), 9).alias("pri"), "h.sas_ssb_flag", "h.polarisation", "h.temperature_compensation", "h.signal_type", "h.swap_flag", pk.valid_baq_mode(F.col("h.baq_mode")).alias("valid_baq"))


@query("packet_samples", """
SELECT event_id, CASE WHEN a >= 512 THEN -(a - 512) ELSE a END AS s0, CASE WHEN b >= 512 THEN -(b - 512) ELSE b END AS s1, round(CASE c WHEN 0 THEN 3 WHEN 1 THEN 8 / 3.0 WHEN 3 THEN 20 / 9.0 ELSE 16 / 9.0 END * 37.53472224, 3) AS rate_mhz
FROM (SELECT event_id, ((event_id * 37) % 1024)::BIGINT AS a, ((event_id * 91) % 1024)::BIGINT AS b, [0, 1, 3, 4][event_id % 4 + 1] AS c FROM events) t""")  # fmt: skip
def packet_samples(spark, d):
    e = F.col("event_id")
    a, b = (e * 37) % 1024, (e * 91) % 1024
    data = F.unhex(F.lpad(F.hex((a * 1024 + b) * 4096), 8, "0"))
    s = pk.bypass_samples(F.col("data"), 2)
    code = F.element_at(F.array(*[F.lit(x) for x in (0, 1, 3, 4)]), (e % 4 + 1).cast("int"))
    return _table(spark, d, "events").withColumn("data", data).select("event_id", F.get(s, 0).cast("long").alias("s0"), F.get(s, 1).cast("long").alias("s1"), _r(pk.sample_rate(code) / 1e6, 3).alias("rate_mhz"))


@query("ts_normalise", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS from_text FROM events")
def ts_normalise(spark, d):
    text = F.upper(F.date_format("ts", "dd-MMM-yyyy HH:mm:ss.SSSSSS"))
    return _table(spark, d, "events").select("event_id", pr.iso_timestamp(F.col("ts")).alias("iso"), pr.normalize_timestamp(text).alias("from_text"))


@query("product_mode", """
WITH p AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '/d/S1A_IW_SLC_' || event_id || '.SAFE' WHEN 1 THEN '/d/NISAR_' || event_id || '.h5' WHEN 2 THEN '/d/TDX1_' || event_id || '.xml' WHEN 3 THEN '/d/CSG_' || event_id || '.h5' ELSE '/d/S1B_SM_' || event_id || '.zip' END AS path FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'S1TOPS' WHEN 1 THEN 'NISAR' WHEN 2 THEN 'TSX' WHEN 3 THEN 'CSG' ELSE 'S1STRIP' END AS mode, regexp_extract(path || '_x_tc.dim', '/([^/]+?)_[^/_]+\\.dim$', 1) AS product FROM p""")  # fmt: skip
def product_mode(spark, d):
    e = F.col("event_id").cast("string")
    k = F.col("event_id") % 5
    path = F.when(k == 0, F.concat(F.lit("/d/S1A_IW_SLC_"), e, F.lit(".SAFE"))).when(k == 1, F.concat(F.lit("/d/NISAR_"), e, F.lit(".h5"))).when(k == 2, F.concat(F.lit("/d/TDX1_"), e, F.lit(".xml"))).when(k == 3, F.concat(F.lit("/d/CSG_"), e, F.lit(".h5"))).otherwise(F.concat(F.lit("/d/S1B_SM_"), e, F.lit(".zip")))
    return _table(spark, d, "events").select("event_id", pr.product_mode(path).alias("mode"), pr.product_id(F.concat(path, F.lit("_x_tc.dim"))).alias("product"))


@query("metadata_core", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 1 AS n_core FROM events")
def metadata_core(spark, d):
    k = F.get_json_object("props", "$.k")
    md = F.create_map(F.lit("PRODUCT"), k, F.lit("not_core"), F.lit("x"))
    return _table(spark, d, "events").select("event_id", pr.core_metadata(md)["PRODUCT"].cast("long").alias("k"), F.size(pr.core_metadata(md)).alias("n_core"))


_LL = "(SELECT event_id, ((event_id * 7919) % 16800) / 100.0 - 84 AS lat, ((event_id * 104729) % 35900) / 100.0 - 179.5 AS lon FROM events)"


def _points(spark, d):
    e = F.col("event_id")
    return _table(spark, d, "events").select("event_id", (((e * 7919) % 16800) / 100.0 - 84).alias("lat"), (((e * 104729) % 35900) / 100.0 - 179.5).alias("lon"))


@query("utm_zone", f"""
SELECT event_id, CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 WHEN lat >= 72 AND lat < 84 AND lon >= 0 AND lon < 9 THEN 31 WHEN lat >= 72 AND lat < 84 AND lon >= 9 AND lon < 21 THEN 33
  WHEN lat >= 72 AND lat < 84 AND lon >= 21 AND lon < 33 THEN 35 WHEN lat >= 72 AND lat < 84 AND lon >= 33 AND lon < 42 THEN 37 ELSE (floor((lon + 180) / 6)::INT % 60) + 1 END + CASE WHEN lat < 0 THEN 32700 ELSE 32600 END AS epsg FROM {_LL}""")  # fmt: skip
def utm_zone(spark, d):
    return _points(spark, d).select("event_id", geo.utm_epsg(F.col("lat"), F.col("lon")).alias("epsg"))


@query("dem_tile", f"""SELECT event_id, 'Copernicus_DSM_COG_10_' || CASE WHEN floor(lat) < 0 THEN 'S' ELSE 'N' END || lpad(abs(floor(lat))::INT::VARCHAR, 2, '0') || '_00_' || CASE WHEN floor(lon) < 0 THEN 'W' ELSE 'E' END || lpad(abs(floor(lon))::INT::VARCHAR, 3, '0') || '_00_DEM' AS tile FROM {_LL}""")
def dem_tile(spark, d):
    return _points(spark, d).select("event_id", geo.dem_tile_name(F.floor("lat"), F.floor("lon")).alias("tile"))


@query("grid_cell", f"""
WITH r AS (SELECT event_id, lon, floor(lat / (180.0 / 2004) + 1e-9)::INT AS row FROM {_LL}),
c AS (SELECT event_id, lon, row, ceil(2 * pi() * 6378.137 * cos(radians(row * (180.0 / 2004))) / 10) AS n FROM r),
k AS (SELECT event_id, row, floor(lon / (360.0 / n) + 1e-9)::INT AS col FROM c)
SELECT event_id, abs(row)::VARCHAR || CASE WHEN row < 0 THEN 'D' ELSE 'U' END || '_' || abs(col)::VARCHAR || CASE WHEN col < 0 THEN 'L' ELSE 'R' END AS name,
       abs(row + 1)::VARCHAR || CASE WHEN row + 1 < 0 THEN 'D' ELSE 'U' END AS up FROM k""")  # fmt: skip
def grid_cell(spark, d):
    p = _points(spark, d).select("event_id", geo.grid_cell(F.col("lat"), F.col("lon"), 10.0).alias("g"))
    return p.select("event_id", "g.name", geo.move_up(F.substring_index("g.name", "_", 1)).alias("up"))


@query("tile_select", f"SELECT event_id FROM {_LL} WHERE lon BETWEEN 0 AND 40 AND lat BETWEEN 0 AND 40 AND lon + lat < 40 AND lat > 0 AND lon > 0")
def tile_select(spark, d):
    return geo.points_within(_points(spark, d), [(0.0, 0.0), (40.0, 0.0), (0.0, 40.0), (0.0, 0.0)]).select("event_id")


@query("geo_text", f"SELECT event_id, round(lon, 2) AS lon, round(lat, 2) AS lat, 4 AS n FROM {_LL}")
def geo_text(spark, d):
    lon, lat = F.round("lon", 2), F.round("lat", 2)
    pair = lambda a, b: F.concat(a.cast("string"), F.lit(" "), b.cast("string"))
    wkt = F.concat(F.lit("POLYGON (("), pair(lon, lat), F.lit(", "), pair(lon + 1, lat), F.lit(", "), pair(lon, lat + 1), F.lit(", "), pair(lon, lat), F.lit("))"))
    ring = geo.ring_of_wkt(wkt)
    return _points(spark, d).select("event_id", ring[0]["lon"].alias("lon"), ring[0]["lat"].alias("lat"), F.size(ring).alias("n"))


@query("utm_project", f"SELECT event_id, round(lat, 5) AS lat, round(lon, 5) AS lon FROM {_LL}")
def utm_project(spark, d):
    """Forward and back again gives the point."""
    p = _points(spark, d).withColumn("zone", geo.utm_zone(F.col("lat"), F.col("lon")))
    e, n = geo.utm_forward(F.col("lat"), F.col("lon"), F.col("zone"))
    p = p.select("event_id", "zone", (F.col("lat") < 0).alias("south"), e.alias("e"), n.alias("n"))
    lat, lon = geo.utm_inverse(F.col("e"), F.col("n"), F.col("zone"), F.col("south"))
    return p.select("event_id", _r(lat, 5).alias("lat"), _r(lon, 5).alias("lon"))


@query("complex_polar", f"""SELECT {_PIXEL}, round(sqrt(l_discount * l_discount + l_tax * l_tax), 6) AS mag, round(atan2(l_tax, l_discount), 6) AS phase, round(CASE WHEN l_discount * l_discount + l_tax * l_tax > 0 THEN 10 * log10(l_discount * l_discount + l_tax * l_tax) ELSE 'NaN'::DOUBLE END, 5) AS db FROM lineitem""")
def complex_polar(spark, d):
    re, im = F.col("l_discount"), F.col("l_tax")
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _r(cx.magnitude(re, im)).alias("mag"), _r(cx.phase(re, im)).alias("phase"), _r(guards.to_db(cx.power(re, im)), 5).alias("db"))


@query("polarimetry", f"""
WITH p AS (SELECT {_PIXEL}, l_discount AS a, l_tax AS b, l_quantity / 50 AS c FROM lineitem)
SELECT {_PIXEL}, round(a * a + 2 * b * b + c * c, 6) AS span, round((a + c) * (a + c) / 2, 6) AS odd, round((a - c) * (a - c) / 2, 6) AS double, round(2 * b * b, 6) AS volume,
       round(a * c, 6) AS c13_re, round(c * c / (c * c + a * a), 6) AS csi, round(b * b / (b * b + (a * a + c * c) / 2), 6) AS vsi FROM p""")  # fmt: skip
def polarimetry(spark, d):
    z = lambda c: F.struct(c.alias("re"), F.lit(0.0).alias("im"))
    hh, hv, vv = z(F.col("l_discount")), z(F.col("l_tax")), z(F.col("l_quantity") / 50)
    parts, c3 = pol.pauli(hh, hv, vv), pol.covariance_c3(hh, hv, vv)
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _r(pol.span(hh, hv, vv)).alias("span"), _r(parts["odd"]).alias("odd"), _r(parts["double"]).alias("double"), _r(parts["volume"]).alias("volume"), _r(c3["c13"]["re"]).alias("c13_re"), _r(pol.canopy_structure(hh, vv)).alias("csi"), _r(pol.volume_scattering(hh, hv, vv)).alias("vsi"))
