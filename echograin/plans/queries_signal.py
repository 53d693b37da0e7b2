"""Queries of ordered, neighbourhood and signal operators, learners and streams."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import complexes as cx
from ..operators import classifiers as cl
from ..operators import kernels as kn
from ..operators import neighbourhoods as nb
from ..streaming import windows as sw
from . import recipes as rc
from .register import query


def _table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(x, digits: int = 6):
    return F.round(x, digits)


@query("win_box1d", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS mean, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 0) / 3, 6) AS smooth FROM events")
def win_box1d(spark, d):
    e = nb.box_mean_1d(_table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 5)
    return nb.box_sum_1d_zero(e, ["user_id"], ["ts", "event_id"], "value", 3).select("event_id", _r(F.col("mean")).alias("mean"), _r(F.col("smooth")).alias("smooth"))


# a raster of 100 columns a user-free tile: events in the order of their ids
_RASTER = "(SELECT event_id, event_id // 2000 AS tile, ((event_id % 2000) // 50)::INT AS r, (event_id % 50)::INT AS c, value / 100 AS v FROM events)"


def _raster(spark, d) -> DataFrame:
    e = F.col("event_id")
    return _table(spark, d, "events").select("event_id", F.floor(e / 2000).alias("tile"), F.floor((e % 2000) / 50).cast("int").alias("r"), (e % 50).cast("int").alias("c"), (F.col("value") / 100).alias("v"))


@query("box_mean_2d", f"""
WITH p AS (SELECT * FROM {_RASTER}), m AS (SELECT tile, max(r) AS mr, max(c) AS mc, min(r) AS nr, min(c) AS nc FROM p GROUP BY tile), o AS (SELECT unnest(range(-1, 2)) AS x)
SELECT p.tile, p.r, p.c, round(sum(q.v) / 9, 6) AS v FROM p JOIN m USING (tile), o a, o b, p q
WHERE q.tile = p.tile AND q.r = least(mr, greatest(nr, p.r + a.x)) AND q.c = least(mc, greatest(nc, p.c + b.x)) GROUP BY p.tile, p.r, p.c""")  # fmt: skip
def box_mean_2d(spark, d):
    return nb.box_mean_2d(_raster(spark, d), ["tile"], "r", "c", ["v"], 3).withColumn("v", _r(F.col("v")))


@query("multilook", f"SELECT tile, (r // 4)::BIGINT AS block_row, (c // 5)::BIGINT AS block_col, round(avg(v), 6) AS value FROM {_RASTER} GROUP BY 1, 2, 3 HAVING count(*) = 20")
def multilook(spark, d):
    return nb.multilook(_raster(spark, d), ["tile"], "r", "c", "v", 4, 5).withColumn("value", _r(F.col("value")))


@query("flip_undersample", f"SELECT tile, ((max(r) OVER (PARTITION BY tile) - r) // 2)::BIGINT AS r, (c // 5)::BIGINT AS c, round(v, 6) AS v FROM {_RASTER} QUALIFY (max(r) OVER (PARTITION BY tile) - r) % 2 = 0 AND c % 5 = 0")
def flip_undersample(spark, d):
    f = nb.flipped(_raster(spark, d), ["tile"], "r")
    return nb.undersample(f, "r", "c", 2, 5).select("tile", "r", "c", _r(F.col("v")).alias("v"))


@query("speckle_lee", f"""
WITH p AS (SELECT tile, r, c, v, max(r) OVER (PARTITION BY tile) AS h FROM {_RASTER}), o AS (SELECT unnest(range(-2, 3)) AS o),
m AS (SELECT p.tile, p.r, p.c, any_value(p.v) AS v, avg(q.v) AS m, greatest(avg(q.v * q.v) - avg(q.v) * avg(q.v), 0) AS s FROM p, o a, o b, p q WHERE q.tile = p.tile AND q.r = least(p.h, greatest(0, p.r + a.o)) AND q.c = least(49, greatest(0, p.c + b.o)) GROUP BY 1, 2, 3)
SELECT tile, r, c, round(m + CASE WHEN m <> 0 AND s / (m * m) > 1 THEN 1 - 1 / (s / (m * m)) ELSE 0 END * (v - m), 6) AS filtered FROM m""")  # fmt: skip
def speckle_lee(spark, d):
    return nb.lee_filter(_raster(spark, d), ["tile"], "r", "c", "v", 5).withColumn("filtered", _r(F.col("filtered")))


@query("cfar_detect", f"""
WITH p AS (SELECT tile, r, c, v, max(r) OVER (PARTITION BY tile) AS h FROM {_RASTER}), o AS (SELECT unnest(range(-3, 4)) AS o),
m AS (SELECT p.tile, p.r, p.c, any_value(p.v) AS v, avg(q.v) AS outer_, sum(CASE WHEN abs(a.o) <= 1 AND abs(b.o) <= 1 THEN q.v END) / 9 AS inner_ FROM p, o a, o b, p q WHERE q.tile = p.tile AND q.r = least(p.h, greatest(0, p.r + a.o)) AND q.c = least(49, greatest(0, p.c + b.o)) GROUP BY 1, 2, 3)
SELECT tile, r, c, v > 1.5 * (outer_ * 49 - inner_ * 9) / 40 AS detected FROM m""")  # fmt: skip
def cfar_detect(spark, d):
    return nb.cfar(_raster(spark, d), ["tile"], "r", "c", "v", 3, 7, 1.5).select("tile", "r", "c", "detected")


@query("coherence_window", f"""
WITH p AS (SELECT tile, r, c, v AS ar, c / 50 AS ai, v * 0.9 AS br, r / 40 AS bi, max(r) OVER (PARTITION BY tile) AS h FROM {_RASTER}), o AS (SELECT unnest(range(-2, 3)) AS o),
m AS (SELECT p.tile, p.r, p.c, avg(q.ar * q.br + q.ai * q.bi) AS re, avg(q.ai * q.br - q.ar * q.bi) AS im, avg(q.ar * q.ar + q.ai * q.ai) AS pa, avg(q.br * q.br + q.bi * q.bi) AS pb FROM p, o a, o b, p q WHERE q.tile = p.tile AND q.r = least(p.h, greatest(0, p.r + a.o)) AND q.c = least(49, greatest(0, p.c + b.o)) GROUP BY 1, 2, 3)
SELECT tile, r, c, round(sqrt(re * re + im * im) / (sqrt(pa * pb) + 1e-8), 6) AS coherence FROM m""")  # fmt: skip
def coherence_window(spark, d):
    r = _raster(spark, d).select("tile", "r", "c", F.col("v").alias("ar"), (F.col("c") / 50).alias("ai"), (F.col("v") * 0.9).alias("br"), (F.col("r") / 40).alias("bi"))
    return nb.windowed_coherence(r, ["tile"], "r", "c", 5).withColumn("coherence", _r(F.col("coherence")))


@query("slope_aspect", f"""
WITH g AS (SELECT tile, r, c, (lead(v) OVER (PARTITION BY tile, c ORDER BY r) - lag(v) OVER (PARTITION BY tile, c ORDER BY r)) / 20 AS gy, (lead(v) OVER (PARTITION BY tile, r ORDER BY c) - lag(v) OVER (PARTITION BY tile, r ORDER BY c)) / 20 AS gx FROM {_RASTER})
SELECT tile, r, c, round(degrees(atan(sqrt(gx * gx + gy * gy))), 5) AS slope, round(degrees(atan2(0.0 - gx, gy)), 5) + 0.0 AS aspect FROM g""")  # fmt: skip
def slope_aspect(spark, d):
    s = nb.slope_aspect(_raster(spark, d), ["tile"], "r", "c", "v", 10.0)
    return s.select("tile", "r", "c", _r(F.col("slope"), 5).alias("slope"), _r(F.col("aspect"), 5).alias("aspect"))


@query("total_variation", f"""
WITH g AS (SELECT tile, abs(lead(v) OVER (PARTITION BY tile, c ORDER BY r) - v) AS dy, abs(lead(v) OVER (PARTITION BY tile, r ORDER BY c) - v) AS dx FROM {_RASTER}) SELECT tile, round(avg(dx) + avg(dy), 6) AS tv FROM g GROUP BY tile""")
def total_variation(spark, d):
    return nb.total_variation(_raster(spark, d), ["tile"], "r", "c", "v").withColumn("tv", _r(F.col("tv")))


@query("change_detect", "SELECT l_orderkey, l_linenumber, round(l_tax - l_discount, 6) AS difference, round(CASE WHEN l_discount <> 0 THEN l_tax / l_discount END, 6) AS ratio, round(CASE WHEN l_discount > 0 AND l_tax > 0 THEN ln(l_tax / l_discount) END, 6) AS log_ratio, round(CASE WHEN l_discount + l_tax <> 0 THEN (l_tax - l_discount) / (l_tax + l_discount) END, 6) AS normalized FROM lineitem")
def change_detect(spark, d):
    c = nb.change(F.col("l_discount"), F.col("l_tax"))
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[_r(c[k]).alias(k) for k in ("difference", "ratio", "log_ratio", "normalized")])


@query("unwrap_phase", """
WITH p AS (SELECT event_id, user_id, ts, (value - floor(value / (2 * pi())) * 2 * pi()) - pi() AS ph FROM events), x AS (SELECT *, ph - lag(ph) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dd FROM p),
j AS (SELECT *, CASE WHEN dd IS NULL OR abs(dd) < pi() THEN 0 ELSE CASE WHEN dd - 2 * pi() * floor((dd + pi()) / (2 * pi())) = -pi() AND dd > 0 THEN pi() ELSE dd - 2 * pi() * floor((dd + pi()) / (2 * pi())) END - dd END AS jump FROM x)
SELECT event_id, round(ph + sum(jump) OVER (PARTITION BY user_id ORDER BY ts, event_id), 5) AS unwrapped FROM j""")  # fmt: skip
def unwrap_phase(spark, d):
    v = F.col("value")
    p = _table(spark, d, "events").withColumn("ph", (v - F.floor(v / (2 * math.pi)) * 2 * math.pi) - math.pi)
    return nb.unwrap_phase(p, ["user_id"], ["ts", "event_id"], "ph").select("event_id", _r(F.col("unwrapped"), 5).alias("unwrapped"))


@query("equal_energy_split", """
WITH s AS (SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) / sum(value) OVER (PARTITION BY user_id), 9) AS share FROM events)
SELECT event_id, least(2, greatest(0, ceil(share * 3)::INT - 1)) AS part FROM s""")
def equal_energy_split(spark, d):
    return nb.equal_energy_split(_table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 3).select("event_id", "part")


@query("asof_join", """
SELECT l_orderkey, l_linenumber, o.o_totalprice AS last_price FROM lineitem l ASOF LEFT JOIN (SELECT o_custkey % 10 AS g, o_orderdate, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1, 2) o ON l.l_suppkey % 10 = o.g AND l.l_shipdate >= o.o_orderdate""")
def asof_join(spark, d):
    left = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", (F.col("l_suppkey") % 10).alias("g"))
    right = _table(spark, d, "orders").groupBy((F.col("o_custkey") % 10).alias("g"), "o_orderdate").agg(F.max("o_totalprice").alias("p"))
    return nb.asof_join(left, right, ["g"], "l_shipdate", "o_orderdate", "p", "last_price").select("l_orderkey", "l_linenumber", "last_price")


@query("interpolate", """
WITH l AS (SELECT event_id, epoch_us(ts) AS t, user_id % 4 AS g FROM events), r AS (SELECT (user_id + 3) % 4 AS g, epoch_us(ts) AS t, max(value) AS v FROM events GROUP BY 1, 2),
p AS (SELECT l.*, r.t AS pt, r.v AS pv FROM l ASOF LEFT JOIN r ON l.g = r.g AND l.t >= r.t), n AS (SELECT l.event_id, r.t AS nt, r.v AS nv FROM l ASOF LEFT JOIN r ON l.g = r.g AND l.t <= r.t)
SELECT event_id, round(CASE WHEN pt IS NULL THEN nv WHEN nt IS NULL THEN pv WHEN nt > pt THEN pv + (nv - pv) * (t - pt) / (nt - pt) ELSE pv END, 4) AS value FROM p JOIN n USING (event_id)""")  # fmt: skip
def interpolate(spark, d):
    """Every event gets the value of the next group of users at its time; every event is a sample of its own group."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    left = _table(spark, d, "events").select("event_id", t.alias("t"), (F.col("user_id") % 4).alias("g"))
    right = _table(spark, d, "events").groupBy(((F.col("user_id") + 3) % 4).alias("g"), t.alias("t2")).agg(F.max("value").alias("v"))
    return nb.interpolate(left, right, ["g"], "t", "t2", "v", "value").select("event_id", _r(F.col("value"), 4).alias("value"))


@query("detrend", """
SELECT event_id, round(y - my - (mxy - mx * my) / (mxx - mx * mx) * (x - mx), 4) AS detrended FROM (SELECT event_id, x, y, avg(x) OVER w AS mx, avg(y) OVER w AS my, avg(x * y) OVER w AS mxy, avg(x * x) OVER w AS mxx
  FROM (SELECT event_id, event_type, (event_id % 1000) / 1000.0 AS x, value AS y FROM events) t WINDOW w AS (PARTITION BY event_type)) t""")  # fmt: skip
def detrend(spark, d):
    e = _table(spark, d, "events").withColumn("x", (F.col("event_id") % 1000) / 1000.0)
    return nb.detrended(e, ["event_type"], "x", "value").select("event_id", _r(F.col("detrended"), 4).alias("detrended"))


@query("equalize_histogram", """
WITH e AS (SELECT event_id, value, min(value) OVER () AS lo, (max(value) OVER () - min(value) OVER ()) / 8 AS w FROM events), b AS (SELECT *, least(7, floor((value - lo) / w))::INT AS i, (value - lo) / w AS x FROM e),
c AS (SELECT k, (SELECT count(*) FROM b WHERE i <= k) * 255.0::DOUBLE / (SELECT count(*) FROM b) AS cdf FROM (SELECT unnest(range(0, 8)) AS k) t)
SELECT event_id, round(h.cdf + (coalesce(n.cdf, h.cdf) - h.cdf) * least(1.0, x - i), 6) AS equalized FROM b JOIN c h ON h.k = i LEFT JOIN c n ON n.k = i + 1""")  # fmt: skip
def equalize_histogram(spark, d):
    return nb.histogram_equalized(_table(spark, d, "events").select("event_id", "value"), "value").select("event_id", _r(F.col("equalized")).alias("equalized"))


@query("array_slices", """
WITH RECURSIVE a AS (SELECT event_id // 50 AS row, value FROM events), n AS (SELECT max(row) + 1 AS n, greatest(4, (max(row) + 1) // 8) AS h FROM a),
s AS (SELECT 0 AS k, 0::BIGINT AS start, n, h, greatest(1, floor(h * 0.5)::BIGINT) AS step, floor(h * 0.15)::BIGINT AS cut FROM n
  UNION ALL SELECT k + 1, start + step, n, h, step, cut FROM s WHERE NOT (start + step >= n OR n - start <= 1.2 * h)),
t AS (SELECT k AS slice, start, CASE WHEN last THEN n ELSE least(start + h, n) END AS end_, CASE WHEN k > 0 THEN cut ELSE 0 END AS drop_start, CASE WHEN last THEN 0 ELSE cut END AS drop_end FROM (SELECT *, start + step >= n OR n - start <= 1.2 * h AS last FROM s) z)
SELECT slice::INT AS slice, start::INT AS start, end_::INT AS end, drop_start::INT AS drop_start, drop_end::INT AS drop_end, count(*) AS cells, round(sum(value), 4) AS total
FROM t JOIN a ON row >= start + drop_start AND row < end_ - drop_end GROUP BY ALL""")
def array_slices(spark, d):
    """All events as one tall array in overlapping slices: their cells between the rows that are dropped."""
    a = _table(spark, d, "events").select(F.floor(F.col("event_id") / 50).cast("int").alias("row"), "value")
    n = a.agg(F.max("row") + 1).first()[0]
    table = spark.createDataFrame(nb.slices(n, max(4, n // 8)), "slice int, start int, end int, drop_start int, drop_end int")
    found = nb.in_slices(a, "row", table)
    return found.groupBy(*table.columns).agg(F.count("*").alias("cells"), F.round(F.sum("value"), 4).alias("total"))


@query("vec_norm", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), 6) AS rms, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * (0.54 - 0.46 * cos(2 * pi() * (i - 1) / 63)))), 6) AS windowed FROM embeddings")
def vec_norm(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    return _table(spark, d, "embeddings").select("vec_id", _r(F.sqrt(add(F.transform(x, lambda v: v * v)) / F.size(x))).alias("rms"), _r(add(cx.windowed(x))).alias("windowed"))


def _signals(spark, d) -> DataFrame:
    return _table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


@query("fft_all", """
SELECT vec_id, k, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * cos(2 * pi() * k * (i - 1) / 64))), 5) + 0.0 AS re, round(-list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * sin(2 * pi() * k * (i - 1) / 64))), 5) + 0.0 AS im
FROM embeddings, (SELECT unnest(range(0, 64)) AS k) t""")  # fmt: skip
def fft_all(spark, d):
    """All 64 coefficients of all vectors."""
    z = kn.fft_1d()(F.col("x"), F.transform("x", lambda v: F.lit(0.0)))
    f = _signals(spark, d).select("vec_id", z.alias("z")).select("vec_id", F.posexplode(F.arrays_zip(F.col("z.re").alias("re"), F.col("z.im").alias("im"))).alias("k", "c"))
    return f.select("vec_id", F.col("k").cast("long").alias("k"), (_r(F.col("c.re"), 5) + 0.0).alias("re"), (_r(F.col("c.im"), 5) + 0.0).alias("im"))


@query("vec_fft", """
SELECT vec_id, k, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * cos(2 * pi() * k * (i - 1) / 64))), 5) + 0.0 AS re, round(-list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * sin(2 * pi() * k * (i - 1) / 64))), 5) + 0.0 AS im
FROM embeddings, (SELECT unnest(range(0, 4)) AS k) t""")  # fmt: skip
def vec_fft(spark, d):
    z = kn.fft_1d()(F.col("x"), F.transform("x", lambda v: F.lit(0.0)))
    f = _signals(spark, d).select("vec_id", z.alias("z")).select("vec_id", F.posexplode(F.slice(F.arrays_zip(F.col("z.re").alias("re"), F.col("z.im").alias("im")), 1, 4)).alias("k", "c"))
    return f.select("vec_id", F.col("k").cast("long").alias("k"), (_r(F.col("c.re"), 5) + 0.0).alias("re"), (_r(F.col("c.im"), 5) + 0.0).alias("im"))


@query("vec_filters", None)
def vec_filters(spark, d):
    x = F.col("x")
    all_of = lambda a: F.transform(a, lambda v: _r(v, 5))
    return _signals(spark, d).select("vec_id", all_of(kn.lowpass(0.1, 1.0)(x)).alias("low"), all_of(kn.highpass(0.1, 1.0)(x)).alias("high"), all_of(kn.bandpass(0.1, 0.3, 1.0)(x)).alias("band"), all_of(kn.envelope()(x)).alias("envelope"), all_of(kn.autocorrelated(8)(x)).alias("acf"), all_of(kn.downsampled(4)(x)).alias("down"), all_of(kn.kaiser_window()(x)).alias("kaiser"), all_of(kn.convolved([1, 2, 1])(x)).alias("smooth"))


@query("fft_2d_roundtrip", f"SELECT tile, r, c, round(v, 5) AS v FROM {_RASTER}")
def fft_2d_roundtrip(spark, d):
    """Two passes forward and two back give the raster."""
    r = _raster(spark, d).select("tile", "r", "c", F.col("v").alias("re"), F.lit(0.0).alias("im"))
    f = kn.fft_2d(r, ["tile"], "r", "c", "re", "im")
    return kn.fft_2d(f, ["tile"], "r", "c", "re", "im", inverse=True).select("tile", "r", "c", _r(F.col("re"), 5).alias("v"))


@query("sublooks", f"""
WITH f AS (SELECT tile, r, k, sum(v * cos(2 * pi() * k * c / 50)) AS re, -sum(v * sin(2 * pi() * k * c / 50)) AS im FROM {_RASTER}, (SELECT unnest(range(0, 50)) AS k) t GROUP BY tile, r, k),
q AS (SELECT *, CASE WHEN (k + 25) % 50 < 16 THEN 0 WHEN (k + 25) % 50 < 33 THEN 1 ELSE 2 END AS look FROM f)
SELECT tile, look, r, c::INT AS c, round(sqrt(sum(re * cos(2 * pi() * k * c / 50) - im * sin(2 * pi() * k * c / 50)) ** 2 + sum(re * sin(2 * pi() * k * c / 50) + im * cos(2 * pi() * k * c / 50)) ** 2) / 50 * sqrt(50.0 / CASE look WHEN 0 THEN 16 ELSE 17 END), 5) AS mag
FROM q, (SELECT unnest(range(0, 50)) AS c) t GROUP BY tile, look, r, c""")  # fmt: skip
def sublooks(spark, d):
    r = _raster(spark, d).select("tile", "r", "c", F.col("v").alias("re"), F.lit(0.0).alias("im"))
    s = kn.sublooks(r, ["tile"], "r", "c", "re", "im", 3)
    return s.select("tile", "look", "r", "c", _r(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")), 5).alias("mag"))


@query("recipe_backscatter", "SELECT l_orderkey, l_linenumber, round(10 * log10(l_quantity * l_quantity), 5) AS sigma0_db FROM lineitem WHERE l_quantity > 10")
def recipe_backscatter(spark, d):
    steps = (rc.subset("l_quantity > 10"), rc.band_maths({"amplitude": "l_quantity"}), *rc.recipe("backscatter_db"))
    return rc.run(_table(spark, d, "lineitem"), steps).select("l_orderkey", "l_linenumber", _r(F.col("sigma0_db"), 5).alias("sigma0_db"))


_BANDS = ["l_quantity", "l_discount", "l_tax"]


@query("ml_pca", None)
def ml_pca(spark, d):
    out = cl.principal_components(_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *_BANDS), _BANDS, 2)
    return out.select("l_orderkey", "l_linenumber", F.round(F.abs(out.components[0]), 4).alias("pc1"))


@query("ml_kmeans", None)
def ml_kmeans(spark, d):
    return cl.k_means(_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *_BANDS), _BANDS, 5, 10).groupBy("cluster").count()


@query("ml_random_forest", None)
def ml_random_forest(spark, d):
    t = _table(spark, d, "lineitem").withColumn("label", (F.col("l_quantity") > 25).cast("int"))
    return cl.random_forest(t.where("l_orderkey % 4 = 0"), t, _BANDS, "label", 5).groupBy("label", "class").count()


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    """The batch form; tests run the same function over a stream."""
    return sw.tumbling(_table(spark, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("total", _r(F.col("total"), 3))


@query("stream_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")  # fmt: skip
def stream_sessions(spark, d):
    s = sw.sessions(_table(spark, d, "events"))
    return s.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query("glcm_texture", f"""
WITH p AS (SELECT tile, r, c, least(7, floor(v * 8))::INT AS g FROM (SELECT tile, r, c, v / max(v) OVER () AS v FROM {_RASTER}) t),
n AS (SELECT a.tile, a.g AS i, b.g AS j, count(*) AS n FROM p a JOIN p b ON a.tile = b.tile AND a.r = b.r AND b.c = a.c + 1 GROUP BY 1, 2, 3),
s AS (SELECT tile, i, j, sum(n) AS n FROM (SELECT tile, i, j, n FROM n UNION ALL SELECT tile, j, i, n FROM n) t GROUP BY 1, 2, 3), q AS (SELECT tile, i, j, n / sum(n) OVER (PARTITION BY tile) AS p FROM s)
SELECT tile, round(sum(p * (i - j) ** 2), 6) AS contrast, round(sum(p * abs(i - j)), 6) AS dissimilarity, round(sum(p / (1 + (i - j) ** 2)), 6) AS homogeneity, round(sum(p * p), 6) AS energy, round(-sum(p * ln(p)), 6) AS entropy FROM q GROUP BY tile""")  # fmt: skip
def glcm_texture(spark, d):
    from ..operators import product_ops as po

    r = _raster(spark, d)
    top = r.agg(F.max("v").alias("m")).withColumn("k", F.lit(1))
    g = r.withColumn("k", F.lit(1)).join(F.broadcast(top), "k").withColumn("g", F.least(F.lit(7), F.floor(F.col("v") / F.col("m") * 8)).cast("int"))
    out = po.glcm(g, ["tile"], "r", "c", "g")
    return out.select("tile", *[_r(F.col(c)).alias(c) for c in ("contrast", "dissimilarity", "homogeneity", "energy", "entropy")])


@query("mosaic_first", f"WITH p AS (SELECT * FROM {_RASTER}) SELECT r, c, round(arg_min(v, tile), 6) AS value FROM p GROUP BY r, c")
def mosaic_first(spark, d):
    from ..operators import product_ops as po

    return po.mosaic(_raster(spark, d), ["r", "c"], "v", "tile").withColumn("value", _r(F.col("value")))


@query("stack_average", f"SELECT r, c, round(avg(v), 6) AS value FROM {_RASTER} GROUP BY r, c")
def stack_average(spark, d):
    from ..operators import product_ops as po

    return po.stack_average(_raster(spark, d), ["r", "c"], "v").withColumn("value", _r(F.col("value")))


@query("temporal_percentile", f"SELECT r, c, round(quantile_cont(v, 0.9), 6) AS value FROM {_RASTER} GROUP BY r, c")
def temporal_percentile(spark, d):
    from ..operators import product_ops as po

    return po.temporal_percentile(_raster(spark, d), ["r", "c"], "v", 90).withColumn("value", _r(F.col("value")))


@query("convert_datatype", f"WITH p AS (SELECT *, min(v) OVER () AS lo, max(v) OVER () AS hi FROM {_RASTER}) SELECT event_id, greatest(0, least(255, floor((v - lo) / (hi - lo) * 255)))::BIGINT AS value FROM p")
def convert_datatype(spark, d):
    from ..operators import product_ops as po

    r = _raster(spark, d)
    ends = r.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("k", F.lit(1))
    return r.withColumn("k", F.lit(1)).join(F.broadcast(ends), "k").select("event_id", po.converted(F.col("v"), F.col("lo"), F.col("hi")).alias("value"))


@query("deburst", f"""
SELECT tile * 30 + r AS line, c, round(v, 6) AS v FROM {_RASTER} WHERE r >= CASE WHEN tile > 0 THEN 5 ELSE 0 END AND r < 40 - CASE WHEN tile < (SELECT max(tile) FROM {_RASTER}) THEN 5 ELSE 0 END""")  # fmt: skip
def deburst(spark, d):
    from ..operators import product_ops as po

    r = _raster(spark, d).select(F.lit("IW1").alias("swath"), F.col("tile").alias("burst"), F.col("r").alias("line"), "c", "v")
    return po.debursted(r, ["swath"], 10).select("line", "c", _r(F.col("v")).alias("v"))


@query("interferogram", "SELECT l_orderkey, l_linenumber, round(l_discount * l_tax + l_quantity * l_quantity / 100, 6) AS re, round((l_tax - l_discount) * l_quantity / 10, 6) + 0.0 AS im FROM lineitem")
def interferogram(spark, d):
    from ..operators import product_ops as po

    q = F.col("l_quantity") / 10
    pair = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("ar"), q.alias("ai"), F.col("l_tax").alias("br"), q.alias("bi"))
    return po.interferogram(pair).select("l_orderkey", "l_linenumber", _r(F.col("re")).alias("re"), (_r(F.col("im")) + 0.0).alias("im"))


@query("ssim_window", f"""
WITH p AS (SELECT tile, r, c, v AS x, v * 0.9 + c / 100 AS y, max(r) OVER (PARTITION BY tile) AS h FROM {_RASTER}), o AS (SELECT unnest(range(-3, 4)) AS o),
m AS (SELECT p.tile, p.r, p.c, avg(q.x) AS x, avg(q.y) AS y, avg(q.x * q.x) AS xx, avg(q.y * q.y) AS yy, avg(q.x * q.y) AS xy FROM p, o a, o b, p q WHERE q.tile = p.tile AND q.r = least(p.h, greatest(0, p.r + a.o)) AND q.c = least(49, greatest(0, p.c + b.o)) GROUP BY 1, 2, 3),
t AS (SELECT tile, max(x) AS top FROM p GROUP BY tile)
SELECT tile, round(avg((2 * x * y + (0.01 * top) ** 2) * (2 * (xy - x * y) + (0.03 * top) ** 2) / ((x * x + y * y + (0.01 * top) ** 2) * (xx - x * x + yy - y * y + (0.03 * top) ** 2))), 5) AS ssim FROM m JOIN t USING (tile) GROUP BY tile""")  # fmt: skip
def ssim_window(spark, d):
    from ..operators import product_ops as po

    r = _raster(spark, d).withColumn("w", F.col("v") * 0.9 + F.col("c") / 100)
    return po.ssim(r, ["tile"], "r", "c", "v", "w").withColumn("ssim", _r(F.col("ssim"), 5))


@query("peaks", "WITH p AS (SELECT event_type, quantile_cont(value, 0.99) AS q FROM events GROUP BY 1) SELECT event_id FROM events JOIN p USING (event_type) WHERE value > q")
def peaks(spark, d):
    from ..operators import product_ops as po

    return po.peaks(_table(spark, d, "events"), ["event_type"], "value").select("event_id")


@query("unmix", "SELECT l_orderkey, l_linenumber, round(l_quantity / 50, 6) AS a, round(l_discount * 10, 6) AS b FROM lineitem")
def unmix(spark, d):
    """Mixtures of two endmembers give their shares back."""
    from ..operators import product_ops as po

    ends = [[1.0, 0.5, 0.2], [0.1, 0.7, 1.0]]
    a, b = F.col("l_quantity") / 50, F.col("l_discount") * 10
    share = po.unmixed(F.array(*[a * x + b * y for x, y in zip(*ends, strict=True)]), ends)
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (_r(share[0]) + 0.0).alias("a"), (_r(share[1]) + 0.0).alias("b"))


_RESULTS = "(SELECT o_orderpriority AS grp, o_orderkey AS tile, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'partial' ELSE 'failed' END AS status, o_totalprice > 1000 AS bands_ok, o_custkey % 3 <> 0 AS meta_ok FROM orders)"


def _results(spark, d) -> DataFrame:
    s = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "partial").otherwise("failed")
    return _table(spark, d, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("tile"), s.alias("status"), (F.col("o_totalprice") > 1000).alias("bands_ok"), (F.col("o_custkey") % 3 != 0).alias("meta_ok"))


@query("validation_groups", f"SELECT grp, count(*) AS tiles, sum((status = 'success')::INT)::BIGINT AS passed, sum((status IN ('failed', 'missing'))::INT)::BIGINT AS failed, CASE WHEN sum((status IN ('failed', 'missing'))::INT) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM {_RESULTS} GROUP BY grp")
def validation_groups(spark, d):
    from ..operators import validation as va

    return va.group_summary(_results(spark, d))


@query("validation_dashboard", f"""
WITH r AS (SELECT * FROM {_RESULTS}), l AS (SELECT grp, 'bands_ok' AS check, bands_ok AS ok FROM r UNION ALL SELECT grp, 'meta_ok', meta_ok FROM r)
SELECT grp, check, sum(ok::INT)::BIGINT AS passed, sum((NOT ok)::INT)::BIGINT AS failed, round(sum(ok::INT) * 100.0 / count(*), 1)::DOUBLE AS pass_pct FROM l GROUP BY 1, 2""".replace("check", '"check"'))  # fmt: skip
def validation_dashboard(spark, d):
    from ..operators import validation as va

    return va.dashboard(_results(spark, d), ["bands_ok", "meta_ok"])


@query("validation_failures", f"SELECT grp, tile, status, array_to_string(list_filter([CASE WHEN NOT bands_ok THEN 'bands_ok' END, CASE WHEN NOT meta_ok THEN 'meta_ok' END], lambda x: x IS NOT NULL), ', ') AS issues FROM {_RESULTS} WHERE status <> 'success'")
def validation_failures(spark, d):
    from ..operators import validation as va

    return va.failure_rows(_results(spark, d), ["bands_ok", "meta_ok"])
