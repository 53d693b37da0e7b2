"""One query for all outputs of an operator family, each with SQL that computes the same from its definition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import complexes as cx
from ..functions import geo
from ..functions import packets as pk
from ..functions import products as pr
from ..operators import domain_losses as dl
from ..operators import focus as fo
from ..operators import focusing as fg
from ..operators import geometry as gm
from ..operators import grid_ops as go
from ..operators import image_stats as st
from ..operators import kernels as kn
from ..operators import neighbourhoods as nb
from ..operators import polarimetry as po
from ..operators import product_ops as ops
from ..operators import relational as rl
from ..operators import summaries as sm
from ..operators import tile_checks as tc
from .queries_signal import _RASTER, _raster
from .register import query


def _table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(x, digits: int = 6):
    return F.round(x, digits)


def _zero(x, digits: int = 6):
    """Rounded, and never a negative zero."""
    return _r(x, digits) + 0.0


# packets: 64 bytes of a hash as a header


def _hex(at: int, size: int) -> str:
    return f"('0x' || substr(h, {2 * at + 1}, {2 * size}))::BIGINT"


_F = 37.53472224e6


@query("packet_fields", f"""
WITH p AS (SELECT event_id, sha256(event_id::VARCHAR) || sha256('x' || event_id::VARCHAR) AS h FROM events)
SELECT event_id, {_hex(6, 4)} AS sync_marker, {_hex(6, 4)} = 892270675 AS sync_valid, {_hex(10, 4)} AS data_take_id, {_hex(14, 1)} AS ecc_number, ({_hex(15, 1)} >> 4) & 7 AS test_mode, {_hex(15, 1)} & 15 AS rx_channel_id,
  {_hex(16, 4)} AS instrument_config_id, {_hex(20, 1)} AS subcom_data_word_index, {_hex(21, 2)} AS subcom_data_word, {_hex(23, 4)} AS space_packet_count, {_hex(27, 4)} AS pri_count, {_hex(32, 1)} AS baq_block_length,
  {_hex(34, 1)} AS range_decimation, {_hex(43, 1)} & 31 AS rank, {_hex(56, 1)} >> 6 AS calibration_mode, {_hex(56, 1)} & 31 AS tx_pulse_number, {_hex(58, 1)} AS swath_number, {_hex(59, 2)} AS number_of_quads,
  round({_hex(40, 3)} / {_F}, 9) AS tx_pulse_length, round({_hex(47, 3)} / {_F}, 9) AS sampling_window_start_time, round({_hex(50, 3)} / {_F}, 9) AS sampling_window_length,
  round(CASE WHEN {_hex(36, 2)} >= 32768 THEN 1 ELSE -1 END * ({_hex(36, 2)} & 32767) * ({_F}::DOUBLE * {_F} / 2097152) / (4 * {_F}::DOUBLE) + CASE WHEN {_hex(38, 2)} >= 32768 THEN 1 ELSE -1 END * ({_hex(38, 2)} & 32767) * ({_F}::DOUBLE / 16384), 1) AS tx_pulse_start_frequency,
  CASE WHEN ({_hex(0, 2)} & 512) > 0 THEN -1 ELSE 1 END * ({_hex(0, 2)} & 511) AS signed10, {_hex(0, 2)} >> 13 AS version, {_hex(4, 2)} + 1 AS length
FROM p""")  # fmt: skip
def packet_fields(spark, d):
    e = F.col("event_id").cast("string")
    header = F.unhex(F.concat(F.sha2(e, 256), F.sha2(F.concat(F.lit("x"), e), 256)))
    h = _table(spark, d, "events").select("event_id", header.alias("b")).select("event_id", "b", pk.packet_header(F.col("b"), F.col("b")).alias("h"))
    plain = ["sync_marker", "data_take_id", "ecc_number", "test_mode", "rx_channel_id", "instrument_config_id", "subcom_data_word_index", "subcom_data_word", "space_packet_count", "pri_count", "baq_block_length", "range_decimation", "rank", "calibration_mode", "tx_pulse_number", "swath_number", "number_of_quads"]
    return h.select(
        "event_id", *[F.col(f"h.secondary.{c}") for c in plain], pk.valid_sync_marker(F.col("h.secondary.sync_marker")).alias("sync_valid"),
        *[_r(F.col(f"h.secondary.{c}"), 9).alias(c) for c in ("tx_pulse_length", "sampling_window_start_time", "sampling_window_length")],
        _r(F.col("h.secondary.tx_pulse_start_frequency"), 1).alias("tx_pulse_start_frequency"), pk.ten_bit_signed(pk.field(F.col("b"), 0, 2)).alias("signed10"),
        F.col("h.primary.packet_version_number").alias("version"), F.col("h.primary.packet_data_length").alias("length"),
    )


# signals: the 64 values of an embedding, by sums over frequencies

_SPECTRUM = """
x AS (SELECT vec_id, unnest(range(0, 64)) AS n, unnest(embedding)::DOUBLE AS x FROM embeddings),
f AS (SELECT vec_id, k, sum(x * cos(2 * pi() * k * n / 64)) AS re, -sum(x * sin(2 * pi() * k * n / 64)) AS im FROM x, (SELECT unnest(range(0, 64)) AS k) t GROUP BY vec_id, k),
w AS (SELECT *, tan(pi() * least(least(k, 64 - k) / 64.0, 0.5 * (1 - 1e-9))) AS u FROM f),
g AS (SELECT vec_id, k, re, im, 1 / (1 + (u / tan(pi() * 0.1)) ** 10) AS low, CASE WHEN k = 0 THEN 0 ELSE 1 / (1 + (tan(pi() * 0.1) / u) ** 10) END AS high,
        CASE WHEN k = 0 THEN 0 ELSE 1 / (1 + (u / tan(pi() * 0.3)) ** 10) / (1 + (tan(pi() * 0.1) / u) ** 10) END AS band, CASE WHEN k IN (0, 32) THEN 1 WHEN k < 32 THEN 2 ELSE 0 END AS one,
        1 / greatest(1e-6, 0.75 - 0.25 * cos(2 * pi() * ((k + 32) % 64) / 63)) AS flat FROM w)"""


def _signals(spark, d) -> DataFrame:
    return _table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def _samples(df: DataFrame, **columns) -> DataFrame:
    """(vec_id, n, a value of each array)."""
    z = F.arrays_zip(*[c.alias(k) for k, c in columns.items()])
    out = df.select("vec_id", F.posexplode(z).alias("n", "z"))
    return out.select("vec_id", F.col("n").cast("long").alias("n"), *[_zero(F.col(f"z.{k}"), 4).alias(k) for k in columns])


@query("signal_filters", f"""
WITH {_SPECTRUM},
y AS (SELECT vec_id, n, sum(low * (re * c - im * s)) / 64 AS low, sum(high * (re * c - im * s)) / 64 AS high, sum(band * (re * c - im * s)) / 64 AS band, sum(one * (re * c - im * s)) / 64 AS a, sum(one * (re * s + im * c)) / 64 AS b,
             sum(flat * (re * c - im * s)) / 64 AS dehammed, sum(re * c - im * s) / 64 AS back
      FROM (SELECT g.*, n, cos(2 * pi() * k * n / 64) AS c, sin(2 * pi() * k * n / 64) AS s FROM g, (SELECT unnest(range(0, 64)) AS n) t) z GROUP BY vec_id, n)
SELECT vec_id, n, round(low, 4) + 0.0 AS low, round(high, 4) + 0.0 AS high, round(band, 4) + 0.0 AS band, round(b, 4) + 0.0 AS hilbert, round(sqrt(a * a + b * b), 4) + 0.0 AS envelope, round(dehammed, 4) + 0.0 AS dehammed, round(back, 4) + 0.0 AS back FROM y""")  # fmt: skip
def signal_filters(spark, d):
    x, none = F.col("x"), F.transform("x", lambda v: F.lit(0.0))
    s = _signals(spark, d).withColumn("h", kn.hilbert()(x, none)).withColumn("e", kn.dehammed(0.75)(x, none)).withColumn("f", kn.fft_1d()(x, none)).withColumn("i", kn.ifft_1d()(F.col("f.re"), F.col("f.im")))
    return _samples(s, low=kn.lowpass(0.1, 1.0)(x), high=kn.highpass(0.1, 1.0)(x), band=kn.bandpass(0.1, 0.3, 1.0)(x), hilbert=F.col("h.im"), envelope=kn.envelope()(x), dehammed=F.col("e.re"), back=F.col("i.re"))


@query("signal_spectrum", f"WITH {_SPECTRUM} SELECT vec_id, k AS n, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM f")
def signal_spectrum(spark, d):
    z = _signals(spark, d).withColumn("z", kn.fft_1d()(F.col("x"), F.transform("x", lambda v: F.lit(0.0))))
    return _samples(z, re=F.col("z.re"), im=F.col("z.im"))


@query("signal_lags", """
WITH x AS (SELECT vec_id, unnest(range(0, 64)) AS n, unnest(embedding)::DOUBLE AS x FROM embeddings), l AS (SELECT unnest(range(0, 9)) AS n)
SELECT vec_id, l.n, round(sum(a.x * b.x), 4) + 0.0 AS auto, round(sum(a.x * c.x), 4) + 0.0 AS crossed
FROM x a JOIN l ON a.n >= l.n JOIN x b USING (vec_id) JOIN x c USING (vec_id) WHERE b.n = a.n - l.n AND c.n = 63 - (a.n - l.n) GROUP BY vec_id, l.n""")  # fmt: skip
def signal_lags(spark, d):
    """Lags 0 to 8 of the autocorrelation and of the correlation with the reversed signal, whose zero lag is in the middle."""
    x = F.col("x")
    crossed = kn.cross_correlated(x, F.reverse("x"), "full")
    return _samples(_signals(spark, d), auto=kn.autocorrelated(8)(x), crossed=F.slice(crossed, 64, 9))


@query("signal_shapes", """
WITH x AS (SELECT vec_id, n, x, lag(x, 1, 0) OVER (PARTITION BY vec_id ORDER BY n) AS p, lead(x, 1, 0) OVER (PARTITION BY vec_id ORDER BY n) AS q FROM (SELECT vec_id, unnest(range(0, 64)) AS n, unnest(embedding)::DOUBLE AS x FROM embeddings) t)
SELECT k.vec_id, k.n, round(x.p + 2 * x.x + x.q, 4) + 0.0 AS smooth, round(x.x * (0.5 - 0.5 * cos(2 * pi() * x.n / 63)), 4) + 0.0 AS hanning, round(x.x * (0.42 - 0.5 * cos(2 * pi() * x.n / 63) + 0.08 * cos(4 * pi() * x.n / 63)), 4) + 0.0 AS blackman,
       round(x.x * cos(2 * pi() * 0.125 * x.n), 4) + 0.0 AS shifted_re, round(x.x * sin(2 * pi() * 0.125 * x.n), 4) + 0.0 AS shifted_im, round(coalesce(y.x, 0.0), 4) + 0.0 AS padded
FROM (SELECT vec_id, unnest(range(0, 80)) AS n FROM embeddings) k LEFT JOIN x ON x.vec_id = k.vec_id AND x.n = k.n LEFT JOIN x y ON y.vec_id = k.vec_id AND y.n = k.n - 8""")  # fmt: skip
def signal_shapes(spark, d):
    x = F.col("x")
    moved = F.transform("x", lambda v, i: cx.shifted(v, F.lit(0.0), i, 0.125, 1.0))
    return _samples(_signals(spark, d), smooth=kn.convolved([1, 2, 1])(x), hanning=cx.windowed(x, "hanning"), blackman=cx.windowed(x, "blackman"), shifted_re=F.transform(moved, lambda z: z["re"]), shifted_im=F.transform(moved, lambda z: z["im"]), padded=cx.zero_padded(x, 80))


@query("signal_resampled", f"""
WITH {_SPECTRUM},
up AS (SELECT vec_id, m AS n, sum(re * cos(2 * pi() * (CASE WHEN k < 32 THEN k ELSE k - 64 END) * m / 128) - im * sin(2 * pi() * (CASE WHEN k < 32 THEN k ELSE k - 64 END) * m / 128)) / 64 AS up FROM f, (SELECT unnest(range(0, 128)) AS m) t GROUP BY vec_id, m)
SELECT vec_id, n, round(up, 4) + 0.0 AS up FROM up""")  # fmt: skip
def signal_resampled(spark, d):
    z = _signals(spark, d).withColumn("z", kn.upsampled(2)(F.col("x"), F.transform("x", lambda v: F.lit(0.0))))
    return _samples(z, up=F.col("z.re"))


@query("signal_downsampled", f"""
WITH {_SPECTRUM}
SELECT vec_id, m AS n, round(sum(low * (re * cos(2 * pi() * k * m * 4 / 64) - im * sin(2 * pi() * k * m * 4 / 64))) / 64, 4) + 0.0 AS filtered, round(any_value(p.x), 4) + 0.0 AS plain
FROM g JOIN x p USING (vec_id) JOIN (SELECT unnest(range(0, 16)) AS m) t ON p.n = 4 * m GROUP BY vec_id, m""")  # fmt: skip
def signal_downsampled(spark, d):
    x = F.col("x")
    return _samples(_signals(spark, d), filtered=kn.downsampled(4)(x), plain=kn.downsampled(4, anti_alias=False)(x))


@query("fft_2d", f"""
WITH p AS (SELECT *, max(r) OVER (PARTITION BY tile) + 1 AS h FROM {_RASTER}),
a AS (SELECT tile, r, h, k, sum(v * cos(2 * pi() * k * c / 50)) AS re, -sum(v * sin(2 * pi() * k * c / 50)) AS im FROM p, (SELECT unnest(range(0, 50)) AS k) t GROUP BY tile, r, h, k)
SELECT tile, j::INT AS r, k::INT AS c, round(sum(re * cos(2 * pi() * j * r / h) + im * sin(2 * pi() * j * r / h)), 5) + 0.0 AS re, round(sum(im * cos(2 * pi() * j * r / h) - re * sin(2 * pi() * j * r / h)), 5) + 0.0 AS im
FROM a, (SELECT unnest(range(0, 40)) AS j) t WHERE j < h GROUP BY tile, j, k""")  # fmt: skip
def fft_2d(spark, d):
    """The forward transform itself, against its double sum."""
    r = _raster(spark, d).select("tile", "r", "c", F.col("v").alias("re"), F.lit(0.0).alias("im"))
    return kn.fft_2d(r, ["tile"], "r", "c", "re", "im").select("tile", "r", "c", _zero(F.col("re"), 5).alias("re"), _zero(F.col("im"), 5).alias("im"))


@query("sublook_sums", f"""
WITH f AS (SELECT tile, r, k, sum(v * cos(2 * pi() * k * c / 50)) AS re, -sum(v * sin(2 * pi() * k * c / 50)) AS im FROM {_RASTER}, (SELECT unnest(range(0, 50)) AS k) t GROUP BY tile, r, k),
l AS (SELECT *, (k + 25) % 50 AS moved FROM f), q AS (SELECT *, CASE WHEN moved < 16 THEN 0 WHEN moved < 33 THEN 1 ELSE 2 END AS look FROM l)
SELECT tile, look, r, c::INT AS c, round(sum(re * cos(2 * pi() * k * c / 50) - im * sin(2 * pi() * k * c / 50)) / 50 * sqrt(50.0 / CASE look WHEN 0 THEN 16 ELSE 17 END), 4) + 0.0 AS re,
       round(sum(re * sin(2 * pi() * k * c / 50) + im * cos(2 * pi() * k * c / 50)) / 50 * sqrt(50.0 / CASE look WHEN 0 THEN 16 ELSE 17 END), 4) + 0.0 AS im
FROM q, (SELECT unnest(range(0, 50)) AS c) t GROUP BY tile, look, r, c""")  # fmt: skip
def sublook_sums(spark, d):
    """Three looks of each line: thirds of its centred spectrum, summed back."""
    r = _raster(spark, d).select("tile", "r", "c", F.col("v").alias("re"), F.lit(0.0).alias("im"))
    return kn.sublooks(r, ["tile"], "r", "c", "re", "im", 3).select("tile", "look", "r", "c", _zero(F.col("re"), 4).alias("re"), _zero(F.col("im"), 4).alias("im"))


@query("migration_terms", """
SELECT event_id, round(d, 9) AS factor, round(4 * pi() * x * (800000.0 * (1 / d - 1) / 299792458.0), 4) + 0.0 AS migration, round(4 * pi() / 0.0555 * (700000.0 + x) * d, 3) AS azimuth, round(299792458.0 / (x + 1e9), 9) AS wavelength, round((4 * pi() * (700000.0 + x) / 0.0555) ** 2 / 1e16, 6) AS loss
FROM (SELECT event_id, value AS x, sqrt(greatest(0.0, 1 - (value * 10 * (0.0555 / (2 * 7500.0))) ** 2)) AS d FROM events) t""")  # fmt: skip
def migration_terms(spark, d):
    x = F.col("value")
    return _table(spark, d, "events").select(
        "event_id", _r(kn.migration_factor(x * 10, 0.0555, 7500.0), 9).alias("factor"), _zero(kn.migration_phase(x, x * 10, 800000.0, 0.0555, 7500.0), 4).alias("migration"),
        _r(kn.azimuth_phase(x * 10, x + 700000.0, 0.0555, 7500.0), 3).alias("azimuth"), _r(cx.wavelength(x + 1e9), 9).alias("wavelength"), _r(cx.free_space_loss(x + 700000.0, F.lit(0.0555)) / 1e16).alias("loss"),
    )


# losses and measures of images


@query("image_losses", f"""
WITH p AS (SELECT tile, r, c, v, v * 0.9 + c / 100 AS t, v - 0.5 AS re, (r + 1) / 40 AS im FROM {_RASTER}),
g AS (SELECT *, v - t AS e, lead(v - t) OVER x - (v - t) AS ex, lead(v - t) OVER y - (v - t) AS ey, lead(re) OVER x AS rx, lead(im) OVER x AS ix, lead(re) OVER y AS ry, lead(im) OVER y AS iy
      FROM p WINDOW x AS (PARTITION BY tile, r ORDER BY c), y AS (PARTITION BY tile, c ORDER BY r)),
s AS (SELECT tile, avg(ex * ex) + avg(ey * ey) AS gradient, avg(atan2(ix * re - rx * im, rx * re + ix * im) ** 2) + avg(atan2(iy * re - ry * im, ry * re + iy * im) ** 2) AS smoothness FROM g GROUP BY tile),
m AS (SELECT p.tile, avg((p.v - q.v) ** 2) AS symmetry FROM p JOIN p q ON p.tile = q.tile AND p.r = q.r AND q.c = 49 - p.c GROUP BY p.tile),
z AS (SELECT tile, avg(t) AS mt, stddev_samp(t) AS st FROM p GROUP BY tile),
a AS (SELECT tile, avg((v - t) ** 2 * ((t - mt) / (st + 1e-8)) ** 2) AS aware FROM p JOIN z USING (tile) GROUP BY tile),
h AS (SELECT tile, least(min(v), min(t)) AS lo, greatest(max(v), max(t)) AS hi, count(*) AS n FROM p GROUP BY tile),
b AS (SELECT tile, n, b, sum(s) AS d FROM (SELECT tile, n, least(99, floor((v - lo) / (hi - lo) * 100)) AS b, 1 AS s FROM p JOIN h USING (tile) UNION ALL SELECT tile, n, least(99, floor((t - lo) / (hi - lo) * 100)), -1 FROM p JOIN h USING (tile)) u GROUP BY 1, 2, 3),
l AS (SELECT tile, sum(abs(d) / n) AS l1 FROM b GROUP BY tile),
w AS (SELECT tile, sum(v) AS sv, sum(v * r) / (sum(v) + 1e-8) AS mr, sum(v * c) / (sum(v) + 1e-8) AS mc FROM p GROUP BY tile),
k AS (SELECT tile, sum(v * (r - mr) ** 2) / (any_value(sv) + 1e-8) AS vr, sum(v * (c - mc) ** 2) / (any_value(sv) + 1e-8) AS vc, max(r) AS hr, max(c) AS hc, -sum(CASE WHEN v > 0 THEN v / sv * ln(v / sv) ELSE 0 END) / ln(count(*)) AS entropy FROM p JOIN w USING (tile) GROUP BY tile)
SELECT tile, round(gradient, 5) AS gradient, round(smoothness, 5) AS smoothness, round(symmetry, 5) AS symmetry, round(aware, 5) AS aware, round(l1, 5) AS l1, round(vr + vc, 3) AS variance, round(vr / (hr * hr) + vc / (hc * hc), 5) AS variance_normalized, round(entropy, 5) AS entropy
FROM s JOIN m USING (tile) JOIN a USING (tile) JOIN l USING (tile) JOIN k USING (tile)""")  # fmt: skip
def image_losses(spark, d):
    p = _raster(spark, d).withColumns({"t": F.col("v") * 0.9 + F.col("c") / 100, "re": F.col("v") - 0.5, "im": (F.col("r") + 1) / 40})
    k = ["tile"]
    parts = [
        fo.gradient_matching(p, k, "r", "c", "v", "t").withColumnRenamed("loss", "gradient"), fo.phase_smoothness(p, k, "r", "c", "re", "im").withColumnRenamed("loss", "smoothness"),
        fo.symmetry_loss(p, k, "r", "c", "v").withColumnRenamed("loss", "symmetry"), fo.distribution_aware_mse(p, k, "v", "t").withColumnRenamed("loss", "aware"), fo.histogram_l1(p, k, "v", "t"),
        fo.centroid_variance(p, k, "r", "c", "v"), fo.centroid_variance(p, k, "r", "c", "v", True).withColumnRenamed("variance", "variance_normalized"), p.groupBy(*k).agg(fo.normalized_entropy(F.col("v")).alias("entropy")),
    ]
    out = parts[0]
    for other in parts[1:]:
        out = out.join(other, k)
    return out.select("tile", *[_r(F.col(c), 3 if c == "variance" else 5).alias(c) for c in ("gradient", "smoothness", "symmetry", "aware", "l1", "variance", "variance_normalized", "entropy")])


@query("complex_losses", """
WITH p AS (SELECT l_returnflag AS k, l_discount - 0.04 AS pr, l_tax - 0.03 AS pi, l_discount * 0.9 AS tr, l_tax + 0.01 AS ti FROM lineitem),
q AS (SELECT *, sqrt(pr * pr + pi * pi) AS a, sqrt(tr * tr + ti * ti) AS b, atan2(pi * tr - pr * ti, pr * tr + pi * ti) AS d FROM p)
SELECT k, round(avg((pr - tr) ** 2) + avg((pi - ti) ** 2), 6) AS split, round(avg(abs(a - b)), 6) AS mag_l1, round(avg((a - b) ** 2), 6) AS mag_l2, round(avg(ln(cosh(a - b))), 6) AS log_cosh, round(avg((a - b) ** 2) + avg(d * d), 6) AS amp_phase,
  round((sum(pr * pr + pi * pi) - sum(tr * tr + ti * ti)) ** 2 / 1e6, 3) AS power, round(avg(abs(d)), 6) AS phase_l1, round(avg(d * d), 6) AS phase_l2, round(1 - sqrt(avg(cos(d)) ** 2 + avg(sin(d)) ** 2), 6) AS phase_correlation,
  round(1 - sqrt(avg(pr * tr + pi * ti) ** 2 + avg(pi * tr - pr * ti) ** 2) / (sqrt(avg(pr * pr + pi * pi) * avg(tr * tr + ti * ti)) + 1e-12), 6) AS coherence, round(avg((pr - tr) ** 2 + (pi - ti) ** 2) / 2, 6) AS speckle,
  round(avg((ln(1 + a) - ln(1 + b)) ** 2), 7) AS log1p, round(2 * (avg((pr - tr) ** 2) + avg((pi - ti) ** 2)) + 0.5 * avg(abs(a - b)), 6) AS composite,
  round(2 * (avg(a) - avg(b)) ** 2 + 2 * (stddev_pop(a) - stddev_pop(b)) ** 2 + 0.5 * ((avg(a ** 3) - 3 * avg(a) * avg(a * a) + 2 * avg(a) ** 3) / stddev_pop(a) ** 3 - (avg(b ** 3) - 3 * avg(b) * avg(b * b) + 2 * avg(b) ** 3) / stddev_pop(b) ** 3) ** 2
    + 0.5 * ((avg(a ** 4) - 4 * avg(a) * avg(a ** 3) + 6 * avg(a) ** 2 * avg(a * a) - 3 * avg(a) ** 4) / var_pop(a) ** 2 - (avg(b ** 4) - 4 * avg(b) * avg(b ** 3) + 6 * avg(b) ** 2 * avg(b * b) - 3 * avg(b) ** 4) / var_pop(b) ** 2) ** 2, 5) AS moments
FROM q GROUP BY k""")  # fmt: skip
def complex_losses(spark, d):
    p = _table(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), (F.col("l_discount") - 0.04).alias("pr"), (F.col("l_tax") - 0.03).alias("pi"), (F.col("l_discount") * 0.9).alias("tr"), (F.col("l_tax") + 0.01).alias("ti"))
    c = [F.col(x) for x in ("pr", "pi", "tr", "ti")]
    a, b = cx.magnitude(c[0], c[1]), cx.magnitude(c[2], c[3])
    return p.groupBy("k").agg(
        _r(st.loss_split_mse(*c)).alias("split"), _r(st.loss_mag_l1(*c)).alias("mag_l1"), _r(st.loss_mag_l2(*c)).alias("mag_l2"), _r(st.loss_log_cosh(*c)).alias("log_cosh"), _r(st.loss_amp_phase(*c)).alias("amp_phase"),
        _r(st.loss_power(*c) / 1e6, 3).alias("power"), _r(st.loss_phase_l1(*c)).alias("phase_l1"), _r(st.loss_phase_l2(*c)).alias("phase_l2"), _r(st.loss_phase_correlation(*c)).alias("phase_correlation"),
        _r(st.loss_coherence(*c)).alias("coherence"), _r(st.loss_speckle_nll(*c, 2.0)).alias("speckle"), _r(st.loss_log1p_mag(*c), 7).alias("log1p"),
        _r(2 * st.loss_split_mse(*c) + 0.5 * st.loss_mag_l1(*c)).alias("composite"), _r(fo.moments_loss(a, b), 5).alias("moments"),
    )


@query("window_terms", f"""
WITH p AS (SELECT tile, r, c, v AS ar, c / 50 AS ai, v * 0.9 AS br, r / 40 AS bi, max(r) OVER (PARTITION BY tile) AS h FROM {_RASTER}), o AS (SELECT unnest(range(-1, 2)) AS x),
w AS (SELECT p.tile, p.r, p.c, avg(q.ar * q.br + q.ai * q.bi) AS re, avg(q.ai * q.br - q.ar * q.bi) AS im, avg(q.ar * q.ar + q.ai * q.ai) AS pa, avg(q.br * q.br + q.bi * q.bi) AS pb
      FROM p, o a, o b, p q WHERE q.tile = p.tile AND q.r = least(p.h, greatest(0, p.r + a.x)) AND q.c = least(49, greatest(0, p.c + b.x)) GROUP BY 1, 2, 3)
SELECT tile, r, c, round(sqrt(re * re + im * im) / (sqrt(pa * pb) + 1e-8), 5) AS coherence FROM w""")  # fmt: skip
def window_terms(spark, d):
    r = _raster(spark, d).select("tile", "r", "c", F.col("v").alias("ar"), (F.col("c") / 50).alias("ai"), (F.col("v") * 0.9).alias("br"), (F.col("r") / 40).alias("bi"))
    return nb.windowed_coherence(r, ["tile"], "r", "c", 3).select("tile", "r", "c", _r(F.col("coherence"), 5).alias("coherence"))


@query("similarity_box", f"""
WITH p AS (SELECT tile, r, c, v AS x, v * 0.9 + c / 100 AS y, max(r) OVER (PARTITION BY tile) AS h FROM {_RASTER}), o AS (SELECT unnest(range(-1, 2)) AS o),
m AS (SELECT p.tile, p.r, p.c, avg(q.x) AS x, avg(q.y) AS y, avg(q.x * q.x) AS xx, avg(q.y * q.y) AS yy, avg(q.x * q.y) AS xy FROM p, o a, o b, p q
      WHERE q.tile = p.tile AND q.r = least(p.h, greatest(0, p.r + a.o)) AND q.c = least(49, greatest(0, p.c + b.o)) GROUP BY 1, 2, 3),
t AS (SELECT tile, max(x) AS top FROM p GROUP BY tile)
SELECT tile, round(avg((2 * x * y + (0.01 * top) ** 2) * (2 * (xy - x * y) + (0.03 * top) ** 2) / ((x * x + y * y + (0.01 * top) ** 2) * (xx - x * x + yy - y * y + (0.03 * top) ** 2))), 5) AS ssim FROM m JOIN t USING (tile) GROUP BY tile""")  # fmt: skip
def similarity_box(spark, d):
    r = _raster(spark, d).withColumn("w", F.col("v") * 0.9 + F.col("c") / 100)
    return ops.ssim(r, ["tile"], "r", "c", "v", "w", 3).withColumn("ssim", _r(F.col("ssim"), 5))


@query("minmax", "SELECT event_id, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6) AS scaled FROM events WINDOW w AS (PARTITION BY event_type)")
def minmax(spark, d):
    return rl.scaled(_table(spark, d, "events"), ["event_type"], "value", "scaled").select("event_id", _r(F.col("scaled")).alias("scaled"))


@query("clamped_windows", """
SELECT event_id, greatest(0, x) AS col, greatest(0, y) AS row, greatest(0, least(100, x + 40) - greatest(0, x))::BIGINT AS width, greatest(0, least(80, y + 30) - greatest(0, y))::BIGINT AS height,
       x >= 0 AND y >= 0 AND x + 40 <= 100 AND y + 30 <= 80 AS within
FROM (SELECT event_id, (event_id % 150)::BIGINT - 25 AS x, ((event_id * 7) % 120)::BIGINT - 20 AS y FROM events) t""")  # fmt: skip
def clamped_windows(spark, d):
    x, y = F.col("event_id") % 150 - 25, (F.col("event_id") * 7) % 120 - 20
    w = fo.clamped_window(x, y, F.lit(40), F.lit(30), 100, 80)
    region = F.struct(x.alias("col"), y.alias("row"), F.lit(40).alias("width"), F.lit(30).alias("height"))
    e = _table(spark, d, "events").select("event_id", w.alias("w"), geo.region_within(region, 100, 80).alias("within"))
    return e.select("event_id", *[F.col(f"w.{c}").cast("long").alias(c) for c in ("col", "row", "width", "height")], "within")


@query("patches", f"""
WITH a AS (SELECT event_id // 50 AS r, (event_id % 50)::INT AS c, value AS v FROM events), n AS (SELECT max(r) + 1 AS h FROM a),
w AS (SELECT r, c, least(64, h - r)::BIGINT AS height, least(16, 50 - c)::BIGINT AS width FROM n, (SELECT unnest(range(0, (SELECT h FROM n), 64)) AS r) x, (SELECT unnest(range(0, 50, 16)) AS c) y)
SELECT w.r::BIGINT AS row, w.c::BIGINT AS col, height, width, count(a.v) AS cells, round(avg(a.v), 6) AS mean FROM w LEFT JOIN a ON a.r // 64 * 64 = w.r AND a.c // 16 * 16 = w.c GROUP BY ALL""")
def patches(spark, d):
    """All events as one tall image in patches of 64 x 16, the last ones cut off by its edges."""
    e = F.col("event_id")
    a = _table(spark, d, "events").select(F.floor(e / 50).alias("r"), (e % 50).cast("int").alias("c"), F.col("value").alias("v"))
    height = a.agg(F.max("r") + 1).first()[0]
    windows = fo.patch_windows(spark, height, 50, (64, 16), drop_incomplete=False)
    own = a.groupBy((F.floor(F.col("r") / 64) * 64).alias("row"), (F.floor(F.col("c") / 16) * 16).alias("col")).agg(F.count("v").alias("cells"), _r(F.avg("v")).alias("mean"))
    return windows.join(own, ["row", "col"], "left").select("row", "col", "height", "width", F.coalesce("cells", F.lit(0)).alias("cells"), "mean")


# grids, rings, projection

@query("grid_moves", """
WITH p AS (SELECT event_id, (event_id % 41)::INT - 20 AS r, (event_id % 31)::INT - 15 AS c FROM events), n AS (SELECT *, abs(r) || CASE WHEN r < 0 THEN 'D' ELSE 'U' END AS row, abs(c) || CASE WHEN c < 0 THEN 'L' ELSE 'R' END AS col FROM p)
SELECT event_id, abs(r + 1) || CASE WHEN r + 1 < 0 THEN 'D' ELSE 'U' END AS up, abs(r - 1) || CASE WHEN r - 1 < 0 THEN 'D' ELSE 'U' END AS down, abs(c + 1) || CASE WHEN c + 1 < 0 THEN 'L' ELSE 'R' END AS right_, abs(c - 1) || CASE WHEN c - 1 < 0 THEN 'L' ELSE 'R' END AS left_,
       (abs(r - 1) || CASE WHEN r - 1 < 0 THEN 'D' ELSE 'U' END) || '_' || (abs(c + 1) || CASE WHEN c + 1 < 0 THEN 'L' ELSE 'R' END) AS down_right FROM n""")  # fmt: skip
def grid_moves(spark, d):
    r, c = (F.col("event_id") % 41).cast("int") - 20, (F.col("event_id") % 31).cast("int") - 15
    row = F.concat(F.abs(r).cast("string"), F.when(r < 0, "D").otherwise("U"))
    col = F.concat(F.abs(c).cast("string"), F.when(c < 0, "L").otherwise("R"))
    return _table(spark, d, "events").select("event_id", geo.move_up(row).alias("up"), geo.move_down(row).alias("down"), geo.move_right(col).alias("right_"), geo.move_left(col).alias("left_"), F.concat(geo.move_down(row), F.lit("_"), geo.move_right(col)).alias("down_right"))


@query("grid_rectangles", """
WITH p AS (SELECT DISTINCT (event_id % 97)::BIGINT AS row, ((event_id // 97) % 53)::BIGINT AS col FROM events WHERE value > 20)
SELECT a.row, a.col FROM p a WHERE EXISTS (SELECT 1 FROM p b WHERE b.row = a.row + 1 AND b.col = a.col) AND EXISTS (SELECT 1 FROM p b WHERE b.row = a.row + 1 AND b.col = a.col + 1) AND EXISTS (SELECT 1 FROM p b WHERE b.row = a.row AND b.col = a.col + 1)""")  # fmt: skip
def grid_rectangles(spark, d):
    e = _table(spark, d, "events").where("value > 20").select((F.col("event_id") % 97).alias("row"), (F.floor(F.col("event_id") / 97) % 53).alias("col"))
    return geo.rectangles(e)


@query("rings", """
WITH p AS (SELECT event_id, floor(value)::DOUBLE AS a, (event_id % 50)::DOUBLE AS b FROM events)
SELECT event_id, 'POLYGON ((' || b || ' ' || a || ', ' || (b + 1) || ' ' || a || ', ' || (b + 1) || ' ' || (a + 1) || ', ' || b || ' ' || (a + 1) || ', ' || b || ' ' || a || '))' AS wkt, b AS lon1, a AS lat1, 4 AS n_gml, a AS lat_gml, 2 AS n_pos, b + 1 AS lon_pos FROM p""")  # fmt: skip
def rings(spark, d):
    """Corners in a wrong order come out around their mean; coordinate texts of two kinds are read."""
    a, b = F.floor("value").cast("double"), (F.col("event_id") % 50).cast("double")
    at = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    e = _table(spark, d, "events").select("event_id", a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    ring = geo.ordered_ring(F.array(at(b, a), at(b + 1, a + 1), at(b + 1, a), at(b, a + 1), at(b, a)))
    pair = lambda x, y: F.concat(x.cast("string"), F.lit(","), y.cast("string"))
    gml = geo.ring_of_gml(F.concat_ws(" ", pair(a, b), pair(a, b + 1), pair(a + 1, b + 1), pair(a, b)))
    pos = geo.ring_of_pos_list(F.concat_ws(" ", a.cast("string"), b.cast("string"), a.cast("string"), (b + 1).cast("string")))
    # rings and texts are columns of their own, or each use would make them again
    e = e.select("event_id", geo.wkt_of_ring(ring).alias("wkt"), gml.alias("gml"), pos.alias("pos")).withColumn("read", geo.ring_of_wkt(F.col("wkt")))
    read, gml, pos = F.col("read"), F.col("gml"), F.col("pos")
    return e.select("event_id", "wkt", F.get(read, 0)["lon"].alias("lon1"), F.get(read, 0)["lat"].alias("lat1"), F.size(gml).alias("n_gml"), F.get(gml, 0)["lat"].alias("lat_gml"), F.size(pos).alias("n_pos"), F.get(pos, 1)["lon"].alias("lon_pos"))


@query("utm_forward", """
WITH p AS (SELECT event_id, value / 6 AS lat, (event_id % 600) / 100.0 + 6 AS lon, 1 / 298.257223563 / (2 - 1 / 298.257223563) AS n FROM events),
q AS (SELECT *, 6378137.0 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS a, n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 AS a1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 AS a2, 61 * n ** 3 / 240 AS a3, radians(lat) AS f, radians(lon - 9) AS l, 2 * sqrt(n) / (1 + n) AS e FROM p),
t AS (SELECT *, sinh(atanh(sin(f)) - e * atanh(e * sin(f))) AS t FROM q), x AS (SELECT *, atan2(t, cos(l)) AS x, atanh(sin(l) / sqrt(1 + t * t)) AS y FROM t)
SELECT event_id, round(500000 + 0.9996 * a * (y + a1 * cos(2 * x) * sinh(2 * y) + a2 * cos(4 * x) * sinh(4 * y) + a3 * cos(6 * x) * sinh(6 * y)), 3) + 0.0 AS easting,
       round(CASE WHEN lat < 0 THEN 10000000 ELSE 0 END + 0.9996 * a * (x + a1 * sin(2 * x) * cosh(2 * y) + a2 * sin(4 * x) * cosh(4 * y) + a3 * sin(6 * x) * cosh(6 * y)), 3) + 0.0 AS northing FROM x""")  # fmt: skip
def utm_forward(spark, d):
    lat, lon = F.col("value") / 6, (F.col("event_id") % 600) / 100.0 + 6
    east, north = geo.utm_forward(lat, lon, F.lit(32))
    return _table(spark, d, "events").select("event_id", _zero(east, 3).alias("easting"), _zero(north, 3).alias("northing"))


# polarimetry and classes


@query("polarimetric_matrices", """
WITH z AS (SELECT l_orderkey, l_linenumber, l_discount AS a, l_tax AS b, l_quantity / 500 AS c, l_discount - l_tax AS d, l_tax * 2 AS e, l_discount * 3 AS f FROM lineitem)
SELECT l_orderkey, l_linenumber, round(a * a + b * b, 6) AS c11, round(2 * (c * c + d * d), 6) AS c22, round(e * e + f * f, 6) AS c33, round((a * c + b * d) * sqrt(2), 6) + 0.0 AS c12_re, round((b * c - a * d) * sqrt(2), 6) + 0.0 AS c12_im, round(a * e + b * f, 6) + 0.0 AS c13_re,
  round(((a + e) ** 2 + (b + f) ** 2) / 2, 6) AS t11, round(((a - e) ** 2 + (b - f) ** 2) / 2, 6) AS t22, round(((a + e) * (a - e) + (b + f) * (b - f)) / 2, 6) + 0.0 AS t12_re, round((a + e) * c + (b + f) * d, 6) + 0.0 AS t13_re,
  round(a * a + b * b + 2 * (c * c + d * d) + e * e + f * f, 6) AS span, round(a * a + b * b + c * c + d * d, 6) AS s0, round(a * a + b * b - c * c - d * d, 6) + 0.0 AS s1, round(2 * (a * c + b * d), 6) + 0.0 AS s2, round(-2 * (b * c - a * d), 6) + 0.0 AS s3,
  round((a + d) / sqrt(2), 6) + 0.0 AS rh_re, round((c + f) / sqrt(2), 6) + 0.0 AS rv_re
FROM z""")  # fmt: skip
def polarimetric_matrices(spark, d):
    z = lambda re, im: F.struct(re.alias("re"), im.alias("im"))
    x, y, q = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 500
    hh, hv, vv = z(x, y), z(q, x - y), z(y * 2, x * 3)
    t = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", po.covariance_c3(hh, hv, vv).alias("c"), po.coherency_t3(hh, hv, vv).alias("t"), po.span(hh, hv, vv).alias("span"), po.stokes(hh, hv).alias("s"), po.compact(hh, hv, vv).alias("k"))
    names = {"c11": "c.c11", "c22": "c.c22", "c33": "c.c33", "c12_re": "c.c12.re", "c12_im": "c.c12.im", "c13_re": "c.c13.re", "t11": "t.t11", "t22": "t.t22", "t12_re": "t.t12.re", "t13_re": "t.t13.re", "span": "span", "s0": "s.s0", "s1": "s.s1", "s2": "s.s2", "s3": "s.s3", "rh_re": "k.rh.re", "rv_re": "k.rv.re"}
    return t.select("l_orderkey", "l_linenumber", *[_zero(F.col(v)).alias(k) for k, v in names.items()])


@query("class_angles", """
WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS a, l_discount * 10 AS b, l_tax * 10 AS c FROM lineitem),
g AS (SELECT l_orderkey, l_linenumber, (a + 0.2 * b + 0.1 * c) / sqrt(1 + 0.04 + 0.01) AS bare, (0.1 * a + b + 0.6 * c) / sqrt(0.01 + 1 + 0.36) AS leaf, (0.3 * a + 0.2 * b + c) / sqrt(0.09 + 0.04 + 1) AS water FROM v)
SELECT l_orderkey, l_linenumber, CASE WHEN bare >= leaf AND bare >= water THEN 'bare' WHEN leaf >= water THEN 'leaf' ELSE 'water' END AS nearest FROM g""")  # fmt: skip
def class_angles(spark, d):
    v = F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10)
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ops.nearest_class(v, {"bare": [1.0, 0.2, 0.1], "leaf": [0.1, 1.0, 0.6], "water": [0.3, 0.2, 1.0]}).alias("nearest"))


@query("change_vectors", "SELECT l_orderkey, l_linenumber, round(sqrt((l_tax - l_discount) ** 2 + (l_discount * 2 - l_tax) ** 2), 6) AS size, round(-0.0555 * l_tax / (4 * pi()), 9) + 0.0 AS displacement FROM lineitem")
def change_vectors(spark, d):
    x, y = F.col("l_discount"), F.col("l_tax")
    v = nb.change_vector(x, y, y, x * 2)
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _r(v["magnitude"]).alias("size"), _zero(nb.phase_to_displacement(y, 0.0555), 9).alias("displacement"))


@query("band_names", """
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE ['i', 'q'][(event_id % 2 + 1)::INT] END AS component, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 1 THEN NULL ELSE 'IW' || (event_id % 3 + 1) END AS swath,
       CASE WHEN event_id % 4 = 3 THEN NULL ELSE ['VV', 'VH'][(event_id % 2 + 1)::INT] END AS pol, CASE WHEN event_id % 4 = 2 THEN (event_id % 5)::INT END AS look, (event_id % 7)::BIGINT AS suffix, ['ASC', 'DESC', 'UNKNOWN', 'LEFT'][(event_id % 4 + 1)::INT] AS pass FROM events""")  # fmt: skip
def band_names(spark, d):
    e, n = F.col("event_id"), F.col("event_id") % 4
    pick = lambda *v: F.get(F.array(*[F.lit(x) for x in v]), (e % len(v)).cast("int"))
    whole = F.concat(pick("i", "q"), F.lit("_IW"), (e % 3 + 1).cast("string"), F.lit("_"), pick("VV", "VH"))
    band = F.when(n == 3, F.lit("Sigma0_VV")).when(n == 1, F.concat(pick("i", "q"), F.lit("_"), pick("VV", "VH"))).when(n == 2, F.concat(whole, F.lit("_SA"), (e % 5).cast("string"))).otherwise(whole)
    key = F.get(F.array(*[F.lit(k) for k in pr.PASS_KEYS]), (e % 5).cast("int"))
    meta = F.map_from_arrays(F.array(key, F.lit("orbit_direction")), F.array(F.when(n == 0, "ascending").when(n == 1, " Descending").when(n == 3, "left").otherwise(" "), F.lit("DESC")))
    t = _table(spark, d, "events").select("event_id", pr.band_parts(band).alias("b"), pr.numeric_suffix(F.concat(F.lit("look"), (e % 7).cast("string"))).alias("suffix"), pr.pass_direction(meta).alias("pass"))
    return t.select("event_id", "b.component", "b.swath", "b.pol", "b.look", "suffix", "pass")


# tiles: orders with their line items' flags as bands

_TILES = """
t AS (SELECT o_orderkey AS tile, o_orderkey % 11 = 0 AS bare, o_orderkey % 3 = 0 AS no_pass, o_orderkey % 5 = 0 AS blank_pass, o_custkey % 7 = 0 AS blank_note FROM orders),
b AS (SELECT l_orderkey AS tile, l_returnflag AS band, max(l_quantity)::INT - 5 AS height, CASE WHEN l_returnflag = 'N' AND count(*) > 2 THEN 11 ELSE 10 END AS width, count(*) > 1 AS has_unit, l_returnflag = 'R' AND l_orderkey % 2 = 0 AS blank_class FROM lineitem GROUP BY l_orderkey, l_returnflag)"""


def _tiles(spark, d) -> tuple[DataFrame, DataFrame]:
    k, text = F.col("o_orderkey"), lambda v: F.lit(v).cast("string")
    entries = F.array(
        F.struct(F.lit("MISSION").alias("key"), text("SAR").alias("value")), F.struct(F.lit("PRODUCT").alias("key"), text("SLC").alias("value")),
        F.when(k % 3 != 0, F.struct(F.lit("PASS").alias("key"), F.when(k % 5 == 0, " ").otherwise("ASC").alias("value"))), F.struct(F.lit("NOTE").alias("key"), F.when(F.col("o_custkey") % 7 != 0, "x").alias("value")),
    )
    tiles = _table(spark, d, "orders").select(k.alias("tile"), F.when(k % 11 != 0, F.map_from_entries(F.filter(entries, lambda e: e.isNotNull()))).alias("metadata"))
    b = _table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("tile"), F.col("l_returnflag").alias("band")).agg((F.max("l_quantity").cast("int") - 5).alias("height"), F.count("*").alias("n"))
    attrs = F.map_from_entries(F.filter(F.array(F.struct(F.lit("CLASS").alias("key"), F.when((F.col("band") == "R") & (F.col("tile") % 2 == 0), " ").otherwise("amplitude").alias("value")), F.when(F.col("n") > 1, F.struct(F.lit("unit").alias("key"), F.lit("1").alias("value")))), lambda e: e.isNotNull()))
    return tiles, b.select("tile", "band", "height", F.when((F.col("band") == "N") & (F.col("n") > 2), 11).otherwise(10).alias("width"), attrs.alias("attrs"))


@query("tile_validation", f"""
WITH {_TILES},
i AS (SELECT tile, band, height, width, NOT has_unit OR blank_class OR height <= 0 AS failing, band || ': ' || array_to_string(list_filter([CASE WHEN NOT has_unit THEN 'without unit' END, CASE WHEN blank_class THEN 'blank CLASS' END, CASE WHEN height <= 0 THEN 'shape ' || height || ' x ' || width END], lambda x: x IS NOT NULL), '; ') AS line FROM b),
g AS (SELECT tile, list_sort(list(band)) AS bands, string_agg(CASE WHEN failing THEN line END, '|' ORDER BY line) AS issues, count(DISTINCT (height, width)) AS shapes FROM i GROUP BY tile),
r AS (SELECT t.tile, array_to_string(list_filter(['A', 'R', 'X'], lambda x: NOT list_contains(coalesce(bands, []), x)), ',') AS missing_bands, array_to_string(list_filter(coalesce(bands, []), lambda x: x NOT IN ('A', 'R', 'X')), ',') AS extra_bands, coalesce(issues, '') AS issues, coalesce(shapes, 0) > 1 AS shapes_differ,
      bare AS no_metadata, CASE WHEN bare THEN '' ELSE array_to_string(list_filter([CASE WHEN blank_note THEN 'NOTE' END, CASE WHEN blank_pass AND NOT no_pass THEN 'PASS' END], lambda x: x IS NOT NULL), ',') END AS blank_metadata,
      CASE WHEN bare THEN 'MISSION,PASS' WHEN no_pass THEN 'PASS' ELSE '' END AS missing_core, CASE WHEN NOT bare AND blank_pass AND NOT no_pass THEN 'PASS' ELSE '' END AS blank_core FROM t LEFT JOIN g USING (tile))
SELECT *, missing_bands = '' AND extra_bands = '' AS bands_ok, NOT no_metadata AND blank_metadata = '' AND missing_core = '' AS metadata_ok, issues = '' AND NOT shapes_differ AS band_attrs_ok,
       CASE WHEN missing_bands = '' AND extra_bands = '' AND NOT no_metadata AND blank_metadata = '' AND missing_core = '' AND issues = '' AND NOT shapes_differ THEN 'success' ELSE 'failed' END AS status FROM r""")  # fmt: skip
def tile_validation(spark, d):
    tiles, bands = _tiles(spark, d)
    v = tc.validated_tiles(tiles, bands, ["A", "R", "X"], ("MISSION", "PASS"), ("CLASS", "unit"))
    lists = ("missing_bands", "extra_bands", "blank_metadata", "missing_core", "blank_core")
    return v.select("tile", *[F.array_join(c, ",").alias(c) for c in lists], F.array_join("band_issues", "|").alias("issues"), "shapes_differ", "no_metadata", "bands_ok", "metadata_ok", "band_attrs_ok", "status")


@query("tile_structure", """
WITH r AS (SELECT o_orderkey AS tile, CASE WHEN o_orderstatus = 'F' THEN 'success' ELSE 'partial' END AS status FROM orders), p AS (SELECT DISTINCT l_orderkey AS tile, 'array:' || l_returnflag || l_linestatus AS path FROM lineitem), a AS (SELECT DISTINCT path FROM p),
m AS (SELECT r.tile, string_agg(a.path, ',' ORDER BY a.path) AS missing FROM r CROSS JOIN a WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.tile = r.tile AND p.path = a.path) GROUP BY r.tile)
SELECT tile, coalesce(missing, '') AS missing, missing IS NULL AS structure_ok, CASE WHEN missing IS NULL THEN status ELSE 'failed' END AS status FROM r LEFT JOIN m USING (tile)""")  # fmt: skip
def tile_structure(spark, d):
    r = _table(spark, d, "orders").select(F.col("o_orderkey").alias("tile"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("partial").alias("status"))
    p = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tile"), F.lit("array").alias("kind"), F.concat("l_returnflag", "l_linestatus").alias("path")).distinct()
    return tc.structure_checked(r, p).select("tile", F.array_join("missing_paths", ",").alias("missing"), "structure_ok", "status")


@query("tile_geometry", """
WITH p AS (SELECT event_id, floor(value)::DOUBLE AS a, (event_id % 50)::DOUBLE AS b FROM events)
SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN 'POLYGON ((' || b || ' ' || a || ', ' || (b + 1) || ' ' || a || ', ' || (b + 1) || ' ' || (a - 1) || ', ' || b || ' ' || (a - 1) || ', ' || b || ' ' || a || '))' END AS ring, b + 0.5 AS centre_lon, a - 0.5 AS centre_lat,
       'POLYGON ((' || b || ' ' || a || ', ' || (b + 2) || ' ' || a || ', ' || (b + 2) || ' ' || (a - 2) || ', ' || b || ' ' || (a - 2) || ', ' || b || ' ' || a || '))' AS cell,
       CASE WHEN event_id % 3 = 0 THEN 'POINT (0 0)' WHEN event_id % 4 <> 0 THEN 'POLYGON ((' || b || ' ' || a || ', ' || (b + 1) || ' ' || a || ', ' || (b + 1) || ' ' || (a - 1) || ', ' || b || ' ' || (a - 1) || ', ' || b || ' ' || a || '))' END AS wkt,
       CASE WHEN event_id % 4 = 0 THEN 'failed' WHEN event_id % 5 = 0 THEN 'partial' ELSE 'success' END AS status FROM p""")  # fmt: skip
def tile_geometry(spark, d):
    e, a, b = F.col("event_id"), F.floor("value").cast("double"), (F.col("event_id") % 50).cast("double")
    at = {"first_near_lat": a, "first_near_long": b, "first_far_lat": a, "first_far_lon": b + 1, "last_far_lat": a - 1, "last_far_long": b + 1, "last_near_lat": F.when(e % 4 != 0, a - 1), "last_near_long": b, "centre_lat": F.lit("none"), "center_lat": a - 0.5, "center_lon": b + 0.5}
    meta = F.create_map(*[x for k, v in at.items() for x in (F.lit(k), v.cast("string"))])
    point = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    cell = F.struct(point(b, a).alias("TL"), point(b + 2, a).alias("TR"), point(b + 2, a - 2).alias("BR"), point(b, a - 2).alias("BL"))
    t = _table(spark, d, "events").select("event_id", meta.alias("m"), cell.alias("cell"))
    m = F.col("m")
    return t.select(
        "event_id", geo.wkt_of_ring(tc.tile_ring(m)).alias("ring"), tc.tile_centre(m)["lon"].alias("centre_lon"), tc.tile_centre(m)["lat"].alias("centre_lat"), geo.wkt_of_ring(tc.rectangle_ring(F.col("cell"))).alias("cell"),
        tc.product_wkt(F.when(e % 3 == 0, " POINT (0 0) ").otherwise(" "), tc.tile_ring(m)).alias("wkt"), tc.quality_status(F.lit(10), F.when(e % 4 == 0, 0).otherwise(5), F.when(e % 5 == 0, 1).otherwise(0)).alias("status"),
    )


@query("tile_database", """
SELECT o_orderkey AS "ID", CASE WHEN o_orderkey % 2 = 0 THEN 'IW1' END AS "SWATH", 'SAR' AS "MISSION", strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') AS first_line_time FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, NULL, 'SAR', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') FROM orders WHERE o_orderkey % 2 <> 0""")  # fmt: skip
def tile_database(spark, d):
    meta = F.create_map(F.lit("MISSION"), F.lit("SAR"), F.lit("first_line_time"), F.upper(F.date_format("o_orderdate", "dd-MMM-yyyy HH:mm:ss.SSSSSS")))
    o = _table(spark, d, "orders").select(F.col("o_orderkey").alias("tile"), meta.alias("metadata"))
    keys, even = ("MISSION", "first_line_time"), F.col("tile") % 2 == 0
    return tc.merged_rows(tc.core_rows(o.where(even).withColumn("swath", F.lit("IW1")), keys), tc.core_rows(o.where(~even), keys))


@query("product_variants", """
WITH p AS (SELECT event_id, ['SSC', 'MGD', 'GEC', 'EEC', NULL, 'SLC', 'GRD'][(event_id % 7 + 1)::INT] AS variant, event_id % 9 = 0 AS map, event_id % 4 AS kind FROM events)
SELECT event_id, variant, variant || '_RE' AS product_type, coalesce(variant IN ('EEC', 'GEC'), false) OR map AS geocoded, coalesce(variant IN ('SSC', 'SLC'), false) OR kind = 1 AS complex_,
       coalesce(variant IN ('MGD', 'GRD'), false) OR kind = 2 AS detected, CASE WHEN event_id % 2 = 0 THEN 'TSX-1' END AS mission FROM p""")  # fmt: skip
def product_variants(spark, d):
    e = F.col("event_id")
    kind = F.get(F.array(*[F.lit(k) for k in ("ssc_re", "MGD_RE", "gec_RE", "EEC_re", " ", "slc_RE", "grd_re")]), (e % 7).cast("int"))
    leaves = F.create_map(F.lit("productType"), kind, F.lit("projection"), F.when(e % 9 == 0, "map"), F.lit("imageDataType"), F.when(e % 4 == 1, "COMPLEX").when(e % 4 == 2, "detected"), F.lit("mission"), F.lit(""), F.lit("platform"), F.when(e % 2 == 0, "tsx-1"))
    m = _table(spark, d, "events").select("event_id", tc.terrasar_metadata(leaves).alias("m"))
    return m.select("event_id", "m.variant", "m.product_type", tc.is_geocoded(F.col("m")).alias("geocoded"), tc.is_complex(F.col("m")).alias("complex_"), tc.is_detected(F.col("m")).alias("detected"), "m.mission")


@query("looks_to_bands", """
SELECT l_orderkey, l_linenumber, n, any_value(l_quantity) AS i, max(CASE WHEN look = 1 THEN l_discount END) AS "i_SA1", max(CASE WHEN look = 2 THEN l_discount * 2 END) AS "i_SA2", max(CASE WHEN look = 1 THEN l_tax END) AS "q_SA1", max(CASE WHEN look = 2 THEN l_tax * 2 END) AS "q_SA2"
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) t, (SELECT unnest([1, 2]) AS look) k GROUP BY 1, 2, 3""")  # fmt: skip
def looks_to_bands(spark, d):
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice"))
    t = _table(spark, d, "lineitem").withColumn("n", n)
    keys = ["l_orderkey", "l_linenumber", "n"]
    looks = t.withColumn("look", F.explode(F.array(F.lit(1), F.lit(2)))).select(*keys, "look", (F.col("l_discount") * F.col("look")).alias("i"), (F.col("l_tax") * F.col("look")).alias("q"))
    return ops.merge_iq(t.select(*keys, F.col("l_quantity").alias("i")), looks, keys)


# spectra of rasters: each row a frequency


@query("spectral_support", f"""
WITH p AS (SELECT tile, r, avg(v * v + (c / 50) * (c / 50)) * CASE WHEN r % 40 BETWEEN 10 AND 27 THEN 1 ELSE 1e-4 END AS power FROM {_RASTER} GROUP BY tile, r),
s AS (SELECT tile, r, sum(power) OVER (PARTITION BY tile ORDER BY r ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS power FROM p),
t AS (SELECT tile, max(power) AS top, arg_max(r, power) AS peak, max(r) + 1 AS n FROM s GROUP BY tile),
b AS (SELECT s.tile, power < top * 10 ** (-2.5) AS weak, (r + n // 2 - peak + n) % n AS k, n // 2 AS mid, n, peak FROM s JOIN t USING (tile)),
e AS (SELECT tile, any_value(n) AS n, any_value(mid) AS mid, any_value(peak) AS peak, coalesce(max(CASE WHEN weak AND k < mid THEN k END) + 1, 0) AS lo, coalesce(min(CASE WHEN weak AND k > mid THEN k END) - 1, any_value(n) - 1) AS hi FROM b GROUP BY tile),
z AS (SELECT *, greatest(2, round_even(0.15 * n, 0)::INT) AS z0 FROM e),
w AS (SELECT *, hi - lo + 1 < z0 + z0 % 2 AS narrow, greatest(0, mid - (z0 + z0 % 2) // 2) AS nl, z0 + z0 % 2 AS zz FROM z),
x AS (SELECT tile, n, mid, peak, CASE WHEN narrow THEN nl ELSE lo END AS lo, CASE WHEN narrow THEN least(n - 1, nl + zz - 1) ELSE hi END AS hi FROM w),
m AS (SELECT tile, arg_max(r, power) AS centre FROM s WHERE r >= 4 AND r < 36 GROUP BY tile)
SELECT tile, (CASE WHEN (hi - lo) % 2 = 0 AND hi >= n - 1 AND lo > 0 THEN lo - 1 ELSE lo END)::INT AS start, (CASE WHEN (hi - lo) % 2 = 0 AND hi < n - 1 THEN hi + 1 ELSE hi END + 1)::INT AS stop, peak, (mid - peak)::INT AS shift, centre FROM x JOIN m USING (tile)""")  # fmt: skip
def spectral_support(spark, d):
    r = _raster(spark, d).select("tile", "r", F.col("v").alias("re"), (F.col("c") / 50).alias("im"))
    p = fg.spectral_profile(r, ["tile"], "r", "re", "im").withColumn("power", F.col("power") * F.when((F.col("r") % 40).between(10, 27), 1.0).otherwise(1e-4))
    p = fg.smoothed_profile(p, ["tile"], "r", 2)
    return fg.spectral_support(p, ["tile"], "r").join(fg.central_bin(p, ["tile"], "r", 40), "tile")


@query("image_passes", f"""
WITH p AS (SELECT *, max(r) OVER (PARTITION BY tile) + 1 AS h FROM {_RASTER}),
x AS (SELECT tile, r, k, sum(v * cos(2 * pi() * k * c / 50)) AS re FROM p, (SELECT unnest(range(0, 50)) AS k) t GROUP BY tile, r, k),
y AS (SELECT tile, j, c, sum(v * cos(2 * pi() * j * r / h)) AS re FROM p, (SELECT unnest(range(0, 40)) AS j) t WHERE j < h GROUP BY tile, j, c)
SELECT x.tile, x.r::INT AS r, x.k::INT AS c, round(x.re, 5) + 0.0 AS along_range, round(y.re, 5) + 0.0 AS along_azimuth FROM x JOIN y ON y.tile = x.tile AND y.j = x.r AND y.c = x.k""")  # fmt: skip
def image_passes(spark, d):
    r = _raster(spark, d).select("tile", "r", "c", F.col("v").alias("re"), F.lit(0.0).alias("im"))
    a, b = fg.range_pass(r, ["tile"], "r", "c", "re", "im"), fg.azimuth_pass(r, ["tile"], "r", "c", "re", "im")
    return a.select("tile", "r", "c", _zero(F.col("re"), 5).alias("along_range")).join(b.select("tile", "r", "c", _zero(F.col("re"), 5).alias("along_azimuth")), ["tile", "r", "c"])


@query("image_margins", f"""
WITH m AS (SELECT tile, max(r) + 1 AS h FROM {_RASTER} GROUP BY tile), g AS (SELECT tile, a.r, b.c FROM m, (SELECT unnest(range(0, 45)) AS r) a, (SELECT unnest(range(0, 57)) AS c) b WHERE a.r < 45)
SELECT g.tile, g.r::INT AS r, g.c::INT AS c, round(coalesce(p.v, 0.0), 6) AS re, g.r >= 2 AND g.r < 42 AND g.c >= 3 AND g.c < 53 AS inside FROM g LEFT JOIN {_RASTER} p ON p.tile = g.tile AND p.r = g.r - 2 AND p.c = g.c - 3
WHERE p.v IS NOT NULL OR NOT (g.r >= 2 AND g.r < 42 AND g.c >= 3 AND g.c < 53)""")  # fmt: skip
def image_margins(spark, d):
    """Zeros around an image; what trimming takes away again is not inside."""
    r = _raster(spark, d).select("tile", "r", "c", F.col("v").alias("re"), F.lit(0.0).alias("im"))
    p = fg.padded(r, ["tile"], "r", "c", "re", "im", 40, 50, left=3, right=4, top=2, bottom=3)
    kept = fg.trimmed(p, "r", "c", 45, 57, left=3, right=4, top=2, bottom=3).select("tile", (F.col("r") + 2).alias("r"), (F.col("c") + 3).alias("c"), F.lit(True).alias("inside"))
    return p.join(kept, ["tile", "r", "c"], "left").select("tile", "r", "c", _r(F.col("re")).alias("re"), F.coalesce("inside", F.lit(False)).alias("inside"))


@query("convolution_2d", f"""
WITH k(i, j, w) AS (VALUES (-1, -1, 0.5), (-1, 0, 1.0), (-1, 1, -1.0), (0, -1, 2.0), (0, 0, 3.0), (0, 1, 0.25), (1, -1, 0.0), (1, 0, -2.0), (1, 1, 1.5))
SELECT p.tile, p.r, p.c, round(sum(q.v * w), 6) + 0.0 AS v FROM {_RASTER} p, k, {_RASTER} q WHERE q.tile = p.tile AND q.r = p.r - k.i AND q.c = p.c - k.j GROUP BY 1, 2, 3""")  # fmt: skip
def convolution_2d(spark, d):
    return fg.convolved_2d(_raster(spark, d), ["tile"], "r", "c", "v", [[0.5, 1.0, -1.0], [2.0, 3.0, 0.25], [0.0, -2.0, 1.5]]).select("tile", "r", "c", _zero(F.col("v")).alias("v"))


@query("bins_and_looks", """
SELECT event_id, round(CASE WHEN k < 32 THEN k ELSE k - 63 END * 100.0 / 63, 6) AS hz, (k + 31) % 63 AS centred, ((k - 20 + 31) % 63 + 63) % 63 AS rolled, CASE WHEN k >= 8 AND k < 56 THEN (k - 8) * 3 // 48 END::INT AS look FROM (SELECT event_id, event_id % 63 AS k FROM events) t""")  # fmt: skip
def bins_and_looks(spark, d):
    e = _table(spark, d, "events").select("event_id", (F.col("event_id") % 63).alias("k")).withColumn("rolled", F.col("k"))
    k = F.col("k")
    return fg.rolled_to(e, "rolled", 63, F.lit(20)).select("event_id", _r(fg.frequency(k, 63, 100.0)).alias("hz"), fg.centred_bin(k, 63).alias("centred"), "rolled", fg.look_of_bin(k, F.lit(8), F.lit(56), 3).alias("look"))


# losses of edges, structure, distributions and features


@query("edge_and_lines", f"""
WITH p AS (SELECT tile, r, c, v, v * 0.8 + c / 100 AS t FROM {_RASTER}),
e AS (SELECT tile, abs(lead(v - t) OVER x - (v - t)) AS ex, abs(lead(v - t) OVER y - (v - t)) AS ey FROM p WINDOW x AS (PARTITION BY tile, r ORDER BY c), y AS (PARTITION BY tile, c ORDER BY r)),
g AS (SELECT k, exp(-((k - 2) ** 2) / (2 * 6.25)) AS g FROM (SELECT unnest(range(0, 5)) AS k) t), w AS (SELECT k, g / (SELECT sum(g) FROM g) AS g FROM g),
m AS (SELECT p.tile, p.r, p.c, sum(g * coalesce(q.v, 0)) AS x, sum(g * coalesce(q.t, 0)) AS y, sum(g * coalesce(q.v * q.v, 0)) AS xx, sum(g * coalesce(q.t * q.t, 0)) AS yy, sum(g * coalesce(q.v * q.t, 0)) AS xy
      FROM p CROSS JOIN w LEFT JOIN p q ON q.tile = p.tile AND q.r = p.r AND q.c = p.c - (w.k - 2) GROUP BY 1, 2, 3),
s AS (SELECT tile, least(1, greatest(0, (2 * x * y + 0.0001) * (2 * (xy - x * y) + 0.0009) / ((x * x + y * y + 0.0001) * (greatest(0, xx - x * x) + greatest(0, yy - y * y) + 0.0009) + 1e-6))) AS s, r FROM m),
l AS (SELECT tile, avg(loss) AS similarity FROM (SELECT tile, r, 1 - avg(s) AS loss FROM s GROUP BY tile, r) u GROUP BY tile)
SELECT tile, round(avg(ex) + avg(ey), 6) AS edges, round(any_value(similarity), 5) AS similarity FROM e JOIN l USING (tile) GROUP BY tile""")  # fmt: skip
def edge_and_lines(spark, d):
    p = _raster(spark, d).withColumn("t", F.col("v") * 0.8 + F.col("c") / 100)
    lines = dl.line_similarity_loss(p, ["tile", "r"], "c", "v", "t", 5).groupBy("tile").agg(F.avg("loss").alias("similarity"))
    return dl.edge_loss(p, ["tile"], "r", "c", "v", "t").join(lines, "tile").select("tile", _r(F.col("loss")).alias("edges"), _r(F.col("similarity"), 5).alias("similarity"))


@query("distribution_losses", f"""
WITH p AS (SELECT tile, v AS p, v * 0.8 + c / 100 AS t FROM {_RASTER}), e AS (SELECT tile, least(0, min(p), min(t)) AS lo, greatest(max(p), max(t)) AS hi, least(min(p), min(t)) AS low, count(*) AS n FROM p GROUP BY tile),
h AS (SELECT tile, n, least(63, floor((x - lo) / (hi - lo) * 64)) AS b, sum(s) AS d FROM (SELECT tile, p AS x, 1 AS s FROM p UNION ALL SELECT tile, t, -1 FROM p) u JOIN e USING (tile) GROUP BY 1, 2, 3),
b AS (SELECT tile, n, low + (least(31, floor((x - low) / (hi - low) * 32)) + 0.5) * (hi - low) / 32 AS a, sum(s) AS np, sum(1 - s) AS nt FROM (SELECT tile, p AS x, 1 AS s FROM p UNION ALL SELECT tile, t, 0 FROM p) u JOIN e USING (tile) GROUP BY 1, 2, 3),
k AS (SELECT x.tile, any_value(x.n) AS n, sum(x.np * y.np * exp(-((x.a - y.a) ** 2) / 2)) AS pp, sum(x.nt * y.nt * exp(-((x.a - y.a) ** 2) / 2)) AS tt, sum(x.np * y.nt * exp(-((x.a - y.a) ** 2) / 2)) AS pt FROM b x JOIN b y ON x.tile = y.tile GROUP BY x.tile)
SELECT tile, round(matched, 7) AS matched, round((pp - n) / (n * (n - 1)) + (tt - n) / (n * (n - 1)) - 2 * pt / (n * n), 6) AS discrepancy FROM k JOIN (SELECT tile, sum((d / (n + 1e-8)) ** 2) AS matched FROM h GROUP BY tile) m USING (tile)""")  # fmt: skip
def distribution_losses(spark, d):
    p = _raster(spark, d).withColumn("t", F.col("v") * 0.8 + F.col("c") / 100)
    a, b = dl.histogram_matching(p, ["tile"], "v", "t"), dl.mean_discrepancy(p, ["tile"], "v", "t", 1.0, 32)
    return a.select("tile", _r(F.col("loss"), 7).alias("matched")).join(b.select("tile", _r(F.col("loss")).alias("discrepancy")), "tile")


@query("channel_losses", """
WITH p AS (SELECT l_returnflag AS k, l_discount - 0.04 AS pr, l_tax - 0.03 AS pi, l_discount * 0.9 AS tr, l_tax + 0.01 AS ti, l_quantity / 10 - 2 AS s FROM lineitem), q AS (SELECT *, sqrt((pr - tr) ** 2 + (pi - ti) ** 2) AS d FROM p)
SELECT k, round(avg(ln(cosh(d))), 7) AS robust, round(avg(d ** 4) * 1000, 7) AS quartic, round(avg(d * d) + avg(4 * pi * pi), 7) AS constrained, round(avg(d * d) + avg((pi - ti) ** 2 + (pr - tr) ** 2), 7) AS channels,
       round(avg(ln(1 + exp(-abs(s))) + greatest(s, 0) - s), 6) AS generator, round((avg(ln(1 + exp(-abs(s))) + greatest(s, 0) - s) + avg(ln(1 + exp(-abs(s))) + greatest(s, 0))) / 2, 6) AS discriminator, round(avg(((pr - tr) ** 2 + (pi - ti) ** 2) / 2), 7) AS feature FROM q GROUP BY k""")  # fmt: skip
def channel_losses(spark, d):
    p = _table(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), (F.col("l_discount") - 0.04).alias("pr"), (F.col("l_tax") - 0.03).alias("pi"), (F.col("l_discount") * 0.9).alias("tr"), (F.col("l_tax") + 0.01).alias("ti"), (F.col("l_quantity") / 10 - 2).alias("s"))
    c = [F.col(x) for x in ("pr", "pi", "tr", "ti")]
    s = F.col("s")
    return p.groupBy("k").agg(
        _r(dl.robust_loss(*c), 7).alias("robust"), _r(dl.robust_loss(*c, "quartic") * 1000, 7).alias("quartic"), _r(dl.symmetry_constrained(*c), 7).alias("constrained"), _r(dl.channels_loss([tuple(c), (c[1], c[0], c[3], c[2])]), 7).alias("channels"),
        _r(dl.generator_loss(s)).alias("generator"), _r(dl.discriminator_loss(s, s)).alias("discriminator"), _r(dl.feature_loss(F.array("pr", "pi"), F.array("tr", "ti")), 7).alias("feature"),
    )


# summaries of configurations


def _summary(spark, d) -> DataFrame:
    o = _table(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "coherence").when(F.col("o_orderstatus") == "O", "covariance").otherwise("other")
    v = F.col("o_totalprice")
    return o.select(kind.alias("kind"), F.substring("o_orderpriority", 1, 1).alias("pol"), F.concat(F.lit("L"), (F.col("o_custkey") % 4 + 1).cast("string")).alias("lookset"), F.when(F.col("o_custkey") % 9 != 0, F.concat(F.lit("W"), (F.col("o_custkey") % 3).cast("string"))).otherwise("none").alias("window"),
                    (F.col("o_orderkey") % 6).alias("selected_bands"), (v / 1e6).alias("mean_nmi"), (1 - v / 1e6).alias("complementarity_1_minus_mean_nmi"), F.when(F.col("o_custkey") % 8 != 0, v / 1000).alias("coherence_median_cv"), (v / 500).alias("covariance_diag_median_cv"))


_SUMMARY = """
s AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'coherence' WHEN 'O' THEN 'covariance' ELSE 'other' END AS kind, substr(o_orderpriority, 1, 1) AS pol, (o_custkey % 4 + 1)::INT AS l, CASE WHEN o_custkey % 9 <> 0 THEN (o_custkey % 3)::INT END AS w, o_orderkey % 6 AS selected_bands, 1 - o_totalprice / 1e6 AS comp,
      CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_custkey % 8 <> 0 THEN o_totalprice / 1000 END WHEN 'O' THEN o_totalprice / 500 END AS vary FROM orders),
m AS (SELECT *, (comp - min(comp) OVER g) / (max(comp) OVER g - min(comp) OVER g) AS cn, 1 - (vary - min(vary) OVER g) / (max(vary) OVER g - min(vary) OVER g) AS iv FROM s WHERE w IS NOT NULL AND l > 1 AND vary IS NOT NULL WINDOW g AS (PARTITION BY kind, pol))"""


@query("configuration_means", f"""
WITH {_SUMMARY}
SELECT kind, l, w, 'L' || l AS lookset, 'W' || w AS "window", round(avg(comp), 6) AS complementarity, round(avg(vary), 4) AS variability, round(avg(cn), 6) AS comp_norm, round(avg(iv), 6) AS inv_var_norm, round(avg(0.6 * cn + 0.4 * iv), 6) AS score, round(avg(selected_bands), 6) AS selected_bands, count(DISTINCT pol) AS n_pols, count(*) AS n_scores
FROM m GROUP BY kind, l, w""")  # fmt: skip
def configuration_means(spark, d):
    k = sm.kind_means(sm.metrics(sm.known_settings(_summary(spark, d), 1), 0.6, 0.4))
    return k.select("kind", "l", "w", "lookset", "window", _r(F.col("complementarity")).alias("complementarity"), _r(F.col("variability"), 4).alias("variability"), *[_r(F.col(c)).alias(c) for c in ("comp_norm", "inv_var_norm", "score", "selected_bands")], "n_pols", "n_scores")


@query("feature_paths", """
SELECT event_id, ['coherence', 'covariance', 'other'][(event_id % 3 + 1)::INT] AS kind, 'IW' || (event_id % 3 + 1) AS swath, 'L' || (event_id % 5) AS lookset, CASE WHEN event_id % 2 = 0 THEN 'W' || (event_id % 7) END AS "window", 'p' || event_id AS product, ['VV', 'VH'][(event_id % 2 + 1)::INT] AS pol,
       ['cov_diag', 'cov_diag', 'cov_cross', 'cov_cross', 'other', 'other'][(event_id % 6 + 1)::INT] AS band_group FROM events""")  # fmt: skip
def feature_paths(spark, d):
    e = F.col("event_id")
    pick = lambda *v: F.get(F.array(*[F.lit(x) for x in v]), (e % len(v)).cast("int"))
    n = lambda k: (e % k).cast("string")
    path = F.concat(F.lit("/d/IW9/L9/IW"), (e % 3 + 1).cast("string"), F.lit("/L"), n(5), F.when(e % 2 == 0, F.concat(F.lit("_W"), n(7))).otherwise(""), F.lit("/p"), e.cast("string"), F.lit("_TC.data/"), pick("coh_", "cov_", "x_"), pick("VV", "VH"), F.lit(".tif"))
    t = _table(spark, d, "events").select("event_id", path.alias("path"), sm.band_group(pick("C11", "C12", "ReC12", "ImC13", "lat", "q_C12")).alias("band_group"))
    return t.select("event_id", sm.feature_kind(F.col("path")).alias("kind"), sm.path_settings(F.col("path")).alias("s"), "band_group").select("event_id", "kind", "s.*", "band_group")


@query("known_values", "SELECT event_type, round(avg(v), 6) AS mean, round(median(v), 6) AS median, count(*) AS n FROM (SELECT event_type, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events) t GROUP BY event_type")
def known_values(spark, d):
    v = F.when(F.col("event_id") % 3 != 0, F.col("value")).otherwise(F.lit(float("nan")))
    return _table(spark, d, "events").withColumn("v", v).groupBy("event_type").agg(_r(sm.known_mean(F.col("v"))).alias("mean"), _r(sm.known_median(F.col("v"))).alias("median"), F.count("*").alias("n"))


@query("ring_areas", """
SELECT event_id, round(abs(radians(w) * (sin(radians(a + h)) - sin(radians(a)))) * 6371.0088 * 6371.0088, 3) AS km2 FROM (SELECT event_id, value / 10 AS a, 1 + event_id % 5 AS w, 0.5 + event_id % 3 AS h FROM events) t""")  # fmt: skip
def ring_areas(spark, d):
    """Boxes of parallels and meridians, whose area on the sphere is known; in the wrong order it's the same."""
    e, a = F.col("event_id"), F.col("value") / 10
    w, h = 1 + e % 5, 0.5 + e % 3
    p = lambda x, y: F.struct((x * 1.0).alias("lon"), y.alias("lat"))
    ring = F.array(p(e % 50, a), p(e % 50 + w, a), p(e % 50 + w, a + h), p(e % 50, a + h))
    return _table(spark, d, "events").select("event_id", _r(sm.ring_area_km2(F.when(e % 2 == 0, ring).otherwise(F.reverse(ring))), 3).alias("km2"))


@query("look_features", """
WITH z AS (SELECT l_orderkey AS k, l_discount + 0.01 AS re, l_tax AS im, sqrt((l_discount + 0.01) ** 2 + l_tax ** 2) AS m FROM lineitem)
SELECT k, count(*)::INT AS looks, round(avg(m * m), 7) AS power, round(1 - sqrt(avg(re / m) ** 2 + avg(im / m) ** 2), 6) AS phase_variance FROM z GROUP BY k""")  # fmt: skip
def look_features(spark, d):
    z = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("look"), (F.col("l_discount") + 0.01).alias("re"), F.col("l_tax").alias("im"))
    f = sm.phase_features(z, ["k"], "look", "re", "im")
    return f.select("k", "looks", _r(F.col("power"), 7).alias("power"), _r(F.col("phase_variance")).alias("phase_variance"))


# other grids: the first tile of the raster, which every size of data has


@query("warped_image", f"""
WITH p AS (SELECT r, c, v FROM {_RASTER} WHERE tile = 0), g AS (SELECT i AS r, j AS c, i * 0.7 + 0.21 AS y, j * 0.6 - 0.33 AS x FROM (SELECT unnest(range(0, 20)) AS i) a, (SELECT unnest(range(0, 70)) AS j) b),
k AS (SELECT g.r, g.c, floor(y) + i AS pr, floor(x) + j AS pc, CASE i WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END * CASE j WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END AS w FROM g, (SELECT unnest([0, 1]) AS i) m, (SELECT unnest([0, 1]) AS j) n),
l AS (SELECT k.r, k.c, CASE WHEN count(p.v) = count(*) THEN sum(w * p.v) END AS v FROM k LEFT JOIN p ON p.r = pr AND p.c = pc WHERE w > 0 GROUP BY 1, 2)
SELECT g.r::INT AS r, g.c::INT AS c, round(l.v, 9) AS bilinear, round(q.v, 6) AS nearest FROM g JOIN l ON l.r = g.r AND l.c = g.c LEFT JOIN p q ON q.r = floor(y + 0.5) AND q.c = floor(x + 0.5)""")  # fmt: skip
def warped_image(spark, d):
    p = _raster(spark, d).where("tile = 0").select("r", "c", "v")
    y, x = F.col("r") * 0.7 + 0.21, F.col("c") * 0.6 - 0.33
    a, b = (gm.warped(p, "r", "c", "v", 20, 70, y, x, m).withColumn("v", _r(F.col("v"), 9)) for m in ("bilinear", "nearest"))
    return a.withColumnRenamed("v", "bilinear").join(b.withColumnRenamed("v", "nearest"), ["r", "c"])


@query("filled_heights", f"""
WITH p AS (SELECT tile, r, c, CASE WHEN (r * 7 + c) % 5 <> 0 THEN v END AS v, max(r) OVER (PARTITION BY tile) AS h FROM {_RASTER}), o AS (SELECT unnest(range(-1, 2)) AS o),
m AS (SELECT p.tile, p.r, p.c, any_value(p.v) AS v, avg(q.v) AS m FROM p, o a, o b, p q WHERE q.tile = p.tile AND q.r = least(p.h, greatest(0, p.r + a.o)) AND q.c = least(49, greatest(0, p.c + b.o)) GROUP BY 1, 2, 3)
SELECT tile, r, c, round(coalesce(v, m), 9) AS v FROM m""")  # fmt: skip
def filled_heights(spark, d):
    p = _raster(spark, d).select("tile", "r", "c", F.when((F.col("r") * 7 + F.col("c")) % 5 != 0, F.col("v")).alias("v"))
    return gm.filled_holes(p, ["tile"], "r", "c", "v").withColumn("v", _r(F.col("v"), 9))


@query("window_statistics", f"""
WITH p AS (SELECT tile, r, c, v, max(r) OVER (PARTITION BY tile) AS h FROM {_RASTER}), o AS (SELECT unnest(range(-1, 2)) AS o),
m AS (SELECT p.tile, p.r, p.c, avg(q.v) AS m, avg(q.v * q.v) AS q, avg(q.v * q.c) AS vc FROM p, o a, o b, p q WHERE q.tile = p.tile AND q.r = least(p.h, greatest(0, p.r + a.o)) AND q.c = least(49, greatest(0, p.c + b.o)) GROUP BY 1, 2, 3)
SELECT tile, r, c, round(((q - m * m) / (m * m) - 0.25) / 1.25, 5) AS divergence, round(m, 6) AS c11, round(vc, 6) AS c12 FROM m""")  # fmt: skip
def window_statistics(spark, d):
    p = _raster(spark, d).select("tile", "r", "c", "v", F.col("v").alias("c11"), (F.col("v") * F.col("c")).alias("c12"))
    a, b = gm.speckle_divergence(p, ["tile"], "r", "c", "v", 3, 4.0), gm.averaged_matrix(p, ["tile"], "r", "c", ["c11", "c12"], 3)
    return a.join(b, ["tile", "r", "c"]).select("tile", "r", "c", _r(F.col("divergence"), 5).alias("divergence"), _r(F.col("c11")).alias("c11"), _r(F.col("c12")).alias("c12"))


@query("relief", f"""
WITH g AS (SELECT tile, r, c, v, (lead(v) OVER (PARTITION BY tile, c ORDER BY r) - lag(v) OVER (PARTITION BY tile, c ORDER BY r)) / 20 AS gy, (lead(v) OVER (PARTITION BY tile, r ORDER BY c) - lag(v) OVER (PARTITION BY tile, r ORDER BY c)) / 20 AS gx FROM {_RASTER})
SELECT tile, r, c, v >= 0.3 AND coalesce(degrees(atan(sqrt(gx * gx + gy * gy))), 0) >= 0.2 AS masked FROM g""")  # fmt: skip
def relief(spark, d):
    return gm.terrain_mask(_raster(spark, d), ["tile"], "r", "c", "v", 10.0, 0.3, 0.2).select("tile", "r", "c", "masked")


@query("phase_models", """
SELECT l_orderkey, l_linenumber, round(a * cos(p) - b * sin(p), 6) + 0.0 AS re, round(a * sin(p) + b * cos(p), 6) + 0.0 AS im, round(-b * 0.0555 * (800000 + a) * sin(radians(35.0)) / (4 * pi() * 120), 6) + 0.0 AS height
FROM (SELECT l_orderkey, l_linenumber, l_discount AS a, l_tax AS b, -2 * pi() * 3 * (l_quantity / 100) - pi() * 5 * (l_quantity / 100 - 0.2) ** 2 AS p FROM lineitem) t""")  # fmt: skip
def phase_models(spark, d):
    z = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("re"), F.col("l_tax").alias("im"), (F.col("l_quantity") / 100).alias("t"), gm.phase_to_height(F.col("l_tax"), 0.0555, 800000 + F.col("l_discount"), F.lit(35.0), 120.0).alias("height"))
    z = gm.deramped(gm.demodulated(z, "re", "im", F.col("t"), 3.0), "re", "im", F.col("t"), 5.0, 0.2)
    return z.select("l_orderkey", "l_linenumber", _zero(F.col("re")).alias("re"), _zero(F.col("im")).alias("im"), _zero(F.col("height")).alias("height"))


@query("band_limited", f"""
WITH f AS (SELECT tile, r, k, CASE WHEN k < 25 THEN k ELSE k - 50 END / 50.0 AS hz, sum(v * cos(2 * pi() * k * c / 50)) AS re, -sum(v * sin(2 * pi() * k * c / 50)) AS im FROM {_RASTER}, (SELECT unnest(range(0, 50)) AS k) t GROUP BY tile, r, k),
g AS (SELECT *, 0.75 - 0.25 * cos(2 * pi() * (hz + 0.105) / 0.31) AS w FROM f WHERE hz >= -0.105 AND hz <= 0.205)
SELECT tile, r, c::INT AS c, round(sum(w * (re * cos(2 * pi() * k * c / 50) - im * sin(2 * pi() * k * c / 50))) / 50, 5) + 0.0 AS re, round(sum(w * (re * sin(2 * pi() * k * c / 50) + im * cos(2 * pi() * k * c / 50))) / 50, 5) + 0.0 AS im FROM g, (SELECT unnest(range(0, 50)) AS c) t GROUP BY tile, r, c""")  # fmt: skip
def band_limited(spark, d):
    r = _raster(spark, d).select("tile", "r", "c", F.col("v").alias("re"), F.lit(0.0).alias("im"))
    return gm.band_limited(r, ["tile"], "r", "c", "re", "im", -0.105, 0.205, 1.0, 0.75).select("tile", "r", "c", _zero(F.col("re"), 5).alias("re"), _zero(F.col("im"), 5).alias("im"))


# cells and pairs


@query("footprint_cells", """
WITH p AS (SELECT event_id % 4000 AS id, 'c' || (event_id % 4000) AS name, ((event_id * 37) % 120 - 40)::DOUBLE AS lon, ((event_id * 53) % 80 - 30)::DOUBLE AS lat, event_id % 13 = 0 AS bare FROM events), d AS (SELECT name, lon, lat, row_number() OVER (PARTITION BY name ORDER BY lat, lon) AS n FROM p WHERE NOT bare AND lon + 1 >= 0 AND lat + 1 >= 0 AND lon <= 40 AND lat <= 40 AND lon + lat <= 40)
SELECT name, lon, lat FROM d WHERE n = 1""")  # fmt: skip
def footprint_cells(spark, d):
    """Boxes of one degree that meet the triangle (0, 0), (40, 0), (0, 40), edges included."""
    e = F.col("event_id")
    p = _table(spark, d, "events").select(F.concat(F.lit("c"), (e % 4000).cast("string")).alias("name"), F.when(e % 13 != 0, 32632).alias("epsg"), ((e * 37) % 120 - 40).cast("double").alias("lon"), ((e * 53) % 80 - 30).cast("double").alias("lat"))
    p = p.withColumns({"lon1": F.col("lon") + 1, "lat1": F.col("lat") + 1})
    return go.cells_on(p, [(0.0, 0.0), (40.0, 0.0), (0.0, 40.0)]).select("name", "lon", "lat")


@query("cell_places", """
WITH p AS (SELECT event_id, (event_id % 1001)::INT - 500 AS r, (event_id % 701)::INT - 350 AS c, ceil(pi() * 6378.137 / 10) AS n FROM events), q AS (SELECT *, r * (180.0 / n) AS lat FROM p), k AS (SELECT *, 2 * pi() * 6378.137 * cos(radians(lat)) AS km FROM q)
SELECT event_id, round(lat, 9) AS lat, round(c * (360.0 / ceil(km / 10)), 9) AS lon, round(km, 6) AS km, (event_id % 360) - 180 >= 170 OR (event_id % 360) - 180 <= -165 AS over_date_line FROM k""")  # fmt: skip
def cell_places(spark, d):
    e = F.col("event_id")
    p = go.place_of((e % 1001).cast("int") - 500, (e % 701).cast("int") - 350, 10.0)
    t = _table(spark, d, "events").select("event_id", p.alias("p"), (e % 360 - 180).alias("lon"))
    over = go.within_longitudes(t, 170, -165).select("event_id", F.lit(True).alias("over"))
    t = t.join(over, "event_id", "left")
    return t.select("event_id", _r(F.col("p.lat"), 9).alias("lat"), _r(F.col("p.lon"), 9).alias("lon"), _r(go.circumference_km(F.col("p.lat"))).alias("km"), F.coalesce("over", F.lit(False)).alias("over_date_line"))


@query("pair_checks", """
SELECT a.l_orderkey AS k, a.l_partkey AS p, b.l_partkey AS q, array_to_string(list_filter([CASE WHEN a.l_returnflag <> b.l_returnflag THEN 'flag' END, CASE WHEN a.l_linestatus <> b.l_linestatus THEN 'status' END], lambda x: x IS NOT NULL), ',') AS differ, a.l_returnflag = b.l_returnflag AND a.l_linestatus = b.l_linestatus AS matches
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey""")  # fmt: skip
def pair_checks(spark, d):
    side = lambda n: _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct(F.col("l_partkey").alias("p"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).alias(n))
    pairs = side("master").join(side("slave"), "k").where("master.p < slave.p")
    c = go.checked_pairs(pairs, ("flag", "status"))
    return c.select("k", F.col("master.p").alias("p"), F.col("slave.p").alias("q"), F.array_join("differ", ",").alias("differ"), "matches")


@query("zone_sources", """
WITH z AS (SELECT DISTINCT c_nationkey AS epsg FROM customer), p AS (SELECT s_nationkey AS epsg, s_name AS path, s_suppkey = 1 AS native FROM supplier),
m AS (SELECT epsg, max(native) AS native, coalesce(min(CASE WHEN native THEN path END), min(path)) AS path FROM p GROUP BY epsg HAVING count(*) = 1 OR max(native)), n AS (SELECT path FROM p WHERE native)
SELECT z.epsg, coalesce(m.path, n.path) AS path, CASE WHEN m.native THEN 'source' WHEN m.path IS NOT NULL THEN 'cached' ELSE 'reproject' END AS action FROM z LEFT JOIN m ON m.epsg = z.epsg, n""")  # fmt: skip
def zone_sources(spark, d):
    s = _table(spark, d, "supplier").select(F.col("s_nationkey").alias("epsg"), F.col("s_name").alias("path"), (F.col("s_suppkey") == 1).alias("native"))
    one = s.groupBy("epsg").agg(F.count("*").alias("n"), F.max("native").alias("own")).where("n = 1 or own")
    return go.source_of_zone(_table(spark, d, "customer").select(F.col("c_nationkey").alias("epsg")), s.join(one.select("epsg"), "epsg", "left_semi"))


@query("swath_folders", """
SELECT 'IW' || (event_id % 3 + 1) AS swath, array_to_string(list_sort(list('/d/p' || event_id || '_IW' || (event_id % 3 + 1) || '.dim')), ',') AS paths FROM events WHERE event_id % 4 <> 0 GROUP BY 1""")  # fmt: skip
def swath_folders(spark, d):
    e = F.col("event_id")
    path = F.concat(F.lit("/d/p"), e.cast("string"), F.when(e % 4 != 0, F.concat(F.lit("_IW"), (e % 3 + 1).cast("string"))).otherwise("_IWX"), F.lit(".dim"))
    return go.swath_products(_table(spark, d, "events").select(path.alias("path")), ["IW1", "IW2", "IW3"]).select("swath", F.array_join("paths", ",").alias("paths"))
