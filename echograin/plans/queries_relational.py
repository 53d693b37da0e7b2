"""Queries of aggregates, joins, sets and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import image_stats as st
from ..operators import relational as rel
from .register import query


def _table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(x, digits: int = 6):
    return F.round(x, digits)


@query("agg_looks", """
SELECT l_returnflag, l_linestatus, round(avg(l_quantity) * avg(l_quantity) / (var_pop(l_quantity) + 1e-12), 6) AS enl, round(var_pop(l_quantity) / (avg(l_quantity) * avg(l_quantity) + 1e-12), 6) AS dispersion,
  round(stddev_pop(l_quantity) / (abs(avg(l_quantity)) + 1e-12), 6) AS cv, round(avg(CASE WHEN l_discount + l_tax > 0 THEN 4 * l_tax / (l_discount + l_tax) END), 6) AS mean_rvi, count(*) AS n
FROM lineitem GROUP BY l_returnflag, l_linestatus""")  # fmt: skip
def agg_looks(spark, d):
    """Looks, dispersion and mean vegetation index by group."""
    q, vv, vh = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    rvi = F.when(vv + vh > 0, 4 * vh / (vv + vh))
    return _table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(_r(st.enl(q)).alias("enl"), _r(st.dispersion_ratio(q)).alias("dispersion"), _r(st.variation(q)).alias("cv"), _r(F.avg(rvi)).alias("mean_rvi"), F.count("*").alias("n"))


@query("agg_phase_variance", "SELECT l_returnflag, round(1 - sqrt(avg(cos(atan2(l_tax, l_discount))) ** 2 + avg(sin(atan2(l_tax, l_discount))) ** 2), 6) AS phase_variance, round(sqrt(avg(l_discount * l_discount + l_tax * l_tax)), 6) AS rms FROM lineitem GROUP BY l_returnflag")
def agg_phase_variance(spark, d):
    re, im = F.col("l_discount"), F.col("l_tax")
    return _table(spark, d, "lineitem").groupBy("l_returnflag").agg(_r(st.phase_variance(re, im)).alias("phase_variance"), _r(st.rms(re, im)).alias("rms"))


_AB = "(SELECT l_returnflag, l_discount AS ar, l_quantity / 50 AS ai, l_tax AS br, l_quantity / 60 AS bi FROM lineitem)"


def _ab():
    return F.col("l_discount"), F.col("l_quantity") / 50, F.col("l_tax"), F.col("l_quantity") / 60


@query("agg_coherence", f"""
SELECT l_returnflag, round(sqrt(avg(ar * br + ai * bi) ** 2 + avg(ai * br - ar * bi) ** 2) / (sqrt(avg(ar * ar + ai * ai) * avg(br * br + bi * bi)) + 1e-12), 6) AS coherence,
  round(sqrt(avg(cos(atan2(ai * br - ar * bi, ar * br + ai * bi))) ** 2 + avg(sin(atan2(ai * br - ar * bi, ar * br + ai * bi))) ** 2), 6) AS phase_coherence FROM {_AB} GROUP BY l_returnflag""")  # fmt: skip
def agg_coherence(spark, d):
    return _table(spark, d, "lineitem").groupBy("l_returnflag").agg(_r(st.coherence(*_ab())).alias("coherence"), _r(st.phase_coherence(*_ab())).alias("phase_coherence"))


@query("agg_image_metrics", """
SELECT l_linestatus, round(avg((x - y) ** 2), 6) AS mse, round(sqrt(avg((x - y) ** 2)), 6) AS rmse, round(10 * log10(max(x) ** 2 / avg((x - y) ** 2)), 5) AS psnr, round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 6) AS correlation,
  round(avg(abs(x - y)), 6) AS mae, round((2 * avg(x) * avg(y) + c1) / (avg(x) ** 2 + avg(y) ** 2 + c1), 6) AS luminance, round((2 * stddev_pop(x) * stddev_pop(y) + c2) / (var_pop(x) + var_pop(y) + c2), 6) AS contrast,
  round((covar_pop(x, y) + c2 / 2) / (stddev_pop(x) * stddev_pop(y) + c2 / 2), 6) AS structure
FROM (SELECT l_linestatus, l_quantity / 50 AS x, l_quantity / 60 + l_tax AS y FROM lineitem) t
JOIN (SELECT l_linestatus, (0.01 * (greatest(max(l_quantity / 50), max(l_quantity / 60 + l_tax)) - least(min(l_quantity / 50), min(l_quantity / 60 + l_tax)))) ** 2 AS c1,
             (0.03 * (greatest(max(l_quantity / 50), max(l_quantity / 60 + l_tax)) - least(min(l_quantity / 50), min(l_quantity / 60 + l_tax)))) ** 2 AS c2 FROM lineitem GROUP BY l_linestatus) c USING (l_linestatus)
GROUP BY l_linestatus, c1, c2""")  # fmt: skip
def agg_image_metrics(spark, d):
    x, y, z = F.col("l_quantity") / 50, F.col("l_quantity") / 60 + F.col("l_tax"), F.lit(0.0)
    return _table(spark, d, "lineitem").groupBy("l_linestatus").agg(
        _r(st.mse(x, z, y, z)).alias("mse"), _r(st.rmse(x, z, y, z)).alias("rmse"), _r(st.psnr(x, y), 5).alias("psnr"), _r(st.amplitude_correlation(x, y)).alias("correlation"),
        _r(st.mae(x, z, y, z)).alias("mae"), _r(st.luminance(x, y)).alias("luminance"), _r(st.ssim_contrast(x, y)).alias("contrast"), _r(st.structure(x, y)).alias("structure"),
    )


_MAG = "sqrt(ar * ar + ai * ai)", "sqrt(br * br + bi * bi)"
_DPH = "atan2(ai * br - ar * bi, ar * br + ai * bi)"


@query("agg_losses", f"""
SELECT l_returnflag, round(avg((ar - br) ** 2) + avg((ai - bi) ** 2), 6) AS split_mse, round(avg((ar - br) ** 2 + (ai - bi) ** 2), 6) AS complex_l2, round(avg(sqrt((ar - br) ** 2 + (ai - bi) ** 2)), 6) AS complex_l1,
  round(avg(abs({_MAG[0]} - {_MAG[1]})), 6) AS mag_l1, round(avg(({_MAG[0]} - {_MAG[1]}) ** 2), 6) AS mag_l2, round(avg((ln({_MAG[0]} + 1e-6) - ln({_MAG[1]} + 1e-6)) ** 2), 6) AS log_mag,
  round(avg((ln(1 + {_MAG[0]}) - ln(1 + {_MAG[1]})) ** 2), 6) AS log1p_mag, round(avg(ln(cosh({_MAG[0]} - {_MAG[1]}))), 6) AS log_cosh, round(avg(({_MAG[0]} - {_MAG[1]}) ** 2) + avg({_DPH} ** 2), 6) AS amp_phase,
  round(avg(abs({_DPH})), 6) AS phase_l1, round(avg({_DPH} ** 2), 6) AS phase_l2, round(1 - sqrt(avg(cos({_DPH})) ** 2 + avg(sin({_DPH})) ** 2), 6) AS phase_correlation,
  round(sum(CASE WHEN {_MAG[1]} > 0.1 THEN 1 - cos({_DPH}) ELSE 0 END) / greatest(sum(CASE WHEN {_MAG[1]} > 0.1 THEN 1 ELSE 0 END), 1), 6) AS phase_masked
FROM {_AB} GROUP BY l_returnflag""")  # fmt: skip
def agg_losses(spark, d):
    names = ("split_mse", "complex_l2", "complex_l1", "mag_l1", "mag_l2", "log_mag", "log1p_mag", "log_cosh", "amp_phase", "phase_l1", "phase_l2", "phase_correlation", "phase_masked")
    return _table(spark, d, "lineitem").groupBy("l_returnflag").agg(*[_r(st.get_loss(n)(*_ab())).alias(n) for n in names])


@query("agg_scalar_losses", """
SELECT l_returnflag, round(avg(CASE WHEN abs(p - t) <= 1 THEN 0.5 * (p - t) ** 2 ELSE abs(p - t) - 0.5 END), 6) AS huber, round(avg(greatest(p, 0) - p * b + ln(1 + exp(-abs(p)))), 6) AS bce,
  round(avg(0.25 * (1 - exp(-(greatest(p, 0) - p * b + ln(1 + exp(-abs(p)))))) ** 2 * (greatest(p, 0) - p * b + ln(1 + exp(-abs(p))))), 6) AS focal
FROM (SELECT l_returnflag, l_quantity / 10 - 2 AS p, l_discount * 30 AS t, CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0.0 END::DOUBLE AS b FROM lineitem) t GROUP BY l_returnflag""")  # fmt: skip
def agg_scalar_losses(spark, d):
    p, t, b = F.col("l_quantity") / 10 - 2, F.col("l_discount") * 30, F.when(F.col("l_tax") > 0.04, 1.0).otherwise(0.0)
    return _table(spark, d, "lineitem").groupBy("l_returnflag").agg(_r(st.loss_huber(p, t)).alias("huber"), _r(st.loss_bce(p, b)).alias("bce"), _r(st.loss_focal(p, b)).alias("focal"))


@query("agg_focus", """
WITH m AS (SELECT event_type, avg(value) AS m1, avg(value ** 2) AS m2, avg(value ** 3) AS m3, avg(value ** 4) AS m4, stddev_samp(value) AS sd, sum(value) AS s, sum(CASE WHEN value > 0 THEN value * ln(value) ELSE 0 END) AS xl FROM (SELECT event_type, value / 100 AS value FROM events) t GROUP BY event_type)
SELECT event_type, round(sd / (m1 + 1e-8), 5) AS contrast, round((m4 - 4 * m1 * m3 + 6 * m1 ** 2 * m2 - 3 * m1 ** 4) / (m2 - m1 ** 2 + 1e-8) ** 2, 4) AS kurtosis, round(ln(s + 1e-8) - xl / (s + 1e-8), 5) AS entropy FROM m""")  # fmt: skip
def agg_focus(spark, d):
    v = F.col("value") / 100
    return _table(spark, d, "events").groupBy("event_type").agg(_r(st.contrast(v), 5).alias("contrast"), _r(st.raw_kurtosis(v), 4).alias("kurtosis"), _r(st.entropy_of_shares(v), 5).alias("entropy"))


@query("agg_percentiles", "SELECT event_type, round(quantile_cont(value, 0.01), 6) AS p1, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def agg_percentiles(spark, d):
    return _table(spark, d, "events").groupBy("event_type").agg(*[_r(F.percentile("value", F.lit(p))).alias(n) for p, n in ((0.01, "p1"), (0.5, "p50"), (0.99, "p99"))])


@query("agg_temporal_stats", "SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n, round(avg(o_totalprice), 2) AS mean, round(min(o_totalprice), 2) AS least, round(max(o_totalprice), 2) AS most, round(stddev_samp(o_totalprice), 2) AS sd FROM orders GROUP BY 1")
def agg_temporal_stats(spark, d):
    p = F.col("o_totalprice")
    return _table(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("n"), _r(F.avg(p), 2).alias("mean"), _r(F.min(p), 2).alias("least"), _r(F.max(p), 2).alias("most"), _r(F.stddev_samp(p), 2).alias("sd"))


@query("agg_binning", "SELECT floor(l_quantity / 5)::BIGINT AS row_bin, floor(l_discount * 50 + 1e-9)::BIGINT AS col_bin, count(*) AS n, round(avg(l_tax), 6) AS mean FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' GROUP BY 1, 2")
def agg_binning(spark, d):
    t = _table(spark, d, "lineitem").where("l_shipdate >= timestamp '1994-01-01'")
    return t.groupBy(F.floor(F.col("l_quantity") / 5).alias("row_bin"), F.floor(F.col("l_discount") * 50 + 1e-9).alias("col_bin")).agg(F.count("*").alias("n"), _r(F.avg("l_tax")).alias("mean"))


@query("agg_nmi", """
WITH r AS (SELECT l_returnflag, min(l_discount) AS lx, max(l_discount) AS hx, min(l_quantity) AS ly, max(l_quantity) AS hy FROM lineitem GROUP BY 1),
b AS (SELECT l_returnflag, greatest(0, least(15, floor((l_discount - lx) / (hx - lx) * 16)::INT)) AS bx, greatest(0, least(15, floor((l_quantity - ly) / (hy - ly) * 16)::INT)) AS by_ FROM lineitem JOIN r USING (l_returnflag)),
h AS (SELECT l_returnflag, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT l_returnflag, bx, count(*) AS n FROM b GROUP BY 1, 2) t GROUP BY 1),
g AS (SELECT l_returnflag, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT l_returnflag, by_, count(*) AS n FROM b GROUP BY 1, 2) t GROUP BY 1),
j AS (SELECT l_returnflag, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT l_returnflag, bx, by_, count(*) AS n FROM b GROUP BY 1, 2, 3) t GROUP BY 1)
SELECT h.l_returnflag, round(2 * (h.h + g.h - j.h) / (h.h + g.h), 6) AS nmi FROM h JOIN g USING (l_returnflag) JOIN j USING (l_returnflag)""")  # fmt: skip
def agg_nmi(spark, d):
    out = st.normalized_mutual_information(_table(spark, d, "lineitem"), "l_discount", "l_quantity", ["l_returnflag"], bins=16)
    return out.select("l_returnflag", _r(F.col("nmi")).alias("nmi"))


@query("join_pair_select", """
WITH o AS (SELECT o_custkey, o_orderstatus, o_orderkey, o_orderdate, o_totalprice, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS n,
  max(o_totalprice) OVER (PARTITION BY o_custkey, o_orderstatus) AS best FROM orders)
SELECT o_custkey, o_orderstatus, max(CASE WHEN rn = 1 THEN o_orderkey END) AS master, max(CASE WHEN rn = 2 THEN o_orderkey END) AS slave, round(max(best), 2) AS coverage, max(CASE WHEN rn = 1 THEN o_orderdate END) AS latest
FROM o WHERE n > 1 AND rn <= 2 GROUP BY 1, 2""")  # fmt: skip
def join_pair_select(spark, d):
    g = rel.select_pairs(_table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], "o_orderdate", "o_totalprice", "o_orderkey")
    return g.withColumn("coverage", _r(F.col("coverage"), 2))


@query("join_best_pair", """
WITH o AS (SELECT o_custkey, o_orderstatus, o_orderkey, o_orderdate, o_totalprice, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS n FROM orders),
g AS (SELECT o_custkey, o_orderstatus, max(CASE WHEN rn = 1 THEN o_orderkey END) AS master, max(CASE WHEN rn = 2 THEN o_orderkey END) AS slave, max(o_totalprice) AS c, max(o_orderdate) AS t FROM o WHERE n > 1 GROUP BY 1, 2)
SELECT master, slave FROM g ORDER BY c DESC, t DESC, master LIMIT 1""")  # fmt: skip
def join_best_pair(spark, d):
    g = rel.select_pairs(_table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], "o_orderdate", "o_totalprice", "o_orderkey")
    return rel.best_pair(g).select("master", "slave")


@query("join_collocate", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / o_totalprice, 6) AS share, datediff('day', o_orderdate, l_shipdate) AS days FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def join_collocate(spark, d):
    """Secondary product beside its reference by pixel key."""
    j = _table(spark, d, "lineitem").join(_table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select("l_orderkey", "l_linenumber", _r(F.col("l_extendedprice") / F.col("o_totalprice")).alias("share"), F.datediff("l_shipdate", "o_orderdate").cast("long").alias("days"))


@query("join_merge_fill", """
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 5 <> 0), s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 7 <> 0)
SELECT o_orderkey, round(CASE WHEN t.v IS NOT NULL AND t.v <> 0 THEN t.v WHEN s.v IS NOT NULL AND s.v <> 0 THEN s.v ELSE coalesce(t.v, s.v) END, 2) AS v,
  CASE WHEN t.v IS NULL THEN 'copied' WHEN t.v IS NOT DISTINCT FROM s.v THEN 'identical' WHEN t.v <> 0 AND s.v <> 0 AND t.v <> s.v THEN 'conflict_kept_first' ELSE 'merged' END AS status
FROM t FULL JOIN s USING (o_orderkey)""")  # fmt: skip
def join_merge_fill(spark, d):
    o, k = _table(spark, d, "orders"), F.col("o_orderkey")
    t = o.where(k % 5 != 0).select("o_orderkey", F.when(k % 3 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("v"))
    s = o.where(k % 7 != 0).select("o_orderkey", F.when(k % 4 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("v"))
    return rel.merge_first_valid(t, s, ["o_orderkey"], ["v"]).withColumn("v", _r(F.col("v"), 2))


@query("merge_all", """
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE o_totalprice END AS v FROM orders), s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders)
SELECT o_orderkey, round(CASE WHEN t.v IS NOT NULL AND t.v <> 0 THEN t.v WHEN s.v IS NOT NULL AND s.v <> 0 THEN s.v ELSE coalesce(t.v, s.v) END, 2) AS v,
  CASE WHEN t.v IS NOT DISTINCT FROM s.v THEN 'identical' WHEN t.v <> 0 AND s.v <> 0 AND t.v <> s.v THEN 'conflict_kept_first' ELSE 'merged' END AS status
FROM t FULL JOIN s USING (o_orderkey)""")  # fmt: skip
def merge_all(spark, d):
    """All orders in both tables, with values that one or both of them lack."""
    o, k = _table(spark, d, "orders"), F.col("o_orderkey")
    t = o.select("o_orderkey", F.when(k % 5 == 0, None).when(k % 3 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("v"))
    s = o.select("o_orderkey", F.when(k % 7 == 0, None).when(k % 4 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("v"))
    return rel.merge_first_valid(t, s, ["o_orderkey"], ["v"]).withColumn("v", _r(F.col("v"), 2))


@query("set_tiles", """
WITH c AS (SELECT p_partkey AS tile FROM part), s AS (SELECT p_partkey AS tile FROM part WHERE p_size = 1), p AS (SELECT p_partkey AS tile FROM part WHERE p_size = 2), a AS (SELECT DISTINCT l_partkey + 50 AS tile FROM lineitem WHERE l_quantity > 45),
e AS (SELECT tile FROM c EXCEPT SELECT tile FROM s EXCEPT SELECT tile FROM p)
SELECT tile, 'missing' AS state FROM (SELECT tile FROM e EXCEPT SELECT tile FROM a) UNION ALL SELECT tile, 'extra' FROM (SELECT tile FROM a EXCEPT SELECT tile FROM c) UNION ALL SELECT tile, 'present' FROM (SELECT tile FROM e INTERSECT SELECT tile FROM a)""")  # fmt: skip
def set_tiles(spark, d):
    part = _table(spark, d, "part").select(F.col("p_partkey").alias("tile"), "p_size")
    actual = _table(spark, d, "lineitem").where("l_quantity > 45").select((F.col("l_partkey") + 50).alias("tile"))
    return rel.tile_sets(part, part.where("p_size = 1"), part.where("p_size = 2"), actual)


@query("win_rank_score", """
WITH n AS (SELECT o_orderkey, o_orderpriority, (o_totalprice - min(o_totalprice) OVER w) / (max(o_totalprice) OVER w - min(o_totalprice) OVER w) AS c, o_custkey, 1 - (o_custkey - min(o_custkey) OVER w)::DOUBLE / (max(o_custkey) OVER w - min(o_custkey) OVER w) AS i FROM orders WINDOW w AS (PARTITION BY o_orderpriority)),
s AS (SELECT o_orderkey, o_orderpriority, 0.7 * c + 0.3 * i AS score FROM n)
SELECT o_orderkey, o_orderpriority, round(score, 6) AS score, row_number() OVER (PARTITION BY o_orderpriority ORDER BY score DESC, o_orderkey)::INT AS rank, percent_rank() OVER (PARTITION BY o_orderpriority ORDER BY score) > 0.5 AS upper_half FROM s""")  # fmt: skip
def win_rank_score(spark, d):
    o = _table(spark, d, "orders").withColumn("ck", F.col("o_custkey").cast("double"))
    s = rel.weighted_score(o, ["o_orderpriority"], "o_totalprice", "ck", 0.7, 0.3)
    out = rel.ranked(s, ["o_orderpriority"], "score", "o_orderkey")
    return out.select("o_orderkey", "o_orderpriority", _r(F.col("score")).alias("score"), "rank", (F.col("pct_rank") > 0.5).alias("upper_half"))


@query("theta_pareto", "SELECT s_suppkey FROM supplier a WHERE NOT EXISTS (SELECT 1 FROM supplier b WHERE b.s_acctbal >= a.s_acctbal AND b.s_nationkey >= a.s_nationkey AND (b.s_acctbal > a.s_acctbal OR b.s_nationkey > a.s_nationkey))")
def theta_pareto(spark, d):
    return rel.pareto_front(_table(spark, d, "supplier"), "s_acctbal", "s_nationkey").select("s_suppkey")


@query("rollup_validation", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, sum(CASE WHEN o_totalprice > 1000 THEN 1 ELSE 0 END)::BIGINT AS n_passed, round(sum(CASE WHEN o_totalprice > 1000 THEN 1 ELSE 0 END) * 100.0 / count(*), 1)::DOUBLE AS pass_pct FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def rollup_validation(spark, d):
    out = rel.rollup_counts(_table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], F.col("o_totalprice") > 1000)
    return out.withColumn("pass_pct", F.col("pass_pct").cast("double"))


@query("band_quality", """
SELECT l_returnflag AS tile, count(*) AS total, 0::BIGINT AS nan, sum(CASE WHEN l_discount = 0 AND l_tax = 0 THEN 1 ELSE 0 END)::BIGINT AS zero_all, sum(CASE WHEN l_discount = 0 AND l_tax = 0 THEN 1 ELSE 0 END)::BIGINT AS nodata,
  sum(CASE WHEN l_discount = 0 AND l_tax = 0 THEN 0 ELSE 1 END)::BIGINT AS valid FROM lineitem GROUP BY l_returnflag""")  # fmt: skip
def band_quality(spark, d):
    return rel.band_quality(_table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "tile"), "tile", ["l_discount", "l_tax"])
