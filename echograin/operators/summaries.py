"""Feature files by their paths, metrics of configurations, and their roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.products import band_parts, numeric_suffix
from .relational import scaled


def feature_kind(path: Column) -> Column:
    """coherence, covariance or other by the start of the file's name."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.when(name.startswith("coh"), "coherence").when(name.startswith("cov"), "covariance").otherwise("other")


def path_settings(path: Column) -> Column:
    """swath, look set, window, product and polarisation from the folders and the name of a path, the last of a kind counts; null where there is none."""

    def last(pattern: str) -> Column:
        found = F.regexp_extract_all(path, F.lit(pattern), F.lit(1))
        return F.when(F.size(found) > 0, F.element_at(found, -1))

    return F.struct(
        last(r"(?:^|[/_])((?:IW|EW|S)\d)(?=$|[/_.])").alias("swath"), last(r"(?:^|[/_])(L\d+)(?=$|[/_.])").alias("lookset"), last(r"(?:^|[/_])(W\d+)(?=$|[/_.])").alias("window"),
        last(r"(?:^|/)([^/]+)_TC\.data").alias("product"), last(r"(?:^|[/_])((?:VV|VH|HH|HV))(?=$|[/_.])").alias("pol"),
    )


def selected_paths(files: DataFrame, holds: Sequence[str] = (), without: Sequence[str] = (), kinds: Sequence[str] = ("coherence", "covariance")) -> DataFrame:
    """Distinct paths that hold all of the texts and none of the others, with their kind and settings, and the reason why a file is left out (null: it isn't)."""
    name = F.element_at(F.split("path", "/"), -1)
    keep = F.lit(True)
    for text in holds:
        keep = keep & name.contains(text)
    for text in without:
        keep = keep & ~name.contains(text)
    out = files.select("path").distinct().where(keep).withColumn("kind", feature_kind(F.col("path")))
    return out.select("path", "kind", path_settings(F.col("path")).alias("settings"), F.when(~F.col("kind").isin(*kinds), F.concat(F.lit("kind "), "kind")).alias("left_out"))


def band_group(band: Column) -> Column:
    """Diagonal, cross or other covariance band by its whole name: C and two digits or more are diagonal, ReC... and ImC... cross."""
    return F.when(band.rlike(r"^C\d\d+$"), "cov_diag").when(band.rlike(r"^(Re|Im)C"), "cov_cross").otherwise("other")


def known_mean(x: Column) -> Column:
    """Mean of the values that aren't NaN; NaN if there are none."""
    return F.coalesce(F.avg(F.when(~F.isnan(x), x)), F.lit(float("nan")))


def known_median(x: Column) -> Column:
    return F.coalesce(F.median(F.when(~F.isnan(x), x)), F.lit(float("nan")))


def look_sets(files: DataFrame, least: int = 2) -> DataFrame:
    """(lookset, swath, pol, looks): the looks of each set that have both an i and a q band, of (lookset, band), for sets of ``least`` looks or more."""
    b = files.select("lookset", band_parts(F.col("band")).alias("b")).where("b.look is not null")
    whole = b.groupBy("lookset", "b.swath", "b.pol", "b.look").agg(F.count_distinct("b.component").alias("parts")).where("parts = 2")
    return whole.groupBy("lookset", "swath", "pol").agg(F.sort_array(F.collect_set("look")).alias("looks")).where(F.size("looks") >= least)


def core(df: DataFrame, row: str, col: str, top: int, left: int, height: int, width: int) -> DataFrame:
    """Pixels of a window without its halo, numbered from its corner."""
    r, c = F.col(row), F.col(col)
    return df.where((r >= top) & (r < top + height) & (c >= left) & (c < left + width)).withColumns({row: r - top, col: c - left})


#: Columns of a summary that metrics are made of.
REQUIRED = ("kind", "pol", "lookset", "window", "selected_bands", "mean_nmi", "complementarity_1_minus_mean_nmi")


def known_settings(summary: DataFrame, least_looks: int | None = None) -> DataFrame:
    """Rows of a summary with the numbers of its look set and window, without those that have none (and with more than
    ``least_looks`` looks, if that is given); columns that are missing are an error."""
    missing = [c for c in REQUIRED if c not in summary.columns]
    if missing:
        raise ValueError(f"the summary has no {', '.join(missing)}")
    out = summary.withColumns({"l": numeric_suffix(F.col("lookset")).cast("int"), "w": numeric_suffix(F.col("window")).cast("int")}).where("l is not null and w is not null")
    return out.where(F.col("l") > least_looks) if least_looks is not None else out


def metrics(summary: DataFrame, w_complementarity: float = 0.5, w_variability: float = 0.5) -> DataFrame:
    """Complementarity and variability (by the median of the kind's own measure), both scaled within kind and polarisation, and the weighted score."""
    variability = F.when(F.col("kind") == "coherence", F.col("coherence_median_cv")).when(F.col("kind") == "covariance", F.col("covariance_diag_median_cv"))
    known = lambda c: c.isNotNull() & ~F.isnan(c)
    m = summary.withColumns({"complementarity": F.col("complementarity_1_minus_mean_nmi"), "variability": variability, "config": F.format_string("L%d/W%d", "l", "w")})
    m = m.where(known(F.col("complementarity")) & known(F.col("variability")))
    m = scaled(scaled(m, ["kind", "pol"], "complementarity", "comp_norm"), ["kind", "pol"], "variability", "var_norm")
    m = m.withColumn("inv_var_norm", 1 - F.col("var_norm"))
    return m.withColumn("score", w_complementarity * F.col("comp_norm") + w_variability * F.col("inv_var_norm"))


def kind_means(metrics_: DataFrame) -> DataFrame:
    """Means of the metrics over polarisations, their number, and the number of scores, by kind and configuration."""
    means = ("complementarity", "variability", "comp_norm", "var_norm", "inv_var_norm", "score", "selected_bands")
    keys = ["kind", "l", "w", "lookset", "window"]
    return metrics_.where("score is not null").groupBy(*keys).agg(*[F.avg(c).alias(c) for c in means], F.count_distinct("pol").alias("n_pols"), F.count("score").alias("n_scores"))


def status_layers(results: DataFrame, geometries: DataFrame) -> DataFrame:
    """(layer, tile, ring): tiles with a known ring in the layer of their status; statuses beyond the usual ones are in other."""
    layer = F.when(F.col("status").isin("success", "partial", "failed", "skipped", "missing", "extra"), F.col("status")).otherwise("other")
    return results.select("tile", layer.alias("layer")).join(geometries.where("ring is not null").select("tile", "ring"), "tile").select("layer", "tile", "ring")


def issue_lines(failures: DataFrame, order: Sequence[str], most: int = 6) -> DataFrame:
    """The first rows in order, a report's top-k, and the number of those beyond it on each."""
    beyond = failures.agg(F.greatest(F.lit(0), F.count("*") - most).alias("more"))  # one row
    return failures.orderBy(*order).limit(most).join(F.broadcast(beyond), F.lit(True))


def ring_area_km2(ring: Column, radius_km: float = 6371.0088) -> Column:
    """Area of a ring (lon, lat) on the sphere: half the sum over its edges of the longitude step times the sines of its ends."""
    n = F.size(ring)

    def edge(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        return F.radians(b["lon"] - a["lon"]) * (2 + F.sin(F.radians(a["lat"])) + F.sin(F.radians(b["lat"])))

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + edge(i))
    return F.abs(total) / 2 * (radius_km * radius_km)


def phase_features(df: DataFrame, keys: Sequence[str], look: str, re: str, im: str) -> DataFrame:
    """(keys, looks, power, phase_variance): the number of looks of a pixel group, their mean power, and 1 less the length of
    their mean unit vector.  The looks of a group are few and lie side by side in one array."""
    z = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(look, F.col(re).alias("re"), F.col(im).alias("im")))).alias("z"))
    mean = lambda f: F.aggregate("z", F.lit(0.0), lambda s, x: s + f(x)) / F.size("z")
    size = lambda x: F.sqrt(x["re"] * x["re"] + x["im"] * x["im"])
    unit_re, unit_im = mean(lambda x: x["re"] / F.greatest(size(x), F.lit(1e-30))), mean(lambda x: x["im"] / F.greatest(size(x), F.lit(1e-30)))
    return z.select(*keys, F.size("z").alias("looks"), mean(lambda x: size(x) * size(x)).alias("power"), (1 - F.sqrt(unit_re * unit_re + unit_im * unit_im)).alias("phase_variance"))
