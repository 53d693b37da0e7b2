"""Pairing, merging, set algebra, ranking and validation roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import in_ranges, join_back

from ..functions.guards import nan


def select_pairs(rows: DataFrame, keys: Sequence[str], start: str, coverage: str, row_id: str) -> DataFrame:
    """For each group of equal keys (nulls are a group) with two or more rows: its latest row as master, the one before as
    slave, and the group's place by best coverage, then by recency.  The pair of place 1 is the overall choice."""
    order = W.partitionBy(*keys).orderBy(F.col(start).desc(), F.col(row_id))
    whole = W.partitionBy(*keys)
    ranked = rows.withColumn("rn", F.row_number().over(order)).withColumn("n", F.count("*").over(whole)).withColumn("best", F.max(coverage).over(whole))
    groups = ranked.where((F.col("n") > 1) & (F.col("rn") <= 2)).groupBy(*keys).agg(
        F.max(F.when(F.col("rn") == 1, F.col(row_id))).alias("master"),
        F.max(F.when(F.col("rn") == 2, F.col(row_id))).alias("slave"),
        F.max("best").alias("coverage"),
        F.max(F.when(F.col("rn") == 1, F.col(start))).alias("latest"),
    )
    return groups


def best_pair(groups: DataFrame) -> DataFrame:
    """The group of best coverage, then of the latest start: a top-1, no global sort."""
    return groups.orderBy(F.col("coverage").desc_nulls_last(), F.col("latest").desc(), F.col("master")).limit(1)


def merge_first_valid(target: DataFrame, source: DataFrame, keys: Sequence[str], bands: Sequence[str], nodata: Sequence[float] = (0.0,)) -> DataFrame:
    """Target values, filled from source where the target's are invalid (null, NaN or no-data); a status for each row.

    copied: only in source; identical; merged: filled somewhere; conflict_kept_first: both valid and different.
    """

    def valid(c: Column) -> Column:
        return F.coalesce(c.isNotNull() & ~F.isnan(c) & ~c.isin(*nodata), F.lit(False))

    t, s = target.alias("t"), source.alias("s")
    joined = t.join(s, [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys], "full")
    out, fills, conflicts, same = [], F.lit(False), F.lit(False), F.lit(True)
    for b in bands:
        a, c = F.col(f"t.{b}"), F.col(f"s.{b}")
        out.append(F.when(valid(a), a).when(valid(c), c).otherwise(F.coalesce(a, c)).alias(b))
        fills = fills | (~valid(a) & valid(c))
        conflicts = conflicts | F.coalesce(valid(a) & valid(c) & (a != c), F.lit(False))
        same = same & a.eqNullSafe(c)
    in_t = F.greatest(*[F.col(f"t.{b}").isNotNull() for b in (*keys, *bands)])
    status = F.when(~in_t, "copied").when(same, "identical").when(conflicts, "conflict_kept_first").when(fills, "merged").otherwise("merged")
    return joined.select(*[F.coalesce(f"t.{k}", f"s.{k}").alias(k) for k in keys], *out, status.alias("status"))


def tile_sets(candidates: DataFrame, skipped: DataFrame, partial: DataFrame, actual: DataFrame, name: str = "tile") -> DataFrame:
    """(tile, state): expected = candidates - skipped - partial; missing = expected - actual; extra = actual - candidates."""
    c, s, p, a = (d.select(name).distinct() for d in (candidates, skipped, partial, actual))
    expected = c.join(s, name, "left_anti").join(p, name, "left_anti")
    return (
        expected.join(a, name, "left_anti").select(name, F.lit("missing").alias("state"))
        .unionByName(a.join(c, name, "left_anti").select(name, F.lit("extra").alias("state")))
        .unionByName(expected.join(a, name, "left_semi").select(name, F.lit("present").alias("state")))
    )


def scaled(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """(value - min) / (max - min) of each group as a further column; 1 where all are (nearly) equal; null and NaN stay.
    The ends are an aggregation with a map-side part, joined back by key."""
    fine = F.when(~F.isnan(value), F.col(value))
    ends = df.groupBy(*keys).agg(F.min(fine).alias("__low"), F.max(fine).alias("__high"))
    low, high = F.col("__low"), F.col("__high")
    both = join_back(df, ends, keys)
    close = F.abs(low - high) <= 1e-8 + 1e-5 * F.abs(high)
    return both.withColumn(out, F.when(fine.isNull(), F.col(value)).when(close, 1.0).otherwise((F.col(value) - low) / (high - low))).drop("__low", "__high")


def weighted_score(df: DataFrame, keys: Sequence[str], good: str, bad: str, w_good: float = 0.5, w_bad: float = 0.5) -> DataFrame:
    """comp_norm, inv_var_norm and score: high ``good`` and low ``bad`` within the keys."""
    df = df.where(F.col(good).isNotNull() & F.col(bad).isNotNull())
    df = scaled(scaled(df, keys, good, "comp_norm"), keys, bad, "inv_var_norm").withColumn("inv_var_norm", 1 - F.col("inv_var_norm"))
    return df.withColumn("score", w_good * F.col("comp_norm") + w_bad * F.col("inv_var_norm"))


def ranked(df: DataFrame, keys: Sequence[str], score: str, tie: str) -> DataFrame:
    """rank (1 is the best) and pct_rank of the score within the keys."""
    w = W.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).withColumn("pct_rank", F.percent_rank().over(W.partitionBy(*keys).orderBy(F.col(score))))


def pareto_front(df: DataFrame, x: str, y: str, ranges: int = 64) -> DataFrame:
    """Rows that no other row dominates (both at least as large, one larger).

    A row is dominated if a row of larger x has y at least as large, or a row of
    the same x has a larger y.  So distinct x with their largest y are enough to
    compare with: a running maximum from the largest x down.  The x are cut into
    ranges at approximate quantiles; a row of each range's maximum goes to all
    tasks, and each range has a running maximum of its own.
    """
    tops = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x).agg(F.max(y).alias("top"))
    parts = in_ranges(tops, x, ranges, "part")
    ends = parts.groupBy("part").agg(F.max("top").alias("part_top")).select(F.col("part").alias("beyond_part"), "part_top")  # a row a range
    own = F.max("top").over(W.partitionBy("part").orderBy(F.col(x).desc()).rowsBetween(W.unboundedPreceding, -1))
    later = F.broadcast(ends.agg(F.collect_list(F.struct("beyond_part", "part_top")).alias("__ends")))
    front = parts.withColumn("beyond", own).join(later, F.lit(True))
    after = F.array_max(F.transform(F.filter("__ends", lambda e: e["beyond_part"] > F.col("part")), lambda e: e["part_top"]))
    beyond = F.greatest("beyond", after)
    front = front.where(beyond.isNull() | (F.col("top") > beyond)).select(F.col(x).alias("front_x"), F.col("top").alias("front_y"))
    return df.join(front, (df[x] == front["front_x"]) & (df[y] == front["front_y"]), "left_semi")


def rollup_counts(df: DataFrame, keys: Sequence[str], passed: Column) -> DataFrame:
    """Counts by every prefix of the keys and in all: n, n_passed and pass_pct (one decimal; 100 of nothing)."""
    n, ok = F.count("*"), F.sum(F.when(passed, 1).otherwise(0))
    return df.rollup(*keys).agg(n.alias("n"), ok.alias("n_passed"), F.when(n > 0, F.round(ok * 100.0 / n, 1)).otherwise(100.0).alias("pass_pct"))


def band_quality(pixels: DataFrame, tile: str, bands: Sequence[str], nodata: float = 0.0) -> DataFrame:
    """Pixel counts by tile: total, nan (a band is NaN or null), zero_all (all bands no-data), nodata, valid."""
    is_nan = F.greatest(*[F.coalesce(F.isnan(b), F.lit(True)) | F.col(b).isNull() for b in bands])
    zero = F.least(*[F.coalesce(F.col(b) == nodata, F.lit(False)) for b in bands])
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return pixels.groupBy(tile).agg(F.count("*").alias("total"), one(is_nan).alias("nan"), one(zero).alias("zero_all"), one(is_nan | zero).alias("nodata"), one(~(is_nan | zero)).alias("valid"))
