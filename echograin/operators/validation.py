"""Roll-ups of tile validation: results are rows (grp, tile, status, and a boolean a check).

Every report is one grouped aggregation, whatever the number of groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def status_counts(results: DataFrame, statuses: Sequence[str] = ("success", "partial", "skipped", "failed", "missing", "extra")) -> DataFrame:
    """One row: tiles by status."""
    return results.agg(*[F.coalesce(F.sum(F.when(F.col("status") == s, 1).otherwise(0)), F.lit(0)).alias(s) for s in statuses])


def group_summary(results: DataFrame) -> DataFrame:
    """Tiles, passed and failed by group, and PASS if none failed."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    failed = one(F.col("status").isin("failed", "missing"))
    return results.groupBy("grp").agg(F.count("*").alias("tiles"), one(F.col("status") == "success").alias("passed"), failed.alias("failed"), F.when(failed == 0, "PASS").otherwise("FAIL").alias("verdict"))


def dashboard(results: DataFrame, checks: Sequence[str]) -> DataFrame:
    """(grp, check, passed, failed, pass_pct): one decimal, 100 of nothing; null results count for neither."""
    long = results.select("grp", F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("ok")) for c in checks])).alias("c")).select("grp", "c.*")
    ok, bad = F.sum(F.when(F.col("ok"), 1).otherwise(0)), F.sum(F.when(~F.col("ok"), 1).otherwise(0))
    return long.groupBy("grp", "check").agg(ok.alias("passed"), bad.alias("failed"), F.when(ok + bad > 0, F.round(ok * 100.0 / (ok + bad), 1)).otherwise(100.0).cast("double").alias("pass_pct"))


def failure_rows(results: DataFrame, checks: Sequence[str]) -> DataFrame:
    """A row for each tile that isn't a success, with the checks it failed."""
    names = F.filter(F.array(*[F.when(~F.col(c), F.lit(c)) for c in checks]), lambda x: x.isNotNull())
    return results.where(F.col("status") != "success").select("grp", "tile", "status", F.array_join(names, ", ").alias("issues"))


def missing_bands(bands: DataFrame, grp: str = "grp", tile: str = "tile", band: str = "band") -> DataFrame:
    """Bands that other tiles of a group have and a tile hasn't: expected is the union over the group."""
    expected = bands.select(grp, band).distinct()
    tiles = bands.select(grp, tile).distinct()
    return tiles.join(expected, grp).join(bands.select(grp, tile, band), [grp, tile, band], "left_anti")


def sample_bands(bands: DataFrame, priority: dict[str, int], limit: int = 6) -> DataFrame:
    """The first bands by the bucket of their name, then by name: a top-k."""
    bucket = F.lit(len(priority))
    for token, k in sorted(priority.items(), key=lambda x: -x[1]):
        bucket = F.when(F.col("band").contains(token), k).otherwise(bucket)
    return bands.select("band").distinct().withColumn("bucket", bucket).orderBy("bucket", "band").limit(limit)


def first_known(results: DataFrame, order: str, keys: Sequence[str]) -> DataFrame:
    """The first row in which one of the keys isn't blank: a minimum over rows, no sort."""
    known = F.greatest(*[F.coalesce(F.trim(F.col(k).cast("string")) != "", F.lit(False)) for k in keys])
    return results.where(known).agg(F.min(F.struct(F.col(order), *keys)).alias("r")).select("r.*")
