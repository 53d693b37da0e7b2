"""Joining a table of one row a group back to its rows, and cutting an order into ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_back(df: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with the other columns of groups (one row a key, null keys are alike); without keys groups is one row."""
    if not keys:
        return df.join(F.broadcast(groups), F.lit(True))
    groups = groups.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(groups, same, "left").drop(*[f"__{k}" for k in keys])


def join_large_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str], rows: str, large: int = 10_000) -> DataFrame:
    """df with the other columns of groups (one row a key), of rows whose keys are in both and not null.

    ``rows`` is the column of groups that counts a key's rows.  The ``large`` largest keys are broadcast, so that their rows
    stay where they are; the rows of the others, each at most one in ``large`` of all, meet their groups by an equi join.
    """
    top = groups.orderBy(F.desc(rows), *keys).limit(large)  # a total order, as it is made twice
    rest = df.join(F.broadcast(top.select(*keys)), list(keys), "left_anti").join(groups, list(keys))
    return df.join(F.broadcast(top), list(keys)).unionByName(rest).drop(rows)


def in_ranges(df: DataFrame, order: str, ranges: int | None = None, out: str = "__range", like: DataFrame | None = None) -> DataFrame:
    """df with the number of the range that each row is in: parts of about the same number of rows, between approximate
    quantiles of the order.  Equal values share a range; null is in the first one.

    The number of ranges is a power of two, at least that of the session's shuffle partitions unless it is given, so it
    grows as a cluster is set up for larger inputs.  ``like`` is a part of the rows, with the same column, that the
    quantiles come from.  A row finds its range by halving, one comparison a step.
    """
    wanted = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = max(1, min(15, (wanted - 1).bit_length()))
    n = 1 << steps
    cuts = (df if like is None else like).agg(F.percentile_approx(order, [k / n for k in range(1, n)], max(10_000, 8 * n)).alias("__cuts"))
    found = df.join(F.broadcast(cuts), F.lit(True)).withColumn(out, F.lit(0))
    for k in range(steps - 1, -1, -1):  # each step is a column of its own, or the expression would double
        found = found.withColumn(out, F.when(F.get("__cuts", F.col(out) + ((1 << k) - 1)) < F.col(order), F.col(out) + (1 << k)).otherwise(F.col(out)))
    return found.drop("__cuts")
