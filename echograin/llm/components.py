"""Connected components of a graph in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hot_keys, remove_folder, shared_table, spread_join, table_path


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of the links (a, b) reaches; a and b are never null.

    Labels start at the smallest neighbour.  Each round takes the smallest label
    among the neighbours and then the label of the label, so long chains shrink
    by doubling; it ends when no label changes.  Every round is written to the
    shared folder, so no lineage grows, and takes the place of the one before.
    Minima are combined before each shuffle; a node with very many links is
    dealt over several tasks.
    """
    spark = links.sparkSession
    both = shared_table(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = shared_table(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "id"))
    hot, before = hot_keys(both, "b"), None
    while True:
        near = spread_join(both, labels.withColumnRenamed("id", "b"), "b", hot, "a", "inner").groupBy("a").agg(F.min("component").alias("near"))
        lower = shared_table(labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.least("component", "near").alias("next"), "component"))
        ahead = labels.select(F.col("id").alias("next"), F.col("component").alias("beyond"))
        # all nodes of a large component may have the same next one
        found = spread_join(lower, ahead, "next", hot_keys(lower, "next"), "id", "inner").select("id", F.least("next", "beyond").alias("component"), (F.least("next", "beyond") != F.col("component")).alias("changed"))
        path = table_path(spark)
        found = shared_table(found, path)
        if before:
            remove_folder(spark, before)
        labels, before = found.select("id", "component"), path
        if not found.where("changed").limit(1).count():
            return labels
