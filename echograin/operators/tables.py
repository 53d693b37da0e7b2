"""Cutting the lineage of loops that work on tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df written to spark.checkpoint.dir and read from there, so that a loop's plans don't grow and a lost executor loses
    nothing.  Where that is unset, as in tests, a folder of the warehouse serves; on a cluster it mustn't be a local one."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/echograin-{uuid.uuid4().hex}"
            if folder.startswith("file:") and not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir isn't set, and the warehouse is a folder of one machine")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
