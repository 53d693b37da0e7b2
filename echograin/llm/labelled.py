"""Which labelled rows a classifier may learn from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier sees in training: crc32 of the id as text is 2 modulo 4.  A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def sample_ids(rows: DataFrame, n: int, *more: str) -> DataFrame:
    """At most n distinct doc_id of ``rows`` (with a column of each of ``more``) that may be learnt from, the same ones each time."""
    ids = rows.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(*[F.max(c).alias(c) for c in more] or [F.lit(1).alias("one")])
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def sampled_texts(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(mark, text) of the sampled ids: one row for each (doc_id, mark) of ``marks``, whatever rows share a doc_id; of
    their texts the greatest counts.  ``marks`` is bounded by the sizes of the samples."""
    rows = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")
    return rows.groupBy("doc_id", "mark").agg(F.max("text").alias("text")).select("mark", "text")
