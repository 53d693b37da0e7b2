"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all the rows of docs; all
but the last return rows with the columns of documents.  Toxic documents go,
then documents of poor quality, then all but one document of each group of
near-duplicates; passages that stand in earlier documents are cut out (a
document that loses all its words goes, n_chars follows the text); what is left
is packed into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echograin.llm import line_crf, minhash, packing, substring_dedup, toxicity
from echograin.llm.shared import shared_table


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity is below the threshold; null and empty texts have the score of a text without features."""
    return toxicity.reject_toxic(docs, _labels(spark, sf_dir))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose quality reaches the threshold; null and empty texts have the least quality."""
    return line_crf.reject_poor(docs, _labels(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates, with all rows of that id; texts without words, and rows without an id, stay."""
    return minhash.drop_near_duplicates(docs).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages that stand in earlier ones; those that lose all their words go, texts without words stay as they are."""
    left = substring_dedup.remove_repeats(docs)
    n_words, n_removed = (F.col(c) for c in left.columns[-2:])
    left = left.where((n_removed == 0) | (n_removed < n_words))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; a text without tokens is one piece, its end id."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("MinHash near-dedup", drop_copies),
    ("substring dedup", cut_repeats),
    ("best-fit packing", pack),
]

#: Learnt models, a signature search and a genetic search are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
