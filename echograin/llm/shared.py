"""Tables between the jobs of one query, and joins that hold with hot keys."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that a task gets in a spread join, and the most keys that are dealt out so.
PER_TASK, MOST_KEYS = 500, 10_000


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark's file systems keep it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset, as in tests, a folder of its own in the warehouse, which
    on a cluster mustn't be a folder of one machine; that one goes when the process ends."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/echograin-{uuid.uuid4().hex}"
        if found.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set, and the warehouse is a folder of one machine")
        spark.sparkContext.setCheckpointDir(found)

        def clean() -> None:
            if spark.sparkContext._jsc is not None:
                remove_folder(spark, found)

        atexit.register(clean)
    return found.rstrip("/")


def table_path(spark: SparkSession) -> str:
    """A path for a new table in the shared folder."""
    return f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"


def shared_table(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there and a lost executor loses nothing of it."""
    path = path or table_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, salts): the keys with more than PER_TASK rows, and how many tasks share each.  At most MOST_KEYS, the
    largest; any other has less than one in MOST_KEYS of all rows, which one task can take."""
    many = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > PER_TASK)
    return shared_table(many.orderBy(F.desc("n"), key).limit(MOST_KEYS).select(key, F.ceil(F.col("n") / PER_TASK).cast("int").alias("salts")))


def spread_join(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame, by: str, how: str = "left", hint: str | None = None) -> DataFrame:
    """rows joined to a table of one row a key.  The rows of a hot key are dealt over its salts by a hash of the column
    ``by``, and its row of the table is copied for each; ``hot`` is hot_keys(rows, key)."""
    salts = F.broadcast(hot)
    left = rows.join(salts, key, "left").withColumn("__salt", F.pmod(F.xxhash64(by), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    right = table.join(salts, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return left.join(right.hint(hint) if hint else right, [key, "__salt"], how).drop("__salt")
