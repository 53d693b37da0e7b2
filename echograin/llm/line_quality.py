"""Quality rules with cross-document line frequency.

Per-document rules come first (too few words, too many repeated windows).  Then
every line is normalised (lower case, words joined by one space) and hashed,
and the distinct documents that hold it are counted per host.  A line found in
more than ``min_docs`` documents and in more than ``max_share`` of its host's
is removed; a document that loses lines and keeps fewer than ``min_words``
words or less than ``min_left`` of its words is depleted and not kept.  With
``copies_once`` documents of the same text count as one, so that a widely
copied document doesn't turn its own lines into boilerplate.

Only built-in expressions.  The documents are read once; their counts and line
hashes are written as a table, from which all further steps read.  All counts
are sums with a map-side part, so a line that stands in every document reaches
the shuffle once a task.  At most ``1 / max_share`` times a host's mean number
of lines can be above the limit, so the table of removed lines is small beside
the documents; it is joined as the optimizer sees fit (broadcast under its size
threshold, else sort-merge with split skewed partitions).

Defined results: a null text has no words, fails the base rules and isn't
kept; a null host is a host of its own; repeated rows each get their row, and
rows that share a doc_id count as one document (rows without one together as
one); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import shared_table

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def words_of(text: Column) -> Column:
    """Words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _repeated_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: the words in windows that stand twice or more in the text."""
    n, last = F.size("words"), F.size("h") - 1
    df = df.withColumn("h", F.when(n > WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(F.slice("words", i + 1, WINDOW)))))
    # only texts in which a window repeats go the way of sorting
    df = df.withColumn("h", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.col("h")))
    df = df.withColumn("s", F.when(F.col("h").isNotNull(), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))

    def same(k: Column, j: Column) -> Column:
        return F.coalesce(F.get("s", k)["x"] == F.get("s", j)["x"], F.lit(False))

    found = F.filter(F.sequence(F.lit(0), last), lambda k: same(k, k + 1) | ((k > 0) & same(k, F.greatest(k - 1, F.lit(0)))))
    df = df.withColumn("at", F.when(F.col("s").isNotNull(), F.sort_array(F.transform(found, lambda k: F.get("s", k)["i"]))))
    step = F.transform("at", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - x, F.lit(WINDOW))))
    covered = F.aggregate(step, F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(F.when(F.col("at").isNotNull(), covered), F.lit(0)).cast("long")).drop("h", "s", "at")


def base_rules(docs: DataFrame, min_words: int = 20, max_repeat_percent: int = 30, *more: str | Column) -> DataFrame:
    """doc_id and ``more`` of every document, its counts, and whether it fails the rules on them."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select("doc_id", text.alias("text"), words_of(F.col("text")).alias("words"), lines.alias("lines"), F.struct(F.lit(0), *more).alias("more"))
    df = _repeated_words(df)
    spaceless = _without(F.col("text"), " \n\t\r\x0b\x0c")
    counts = df.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(spaceless).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        "lines",
        F.col("more.*"),
    )
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    return counts.withColumn("base_failed", failed)


def frequent_lines(lines: DataFrame, max_share: float = 0.05, min_docs: int = 10) -> DataFrame:
    """The (host, line) of lines (host, line, doc) found in more than min_docs and max_share of the host's distinct documents."""
    held = lines.groupBy("host", "line", "doc").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > min_docs)
    hosts = lines.groupBy("host", "doc").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("host_docs"))
    of_host = held["host"].eqNullSafe(hosts["host"])
    return held.join(hosts, of_host).where(F.col("n_docs") > max_share * F.col("host_docs")).select(held["host"], "line", "n_docs")


def line_frequency_rules(docs: DataFrame, host: str = "source", max_share: float = 0.05, min_docs: int = 10, min_words: int = 20, min_left: float = 0.3, copies_once: bool = False) -> DataFrame:
    """Base rules, then the words that frequent lines take away, then the verdict ``kept``."""
    doc = F.xxhash64(F.coalesce("text", F.lit(""))) if copies_once else F.col("doc_id")
    counts = base_rules(docs, min_words, 30, F.col(host).alias("host"), doc.alias("doc"))
    normal = F.transform("lines", lambda x: words_of(F.lower(x)))
    hashed = F.transform(normal, lambda w: F.struct(F.xxhash64(w).alias("line"), F.size(w).alias("words")))
    # written once; the number of a row is fixed from then on
    counts = shared_table(counts.withColumn("lines", hashed).withColumn("row", F.monotonically_increasing_id()))
    lines = counts.select("row", "host", "doc", F.explode("lines").alias("at")).select("row", "host", "doc", "at.line", "at.words")
    limit = frequent_lines(lines, max_share, min_docs)
    hit = lines.join(limit, lines["host"].eqNullSafe(limit["host"]) & (lines["line"] == limit["line"]), "left_semi")
    lost = hit.groupBy("row").agg(F.sum("words").alias("lost"))
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    depleted = F.col("lost").isNotNull() & ((left < min_words) | (left < min_left * F.col("n_words")))
    return counts.join(lost, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~depleted).alias("kept"),
        F.coalesce("lost", F.lit(0)).alias("n_removed_words"),
    )


def op1_line_quality(spark, sf_dir: str) -> DataFrame:
    return line_frequency_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, source FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT r, i, ws[i:i+7] AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8) t),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) t WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest(range(8)) AS o) z GROUP BY r),
ln AS (SELECT r, pos, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d) t
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY r),
norm AS (SELECT r, pos, source, doc_id, array_to_string(ws, ' ') AS line, len(ws) AS n
         FROM (SELECT d.r, pos, source, coalesce(doc_id, -1) AS doc_id, list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM ln JOIN d USING (r)) t),
hosts AS (SELECT source, count(DISTINCT doc_id) AS n FROM norm GROUP BY source),
freq AS (SELECT n.source, n.line FROM (SELECT source, line, count(DISTINCT doc_id) AS c FROM norm GROUP BY source, line) n
         JOIN hosts h ON h.source IS NOT DISTINCT FROM n.source WHERE c > 10 AND c > 0.05 * h.n),
lost AS (SELECT r, sum(n)::BIGINT AS n FROM norm JOIN freq f ON f.source IS NOT DISTINCT FROM norm.source AND f.line = norm.line GROUP BY r),
b AS (
  SELECT d.r, d.doc_id, len(w.ws)::BIGINT AS n_words, length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_removed_words
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN cov USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
       AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < 20 OR n_words - n_removed_words < 0.3 * n_words)) AS kept,
       n_removed_words
FROM b
"""
