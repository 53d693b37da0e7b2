"""Document fingerprints by one-permutation MinHash.

A text's set holds the hashes of its distinct runs of ``SHINGLE`` words (with
fewer words, of all its words as one).  One hash function deals the set over
``BINS`` bins by its low bits and ranks it within them: the hashes, sorted with
one sentinel a bin, give the minimum of every bin in one pass over the text.
An empty bin takes the minimum of another by optimal densification: it looks at
bins drawn by a hash of its own number, the same ones for every text, until one
is filled; after ``TRIES`` of them the filled bin that ranks first for it is
taken at once, which is where the walk would end on average too.  Of each bin
``BITS`` bits of a hash of the minimum and the bin are kept, 16 bins to a long.
Bins whose minima differ agree in them by chance once in 16; likeness() takes
that out of the share of equal bins.

All of it is one row's work in built-in expressions.  Only the next document
costs shuffles: ids alone are sorted by ranges, and the first quarter of the
next text and its fingerprint come back by two joins on ids.

Defined results: a null text is the empty text; texts without words have the
empty fingerprint, which is like another empty one (1) and unlike all others
(0); a null doc_id comes before all others; rows that share a doc_id follow the
same document, and as a next document those of their texts count whose needed
first part is greatest; the only document follows itself; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_table

SHINGLE, BINS, BITS, TRIES = 5, 256, 4, 6
#: Hashes are whole numbers below this prime, so that products fit a long here and in SQL.
PRIME = (1 << 31) - 1
#: Multipliers of the hash functions: powers of one primitive root.
_ROOTS = [pow(48271, k, PRIME) for k in range(1, 401)]
_OF_BIN, (_RANK, _SHIFT, _NEXT_WORD) = _ROOTS[:BINS], _ROOTS[300:303]
#: Bins that an empty bin looks at, one list a try.
_TRIED = [[(i * _ROOTS[310 + 2 * t] + _ROOTS[311 + 2 * t]) % PRIME % BINS for i in range(1, BINS + 1)] for t in range(TRIES)]
_SPACE = " \t\n\x0b\x0c\r"


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<bigint>")


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with one more column: the fingerprint of a text column, BINS * BITS bits in longs; the empty array without words."""
    columns = df.columns
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(_SPACE))
    word = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % PRIME
    out = df.select("*", F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(trimmed, r"[\x20\x09-\x0D]+"), word)).alias("__words"))

    append = lambda acc, w: (acc * _long(_NEXT_WORD) + w) % PRIME

    def shingle(i: Column) -> Column:
        h = F.get("__words", i)
        for k in range(1, SHINGLE):
            h = append(h, F.get("__words", i + k))
        return h

    n = F.size("__words")
    hashes = F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(0), n - SHINGLE), shingle)).otherwise(F.array(F.aggregate("__words", _long(0), append)))
    # bin above, rank within it below; the sentinel of a bin comes after its ranks
    ranked = F.transform(hashes, lambda h: F.shiftleft(h % BINS, 31).bitwiseOR((h * _long(_RANK) + _long(_SHIFT)) % PRIME))
    sentinels = _longs([(i << 31) + PRIME for i in range(BINS)])
    out = out.select(*columns, "__words", F.sort_array(F.concat(ranked, sentinels)).alias("__sorted"))
    first = F.filter("__sorted", lambda x, i: (i == 0) | (F.shiftright(x, 31) != F.shiftright(F.get("__sorted", i - 1), 31)))
    out = out.select(*columns, "__words", first.alias("__first"))
    minimum = F.transform("__first", lambda x: F.when(x.bitwiseAND(PRIME) != PRIME, x.bitwiseAND(PRIME)))
    out = out.select(*columns, "__words", F.filter("__first", lambda x: x.bitwiseAND(PRIME) != PRIME).alias("__filled"), minimum.alias("__minimum"))

    def kept(x: Column, i: Column) -> Column:
        own = F.get(_longs(_OF_BIN), i)
        tried = [F.get("__minimum", F.get(F.array(*[F.lit(j) for j in t]), i)) for t in _TRIED]
        ranks = F.transform("__filled", lambda y: F.shiftleft((F.shiftright(y, 31) + 1) * own % PRIME, 31).bitwiseOR(y.bitwiseAND(PRIME)))
        return F.shiftright(F.coalesce(x, *tried, F.array_min(ranks).bitwiseAND(PRIME)) * own % PRIME, 31 - BITS)

    out = out.select(*columns, "__words", F.transform("__minimum", kept).alias("__kept"))
    per = 64 // BITS
    pack = lambda k: F.aggregate(F.slice("__kept", k * per + 1, per), _long(0), lambda acc, v: F.shiftleft(acc, BITS).bitwiseOR(v))
    packed = F.array(*[pack(k) for k in range(BINS // per)])  # one expression a long: in a lambda __kept would be made anew for each
    return out.select(*columns, F.when(n == 0, F.array().cast("array<bigint>")).otherwise(packed).alias(name))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins of two fingerprints without those that agree by chance, 0 to 1."""

    def unequal(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for shift in (1, 2):
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
        return F.bit_count(z.bitwiseAND(_long(0x1111111111111111)))

    n = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda acc, v: acc + v)
    chance = 1 / (1 << BITS)
    share = F.greatest((1 - n / BINS - chance) / (1 - chance), F.lit(0.0))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(share)


def as_text(packed: Column) -> Column:
    """A fingerprint in hexadecimal digits, one a bin."""
    return F.lower(F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 64 // BITS, "0")), ""))


def successors(keys: DataFrame) -> DataFrame:
    """(key, next): each distinct key with the next larger one, the largest with the smallest.  Keys are cut into ranges
    by a sample and written with their range, so that no window is over more than one range; the ranges' first keys,
    one row each, are ordered in one task."""
    ranged = shared_table(keys.distinct().repartitionByRange("key").withColumn("range", F.spark_partition_id()))
    firsts = ranged.groupBy("range").agg(F.min("key").alias("first"))
    everywhere = Window.orderBy("range")
    after = firsts.select("range", F.coalesce(F.lead("first").over(everywhere), F.first("first").over(everywhere)).alias("after"))
    inside = F.lead("key").over(Window.partitionBy("range").orderBy("key"))
    return ranged.withColumn("inside", inside).join(F.broadcast(after), "range").select("key", F.coalesce("inside", "after").alias("next"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text, edited, fingerprint, edited_fingerprint, next_fingerprint) of every row of docs: the text, the text whose last
    quarter is replaced by the first part of the next document, and the fingerprints of both and of the next document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    lowest = _long(-(1 << 63))
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), lowest).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    wanted = base.groupBy("key").agg(F.max(F.floor(F.length("text") / 4).cast("int")).alias("need"))
    wanted = wanted.join(successors(base.select("key")), "key").select(F.col("key").alias("before"), "next", "need")
    # one exchange of the texts by id serves both joins
    base = with_fingerprint(base, "text", "fingerprint")
    ahead = base.join(wanted.hint("merge"), F.col("key") == F.col("next")).select("before", F.struct(F.expr("substring(text, 1, need)").alias("head"), F.col("fingerprint").alias("fp")).alias("ahead"))
    ahead = ahead.groupBy("before").agg(F.max("ahead").alias("ahead"))
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.substring("ahead.head", F.lit(1), quarter))
    rows = base.join(ahead.hint("merge"), F.col("key") == F.col("before"))
    rows = rows.select(F.when(F.col("key") != lowest, F.col("key")).cast(kind).alias("doc_id"), "text", edited.alias("edited"), "fingerprint", F.col("ahead.fp").alias("next_fingerprint"))
    return with_fingerprint(rows, "edited", "edited_fingerprint")


def op11_fingerprints(spark, sf_dir: str) -> DataFrame:
    rows = edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("fingerprint")).alias("fingerprint"), as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def _sql() -> str:
    word = f"('0x' || substr(md5(x), 1, 8))::BIGINT % {PRIME}"
    shingle = "w[i]"
    for k in range(1, SHINGLE):
        shingle = f"(({shingle}) * {_NEXT_WORD} + w[i + {k}]) % {PRIME}"
    tried = ", ".join(f"m[[{', '.join(str(j + 1) for j in t)}][i]]" for t in _TRIED)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, length(text) // 4 AS q, coalesce(lead(text) OVER o, first_value(text) OVER o) AS ahead, coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id FROM d WINDOW o AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, left(text, length(text) - q) || left(ahead, q) AS edited FROM n),
u AS (SELECT doc_id, 0 AS side, text AS t FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
w AS (SELECT doc_id, side, list_transform(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> ''), lambda x: {word}) AS w FROM u),
h AS (SELECT doc_id, side, {shingle} AS h FROM (SELECT doc_id, side, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM w WHERE len(w) >= {SHINGLE}) t
  UNION ALL SELECT doc_id, side, list_reduce(w, lambda acc, x: (acc * {_NEXT_WORD} + x) % {PRIME}, 0::BIGINT) FROM w WHERE len(w) BETWEEN 1 AND {SHINGLE - 1}),
b AS (SELECT doc_id, side, h % {BINS} AS bin, min((h * {_RANK} + {_SHIFT}) % {PRIME}) AS v FROM h GROUP BY ALL),
g AS (SELECT k.doc_id, k.side, list(b.v ORDER BY i) AS m, list({{'f': b.bin + 1, 'v': b.v}}) FILTER (b.v IS NOT NULL) AS filled
  FROM (SELECT doc_id, side, unnest(range({BINS})) AS i FROM (SELECT DISTINCT doc_id, side FROM b)) k LEFT JOIN b ON b.doc_id = k.doc_id AND b.side = k.side AND b.bin = k.i GROUP BY ALL),
a AS (SELECT {_OF_BIN} AS a),
x AS (SELECT doc_id, side, i, coalesce(m[i], {tried}, list_min(list_transform(filled, lambda y: (y.f * a[i] % {PRIME}) * {1 << 31} + y.v)) % {1 << 31}) * a[i] % {PRIME} // {1 << (31 - BITS)} AS v
  FROM (SELECT g.*, a.a, unnest(range(1, {BINS + 1})) AS i FROM g, a) t),
p AS (SELECT doc_id, side, string_agg('0123456789abcdef'[v + 1], '' ORDER BY i) AS p FROM x GROUP BY ALL),
f AS (SELECT e.doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, coalesce(p0.p, '') AS fp, coalesce(p1.p, '') AS ep, coalesce(p2.p, '') AS np
  FROM e LEFT JOIN p p0 ON p0.doc_id = e.doc_id AND p0.side = 0 LEFT JOIN p p1 ON p1.doc_id = e.doc_id AND p1.side = 1 LEFT JOIN p p2 ON p2.doc_id = e.next_id AND p2.side = 0)
SELECT doc_id, n_chars::BIGINT AS n_chars, edited_sha256, fp AS fingerprint, ep AS edited_fingerprint,
  CASE WHEN fp = '' OR ep = '' THEN (fp = ep)::INT::DOUBLE ELSE greatest((1 - hamming(fp, ep) / {BINS}.0::DOUBLE - {1 / (1 << BITS)}) / {1 - 1 / (1 << BITS)}, 0.0)::DOUBLE END AS near_edited,
  CASE WHEN fp = '' OR np = '' THEN (fp = np)::INT::DOUBLE ELSE greatest((1 - hamming(fp, np) / {BINS}.0::DOUBLE - {1 / (1 << BITS)}) / {1 - 1 / (1 << BITS)}, 0.0)::DOUBLE END AS near_next
FROM f
"""


SQL = _sql()
