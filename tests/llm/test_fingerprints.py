"""One-permutation MinHash against a plain version, its estimates against full sets, and odd rows."""

import random
import re
from hashlib import md5, sha256

import pytest
from pyspark.sql import functions as F

from echograin.llm import fingerprints as fp

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, fingerprint string, key long, next int, need int"


def shingles(text):
    w = [int(md5(x.encode()).hexdigest()[:8], 16) % fp.PRIME for x in WORD.findall(text or "")]
    runs = [w[i : i + 5] for i in range(len(w) - 4)] if len(w) >= 5 else [w] if w else []
    out = set()
    for run in runs:
        h = 0
        for x in run:
            h = (h * fp._NEXT_WORD + x) % fp.PRIME
        out.add(h)
    return out


def plain_fingerprint(text):
    bins = {}
    for h in shingles(text):
        v = (h * fp._RANK + fp._SHIFT) % fp.PRIME
        bins[h % 256] = min(v, bins.get(h % 256, v))
    if not bins:
        return ""
    out = ""
    for i in range(256):
        look = [i, *(t[i] for t in fp._TRIED), *sorted(bins, key=lambda b: (b + 1) * fp._OF_BIN[i] % fp.PRIME)]
        out += f"{bins[next(b for b in look if b in bins)] * fp._OF_BIN[i] % fp.PRIME >> 27:x}"
    return out


def rows(texts):
    return [(i, t, "en", "f", 1, 2, 3) for i, t in texts]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    prose = lambda n: "".join(rng.choice(["the", "of", "naïve", "日本", "a\x1cb"] + [f"w{k}" for k in range(200)]) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(n))
    out = [(3 * k, prose(rng.randrange(1, 300))) for k in range(40)]
    out += [(200, None), (201, ""), (202, " \n "), (203, "one"), (204, "one"), (205, "a b c d"), (206, "word " * 500), (207, prose(12000)), (208, "x" * 4000), (209, out[3][1]), (210, "日本🤗" * 9)]
    return out


def test_fingerprints_edits_and_likeness(spark, texts):
    df = spark.createDataFrame(rows(texts), DOCS).repartition(5)
    got = {r["doc_id"]: r for r in fp.edited_fingerprints(df).select("*", fp.as_text(F.col("fingerprint")).alias("f"), fp.as_text(F.col("edited_fingerprint")).alias("e"), fp.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near")).collect()}
    assert len(got) == len(texts)
    ordered = sorted(texts)
    for k, (i, t) in enumerate(ordered):
        t, ahead = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + ahead[:q]
        assert got[i]["edited"] == edited and got[i]["f"] == plain_fingerprint(t) and got[i]["e"] == plain_fingerprint(edited)
        a, b = shingles(t), shingles(edited)
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(got[i]["near"] - true) < 0.15
    assert got[203]["f"] == got[204]["f"] and got[9]["f"] == got[209]["f"] and len(got[9]["f"]) == 256


def test_estimates_of_few_and_many_shingles(spark):
    """Densified and crowded bins both keep the estimate near the true share."""
    rng, data, want = random.Random(9), [], []
    for n in (1, 3, 20, 100, 400, 3000):
        for share in (0.0, 0.3, 0.75, 1.0):
            words = [f"s{rng.randrange(10**9)}" for _ in range(n + 4)]
            cut = round((n + 4) * 2 * share / (1 + share))
            other = words[:cut] + [f"o{rng.randrange(10**9)}" for _ in range(n + 4 - cut)]
            a, b = " ".join(words), " ".join(other)
            data.append((len(data), a, b))
            want.append(len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)))
    df = spark.createDataFrame(data, "id int, a string, b string")
    df = fp.with_fingerprint(fp.with_fingerprint(df, "a", "fa"), "b", "fb").select("id", fp.likeness(F.col("fa"), F.col("fb")).alias("near"))
    for r in df.collect():
        assert abs(r["near"] - want[r["id"]]) < 0.12, (data[r["id"]][1][:40], r["near"], want[r["id"]])


def test_odd_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert fp.edited_fingerprints(empty).count() == 0
    alone = fp.edited_fingerprints(spark.createDataFrame(rows([(5, "abcdefgh")]), DOCS)).collect()
    assert [(r["doc_id"], r["edited"]) for r in alone] == [(5, "abcdefab")]
    # a null id comes first; rows of one id follow the same document and all stay
    data = [(None, "nnnnnnnn"), (1, "aaaaaaaa"), (1, "aaaaaaaa"), (1, "bbbb"), (9, "cccccccc")]
    got = fp.edited_fingerprints(spark.createDataFrame(rows(data), DOCS)).collect()
    assert sorted((r["doc_id"] or 0, r["edited"]) for r in got) == [(0, "nnnnnnbb"), (1, "aaaaaacc"), (1, "aaaaaacc"), (1, "bbbc"), (9, "ccccccnn")]


def test_successors_over_many_ranges(spark):
    keys = random.Random(1).sample(range(-(10**12), 10**12), 3000)
    df = spark.createDataFrame([(k,) for k in keys + keys[:50]], "key long").repartition(7)
    got = {r["key"]: r["next"] for r in fp.successors(df).collect()}
    ordered = sorted(keys)
    assert got == dict(zip(ordered, ordered[1:] + ordered[:1], strict=True))


def test_query_digests(spark):
    got = {r["doc_id"]: r for r in fp.op11_fingerprints(spark, "/root/testdata/sf0.001").collect()}
    data = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ids = sorted(data)
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        t, q = data[a], len(data[a]) // 4
        assert got[a]["n_chars"] == len(t) and got[a]["edited_sha256"] == sha256((t[: len(t) - q] + data[b][:q]).encode()).hexdigest()
        assert got[a]["near_edited"] >= got[a]["near_next"]
