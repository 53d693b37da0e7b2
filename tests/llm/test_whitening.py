"""Exact scatter and whitening against fractions and numpy, with odd vectors."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from echograin.llm import whitening as wh

VECTORS = "vec_id long, embedding array<float>, label int, n string, component int"


def rows(vectors, start=0):
    return [(start + i, v, 1, "n", 5) for i, v in enumerate(vectors)]


def plain(vectors):
    """(n, S, exact numerators, V, variances, components) by fractions and numpy."""
    x = [[math.floor(Fraction(float(np.float32(c))) * 1024) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    m = [[n * r[i] - s[i] for i in range(d)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in m), n**3)) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    return n, s, m, v, e[::-1], u[:, ::-1]


def check(got, vectors, ids):
    n, s, m, v, e, u = plain(vectors)
    k = min(8, len(vectors[0]))
    assert len(got) == n * k
    by = {(r["vec_id"], r["component_"]): r for r in got}
    for i, r in zip(ids, m, strict=True):
        for c in range(1, k + 1):
            row = by[i, c]
            assert row["n_"] == n and int(row["deviation"]) == sum(t * t for t in r) and row["n"] == "n" and row["component"] == 5
            assert math.isclose(row["explained"], e[c - 1] / np.trace(v), rel_tol=1e-9) and row["identity_error"] < 1e-9
    w = np.array([[by[i, c]["whitened"] for c in range(1, k + 1)] for i in ids])
    want = np.array([[t / n for t in r] for r in m]) @ u[:, :k] / np.sqrt(e[:k])
    want *= np.sign((want * w).sum(0))
    assert np.abs(w - want).max() < 1e-7
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-9


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    return (rng.normal(size=(150, 12)) * np.arange(1, 13) * 0.3).astype(np.float32).tolist()


def test_whitening_is_exact(spark, vectors):
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [None] * 12, [1.0] * 11 + [nan], [inf] + [0.0] * 11, [1.0] * 11 + [None]]
    data = rows(vectors) + rows(bad, 1000) + [(None, vectors[0], None, "n", 5)]
    df = spark.createDataFrame(data, VECTORS).repartition(6)
    got = wh.whitened(df).collect()
    kept = [r for r in got if r["vec_id"] is not None]
    assert len(got) - len(kept) == 8
    # the row without an id is one of the fit list
    check([{**r.asDict(), "vec_id": 150 if r["vec_id"] is None else r["vec_id"]} for r in got], [*vectors, vectors[0]], list(range(151)))


def test_totals_do_not_depend_on_the_split(spark, vectors):
    fits = [wh.fits(spark.createDataFrame(rows(vectors), VECTORS).repartition(p))[12] for p in (1, 3, 40)]
    for f in fits[1:]:
        assert f.n == fits[0].n and f.sums == fits[0].sums and np.array_equal(f.covariance, fits[0].covariance) and np.array_equal(f.components, fits[0].components)


def test_scatter_of_every_size():
    rng = random.Random(2)
    for most in (3, 10**4, 10**8, 10**12, 1 << 60):
        y = [[rng.randrange(-most, most) for _ in range(5)] for _ in range(50)]
        s, p = wh.scatter(np.array(y, np.int64))
        assert s.tolist() == [sum(r[i] for r in y) for i in range(5)]
        assert p.tolist() == [[sum(r[i] * r[j] for r in y) for j in range(5)] for i in range(5)]
        for v in (*s.tolist(), *p.ravel().tolist(), 0, -1, -(1 << 300)):
            assert sum(x << 32 * k for k, x in wh.limbs(v)) == v and all(abs(x) < 1 << 32 for _, x in wh.limbs(v))


def test_nearly_parallel_vectors_far_from_zero(spark):
    """Cancellation that floating-point moments would not survive: spread of some units beside an offset of 1e12."""
    rng = random.Random(8)
    base = [float(2**30) + k for k in range(4)]
    data = [[b + rng.randrange(-3, 4) / 1024 for b in base] for _ in range(60)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    fit = wh.fits(df)[4]
    x = [[math.floor(Fraction(c) * 1024) for c in v] for v in data]
    n = len(x)
    s = [sum(r[i] for r in x) for i in range(4)]
    want = [[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3)) for j in range(4)] for i in range(4)]
    assert np.allclose(fit.covariance, want, rtol=1e-15, atol=0) and fit.variances[0] < 100


def test_odd_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert wh.whitened(empty).count() == 0
    one = wh.whitened(spark.createDataFrame(rows([[1.0, 2.0]]), VECTORS)).collect()
    assert [(r["component_"], r["whitened"], r["explained"], int(r["deviation"]), r["identity_error"]) for r in one] == [(1, 0.0, 0.0, 0, 0.0), (2, 0.0, 0.0, 0, 0.0)]
    # two lengths are fitted apart; the second component of the first has no variance
    data = rows([[1.0, 5.0], [2.0, 5.0], [4.0, 5.0]]) + rows([[1.0], [3.0]], 10)
    got = {(r["vec_id"], r["component_"]): r for r in wh.whitened(spark.createDataFrame(data, VECTORS)).collect()}
    assert len(got) == 8 and got[0, 1]["n_"] == 3 and got[10, 1]["n_"] == 2
    assert all(got[i, 2]["whitened"] == 0.0 for i in range(3)) and abs(abs(got[10, 1]["whitened"]) - 1) < 1e-12
    huge = wh.whitened(spark.createDataFrame([(1, [1.7e308]), (2, [-1.7e308])], "vec_id long, embedding array<double>")).collect()
    assert [r["deviation"] for r in huge] == [None, None] and all(abs(abs(r["whitened"]) - 1) < 1e-9 for r in huge)


def test_query(spark):
    got = wh.op13_whitening(spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    r = {(x["vec_id"], x["component"]): x for x in got.collect()}
    data = {x["vec_id"]: x["embedding"] for x in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()}
    n, s, m, v, e, u = plain(list(data.values()))
    assert len(r) == 8 * n
    for (i, c), x in r.items():
        assert x["n"] == n and math.isclose(x["explained"], e[c - 1] / np.trace(v), rel_tol=1e-9) and x["identity_error"] < 1e-9
    for i, t in zip(data, m, strict=True):
        assert r[i, 1]["deviation"] == sum(y * y for y in t)
