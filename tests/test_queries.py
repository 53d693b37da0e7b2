"""Every registered query of the reference's operators against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from echograin.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "none"
    if isinstance(v, float):
        return f"{v + 0.0:.5g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    ref = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(ref.columns)
    columns = sorted(df.columns)
    at = [ref.columns.index(c) for c in columns]
    ours = sorted("|".join(plain(r[c]) for c in columns) for r in df.collect())
    assert ours == sorted("|".join(plain(r[k]) for k in at) for r in ref.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_interpolate_takes_all_events(spark):
    import numpy as np

    events = duckdb.sql(f"SELECT event_id, user_id, epoch_us(ts), value FROM '{DATA}/events.parquet'").fetchall()
    samples = [{} for _ in range(4)]
    for _, user, t, v in events:
        own = samples[user % 4]
        own[t] = max(v, own.get(t, v))
    got = {r["event_id"]: r["value"] for r in catalog.QUERIES["interpolate"](spark, DATA).collect()}
    assert len(got) == len(events)
    for g, known in enumerate([samples[(k + 1) % 4] for k in range(4)]):
        times = sorted(known)
        mine = [(i, t) for i, user, t, _ in events if user % 4 == g]
        start = times[0]
        want = np.interp([t - start for _, t in mine], [t - start for t in times], [known[t] for t in times])
        assert np.allclose([got[i] for i, _ in mine], want, atol=2e-3)


def test_vec_filters_return_all_samples(spark):
    import numpy as np

    vectors = dict(duckdb.sql(f"SELECT vec_id, embedding FROM '{DATA}/embeddings.parquet'").fetchall())
    for r in catalog.QUERIES["vec_filters"](spark, DATA).collect():
        x = np.array(vectors[r["vec_id"]], float)
        assert [len(r[c]) for c in ("low", "high", "band", "envelope", "acf", "down", "kaiser", "smooth")] == [64, 64, 64, 64, 9, 16, 64, 64]
        assert np.allclose(r["acf"], np.correlate(x, x, "full")[63:72], atol=1e-4)
        assert np.allclose(r["kaiser"], x * np.kaiser(64, 8.6), atol=1e-4) and np.allclose(r["smooth"], np.convolve(x, [1, 2, 1], "same"), atol=1e-4)
