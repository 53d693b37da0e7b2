"""Definitions that are fixed by what products and their readers mean."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echograin.functions import products
from echograin.operators import focusing, summaries, tile_checks


def test_variants(spark):
    df = spark.createDataFrame([(v, k) for v in ("SSC", "SLC", "MGD", "GRD", "GEC", "EEC", None) for k in ("COMPLEX", "DETECTED", None)], "variant string, image_data_type string")
    m = F.struct("variant", "image_data_type", F.lit(None).cast("string").alias("projection"), F.lit(None).cast("string").alias("map_projection"))
    got = {(r[0], r[1]): tuple(r[2:]) for r in df.select("variant", "image_data_type", tile_checks.is_complex(m), tile_checks.is_detected(m), tile_checks.is_geocoded(m)).collect()}
    for (v, k), found in got.items():
        assert found == (v in ("SSC", "SLC") or k == "COMPLEX", v in ("MGD", "GRD") or k == "DETECTED", v in ("EEC", "GEC"))


def test_band_groups_and_passes(spark):
    names = {"C11": "cov_diag", "C12": "cov_diag", "C123": "cov_diag", "C1": "other", "ReC12": "cov_cross", "ImC13": "cov_cross", "q_C12": "other", "c11": "other", "C11x": "other"}
    df = spark.createDataFrame([(k,) for k in names], "band string")
    assert {r[0]: r[1] for r in df.select("band", summaries.band_group(F.col("band"))).collect()} == names
    meta = [({"PASS": " ascending "}, "ASC"), ({"pass": "DESCENDING"}, "DESC"), ({"PASS": " ", "pass_direction": "des"}, "DES"), ({"PASS_DIRECTION": "left"}, "LEFT"), ({"orbitPassDirection": "Asc"}, "ASC"), ({"orbit_direction": "ASC"}, "UNKNOWN"), ({}, "UNKNOWN")]
    df = spark.createDataFrame([(k, m) for k, (m, _) in enumerate(meta)], "k int, m map<string,string>")
    assert {r[0]: r[1] for r in df.select("k", products.pass_direction(F.col("m"))).collect()} == {k: want for k, (_, want) in enumerate(meta)}


def plain_support(e, least=0.15):
    n, mid = len(e), len(e) // 2
    shift = mid - int(np.argmax(e))
    strong = np.roll(e, shift) >= e.max() * 10**-2.5
    lo = hi = mid
    while lo > 0 and strong[lo - 1]:
        lo -= 1
    while hi < n - 1 and strong[hi + 1]:
        hi += 1
    size = max(2, round(least * n))
    size += size % 2
    if hi - lo + 1 < size:
        lo = max(0, mid - size // 2)
        hi = min(n - 1, lo + size - 1)
    if (hi - lo) % 2 == 0:
        if hi < n - 1:
            hi += 1
        elif lo > 0:
            lo -= 1
    return lo, hi + 1, int(np.argmax(e)), shift


@pytest.mark.parametrize("n", [7, 40, 41])
def test_spectral_support(spark, n):
    rng = np.random.default_rng(n)
    profiles = {}
    for k in range(12):
        e = np.full(n, 1e-5)
        width, centre = rng.integers(1, n + 1), rng.integers(0, n)
        e[(centre + np.arange(width)) % n] = rng.uniform(0.5, 1, width)
        profiles[k] = e
    df = spark.createDataFrame([(k, i, float(x)) for k, e in profiles.items() for i, x in enumerate(e)], "tile int, bin int, power double")
    got = {r["tile"]: (r["start"], r["stop"], r["peak"], r["shift"]) for r in focusing.spectral_support(df, ["tile"], "bin").collect()}
    assert got == {k: plain_support(e) for k, e in profiles.items()}
