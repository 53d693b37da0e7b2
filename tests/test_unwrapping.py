"""Two-dimensional unwrapping of surfaces with residues, however the image is cut into blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echograin.operators import unwrapping as uw


def surface(kind, h=40, w=52):
    r, c = np.indices((h, w)).astype(float)
    z = 9 * np.sin(r / 9) * np.cos(c / 13) + 0.012 * (r - 20) ** 2 + 0.25 * c
    if kind == "spikes":
        rng = np.random.default_rng(5)
        at = rng.choice(h * w, 60, replace=False)
        z.ravel()[at] += rng.uniform(1.6, 3.0, 60) * rng.choice([-1, 1], 60)
    if kind == "fault":  # slip of up to three quarters of a turn along a line that ends inside
        slip = 1.5 * np.pi * np.clip(1 - ((c - 26) / 20) ** 2, 0, None)
        z += np.where(r >= 20, slip, 0.0) * np.clip(1 - (r - 20) / 60, 0, 1)
    return z


def table(spark, surfaces):
    rows = [(k, int(r), int(c), float(np.angle(np.exp(1j * z[r, c])))) for k, z in surfaces.items() for r, c in np.ndindex(z.shape) if np.isfinite(z[r, c])]
    return spark.createDataFrame(rows, "tile string, row int, col int, phase double").repartition(6)


def unwrap(df, **more):
    return {(r["tile"], r["row"], r["col"]): (r["unwrapped"], r["component"]) for r in uw.unwrapped(df, ["tile"], **more).collect()}


def test_residues(spark):
    z = surface("spikes")
    got = {(r["row"], r["col"]): r["residue"] for r in uw.residues(table(spark, {"s": z}), ["tile"], "row", "col", "phase").collect()}
    p = np.angle(np.exp(1j * z))
    wrap = lambda x: x - 2 * np.pi * np.round(x / (2 * np.pi))
    d, a = wrap(np.diff(p, axis=0)), wrap(np.diff(p, axis=1))
    want = np.round((a[:-1] + d[:, 1:] - a[1:] - d[:, :-1]) / (2 * np.pi)).astype(int)
    assert len(got) == want.size and all(got[k] == want[k] for k in np.ndindex(want.shape)) and np.abs(want).sum() > 20


@pytest.mark.parametrize("block", [9, 64])
def test_surfaces_come_back(spark, block):
    surfaces = {k: surface(k) for k in ("plain", "spikes", "fault")}
    got = unwrap(table(spark, surfaces), block=block)
    for k, z in surfaces.items():
        # a spike that is over half a turn from its neighbours has no right number of turns; all others do
        known = z if k != "spikes" else np.where(np.abs(z - surface("plain")) > 0, np.nan, z)
        off = {round((got[k, r, c][0] - z[r, c]) / (2 * np.pi), 6) for r, c in np.ndindex(z.shape) if np.isfinite(known[r, c])}
        assert len(off) == 1 and off.pop() % 1 == 0, k
        assert len({got[k, r, c][1] for r, c in np.ndindex(z.shape)}) == 1
        assert got[k, 0, 0][0] == pytest.approx(np.angle(np.exp(1j * z[0, 0])))


def test_gaps_make_components_and_odd_images(spark):
    z = surface("plain", 20, 24)
    z[:, 11] = np.nan
    got = unwrap(table(spark, {"s": z}), block=8)
    assert len(got) == 20 * 23
    for side in (range(11), range(12, 24)):
        assert len({round((got["s", r, c][0] - z[r, c]) / (2 * np.pi), 6) for r in range(20) for c in side}) == 1 and len({got["s", r, c][1] for r in range(20) for c in side}) == 1
    one = spark.createDataFrame([("a", 3, 4, 1.5), ("b", 0, 0, None), ("b", 0, 1, float("nan"))], "tile string, row int, col int, phase double")
    assert {k: v[0] for k, v in unwrap(one).items()} == {("a", 3, 4): 1.5}
    assert unwrap(one.where(F.lit(False))) == {}
