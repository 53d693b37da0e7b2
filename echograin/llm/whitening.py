"""Embedding whitening from an exact integer scatter matrix.

A component c of a vector becomes the whole number x = floor(SCALE * c) +
OFFSET.  Every task subtracts the shift from its vectors and adds up their
number, sums and cross-products as whole numbers of any size: floating-point
products where they stay below 2^53 and are exact, 64-bit ones where they fit,
Python's else.  A task sends its totals in limbs of 32 bits, a row for each that
isn't 0, so the exact totals of all tasks are sums of longs.  The driver gets one number
for each entry of the upper triangle, forms n * X'X - S S' exactly, and only
then turns to floating point: V = that / n^2, correctly rounded, and its
eigenvectors by eigh.  A second pass projects (n * x - S) / n, and a third one
measures the covariance of what comes out.

Defined results: vectors that are null, empty or hold null or non-finite
entries are left out; vectors of each length are fitted among themselves, and
the driver holds one matrix a length; of a component without variance (less
than 1e-13 of the greatest) whitened and explained are 0 and identity_error
leaves it out; the sign makes the entry of greatest size positive; a vector of
fewer than ``components`` entries has as many components as entries; repeated
rows count each; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, OFFSET = 1024.0, 100_000
COMPONENTS = 8
#: Vectors that are worked on at a time.
BLOCK = 4096
#: Variances below this share of the greatest count as none.
NO_VARIANCE = 1e-13


def usable(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as doubles) of a list column, by length; without null, empty and non-finite vectors."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for length in np.unique(n[n > 0]).tolist():
        of_length = np.flatnonzero(n == length)
        for a in range(0, len(of_length), BLOCK):
            rows = of_length[a : a + BLOCK]
            values = pc.list_flatten(column.take(pa.array(rows))).cast(pa.float64())
            x = pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, length)
            good = np.isfinite(x).all(1)
            if good.any():
                yield rows[good], x[good]


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) without the offset, as 64-bit integers, or as Python's where they don't fit."""
    y = np.floor(vectors * SCALE)
    if np.isfinite(y).all() and np.abs(y).max() < 2.0**61:
        return y.astype(np.int64)
    from fractions import Fraction

    return np.array([[int(Fraction(float(c)) * int(SCALE) // 1) for c in row] for row in vectors], object)


def scatter(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact (sums, cross-products) of rows of whole numbers, as arrays of Python integers."""
    if y.dtype != object:
        most = max(1, int(np.abs(y).max()))
        if most * most * len(y) < 1 << 53:
            f = y.astype(np.float64)
            return f.sum(0).astype(np.int64).astype(object), (f.T @ f).astype(np.int64).astype(object)
        if most * most * len(y) < 1 << 62:
            return y.sum(0).astype(object), (y.T @ y).astype(object)
        y = y.astype(object)
    return y.sum(0), y.T @ y


def limbs(value: int) -> list[tuple[int, int]]:
    """A whole number as (k, limb): the sum of limb times 2^(32 k); limbs are below 2^32 and have its sign."""
    sign, value, out, k = 1 if value >= 0 else -1, abs(value), [], 0
    while value:
        if value & 0xFFFFFFFF:
            out.append((k, sign * (value & 0xFFFFFFFF)))
        value, k = value >> 32, k + 1
    return out


@dataclass(frozen=True)
class Fit:
    """Statistics of the vectors of one length."""

    n: int
    sums: tuple[int, ...]  #: of x
    covariance: np.ndarray
    components: np.ndarray  #: one a column
    variances: np.ndarray
    trace: float
    unit: int = 1  #: what covariance and trace are counted in: 1, or a power of two where they are beyond floating point

    @property
    def scales(self) -> np.ndarray:
        """1 / sqrt(variance) of each component, 0 where there is none."""
        some = self.variances > NO_VARIANCE * max(self.variances[0], 0.0)
        return np.where(some, 1 / np.sqrt(np.where(some, self.variances, 1.0)), 0.0)


def fit_from_totals(n: int, sums: list[int], products: list[list[int]], components: int) -> Fit:
    """The fit from exact totals of y = x - OFFSET: n, sums, and X'X."""
    d = len(sums)
    centred = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    unit = 1 << max(0, (max(abs(x) for row in centred for x in row).bit_length() - 2 * n.bit_length() - 900) // 2)
    v = np.array([[centred[i][j] / (n * unit) ** 2 for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:components]
    e, u = np.maximum(e[order], 0.0), u[:, order]
    u = u * np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])
    trace = sum(centred[i][i] for i in range(d)) / (n * unit) ** 2
    return Fit(n, tuple(s + n * OFFSET for s in sums), v, u, e, trace, unit)


_LIMBS = pa.schema([("d", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("k", pa.int32()), ("v", pa.int64())])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors to the exact totals of a task, (length, i, j, k, limb); i = j = -1 is the number of vectors, j = -1
    a sum."""
    found: dict[int, list] = {}
    for batch in batches:
        for rows, vectors in usable(batch.column(0)):
            s, p = scatter(whole_numbers(vectors))
            own = found.setdefault(vectors.shape[1], [0, 0, 0])
            own[0], own[1], own[2] = own[0] + len(rows), own[1] + s, own[2] + p
    for d, (n, s, p) in found.items():
        entries = [(-1, -1, n), *((i, -1, int(s[i])) for i in range(d)), *((i, j, int(p[i, j])) for i in range(d) for j in range(i, d))]
        rows = [(d, i, j, k, v) for i, j, value in entries for k, v in limbs(value)]
        for a in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[a : a + 10_000], strict=True), _LIMBS.types, strict=True)], schema=_LIMBS)


def fits(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of the vectors of each length.  Totals of all tasks are added up in tables; the driver gets a few rows an
    entry of a matrix."""
    totals = vectors.select(column).mapInArrow(_totals, "d int, i int, j int, k int, v long").groupBy("d", "i", "j", "k").agg(F.sum("v").alias("v"))
    by_length: dict[int, dict[tuple[int, int], int]] = {}
    for d, i, j, k, v in totals.toLocalIterator():
        own = by_length.setdefault(d, {})
        own[i, j] = own.get((i, j), 0) + (v << 32 * k)
    out = {}
    for d, v in by_length.items():
        out[d] = fit_from_totals(v[-1, -1], [v.get((i, -1), 0) for i in range(d)], [[v.get((min(i, j), max(i, j)), 0) for j in range(d)] for i in range(d)], components)
    return out


def _numerators(fit: Fit, y: np.ndarray) -> np.ndarray:
    """n * x - S, exact."""
    sums = [s - fit.n * OFFSET for s in fit.sums]
    if y.dtype != object and fit.n * max(1, int(np.abs(y).max())) + max(map(abs, sums)) < 1 << 62:
        return fit.n * y - np.array(sums, np.int64)
    return fit.n * y.astype(object) - np.array(sums, object)


def _squares(m: np.ndarray) -> list[int]:
    """Exact sum of the squares of each row."""
    if m.dtype != object:
        most = max(1, int(np.abs(m).max()))
        if most * most * m.shape[1] < 1 << 62:
            return (m * m).sum(1).tolist()
        m = m.astype(object)
    return (m * m).sum(1).tolist()


def projected(fit: Fit, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n * x - S, whitened) of vectors."""
    m = _numerators(fit, whole_numbers(vectors))
    centred = (m / (fit.n * fit.unit)).astype(np.float64)
    return m, centred @ fit.components * fit.scales


def _moments(known: dict[int, Fit]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for _, vectors in usable(batch.column(0)):
                d = vectors.shape[1]
                w = projected(known[d], vectors)[1]
                own = found.setdefault(d, [0, 0])
                own[0], own[1] = own[0] + w.sum(0), own[1] + w.T @ w
        rows = [(d, i, j, float(p[i, j]) if j >= 0 else float(s[i])) for d, (s, p) in found.items() for i in range(len(s)) for j in range(-1, len(s))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int32(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["d", "i", "j", "v"])

    return run


def identity_errors(vectors: DataFrame, known: dict[int, Fit], column: str = "embedding") -> dict[int, float]:
    """Largest entry of (covariance of the whitened vectors - identity), by length; measured on all of them."""
    rows = vectors.select(column).mapInArrow(_moments(known), "d int, i int, j int, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v")).collect()
    total = {(r["d"], r["i"], r["j"]): r["v"] for r in rows}
    out = {}
    for d, fit in known.items():
        k = fit.components.shape[1]
        mean = np.array([total[d, i, -1] / fit.n for i in range(k)])
        cov = np.array([[total[d, i, j] / fit.n for j in range(k)] for i in range(k)]) - np.outer(mean, mean)
        some = fit.scales > 0
        out[d] = float(np.abs(cov - np.eye(k))[np.ix_(some, some)].max(initial=0.0))
    return out


def whitened(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The columns of ``vectors`` other than the vector, and component, n, deviation (decimal of 38 digits; null beyond),
    whitened, explained and identity_error; one row for each vector that is left and each component.  Columns that are
    there already keep their names, and the new ones get a line behind theirs."""
    known = fits(vectors, column, components)
    errors = identity_errors(vectors, known, column) if known else {}
    keep = [c for c in vectors.columns if c != column]
    taken, names = {c.lower() for c in keep}, []
    for name in ("component", "n", "deviation", "whitened", "explained", "identity_error"):
        while name.lower() in taken:
            name += "_"
        names.append(name)
    kinds = (T.IntegerType(), T.LongType(), T.StringType(), T.DoubleType(), T.DoubleType(), T.DoubleType())
    schema = T.StructType([*(vectors.schema[c] for c in keep), *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])
    arrow = (pa.int32(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in usable(batch.column(len(keep))):
                fit = known[x.shape[1]]
                m, w = projected(fit, x)
                k = w.shape[1]
                share = fit.variances / fit.trace if fit.trace else np.zeros(k)
                at = pa.array(np.repeat(rows, k))
                new = [np.tile(np.arange(1, k + 1), len(rows)), np.full(len(rows) * k, fit.n), [str(v) for v in _squares(m) for _ in range(k)], w.ravel(), np.tile(np.where(fit.scales > 0, share, 0.0), len(rows)), np.full(len(rows) * k, errors[x.shape[1]])]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(keep))), *(pa.array(c, t) for c, t in zip(new, arrow, strict=True))], names=[*keep, *names])

    out = vectors.select(*keep, column).mapInArrow(run, schema)
    return out.withColumn(names[2], F.expr(f"try_cast(`{names[2]}` AS decimal(38, 0))"))


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    rows = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS long)"))
