"""Signal kernels over arrays and over lines of a raster.

A line of a raster is an array column (re, im); kernels run on batches of lines
as Arrow functions, on views of the batch's numbers, so a task holds some lines, never an image.
A two-dimensional transform is two passes with a transpose between: lines by
row, then lines by column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPLEX_LINE = "struct<re: array<double>, im: array<double>>"


def _rows(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Views of the lists of an Arrow column, numbers as double and null ones as NaN; None for a null list."""
    if pa.types.is_null(column.type):
        yield from (None for _ in range(len(column)))
        return
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    for k, known in enumerate(column.is_valid().to_numpy(zero_copy_only=False)):
        yield flat[offsets[k] : offsets[k + 1]] if known else None


def _lists(found: Sequence[np.ndarray | None]) -> pa.Array:
    """Arrays as one Arrow column of lists; None is a null list."""
    offsets = np.append(0, np.cumsum([0 if x is None else len(x) for x in found])).astype(np.int32)
    flat = np.concatenate([x for x in found if x is not None] or [np.zeros(0)])
    null = pa.array([x is None for x in found], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.float64()), mask=null)


def complex_kernel(kernel: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column, Column], Column]:
    """A function of one complex line as a column function of (re, im) arrays; null lines stay null."""

    @F.arrow_udf(COMPLEX_LINE)
    def run(re: pa.Array, im: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(_rows(re), _rows(im), strict=True):
            out.append(None if a is None else np.asarray(kernel(a + (1j * b if b is not None else 0)), complex))
        return pa.StructArray.from_arrays([_lists([z if z is None else z.real for z in out]), _lists([z if z is None else z.imag for z in out])], names=["re", "im"])

    return run


def real_kernel(kernel: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """A function of one real line as a column function of an array."""

    @F.arrow_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        return _lists([None if v is None else np.asarray(kernel(v), float) for v in _rows(x)])

    return run


def fft_1d() -> Callable:
    return complex_kernel(np.fft.fft)


def ifft_1d() -> Callable:
    return complex_kernel(np.fft.ifft)


def analytic(x: np.ndarray) -> np.ndarray:
    """The signal with its Hilbert transform as imaginary part."""
    n = x.shape[-1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0 and n:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * gain)


def hilbert() -> Callable:
    return complex_kernel(analytic)


def envelope() -> Callable:
    return real_kernel(lambda x: np.abs(analytic(x)))


def butterworth(x: np.ndarray, low: float | None, high: float | None, rate: float, order: int = 5) -> np.ndarray:
    """Zero-phase Butterworth response, applied forwards and backwards in the frequency domain."""
    f = np.abs(np.fft.fftfreq(len(x), 1 / rate))
    gain = np.ones(len(x))
    warped = np.tan(np.pi * np.minimum(f, rate / 2 * (1 - 1e-9)) / rate)
    if high is not None:
        gain /= 1 + (warped / np.tan(np.pi * high / rate)) ** (2 * order)
    if low is not None:
        with np.errstate(divide="ignore"):
            gain /= 1 + (np.tan(np.pi * low / rate) / warped) ** (2 * order)
    out = np.fft.ifft(np.fft.fft(x) * gain)
    return out if np.iscomplexobj(x) else out.real


def lowpass(cutoff: float, rate: float, order: int = 5) -> Callable:
    return real_kernel(lambda x: butterworth(x, None, cutoff, rate, order))


def highpass(cutoff: float, rate: float, order: int = 5) -> Callable:
    return real_kernel(lambda x: butterworth(x, cutoff, None, rate, order))


def bandpass(low: float, high: float, rate: float, order: int = 5) -> Callable:
    return real_kernel(lambda x: butterworth(x, low, high, rate, order))


def kaiser_window(beta: float = 8.6) -> Callable:
    return real_kernel(lambda x: x * np.kaiser(len(x), beta))


def upsampled(factor: int) -> Callable:
    """More samples by a zero-padded spectrum."""

    def run(x: np.ndarray) -> np.ndarray:
        n = len(x)
        s = np.fft.fftshift(np.fft.fft(x))
        pad = n * (factor - 1)
        return np.fft.ifft(np.fft.ifftshift(np.pad(s, (pad // 2, pad - pad // 2)))) * factor

    return complex_kernel(run)


def downsampled(factor: int, anti_alias: bool = True) -> Callable:
    return real_kernel(lambda x: (butterworth(x, None, 0.4 / factor, 1.0) if anti_alias and factor > 1 else x)[::factor])


def autocorrelated(max_lag: int | None = None) -> Callable:
    def run(x: np.ndarray) -> np.ndarray:
        full = np.correlate(x, x, "full")[len(x) - 1 :]
        return full if max_lag is None else full[: max_lag + 1]

    return real_kernel(run)


def cross_correlated(a: Column, b: Column, mode: str = "full") -> Column:
    @F.arrow_udf("array<double>")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return _lists([None if p is None or q is None else np.correlate(p, q, mode) for p, q in zip(_rows(x), _rows(y), strict=True)])

    return run(a, b)


def convolved(kernel: Sequence[float], mode: str = "same") -> Callable:
    k = np.asarray(kernel, float)
    return real_kernel(lambda x: np.convolve(x, k, mode))


def matched_filter(replica: np.ndarray, window: str = "hamming") -> np.ndarray:
    """Conjugate spectrum of the windowed replica over its energy."""
    taper = {"hamming": np.hamming, "hanning": np.hanning, "blackman": np.blackman, "rectangular": np.ones}[window](len(replica))
    weighted = replica * taper
    return np.conj(np.fft.fft(weighted)) / max(np.sum(np.abs(weighted) ** 2), 1e-30)


def chirp(length_s: float, rate_hz_s: float, start_hz: float, sample_hz: float) -> np.ndarray:
    n = int(np.floor(length_s * sample_hz))
    t = np.linspace(-length_s / 2, length_s / 2, n)
    return np.exp(2j * np.pi * ((start_hz + rate_hz_s * length_s / 2) * t + rate_hz_s / 2 * t * t))


def pulse_compressed(replica: np.ndarray, window: str = "hamming") -> Callable:
    """Range compression of lines with a chirp."""

    def run(x: np.ndarray) -> np.ndarray:
        padded = np.zeros(len(x), complex)
        n = min(len(replica), len(x))
        padded[:n] = replica[:n]
        return np.fft.ifft(np.fft.fft(x) * matched_filter(padded, window))

    return complex_kernel(run)


def dehammed(alpha: float = 0.75) -> Callable:
    """Spectrum divided by a Hamming weight of its length."""

    def run(x: np.ndarray) -> np.ndarray:
        n = len(x)
        w = alpha - (1 - alpha) * np.cos(2 * np.pi * np.arange(n) / max(1, n - 1))
        return np.fft.ifft(np.fft.ifftshift(np.fft.fftshift(np.fft.fft(x)) / np.maximum(w, 1e-6)))

    return complex_kernel(run)


def lines(df: DataFrame, keys: Sequence[str], line: str, at: str, re: str, im: str) -> DataFrame:
    """A row a line: sorted arrays of (re, im) along ``at``."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(at), F.col(re), F.col(im))))
    out = df.groupBy(*keys, line).agg(packed.alias("__p"))
    return out.select(*keys, line, F.transform("__p", lambda p: p[at]).alias(at), F.transform("__p", lambda p: p[re]).alias(re), F.transform("__p", lambda p: p[im]).alias(im))


def cells(df: DataFrame, keys: Sequence[str], line: str, at: str, re: str, im: str) -> DataFrame:
    """The reverse of lines()."""
    z = F.arrays_zip(F.col(at).alias("at"), F.col(re).alias("re"), F.col(im).alias("im"))
    out = df.select(*keys, line, F.explode(z).alias("__p"))
    return out.select(*keys, line, F.col("__p.at").alias(at), F.col("__p.re").alias(re), F.col("__p.im").alias(im))


def transformed_lines(df: DataFrame, keys: Sequence[str], line: str, at: str, re: str, im: str, kernel: Callable) -> DataFrame:
    """A complex kernel along every line, cells in and out."""
    packed = lines(df, keys, line, at, re, im)
    done = packed.withColumn("__z", kernel(F.col(re), F.col(im))).select(*keys, line, at, F.col("__z.re").alias(re), F.col("__z.im").alias(im))
    return cells(done, keys, line, at, re, im)


def fft_2d(df: DataFrame, keys: Sequence[str], row: str, col: str, re: str, im: str, inverse: bool = False) -> DataFrame:
    k = ifft_1d if inverse else fft_1d
    return transformed_lines(transformed_lines(df, keys, row, col, re, im, k()), keys, col, row, re, im, k())


def sublooks(df: DataFrame, keys: Sequence[str], line: str, at: str, re: str, im: str, looks: int) -> DataFrame:
    """Sub-aperture looks of every line: equal parts of its centred spectrum, each transformed back, with a look number."""

    def look(k: int) -> Callable:
        def run(x: np.ndarray) -> np.ndarray:
            s = np.fft.fftshift(np.fft.fft(x))
            edges = np.linspace(0, len(s), looks + 1).astype(int)
            keep = np.zeros_like(s)
            keep[edges[k] : edges[k + 1]] = s[edges[k] : edges[k + 1]]
            return np.fft.ifft(np.fft.ifftshift(keep)) * np.sqrt(len(s) / max(1, edges[k + 1] - edges[k]))

        return complex_kernel(run)

    packed = lines(df, keys, line, at, re, im)
    parts = [packed.select(*keys, line, at, F.lit(k).alias("look"), look(k)(F.col(re), F.col(im)).alias("__z")) for k in range(looks)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    done = every.select(*keys, "look", line, at, F.col("__z.re").alias(re), F.col("__z.im").alias(im))
    return cells(done, [*keys, "look"], line, at, re, im)


def migration_factor(azimuth_hz: Column, wavelength_m: float, velocity: float) -> Column:
    """D of the range-Doppler domain: sqrt(1 - (lambda f / 2 V)^2)."""
    x = azimuth_hz * (wavelength_m / (2 * velocity))
    return F.sqrt(F.greatest(F.lit(0.0), 1 - x * x))


def migration_phase(range_hz: Column, azimuth_hz: Column, range_m: float, wavelength_m: float, velocity: float, c: float = 299792458.0) -> Column:
    """Phase that corrects range migration."""
    d = migration_factor(azimuth_hz, wavelength_m, velocity)
    return 4 * np.pi * range_hz * (range_m * (1 / d - 1) / c)


def azimuth_phase(azimuth_hz: Column, range_m: Column, wavelength_m: float, velocity: float) -> Column:
    """Phase of the azimuth matched filter."""
    return 4 * np.pi / wavelength_m * range_m * migration_factor(azimuth_hz, wavelength_m, velocity)
