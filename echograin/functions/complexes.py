"""Complex numbers as pairs of columns, and signal scalars over them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

C_LIGHT = 299792458.0


def magnitude(re: Column, im: Column) -> Column:
    return F.sqrt(re * re + im * im)


def power(re: Column, im: Column) -> Column:
    return re * re + im * im


def phase(re: Column, im: Column) -> Column:
    return F.atan2(im, re)


def from_polar(mag: Column, ph: Column) -> Column:
    return F.struct((mag * F.cos(ph)).alias("re"), (mag * F.sin(ph)).alias("im"))


def conj_product(ar: Column, ai: Column, br: Column, bi: Column) -> tuple[Column, Column]:
    """a times the conjugate of b."""
    return ar * br + ai * bi, ai * br - ar * bi


def wrap(angle: Column) -> Column:
    """Angle in (-pi, pi]."""
    return F.atan2(F.sin(angle), F.cos(angle))


def shifted(re: Column, im: Column, index: Column, shift_hz: float, rate_hz: float) -> Column:
    """Sample ``index`` moved in frequency."""
    a = index * (2 * math.pi * shift_hz / rate_hz)
    return F.struct((re * F.cos(a) - im * F.sin(a)).alias("re"), (re * F.sin(a) + im * F.cos(a)).alias("im"))


def wavelength(hz: Column) -> Column:
    return F.lit(C_LIGHT) / hz


def free_space_loss(range_m: Column, wavelength_m: Column) -> Column:
    x = 4 * math.pi * range_m / wavelength_m
    return x * x


def window_weight(i: Column, n: Column | int, kind: str = "hamming") -> Column:
    """Weight of sample i of n; symmetric windows."""
    a = i * (2 * math.pi) / (F.lit(n) - 1)
    if kind == "hamming":
        return 0.54 - 0.46 * F.cos(a)
    if kind in ("hanning", "hann"):
        return 0.5 - 0.5 * F.cos(a)
    if kind == "blackman":
        return 0.42 - 0.5 * F.cos(a) + 0.08 * F.cos(2 * a)
    if kind == "rectangular":
        return F.lit(1.0)
    raise ValueError(f"no such window: {kind}")


def windowed(values: Column, kind: str = "hamming") -> Column:
    """An array times the window of its length."""
    n = F.size(values)
    return F.transform(values, lambda x, i: F.when(n == 1, x).otherwise(x * window_weight(i, n, kind)))


def zero_padded(values: Column, length: int) -> Column:
    """An array in the middle of ``length`` zeros; longer arrays are an error."""
    n = F.size(values)
    left = F.floor((F.lit(length) - n) / 2).cast("int")
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    return F.when(n <= length, F.concat(zeros(left), values, zeros(F.lit(length) - n - left))).otherwise(F.raise_error(F.lit("longer than the new length")))
