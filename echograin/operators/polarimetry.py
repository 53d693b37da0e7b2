"""Polarimetric quantities as expressions over scattering elements.

Scattering elements are struct<re, im> columns; matrices come as structs of
their distinct elements, and averages over windows or groups are taken of those.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.guards import over


def _sq(z: Column) -> Column:
    return z["re"] * z["re"] + z["im"] * z["im"]


def _cross(a: Column, b: Column) -> Column:
    """a times conjugate b."""
    return F.struct((a["re"] * b["re"] + a["im"] * b["im"]).alias("re"), (a["im"] * b["re"] - a["re"] * b["im"]).alias("im"))


def _sum(a: Column, b: Column, sign: int = 1) -> Column:
    return F.struct((a["re"] + sign * b["re"]).alias("re"), (a["im"] + sign * b["im"]).alias("im"))


def covariance_c2(a: Column, b: Column) -> Column:
    return F.struct(_sq(a).alias("c11"), _sq(b).alias("c22"), _cross(a, b).alias("c12"))


def covariance_c3(hh: Column, hv: Column, vv: Column) -> Column:
    r2 = 2.0**0.5
    c12, c23 = _cross(hh, hv), _cross(hv, vv)
    scale = lambda z: F.struct((z["re"] * r2).alias("re"), (z["im"] * r2).alias("im"))
    return F.struct(_sq(hh).alias("c11"), (2 * _sq(hv)).alias("c22"), _sq(vv).alias("c33"), scale(c12).alias("c12"), _cross(hh, vv).alias("c13"), scale(c23).alias("c23"))


def coherency_t3(hh: Column, hv: Column, vv: Column) -> Column:
    s, d = _sum(hh, vv), _sum(hh, vv, -1)
    half = lambda z: F.struct((z["re"] / 2).alias("re"), (z["im"] / 2).alias("im"))
    return F.struct((_sq(s) / 2).alias("t11"), (_sq(d) / 2).alias("t22"), (2 * _sq(hv)).alias("t33"), half(_cross(s, d)).alias("t12"), _cross(s, hv).alias("t13"), _cross(d, hv).alias("t23"))


def span(hh: Column, hv: Column, vv: Column) -> Column:
    return _sq(hh) + 2 * _sq(hv) + _sq(vv)


def pauli(hh: Column, hv: Column, vv: Column) -> Column:
    """Odd bounce, double bounce and volume power."""
    return F.struct((_sq(_sum(hh, vv)) / 2).alias("odd"), (_sq(_sum(hh, vv, -1)) / 2).alias("double"), (2 * _sq(hv)).alias("volume"))


def sinclair(hh: Column, hv: Column, vv: Column) -> Column:
    return F.struct(_sq(vv).alias("vv"), _sq(hv).alias("hv"), _sq(hh).alias("hh"))


def stokes(h: Column, v: Column) -> Column:
    """Stokes vector of a received pair, with degree of polarisation and linear ratio."""
    x = _cross(h, v)
    s0, s1, s2, s3 = _sq(h) + _sq(v), _sq(h) - _sq(v), 2 * x["re"], -2 * x["im"]
    return F.struct(s0.alias("s0"), s1.alias("s1"), s2.alias("s2"), s3.alias("s3"), over(F.sqrt(s1 * s1 + s2 * s2 + s3 * s3), s0).alias("dop"), over(s0 - s1, s0 + s1).alias("linear_ratio"))


def m_chi(s: Column) -> Column:
    """Surface, double bounce and volume power of a (mean) Stokes vector."""
    m = over(F.sqrt(s["s1"] * s["s1"] + s["s2"] * s["s2"] + s["s3"] * s["s3"]), s["s0"])
    sin_2chi = over(-s["s3"], m * s["s0"])
    return F.struct(F.sqrt(s["s0"] * m * (1 - sin_2chi) / 2).alias("surface"), F.sqrt(s["s0"] * m * (1 + sin_2chi) / 2).alias("double"), F.sqrt(s["s0"] * (1 - m)).alias("volume"))


def canopy_structure(hh: Column, vv: Column) -> Column:
    return over(_sq(vv), _sq(vv) + _sq(hh))


def volume_scattering(hh: Column, hv: Column, vv: Column) -> Column:
    return over(_sq(hv), _sq(hv) + (_sq(hh) + _sq(vv)) / 2)


def compact(hh: Column, hv: Column, vv: Column) -> Column:
    """Received pair of a right circular transmission."""
    r2 = 2.0**0.5
    h = F.struct(((hh["re"] + hv["im"]) / r2).alias("re"), ((hh["im"] - hv["re"]) / r2).alias("im"))
    v = F.struct(((hv["re"] + vv["im"]) / r2).alias("re"), ((hv["im"] - vv["re"]) / r2).alias("im"))
    return F.struct(h.alias("rh"), v.alias("rv"))


def entropy_alpha2(c11: Column, c22: Column, c12_re: Column, c12_im: Column) -> Column:
    """Entropy, anisotropy and mean alpha (degrees) of a 2 x 2 covariance."""
    t, d = c11 + c22, c11 - c22
    root = F.sqrt(d * d + 4 * (c12_re * c12_re + c12_im * c12_im))
    l1, l2 = (t + root) / 2, (t - root) / 2
    p1, p2 = over(l1, t), over(l2, t)
    h = lambda p: F.when(p > 0, -p * F.log2(p)).otherwise(0.0)
    # cos(alpha) of the first eigenvector is the share of its first element
    cos2 = F.when(root > 0, (1 + d / root) / 2).otherwise(0.5)
    a1 = F.acos(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cos2))))
    a2 = F.acos(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - cos2))))
    return F.struct((h(p1) + h(p2)).alias("entropy"), over(l1 - l2, t).alias("anisotropy"), F.degrees(p1 * a1 + p2 * a2).alias("alpha"))


def spectral_angle(x: Column, reference: list[float]) -> Column:
    """Angle in radians between an array column and a reference spectrum."""
    r = F.array(*[F.lit(float(v)) for v in reference])
    dot = F.aggregate(F.zip_with(x, r, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    top = sum(v * v for v in reference) ** 0.5
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), over(dot, norm * top))))
