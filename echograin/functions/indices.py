"""Radar and optical indices as column expressions.

Radar indices take linear backscatter, optical ones reflectance.  A ratio whose
guard fails is NaN, a null input gives null.  The optical formulas are the
published ones of each index.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import over, over_positive

# radar


def rvi(vv: Column, vh: Column) -> Column:
    return over_positive(4 * vh, vv + vh)


def dprvi_vv(vv: Column, vh: Column) -> Column:
    return over_positive(4 * vh, vv + vh)


def dprvi_hh(hh: Column, hv: Column) -> Column:
    return over_positive(4 * hv, hh + hv)


def dpdd(vv: Column, vh: Column) -> Column:
    return (vv + vh) / F.sqrt(F.lit(2.0))


def ndpoll(vv: Column, vh: Column) -> Column:
    return over(vv - vh, vv + vh)


def qprvi(hh: Column, vv: Column, hv: Column) -> Column:
    return over(8 * hv, hh + vv + 2 * hv)


def rfdi(hh: Column, hv: Column) -> Column:
    return over(hh - hv, hh + hv)


def vddpi(vv: Column, vh: Column) -> Column:
    return over(vv + vh, vv)


def vhvvd(vh: Column, vv: Column) -> Column:
    return vh - vv


def vhvvp(vh: Column, vv: Column) -> Column:
    return vh * vv


def vhvvr(vh: Column, vv: Column) -> Column:
    return over(vh, vv)


def vvvhd(vv: Column, vh: Column) -> Column:
    return vv - vh


def vvvhr(vv: Column, vh: Column) -> Column:
    return over(vv, vh)


def vvvhs(vv: Column, vh: Column) -> Column:
    return vv + vh


# optical vegetation


def ndvi(red: Column, nir: Column) -> Column:
    return over(nir - red, nir + red)


def savi(red: Column, nir: Column, soil: float = 0.5) -> Column:
    return over((1 + soil) * (nir - red), nir + red + soil)


def tsavi(red: Column, nir: Column, slope: float = 0.5, intercept: float = 0.5, adjust: float = 0.08) -> Column:
    return over(slope * (nir - slope * red - intercept), intercept * nir + red - intercept * slope + adjust * (1 + slope * slope))


def msavi(red: Column, nir: Column, slope: float = 0.5) -> Column:
    soil = 1 - 2 * slope * ndvi(red, nir) * (nir - slope * red)
    return over((1 + soil) * (nir - red), nir + red + soil)


def msavi2(red: Column, nir: Column) -> Column:
    inner = (2 * nir + 1) * (2 * nir + 1) - 8 * (nir - red)
    return (2 * nir + 1 - F.sqrt(inner)) / 2


def wdvi(red: Column, nir: Column, slope: float = 0.5) -> Column:
    return nir - slope * red


def tndvi(red: Column, nir: Column) -> Column:
    return F.sqrt(ndvi(red, nir) + 0.5)


def arvi(red: Column, nir: Column, blue: Column, gamma: float = 1.0) -> Column:
    rb = red - gamma * (blue - red)
    return over(nir - rb, nir + rb)


def dvi(red: Column, nir: Column) -> Column:
    return nir - red


def gemi(red: Column, nir: Column) -> Column:
    eta = over(2 * (nir * nir - red * red) + 1.5 * nir + 0.5 * red, nir + red + 0.5)
    return eta * (1 - 0.25 * eta) - over(red - 0.125, 1 - red)


def gndvi(green: Column, nir: Column) -> Column:
    return over(nir - green, nir + green)


def ipvi(red: Column, nir: Column) -> Column:
    return over(nir, nir + red)


def mcari(red1: Column, red2: Column, green: Column) -> Column:
    return ((red2 - red1) - 0.2 * (red2 - green)) * over(red2, red1)


def mtci(red4: Column, red5: Column, nir: Column) -> Column:
    return over(nir - red5, red5 - red4)


def ratio_vi(red: Column, nir: Column) -> Column:
    return over(nir, red)


def ireci(red4: Column, red5: Column, red6: Column, nir: Column) -> Column:
    return over(nir - red4, over(red5, red6))


def ndi45(red4: Column, red5: Column) -> Column:
    return over(red5 - red4, red5 + red4)


def pssra(red: Column, nir: Column) -> Column:
    return over(nir, red)


def pvi(red: Column, nir: Column, angle_deg: float = 45.0) -> Column:
    """Perpendicular distance to the soil line at this angle."""
    a = F.radians(F.lit(angle_deg))
    return F.sin(a) * nir - F.cos(a) * red


def reip(red4: Column, red5: Column, red6: Column, nir: Column) -> Column:
    return 700 + 40 * over((red4 + nir) / 2 - red5, red6 - red5)


def s2rep(red4: Column, red5: Column, red6: Column, nir: Column) -> Column:
    return 705 + 35 * over((nir + red4) / 2 - red5, red6 - red5)


# water and soil


def mndwi(green: Column, mir: Column) -> Column:
    return over(green - mir, green + mir)


def ndwi(nir: Column, mir: Column) -> Column:
    return over(nir - mir, nir + mir)


def ndwi2(green: Column, nir: Column) -> Column:
    return over(green - nir, green + nir)


def ndpi(green: Column, mir: Column) -> Column:
    return over(mir - green, mir + green)


def ndti(red: Column, green: Column) -> Column:
    return over(red - green, red + green)


def bi(red: Column, green: Column) -> Column:
    return F.sqrt((red * red + green * green) / 2)


def bi2(red: Column, green: Column, nir: Column) -> Column:
    return F.sqrt((red * red + green * green + nir * nir) / 3)


def ci(red: Column, green: Column) -> Column:
    return over(red - green, red + green)


def ri(red: Column, green: Column) -> Column:
    return over(red * red, green * green * green)


def flh(low: Column, signal: Column, high: Column, low_nm: float, signal_nm: float, high_nm: float, cloud: float = 1.005) -> Column:
    """Height of a line over the baseline between two bands."""
    part = (signal_nm - low_nm) / (high_nm - low_nm)
    return signal - cloud * (low + (high - low) * part)
