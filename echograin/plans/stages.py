"""Which stages a pair or a product goes through on the way to a time series, by what there is of it.

A plan is a name and a tuple of stages, put together by rules from the numbers
of images, bursts and sub-swaths.  ``NAMED`` lists all plans that the rules can
give, so that a plan may also be asked for by its name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

#: What a plan takes: one product, a pair, or several products.
SINGLE, PAIR, MULTI = "single", "pair", "multi"


class Plan(NamedTuple):
    name: str
    branch: str
    takes: str
    stages: tuple[str, ...]


def _positive(**numbers: int) -> None:
    for name, n in numbers.items():
        if n < 1:
            raise ValueError(f"{name} has to be 1 or more, not {n}")


def tops_split(sources: int) -> Plan:
    """A sub-swath's bursts with precise orbits, of slices that are joined first if there are several."""
    _positive(sources=sources)
    joined = sources > 1
    return Plan("topsar_" + "assemble_" * joined + "split_applyorbit", "topsar", MULTI if joined else SINGLE, ("slice_assembly",) * joined + ("topsar_split", "apply_orbit_file"))


def tops_pair(masters: int, bursts: int, own_elevation: bool = False) -> Plan:
    """A TOPS pair to a debursted interferogram: one sub-swath is freed of its topography and cut at once, and spectral
    diversity needs more than one burst."""
    _positive(masters=masters, bursts=bursts)
    one, no_esd = masters == 1, bursts == 1
    stages = ("back_geocoding", *(("enhanced_spectral_diversity",) if not no_esd else ()), "deburst", "interferogram", "deburst", *(("topo_phase_removal", "subset") if one else ()))
    return Plan("topsar_coreg_ifg" + "_subset" * one + "_no_esd" * no_esd + "_ext_dem" * own_elevation, "topsar", PAIR, stages)


def tops_export(masters: int, own_elevation: bool = False) -> Plan:
    """The export of a pair, whose sub-swaths are merged first if there are several."""
    _positive(masters=masters)
    if masters == 1:
        return Plan("topsar_export", "topsar", PAIR, ("stamps_export_pair",))
    return Plan("topsar_export_mergeiw_subset" + "_ext_dem" * own_elevation, "topsar", MULTI, ("topsar_merge_products", "topo_phase_removal", "subset", "stamps_export_pair"))


def strip_subset() -> Plan:
    return Plan("stripmap_subset", "stripmap", SINGLE, ("subset",))


def strip_pair(own_elevation: bool = False) -> Plan:
    """A stripmap pair brought together over an elevation model."""
    return Plan("stripmap_dem_assisted_coregistration" + "_ext_dem" * own_elevation, "stripmap", PAIR, ("dem_assisted_coregistration_pair",))


def strip_interferogram(own_elevation: bool = False) -> Plan:
    return Plan("stripmap_interferogram_topophase" + "_ext_dem" * own_elevation, "stripmap", SINGLE, ("interferogram", "topo_phase_removal"))


def strip_export() -> Plan:
    return Plan("stripmap_export", "stripmap", PAIR, ("stamps_export_pair",))


def _all() -> Iterator[Plan]:
    both = (False, True)
    yield from (tops_split(n) for n in (1, 2))
    yield from (tops_pair(m, b, e) for m, b, e in product((1, 2), (1, 2), both))
    yield from (tops_export(m, e) for m, e in product((1, 2), both))
    yield from (strip_subset(), strip_export())
    yield from (f(e) for f in (strip_pair, strip_interferogram) for e in both)


NAMED = {p.name: p for p in _all()}


def names(branch: str | None = None) -> list[str]:
    """Names of the plans, in order, of one branch if it is given."""
    return sorted(p.name for p in NAMED.values() if branch in (None, p.branch))


def plan(name: str) -> Plan:
    if name not in NAMED:
        raise LookupError(f"no plan {name!r}; there are {', '.join(names())}")
    return NAMED[name]


def missing_for_export(bands: list[str], phase: bool = True, elevation: bool = True, lat_lon: bool = True) -> list[str]:
    """What an interferogram's bands lack for an export to a time series; case doesn't matter."""

    def has(pattern: str) -> bool:
        return any(re.search(pattern, b, re.IGNORECASE) for b in bands)

    def placed(short: str, long: str) -> bool:
        return has(rf"^({short}|{long})$|orthorectified.*{short}|{short}.*orthorectified")

    found = {"Phase_ifg_*": not phase or has("^phase_ifg"), "elevation": not elevation or has("^elevation(_|$)"), "orthorectified latitude/longitude": not lat_lon or placed("lat", "latitude") and placed("lon", "longitude")}
    return [name for name, there in found.items() if not there]
