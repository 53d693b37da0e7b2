"""Product names, times and metadata as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
#: Keys of the core metadata of a tile.
CORE_KEYS = (
    "MISSION", "ACQUISITION_MODE", "PRODUCT_TYPE", "radar_frequency", "pulse_repetition_frequency", "range_spacing", "azimuth_spacing", "range_bandwidth",
    "azimuth_bandwidth", "antenna_pointing", "PASS", "avg_scene_height", "PRODUCT", "mds1_tx_rx_polar", "mds2_tx_rx_polar", "first_line_time",
)


def iso_timestamp(ts: Column) -> Column:
    """Timestamp as ISO text in UTC with microseconds (the session's zone has to be UTC)."""
    return F.date_format(ts, ISO)


def normalize_timestamp(text: Column) -> Column:
    """`dd-MMM-yyyy HH:mm:ss[.f]` or ISO text, fraction cut to microseconds, as ISO text in UTC; other text stays, blank is null."""
    t = F.trim(text)
    month = F.regexp_extract(t, r"^(\d{1,2}-)([A-Za-z]{3})", 2)
    named = F.when(month != "", F.concat(F.regexp_extract(t, r"^(\d{1,2}-)", 1), F.initcap(F.lower(month)), F.regexp_replace(t, r"^\d{1,2}-[A-Za-z]{3}", "")))
    iso = F.regexp_replace(t, r"(T\d{2}:\d{2}:\d{2}\.\d{6})\d+", "$1")
    found = F.coalesce(
        F.try_to_timestamp(named, F.lit("d-MMM-yyyy HH:mm:ss.SSSSSS")),
        F.try_to_timestamp(named, F.lit("d-MMM-yyyy HH:mm:ss")),
        F.try_to_timestamp(F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}"), iso)),
    )
    return F.when(t == "", None).otherwise(F.coalesce(iso_timestamp(found), t))


#: The family of a product by the start of the mission field of its file name, as the missions name their products.
FAMILIES = {"NISAR": "NISAR", "TSX": "TSX", "TDX": "TSX", "CSK": "CSG", "CSG": "CSG", "BIO": "BM", "S1A": "S1", "S1B": "S1", "S1C": "S1", "S1D": "S1"}
#: Modes of the second field of a Sentinel-1 name; all others scan in several swaths.
STRIP_MODES = ("SM", "S1", "S2", "S3", "S4", "S5", "S6")


def file_name(path: Column) -> Column:
    """(stem, extension) of the last part of a path."""
    name = F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)
    parts = F.split(name, r"\.")
    more = F.size(parts) > 1
    return F.struct(F.when(more, F.array_join(F.slice(parts, 1, F.greatest(F.lit(1), F.size(parts) - 1)), ".")).otherwise(name).alias("stem"), F.when(more, F.element_at(parts, -1)).alias("extension"))


def name_fields(path: Column) -> Column:
    """The fields between the underscores of a product's file name."""
    return F.split(file_name(path)["stem"], "_")


def product_id(path: Column) -> Column:
    """Name of a .dim product without its last field; null where the path isn't one of two fields or more."""
    fields = name_fields(path)
    return F.when((file_name(path)["extension"] == "dim") & (F.size(fields) > 1), F.array_join(F.slice(fields, 1, F.greatest(F.lit(1), F.size(fields) - 1)), "_"))


def product_mode(path: Column) -> Column:
    """Sensor family by the mission field of the file name, for Sentinel-1 with S1STRIP or S1TOPS by its mode field; null for an unknown mission."""
    fields = F.transform(name_fields(path), F.upper)
    mission = F.get(fields, 0)
    family = F.lit(None).cast("string")
    for start, name in FAMILIES.items():
        family = F.when(mission.startswith(start), name).otherwise(family)
    return F.when(family != "S1", family).when(F.get(fields, 1).isin(*STRIP_MODES), "S1STRIP").when(family == "S1", "S1TOPS")


def core_metadata(metadata: Column) -> Column:
    """The core keys of a metadata map that are there."""
    return F.map_filter(metadata, lambda k, v: k.isin(*CORE_KEYS))


#: Keys that may hold the pass of an orbit, the first one with a text counts.
PASS_KEYS = ("PASS", "pass", "pass_direction", "PASS_DIRECTION", "orbitPassDirection")


def pass_direction(metadata: Column) -> Column:
    """ASC, DESC, another text in capitals, or UNKNOWN."""
    raw = F.upper(F.coalesce(*[F.when(F.trim(metadata[k]) != "", F.trim(metadata[k])) for k in PASS_KEYS]))
    return F.when(raw.startswith("ASC"), "ASC").when(raw.startswith("DESC"), "DESC").otherwise(F.coalesce(raw, F.lit("UNKNOWN")))


def numeric_suffix(text: Column) -> Column:
    """First digits of a text as a number."""
    found = F.regexp_extract(text, r"(\d+)", 1)
    return F.when(found != "", found.cast("long"))


def band_parts(band: Column) -> Column:
    """Component, swath, polarisation and look of a band name such as i_IW1_VV_SA2; null without i or q."""
    pattern = r"(?:^|_)([iq])_(?:(IW\d|EW\d|S\d)_)?([HV]{2})(?:_SA(\d+))?$"
    part = lambda k: F.regexp_extract(band, pattern, k)
    blank = lambda c: F.when(c != "", c)
    return F.when(part(1) != "", F.struct(part(1).alias("component"), blank(part(2)).alias("swath"), part(3).alias("pol"), blank(part(4)).cast("int").alias("look")))
