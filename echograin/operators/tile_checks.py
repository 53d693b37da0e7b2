"""Validation of finished tiles, their geometry, and the databases of their core metadata.

A tile is a row (tile, metadata) with its metadata as a map, null where a tile
has none; its bands are rows (tile, band, height, width, attrs).  All checks are
expressions and one grouped aggregation a table, whatever the number of tiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import wkt_of_ring
from ..functions.products import CORE_KEYS, normalize_timestamp

#: Attributes that every band of a tile has to have.
BAND_ATTRIBUTES = ("CLASS", "IMAGE_VERSION", "log10_scaled", "raster_height", "raster_width", "scaling_factor", "scaling_offset", "unit")
_NAMES = "array<string>"


def blank(text: Column) -> Column:
    """Whether a value is null or only white space."""
    return F.coalesce(F.trim(text) == "", F.lit(True))


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(_NAMES)


def keys_without_value(metadata: Column) -> Column:
    """Sorted keys of a map that hold a blank value."""
    return F.sort_array(F.map_keys(F.map_filter(metadata, lambda k, v: blank(v))))


def absent_keys(metadata: Column, wanted: Sequence[str]) -> Column:
    return F.sort_array(F.array_except(_strings(wanted), F.map_keys(metadata)))


def band_issues(bands: DataFrame, required: Sequence[str] = BAND_ATTRIBUTES) -> DataFrame:
    """bands with absent_attrs, empty_attrs and bad_shape."""
    attrs = F.coalesce("attrs", F.create_map().cast("map<string,string>"))
    return bands.withColumns({
        "absent_attrs": absent_keys(attrs, required),
        "empty_attrs": F.array_intersect(keys_without_value(attrs), _strings(required)),
        "bad_shape": F.coalesce((F.col("height") <= 0) | (F.col("width") <= 0), F.lit(True)),
    })


def issue_text(band: Column, absent: Column, empty: Column, bad_shape: Column, height: Column, width: Column) -> Column:
    """One line on a band that fails."""
    listed = lambda label, names: F.when(F.size(names) > 0, F.concat(F.lit(label), F.array_join(names, ", ")))
    shape = F.when(bad_shape, F.format_string("shape %s x %s", height, width))
    return F.concat(band, F.lit(": "), F.concat_ws("; ", listed("without ", absent), listed("blank ", empty), shape))


def validated_tiles(tiles: DataFrame, bands: DataFrame, expected: Sequence[str], core_keys: Sequence[str] = CORE_KEYS, required: Sequence[str] = BAND_ATTRIBUTES) -> DataFrame:
    """A row a tile: which expected bands are missing and which are beyond them, core keys that are missing or blank,
    blank metadata, bands with issues, whether shapes differ, three checks, and the status success or failed."""
    issues = band_issues(bands, required)
    failing = (F.size("absent_attrs") > 0) | (F.size("empty_attrs") > 0) | F.col("bad_shape")
    line = issue_text(F.col("band"), F.col("absent_attrs"), F.col("empty_attrs"), F.col("bad_shape"), F.col("height"), F.col("width"))
    by_tile = issues.groupBy("tile").agg(
        F.sort_array(F.collect_set("band")).alias("bands"),
        F.sort_array(F.collect_list(F.when(failing, line))).alias("band_issues"),
        F.count_distinct("height", "width").alias("shapes"),
    )
    none = F.array().cast(_NAMES)
    t = tiles.join(by_tile, "tile", "left").withColumn("bands", F.coalesce("bands", none)).withColumn("band_issues", F.coalesce("band_issues", none))
    known = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    t = t.withColumns({
        "missing_bands": F.sort_array(F.array_except(_strings(expected), F.col("bands"))),
        "extra_bands": F.sort_array(F.array_except(F.col("bands"), _strings(expected))),
        "no_metadata": F.col("metadata").isNull(),
        "blank_metadata": keys_without_value(known),
        "missing_core": absent_keys(known, core_keys),
        "blank_core": F.array_intersect(keys_without_value(known), _strings(core_keys)),
        "shapes_differ": F.coalesce(F.col("shapes") > 1, F.lit(False)),
    })
    t = t.withColumns({
        "bands_ok": (F.size("missing_bands") == 0) & (F.size("extra_bands") == 0),
        "metadata_ok": ~F.col("no_metadata") & (F.size("blank_metadata") == 0) & (F.size("missing_core") == 0),
        "band_attrs_ok": (F.size("band_issues") == 0) & ~F.col("shapes_differ"),
    })
    ok = F.col("bands_ok") & F.col("metadata_ok") & F.col("band_attrs_ok")
    return t.drop("shapes").withColumn("status", F.when(ok, "success").otherwise("failed"))


def structure_checked(results: DataFrame, paths: DataFrame) -> DataFrame:
    """results (tile, status, ...) with the paths that other tiles have and a tile hasn't, of paths (tile, kind, path):
    a tile that lacks some has structure_ok false and fails."""
    lacking = _lacking(results.select("tile").distinct(), paths)
    joined = results.join(lacking, "tile", "left").withColumn("missing_paths", F.coalesce("missing_paths", F.array().cast(_NAMES)))
    joined = joined.withColumn("structure_ok", F.size("missing_paths") == 0)
    return joined.withColumn("status", F.when(F.col("structure_ok"), F.col("status")).otherwise("failed"))


def _lacking(tiles: DataFrame, paths: DataFrame) -> DataFrame:
    """(tile, missing_paths): by each tile's own array against the array of all paths, which is bounded by the layout of one tile."""
    text = F.concat_ws(":", "kind", "path")
    whole = paths.select(text.alias("p")).distinct().agg(F.sort_array(F.collect_list("p")).alias("__all"))  # one row
    own = paths.groupBy("tile").agg(F.collect_set(text).alias("__own"))
    found = tiles.join(own, "tile", "left").join(F.broadcast(whole), F.lit(True))
    return found.select("tile", F.array_except("__all", F.coalesce("__own", F.array().cast(_NAMES))).alias("missing_paths"))


def quality_status(total: Column, valid: Column, nodata: Column) -> Column:
    """failed without a valid pixel, partial with some nodata, else success."""
    return F.when((total == 0) | (valid == 0), "failed").when(nodata > 0, "partial").otherwise("success")


# geometry


def corner(metadata: Column, stem: str) -> Column:
    """A corner (lon, lat) of a metadata map by the keys <stem>_lat and <stem>_lon or <stem>_long; null where one isn't a finite number."""
    number = lambda key: metadata[key].try_cast("double")
    lat, lon = number(f"{stem}_lat"), F.coalesce(number(f"{stem}_lon"), number(f"{stem}_long"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite(lat) & finite(lon), F.struct(lon.alias("lon"), lat.alias("lat")))


def tile_ring(metadata: Column) -> Column:
    """The closed ring of a tile's four corners; null if one is missing."""
    corners = [corner(metadata, s) for s in ("first_near", "first_far", "last_far", "last_near")]
    known = corners[0].isNotNull() & corners[1].isNotNull() & corners[2].isNotNull() & corners[3].isNotNull()
    return F.when(known, F.array(*corners, corners[0]))


def tile_centre(metadata: Column) -> Column:
    return F.coalesce(corner(metadata, "centre"), corner(metadata, "center"))


def rectangle_ring(rect: Column) -> Column:
    """The closed ring of a grid cell's struct of corners TL, TR, BR, BL (lon, lat)."""
    return F.array(*[F.struct(rect[c]["lon"].alias("lon"), rect[c]["lat"].alias("lat")) for c in ("TL", "TR", "BR", "BL", "TL")])


# databases of tiles


def core_rows(results: DataFrame, core_keys: Sequence[str] = CORE_KEYS) -> DataFrame:
    """A row a tile with its ID, its swath if there is one, and its core metadata as columns; the time of the first line as ISO text."""
    value = lambda k: normalize_timestamp(F.col("metadata")[k]) if k == "first_line_time" else F.col("metadata")[k]
    swath = [F.col("swath").alias("SWATH")] if "swath" in results.columns else []
    return results.select(F.col("tile").alias("ID"), *swath, *[value(k).alias(k) for k in core_keys])


def merged_rows(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Rows of several groups of tiles; columns that a group lacks are null."""
    for other in more:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def write_tile_database(rows: DataFrame, folder: str, name: str) -> str:
    """The rows as Parquet under the product's name; the path."""
    path = f"{folder.rstrip('/')}/{name}_core_metadata.parquet"
    rows.write.mode("overwrite").parquet(path)
    return path


# footprints of products


#: Variants of TerraSAR-X products by how their pixels lie and what they hold.
GEOCODED, COMPLEX, DETECTED = ("EEC", "GEC"), ("SSC", "SLC"), ("MGD", "GRD")


def terrasar_metadata(leaves: Column) -> Column:
    """Mission, variant, type, mode and projection of a TerraSAR-X product from the leaves of its XML (tag to text); blank is null."""

    def token(*tags: str) -> Column:
        return F.coalesce(*[F.when(~blank(leaves[t]), F.upper(F.trim(leaves[t]))) for t in tags])

    kind = token("productType")
    return F.struct(
        token("mission", "platform", "shortName").alias("mission"), F.coalesce(token("productVariant"), F.get(F.split(kind, "_"), 0)).alias("variant"), kind.alias("product_type"),
        token("imagingMode", "operationalMode").alias("imaging_mode"), token("imageDataType").alias("image_data_type"), token("projection").alias("projection"), token("mapProjection").alias("map_projection"),
    )


def is_geocoded(metadata: Column) -> Column:
    return F.coalesce(metadata["variant"].isin(*GEOCODED), F.lit(False)) | F.coalesce(metadata["projection"] == "MAP", F.lit(False)) | metadata["map_projection"].isNotNull()


def is_complex(metadata: Column) -> Column:
    return F.coalesce(metadata["variant"].isin(*COMPLEX), F.lit(False)) | F.coalesce(metadata["image_data_type"] == "COMPLEX", F.lit(False))


def is_detected(metadata: Column) -> Column:
    return F.coalesce(metadata["variant"].isin(*DETECTED), F.lit(False)) | F.coalesce(metadata["image_data_type"] == "DETECTED", F.lit(False))


def product_wkt(given: Column, *found: Column) -> Column:
    """The footprint that a user gives, else the first ring that was found in the product's own files; null if there is none."""
    rings = [F.when(F.size(r) >= 3, wkt_of_ring(r)) for r in found]
    return F.coalesce(F.when(~blank(given), F.trim(given)), *rings)
