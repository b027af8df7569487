"""Scene headers: role maps, raster type, sensor, capabilities, band-set tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions.bands import RADAR_FILE_HINT, band_role

RADAR_ROLES = ["VV", "VH", "HH", "HV"]


def role_map(bands: DataFrame) -> DataFrame:
    """scene_id, total_bands, filename, role_map; the first band of a role wins, Unknown is left out."""
    roles = bands.withColumn("role", band_role())
    first = roles.groupBy("scene_id", "total_bands", "filename", "role").agg(F.min("band_idx").alias("band_idx"))
    entries = F.collect_list(F.when(F.col("role") != "Unknown", F.struct("band_idx", "role")))
    folded = first.groupBy("scene_id", "total_bands", "filename").agg(F.sort_array(entries).alias("entries"))
    pairs = F.transform("entries", lambda e: F.struct(e["role"].alias("key"), e["band_idx"].alias("value")))
    return folded.select("scene_id", "total_bands", "filename", F.map_from_entries(pairs).alias("role_map"))


def _has(*roles: str) -> Column:
    keys = F.map_keys("role_map")
    hit = F.lit(False)
    for role in roles:
        hit = hit | F.array_contains(keys, role)
    return hit


def classify_scenes(bands: DataFrame) -> DataFrame:
    """Raster type, sensor, polarisations and index capabilities per scene.

    ``bands`` has scene_id, band_idx, total_bands, description, filename.
    """
    scenes = role_map(bands)
    name = F.lower("filename")
    n = F.col("total_bands")
    radar = _has(*RADAR_ROLES) | (n.isin(1, 2) & name.rlike(RADAR_FILE_HINT))
    multispectral = (n >= 4) | ((n > 1) & _has("B08", "B11", "B12"))
    kind = (
        F.when(radar, "SAR")
        .when(multispectral, "OPTICAL MULTISPECTRAL")
        .when(n == 3, "OPTICAL RGB")
        .otherwise("OPTICAL SINGLE-BAND")
    )
    radar_sensor = (
        F.when(name.contains("risat"), "RISAT-1A SAR")
        .when(name.contains("sentinel-1") | name.contains("s1") | n.isin(1, 2), "Sentinel-1 SAR")
        .otherwise("Unknown")
    )
    optical_sensor = (
        F.when(name.contains("landsat"), "Landsat Multispectral")
        .when(n.isin(4, 6, 12, 13), "Sentinel-2 Multispectral")
        .otherwise("Optical Multispectral")
    )
    found = F.filter(F.array(*[F.lit(r) for r in RADAR_ROLES]), lambda r: F.array_contains(F.map_keys("role_map"), r))
    assumed = F.when(n == 1, F.array(F.lit("VV"))).otherwise(F.array(F.lit("VV"), F.lit("VH")))
    typed = scenes.withColumn("raster_type", kind)
    is_radar, is_ms = F.col("raster_type") == "SAR", F.col("raster_type") == "OPTICAL MULTISPECTRAL"
    return typed.select(
        "scene_id",
        "total_bands",
        "filename",
        "role_map",
        "raster_type",
        F.when(is_radar, radar_sensor)
        .when(is_ms, optical_sensor)
        .when(F.col("raster_type") == "OPTICAL RGB", "Optical RGB Sensor")
        .otherwise("Panchromatic / Single-Band Optical")
        .alias("sensor"),
        F.when(is_radar, "SAR").when(is_ms, "Multispectral").otherwise("Optical").alias("modality"),
        F.when(is_radar, F.when(F.size(found) > 0, found).otherwise(assumed))
        .otherwise(F.array().cast("array<string>"))
        .alias("polarizations"),
        (
            (is_ms & _has("B04", "Red") & _has("B03", "Green") & _has("B02", "Blue"))
            | (F.col("raster_type") == "OPTICAL RGB")
        ).alias("has_true_color"),
        (is_ms & _has("B08") & _has("B04", "Red")).alias("ndvi_supported"),
        (is_ms & _has("B03", "Green") & _has("B08")).alias("ndwi_supported"),
        (is_ms & _has("B11") & _has("B08")).alias("ndbi_supported"),
    )


def subset_of(required: str | Column, available: str | Column) -> Column:
    """Every element of ``required`` is in ``available``."""
    return F.size(F.array_except(required, available)) == 0


def with_bands(scenes: DataFrame, needed: Sequence[str]) -> DataFrame:
    """Classified scenes whose role map holds all the needed roles."""
    return scenes.filter(subset_of(F.array(*[F.lit(b) for b in needed]), F.map_keys("role_map")))


def header_geometry(headers: DataFrame) -> DataFrame:
    """Add bounds, resolution and ground sample distance in metres to affine headers.

    Needs a, b, c, d, e, f, width, height, epsg. Degrees count 111320 m each.
    """
    right = F.col("c") + F.col("a") * F.col("width")
    bottom = F.col("f") + F.col("e") * F.col("height")
    res = F.abs("a")
    return headers.select(
        "*",
        F.least("c", right).alias("left"),
        F.least("f", bottom).alias("bottom"),
        F.greatest("c", right).alias("right"),
        F.greatest("f", bottom).alias("top"),
        res.alias("res_x"),
        F.abs("e").alias("res_y"),
        F.when(F.col("epsg") == 4326, res * 111320.0).otherwise(res).alias("gsd_m"),
    )
