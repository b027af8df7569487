"""Optical and radar pixels of one place, joined and counted as evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.functions.optical import blend, reflectance_masks
from scenelake.functions.radar import backscatter_masks

PIXELS_PER_STRUCTURE = 120
MIN_VEGETATION_PIXELS = 50


def pair_modalities(
    optical: DataFrame, radar: DataFrame, keys: Sequence[str] = ("scene_id", "row", "col")
) -> DataFrame:
    """Inner join on the grid: optical r, g, b (reflectance) and radar vv, vh (dB)."""
    return optical.select(*keys, "r", "g", "b").join(radar.select(*keys, "vv", "vh"), list(keys))


def modality_masks(pixels: DataFrame) -> DataFrame:
    """Add the optical masks as o_* and the radar masks as s_*."""
    masks = {f"o_{n}": c for n, c in reflectance_masks().items()}
    masks |= {f"s_{n}": c for n, c in backscatter_masks().items()}
    return pixels.withColumns(masks)


def modality_counts(
    masked: DataFrame,
    gsd: float = 10.0,
    min_structures: int = 0,
    keys: Sequence[str] = ("scene_id",),
) -> DataFrame:
    """Class counts, structures, agreement of both sensors and cloud-recovered area, per scene."""

    def flag(name: str):
        return F.coalesce(F.col(name), F.lit(False))

    built_o, built_s = flag("o_urban"), flag("s_double_bounce")
    water_o, water_s = flag("o_water"), flag("s_specular_water")
    either = built_o | built_s | water_o | water_s
    both = (built_o & built_s) | (water_o & water_s)
    any_radar = built_s | water_s | flag("s_volume_scattering")
    names = [c for c in masked.columns if c.startswith(("o_", "s_"))]
    counted = masked.groupBy(*keys).agg(
        F.count("*").alias("pixels"),
        *[F.count_if(F.col(c)).alias(c) for c in names],
        F.count_if(both).alias("agreeing_pixels"),
        F.count_if(either).alias("claimed_pixels"),
        F.count_if(flag("o_cloud_or_haze") & any_radar).alias("recovered_pixels"),
        F.avg(F.when(F.col("s_double_bounce"), F.col("vv"))).alias("double_bounce_db"),
        F.avg(F.when(F.col("s_specular_water"), F.col("vv"))).alias("specular_db"),
    )
    structures = F.greatest(F.lit(min_structures), F.floor(F.col("s_double_bounce") / PIXELS_PER_STRUCTURE))
    return counted.withColumns(
        {
            "structures": structures.cast("bigint"),
            "concordance_pct": F.col("agreeing_pixels") * 100.0 / F.nullif(F.col("claimed_pixels"), F.lit(0)),
            "recovered_km2": F.col("recovered_pixels") * float(gsd * gsd) / 1e6,
        }
    )


def evidence(counts: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Evidence rows of all sources, duplicates kept, each with its source label."""

    def rows(source: str, title: str, metric: str, shown):
        return counts.filter(shown).select(
            *keys,
            F.lit(source).alias("source"),
            F.lit(title).alias("title"),
            F.lit(metric).alias("metric"),
            F.col(metric).cast("double").alias("value"),
        )

    optical = rows("optical", "Vegetation canopy", "o_vegetation", F.col("o_vegetation") > MIN_VEGETATION_PIXELS).unionByName(
        rows("optical", "Visible surface reflectance", "pixels", F.lit(True))
    )
    radar = rows("sar", "Double-bounce structures", "structures", F.lit(True)).unionByName(
        rows("sar", "Specular water surface", "s_specular_water", F.lit(True))
    )
    combined = rows("combined", "Cloud-recovered area", "recovered_km2", F.lit(True)).unionByName(
        rows("combined", "Sensor agreement", "concordance_pct", F.lit(True))
    )
    return optical.unionByName(radar).unionByName(combined)


def fused_rgb(
    optical_rgb: DataFrame, radar_rgb: DataFrame, keys: Sequence[str] = ("scene_id", "row", "col")
) -> DataFrame:
    """8-bit weighted blend of an optical and a radar composite on the common grid."""
    old = optical_rgb.select(*keys, *[F.col(c).alias(f"o_{c}") for c in "rgb"])
    new = radar_rgb.select(*keys, *[F.col(c).alias(f"s_{c}") for c in "rgb"])
    return old.join(new, list(keys)).select(*keys, *[blend(f"o_{c}", f"s_{c}").alias(c) for c in "rgb"])
