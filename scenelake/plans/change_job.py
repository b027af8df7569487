"""Change jobs: from two dates to classes, regions, areas and a text."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.operators import change as ch


class ChangeResult(NamedTuple):
    """One row per scene, and the regions it is built from."""

    summary: DataFrame
    regions: DataFrame


def detect_change(
    before: DataFrame,
    after: DataFrame,
    headers: DataFrame,
    gsd: float = ch.DEFAULT_GSD_M,
    threshold: float = ch.CHANGE_THRESHOLD,
    min_pixels: int = 15,
) -> ChangeResult:
    """Classify the change of r, g, b pixels between two dates and report it per scene.

    ``headers`` has scene_id, height, width. One join and one aggregation touch pixels;
    totals, regions and text come from the (scene, class) rows.
    """
    classed = ch.change_class(ch.pair_pixels(before, after, ("r", "g", "b")), threshold)
    extents = ch.class_extents(classed)
    regions = ch.class_regions(extents, headers, gsd, min_pixels)
    totals = ch.change_totals(extents, gsd)
    by_type = regions.groupBy("scene_id").agg(
        F.count("*").alias("regions"), *[_hectares(name).alias(name) for name in ("built_ha", "vegetation_ha", "water_ha")]
    )
    joined = totals.join(by_type, "scene_id", "left").fillna(0, ["regions"]).fillna(0.0, ["built_ha", "vegetation_ha", "water_ha"])
    return ChangeResult(joined.withColumn("description", _describe()), regions)


def _hectares(name: str) -> Column:
    cls = {"built_ha": 1, "vegetation_ha": 2, "water_ha": 3}[name]
    return F.sum(F.when(F.col("cls") == cls, F.col("area_hectares")).otherwise(0.0))


def _describe() -> Column:
    lead = F.format_string(
        "%.1f%% of the surface changed, %.3f km² (%.2f ha).", "change_percentage", "area_km2", "area_hectares"
    )
    lines = [
        F.when(F.col("built_ha") > 0, F.format_string("Built-up & Logistics Expansion: %.1f ha", "built_ha")),
        F.when(F.col("vegetation_ha") > 0, F.format_string("Vegetation & Canopy Clearing: %.1f ha", "vegetation_ha")),
        F.when(F.col("water_ha") > 0, F.format_string("Hydrological Fluctuation: %.1f ha", "water_ha")),
    ]
    return F.concat_ws("\n", lead, *lines)


def index_change_job(
    before: DataFrame,
    after: DataFrame,
    areas: DataFrame,
    index: str = "ndvi",
    band: float = 0.10,
) -> DataFrame:
    """Index on both dates to shares, areas and a sentence per scene.

    ``areas`` has scene_id, aoi_area_km2, before_date, after_date.
    """
    from scenelake.functions.indices import INDEX_BANDS

    pairs = ch.pair_pixels(before, after, INDEX_BANDS[index])
    changes = ch.index_change(pairs, index, band)
    return ch.change_summary(changes.join(areas, "scene_id"), index)
