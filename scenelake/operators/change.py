"""Two-date comparison of pixel tables: pairing, change classes, regions, index deltas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions import indices as ix

CHANGE_THRESHOLD = 0.18
DEFAULT_GSD_M = 10.0
SIGNIFICANT_PERCENT = 2.0

# Change classes.
CHANGE_CLASSES = {
    1: ("Built-up & Logistics Expansion", "Built-up Expansion", "#f59e0b"),
    2: ("Canopy & Agricultural Loss", "Vegetation Loss", "#ef4444"),
    3: ("Reservoir Contraction", "Water Contraction", "#38bdf8"),
    4: ("Infrastructure & Roadway", "Infrastructure Addition", "#06b6d4"),
}
OTHER_CLASS = ("Temporal Change", "Land-Cover Conversion", "#f59e0b")

# Names of the three outcomes by index.
OUTCOME_LABELS = {
    "ndbi": ("New Construction / Urban Expansion", "Stable Impervious Surface", "Demolition / Surface Clearing"),
    "ndvi": ("Vegetation Growth / Greening", "Stable Flora / Canopy", "Vegetation Loss / Clearing"),
    "ndwi": ("Water Expansion / Flooding", "Stable Water Body", "Water Recession / Drying"),
}
OTHER_LABELS = ("Surface Activity Increase", "Stable Reflectance", "Surface Activity Decrease")


def pair_pixels(
    before: DataFrame, after: DataFrame, bands: Sequence[str], keys: Sequence[str] = ("scene_id", "row", "col")
) -> DataFrame:
    """Inner join on the common grid; band x becomes x1 (before) and x2 (after).

    The common extent is what both dates cover. Tables bucketed on the keys join without
    a shuffle.
    """
    old = before.select(*keys, *[F.col(b).alias(f"{b}1") for b in bands])
    new = after.select(*keys, *[F.col(b).alias(f"{b}2") for b in bands])
    return old.join(new, list(keys))


def change_magnitude(bands: Sequence[str] = ("r", "g", "b")) -> Column:
    """Mean absolute band difference of 8-bit pixels as a share of full scale."""
    total = F.lit(0.0)
    for b in bands:
        total = total + F.abs(F.col(f"{b}2") - F.col(f"{b}1")) / 255.0
    return total / float(len(bands))


def change_class(pairs: DataFrame, threshold: float = CHANGE_THRESHOLD) -> DataFrame:
    """Add ``cls``: 1 built-up, 2 vegetation loss, 3 water contraction, 0 unchanged; water goes first."""
    changed = change_magnitude() > threshold
    cls = (
        F.when(changed & (F.col("b1") > 100) & (F.col("b2") < 80), 3)
        .when(changed & (F.col("r2") > F.col("r1")), 1)
        .when(changed & (F.col("g1") > F.col("g2")), 2)
        .otherwise(0)
    )
    return pairs.withColumn("cls", cls)


def class_extents(classed: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Pixel count and pixel extent per (scene, class): the one wide shuffle of the change job."""
    return classed.groupBy(*keys, "cls").agg(
        F.count("*").alias("pixels"),
        F.min("row").alias("row_min"),
        F.max("row").alias("row_max"),
        F.min("col").alias("col_min"),
        F.max("col").alias("col_max"),
    )


def changed_classes(classed: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Distinct classes above zero per scene."""
    return classed.filter("cls > 0").select(*keys, "cls").distinct()


def change_totals(extents: DataFrame, gsd: float = DEFAULT_GSD_M, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Changed pixels, percent and areas per scene from the class extents."""
    changed = F.sum(F.when(F.col("cls") > 0, F.col("pixels")).otherwise(0))
    totals = extents.groupBy(*keys).agg(F.sum("pixels").alias("pixels"), changed.alias("changed_pixels"))
    area = F.col("changed_pixels") * float(gsd * gsd)
    percent = F.col("changed_pixels") * 100.0 / F.col("pixels")
    return totals.select(
        *keys,
        "pixels",
        "changed_pixels",
        percent.alias("change_percentage"),
        area.alias("area_m2"),
        (area / 1e4).alias("area_hectares"),
        (area / 1e6).alias("area_km2"),
        (F.round(percent, 1) > SIGNIFICANT_PERCENT).alias("has_significant_change"),
    )


def class_regions(
    extents: DataFrame,
    headers: DataFrame,
    gsd: float = DEFAULT_GSD_M,
    min_pixels: int = 15,
    class_map: dict[int, tuple[str, str, str]] | None = None,
    keys: Sequence[str] = ("scene_id",),
    extra: Sequence[str] = (),
) -> DataFrame:
    """One region per (scene, class) of at least ``min_pixels``: box in percent, area, confidence."""
    names = class_map or CHANGE_CLASSES
    kept = extents.filter((F.col("cls") > 0) & (F.col("pixels") >= min_pixels)).join(headers, list(keys))
    area = F.col("pixels") * float(gsd * gsd)
    extent = (F.col("row_max") - F.col("row_min") + 1) * (F.col("col_max") - F.col("col_min") + 1)
    density = F.col("pixels") / extent

    def pick(i: int) -> Column:
        chain = None
        for cls, entry in names.items():
            chain = F.when(F.col("cls") == cls, entry[i]) if chain is None else chain.when(F.col("cls") == cls, entry[i])
        return chain.otherwise(OTHER_CLASS[i])

    def percent(pixel: str, size: str) -> Column:
        return F.round(F.col(pixel) * 100.0 / F.col(size), 1)

    return kept.select(
        *keys,
        *extra,
        "cls",
        pick(0).alias("label"),
        pick(1).alias("change_type"),
        pick(2).alias("color"),
        "pixels",
        percent("row_min", "height").alias("ymin"),
        percent("col_min", "width").alias("xmin"),
        percent("row_max", "height").alias("ymax"),
        percent("col_max", "width").alias("xmax"),
        F.round(area, 1).alias("area_m2"),
        F.round(area / 1e4, 2).alias("area_hectares"),
        F.round(area / 1e6, 3).alias("area_km2"),
        density.alias("density"),
        F.least(F.greatest(density * 0.18 + 0.80, F.lit(0.82)), F.lit(0.98)).alias("confidence"),
    )


def area_by_type(regions: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Hectares and region count per change type."""
    return regions.groupBy(*keys, "change_type").agg(F.sum("area_hectares").alias("hectares"), F.count("*").alias("regions"))


# Index, texts of a rise and a fall, and the shift from which they apply.
INDICATORS = (
    ("ndvi", "Vegetation Regrowth / Canopy Expansion", "Vegetation Canopy Reduction", 0.05),
    ("ndbi", "Impervious / Built-up Construction Growth", "Demolition or Bare Soil Conversion", 0.05),
    ("ndwi", "Inundation / Water Basin Expansion", "Water Body Surface Area Contraction", 0.04),
)
NO_INDICATOR = "Stable spectral response with minimal land-cover conversion."
SHIFTS_LEAD = "Net index shifts: "


def _paired_index(index: str, epoch: int, **options) -> Column:
    first, second = ix.INDEX_BANDS[index]
    return ix.normalized_difference(f"{first}{epoch}", f"{second}{epoch}", **options)


def index_deltas(
    pairs: DataFrame, indices: Sequence[str] = ("ndvi", "ndwi", "ndbi"), keys: Sequence[str] = ("scene_id",)
) -> DataFrame:
    """Mean of each index on both dates, its delta, indicator list and a sentence, per scene."""
    aggs = [F.avg(_paired_index(i, e)).alias(f"{i}_{e}") for i in indices for e in (1, 2)]
    means = pairs.groupBy(*keys).agg(*aggs)
    means = means.withColumns({f"delta_{i}": F.col(f"{i}_2") - F.col(f"{i}_1") for i in indices})
    notes = []
    for index, up, down, limit in INDICATORS:
        if index not in indices:
            continue
        delta = F.round(f"delta_{index}", 4)
        text = F.format_string(f"%s (Δ{index.upper()}: %+.3f)", F.when(delta > 0, up).otherwise(down), delta)
        notes.append(F.when(F.abs(delta) > limit, text))
    found = F.array_compact(F.array(*notes))
    stable = F.array(F.lit(NO_INDICATOR))
    out = means.withColumn("indicators", F.when(F.size(found) > 0, found).otherwise(stable))
    parts = [F.format_string(f"Δ{i.upper()} = %+.3f", F.round(f"delta_{i}", 4)) for i in indices]
    return out.withColumn("interpretation", F.concat(F.lit(SHIFTS_LEAD), F.concat_ws(", ", *parts), F.lit(".")))


def index_change(
    pairs: DataFrame, index: str = "ndvi", band: float = 0.10, keys: Sequence[str] = ("scene_id",)
) -> DataFrame:
    """Percent improved / stable / declined and the mean delta of one index, per scene."""
    delta = ix.clipped_delta(_paired_index(index, 2), _paired_index(index, 1))
    d = pairs.select(*keys, delta.alias("delta"), _paired_index(index, 1).alias("v1"), _paired_index(index, 2).alias("v2"))

    def percent(name: str) -> Column:
        cls = ix.delta_class("delta", band)
        return F.avg(F.when(cls == name, 100.0).when(cls.isNotNull(), 0.0)).alias(f"{name}_percent")

    return d.groupBy(*keys).agg(
        F.count("delta").alias("pixels"),
        percent("improved"),
        percent("stable"),
        percent("declined"),
        F.avg("v1").alias("before_mean"),
        F.avg("v2").alias("after_mean"),
        F.avg("delta").alias("mean_change"),
    )


def change_summary(
    changes: DataFrame,
    index: str = "ndvi",
    area: str = "aoi_area_km2",
    before: str = "before_date",
    after: str = "after_date",
) -> DataFrame:
    """Areas, labels and a sentence for rows of ``index_change`` that carry an area and two dates."""
    labels = OUTCOME_LABELS.get(index, OTHER_LABELS)
    out = changes
    for name, label in zip(("improved", "stable", "declined"), labels):
        km2 = F.col(f"{name}_percent") / 100.0 * F.col(area)
        out = out.withColumn(f"{name}_label", F.lit(label)).withColumn(f"{name}_area_km2", km2)
    sentence = F.format_string(
        "%.2f km² between %s and %s: %s on %.1f%% (%.2f km²), %s on %.1f%% (%.2f km²), %s on %.1f%% (%.2f km²). "
        f"Mean shift %+.3f in {index.upper()}.",
        F.col(area),
        F.col(before),
        F.col(after),
        *[F.col(f"{n}_{c}") for n in ("improved", "stable", "declined") for c in ("label", "percent", "area_km2")],
        F.col("mean_change"),
    )
    return out.withColumn("summary", sentence)


def class_components(
    classed: DataFrame,
    headers: DataFrame,
    gsd: float = DEFAULT_GSD_M,
    min_pixels: int = 15,
    keys: Sequence[str] = ("scene_id",),
) -> DataFrame:
    """One region per connected group of changed pixels of a class: ``class_regions`` plus ``component``, its first pixel."""
    from scenelake.operators.components import component_sizes, label_runs

    by = ("cls", *keys)
    cells = classed.filter("cls > 0").select(*keys, "cls", "row", "col", F.lit(1).alias("mask"))
    sized = component_sizes(label_runs(cells, keys=by), by).withColumnRenamed("label", "component")
    return class_regions(sized, headers, gsd, min_pixels, keys=keys, extra=("component",))
