"""Target regions: mask, clean-up, components, best k, percent boxes, ground coordinates."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions import geometry as geo
from scenelake.functions.boxes import is_large_enough
from scenelake.functions.crs import to_wgs84
from scenelake.functions.optical import excess_green, target_mask, track_mask
from scenelake.functions.radar import grounding_mask
from scenelake.operators import morphology as mo
from scenelake.operators.components import component_sizes, label_runs
from scenelake.operators.quantiles import counted_quantiles, quantiles
from scenelake.operators.ranking import top_k
from scenelake.session import cut_lineage


class Recipe(NamedTuple):
    """How a target is cleaned, scored and boxed."""

    share: float
    least: int
    closing: bool
    min_pixels: int
    pad: float
    min_side: bool


# Window share of the shorter side, its lower bound, filter, smallest area, pad.
RECIPES = {
    "trees": Recipe(0.012, 2, False, 25, 0.5, True),
    "sports": Recipe(0.025, 3, True, 20, 0.8, True),
    "water": Recipe(0.02, 2, True, 20, 0.5, False),
    "urban": Recipe(0.015, 2, False, 40, 0.5, False),
}
DENSITY_SHARE, DENSITY_LEAST = 0.06, 5
DENSITY_QUANTILE, DENSITY_FALLBACK = 0.80, 0.05

# Label, colour and base confidence of grounded targets.
GROUNDED = {
    "sports": ("Playground / Athletic Facility", "#f59e0b", 0.95),
    "trees": ("Dense Vegetation / Canopy", "#10b981", 0.95),
    "water": ("Water Body / Hydrological Basin", "#06b6d4", 0.93),
    "urban": ("Target Feature", "#10b981", 0.88),
    "radar_strong": ("Strong Radar Backscatter / Built Structure", "#f59e0b", 0.91),
    "radar_water": ("Specular Zero-Return / Water Body", "#06b6d4", 0.93),
    "radar_rough": ("Vegetation Volume Scattering", "#10b981", 0.86),
    "radar_other": ("SAR Identified Feature", "#38bdf8", 0.88),
}
OVERVIEW = {
    "trees": "Dense Tree Canopy",
    "urban": "Built-Up Structures",
    "sports": "Open Ground / Facility",
    "water": "Hydrological Surface",
}
RADAR_MIN_PIXELS = 20


def _window(share: float, least: int) -> Column:
    side = F.least(F.col("height"), F.col("width"))
    return F.greatest(F.lit(least), F.floor(side * share)).cast("int")


def _urban_seed(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Cells whose density of bright roofs is in the top fifth of the scene's positive densities."""
    dense = mo.density(cells, headers, _window(DENSITY_SHARE, DENSITY_LEAST), "urban")
    counts = dense.filter("hits > 0").groupBy("scene_id", "density").agg(F.count("*").alias("n"))
    limits = counted_quantiles(counts, ["scene_id"], "density", [DENSITY_QUANTILE], ["limit"])
    joined = dense.join(limits.select("scene_id", "limit"), "scene_id", "left")
    enough = F.col("density") >= F.coalesce("limit", F.lit(DENSITY_FALLBACK))
    return joined.withColumn("urban", enough.cast("int")).drop("hits", "density", "limit")


def _of_side(headers: DataFrame, min_side: int) -> DataFrame:
    return headers.filter((F.col("height") >= min_side) & (F.col("width") >= min_side)) if min_side else headers


def cleaned_masks(px: DataFrame, headers: DataFrame, features: Sequence[str], min_side: int = 0) -> DataFrame:
    """r, g, b pixels with one cleaned 0/1 mask column per target; all masks share their passes.

    Window sizes follow each scene's own side. ``min_side`` leaves out smaller scenes.
    """
    usable = _of_side(headers, min_side)
    seeds = {f: target_mask(f).cast("int") for f in features}
    cells = px.join(usable.select("scene_id"), "scene_id", "left_semi").withColumns(seeds)
    if "urban" in features:
        cells = _urban_seed(cells, usable)
    columns = cells.columns
    sizes = usable.select("scene_id", *[_window(RECIPES[f].share, RECIPES[f].least).alias(f"_size_{f}") for f in features])
    filters = {f: mo.MaskFilter(F.col(f"_size_{f}"), RECIPES[f].closing) for f in features}
    return mo.filter_masks(cells.join(sizes, "scene_id"), filters).select(*columns)


KEYS = ("feature", "scene_id")


def _percent_boxes(labelled: DataFrame, chosen: DataFrame, headers: DataFrame) -> DataFrame:
    """Box from the 1st to the 99th percentile of rows and columns, in percent with the pad."""
    keys, probs = [*KEYS, "label"], [0.01, 0.99]
    members = labelled.join(chosen.select(*keys), keys, "left_semi")
    rows = members.groupBy(*keys, "row").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("n"))
    cols = (
        members.select(*keys, F.explode(F.sequence("c0", "c1")).alias("col")).groupBy(*keys, "col").agg(F.count("*").alias("n"))
    )
    by_row = counted_quantiles(rows, keys, "row", probs, ["row_lo", "row_hi"])
    by_col = counted_quantiles(cols, keys, "col", probs, ["col_lo", "col_hi"])
    joined = chosen.join(by_row, keys).join(by_col, keys).join(headers.select("scene_id", "height", "width"), "scene_id")

    def low(c: str, side: str) -> Column:
        return F.greatest(F.lit(0.0), F.col(c) / F.col(side) * 100.0 - F.col("pad"))

    def high(c: str, side: str) -> Column:
        return F.least(F.lit(100.0), F.col(c) / F.col(side) * 100.0 + F.col("pad"))

    return joined.select(
        *chosen.columns,
        low("row_lo", "height").alias("ymin"),
        low("col_lo", "width").alias("xmin"),
        high("row_hi", "height").alias("ymax"),
        high("col_hi", "width").alias("xmax"),
    )


def _per_feature(values: dict) -> Column:
    """A recipe value picked by the feature column."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("feature"))


def scored_components(labelled: DataFrame) -> DataFrame:
    """Components worth boxing, with their score, from labelled runs that carry exg and track."""
    sized = component_sizes(labelled, KEYS, ("exg", "track"))
    area = F.col("pixels").cast("double")
    score = (
        # area x (mean excess green + 10), without the division so that equal scores stay equal
        F.when(F.col("feature") == "trees", F.col("exg") + area * 10.0)
        .when(F.col("feature") == "sports", area + F.col("track") * 25.0)
        .otherwise(area)
    )
    sized = sized.withColumn("_large", F.col("pixels") >= _per_feature({f: r.min_pixels for f, r in RECIPES.items()}))
    # Sports scenes without a large enough ground fall back to plain area.
    grounds = sized.filter("feature = 'sports'").groupBy(*KEYS).agg(F.bool_or("_large").alias("_any"))
    joined = sized.join(grounds, list(KEYS), "left")
    fallback = (F.col("feature") == "sports") & ~F.col("_any")
    kept = joined.filter(F.col("_large") | fallback)
    return kept.withColumn("score", F.when(fallback, area).otherwise(score)).drop("_large", "_any")


def target_regions(
    px: DataFrame, headers: DataFrame, features: str | Sequence[str], k: int = 3, digits: int | None = 2, min_side: int = 0
) -> DataFrame:
    """Up to k boxes of each target per scene, best first.

    ``px``: scene_id, row, col, r, g, b (0..255); ``headers``: scene_id, height, width. All
    targets share one labelling. ``min_side`` leaves out scenes with a shorter side.
    """
    names = [features] if isinstance(features, str) else list(features)
    cleaned = cleaned_masks(px, headers, names, min_side)
    rows = F.filter(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("mask")) for f in names]), lambda m: m["mask"] == 1)
    masks = cleaned.select("scene_id", "row", "col", "r", "g", "b", F.inline(rows))
    labelled = label_runs(masks, keys=KEYS, exg=excess_green(), track=track_mask().cast("int"))
    scored = scored_components(labelled).withColumn("pad", _per_feature({f: r.pad for f, r in RECIPES.items()}))
    boxes = _boxed(labelled, scored, headers, k)
    needs_side = F.col("feature").isin(*[f for f, r in RECIPES.items() if r.min_side])
    return _rounded(boxes.filter(~needs_side | is_large_enough()), digits)


def _boxed(labelled: DataFrame, scored: DataFrame, headers: DataFrame, k: int) -> DataFrame:
    best = top_k(scored, KEYS, [F.col("score").desc(), F.col("label")], k)
    chosen = cut_lineage(best.select(*KEYS, "label", F.col("rank").cast("bigint").alias("rank"), "pixels", "score", "pad"))
    return _percent_boxes(labelled, chosen, headers).drop("pad")


def _rounded(boxes: DataFrame, digits: int | None) -> DataFrame:
    if digits is None:
        return boxes
    return boxes.withColumns({c: F.round(c, digits) for c in ("ymin", "xmin", "ymax", "xmax")})


def radar_regions(
    px_db: DataFrame, headers: DataFrame, intent: str, k: int = 3, digits: int | None = 2, min_side: int = 0
) -> DataFrame:
    """Up to k boxes of a radar target (strong, water, rough, other) per scene, largest first."""
    usable = _of_side(headers, min_side)
    cells = px_db.join(usable.select("scene_id"), "scene_id", "left_semi").withColumns(
        {"mask": grounding_mask(intent).cast("int"), "feature": F.lit(f"radar_{intent}")}
    )
    labelled = label_runs(cells, keys=KEYS)
    scored = component_sizes(labelled, KEYS).filter(F.col("pixels") >= RADAR_MIN_PIXELS)
    scored = scored.withColumn("score", F.col("pixels").cast("double")).withColumn("pad", F.lit(0.5))
    return _rounded(_boxed(labelled, scored, headers, k), digits)


def scene_overview(px: DataFrame, headers: DataFrame, digits: int | None = 2) -> DataFrame:
    """Best box of each target per scene."""
    best = target_regions(px, headers, list(OVERVIEW), 1, digits)
    return best.withColumn("label", _per_feature(OVERVIEW)).withColumn("confidence", F.lit(0.93))


def ground(boxes: DataFrame, headers: DataFrame, feature: str) -> DataFrame:
    """Georeferenced regions of percent boxes: WGS84 ring, box, centroid, area, label, confidence.

    ``headers``: scene_id, a, c, e, f, width, height, epsg. The confidence drops by 0.02 per
    position.
    """
    label, color, confidence = GROUNDED[feature]
    j = boxes.join(headers.select("scene_id", "a", "c", "e", "f", "width", "height", "epsg"), "scene_id")

    def pixel(c: str, side: str) -> Column:
        return F.floor(F.col(c) / 100.0 * F.col(side)).cast("bigint")

    j = j.withColumns(
        {"_y0": pixel("ymin", "height"), "_x0": pixel("xmin", "width"), "_y1": pixel("ymax", "height"), "_x1": pixel("xmax", "width")}
    )

    def place(row: Column, col: Column) -> Column:
        x, y = geo.pixel_to_geo(row, col)
        return to_wgs84(x, y, F.col("epsg"))

    y0, x0, y1, x1 = (F.col(c) for c in ("_y0", "_x0", "_y1", "_x1"))
    corners = [place(y0, x0), place(y0, x1), place(y1, x1), place(y1, x0)]
    j = j.withColumn("ring", F.array(*corners, corners[0]))
    middle = place(F.floor((y0 + y1) / 2.0), F.floor((x0 + x1) / 2.0))
    gsd = geo.gsd_metres(F.abs("a"), "epsg")
    area = F.greatest(F.lit(1), (y1 - y0) * (x1 - x0)) * gsd * gsd
    return j.select(
        "scene_id",
        "rank",
        F.format_string("%s #%d", F.lit(label), "rank").alias("label"),
        F.lit(label).alias("category"),
        (F.lit(confidence) - F.col("rank") * 0.02).alias("confidence"),
        "ymin",
        "xmin",
        "ymax",
        "xmax",
        "ring",
        *[c.alias(n) for n, c in geo.ring_bbox("ring").items()],
        middle["lon"].alias("centroid_lon"),
        middle["lat"].alias("centroid_lat"),
        area.alias("area_m2"),
        (area / 1e4).alias("area_ha"),
        F.lit(color).alias("color"),
    )


def region_quantiles(px: DataFrame, value: str) -> DataFrame:
    """Stretch limits (1st and 99th percentile) of a value per scene."""
    return quantiles(px, ["scene_id"], value, (0.01, 0.99), ("low", "high"))
