"""Per-scene statistics of bands, indices and class masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.functions import indices as ix

# Statistics reported for a band without a valid pixel.
EMPTY_BAND = {"min": 0.0, "max": 255.0, "mean": 128.0, "std": 0.0}


# Parts of a caption.
CAPTION_VEGETATION = "%.1f%% active vegetation canopy (mean NDVI %.2f)"
CAPTION_BUILT = "%.1f%% built-up impervious structures (mean NDBI %.2f)"
CAPTION_WATER = "%.1f%% surface water bodies (mean NDWI %.2f)"
CAPTION_LEAD = "This optical multispectral observation displays a landscape characterized by "
CAPTION_NONE = "Optical imagery showing mixed urban, agricultural, and natural terrain."
CAPTION_RADAR = "Radar image with %d high-intensity double-bounce sectors."
CAPTION_RADAR_NONE = "Radar image without high-intensity double-bounce sectors."


def band_stats(px_long: DataFrame, keys: Sequence[str] = ("scene_id",), digits: int | None = 2) -> DataFrame:
    """min, max, mean and population std per band over all valid pixels."""
    v = F.col("value").cast("double")
    stats = px_long.groupBy(*keys, "band").agg(
        F.count(v).alias("valid_pixels"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
    )
    filled = {name: F.coalesce(F.col(name), F.lit(default)) for name, default in EMPTY_BAND.items()}
    if digits is not None:
        filled = {name: F.round(c, digits) for name, c in filled.items()}
    return stats.withColumns(filled)


def _shares(index: str) -> dict:
    v = F.col(index)
    if index == "ndvi":
        return {"vegetated_pct": v > 0.4, "bare_land_pct": (v >= 0.0) & (v < 0.25)}
    if index == "ndwi":
        return {"water_body_pct": v > 0.0}
    return {"built_up_pct": v > 0.1}


def _percent(condition) -> F.Column:
    return F.avg(F.when(condition, 100.0).when(condition.isNotNull(), 0.0))


def index_stats(
    px: DataFrame,
    indices: Sequence[str] = ("ndvi", "ndwi", "ndbi"),
    keys: Sequence[str] = ("scene_id",),
    **options,
) -> DataFrame:
    """One row per (scene, index): moments, threshold shares and class percentages.

    All indices come from one pass and one partial aggregation, so a scene that holds
    most of the pixels is folded map-side before it is shuffled.
    """
    values = px.select(*keys, *[ix.index_column(i, **options).alias(i) for i in indices])
    aggs, rows = [], []
    for i in indices:
        v = F.col(i)
        high, low, *names = ix.INDEX_CLASSES[i]
        shares = _shares(i)
        aggs += [
            F.count(v).alias(f"{i}_n"),
            F.avg(v).alias(f"{i}_mean"),
            F.min(v).alias(f"{i}_min"),
            F.max(v).alias(f"{i}_max"),
            F.stddev_pop(v).alias(f"{i}_std"),
            *[_percent(c).alias(f"{i}_{name}") for name, c in shares.items()],
            _percent(v > high).alias(f"{i}_c0"),
            _percent((v >= low) & (v <= high)).alias(f"{i}_c1"),
            _percent(v < low).alias(f"{i}_c2"),
        ]
        rows.append(
            F.struct(
                F.lit(i).alias("index"),
                F.col(f"{i}_n").alias("valid_pixels"),
                *[F.col(f"{i}_{s}").alias(s) for s in ("mean", "min", "max", "std")],
                F.create_map(*[x for name in shares for x in (F.lit(name), F.col(f"{i}_{name}"))]).alias("shares"),
                F.create_map(*[x for k, name in enumerate(names) for x in (F.lit(name), F.col(f"{i}_c{k}"))]).alias(
                    "class_breakdown"
                ),
            )
        )
    return values.groupBy(*keys).agg(*aggs).select(*keys, F.inline(F.array(*rows)))


def class_breakdown(df: DataFrame, class_col: str, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Map from class to percent of the classified pixels, per scene.

    Two steps: counts per (scene, class) with map-side combine, then one small row per class.
    """
    counts = df.filter(F.col(class_col).isNotNull()).groupBy(*keys, class_col).agg(F.count("*").alias("n"))
    entries = F.sort_array(F.collect_list(F.struct(F.col(class_col).alias("class"), "n")))
    folded = counts.groupBy(*keys).agg(F.sum("n").alias("pixels"), entries.alias("entries"))
    percent = F.transform(
        "entries", lambda e: F.struct(e["class"].alias("key"), (e["n"] * 100.0 / F.col("pixels")).alias("value"))
    )
    return folded.select(*keys, "pixels", F.map_from_entries(percent).alias("class_breakdown"))


def missing_share(px: DataFrame, band: str, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Percent of missing values of a band over all pixels of a scene."""
    missing = F.col(band).isNull() | F.isnan(F.col(band))
    return px.groupBy(*keys).agg(F.count("*").alias("pixels"), _percent(missing).alias("nodata_percentage"))


def scene_caption(stats: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Land-cover sentence per scene from the rows of ``index_stats``."""

    def share(index: str, name: str):
        return F.max(F.when(F.col("index") == index, F.col("shares")[name]))

    def mean(index: str):
        return F.max(F.when(F.col("index") == index, F.col("mean")))

    facts = stats.groupBy(*keys).agg(
        share("ndvi", "vegetated_pct").alias("veg"),
        mean("ndvi").alias("veg_mean"),
        share("ndbi", "built_up_pct").alias("built"),
        mean("ndbi").alias("built_mean"),
        share("ndwi", "water_body_pct").alias("water"),
        mean("ndwi").alias("water_mean"),
    )
    phrases = F.concat_ws(
        ", ",
        F.when(F.col("veg") > 0, F.format_string(CAPTION_VEGETATION, "veg", "veg_mean")),
        F.when(F.col("built") > 0, F.format_string(CAPTION_BUILT, "built", "built_mean")),
        F.when(F.col("water") > 0, F.format_string(CAPTION_WATER, "water", "water_mean")),
    )
    return facts.select(
        *keys,
        "veg",
        "built",
        "water",
        F.when(phrases != "", F.concat(F.lit(CAPTION_LEAD), phrases, F.lit("."))).otherwise(CAPTION_NONE).alias("caption"),
    )


def radar_caption(structures: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Sentence per radar scene from its count of high-return regions."""
    return structures.select(
        *keys,
        "structures",
        F.when(F.col("structures") > 0, F.format_string(CAPTION_RADAR, "structures")).otherwise(CAPTION_RADAR_NONE).alias("caption"),
    )
