"""Percentile stretch, composites and previews as 8-bit tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions.radar import to_db
from scenelake.operators.quantiles import quantiles


def _valid(value: Column, valid: str) -> Column:
    usable = value.isNotNull() & ~F.isnan(value)
    if valid == "positive":
        return usable & (value > 0)
    if valid == "finite":
        return usable
    raise ValueError(f"valid must be 'positive' or 'finite', not {valid!r}")


def stretched(value: Column, low: Column, high: Column) -> Column:
    """8-bit value between two limits; no limits or no value gives 0."""
    top = F.when(high <= low, low + 1.0).otherwise(high)
    ratio = (value - low) / (top - low)
    clipped = F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0))
    usable = value.isNotNull() & ~F.isnan(value) & low.isNotNull()
    return F.when(usable, F.floor(clipped * 255.0)).otherwise(0).cast("int")


def stretch(
    df: DataFrame,
    value: str,
    lower: float = 0.02,
    upper: float = 0.98,
    keys: Sequence[str] = ("scene_id",),
    valid: str = "positive",
    out: str = "byte",
) -> DataFrame:
    """Stretch one column to 8 bit between two exact percentiles of its group."""
    v = F.col(value).cast("double")
    usable = df.filter(_valid(v, valid))
    limits = quantiles(usable, keys, value, (lower, upper), ("_low", "_high"))
    joined = df.join(limits, list(keys), "left")
    return joined.withColumn(out, stretched(v, F.col("_low"), F.col("_high"))).drop("_low", "_high")


def linear_scenes(px: DataFrame, bands: Sequence[str] = ("vv", "vh"), keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Per scene: is the radar still linear power (no negative value) rather than dB."""
    lowest = F.least(*[F.col(b) for b in bands]) if len(bands) > 1 else F.col(bands[0])
    return px.groupBy(*keys).agg((F.min(F.when(~F.isnan(lowest), lowest)) >= 0).alias("is_linear"))


def radar_to_db(px: DataFrame, bands: Sequence[str] = ("vv", "vh"), keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Convert the scenes that are linear, leave those already in dB."""
    flagged = px.join(linear_scenes(px, bands, keys), list(keys))
    converted = {b: F.when(F.col("is_linear"), to_db(b)).otherwise(F.col(b)) for b in bands}
    return flagged.withColumns(converted).drop("is_linear")


def radar_composite(px_db: DataFrame, keys: Sequence[str] = ("scene_id",), valid: str = "finite") -> DataFrame:
    """r = VV, g = VH, b = their absolute difference; grey where a scene has no VH."""
    long = px_db.select(*keys, "row", "col", F.stack(F.lit(2), F.lit("vv"), F.col("vv"), F.lit("vh"), F.col("vh")).alias("pol", "value"))
    usable = long.filter(_valid(F.col("value"), valid))
    limits = quantiles(usable, [*keys, "pol"], "value", (0.01, 0.99), ("low", "high"))
    per_scene = limits.groupBy(*keys).agg(
        *[F.max(F.when(F.col("pol") == p, F.col(s))).alias(f"_{p}_{s}") for p in ("vv", "vh") for s in ("low", "high")]
    )
    joined = px_db.join(per_scene, list(keys), "left")
    vv = stretched(F.col("vv"), F.col("_vv_low"), F.col("_vv_high"))
    vh = stretched(F.col("vh"), F.col("_vh_low"), F.col("_vh_high"))
    dual = F.col("_vh_low").isNotNull()
    return joined.select(
        *keys,
        "row",
        "col",
        vv.alias("r"),
        F.when(dual, vh).otherwise(vv).alias("g"),
        F.when(dual, F.abs(vv - vh)).otherwise(vv).alias("b"),
    )


def normalize_reflectance(df: DataFrame, bands: Sequence[str] = ("r", "g", "b"), keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Bring bands to 0..1: scenes with a value above 1 are taken as 8 bit."""
    peak = df.groupBy(*keys).agg(F.max(F.greatest(*[F.col(b).cast("double") for b in bands])).alias("_peak"))
    joined = df.join(peak, list(keys))

    def scaled(band: str) -> Column:
        v = F.col(band).cast("double")
        v = F.when(F.col("_peak") > 1.0, v / 255.0).otherwise(v)
        return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))

    return joined.withColumns({b: scaled(b) for b in bands}).drop("_peak")


def composite_choice(scenes: DataFrame, kind: str = "true_color") -> DataFrame:
    """Band numbers for r, g, b of each classified scene, and what they show.

    ``scenes`` is the output of ``classify_scenes``. Near-infrared or shortwave bands never
    stand in for green or blue.
    """
    role = F.col("role_map")
    total = F.col("total_bands").cast("int")

    def first(*names: str) -> Column:
        return F.coalesce(*[F.try_element_at(role, F.lit(n)) for n in names])

    red, green, blue, nir = first("B04", "Red"), first("B03", "Green"), first("B02", "Blue"), first("B08")
    vv = F.coalesce(first("VV"), F.lit(1))
    vh = F.coalesce(first("VH"), F.least(F.lit(2), total))

    def pick(a: Column, b: Column, c: Column, label: str) -> Column:
        return F.struct(a.cast("int").alias("r"), b.cast("int").alias("g"), c.cast("int").alias("b"), F.lit(label).alias("shows"))

    one = F.lit(1)
    is_sar = F.col("raster_type") == "SAR"
    if kind == "true_color":
        choice = (
            F.when(red.isNotNull() & green.isNotNull() & blue.isNotNull(), pick(red, green, blue, "true color"))
            .when(total == 3, pick(one, F.lit(2), F.lit(3), "standard 3-band"))
            .when(is_sar, pick(vv, vh, vv, "radar polarimetric"))
            .when(red.isNotNull() & nir.isNotNull(), pick(nir, red, red, "false color nir-red"))
            .when(red.isNotNull(), pick(red, red, red, "red grey"))
            .otherwise(pick(one, one, one, "single channel grey"))
        )
    elif kind == "false_color_nir":
        choice = (
            F.when(is_sar, pick(vv, vh, vv, "radar polarimetric"))
            .when(nir.isNotNull() & red.isNotNull() & green.isNotNull(), pick(nir, red, green, "false color infrared"))
            .when(nir.isNotNull() & red.isNotNull(), pick(nir, red, red, "false color nir-red"))
            .when(total >= 3, pick(F.lit(3), one, F.lit(2), "simulated infrared"))
            .otherwise(pick(one, one, one, "single channel grey"))
        )
    else:
        raise ValueError(f"unknown composite {kind!r}")
    return scenes.select("scene_id", "total_bands", choice.alias("choice")).select("scene_id", "total_bands", "choice.*")


def custom_choice(headers: DataFrame, triplet: Sequence[int]) -> DataFrame:
    """Band numbers given by hand, kept inside the bands a scene has."""
    total = F.col("total_bands").cast("int")
    picks = [F.least(F.greatest(F.lit(1), F.lit(int(k))), total).alias(n) for n, k in zip("rgb", triplet)]
    return headers.select("scene_id", "total_bands", *picks, F.lit("custom").alias("shows"))


def composite(px_long: DataFrame, choice: DataFrame, lower: float = 0.02, upper: float = 0.98) -> DataFrame:
    """Stretched 8-bit r, g, b pixels of the chosen bands.

    The choice is turned into (scene, band) rows, so bands that are not shown drop out
    before the percentiles and the one shuffle that brings the channels together.
    """
    used = choice.select("scene_id", F.explode(F.array_distinct(F.array("r", "g", "b"))).alias("band"))
    values = px_long.join(used, ["scene_id", "band"])
    bytes_ = stretch(values, "value", lower, upper, keys=("scene_id", "band"))
    stacked = bytes_.join(choice.select("scene_id", "r", "g", "b"), "scene_id").groupBy("scene_id", "row", "col")
    return stacked.agg(
        *[F.max(F.when(F.col("band") == F.col(c), F.col("byte"))).alias(f"_{c}") for c in "rgb"]
    ).select("scene_id", "row", "col", *[F.coalesce(F.col(f"_{c}"), F.lit(0)).alias(c) for c in "rgb"])


def preview(rgb: DataFrame, headers: DataFrame, max_size: int = 1024) -> DataFrame:
    """Shrink r, g, b pixels by block average so that no side exceeds ``max_size``."""
    step = F.greatest(F.ceil(F.greatest("height", "width") / float(max_size)), F.lit(1)).cast("int")
    scaled = rgb.join(headers.select("scene_id", step.alias("step")), "scene_id")
    cell = [F.call_function("div", F.col(c), F.col("step")).alias(c) for c in ("row", "col")]
    return (
        scaled.select("scene_id", *cell, "r", "g", "b")
        .groupBy("scene_id", "row", "col")
        .agg(*[F.floor(F.avg(c)).cast("int").alias(c) for c in "rgb"])
    )
