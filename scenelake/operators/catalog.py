"""Scene catalog: filters, scoring, ranking, best scenes and pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions import geometry as geo
from scenelake.operators.ranking import rank_within, top_one

OPTICAL_COLLECTION = "SENTINEL-2"
OPTICAL_SENSOR = "Sentinel-2 MSI"


def filter_scenes(
    scenes: DataFrame,
    bbox: Sequence[float] | None = None,
    start: str | None = None,
    end: str | None = None,
    max_cloud: float | None = None,
    collection: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Scenes that meet a box, a closed range of days, a cloud limit (optical only), a collection.

    All predicates are plain comparisons on columns, so they reach the file scan. With a
    ``limit`` the clearest, then earliest scenes are kept.
    """
    if start and end and start > end:
        raise ValueError(f"start {start} is after end {end}")
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    out = scenes
    if collection is not None:
        out = out.filter(F.col("collection") == collection)
    if start:
        out = out.filter(F.col("acquired_at") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        out = out.filter(F.col("acquired_at") < F.lit(end).cast("timestamp_ntz") + F.expr("interval 1 day"))
    if max_cloud is not None:
        out = out.filter((F.col("collection") != OPTICAL_COLLECTION) | (F.col("cloud") <= max_cloud))
    if bbox is not None:
        x0, y0, x1, y1 = (float(b) for b in bbox)
        out = out.filter((F.col("x0") <= x1) & (F.col("x1") >= x0) & (F.col("y0") <= y1) & (F.col("y1") >= y0))
    if limit is not None:
        out = clearest(out, limit)
    return out


def clearest(scenes: DataFrame, limit: int) -> DataFrame:
    """First scenes by cloud, then date."""
    return scenes.orderBy("cloud", "acquired_at", "product_id").limit(limit)


def chronological(scenes: DataFrame, limit: int) -> DataFrame:
    """First scenes by date."""
    return scenes.orderBy("acquired_at", "product_id").limit(limit)


def sensor_or_all(scenes: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """Scenes whose sensor contains one of the words; all scenes when none does."""
    hit = F.lit(False)
    for word in sensors:
        hit = hit | F.lower("sensor").contains(word.lower())
    found = scenes.agg(F.coalesce(F.bool_or(hit), F.lit(False))).scalar()
    return scenes.filter(hit | ~found)


def wants_radar(sensors: str | Column) -> Column:
    """A requested sensor list asks for radar: any entry with a 1 or SAR."""
    return F.exists(sensors, lambda s: s.contains("1") | s.contains("SAR"))


def days_apart(a: str | Column, b: str | Column) -> Column:
    """Whole days between two timestamps, floored, then absolute."""
    left, right = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    seconds = F.timestamp_diff("SECOND", right, left)
    return F.abs(F.floor(seconds / 86400.0)).cast("bigint")


def scene_score(target: str | Column | None = "target_date") -> Column:
    """Score 0.1..0.99 from cloud, days from the target, coverage and product level."""
    optical = F.col("sensor") == OPTICAL_SENSOR
    clear = F.greatest(F.lit(0.0), 1.0 - F.col("cloud") / 30.0)
    score = F.when(optical, clear * 0.40 + 0.60).otherwise(1.0)
    if target is not None:
        near = F.greatest(F.lit(0.0), 1.0 - days_apart("acquired_at", target) / 60.0) * 0.30 + 0.70
        score = score * F.coalesce(near, F.lit(1.0))
    score = score * (F.col("overlap") / 100.0 * 0.20 + 0.80)
    kind = F.upper("product_type")
    calibrated = kind.contains("2A") | kind.contains("GRD")
    raw = kind.contains("1C") | kind.contains("SLC")
    score = score + F.when(calibrated, 0.08).when(raw, -0.05).otherwise(0.0)
    return F.least(F.lit(0.99), F.greatest(F.lit(0.1), score))


# Texts of a selection reason.
REASON_LEAD = "Selected for optimal observation quality: "
REASON_RADAR = "all-weather radar penetration (0% cloud interference)"
REASON_CLEAR = "exceptional clear-sky quality (%.1f%% cloud)"
REASON_LOW = "low cloud coverage (%.1f%%)"
REASON_MODERATE = "moderate cloud (%.1f%%)"
REASON_OFFSET = "temporal offset: %d days from requested target"
REASON_COVERAGE = "%.0f%% AOI spatial coverage"
REASON_CALIBRATED = "calibrated Bottom-of-Atmosphere / GRD product"
REASON_RAW = "uncalibrated Top-of-Atmosphere / SLC product"
REASON_OTHER = "Candidate rank #%d (Score: %.2f)"


def score_reasons(target: str | Column | None = "target_date") -> Column:
    """What made a scene's score, factor by factor."""
    optical = F.col("sensor") == OPTICAL_SENSOR
    sky = (
        F.when(~optical, REASON_RADAR)
        .when(F.col("cloud") < 5.0, F.format_string(REASON_CLEAR, "cloud"))
        .when(F.col("cloud") < 15.0, F.format_string(REASON_LOW, "cloud"))
        .otherwise(F.format_string(REASON_MODERATE, "cloud"))
    )
    parts = [sky]
    if target is not None:
        parts.append(F.format_string(REASON_OFFSET, days_apart("acquired_at", target)))
    parts.append(F.format_string(REASON_COVERAGE, "overlap"))
    kind = F.upper("product_type")
    parts.append(
        F.when(kind.contains("2A") | kind.contains("GRD"), REASON_CALIBRATED).when(kind.contains("1C") | kind.contains("SLC"), REASON_RAW)
    )
    return F.concat(F.lit(REASON_LEAD), F.concat_ws("; ", *parts), F.lit("."))


def rank_scenes(
    scenes: DataFrame, keys: Sequence[str] = ("request_id",), target: str | None = "target_date", order: str = "ord"
) -> DataFrame:
    """Score and rank the scenes of each request; equal scores keep the order of ``order``."""
    scored = scenes.withColumn("score", scene_score(target))
    ranked = rank_within(scored, keys, -F.col("score"), [order])
    best = F.col("rank") == 1
    reason = F.when(best, score_reasons(target)).otherwise(F.format_string(REASON_OTHER, "rank", "score"))
    return ranked.withColumn("is_selected", best).withColumn("reason", reason)


def best_scene(
    scenes: DataFrame, keys: Sequence[str] = ("request_id",), target: str | None = "target_date", order: str = "ord"
) -> DataFrame:
    """Top scene per request, without ranking the others."""
    scored = scenes.withColumn("score", scene_score(target))
    return top_one(scored, keys, [F.col("score"), -F.col(order)]).withColumn("reason", score_reasons(target))


def best_pair(
    before: DataFrame,
    after: DataFrame,
    keys: Sequence[str] = ("request_id",),
    target_before: str | None = "target_date",
    target_after: str | None = "target_date",
) -> DataFrame:
    """Best scene of each side per request; reasons carry the role when both sides exist."""
    fields = ("product_id", "acquired_at", "score", "reason")
    sides = []
    for df, target, side in ((before, target_before, "before"), (after, target_after, "after")):
        best = best_scene(df, keys, target)
        sides.append(best.select(*keys, *[F.col(f).alias(f"{side}_{f}") for f in fields]))
    both = sides[0].join(sides[1], list(keys), "full_outer")
    complete = F.col("before_product_id").isNotNull() & F.col("after_product_id").isNotNull()
    for side, lead in (("before", "Optimal Baseline (T1): "), ("after", "Optimal Monitoring (T2): ")):
        reason = F.col(f"{side}_reason")
        both = both.withColumn(f"{side}_reason", F.when(complete, F.concat(F.lit(lead), reason)).otherwise(reason))
    return both


# --- product identifiers


def product_date(product_id: str | Column) -> Column:
    """Acquisition date in an optical level-2A product id, NULL without one."""
    c = F.col(product_id) if isinstance(product_id, str) else product_id
    return F.try_to_date(F.nullif(F.regexp_extract(c, r"MSIL2A_(\d{8})", 1), F.lit("")), "yyyyMMdd")


def product_sensor(product_id: str | Column) -> Column:
    c = F.col(product_id) if isinstance(product_id, str) else product_id
    return F.when(c.contains("S1"), "Sentinel-1 SAR C-Band").otherwise(OPTICAL_SENSOR)


def cache_key(product_id: str | Column, bbox: Sequence[str | Column] | None = None) -> Column:
    """First 16 hex digits of the sha256 of the id, with the box appended when there is one."""
    c = F.col(product_id) if isinstance(product_id, str) else product_id
    text = c
    if bbox:
        text = F.concat(c, F.lit("_["), F.concat_ws(", ", *[(F.col(b) if isinstance(b, str) else b).cast("string") for b in bbox]), F.lit("]"))
    return F.substring(F.sha2(text, 256), 1, 16)


def bbox_columns(x0: str | Column, y0: str | Column, w: str | Column) -> dict[str, Column]:
    """Far corner of square footprints."""
    return {"x1": geo._c(x0) + geo._c(w), "y1": geo._c(y0) + geo._c(w)}
