"""Scene retrieval: requests in words to the best scene of each wanted date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions import geometry as geo
from scenelake.operators.catalog import days_apart, scene_score
from scenelake.operators.change import CHANGE_THRESHOLD, DEFAULT_GSD_M
from scenelake.operators.overlap import scene_aoi_overlap
from scenelake.operators.query_text import parse_retrieval_queries
from scenelake.plans.change_job import detect_change
from scenelake.session import cut_lineage

AOI_HALF_DEGREES = 0.06
# Tasks and sensor names of parsed requests.
CHANGE_TASK, RADAR_TASK = "Bi-Temporal Change Analysis", "SAR Radar Analysis"
OPTICAL_SENSOR = "Sentinel-2 MSI"


def retrieve_pairs(
    queries: DataFrame,
    scenes: DataFrame,
    gaz: DataFrame,
    max_cloud: float = 20.0,
    window_days: int = 60,
    half_side: float = AOI_HALF_DEGREES,
    cell: float = 1.0,
) -> DataFrame:
    """Best scene before and after per request (query_id, text).

    ``scenes``: product_id, product_type, sensor, collection, acquired_at, cloud, ord and the
    box x0, y0, x1, y1. Coverage is measured, not assumed. Scenes meet distinct places by the
    footprint join and are folded to the best one per place, sensor and date by aggregation;
    requests only look that up, so equal requests cost nothing extra. Requests for radar get, as
    ``partner``, the best optical scene of the same place and date as well. Each side has the number of scenes that
    were weighed for it, and the row has the requested box x0, y0, x1, y1.
    """
    parsed = parse_retrieval_queries(queries, gaz).filter("lat is not null")
    spec = ["lat", "lon", "sensor", "task", "date_a", "date_b"]
    asked = cut_lineage(parsed.select("query_id", *spec).withColumn("spec", F.concat_ws("|", *spec)))
    wanted = asked.drop("query_id").distinct().select(
        "spec", "sensor", "task",
        *[F.col(d).cast("timestamp_ntz").alias(d) for d in ("date_a", "date_b")],
        (F.col("lon") - half_side).alias("x0"), (F.col("lat") - half_side).alias("y0"),
        (F.col("lon") + half_side).alias("x1"), (F.col("lat") + half_side).alias("y1"),
    )
    fit = scenes.filter((F.col("collection") != "SENTINEL-2") | (F.col("cloud") <= max_cloud))
    # Areas meet scenes once per place; sensor and dates are compared after that.
    places = wanted.select("x0", "y0", "x1", "y1").distinct().withColumn("place", F.concat_ws("|", "x0", "y0", "x1", "y1"))
    met = scene_aoi_overlap(fit, places, "product_id", "place", cell).select(
        F.col("scene_id").alias("product_id"), F.col("aoi_id").alias("place"), F.col("overlap_pct").alias("overlap")
    )
    scene = fit.select("product_id", "product_type", "sensor", "acquired_at", "cloud", "ord")
    sides = F.array(
        F.struct(F.lit("before").alias("side"), F.col("sensor"), F.col("date_a").alias("target_date")),
        F.struct(F.lit("after").alias("side"), F.col("sensor"), F.col("date_b").alias("target_date")),
        F.struct(F.lit("partner").alias("side"), F.when(F.col("task") == RADAR_TASK, OPTICAL_SENSOR).alias("sensor"), F.col("date_a").alias("target_date")),
    )
    dated = wanted.select("spec", F.concat_ws("|", "x0", "y0", "x1", "y1").alias("place"), F.inline(sides)).filter("sensor is not null")
    # A target date is needed by many requests of a place: scenes are scored once for it.
    goals = dated.select("place", "sensor", "target_date").distinct()
    # Scenes meet only the dates of their own and the next date buckets, not all dates of a place.
    slot = lambda date: F.floor(F.datediff(date, F.lit("1970-01-01")) / (window_days + 1))
    around = F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: slot("target_date") + k))
    near = days_apart("acquired_at", "target_date") <= window_days
    placed = met.join(scene.withColumn("slot", slot("acquired_at")), "product_id")
    met_dates = placed.join(goals.withColumn("slot", around), ["place", "sensor", "slot"])
    scored = met_dates.filter(near).withColumn("score", scene_score("target_date"))
    picked = F.max_by(F.struct("product_id", "acquired_at", "score"), F.struct(F.col("score"), -F.col("ord")))
    best = scored.groupBy("place", "sensor", "target_date").agg(picked.alias("_best"), F.count("*").alias("weighed"))
    best = best.select("place", "sensor", "target_date", "_best.*", "weighed")
    chosen = dated.join(best, ["place", "sensor", "target_date"])

    def pick(side: str, name: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(name))).alias(f"{side}_{name}")

    facts = ("product_id", "acquired_at", "score", "weighed")
    paired = chosen.groupBy("spec").agg(*[pick(s, n) for s in ("before", "after", "partner") for n in facts])
    boxes = wanted.select("spec", "x0", "y0", "x1", "y1")
    out = asked.select("query_id", "task", "spec").join(paired.join(boxes, "spec"), "spec").drop("spec")
    change = F.col("task") == CHANGE_TASK
    return out.withColumns({f"after_{n}": F.when(change, F.col(f"after_{n}")) for n in facts})


def retrieve_change(
    pairs: DataFrame, px: DataFrame, headers: DataFrame, gsd: float = DEFAULT_GSD_M, threshold: float = CHANGE_THRESHOLD
) -> DataFrame:
    """Change between the two scenes that each request was given: from the rows of ``retrieve_pairs`` to the answer.

    ``px``: product_id, row, col, r, g, b; ``headers``: product_id, height, width. Only pixels of chosen scenes are
    read, each distinct pair is compared once, and requests look its result up. Requests for one scene, and those
    without a scene on one side, have no row.
    """
    both = pairs.filter("before_product_id is not null and after_product_id is not null")
    both = cut_lineage(both.select("query_id", "before_product_id", "after_product_id"))
    chosen = both.drop("query_id").distinct().withColumn("pair", F.concat_ws("|", "before_product_id", "after_product_id"))

    def side(name: str) -> DataFrame:
        named = chosen.select(F.col(f"{name}_product_id").alias("product_id"), F.col("pair").alias("scene_id"))
        return px.select("product_id", "row", "col", "r", "g", "b").join(named, "product_id").drop("product_id")

    sizes = headers.select("product_id", "height", "width").join(
        chosen.select(F.col("before_product_id").alias("product_id"), F.col("pair").alias("scene_id")), "product_id"
    )
    done = detect_change(side("before"), side("after"), sizes.drop("product_id"), gsd, threshold).summary
    return both.join(chosen, ["before_product_id", "after_product_id"]).join(done.withColumnRenamed("scene_id", "pair"), "pair").drop("pair")


def request_boxes(parsed: DataFrame, half_side: float = AOI_HALF_DEGREES) -> DataFrame:
    """Ring of the area around each located request."""
    lon, lat = F.col("lon"), F.col("lat")
    return parsed.filter("lat is not null").select(
        "query_id", geo.box_ring(lon - half_side, lat - half_side, lon + half_side, lat + half_side).alias("ring")
    )
