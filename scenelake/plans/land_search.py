"""Land search: requests in words to ranked regions on the ground."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions import geometry as geo
from scenelake.functions import indices as ix
from scenelake.operators import candidates as cd
from scenelake.operators.components import component_sizes, label_runs
from scenelake.operators.overlap import overlap_join
from scenelake.operators.query_text import parse_land_queries
from scenelake.session import cut_lineage, small


class LandSearch(NamedTuple):
    """Parsed requests, ranked candidates, one text row per request; candidates by distinct request, and who made it."""

    requests: DataFrame
    candidates: DataFrame
    answers: DataFrame
    shared: DataFrame
    searches: DataFrame


# Condition of a cell per search target, on the index columns.
def target_condition(target: str) -> Column:
    """Whether one observation of a cell shows a target."""
    conditions = {
        "potentially_vacant_land": ix.bare_land("ndvi", "ndwi", "ndbi"),
        "low_vegetation_health": (F.col("ndvi") < 0.20),
        "healthy_vegetation": F.col("ndvi") > 0.50,
        "water_bodies": F.col("ndwi") > 0.0,
        "built_up_infrastructure": F.col("ndbi") > 0.10,
    }
    return conditions[target]


BOX = ("x0", "y0", "x1", "y1")
CHANGE_TARGET = "land_use_change"
CHANGE_KINDS = ("built_up_gain", "vegetation_gain", "vegetation_loss")
CHANGE_SHIFT = 0.10
#: Scenes whose ids are broadcast to the scan of the pixels at most; more are met in a shuffle.
BROADCAST_SCENES = 1_000_000
TARGETS = ("potentially_vacant_land", "low_vegetation_health", "healthy_vegetation", "water_bodies", "built_up_infrastructure")


def region_table(
    px: DataFrame,
    headers: DataFrame,
    date: str,
    min_ratio: float,
    targets: Sequence[str] = TARGETS,
) -> DataFrame:
    """Connected regions whose cells show a target on at least ``min_ratio`` of their dates.

    Made once for all targets, whatever the number of requests. ``headers``: scene_id, a, c,
    e, f, epsg (4326), width, height.
    """
    return _described(_persistent_regions(px, headers, date, min_ratio, targets))


def _persistent_regions(px: DataFrame, headers: DataFrame, date: str, min_ratio: float, targets: Sequence[str]) -> DataFrame:
    values = px.select("scene_id", "row", "col", date, *[ix.index_column(i).alias(i) for i in ix.INDEX_BANDS])
    return _regions(cd.persistent_cells(values, {t: target_condition(t) for t in targets}, date, min_ratio), headers)


def _regions(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Connected regions of (target, scene_id, row, col, hits, observations) cells, their size and place on the ground."""
    keys = ("target", "scene_id")
    sums = {"hits": F.col("hits"), "observations": F.col("observations"), "row_sum": F.col("row"), "col_sum": F.col("col")}
    sized = component_sizes(label_runs(cells.withColumn("mask", F.lit(1)), keys=keys, **sums), keys, tuple(sums))
    h = sized.join(headers.select("scene_id", "a", "c", "e", "f", "epsg"), "scene_id")
    lon, lat = geo.pixel_to_geo(F.col("row_sum") / F.col("pixels"), F.col("col_sum") / F.col("pixels"))
    gsd = geo.gsd_metres(F.abs("a"), "epsg")
    return h.withColumns({"area_hectares": geo.area_units("pixels", gsd)["ha"], "lon": lon, "lat": lat}).drop("row_sum", "col_sum", "epsg")


def _described(regions: DataFrame) -> DataFrame:
    """Outline, persistence and confidence of ``_regions``; further columns go along."""
    x0, y0 = geo.pixel_to_geo(F.col("row_max") + 1, "col_min", centre=False)
    x1, y1 = geo.pixel_to_geo("row_min", F.col("col_max") + 1, centre=False)
    ratio = F.col("hits") / F.col("observations")
    years = F.concat_ws("-", F.split("target", r"\|")[1], F.split("target", r"\|")[2])
    shown = F.when(F.col("target").startswith(f"{CHANGE_TARGET}|"), years).otherwise(
        F.format_string("%d/%d observations", F.col("hits").cast("bigint"), F.col("observations").cast("bigint"))
    )
    raw = ("hits", "observations", "row_min", "row_max", "col_min", "col_max", "a", "c", "e", "f")
    own = ("scene_id", "label", "target", "pixels", "area_hectares", "lon", "lat")
    return regions.select(
        *own,
        geo.box_ring(x0, y0, x1, y1, 5).alias("ring"),
        ratio.alias("persistence_ratio"),
        shown.alias("temporal_persistence"),
        (F.lit(0.70) + ratio * 0.28).alias("confidence_score"),
        *[c for c in regions.columns if c not in (*own, *raw)],
    )


def change_target(kind: Column, from_year: Column, to_year: Column) -> Column:
    """Target name of a kind of change between two years."""
    return F.concat_ws("|", F.lit(CHANGE_TARGET), from_year.cast("string"), to_year.cast("string"), kind)


def change_region_table(px: DataFrame, headers: DataFrame, date: str, spans: DataFrame, shift: float = CHANGE_SHIFT) -> DataFrame:
    """Connected regions of one kind of change between the years of each row of ``spans`` (from_year, to_year).

    ``date`` holds the year of an observation. A cell that was seen in both years counts as built-up gain, vegetation
    gain or vegetation loss, whichever applies first, once the index has moved by more than ``shift``; of several
    observations of a year the mean counts.
    """
    return _described(_change_regions(px, headers, date, spans, shift))


def _change_regions(px: DataFrame, headers: DataFrame, date: str, spans: DataFrame, shift: float = CHANGE_SHIFT) -> DataFrame:
    side = F.explode(F.array(F.struct(F.col("from_year").alias("yr"), F.lit(1).alias("side")), F.struct(F.col("to_year").alias("yr"), F.lit(2).alias("side"))))
    wanted = spans.select("from_year", "to_year", side.alias("s")).select("from_year", "to_year", F.col("s.yr").alias("_yr"), "s.side")
    # years of no span are left out where the pixels are read
    years = small(cut_lineage(wanted.select(F.col("_yr").alias(date)).distinct()))
    near = px.join(years, date, "left_semi")
    values = near.select("scene_id", "row", "col", F.col(date).alias("_yr"), *[ix.index_column(i).alias(i) for i in ("ndvi", "ndbi")])
    mean = lambda i, k: F.avg(F.when(F.col("side") == k, F.col(i)))
    cells = values.join(wanted, "_yr").groupBy("from_year", "to_year", "scene_id", "row", "col").agg(
        (mean("ndvi", 2) - mean("ndvi", 1)).alias("dv"), (mean("ndbi", 2) - mean("ndbi", 1)).alias("db")
    )
    kind = F.when(F.col("db") > shift, "built_up_gain").when(F.col("dv") > shift, "vegetation_gain").when(F.col("dv") < -shift, "vegetation_loss")
    moved = cells.withColumn("kind", kind).filter("kind is not null")
    named = moved.select(
        change_target(F.col("kind"), F.col("from_year"), F.col("to_year")).alias("target"), "scene_id", "row", "col",
        F.lit(1).alias("hits"), F.lit(1).alias("observations"),
    )
    return _regions(named, headers)


def _for_each(rows: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the columns of ``found`` for their keys; null keys are equal."""
    other = found.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(lambda x, y: x & y, [rows[k].eqNullSafe(other[f"_of_{k}"]) for k in keys])
    return rows.join(other, same).drop(*[f"_of_{k}" for k in keys])


def land_search(
    px: DataFrame,
    headers: DataFrame,
    queries: DataFrame,
    gaz: DataFrame,
    date: str,
    min_ratio: float,
    areas: DataFrame | None = None,
    targets: Sequence[str] = TARGETS,
    cell: float = 1.0,
) -> LandSearch:
    """Answer (query_id, text) requests from pixels.

    A cell shows a target from the share ``min_ratio`` of its dates on. Candidates carry search_id, cand_id and name, so
    that they can be refined, ranked and rolled up as they are.
    ``areas`` (query_id, x0, y0, x1, y1) replaces the box around the named place. Requests for change between years get
    the regions of each kind of change between these years (``date`` then holds years). Pixels are grouped into regions
    once; only regions meet requests, by the scenes whose footprint overlaps the requested box. Equal requests are
    answered once and handed to every query that made them.
    """
    asks = queries.withColumn("of", F.sha2("text", 256))
    # Parsing is the dear part of the request side: done once for equal texts, and written once.
    texts = small(cut_lineage(parse_land_queries(asks.select("of", "text").distinct(), gaz).drop("text")))
    parsed = _for_each(asks, texts, ["of"]).drop("of")
    box = geo.radius_bbox("lat", "lon", "radius_km")
    own = {c: f"own_{c}" for c in BOX} if areas is not None else {}
    made = asks.join(areas.select("query_id", *[F.col(c).alias(o) for c, o in own.items()]), "query_id", "left") if own else asks
    kinds = ["of", *own.values()]
    placed = (_for_each(made.select(*kinds).distinct(), texts, ["of"]) if own else texts).filter("is_supported and lat is not null")
    placed = placed.select(
        *kinds, "target", "from_year", "to_year", "ranking_criteria", "lat", "lon",
        F.coalesce("minimum_area_hectares", F.lit(cd.MIN_AREA_HECTARES)).alias("minimum_area_hectares"),
        *[(F.coalesce(F.col(own[n]), c) if own else c).alias(n) for n, c in zip(BOX, box.values())],
    )
    fields = ["target", "from_year", "to_year", "ranking_criteria", "minimum_area_hectares", "lat", "lon", *BOX]
    # rows carry a digest of the request
    spec = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]).cast("binary"))
    wanted = cut_lineage(placed.withColumn("spec", spec).withColumn("place", F.concat_ws("|", *BOX)))
    asked = cut_lineage(_for_each(made, small(wanted.select(*kinds, "spec")), kinds).select("query_id", "spec"))
    specs = wanted.select("spec", "place", *fields).distinct()
    right, low = F.col("c") + F.col("a") * F.col("width"), F.col("f") + F.col("e") * F.col("height")
    footprints = headers.select(
        "scene_id", F.least("c", right).alias("x0"), F.least("f", low).alias("y0"), F.greatest("c", right).alias("x1"), F.greatest("f", low).alias("y1")
    )
    places = specs.select("place", *BOX).distinct()
    pairs = overlap_join(footprints, places, "scene_id", "place", cell).select(F.col("id_a").alias("scene_id"), F.col("id_b").alias("place"))
    met = cut_lineage(pairs.join(places, "place"))
    # pixels of scenes that no request meets are left out where they are read, while the list of scenes is not too long
    wanted_px = px.join(small(cut_lineage(met.select("scene_id").distinct()), BROADCAST_SCENES), "scene_id", "left_semi")
    found = _persistent_regions(wanted_px, headers, date, min_ratio, targets)
    spans = specs.filter(F.col("target") == CHANGE_TARGET).select("from_year", "to_year").distinct()
    found = found.unionByName(_change_regions(wanted_px, headers, date, spans))
    kinds = F.explode(F.array(*[change_target(F.lit(k), F.col("from_year"), F.col("to_year")) for k in CHANGE_KINDS]))
    change = specs.filter(F.col("target") == CHANGE_TARGET).withColumn("target", kinds)
    aims = specs.filter(F.col("target") != CHANGE_TARGET).unionByName(change).withColumnsRenamed({"lat": "lat0", "lon": "lon0"})
    inside = found.join(met, "scene_id").filter("lon >= x0 and lon <= x1 and lat >= y0 and lat <= y1")
    kept = cd.minimum_area(inside.join(aims.drop(*BOX), ["place", "target"]), "minimum_area_hectares")
    cand = _described(kept).withColumn("distance_km", geo.distance_km("lat", "lon", "lat0", "lon0")).withColumn(
        "cand_id", F.concat_ws("-", "scene_id", "label", F.nullif(F.split_part("target", F.lit("|"), F.lit(4)), F.lit("")))
    )
    ranked = cut_lineage(_rank_by_request(cut_lineage(cand.drop(*BOX, "lat0", "lon0", "place", "from_year", "to_year"))))
    by_query = asked.select("query_id", "spec")
    shared = ranked.withColumn("name", F.format_string("%s #%d", F.regexp_replace("target", "[_|]", " "), "rank"))
    named = cd.hand_out(shared, by_query, "spec").withColumn("search_id", F.col("query_id"))
    searches = by_query.withColumnRenamed("query_id", "search_id")
    return LandSearch(parsed, named, _answers(parsed, by_query, ranked), shared, searches)


def _rank_by_request(cand: DataFrame) -> DataFrame:
    """Rank the candidates of each distinct request by its own criteria, in one pass."""
    by = F.col("ranking_criteria")
    first = (
        F.when(by == "distance_asc", cd.to_the_metre("distance_km"))
        .when(by == "persistence_desc", -F.col("persistence_ratio"))
        .otherwise(-F.col("area_hectares"))
    )
    tied = cand.withColumn("_area", -F.col("area_hectares"))
    return cd.rank_within(tied, ["spec"], first, ["_area", "scene_id", "label", "target"]).drop("_area")


def _answers(parsed: DataFrame, by_query: DataFrame, ranked: DataFrame) -> DataFrame:
    folded = ranked.groupBy("spec").agg(
        F.count("*").alias("candidates"),
        F.sum("area_hectares").alias("total_hectares"),
        F.count_if(F.col("area_hectares") >= cd.LARGE_HECTARES).alias("large_candidates"),
        F.min_by(F.struct("area_hectares", "distance_km", "temporal_persistence"), "rank").alias("top"),
    )
    joined = parsed.select("query_id", "intent", "location", "radius_km", "minimum_area_hectares", "is_supported", "unsupported_reason", "lat").join(
        by_query.join(folded, "spec").drop("spec"), "query_id", "left"
    )
    status = (
        F.when(~F.col("is_supported"), "UNSUPPORTED_QUERY")
        .when(F.col("lat").isNull(), "UNKNOWN_LOCATION")
        .otherwise("COMPLETED")
    )
    none = F.format_string(
        "No area of at least %.1f hectares within %.1f km of %s.", F.coalesce("minimum_area_hectares", F.lit(cd.MIN_AREA_HECTARES)), "radius_km", "location"
    )
    some = F.format_string(
        "%d areas within %.1f km of %s, %.1f hectares in total, %d of them above %.1f ha; the first has %.1f ha at %.1f km (%s).",
        "candidates", "radius_km", "location", "total_hectares", "large_candidates", F.lit(cd.LARGE_HECTARES),
        "top.area_hectares", "top.distance_km", "top.temporal_persistence",
    )
    text = F.when(F.col("status") == "UNSUPPORTED_QUERY", F.col("unsupported_reason")).when(F.col("candidates") > 0, some).when(
        F.col("status") == "COMPLETED", none
    )
    return joined.withColumn("status", status).select(
        "query_id", "status", F.coalesce("candidates", F.lit(0)).alias("candidates"), "total_hectares", "large_candidates", text.alias("explanation")
    )
