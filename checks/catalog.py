"""Registered queries over the scene catalog and land-search candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.geometry import footprint_boxes
from checks.pixels import NDBI, NDVI, NDWI
from checks.views import fixed, sfixed, sql
from scenelake.functions import geometry as geo
from scenelake.functions import indices as ix
from scenelake.operators import candidates as cd
from scenelake.operators import catalog as cat
from scenelake.sources import files, geojson, stac, store

QUERIES: dict = {}
SQL: dict[str, str] = {}


def boxed_catalog(spark, sf):
    return v.catalog(spark, sf).withColumns(cat.bbox_columns("x0", "y0", "w"))


# --- P6 / P7 filters, W4 orders
QUERIES["p6_filter_scenes"] = lambda spark, sf: cat.filter_scenes(
    boxed_catalog(spark, sf), bbox=(-60.0, -40.0, 90.0, 45.0), start="1996-02-10", end="1999-07-31", max_cloud=25.0, collection="SENTINEL-2"
).select("product_id", "cloud", "overlap")
SQL["p6_filter_scenes"] = sql(
    "catalog",
    """select product_id, cloud, overlap from catalog where collection = 'SENTINEL-2' and acquired_at >= timestamp '1996-02-10' and acquired_at < timestamp '1999-08-01'
    and cloud <= 25 and x0 <= 90 and x0 + w >= -60 and y0 <= 45 and y0 + w >= -40""",
)
QUERIES["w4_clearest_scenes"] = lambda spark, sf: cat.filter_scenes(boxed_catalog(spark, sf), max_cloud=10.0, collection="SENTINEL-2", limit=50).select(
    "product_id", "cloud"
)
SQL["w4_clearest_scenes"] = sql("catalog", "select product_id, cloud from catalog where collection = 'SENTINEL-2' and cloud <= 10 order by cloud, acquired_at, product_id limit 50")
QUERIES["w4_chronological"] = lambda spark, sf: cat.chronological(v.catalog(spark, sf), 40).select("product_id")
SQL["w4_chronological"] = sql("catalog", "select product_id from catalog order by acquired_at, product_id limit 40")


def _sensors(spark, sf):
    scenes = v.catalog(spark, sf)
    hit = cat.sensor_or_all(scenes, ["sar"]).select("product_id", F.lit("sar").alias("asked"))
    miss = cat.sensor_or_all(scenes, ["landsat"]).select("product_id", F.lit("landsat").alias("asked"))
    radar = cat.wants_radar(F.array(F.col("product_type"), F.lit("optical")))
    return hit.unionByName(miss).unionByName(scenes.filter(radar).select("product_id", F.lit("radar request").alias("asked")))


QUERIES["p7_sensor_or_all"] = _sensors
SQL["p7_sensor_or_all"] = sql(
    "catalog",
    """select product_id, 'sar' as asked from catalog where contains(lower(sensor), 'sar') union all select product_id, 'landsat' from catalog
    union all select product_id, 'radar request' from catalog where contains(product_type, '1')""",
)

# --- W1 / W2 / J9
SCORE = """sc as (select *, least(0.99e0, greatest(0.1e0,
   (case when sensor = 'Sentinel-2 MSI' then greatest(0e0, 1e0 - cloud / 30e0) * 0.4e0 + 0.6e0 else 1e0 end)
   * (greatest(0e0, 1e0 - abs(floor(epoch(acquired_at - target_date) / 86400e0)) / 60e0) * 0.3e0 + 0.7e0) * (overlap / 100e0 * 0.2e0 + 0.8e0)
   + (case when contains(product_type, '2A') or contains(product_type, 'GRD') then 0.08e0 else -0.05e0 end))) as score from catalog),
rk as (select *, row_number() over (partition by request_id order by score desc, ord) as rank from sc)"""
REASON = """'Selected for optimal observation quality: ' || (case when sensor <> 'Sentinel-2 MSI' then 'all-weather radar penetration (0% cloud interference)'
  when cloud < 5 then printf('exceptional clear-sky quality (%.1f%% cloud)', cloud) when cloud < 15 then printf('low cloud coverage (%.1f%%)', cloud) else printf('moderate cloud (%.1f%%)', cloud) end)
  || printf('; temporal offset: %d days from requested target; %.0f%% AOI spatial coverage; ', cast(abs(floor(epoch(acquired_at - target_date) / 86400e0)) as bigint), overlap)
  || (case when product_type = 'S2MSI1C' then 'uncalibrated Top-of-Atmosphere / SLC product' else 'calibrated Bottom-of-Atmosphere / GRD product' end) || '.'"""
QUERIES["w1_rank_scenes"] = lambda spark, sf: cat.rank_scenes(v.catalog(spark, sf)).select(
    "request_id", "ord", "rank", "score", "is_selected", F.when(F.col("is_selected"), F.col("reason")).alias("reason")
)
SQL["w1_rank_scenes"] = sql("catalog", f"with {SCORE} select request_id, ord, rank, score, rank = 1 as is_selected, case when rank = 1 then {REASON} end as reason from rk")
QUERIES["w2_best_scene"] = lambda spark, sf: cat.best_scene(v.catalog(spark, sf)).select("request_id", "product_id", "score", "reason")
SQL["w2_best_scene"] = sql("catalog", f"with {SCORE} select request_id, product_id, score, {REASON} as reason from rk where rank = 1")


def _pairs(spark, sf):
    scenes = v.catalog(spark, sf)
    border = F.col("acquired_at") < F.col("target_date")
    out = cat.best_pair(scenes.filter(border), scenes.filter(~border))
    return out.select("request_id", "before_product_id", "before_score", "after_product_id", "after_score", F.md5(F.col("before_reason").cast("binary")).alias("before_reason"))


QUERIES["j9_best_pair"] = _pairs
SQL["j9_best_pair"] = sql(
    "catalog",
    f"""with {SCORE}, side as (select *, acquired_at < target_date as old, row_number() over (partition by request_id, acquired_at < target_date order by score desc, ord) as k from sc),
    b as (select request_id, product_id, score, 'Optimal Baseline (T1): ' || {REASON} as reason from side where old and k = 1), a as (select * from side where not old and k = 1)
    select coalesce(b.request_id, a.request_id) as request_id, b.product_id as before_product_id, b.score as before_score, a.product_id as after_product_id, a.score as after_score,
    md5(b.reason) as before_reason from b full join a on b.request_id = a.request_id""",
)

# --- F19, F20, S7, J10
QUERIES["f19_product_dates"] = lambda spark, sf: v.catalog(spark, sf).select(
    "ord", F.date_format(cat.product_date("product_id"), "yyyy-MM-dd").alias("day"), cat.product_sensor("product_id").alias("sensor"),
    cat.days_apart("acquired_at", "target_date").alias("days"),
)
SQL["f19_product_dates"] = sql(
    "catalog",
    """select ord, case when contains(product_id, 'MSIL2A_') then strftime(acquired_at, '%Y-%m-%d') end as day, sensor,
    cast(abs(floor(epoch(acquired_at - target_date) / 86400e0)) as bigint) as days from catalog""",
)
KEYED = """k as (select *, substring(sha256(product_id || '_[' || x0 || ', ' || y0 || ', ' || (x0 + w) || ', ' || (y0 + w) || ']'), 1, 16) as key from catalog)"""
QUERIES["f20_cache_keys"] = lambda spark, sf: store.with_key(boxed_catalog(spark, sf), ["x0", "y0", "x1", "y1"]).select(
    "ord", F.col("key"), cat.cache_key("product_id").alias("plain_key")
)
SQL["f20_cache_keys"] = sql("catalog", f"with {KEYED} select ord, key, substring(sha256(product_id), 1, 16) as plain_key from k")


def _new_products(spark, sf):
    keyed = v.catalog(spark, sf).select("request_id", "product_type", "ord", F.concat_ws("|", "product_type", F.weekofyear("acquired_at"), "request_id").alias("product_id"))
    keyed = store.with_key(keyed)
    return store.new_products(keyed, keyed.filter("product_type = 'S1_GRD'")).select("key", "product_id", "ord")


QUERIES["s7_new_products"] = _new_products
SQL["s7_new_products"] = sql(
    "catalog",
    """with p as (select request_id, product_type, ord, product_type || '|' || weekofyear(acquired_at) || '|' || request_id as product_id from catalog)
    select substring(sha256(product_id), 1, 16) as key, product_id, min(ord) as ord from p where product_type <> 'S1_GRD' group by product_id""",
)
QUERIES["j10_cached_products"] = lambda spark, sf: store.cached_products(
    store.with_key(v.catalog(spark, sf)), store.with_key(v.catalog(spark, sf).filter("cloud > 30"))
).select("product_id")
SQL["j10_cached_products"] = sql("catalog", "select product_id from catalog where cloud > 30")

# --- candidates
AT = "distance_km"


def candidates(spark, sf):
    return v.cand(spark, sf).withColumn(AT, F.floor(geo.distance_km("lat", "lon", 0.0, 0.0) * 10.0 + 0.5) / 10.0)


CAND = """c as (select *, floor(sqrt(((lat - 0e0) * 111e0) * ((lat - 0e0) * 111e0) + ((lon - 0e0) * (cos(0e0) * 111e0)) * ((lon - 0e0) * (cos(0e0) * 111e0))) * 10e0 + 0.5e0) / 10e0 as distance_km from cand)"""
ORDERS = {
    "area_desc": "area_hectares desc",
    "distance_asc": "distance_km",
    "persistence_desc": "persistence_ratio desc, area_hectares desc",
    "confidence_desc": "confidence_score desc",
}


def _ranked(spark, sf):
    out = None
    for criteria in ORDERS:
        one = cd.rank_candidates(candidates(spark, sf), criteria).select("search_id", "cand_id", "rank", F.lit(criteria).alias("criteria"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES["w3_rank_candidates"] = _ranked
SQL["w3_rank_candidates"] = sql(
    "cand",
    f"with {CAND} " + " union all ".join(f"select search_id, cand_id, row_number() over (partition by search_id order by {o}, cand_id) as rank, '{n}' as criteria from c" for n, o in ORDERS.items()),
)
QUERIES["w7_nearest"] = lambda spark, sf: cd.nearest(candidates(spark, sf)).select("search_id", "cand_id", AT)
SQL["w7_nearest"] = sql("cand", f"with {CAND} select search_id, cand_id, distance_km from c qualify row_number() over (partition by search_id order by distance_km, cand_id) = 1")
QUERIES["p17_minimum_area"] = lambda spark, sf: cd.minimum_area(v.cand(spark, sf)).select("cand_id", "area_hectares")
SQL["p17_minimum_area"] = sql("cand", "select cand_id, area_hectares from cand where area_hectares >= 0.5e0")
QUERIES["a8_candidate_rollup"] = lambda spark, sf: cd.rollup(v.cand(spark, sf)).select(
    "search_id", "candidates", fixed("total_hectares").alias("ha"), "large_candidates", "largest"
)
SQL["a8_candidate_rollup"] = sql(
    "cand",
    f"""select search_id, count(*) as candidates, {sfixed('sum(area_hectares)')} as ha, count(*) filter (where area_hectares >= 3) as large_candidates,
    first(cand_id order by area_hectares desc, cand_id) as largest from cand group by 1""",
)


def _prompts(spark, sf):
    k = F.col("n_nationkey")
    text = (
        F.when(k % 4 == 0, F.format_string("Only show areas larger than %d hectares", k % 7 + 1))
        .when(k % 4 == 1, "Which one is the closest?")
        .when(k % 4 == 2, "Keep the consistent ones")
        .otherwise("Thanks")
    )
    return v.table(spark, sf, "nation").select(k.alias("search_id"), text.alias("prompt"))


REFINED = f"""{CAND}, r as (select *, case search_id % 4 when 0 then 'area' when 1 then 'nearest' when 2 then 'persistence' else 'none' end as rule from c),
f as (select * from r where (rule <> 'area' or area_hectares >= search_id % 7 + 1) and (rule <> 'persistence' or persistence_ratio >= 0.8e0))"""
QUERIES["p16_refine_candidates"] = lambda spark, sf: cd.refine_candidates(candidates(spark, sf), _prompts(spark, sf)).select("search_id", "cand_id", "rule", "position")
SQL["p16_refine_candidates"] = sql(
    "cand",
    f"with {REFINED} select search_id, cand_id, rule, row_number() over (partition by search_id order by case when rule = 'nearest' then distance_km else 0 end, cand_id) as position from f",
)
QUERIES["p16_refine_reply"] = lambda spark, sf: cd.refine_reply(cd.refine_candidates(candidates(spark, sf), _prompts(spark, sf)))
SQL["p16_refine_reply"] = sql(
    "cand",
    f"""with {REFINED}, t as (select search_id, rule, count(*) as n, first(name order by distance_km, cand_id) as name, first(distance_km order by distance_km, cand_id) as km,
      first(area_hectares order by distance_km, cand_id) as ha from f group by 1, 2)
    select search_id, rule, n as count, case rule when 'area' then n || ' candidate area(s) larger than ' || (search_id % 7 + 1) || '.0 hectares.'
      when 'nearest' then 'The closest candidate is ''' || name || ''', ' || printf('%.1f', km) || ' km away (' || printf('%.1f', ha) || ' ha).'
      when 'persistence' then n || ' candidate(s) stay bare across most observations.' else n || ' candidate areas remain active.' end as reply from t""",
)


def bare(px):
    return ix.bare_land(ix.ndvi(), ix.ndwi(), ix.ndbi())


QUERIES["a16_persistence"] = lambda spark, sf: cd.persistence(v.px_time(spark, sf), bare(None), "yr").select(
    "scene_id", "row", "col", "observations", "hits", "last_date", "persistence_ratio", "persistence_label"
)
SQL["a16_persistence"] = sql(
    "px_time",
    f"""with d as (select scene_id, row, col, yr, bool_or({NDVI} < 0.25e0 and {NDWI} < 0 and {NDBI} < 0.15e0) as bare from px_time group by 1, 2, 3, 4),
    p as (select scene_id, row, col, count(*) as observations, count(*) filter (where bare) as hits, max(yr) as last_date from d group by 1, 2, 3)
    select *, hits / cast(observations as double) as persistence_ratio, case when hits >= 0.8e0 * observations then 'high' when hits >= 0.5e0 * observations then 'medium' else 'low' end as persistence_label from p""",
)


def _features(spark, sf):
    ring = geo.box_ring("x0", "y0", "x1", "y1")
    text = footprint_boxes(spark, sf).select("id", geojson.feature(ring, ["id", "grp"]).alias("text"))
    at = lambda i, k: F.get_json_object("text", f"$.geometry.coordinates[0][{i}][{k}]").cast("double")
    return text.select(
        "id", F.get_json_object("text", "$.properties.grp").cast("int").alias("grp"), F.get_json_object("text", "$.geometry.type").alias("kind"),
        fixed(at(0, 0), 5).alias("lon0"), fixed(at(2, 1), 5).alias("lat2"), (at(0, 0) == at(4, 0)).alias("closed"),
    )


QUERIES["s6_geojson"] = _features
SQL["s6_geojson"] = sql("footprints", f"select id, grp, 'Polygon' as kind, {sfixed('x0', 5)} as lon0, {sfixed('y0 + w', 5)} as lat2, true as closed from footprints")
AUDIT_NAMES = "concat('/in/', page_id, array('-s2.tif', '_sar.TIFF', '_sentinel-1.png', '_change.jpg', '_x.jpeg', '.gif', '')[page_id % 7])"


def _listing(spark, sf):
    """A listing made of the pages: file names of all kinds, sizes of the pages, signatures for some."""
    head = "case page_id % 4 when 0 then concat(unhex('49492A00'), cast(html as binary)) when 1 then concat(unhex('89504E47'), cast(html as binary)) when 2 then concat(unhex('FFD8FF'), cast(html as binary)) else cast(html as binary) end"
    return v.table(spark, sf, "pages").selectExpr(
        f"{AUDIT_NAMES} as path", "if(page_id % 11 = 0, 0L, cast(octet_length(html) as bigint)) as length", f"{head} as content",
        "if(page_id % 13 = 0, 'no data', null) as error", "page_id % 17 as width", "page_id % 5 as bands", "if(page_id % 3 = 0, null, 4326) as epsg",
    )


QUERIES["s2_audit_rows"] = lambda spark, sf: files.audit_rows(_listing(spark, sf), signature=True, require_crs=True).select(
    "path", "filename", "extension", "length", "status", "is_valid", "modality", "bands"
)
SQL["s2_audit_rows"] = """with l as (select page_id as p, '/in/' || page_id || ['-s2.tif', '_sar.TIFF', '_sentinel-1.png', '_change.jpg', '_x.jpeg', '.gif', ''][page_id % 7 + 1] as path,
    case when page_id % 11 = 0 then 0 else strlen(html) end as length, page_id % 7 as k, page_id % 4 as s, html from pages),
  m as (select *, k < 5 as known, case when k <= 1 then s = 0 when k = 2 then s = 1 when k <= 4 then s = 2 else false end as signed from l),
  t as (select *, case when not known then 'UNSUPPORTED_FORMAT' when length = 0 or not signed then 'CORRUPTED_FILE' when p % 13 = 0 then 'READ_ERROR'
    when p % 17 = 0 or p % 5 = 0 or p % 3 = 0 then 'INVALID' else 'VALID' end as status from m)
  select path, substring(path, 5) as filename, ['tif', 'tiff', 'png', 'jpg', 'jpeg', 'gif', ''][k + 1] as extension, length, status, status = 'VALID' as is_valid,
    ['Multispectral', 'SAR', 'SAR', 'Bi-Temporal Pair', 'Optical', 'Optical', 'Optical'][k + 1] as modality,
    cast([12, 2, 2, 4, 3, 3, 3][k + 1] as integer) as bands from t"""


def _stac(spark, sf):
    """Feature collections as JSON text made of the catalog, one per request and day, read back as scenes."""
    c = boxed_catalog(spark, sf)
    props = F.struct(
        F.when(F.col("ord") % 3 == 0, F.col("product_id")).alias("id"),
        F.when(F.col("ord") % 2 == 0, F.date_format("acquired_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("datetime"),
        F.date_format("acquired_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("start_datetime"),
        F.when(F.col("ord") % 5 != 0, F.col("cloud")).alias("eo:cloud_cover"),
        (F.col("cloud") / 2.0).alias("cloudCoverage"),
        F.when(F.col("ord") % 4 == 0, F.lit("T43")).alias("mgrs"),
    )
    item = F.struct(F.when(F.col("ord") % 3 != 0, F.col("product_id")).alias("id"), F.array("x0", "y0", "x1", "y1").alias("bbox"), props.alias("properties"))
    text = c.select(F.to_json(F.struct(F.array(item).alias("features"))).alias("text"))
    scenes = stac.stac_rows(text.select(F.from_json("text", stac.STAC_SCHEMA).alias("t")).select("t.*"), "SENTINEL-2")
    return scenes.select(
        "product_id", fixed("cloud", 1).alias("cloud"), "platform", "tile_id", "x0", "y1", F.array_join("bands", ",").alias("bands"),
        F.date_format("acquired_at", "yyyy-MM-dd").alias("day"),
    )


QUERIES["s3_stac_items"] = _stac
SQL["s3_stac_items"] = sql(
    "catalog",
    f"""select product_id, {sfixed('case when ord % 5 <> 0 and cloud <> 0 then cloud else cloud / 2e0 end', 1)} as cloud, 'Sentinel-2B' as platform, case when ord % 4 = 0 then 'T43' else 'T44N' end as tile_id,
    x0, y0 + w as y1, 'B02,B03,B04,B08,B11,B12' as bands, strftime(acquired_at, '%Y-%m-%d') as day from catalog""",
)
