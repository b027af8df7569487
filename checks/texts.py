"""Registered queries over text tables: routing, field extraction, boxes in text, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.pixels import NDBI, NDVI, NDWI
from checks.views import fixed, sfixed, sql
from scenelake.functions import boxes as bx
from scenelake.functions import optical as opt
from scenelake.functions import text as tx
from scenelake.operators import box_text, gazetteer
from scenelake.operators import query_text as qt
from scenelake.operators.stats import index_stats
from scenelake.sources.gazetteer import places

QUERIES: dict = {}
SQL: dict[str, str] = {}


def has(words, c: str = "q") -> str:
    return "(" + " or ".join(f"contains({c}, '{w}')" for w in words) + ")"


Q = "q as (select query_id, text, lower(trim(text)) as q from queries)"

# --- Q1 routing
QUERIES["q1_route_tasks"] = lambda spark, sf: qt.route_tasks(v.queries(spark, sf)).select(
    "query_id", "task", F.concat_ws("+", "tools").alias("tools"), "is_multi_tool"
)
SQL["q1_route_tasks"] = sql(
    "queries",
    f"""with {Q}, p as (select query_id, case when {has(qt.CROSS_MODAL_WORDS)} then 1 when {has(qt.COMPOUND_WORDS)} and {has(qt.TWO_DATE_WORDS)} then 2
      when {has(qt.CHANGE_WORDS)} then 3 when {has(qt.GROUNDING_WORDS)} then 4 when {has(qt.CAPTION_WORDS)} then 5 else 6 end as k from q)
    select query_id, ['OPTICAL_SAR','TEMPORAL_CHANGE','TEMPORAL_CHANGE','GROUNDING','SINGLE_CAPTION','SINGLE_VQA'][k] as task,
      ['OpticalSAR','ChangeDetection+SpectralAnalysis+SingleImageVQA','ChangeDetection','Grounding','Captioning','SingleImageVQA'][k] as tools, k = 2 as is_multi_tool from p""",
)


def _routed_with_inputs(spark, sf):
    i = F.col("query_id")
    wanted = F.when(i % 6 == 1, F.element_at(F.array(*[F.lit(t.lower()) for t in qt.TASK_TOOLS]), (i % 5 + 1).cast("int")))
    df = v.queries(spark, sf).select("*", wanted.alias("wanted"), (i % 4 == 0).alias("pair"), (i % 9 == 0).alias("cross"))
    return qt.route_tasks(df, preferred="wanted", has_pair="pair", has_optical_sar="cross").select(
        "query_id", "task", F.size("tools").alias("n_tools"), qt.auto_task("text").alias("auto")
    )


QUERIES["q1_route_tasks_with_inputs"] = _routed_with_inputs
SQL["q1_route_tasks_with_inputs"] = sql(
    "queries",
    f"""with {Q}, p as (select query_id, query_id % 6 = 1 as given, query_id % 5 + 1 as w, case when query_id % 9 = 0 or {has(qt.CROSS_MODAL_WORDS)} then 1
      when {has(qt.COMPOUND_WORDS)} and (query_id % 4 = 0 or {has(qt.TWO_DATE_WORDS)}) then 2
      when query_id % 4 = 0 or {has(qt.CHANGE_WORDS)} then 3 when {has(qt.GROUNDING_WORDS)} then 4 when {has(qt.CAPTION_WORDS)} then 5 else 6 end as k,
      case when {has(qt.AUTO_CAPTION_WORDS)} then 'captioning' when {has(qt.AUTO_GROUNDING_WORDS)} then 'grounding' else 'vqa' end as auto from q)
    select query_id, case when given then ['SINGLE_VQA','SINGLE_CAPTION','GROUNDING','TEMPORAL_CHANGE','OPTICAL_SAR'][w] else
      ['OPTICAL_SAR','TEMPORAL_CHANGE','TEMPORAL_CHANGE','GROUNDING','SINGLE_CAPTION','SINGLE_VQA'][k] end as task,
      cast(case when not given and k = 2 then 3 else 1 end as integer) as n_tools, auto from p""",
)

# --- Q2 land search fields
PLACE = """place as (select query_id, first(key order by ord) as key from (select query_id, key, ord from q join gaz on regexp_matches(q, '\\b' || key || '\\b')) group by 1)"""
QUERIES["q2_land_fields"] = lambda spark, sf: qt.parse_land_queries(v.queries(spark, sf), v.gaz(spark, sf)).select(
    "query_id", "intent", "target", "analysis", "location", "radius_km", fixed("minimum_area_hectares").alias("min_ha"), "ranking_criteria",
    "from_year", "to_year", "is_supported",
)
SQL["q2_land_fields"] = sql(
    "queries gaz",
    f"""with {Q}, {PLACE}, f as (select q.query_id, q, key, not {has(qt.UNSUPPORTED_WORDS)} as ok,
      try_cast(regexp_extract(q, 'within\\s+(\\d+(?:\\.\\d+)?)\\s*km', 1) as double) as km,
      try_cast(regexp_extract(q, '{qt.AREA_PATTERN}', 1) as double) * (case when regexp_extract(q, '{qt.AREA_PATTERN}', 2) like 'acre%' then {qt.HECTARES_PER_ACRE} else 1e0 end) as ha,
      list_transform(regexp_extract_all(q, '{qt.YEAR_PATTERN}', 1), lambda y: cast(y as integer)) as ys from q left join place on q.query_id = place.query_id),
    g as (select *, {has(qt.SEARCH_CHANGE_WORDS)} or len(ys) > 0 as chg from f),
    k as (select *, case when not ok then 0 when chg then 1 when {has(qt.VACANT_WORDS)} then 2 when {has(qt.VEGETATION_WORDS)} then 3 when {has(qt.WATER_WORDS)} then 4
      when {has(qt.BUILT_WORDS)} then 5 else 2 end as k from g)
    select query_id, ['unsupported_query','temporal_change','vacant_land_search','vegetation_analysis','water_detection','built_up_detection'][k + 1] as intent,
      case k when 0 then 'unsupported_legal_financial' when 1 then 'land_use_change' when 2 then 'potentially_vacant_land'
        when 3 then (case when {has(qt.POOR_WORDS)} then 'low_vegetation_health' else 'healthy_vegetation' end) when 4 then 'water_bodies' else 'built_up_infrastructure' end as target,
      [null, 'ndvi_ndbi_change', 'bare_land_detection', 'ndvi', 'ndwi', 'ndbi'][k + 1] as analysis,
      case when ok then upper(key[1]) || key[2:] end as location, case when ok then coalesce(km, case when {has(['around', 'near'])} then 6e0 else 5e0 end) end as radius_km,
      {sfixed("case when ok then coalesce(ha, case when contains(q, 'large') then 2e0 end) end")} as min_ha,
      case when ok then (case when {has(qt.NEAREST_WORDS)} then 'distance_asc' when {has(qt.LARGEST_WORDS)} then 'area_desc' when {has(qt.PERSISTENT_WORDS)} then 'persistence_desc' else 'area_desc' end) end as ranking_criteria,
      case when k = 1 then coalesce(ys[1], 2024) end as from_year, case when k = 1 then coalesce(ys[2], 2026) end as to_year, ok as is_supported from k""",
)

# --- Q3 retrieval fields
QUERIES["q3_retrieval_fields"] = lambda spark, sf: qt.parse_retrieval_queries(v.queries(spark, sf), v.gaz(spark, sf)).select(
    "query_id", "location", "date_a", "date_b", "sensor", "task"
)
SQL["q3_retrieval_fields"] = sql(
    "queries gaz",
    f"""with {Q}, {PLACE}, f as (select q.query_id, text, q, key, list_transform(regexp_extract_all(text, '{qt.RETRIEVAL_YEAR}', 1), lambda y: cast(y as integer)) as ys,
      contains(q, 'january') as jan, regexp_matches(q, '{qt.RADAR_WORDS}') as radar from q left join place on q.query_id = place.query_id)
    select query_id, coalesce(key, nullif(trim(regexp_extract(text, '{qt.RETRIEVAL_LOCATION}', 1)), ''), array_to_string(regexp_extract_all(text, '\\b([A-Z][a-z]+)\\b', 1), ' ')) as location,
      (case when jan then coalesce(ys[1], 2024) when len(ys) >= 2 then least(ys[1], ys[2]) when len(ys) = 1 then ys[1] - 2 else 2024 end) || '-01-15' as date_a,
      (case when jan then coalesce(ys[2], 2026) when len(ys) >= 2 then greatest(ys[1], ys[2]) when len(ys) = 1 then ys[1] else 2026 end) || '-01-15' as date_b,
      case when radar then 'Sentinel-1 SAR C-Band' else 'Sentinel-2 MSI' end as sensor,
      case when {has(qt.RETRIEVAL_CHANGE_WORDS)} then 'Bi-Temporal Change Analysis' when radar then 'SAR Radar Analysis' else 'Single Optical Analysis' end as task from f""",
)


#: Place words put behind the requests of ``s4_gazetteer``.
NAMED = ["Erode", "ERODED soil", "Chennai.", "mumbai and erode", "bengaluru", "nowhere", "Coimbatore", "perundurai"]


# --- Q4 topics and sentences from statistics
def _described(spark, sf):
    stats = index_stats(v.px_multi(spark, sf))
    many = v.px_multi(spark, sf).agg(F.max("scene_id")).scalar()
    asked = v.queries(spark, sf).select(
        "query_id", "text", (F.col("query_id") % many + 1).alias("scene_id"), F.lit("Somewhere, District").alias("location"),
        ((F.col("query_id") % 9) + 0.5).alias("area_km2"),
    )
    wanted = F.when(F.col("topic") == "built", "ndbi").when(F.col("topic") == "water", "ndwi").otherwise("ndvi")
    rows = asked.withColumn("topic", qt.topic("text")).withColumn("index", wanted).drop("topic").join(stats, ["scene_id", "index"], "left")
    return qt.describe_stats(rows).select(
        "query_id", "topic", fixed("share_pct").alias("share_pct"), fixed("share_km2").alias("share_km2"),
        F.col("answer").startswith("In Somewhere, ").alias("names_place"),
    )


QUERIES["q4_describe_stats"] = _described
SQL["q4_describe_stats"] = sql(
    "queries px_multi",
    f"""with {Q}, i as (select scene_id, {NDVI} as ndvi, {NDWI} as ndwi, {NDBI} as ndbi from px_multi),
    s as (select scene_id, avg(case when ndbi > 0.1e0 then 100e0 else 0e0 end) as b, avg(case when ndvi > 0.5e0 then 100e0 else 0e0 end) as g,
      avg(case when ndwi > 0 then 100e0 else 0e0 end) as w from i group by 1),
    t as (select query_id, case when {has(qt.TOPIC_WORDS['built'])} then 'built' when {has(qt.TOPIC_WORDS['vegetation'])} then 'vegetation' when {has(qt.TOPIC_WORDS['water'])} then 'water' else 'general' end as topic from q),
    u as (select query_id, topic, case topic when 'built' then b when 'vegetation' then g when 'water' then w end as pct from t left join s on query_id % (select max(scene_id) from s) + 1 = scene_id)
    select query_id, topic, {sfixed('pct')} as share_pct, {sfixed('pct / 100e0 * (query_id % 9 + 0.5e0)')} as share_km2, true as names_place from u""",
)

# --- Q7 grounding flags, target phrase, feature word
QUERIES["q7_grounding_flags"] = lambda spark, sf: v.queries(spark, sf).select(
    "query_id", *[c.alias(n) for n, c in tx.grounding_flags("text").items()], tx.target_phrase("text").alias("phrase"), opt.feature_of("text").alias("feature")
)
SQL["q7_grounding_flags"] = sql(
    "queries",
    f"""with {Q} select query_id, """
    + ", ".join(f"{has(w)} as is_{n}" for n, w in tx.GROUNDING_WORDS.items())
    + f""", trim(regexp_replace(trim(text), '{tx.TARGET_LEAD}', '')) as phrase, case """
    + " ".join(f"when {has(w)} then '{n}'" for n, w in opt.FEATURE_WORDS.items())
    + " end as feature from q",
)

# --- J5 geocoding
QUERIES["j5_geocode"] = lambda spark, sf: gazetteer.geocode(v.queries(spark, sf), v.gaz(spark, sf)).select(
    "query_id", "place_name", "resolved_by", "lat", "lon", fixed("min_lon", 4).alias("min_lon"), fixed("max_lat", 4).alias("max_lat")
)
PAIR = r"(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)"
SQL["j5_geocode"] = sql(
    "queries gaz",
    f"""with {Q}, {PLACE}, f as (select q.query_id, g.name, coalesce(g.lat, try_cast(regexp_extract(text, '{PAIR}', 1) as double)) as lat,
      coalesce(g.lon, try_cast(regexp_extract(text, '{PAIR}', 2) as double)) as lon from q left join place on q.query_id = place.query_id left join gaz g on place.key = g.key)
    select query_id, name as place_name, case when name is not null then 'gazetteer' when lat is not null then 'coordinates' end as resolved_by, lat, lon,
      {sfixed('lon - 0.04e0', 4)} as min_lon, {sfixed('lat + 0.04e0', 4)} as max_lat from f""",
)
QUERIES["j5_geocode_substring"] = lambda spark, sf: gazetteer.match_places(v.queries(spark, sf), v.gaz(spark, sf), mode="contains").select(
    "query_id", F.col("place.key").alias("key"), F.col("place.ord").alias("ord")
)
SQL["j5_geocode_substring"] = sql(
    "queries gaz",
    f"""with {Q}, m as (select query_id, key, ord, row_number() over (partition by query_id order by ord) as rn from q join gaz on contains(q, key))
    select q.query_id, key, ord from q left join m on q.query_id = m.query_id and rn = 1""",
)


def _document_places(spark, sf):
    """Whole documents against the first two words of every benchmark item."""
    first = F.lower(F.regexp_extract("text", r"([A-Za-z]+ [A-Za-z]+)", 1))
    gaz = v.table(spark, sf, "benchmark").select(first.alias("key"), F.col("item_id").alias("ord"), first.alias("name"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    docs = v.table(spark, sf, "documents").select("doc_id", "text")
    return gazetteer.match_places(docs, gaz).select("doc_id", F.col("place.key").alias("key"), F.col("place.ord").alias("ord"))


QUERIES["j5_geocode_documents"] = _document_places
SQL["j5_geocode_documents"] = r"""
    with g as (select lower(regexp_extract(text, '([A-Za-z]+ [A-Za-z]+)', 1)) as key, item_id as ord from benchmark where regexp_matches(text, '[A-Za-z]+ [A-Za-z]+')),
    low as materialized (select doc_id, lower(text) as t from documents),
    pair as materialized (select doc_id, key, ord, string_split(t, key) as parts from low join g on contains(t, key)),
    near as (select doc_id, key, ord, unnest(parts[:-2]) as before, unnest(parts[2:]) as after from pair),
    m as (select doc_id, key, ord, row_number() over (partition by doc_id order by ord, key) as rn from
      (select distinct doc_id, key, ord from near where not regexp_matches(right(before, 1), '[\pL\pN_]') and not regexp_matches(left(after, 1), '[\pL\pN_]')))
    select d.doc_id, key, ord from documents d left join m on d.doc_id = m.doc_id and rn = 1"""
QUERIES["s4_gazetteer"] = lambda spark, sf: gazetteer.geocode(
    v.queries(spark, sf).withColumn("text", F.concat("text", F.lit(" by "), F.element_at(F.array(*[F.lit(x) for x in NAMED]), (F.col("query_id") % 8 + 1).cast("int")))),
    places(spark),
).select("query_id", "place_name", "resolved_by", "lat", "lon", "min_lon", "max_lat")
SQL["s4_gazetteer"] = sql(
    "queries",
    """with g(k, key, name, lat, lon, x0, y1) as (values (0, 'perundurai', 'Perundurai, Erode District, Tamil Nadu, India', 11.2750e0, 77.5833e0, 77.5300e0, 11.3200e0),
      (1, 'erode', 'Erode, Tamil Nadu, India', 11.3410e0, 77.7172e0, 77.6600e0, 11.3900e0), (2, 'coimbatore', 'Coimbatore, Tamil Nadu, India', 11.0168e0, 76.9558e0, 76.8800e0, 11.0800e0),
      (3, 'chennai', 'Chennai, Tamil Nadu, India', 13.0827e0, 80.2707e0, 80.1800e0, 13.2500e0), (4, 'mumbai', 'Mumbai, Maharashtra, India', 19.0760e0, 72.8777e0, 72.7500e0, 19.2500e0),
      (5, 'bengaluru', 'Bengaluru, Karnataka, India', 12.9716e0, 77.5946e0, 77.5000e0, 13.1000e0)),
    t as (select query_id, lower(text || ' by ' || ['Erode', 'ERODED soil', 'Chennai.', 'mumbai and erode', 'bengaluru', 'nowhere', 'Coimbatore', 'perundurai'][query_id % 8 + 1]) as q from queries),
    h as (select query_id, min(k) as k from t join g on regexp_matches(q, '(^|[^a-z0-9_])' || key || '([^a-z0-9_]|$)') group by 1),
    c as (select query_id, try_cast(regexp_extract(q, '(-?\\d+(?:\\.\\d+)?)\\s*,\\s*(-?\\d+(?:\\.\\d+)?)', 1) as double) as la, try_cast(regexp_extract(q, '(-?\\d+(?:\\.\\d+)?)\\s*,\\s*(-?\\d+(?:\\.\\d+)?)', 2) as double) as lo from t)
    select t.query_id, g.name as place_name, case when g.key is not null then 'gazetteer' when la is not null then 'coordinates' end as resolved_by,
      coalesce(g.lat, la) as lat, coalesce(g.lon, lo) as lon, coalesce(x0, round(lo - 0.04e0, 4)) as min_lon, coalesce(y1, round(la + 0.04e0, 4)) as max_lat
    from t left join h on t.query_id = h.query_id left join g on h.k = g.k left join c on t.query_id = c.query_id""",
)
QUERIES["f20_hashed_place"] = lambda spark, sf: v.queries(spark, sf).select("query_id", gazetteer.hashed_place("text").alias("p")).select("query_id", "p.lat", "p.lon")
SQL["f20_hashed_place"] = sql(
    "queries",
    """with h as (select query_id, cast('0x' || substring(md5(text), 1, 8) as bigint) as h from queries)
    select query_id, (h % 1500) / 100e0 + 10e0 as lat, ((h >> 4) % 1200) / 100e0 + 75e0 as lon from h""",
)

# --- F16 normalisation, Q5 extraction, P19 / P20 filters, J11 merge
NUM = r"\[(\d+), (\d+), (\d+), (\d+)\]"
PARTS = f"""n as (select text_id, image_id, text, {', '.join(f"cast(regexp_extract(text, '{NUM}', {k}) as double) as c{k}" for k in (1, 2, 3, 4))} from boxes)"""
NORM = """m as (select *, greatest(c1, c2, c3, c4) as top from n),
z as (select text_id, image_id, text, top, c1 * f as a, c2 * f as b, c3 * f as c, c4 * f as d from (select *, case when top <= 100 then 1e0 when top <= 1005 then null else null end as f from m) where top <= 100
 union all select text_id, image_id, text, top, c1 / 1000e0 * 100e0, c2 / 1000e0 * 100e0, c3 / 1000e0 * 100e0, c4 / 1000e0 * 100e0 from m where top > 100 and top <= 1005
 union all select text_id, image_id, text, top, c1 / 1024e0 * 100e0, c2 / 1024e0 * 100e0, c3 / 1024e0 * 100e0, c4 / 1024e0 * 100e0 from m where top > 1005),
bx as (select text_id, image_id, text, greatest(least(least(a, c), 100e0), 0e0) as ymin, greatest(least(least(b, d), 100e0), 0e0) as xmin,
 greatest(least(greatest(a, c), 100e0), 0e0) as ymax, greatest(least(greatest(b, d), 100e0), 0e0) as xmax from z)"""


def text_boxes(spark, sf):
    return box_text.extract_boxes(v.boxes(spark, sf), digits=None)


QUERIES["q5_extract_boxes"] = lambda spark, sf: text_boxes(spark, sf).select(
    "text_id", "position", "label", "confidence", "color", *[fixed(c).alias(c) for c in ("ymin", "xmin", "ymax", "xmax")]
)
KEPT = "kept as (select * from bx where not (ymax - ymin < 0.5e0 and xmax - xmin < 0.5e0))"
SQL["q5_extract_boxes"] = sql(
    "boxes",
    f"""with {PARTS}, {NORM}, {KEPT} select text_id, cast(0 as integer) as position, 'Target at' as label, 0.92e0 as confidence, '#10b981' as color,
    {sfixed('ymin')} as ymin, {sfixed('xmin')} as xmin, {sfixed('ymax')} as ymax, {sfixed('xmax')} as xmax from kept""",
)


def _tokens(spark, sf):
    k = F.col("o_orderkey")
    token = F.format_string("{<%d><%d><%d><%d>|<%d>}", k % 600, k % 700, k % 600 + 40, k % 700 + 3, k % 90 + 10)
    text = F.concat(F.lit("<p>some tall trees</p> "), token, F.lit("<delim>"), F.format_string("{<5><6><%d><9>} and [1, 2, 3, 4]", k % 800))
    df = v.table(spark, sf, "orders").select(k.alias("text_id"), text.alias("text"))
    return box_text.extract_boxes(df, digits=None).select(
        "text_id", "position", "label", fixed("confidence", 2).alias("confidence"), *[fixed(c).alias(c) for c in ("ymin", "xmin", "ymax", "xmax")]
    )


def _scaled(values: str) -> str:
    return f"(case when greatest({values}) <= 100 then 1e0 else 0.1e0 end)"


QUERIES["q5_extract_token_boxes"] = _tokens
SQL["q5_extract_token_boxes"] = f"""
with t as (select o_orderkey as k from orders),
r as (select k, 0 as i, k % 600 as a, k % 700 as b, k % 600 + 40 as c, k % 700 + 3 as d, (k % 90 + 10) / 100e0 as s from t
  union all select k, 1, 5, 6, k % 800, 9, 0.92e0 from t),
m as (select *, greatest(a, b, c, d) as top from r),
p as (select k, i, s, case when top <= 1 then 100e0 when top <= 100 then 1e0 else 0.1e0 end as f, least(a, c) as y0, greatest(a, c) as y1, least(b, d) as x0, greatest(b, d) as x1 from m),
z as (select k, i, s, y0 * f as ymin, x0 * f as xmin, y1 * f as ymax, x1 * f as xmax from p),
kept as (select * from z where not (ymax - ymin < 0.5e0 and xmax - xmin < 0.5e0))
select k as text_id, cast(row_number() over (partition by k order by i) - 1 as integer) as position, 'Tall Trees' as label, {sfixed('s', 2)} as confidence,
 {sfixed('ymin')} as ymin, {sfixed('xmin')} as xmin, {sfixed('ymax')} as ymax, {sfixed('xmax')} as xmax from kept"""


def _normalized(spark, sf):
    k = F.col("o_orderkey")
    raw = v.table(spark, sf, "orders").select(
        k, *[(F.col("o_totalprice") * w % m).alias(f"c{i}") for i, (w, m) in enumerate([(1.0, 97.0), (3.0, 530.0), (7.0, 1200.0), (11.0, 88.0)], 1)]
    )
    unit = bx.normalize_box(*[F.col(f"c{i}") / 1200.0 for i in (1, 2, 3, 4)], digits=None)
    sized = bx.normalize_box("c1", "c2", "c3", "c4", width=F.lit(640), height=F.lit(480), digits=None)
    plain = bx.normalize_box("c1", "c2", "c3", "c4", digits=None)
    return raw.select("o_orderkey", unit.alias("u"), sized.alias("s"), plain.alias("p")).select(
        "o_orderkey", *[fixed(f"{s}.{n}").alias(f"{s}_{n}") for s in "usp" for n in ("ymin", "xmin", "ymax", "xmax")]
    )


def _side(name: str, a: str, b: str, fa: str) -> str:
    return f"greatest(least({fa}({a} / k, {b} / k), 100e0), 0e0)"


def _box_sql(prefix: str, ky: str, kx: str) -> str:
    out = []
    for n, fn, a, b, k in (("ymin", "least", "c1", "c3", ky), ("xmin", "least", "c2", "c4", kx), ("ymax", "greatest", "c1", "c3", ky), ("xmax", "greatest", "c2", "c4", kx)):
        out.append(f"{sfixed(f'greatest(least({fn}({a} / ({k}) * 100e0, {b} / ({k}) * 100e0), 100e0), 0e0)')} as {prefix}_{n}")
    return ", ".join(out)


QUERIES["f16_normalize_box"] = _normalized
SQL["f16_normalize_box"] = f"""
with r as (select o_orderkey, o_totalprice * 1e0 % 97e0 as c1, o_totalprice * 3e0 % 530e0 as c2, o_totalprice * 7e0 % 1200e0 as c3, o_totalprice * 11e0 % 88e0 as c4 from orders),
m as (select *, greatest(c1, c2, c3, c4) as top from r)
select o_orderkey, {_box_sql('u', '1200e0', '1200e0')}, {_box_sql('s', 'case when top > 1.05e0 then 480e0 else 1e0 end', 'case when top > 1.05e0 then 640e0 else 1e0 end')},
{_box_sql('p', 'case when top <= 1.05e0 then 1e0 when top <= 100 then 100e0 when top <= 1005 then 1000e0 else 1024e0 end', 'case when top <= 1.05e0 then 1e0 when top <= 100 then 100e0 when top <= 1005 then 1000e0 else 1024e0 end')} from m"""

QUERIES["p20_degenerate_filter"] = lambda spark, sf: text_boxes(spark, sf).filter(bx.is_large_enough()).select("text_id", fixed("ymin").alias("ymin"))
SQL["p20_degenerate_filter"] = sql("boxes", f"with {PARTS}, {NORM} select text_id, {sfixed('ymin')} as ymin from bx where ymax - ymin > 1.5e0 and xmax - xmin > 1.5e0")

QUERIES["p19_unreliable_filter"] = lambda spark, sf: box_text.reliable_boxes(
    text_boxes(spark, sf).withColumns({"ymin": F.col("ymin") + 30, "ymax": F.col("ymax") + 12, "xmin": F.col("xmin") + 30, "xmax": F.col("xmax") + 12})
).select("text_id", fixed("ymin").alias("ymin"), fixed("xmax").alias("xmax"))
SQL["p19_unreliable_filter"] = sql(
    "boxes",
    f"""with {PARTS}, {NORM}, {KEPT}, s as (select text_id, ymin + 30 as ymin, ymax + 12 as ymax, xmin + 30 as xmin, xmax + 12 as xmax from kept)
    select text_id, {sfixed('ymin')} as ymin, {sfixed('xmax')} as xmax from s
    where not (ymin between 54 and 66 and xmin between 54 and 66 and abs(ymax - ymin) <= 12 and abs(xmax - xmin) <= 12)""",
)


def _merged(spark, sf):
    found = text_boxes(spark, sf).withColumn("ord", F.col("text_id"))
    first = found.groupBy("image_id").agg(F.min("ord").alias("first"))
    split = found.join(first, "image_id")
    anchored = F.col("image_id") % 3 != 0
    anchors = split.filter((F.col("ord") == F.col("first")) & anchored)
    rest = split.filter((F.col("ord") != F.col("first")) | ~anchored)
    return box_text.merge_boxes(anchors, rest).select("image_id", "ord", fixed("ymin").alias("ymin"), fixed("xmin").alias("xmin"))


QUERIES["j11_merge_boxes"] = _merged
SQL["j11_merge_boxes"] = sql(
    "boxes",
    f"""with recursive {PARTS}, {NORM}, {KEPT}, o as (select image_id, text_id, ymin, xmin, row_number() over (partition by image_id order by text_id) as rn from kept),
    walk(image_id, rn, ys, xs, ids) as (select image_id, rn, [ymin], [xmin], [text_id] from o where rn = 1 and image_id % 3 <> 0
      union all select image_id, nrn, case when f then list_append(ys, y) else ys end, case when f then list_append(xs, x) else xs end, case when f then list_append(ids, t) else ids end
      from (select w.image_id, w.ys, w.xs, w.ids, o.rn as nrn, o.ymin as y, o.xmin as x, o.text_id as t,
          not list_bool_or(list_transform(list_zip(ys, xs), lambda p: abs(p[1] - o.ymin) < 8 and abs(p[2] - o.xmin) < 8)) as f
        from walk w join o on w.image_id = o.image_id and o.rn = w.rn + 1)),
    fin as (select image_id, arg_max(ids, rn) as ids from walk group by 1)
    select image_id, text_id as ord, {sfixed('ymin')} as ymin, {sfixed('xmin')} as xmin from kept join (select image_id as i, unnest(ids) as t from fin) on image_id = i and text_id = t
    union all select image_id, text_id, {sfixed('ymin')}, {sfixed('xmin')} from kept where image_id % 3 = 0""",
)


# --- Q6 cleaning, F21 texts
def _raw_outputs(spark, sf):
    k = F.col("o_orderkey")
    return v.table(spark, sf, "orders").select(
        k.alias("text_id"),
        F.concat(
            F.lit(" There are <p>"), F.col("o_orderpriority"), F.lit("</p> {<1><2><3><"), k % 99, F.lit(">|<90>}<delim>  near <box>"), k,
            F.lit("</box> , "), F.col("o_orderstatus"), F.lit(" ! "),
        ).alias("text"),
    )


QUERIES["q6_clean_output"] = lambda spark, sf: _raw_outputs(spark, sf).select("text_id", tx.clean_output("text").alias("clean"))
SQL["q6_clean_output"] = """
select o_orderkey as text_id, 'There are ' || o_orderpriority || ' near, ' || o_orderstatus || '!' as clean from orders"""

QUERIES["f21_texts"] = lambda spark, sf: v.hist(spark, sf).select(
    "analysis_id", "step", tx.size_text(F.col("duration_ms") * 4096).alias("size"), tx.percent_text(F.col("duration_ms") / 8).alias("pct"),
    tx.signed_text(F.col("duration_ms") - 600, 0).alias("delta"), tx.confidence_text((F.col("duration_ms") % 64) / 64.0).alias("conf"),
)
SQL["f21_texts"] = sql(
    "hist",
    """select analysis_id, step, case when duration_ms * 4096 < 1048576 then printf('%.1f KB', duration_ms * 4e0) else printf('%.2f MB', duration_ms / 256e0) end as size,
    printf('%.1f%%', duration_ms / 8e0) as pct, printf('%+d', duration_ms - 600) as delta, printf('%d%%', cast(floor(duration_ms % 64 / 64e0 * 100e0) as integer)) as conf from hist""",
)
