"""Registered queries over analysis history, reports, tools, metrics and the search plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.pixels import NDBI, NDVI, NDWI
from checks.regions import label_sql
from checks.texts import PLACE, Q, has
from checks.views import fixed, sfixed, sql
from scenelake.functions import text as tx
from scenelake.operators import history as hs
from scenelake.operators import metrics as mt
from scenelake.operators import query_text as qt
from scenelake.operators.candidates import hand_out, refine_reply, refine_shared, shared_searches
from scenelake.operators.stats import class_breakdown
from scenelake.plans.land_search import land_search
from scenelake.plans.retrieval import retrieve_change, retrieve_pairs
from scenelake.registry import default_toolbox, tools_for

QUERIES: dict = {}
SQL: dict[str, str] = {}

# --- A12 / A13 / U3 folding
QUERIES["a12_fold_confidence"] = lambda spark, sf: hs.fold_tool_results(v.hist(spark, sf)).select(
    "analysis_id", "tools", fixed("confidence").alias("confidence"), "inference_time_ms", "model_status"
)
SQL["a12_fold_confidence"] = sql(
    "hist",
    f"""select analysis_id, count(*) as tools, {sfixed("case when count(*) = 1 then (case when max(confidence) > 0 then max(confidence) when max(status) = 'COMPLETED' then 0.88e0 else 0e0 end) else coalesce(avg(confidence) filter (where status = 'COMPLETED' and confidence > 0), 0.88e0) end")} as confidence,
    cast(sum(duration_ms) as bigint) as inference_time_ms, 'READY' as model_status from hist group by 1""",
)
QUERIES["a13_trace_rollup"] = lambda spark, sf: hs.trace_rollup(v.hist(spark, sf)).select(
    "analysis_id", "duration_ms", "steps", F.array_join("models_used", ">").alias("models"), F.md5(F.col("answer").cast("binary")).alias("answer_md5")
)
SQL["a13_trace_rollup"] = sql(
    "hist",
    """with m as (select analysis_id, tool, min(step) as seen_at from hist group by 1, 2), a as (select analysis_id, text, min(step) as seen_at from hist where text <> '' group by 1, 2),
    ms as (select analysis_id, string_agg(tool, '>' order by seen_at, tool) as models from m group by 1), ans as (select analysis_id, md5(string_agg(text, ' ' order by seen_at, text)) as answer_md5 from a group by 1)
    select h.analysis_id, cast(sum(duration_ms) as bigint) as duration_ms, count(*) as steps, any_value(models) as models, any_value(answer_md5) as answer_md5
    from hist h left join ms on h.analysis_id = ms.analysis_id left join ans on h.analysis_id = ans.analysis_id group by 1""",
)
QUERIES["u3_first_seen"] = lambda spark, sf: hs.first_seen(v.hist(spark, sf), "status").select("analysis_id", F.array_join("status_list", ",").alias("seen"))
SQL["u3_first_seen"] = sql(
    "hist",
    "with m as (select analysis_id, status, min(step) as seen_at from hist group by 1, 2) select analysis_id, string_agg(status, ',' order by seen_at) as seen from m group by 1",
)
QUERIES["w9_number_steps"] = lambda spark, sf: hs.number_steps(
    v.hist(spark, sf).withColumn("at", F.col("duration_ms") * 1000 + F.col("step")).withColumnRenamed("step", "turn"), "at"
).select("analysis_id", "turn", "step")
SQL["w9_number_steps"] = sql("hist", "select analysis_id, step as turn, row_number() over (partition by analysis_id order by duration_ms * 1000 + step) as step from hist")


# --- S8, P18, W8 lists
def summaries(spark, sf):
    h = v.hist(spark, sf)
    return h.groupBy("analysis_id").agg(
        F.min_by("text", "step").alias("query"), F.max_by("tool", "step").alias("task"), F.max("step").alias("created_at"), F.max_by("text", "step").alias("location")
    )


SUMMARY = """s as (select analysis_id, first(text order by step) as query, first(tool order by step desc) as task, max(step) as created_at, first(text order by step desc) as location from hist group by 1)"""
QUERIES["s8_history_list"] = lambda spark, sf: hs.newest_first(summaries(spark, sf)).select("analysis_id", "task", "created_at", F.md5(F.col("query").cast("binary")).alias("query_md5"))
SQL["s8_history_list"] = sql("hist", f"with {SUMMARY} select analysis_id, task, created_at, md5(query) as query_md5 from s")
QUERIES["s8_get_analysis"] = lambda spark, sf: hs.get_analysis(v.hist(spark, sf), 3).select("analysis_id", "step", "tool", "duration_ms")
SQL["s8_get_analysis"] = sql("hist", "select analysis_id, step, tool, duration_ms from hist where analysis_id = 3")
QUERIES["s8_delete_analysis"] = lambda spark, sf: hs.without_analysis(v.hist(spark, sf), 3).select("analysis_id", "step")
SQL["s8_delete_analysis"] = sql("hist", "select analysis_id, step from hist where analysis_id <> 3")
QUERIES["p18_filter_history"] = lambda spark, sf: hs.filter_history(summaries(spark, sf), "assistant", "EN").select("analysis_id", "task")
SQL["p18_filter_history"] = sql("hist", f"with {SUMMARY} select analysis_id, task from s where task = 'assistant' and (contains(lower(query), 'en') or contains(lower(location), 'en'))")
QUERIES["w8_newest"] = lambda spark, sf: hs.newest(v.hist(spark, sf), "analysis_id", "duration_ms", ["tool"])
SQL["w8_newest"] = sql("hist", "select tool, first(analysis_id order by duration_ms desc, analysis_id desc) as analysis_id from hist group by 1")


# --- S9 reports, F23, F24
def _report_inputs(spark, sf):
    h = v.hist(spark, sf)
    analyses = (
        hs.fold_tool_results(h)
        .join(hs.trace_rollup(h).select("analysis_id", "models_used", "answer"), "analysis_id")
        .select("analysis_id", F.lit("How green is it?").alias("query"), F.lit("VQA").alias("task"), F.lit("DONE").alias("status"),
                F.lit(0.5).alias("confidence"), "answer", "models_used", F.col("inference_time_ms").alias("execution_time_ms"), F.lit("2026-01-01").alias("created_at"))
    )
    evidence = h.filter("status = 'FAILED'").select(
        "analysis_id", F.format_string("ev%02d", "step").alias("evidence_id"), F.col("tool").alias("category"), F.col("status").alias("title"),
        F.lit(0.25).alias("confidence"), F.col("duration_ms").cast("string").alias("description"),
    )
    steps = h.select("analysis_id", "step", F.col("status").alias("name"), "tool", "duration_ms", F.lit("").alias("output_summary"))
    return analyses, evidence, steps


def _reports(spark, sf):
    out = hs.render_reports(*_report_inputs(spark, sf))
    return out.select("analysis_id", F.length("content").alias("n"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


REPORT_PARTS = """a as (select analysis_id, text, min(step) as seen_at from hist where text <> '' group by 1, 2), m as (select analysis_id, tool, min(step) as seen_at from hist group by 1, 2),
ans as (select analysis_id, string_agg(text, ' ' order by seen_at, text) as answer from a group by 1), ms as (select analysis_id, string_agg(tool, ', ' order by seen_at, tool) as models from m group by 1),
ev as (select analysis_id, string_agg('| `' || printf('ev%02d', step) || '` | ' || tool || ' | **' || status || '** | 25% | ' || duration_ms || ' |', chr(10) order by step) as ev from hist where status = 'FAILED' group by 1),
tr as (select analysis_id, string_agg('| ' || step || ' | ' || status || ' | `' || tool || '` | ' || duration_ms || 'ms | - |', chr(10) order by step) as tr, cast(sum(duration_ms) as bigint) as ms from hist group by 1)"""
QUERIES["s9_reports"] = _reports
SQL["s9_reports"] = sql(
    "hist",
    f"""with {REPORT_PARTS}, r as (select tr.analysis_id, concat_ws(chr(10), '# Mission Report - VQA', '**Generated**: 2026-01-01 | **Analysis ID**: `' || tr.analysis_id || '`', chr(10) || '---' || chr(10) || chr(10) || '## 1. Executive Summary',
      '- **Query**: *"How green is it?"*', '- **Identified Task**: `VQA`', '- **Calibrated Confidence**: **50%**', '- **Execution Latency**: `' || ms || ' ms`', '- **Models Employed**: ' || models,
      chr(10) || '## 2. Findings', '> ' || answer, chr(10) || '## 3. Evidence' || chr(10) || '| ID | Category | Feature Title | Confidence | Description |' || chr(10) || '| :--- | :--- | :--- | :--- | :--- |' || chr(10) || ev,
      chr(10) || '## 4. Execution Trace' || chr(10) || '| Step | Action | Tool | Duration | Output Summary |' || chr(10) || '| :--- | :--- | :--- | :--- | :--- |' || chr(10) || tr, chr(10) || '---') as content
      from tr join ans on tr.analysis_id = ans.analysis_id join ms on tr.analysis_id = ms.analysis_id left join ev on tr.analysis_id = ev.analysis_id)
    select analysis_id, cast(length(content) as integer) as n, md5(content) as content_md5 from r""",
)


def _json_reports(spark, sf):
    out = hs.render_reports(*_report_inputs(spark, sf), fmt="json", include_evidence=False)
    parsed = F.from_json("content", "answer STRING, evidence ARRAY<STRING>, execution_trace ARRAY<STRUCT<step: BIGINT, duration_ms: BIGINT>>, execution_time_ms BIGINT")
    return out.withColumn("p", parsed).select(
        "analysis_id", F.md5(F.col("p.answer").cast("binary")).alias("answer_md5"), F.size("p.evidence").alias("n_evidence"), F.size("p.execution_trace").alias("n_steps"),
        F.aggregate("p.execution_trace", F.lit(0).cast("bigint"), lambda s, t: s + t["duration_ms"]).alias("ms"), F.col("p.execution_time_ms").alias("total"),
    )


QUERIES["f24_json_reports"] = _json_reports
SQL["f24_json_reports"] = sql(
    "hist",
    f"""with {REPORT_PARTS} select tr.analysis_id, md5(answer) as answer_md5, cast(0 as integer) as n_evidence, cast((select count(*) from hist h where h.analysis_id = tr.analysis_id) as integer) as n_steps, ms, ms as total
    from tr join ans on tr.analysis_id = ans.analysis_id""",
)
QUERIES["f23_maps"] = lambda spark, sf: class_breakdown(v.hist(spark, sf), "tool", ["analysis_id"]).select(
    "analysis_id", "pixels", F.size("class_breakdown").alias("n"), fixed(F.try_element_at("class_breakdown", F.lit("user"))).alias("user_pct"),
    F.array_join(F.array_sort(F.map_keys("class_breakdown")), ",").alias("keys"),
)
SQL["f23_maps"] = sql(
    "hist",
    f"""select analysis_id, count(*) as pixels, cast(count(distinct tool) as integer) as n,
    {sfixed("nullif(count(*) filter (where tool = 'user'), 0) * 100e0 / count(*)")} as user_pct,
    array_to_string(list_sort(list(distinct tool)), ',') as keys from hist where tool is not null group by 1""",
)


# --- tools (X1, X2, J10)
def _tools(spark, sf):
    routed = qt.route_tasks(v.queries(spark, sf))
    i = F.col("query_id")
    inputs = (
        F.when(i % 3 == 0, F.array(F.lit("image"), F.lit("image_a")))
        .when(i % 3 == 1, F.array(F.lit("image_a"), F.lit("image_b")))
        .otherwise(F.array(F.lit("image"), F.lit("optical"), F.lit("sar")))
    )
    return tools_for(routed.select("query_id", "task", inputs.alias("inputs")), default_toolbox().table(spark)).select("query_id", "tool")


QUERIES["j10_tools_for_requests"] = _tools
SQL["j10_tools_for_requests"] = sql(
    "queries",
    f"""with {Q}, p as (select query_id, query_id % 3 as g, case when {has(qt.CROSS_MODAL_WORDS)} then 'OPTICAL_SAR' when {has(qt.CHANGE_WORDS)} or ({has(qt.COMPOUND_WORDS)} and {has(qt.TWO_DATE_WORDS)}) then 'TEMPORAL_CHANGE'
      when {has(qt.GROUNDING_WORDS)} then 'GROUNDING' when {has(qt.CAPTION_WORDS)} then 'SINGLE_CAPTION' else 'SINGLE_VQA' end as task from q)
    select query_id, 'OpticalSAR' as tool from p where task = 'OPTICAL_SAR' and g = 2 union all select query_id, 'ChangeDetection' from p where task = 'TEMPORAL_CHANGE' and g = 1
    union all select query_id, 'SpectralAnalysis' from p where task = 'TEMPORAL_CHANGE' and g <> 1
    union all select query_id, 'Grounding' from p where task = 'GROUNDING' and g <> 1 union all select query_id, 'Captioning' from p where task = 'SINGLE_CAPTION' and g <> 1
    union all select query_id, 'StatisticsAnswer' from p where task = 'SINGLE_VQA' and g <> 1""",
)

# --- E1..E3
QUERIES["e1_classification"] = lambda spark, sf: mt.classification_metrics(
    v.table(spark, sf, "labels").select(F.col("quality").alias("label"), (1 - F.col("toxic")).alias("pred"))
)
SQL["e1_classification"] = """
with c as (select count(*) as n, count(*) filter (where quality = 1 and toxic = 0) as tp, count(*) filter (where quality <> 1 and toxic = 0) as fp,
  count(*) filter (where quality = 1 and toxic <> 0) as fn, count(*) filter (where quality <> 1 and toxic <> 0) as tn from labels)
select *, (tp + tn) / cast(n as double) as accuracy, tp / cast(tp + fp as double) as precision, tp / cast(tp + fn as double) as recall, tp * 2 / cast(tp * 2 + fp + fn as double) as f1 from c"""


def _boxes(spark, sf):
    i = F.col("c_custkey")
    base = v.table(spark, sf, "customer").select(i.alias("item_id"), F.col("c_nationkey").alias("grp"), (i % 50).cast("double").alias("ymin"), (i % 40).cast("double").alias("xmin"))
    truth = base.withColumn("ymax", F.col("ymin") + 20.0).withColumn("xmax", F.col("xmin") + 30.0)
    shift = F.col("item_id") % 13
    pred = truth.filter("item_id % 17 <> 0").withColumns({"ymin": F.col("ymin") + shift, "xmin": F.col("xmin") - shift, "ymax": F.col("ymax") + shift, "xmax": F.col("xmax") - shift}).drop("grp")
    return mt.box_metrics(truth, pred, keys=["grp"])


QUERIES["e2_box_metrics"] = lambda spark, sf: _boxes(spark, sf).select("grp", "n", fixed("miou").alias("miou"), fixed("recall").alias("recall"))
SQL["e2_box_metrics"] = f"""
with s as (select c_nationkey as grp, case when c_custkey % 17 = 0 then 0e0 else (20 - c_custkey % 13) * (30 - c_custkey % 13) / (1200e0 - (20 - c_custkey % 13) * (30 - c_custkey % 13)) end as iou from customer)
select grp, count(*) as n, {sfixed('avg(iou)')} as miou, {sfixed('avg(case when iou >= 0.5e0 then 1e0 else 0e0 end)')} as recall from s group by 1"""
QUERIES["e3_calibration"] = lambda spark, sf: mt.calibration_error(
    v.hist(spark, sf).select("confidence", (F.col("status") == "COMPLETED").cast("int").alias("correct"))
).select("n", fixed("ece").alias("ece"))
SQL["e3_calibration"] = sql(
    "hist",
    f"""with b as (select least(floor(confidence * 10e0), 9) as bin, count(*) as n, avg(case when status = 'COMPLETED' then 1e0 else 0e0 end) as acc, avg(confidence) as conf from hist group by 1)
    select cast(sum(n) as bigint) as n, {sfixed('sum(n * abs(acc - conf)) / sum(n)')} as ece from b""",
)


# --- R12 land search, R13 retrieval
def scene_headers(spark, sf):
    """Scenes of px_time near the gazetteer places: 0.02 degree pixels."""
    i = F.col("s_suppkey")
    return v.table(spark, sf, "supplier").select(
        i.alias("scene_id"), F.lit(0.02).alias("a"), (F.lit(74.95) + (i % 25) * 0.4).alias("c"), F.lit(-0.02).alias("e"),
        (F.lit(10.05) + (i % 25) * 0.5).alias("f"), F.lit(5).alias("width"), F.lit(4).alias("height"), F.lit(4326).alias("epsg"),
    )


def _land(spark, sf):
    h = scene_headers(spark, sf)
    grown = h.withColumn("height", F.lit(40))
    return land_search(v.px_time(spark, sf), grown, v.queries(spark, sf), v.gaz(spark, sf), "yr", min_ratio=0.8)


def _land_change(spark, sf):
    """The same pixels 28 years later, so that the years of the requests are there."""
    grown = scene_headers(spark, sf).withColumn("height", F.lit(40))
    later = v.px_time(spark, sf).withColumn("yr", F.col("yr") + 28)
    found = land_search(later, grown, v.queries(spark, sf), v.gaz(spark, sf), "yr", min_ratio=0.8, targets=["water_bodies"])
    return found.candidates.filter(F.col("target").startswith("land_use_change")).select(
        "query_id", "target", "scene_id", "label", "rank", "pixels", fixed("area_hectares", 3).alias("ha"), fixed("distance_km", 3).alias("km"), "temporal_persistence"
    )


QUERIES["r12_land_change"] = _land_change
QUERIES["r12_land_search"] = lambda spark, sf: _land(spark, sf).candidates.select(
    "query_id", "scene_id", "label", "rank", "pixels", fixed("area_hectares", 3).alias("ha"), fixed("distance_km", 3).alias("km"), fixed("persistence_ratio").alias("ratio")
)
TARGET_SQL = {
    "potentially_vacant_land": "ndvi < 0.25e0 and ndwi < 0 and ndbi < 0.15e0",
    "low_vegetation_health": "ndvi < 0.2e0",
    "healthy_vegetation": "ndvi > 0.5e0",
    "water_bodies": "ndwi > 0",
    "built_up_infrastructure": "ndbi > 0.1e0",
}
LAND_CTES = (
    f"""with recursive i as (select scene_id, row, col, yr, {NDVI} as ndvi, {NDWI} as ndwi, {NDBI} as ndbi from px_time),
    o as ("""
    + " union all ".join(f"select '{t}' as target, scene_id, row, col, yr, {c} as hit from i" for t, c in TARGET_SQL.items())
    + f"""), per as (select target || '|' || scene_id as scene_id, row, col, count(distinct yr) as n, count(distinct yr) filter (where hit) as k from o group by target, o.scene_id, row, col),
    seed as (select *, cast(k >= 0.8e0 * n as integer) as mask from per),
    {label_sql('seed', 60)},
    reg as (select split_part(l.scene_id, '|', 1) as target, cast(split_part(l.scene_id, '|', 2) as bigint) as scene_id, label, count(*) as pixels, sum(k) / cast(sum(n) as double) as ratio, avg(l.row) as mr, avg(l.col) as mc
      from labelled l join per p on l.scene_id = p.scene_id and l.row = p.row and l.col = p.col group by l.scene_id, label),
    geo as (select *, 0.02e0 * (mc + 0.5e0) + 74.95e0 + scene_id % 25 * 0.4e0 as lon, -0.02e0 * (mr + 0.5e0) + 10.05e0 + scene_id % 25 * 0.5e0 as lat, pixels * (0.02e0 * 111320e0) * (0.02e0 * 111320e0) / 1e4 as ha from reg),
    {Q}, {PLACE},
    f as (select q.query_id, q, g.lat as lat0, g.lon as lon0, coalesce(try_cast(regexp_extract(q, 'within\\s+(\\d+(?:\\.\\d+)?)\\s*km', 1) as double), case when {has(['around', 'near'])} then 6e0 else 5e0 end) as km,
      coalesce(try_cast(regexp_extract(q, '{qt.AREA_PATTERN}', 1) as double) * (case when regexp_extract(q, '{qt.AREA_PATTERN}', 2) like 'acre%' then {qt.HECTARES_PER_ACRE} else 1e0 end), case when contains(q, 'large') then 2e0 end, 0.5e0) as least_ha,
      case when {has(qt.SEARCH_CHANGE_WORDS)} or regexp_matches(q, '{qt.YEAR_PATTERN}') then 'land_use_change' when {has(qt.VACANT_WORDS)} then 'potentially_vacant_land'
        when {has(qt.VEGETATION_WORDS)} then (case when {has(qt.POOR_WORDS)} then 'low_vegetation_health' else 'healthy_vegetation' end) when {has(qt.WATER_WORDS)} then 'water_bodies'
        when {has(qt.BUILT_WORDS)} then 'built_up_infrastructure' else 'potentially_vacant_land' end as target,
      case when {has(qt.NEAREST_WORDS)} then 1 when {has(qt.LARGEST_WORDS)} then 0 when {has(qt.PERSISTENT_WORDS)} then 2 else 0 end as crit
      from q join place on q.query_id = place.query_id join gaz g on place.key = g.key where not {has(qt.UNSUPPORTED_WORDS)}),
    c as (select query_id, scene_id, label, pixels, ha, ratio, crit, sqrt(((lat - lat0) * 111e0) ** 2 + ((lon - lon0) * (cos(lat0 * pi() / 180e0) * 111e0)) ** 2) as dist
      from f join geo on f.target = geo.target and abs(lat - lat0) <= km / 111e0 and abs(lon - lon0) <= km / (cos(lat0 * pi() / 180e0) * 111e0) and ha >= least_ha)"""
)
REQUESTS = LAND_CTES[LAND_CTES.index("f as (select q.query_id"):LAND_CTES.index("c as (select query_id, scene_id")]
SQL["r12_land_change"] = sql(
    "px_time queries gaz",
    f"""with recursive {Q}, {PLACE}, {REQUESTS}
    y as (select query_id, coalesce(try_cast(regexp_extract_all(q, '{qt.YEAR_PATTERN}')[1] as integer), 2024) as y1,
      coalesce(try_cast(regexp_extract_all(q, '{qt.YEAR_PATTERN}')[2] as integer), 2026) as y2 from f where target = 'land_use_change'),
    i as (select scene_id, row, col, yr + 28 as yr, {NDVI} as ndvi, {NDBI} as ndbi from px_time), span as (select distinct y1, y2 from y),
    d as (select y1, y2, a.scene_id, a.row, a.col, b.ndvi - a.ndvi as dv, b.ndbi - a.ndbi as db from span join i a on a.yr = y1 join i b on b.yr = y2 and a.scene_id = b.scene_id and a.row = b.row and a.col = b.col),
    k as (select *, case when db > 0.1e0 then 'built_up_gain' when dv > 0.1e0 then 'vegetation_gain' when dv < -0.1e0 then 'vegetation_loss' end as kind from d),
    seed as (select 'land_use_change|' || y1 || '|' || y2 || '|' || kind || '#' || scene_id as scene_id, row, col, 1 as mask from k where kind is not null),
    {label_sql('seed', 60)},
    reg as (select split_part(scene_id, '#', 1) as target, cast(split_part(scene_id, '#', 2) as bigint) as scene_id, label, count(*) as pixels, avg(row) as mr, avg(col) as mc from labelled l group by l.scene_id, label),
    geo as (select *, 0.02e0 * (mc + 0.5e0) + 74.95e0 + scene_id % 25 * 0.4e0 as lon, -0.02e0 * (mr + 0.5e0) + 10.05e0 + scene_id % 25 * 0.5e0 as lat, pixels * (0.02e0 * 111320e0) * (0.02e0 * 111320e0) / 1e4 as ha from reg),
    c as (select f.query_id, geo.target, geo.scene_id, label, pixels, ha, crit, y1, y2, sqrt(((geo.lat - lat0) * 111e0) ** 2 + ((geo.lon - lon0) * (cos(lat0 * pi() / 180e0) * 111e0)) ** 2) as dist
      from f join y on f.query_id = y.query_id join geo on geo.target like 'land_use_change|' || y1 || '|' || y2 || '|%'
        and abs(geo.lat - lat0) <= km / 111e0 and abs(geo.lon - lon0) <= km / (cos(lat0 * pi() / 180e0) * 111e0) and ha >= least_ha)
    select query_id, target, scene_id, label, pixels, {sfixed('ha', 3)} as ha, {sfixed('dist', 3)} as km, y1 || '-' || y2 as temporal_persistence,
      row_number() over (partition by query_id order by case crit when 1 then round(dist, 3) when 2 then -1e0 else -ha end, -ha, scene_id, label, target) as rank from c""",
)
SQL["r12_land_search"] = sql(
    "px_time queries gaz",
    LAND_CTES
    + f"""select query_id, scene_id, label, pixels, {sfixed('ha', 3)} as ha, {sfixed('dist', 3)} as km, {sfixed('ratio')} as ratio,
      row_number() over (partition by query_id order by case crit when 1 then round(dist, 3) when 2 then -ratio else -ha end, -ha, scene_id, label) as rank from c""",
)


def _followup(spark, sf):
    i = F.col("query_id")
    asks = F.when(i % 3 == 0, "Only areas larger than 60 hectares").when(i % 3 == 1, "Which is the closest one?").otherwise("the persistent ones")
    prompts = v.queries(spark, sf).select(i.alias("search_id"), asks.alias("prompt"))
    found = _land(spark, sf)
    grouped = shared_searches(found.searches, prompts)
    refined = refine_shared(found.shared, grouped)
    replies = refine_reply(refined, ("group",)).select("group", F.col("count").alias("n"), (F.length("reply") > 0).alias("answered"))
    told = refined.select("group", "cand_id", "rule", F.col("position").cast("bigint").alias("position")).join(replies, "group")
    return hand_out(told, grouped.select("search_id", "group"), "group")


QUERIES["r12_followup"] = _followup
SQL["r12_followup"] = sql(
    "px_time queries gaz",
    LAND_CTES
    + """ , e as (select query_id as search_id, scene_id || '-' || label as cand_id, ha, ratio, dist, query_id % 3 as m from c)
    select search_id, cand_id, ['area', 'nearest', 'persistence'][m + 1] as rule, row_number() over (partition by search_id order by case when m = 1 then round(dist, 3) else 0e0 end, cand_id) as position,
      count(*) over (partition by search_id) as n, true as answered from e where (m <> 0 or ha >= 60) and (m <> 2 or ratio >= 0.8e0)""",
)
QUERIES["r12_land_search_answers"] = lambda spark, sf: _land(spark, sf).answers.select("query_id", "status", "candidates", fixed("total_hectares", 3).alias("ha"))
SQL["r12_land_search_answers"] = sql(
    "px_time queries gaz",
    LAND_CTES
    + f""" , n as (select query_id, count(*) as k, sum(ha) as ha from c group by 1)
    select q.query_id, case when {has(qt.UNSUPPORTED_WORDS)} then 'UNSUPPORTED_QUERY' when key is null then 'UNKNOWN_LOCATION'
      else 'COMPLETED' end as status,
      coalesce(k, 0) as candidates, {sfixed('n.ha', 3)} as ha from q left join place on q.query_id = place.query_id left join n on q.query_id = n.query_id""",
)



def _retrieval(spark, sf, years=20):
    scenes = v.catalog(spark, sf).withColumns(
        {"x0": F.lit(74.0) + (F.col("ord") % 25) * 0.4, "y0": F.lit(9.0) + (F.col("ord") % 25) * 0.5, "acquired_at": F.col("acquired_at") + F.expr(f"interval {years} year")}
    )
    scenes = scenes.withColumn("x1", F.col("x0") + 1.0 + F.col("w") * 0.05).withColumn("y1", F.col("y0") + 1.0 + F.col("w") * 0.05)
    return retrieve_pairs(v.queries(spark, sf), scenes, v.gaz(spark, sf), max_cloud=60.0, window_days=400)


QUERIES["r13_scene_retrieval"] = lambda spark, sf: _retrieval(spark, sf).select(
    "query_id", "task", "before_product_id", fixed("before_score").alias("before_score"), "after_product_id", fixed("after_score").alias("after_score")
)
R13_CTES = f"""with {Q}, {PLACE}, f as (select q.query_id, text, q, g.lat, g.lon, list_transform(regexp_extract_all(text, '{qt.RETRIEVAL_YEAR}', 1), lambda y: cast(y as integer)) as ys,
      contains(q, 'january') as jan, regexp_matches(q, '{qt.RADAR_WORDS}') as radar from q join place on q.query_id = place.query_id join gaz g on place.key = g.key),
    p as (select query_id, lat, lon, case when radar then 'Sentinel-1 SAR C-Band' else 'Sentinel-2 MSI' end as sensor,
      case when {has(qt.RETRIEVAL_CHANGE_WORDS)} then 'Bi-Temporal Change Analysis' when radar then 'SAR Radar Analysis' else 'Single Optical Analysis' end as task,
      make_timestamp(case when jan then coalesce(ys[1], 2024) when len(ys) >= 2 then least(ys[1], ys[2]) when len(ys) = 1 then ys[1] - 2 else 2024 end, 1, 15, 0, 0, 0) as da,
      make_timestamp(case when jan then coalesce(ys[2], 2026) when len(ys) >= 2 then greatest(ys[1], ys[2]) when len(ys) = 1 then ys[1] else 2026 end, 1, 15, 0, 0, 0) as db from f),
    s as (select product_id, product_type, sensor, collection, acquired_at + interval 20 year as acq, cloud, ord, 74e0 + ord % 25 * 0.4e0 as x0, 9e0 + ord % 25 * 0.5e0 as y0, w from catalog where collection <> 'SENTINEL-2' or cloud <= 60),
    j as (select query_id, task, product_id, product_type, p.sensor, acq, cloud, ord, side, case side when 1 then da else db end as td,
        greatest(least(x0 + 1e0 + w * 0.05e0, lon + 0.06e0) - greatest(x0, lon - 0.06e0), 0e0) * greatest(least(y0 + 1e0 + w * 0.05e0, lat + 0.06e0) - greatest(y0, lat - 0.06e0), 0e0) * 100e0
          / (((lon + 0.06e0) - (lon - 0.06e0)) * ((lat + 0.06e0) - (lat - 0.06e0))) as overlap
      from p join s on p.sensor = s.sensor and x0 <= lon + 0.06e0 and lon - 0.06e0 <= x0 + 1e0 + w * 0.05e0 and y0 <= lat + 0.06e0 and lat - 0.06e0 <= y0 + 1e0 + w * 0.05e0, generate_series(1, 2) t(side)),
    d as (select *, abs(floor(epoch(acq - td) / 86400e0)) as days from j),
    sc as (select *, least(0.99e0, greatest(0.1e0, (case when sensor = 'Sentinel-2 MSI' then greatest(0e0, 1e0 - cloud / 30e0) * 0.4e0 + 0.6e0 else 1e0 end) * (greatest(0e0, 1e0 - days / 60e0) * 0.3e0 + 0.7e0)
      * (overlap / 100e0 * 0.2e0 + 0.8e0) + (case when contains(product_type, '2A') or contains(product_type, 'GRD') then 0.08e0 else -0.05e0 end))) as score from d where days <= 400),
    b as (select * from sc qualify row_number() over (partition by query_id, side order by score desc, ord) = 1)"""
SQL["r13_scene_retrieval"] = sql(
    "queries gaz catalog",
    R13_CTES
    + f"""
    select query_id, task, max(product_id) filter (where side = 1) as before_product_id, {sfixed('max(score) filter (where side = 1)')} as before_score,
      case when task = 'Bi-Temporal Change Analysis' then max(product_id) filter (where side = 2) end as after_product_id,
      {sfixed("case when task = 'Bi-Temporal Change Analysis' then max(score) filter (where side = 2) end")} as after_score from b group by 1, 2""",
)


def _product_pixels(spark, sf):
    """Sixteen pixels for each product of the catalog."""
    at = F.explode(F.sequence(F.lit(0), F.lit(15)))
    k = v.table(spark, sf, "orders").join(v.catalog(spark, sf).select(F.col("ord").alias("o_orderkey"), "product_id"), "o_orderkey")
    k = k.select("product_id", "o_orderkey", "o_custkey", at.alias("at")).selectExpr("*", "cast(at div 4 as int) as row", "cast(at % 4 as int) as col")
    band = lambda m, n: (F.col("o_custkey") * (F.col("row") * m + 3) + F.col("o_orderkey") * (F.col("col") * n + 1)) % 256
    return k.select("product_id", "row", "col", band(5, 7).alias("r"), band(11, 3).alias("g"), band(2, 13).alias("b"))


def _retrieval_change(spark, sf):
    headers = v.catalog(spark, sf).select("product_id", F.lit(4).alias("height"), F.lit(4).alias("width"))
    out = retrieve_change(_retrieval(spark, sf), _product_pixels(spark, sf), headers)
    return out.select("query_id", "before_product_id", "after_product_id", "pixels", "changed_pixels", fixed("area_hectares").alias("ha"))


QUERIES["r13_retrieval_change"] = _retrieval_change
SQL["r13_retrieval_change"] = sql(
    "queries gaz catalog",
    R13_CTES
    + """, res as (select query_id, max(product_id) filter (where side = 1) as before_product_id, max(product_id) filter (where side = 2) as after_product_id
      from b where task = 'Bi-Temporal Change Analysis' group by 1 having count(distinct side) = 2),
    px as (select c.product_id, y as row, x as col, (o_custkey * (y * 5 + 3) + o_orderkey * (x * 7 + 1)) % 256 as r, (o_custkey * (y * 11 + 3) + o_orderkey * (x * 3 + 1)) % 256 as g,
      (o_custkey * (y * 2 + 3) + o_orderkey * (x * 13 + 1)) % 256 as b from orders join catalog c on o_orderkey = c.ord, generate_series(0, 3) t(y), generate_series(0, 3) u(x)),
    m as (select query_id, before_product_id, after_product_id, (abs(n.r - o.r) / 255e0 + abs(n.g - o.g) / 255e0 + abs(n.b - o.b) / 255e0) / 3e0 as mag, o.r as r1, o.g as g1, o.b as b1, n.r as r2, n.g as g2, n.b as b2
      from res join px o on o.product_id = before_product_id join px n on n.product_id = after_product_id and n.row = o.row and n.col = o.col),
    k as (select *, case when mag > 0.18e0 and b1 > 100 and b2 < 80 then 3 when mag > 0.18e0 and r2 > r1 then 1 when mag > 0.18e0 and g1 > g2 then 2 else 0 end as cls from m)
    select query_id, before_product_id, after_product_id, count(*) as pixels, count(*) filter (where cls > 0) as changed_pixels, """
    + sfixed("count(*) filter (where cls > 0) * 100e0 / 1e4")
    + """ as ha from k group by 1, 2, 3""",
)

