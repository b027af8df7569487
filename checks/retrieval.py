"""Scene retrieval to its end: typed branches, answers and trace rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.history import R13_CTES, _retrieval
from checks.pairs import DELTA
from checks.texts import Q, has
from checks.views import fixed, sfixed, sql
from scenelake.operators import query_text as qt
from scenelake.operators.change import index_change
from scenelake.plans.retrieval_answers import answer_requests

QUERIES: dict = {}
SQL: dict[str, str] = {}

SIDE = 24


def _headers(spark, sf):
    """Every product of the catalog on 24 x 24 pixels of 0.05 degrees."""
    k = F.col("ord") % 25
    return v.catalog(spark, sf).select(
        "product_id", F.lit(0.05).alias("a"), (F.lit(74.0) + k * 0.4).alias("c"), F.lit(-0.05).alias("e"), (F.lit(10.2) + k * 0.5).alias("f"),
        F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"),
    )


def _pixels(spark, sf):
    keys = v.catalog(spark, sf).select("product_id", "collection", F.col("ord").alias("o_orderkey"))
    orders = v.table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(keys, "o_orderkey")
    cells = orders.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))))
    mixed = lambda m, n: F.col("o_custkey") * (F.col("row") * m + 3) + F.col("o_orderkey") * (F.col("col") * n + 1)
    optical = F.col("collection") == "SENTINEL-2"
    band = lambda m, n: F.when(optical, mixed(m, n) % 256)
    return cells.select(
        "product_id", "row", "col", band(5, 7).alias("r"), band(11, 3).alias("g"), band(2, 13).alias("b"),
        F.when(~optical, -1.0 - mixed(5, 7) % 29).alias("vv"), F.when(~optical, -2.0 - mixed(11, 3) % 29).alias("vh"),
    )


def _answers(spark, sf):
    return answer_requests(_retrieval(spark, sf, 26), _pixels(spark, sf), _headers(spark, sf))


CTES = (
    R13_CTES.replace("interval 20 year", "interval 26 year")
    .replace("generate_series(1, 2) t(side)", "generate_series(1, 3) t(side)")
    .replace("product_type, p.sensor, acq", "product_type, s.sensor, lat, lon, acq")
    .replace("case side when 1 then da else db end as td", "case side when 2 then db else da end as td")
    .replace("from p join s on p.sensor = s.sensor and", "from p join s on")
    .replace("generate_series(1, 3) t(side)", "generate_series(1, 3) t(side) where s.sensor = case when side = 3 then 'Sentinel-2 MSI' else p.sensor end and (side < 3 or task = 'SAR Radar Analysis')")
    + """, res as (select query_id, any_value(task) as task, any_value(lat) as lat, any_value(lon) as lon, max(product_id) filter (where side = 1) as p1, max(product_id) filter (where side = 2) as p2,
        max(product_id) filter (where side = 3) as p3 from b group by 1),
    job as (select *, case when p1 is null or (task = 'Bi-Temporal Change Analysis' and p2 is null) then null when task = 'Bi-Temporal Change Analysis' then 'change'
        when task = 'SAR Radar Analysis' and p3 is not null then 'fusion' when task = 'SAR Radar Analysis' then 'radar' else 'optical' end as branch from res),
    named as (select *, p1 as first_product, case branch when 'change' then p2 when 'fusion' then p3 end as second_product from job),
    need as (select query_id, branch, lat, lon, 1 as part, first_product as product_id from named where branch is not null
      union all select query_id, branch, lat, lon, 2, second_product from named where second_product is not null),
    cell as (select query_id, branch, part, product_id, lat, lon, o_custkey as u, o_orderkey as k, t.y as row, x.x as col, 74e0 + o_orderkey % 25 * 0.4e0 + 0.05e0 * (x.x + 0.5e0) as px, 10.2e0 + o_orderkey % 25 * 0.5e0 - 0.05e0 * (t.y + 0.5e0) as py
      from need join catalog c using (product_id) join orders on o_orderkey = c.ord, generate_series(0, 23) t(y), generate_series(0, 23) x(x)),
    near as (select *, floor((lat + 0.06e0 - py) / 0.05e0) as cr, floor((px - lon + 0.06e0) / 0.05e0) as cc,
      (u * (row * 5 + 3) + k * (col * 7 + 1)) as m1, (u * (row * 11 + 3) + k * (col * 3 + 1)) as m2, (u * (row * 2 + 3) + k * (col * 13 + 1)) as m3
      from cell where abs(px - lon) <= 0.06e0 and abs(py - lat) <= 0.06e0),
    opt as (select query_id, branch, part, cr, cc, r, g, b, greatest(least(case when peak > 1 then r / 255e0 else r end, 1e0), 0e0) as nr, greatest(least(case when peak > 1 then g / 255e0 else g end, 1e0), 0e0) as ng,
        greatest(least(case when peak > 1 then b / 255e0 else b end, 1e0), 0e0) as nb
      from (select *, m1 % 256 as r, m2 % 256 as g, m3 % 256 as b, max(greatest(m1 % 256, m2 % 256, m3 % 256)) over (partition by query_id, part) as peak from near where product_id like 'S2%')),
    sar as (select query_id, branch, part, cr, cc, -1e0 - m1 % 29 as vv, -2e0 - m2 % 29 as vh from near where product_id like 'S1%'),
    om as (select query_id, branch, part, cr, cc, (ng > nr * 1.15e0 and ng > 0.2e0) as veg, (nb > nr * 1.3e0 and nr < 0.25e0 and ng < 0.35e0) as wat,
        (nr > 0.25e0 and ng > 0.25e0 and nb > 0.25e0 and not (ng > nr * 1.15e0 and ng > 0.2e0)) as urb, (nr > 0.85e0 and ng > 0.85e0 and nb > 0.85e0) as cld from opt),
    sm as (select query_id, branch, cr, cc, vv > -6.5e0 as bounce, vv < -20e0 as spec, vh > -14e0 and not vv > -6.5e0 as vol from sar),
    ch as (select o.query_id, count(*) as pixels, count(*) filter (where mag > 0.18e0 and moved) * 100e0 / count(*) as value
      from (select o.query_id, (abs(n.r - o.r) / 255e0 + abs(n.g - o.g) / 255e0 + abs(n.b - o.b) / 255e0) / 3e0 as mag, (o.b > 100 and n.b < 80) or n.r > o.r or o.g > n.g as moved from opt o join opt n on o.query_id = n.query_id and o.cr = n.cr and o.cc = n.cc where o.branch = 'change' and o.part = 1 and n.part = 2) o group by 1),
    fu as (select o.query_id, count(*) as pixels, count(*) filter (where (urb and bounce) or (wat and spec)) * 100e0 / nullif(count(*) filter (where urb or bounce or wat or spec), 0) as value,
        count(*) filter (where bounce) as n_bounce, count(*) filter (where cld and (bounce or spec or vol)) as recovered
      from om o join sm s on o.query_id = s.query_id and o.cr = s.cr and o.cc = s.cc where o.branch = 'fusion' group by 1),
    si as (select query_id, count(*) as pixels, avg(case when veg then 100e0 else 0e0 end) as value from om where branch = 'optical' group by 1
      union all select query_id, count(*), cast(count(*) filter (where bounce) // 120 as double) from sm where branch = 'radar' group by 1),
    told as (select query_id, pixels, value from ch union all select query_id, pixels, value from fu union all select * from si),
    answered as (select named.*, pixels, value, case when branch is null then 'NO_SCENE' when pixels is null then 'NO_PIXELS' else 'COMPLETED' end as status from named left join told using (query_id))"""
)

QUERIES["r13_single_answer"] = lambda spark, sf: _answers(spark, sf).answers.select(
    "query_id", "task", "branch", "status", "first_product", "second_product", "pixels", fixed("value").alias("value")
)
SQL["r13_single_answer"] = sql(
    "queries gaz catalog", CTES + f" select query_id, task, branch, status, first_product, second_product, pixels, {sfixed('value')} as value from answered"
)


def _fusion(spark, sf):
    found = _answers(spark, sf)
    asked = found.answers.filter("branch = 'fusion'").select("query_id", "job", "first_product", "second_product")
    facts = found.fusion.select(F.col("scene_id").alias("job"), "pixels", F.col("s_double_bounce").alias("double_bounce"), F.col("recovered_pixels").alias("recovered"), fixed("concordance_pct").alias("concordance"))
    return asked.join(facts, "job").drop("job")


QUERIES["r13_retrieval_fusion"] = _fusion
SQL["r13_retrieval_fusion"] = sql(
    "queries gaz catalog",
    CTES + f""" select query_id, first_product, second_product, fu.pixels, n_bounce as double_bounce, recovered, {sfixed('fu.value')} as concordance
      from fu join named using (query_id)""",
)

QUERIES["r13_trace"] = lambda spark, sf: _answers(spark, sf).trace.select("query_id", "step", "tool", "status", F.when(F.col("step").isin(3, 4), F.col("text")).alias("text"))
SQL["r13_trace"] = sql(
    "queries gaz catalog",
    CTES
    + """ select query_id, step, ['QueryParser', 'CatalogSearch', 'SceneSelector', 'PixelReader', 'Analysis'][step] as tool,
      case when case step when 3 then first_product is not null when 4 then pixels is not null when 5 then status = 'COMPLETED' else true end then 'COMPLETED' else 'FAILED' end as status,
      case step when 3 then 'Chosen: ' || coalesce(first_product, 'none') || ', ' || coalesce(second_product, 'none') || '.' when 4 then coalesce(pixels, 0) || ' pixels in the box.' end as text
      from answered, generate_series(1, 5) t(step)""",
)


# --- Q4 sentences on change by topic
def _described_change(spark, sf):
    pairs = v.px_ms_pair(spark, sf)
    many = pairs.agg(F.max("scene_id")).first()[0]
    asked = v.queries(spark, sf).select(
        "query_id", "text", (F.col("query_id") % many + 1).alias("scene_id"), F.lit("Somewhere, District").alias("location"), (F.col("query_id") % 9 + 0.5).alias("area_km2"),
        F.lit("2020-01-15T05:00:00").alias("before_date"), F.lit("2024-01-15T05:00:00").alias("after_date"),
    )
    told = qt.describe_change(asked.join(index_change(pairs, "ndvi"), "scene_id"))
    lead = F.concat(F.lit("Between 2020-01-15 and 2024-01-15 in Somewhere, "), "topic", F.lit(" gained on "))
    return told.select("query_id", "topic", *[fixed(f"{n}_km2").alias(f"{n}_km2") for n in ("improved", "stable", "declined")], F.col("answer").startswith(lead).alias("well_said"))


QUERIES["q4_describe_change"] = _described_change
SQL["q4_describe_change"] = sql(
    "queries px_ms_pair",
    f"""with {Q}, {DELTA}, g as (select scene_id, avg(case when delta > 0.1e0 then 100e0 else 0e0 end) as up, avg(case when delta between -0.1e0 and 0.1e0 then 100e0 else 0e0 end) as same,
      avg(case when delta < -0.1e0 then 100e0 else 0e0 end) as down from d group by 1),
    t as (select query_id, query_id % 9 + 0.5e0 as size, query_id % (select max(scene_id) from px_ms_pair) + 1 as scene_id,
      case when {has(qt.TOPIC_WORDS['built'])} then 'built' when {has(qt.TOPIC_WORDS['vegetation'])} then 'vegetation' when {has(qt.TOPIC_WORDS['water'])} then 'water' else 'general' end as topic from q)
    select query_id, topic, {sfixed('up / 100e0 * size')} as improved_km2, {sfixed('same / 100e0 * size')} as stable_km2, {sfixed('down / 100e0 * size')} as declined_km2, true as well_said
      from t join g using (scene_id)""",
)
