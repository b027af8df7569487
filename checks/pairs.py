"""Registered queries over two dates or two sensors."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.pixels import nd
from checks.regions import label_sql
from checks.views import fixed, sfixed, sql
from scenelake.functions import indices as ix
from scenelake.functions.geometry import area_units
from scenelake.operators import change as ch
from scenelake.operators import fusion
from scenelake.operators.display import radar_to_db
from scenelake.plans.change_job import detect_change, index_change_job
from scenelake.plans.fusion_job import fuse

QUERIES: dict = {}
SQL: dict[str, str] = {}
PX = ["scene_id", "row", "col"]

# --- J1
QUERIES["j1_pixel_pairs"] = v.px_pair
SQL["j1_pixel_pairs"] = sql("px_pair", "select * from px_pair")

MAG = "((abs(r2 - r1) / 255e0 + abs(g2 - g1) / 255e0 + abs(b2 - b1) / 255e0) / 3e0)"
CLS = f"case when {MAG} > 0.18e0 and b1 > 100 and b2 < 80 then 3 when {MAG} > 0.18e0 and r2 > r1 then 1 when {MAG} > 0.18e0 and g1 > g2 then 2 else 0 end"
CLASSED = f"classed as (select *, {CLS} as cls from px_pair)"
EXT = f"""{CLASSED}, ext as (select scene_id, cls, count(*) as pixels, min(row) as row_min, max(row) as row_max, min(col) as col_min, max(col) as col_max
  from classed group by 1, 2)"""
HDR = "hdr as (select scene_id, max(row) + 1 as height, max(col) + 1 as width from px_obs group by 1)"


def _headers(spark, sf):
    return v.px_obs(spark, sf).groupBy("scene_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))


QUERIES["p13_change_class"] = lambda spark, sf: ch.change_class(v.px_pair(spark, sf)).select(*PX, "cls")
SQL["p13_change_class"] = sql("px_pair", f"with {CLASSED} select scene_id, row, col, cls from classed")

QUERIES["u4_changed_classes"] = lambda spark, sf: ch.changed_classes(ch.change_class(v.px_pair(spark, sf)))
SQL["u4_changed_classes"] = sql("px_pair", f"with {CLASSED} select distinct scene_id, cls from classed where cls > 0")


def _totals(spark, sf):
    return ch.change_totals(ch.class_extents(ch.change_class(v.px_pair(spark, sf))))


QUERIES["a6_change_totals"] = lambda spark, sf: _totals(spark, sf).drop("has_significant_change")
SQL["a6_change_totals"] = sql(
    "px_pair",
    f"""with {CLASSED}, t as (select scene_id, count(*) as pixels, count(*) filter (where cls > 0) as changed_pixels from classed group by 1)
    select scene_id, pixels, changed_pixels, changed_pixels * 100e0 / pixels as change_percentage, changed_pixels * 100e0 as area_m2,
    changed_pixels * 100e0 / 1e4 as area_hectares, changed_pixels * 100e0 / 1e6 as area_km2 from t""",
)
QUERIES["p21_significant_change"] = lambda spark, sf: _totals(spark, sf).select("scene_id", "has_significant_change")
SQL["p21_significant_change"] = sql(
    "px_pair", f"with {CLASSED} select scene_id, round(count(*) filter (where cls > 0) * 100e0 / count(*), 1) > 2 as has_significant_change from classed group by 1"
)


def _regions(spark, sf, **kw):
    return ch.class_regions(ch.class_extents(ch.change_class(v.px_pair(spark, sf))), _headers(spark, sf), **kw)


REGION_SQL = f"""with {EXT}, {HDR}, k as (select ext.*, height, width, pixels / cast((row_max - row_min + 1) * (col_max - col_min + 1) as double) as density
  from ext join hdr on ext.scene_id = hdr.scene_id where cls > 0 and pixels >= 15)"""
QUERIES["a7_class_regions"] = lambda spark, sf: _regions(spark, sf).select(
    "scene_id", "cls", "change_type", "pixels", fixed(F.col("ymin"), 1).alias("ymin"), fixed(F.col("xmax"), 1).alias("xmax"),
    "area_m2", fixed("density").alias("density"), fixed("confidence").alias("confidence"),
)
SQL["a7_class_regions"] = sql(
    "px_obs px_pair",
    f"""{REGION_SQL} select scene_id, cls, case cls when 1 then 'Built-up Expansion' when 2 then 'Vegetation Loss' else 'Water Contraction' end as change_type,
    pixels, {sfixed('row_min * 100e0 / height', 1)} as ymin, {sfixed('col_max * 100e0 / width', 1)} as xmax, pixels * 100e0 as area_m2,
    {sfixed('density')} as density, {sfixed('least(greatest(density * 0.18e0 + 0.8e0, 0.82e0), 0.98e0)')} as confidence from k""",
)
QUERIES["a7_class_components"] = lambda spark, sf: ch.class_components(
    ch.change_class(v.px_pair(spark, sf)), _headers(spark, sf), min_pixels=4
).select("scene_id", "cls", "component", "pixels", "area_m2", fixed("density").alias("density"), fixed(F.col("ymax"), 1).alias("ymax"))
SQL["a7_class_components"] = sql(
    "px_obs px_pair",
    f"""with recursive {CLASSED}, {HDR}, seed as (select scene_id * 10 + cls as scene_id, row, col, 1 as mask from classed where cls > 0), {label_sql('seed', 150)},
    s as (select scene_id // 10 as sid, cast(scene_id % 10 as integer) as cls, label, count(*) as pixels, min(row) as r0, max(row) as r1, min(col) as c0, max(col) as c1 from labelled group by 1, 2, 3 having count(*) >= 4)
    select sid as scene_id, cls, label as component, pixels, pixels * 100e0 as area_m2, {sfixed('pixels / cast((r1 - r0 + 1) * (c1 - c0 + 1) as double)')} as density,
      {sfixed('r1 * 100e0 / height', 1)} as ymax from s join hdr on sid = hdr.scene_id""",
)
QUERIES["p17_region_noise_filter"] = lambda spark, sf: _regions(spark, sf, min_pixels=25).select("scene_id", "cls", "pixels")
SQL["p17_region_noise_filter"] = sql("px_pair", f"with {EXT} select scene_id, cls, pixels from ext where cls > 0 and pixels >= 25")

QUERIES["a8_area_by_type"] = lambda spark, sf: ch.area_by_type(_regions(spark, sf)).select(
    "scene_id", "change_type", fixed("hectares", 2).alias("ha"), "regions"
)
SQL["a8_area_by_type"] = sql(
    "px_pair",
    f"""with {EXT} select scene_id, case cls when 1 then 'Built-up Expansion' when 2 then 'Vegetation Loss' else 'Water Contraction' end as change_type,
    {sfixed('sum(pixels) * 100e0 / 1e4', 2)} as ha, count(*) as regions from ext where cls > 0 and pixels >= 15 group by 1, 2""",
)


# --- R8 whole job
def _job(spark, sf):
    obs = v.px_obs(spark, sf)
    result = detect_change(obs.filter("ep = 1"), obs.filter("ep = 2"), _headers(spark, sf))
    return result.summary.select(
        "scene_id", "pixels", "changed_pixels", "has_significant_change", "regions",
        *[fixed(c, 2).alias(c) for c in ("built_ha", "vegetation_ha", "water_ha")],
    )


QUERIES["r8_change_job"] = _job
SQL["r8_change_job"] = sql(
    "px_pair",
    f"""with {EXT} select scene_id, cast(sum(pixels) as bigint) as pixels, cast(coalesce(sum(pixels) filter (where cls > 0), 0) as bigint) as changed_pixels,
    round(coalesce(sum(pixels) filter (where cls > 0), 0) * 100e0 / sum(pixels), 1) > 2 as has_significant_change,
    count(*) filter (where cls > 0 and pixels >= 15) as regions, """
    + ", ".join(
        f"{sfixed(f'coalesce(sum(pixels) filter (where cls = {k} and pixels >= 15), 0) * 100e0 / 1e4', 2)} as {n}"
        for k, n in [(1, "built_ha"), (2, "vegetation_ha"), (3, "water_ha")]
    )
    + " from ext group by 1",
)

# --- index deltas
I1, I2 = nd("b081", "b041"), nd("b082", "b042")
W1, W2 = nd("b031", "b081"), nd("b032", "b082")
B1, B2 = nd("b111", "b081"), nd("b112", "b082")


def _deltas(spark, sf):
    d = ch.index_deltas(v.px_ms_pair(spark, sf))
    return d.select(
        "scene_id", *[fixed(f"delta_{i}").alias(f"delta_{i}") for i in ix.INDEX_BANDS], fixed("ndvi_1").alias("ndvi_1"),
        fixed("ndbi_2").alias("ndbi_2"), F.size("indicators").alias("n_notes"),
        F.array_join(F.transform("indicators", lambda s: F.substring_index(s, " (", 1)), "; ").alias("notes"),
    )


QUERIES["a5_index_deltas"] = _deltas
SQL["a5_index_deltas"] = sql(
    "px_ms_pair",
    f"""with m as (select scene_id, avg({I1}) as i1, avg({I2}) as i2, avg({W1}) as w1, avg({W2}) as w2, avg({B1}) as b1, avg({B2}) as b2 from px_ms_pair group by 1),
    n as (select *, list_filter([case when i2 - i1 > 0.05e0 then 'Vegetation Regrowth / Canopy Expansion' when i2 - i1 < -0.05e0 then 'Vegetation Canopy Reduction' end,
      case when b2 - b1 > 0.05e0 then 'Impervious / Built-up Construction Growth' when b2 - b1 < -0.05e0 then 'Demolition or Bare Soil Conversion' end,
      case when w2 - w1 > 0.04e0 then 'Inundation / Water Basin Expansion' when w2 - w1 < -0.04e0 then 'Water Body Surface Area Contraction' end], lambda x: x is not null) as found from m)
    select scene_id, {sfixed('i2 - i1')} as delta_ndvi, {sfixed('w2 - w1')} as delta_ndwi, {sfixed('b2 - b1')} as delta_ndbi, {sfixed('i1')} as ndvi_1,
    {sfixed('b2')} as ndbi_2, cast(greatest(len(found), 1) as integer) as n_notes,
    case when len(found) = 0 then 'Stable spectral response with minimal land-cover conversion.' else array_to_string(found, '; ') end as notes from n""",
)

DELTA = f"d as (select scene_id, row, col, {I1} as v1, {I2} as v2, least(greatest({I2} - {I1}, -1e0), 1e0) as delta from px_ms_pair)"
QUERIES["p14_delta_class"] = lambda spark, sf: v.px_ms_pair(spark, sf).select(
    *PX,
    ix.delta_class(ix.clipped_delta(ix.ndvi("b082", "b042"), ix.ndvi("b081", "b041"))).alias("cls"),
)
SQL["p14_delta_class"] = sql("px_ms_pair", f"with {DELTA} select scene_id, row, col, case when delta > 0.1e0 then 'improved' when delta < -0.1e0 then 'declined' else 'stable' end as cls from d")


def _areas(spark, sf):
    return v.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("scene_id"), (F.col("s_suppkey") % 40 + 1).cast("double").alias("aoi_area_km2"),
        F.lit("1997-01-01").alias("before_date"), F.lit("1999-01-01").alias("after_date"),
    )


def _index_job(spark, sf):
    ms = v.px_ms(spark, sf)
    out = index_change_job(ms.filter("ep = 1"), ms.filter("ep = 2"), _areas(spark, sf), "ndvi")
    return out.select(
        "scene_id", "pixels", "improved_label", *[fixed(f"{n}_percent").alias(f"{n}_percent") for n in ("improved", "stable", "declined")],
        fixed("before_mean").alias("before_mean"), fixed("after_mean").alias("after_mean"), fixed("mean_change").alias("mean_change"),
        fixed("declined_area_km2").alias("declined_km2"), F.col("summary").startswith(F.format_string("%.2f km²", "aoi_area_km2")).alias("says_area"),
    )


CHANGE = f"""with {DELTA} select d.scene_id, count(*) as pixels, 'Vegetation Growth / Greening' as improved_label,
    {sfixed('avg(case when delta > 0.1e0 then 100e0 else 0e0 end)')} as improved_percent,
    {sfixed('avg(case when delta between -0.1e0 and 0.1e0 then 100e0 else 0e0 end)')} as stable_percent,
    {sfixed('avg(case when delta < -0.1e0 then 100e0 else 0e0 end)')} as declined_percent,
    {sfixed('avg(v1)')} as before_mean, {sfixed('avg(v2)')} as after_mean, {sfixed('avg(delta)')} as mean_change,
    {sfixed('avg(case when delta < -0.1e0 then 100e0 else 0e0 end) / 100e0 * (d.scene_id % 40 + 1)')} as declined_km2, true as says_area
    from d join supplier on d.scene_id = s_suppkey group by 1"""
QUERIES["r11_index_change_job"] = _index_job
SQL["r11_index_change_job"] = sql("px_ms_pair", CHANGE)


def _summary(spark, sf):
    changes = ch.index_change(v.px_ms_pair(spark, sf), "ndbi")
    out = ch.change_summary(changes.join(_areas(spark, sf), "scene_id"), "ndbi")
    return out.select("scene_id", "improved_label", "stable_label", "declined_label", fixed("improved_area_km2").alias("improved_km2"))


QUERIES["a19_change_summary"] = _summary
SQL["a19_change_summary"] = sql(
    "px_ms_pair",
    f"""select p.scene_id, 'New Construction / Urban Expansion' as improved_label, 'Stable Impervious Surface' as stable_label,
    'Demolition / Surface Clearing' as declined_label,
    {sfixed(f'avg(case when least(greatest({B2} - {B1}, -1e0), 1e0) > 0.1e0 then 100e0 else 0e0 end) / 100e0 * (p.scene_id % 40 + 1)')} as improved_km2
    from px_ms_pair p join supplier on p.scene_id = s_suppkey group by p.scene_id""",
)


# --- optical and radar
def _optical(spark, sf):
    return v.px_multi(spark, sf).select(*PX, F.col("b04").alias("r"), F.col("b03").alias("g"), F.col("b02").alias("b"))


FUSED = """db as (select scene_id, row, col, log10(greatest(vv, 1e-7)) * 10e0 as vv, case when vh is not null then log10(greatest(vh, 1e-7)) * 10e0 end as vh from px_sar),
j as (select o.scene_id, o.row, o.col, b04 as r, b03 as g, b02 as b, vv, vh from px_multi o join db on o.scene_id = db.scene_id and o.row = db.row and o.col = db.col),
m as (select *, g > r * 1.15e0 and g > 0.2e0 as veg, b > r * 1.3e0 and r < 0.25e0 and g < 0.35e0 as wo, r > 0.85e0 and g > 0.85e0 and b > 0.85e0 as cl,
  vv > -6.5e0 as bs, vv < -20e0 as ws, coalesce(vh, vv - 6e0) > -14e0 and not vv > -6.5e0 as vs from j),
n as (select *, r > 0.25e0 and g > 0.25e0 and b > 0.25e0 and not veg as bo from m),
c as (select scene_id, count(*) as pixels, count(*) filter (where veg) as o_vegetation, count(*) filter (where wo) as o_water, count(*) filter (where bo) as o_urban,
  count(*) filter (where bs) as s_double_bounce, count(*) filter (where ws) as s_specular_water, count(*) filter (where vs) as s_volume_scattering,
  count(*) filter (where (bo and bs) or (wo and ws)) as agreeing_pixels, count(*) filter (where bo or bs or wo or ws) as claimed_pixels,
  count(*) filter (where cl and (bs or ws or vs)) as recovered_pixels, avg(vv) filter (where bs) as bdb from n group by 1)"""

QUERIES["j2_modality_pairs"] = lambda spark, sf: fusion.pair_modalities(_optical(spark, sf), v.px_sar(spark, sf))
SQL["j2_modality_pairs"] = sql(
    "px_multi px_sar",
    "select o.scene_id, o.row, o.col, b04 as r, b03 as g, b02 as b, vv, vh from px_multi o join px_sar s on o.scene_id = s.scene_id and o.row = s.row and o.col = s.col",
)


def _counts(spark, sf, **kw):
    pixels = fusion.pair_modalities(_optical(spark, sf), radar_to_db(v.px_sar(spark, sf)))
    return fusion.modality_counts(fusion.modality_masks(pixels), **kw)


QUERIES["a10_radar_class_counts"] = lambda spark, sf: _counts(spark, sf, min_structures=2).select(
    "scene_id", "pixels", "s_double_bounce", "s_specular_water", "s_volume_scattering", "structures", "o_vegetation"
)
SQL["a10_radar_class_counts"] = sql(
    "px_multi px_sar",
    f"with {FUSED} select scene_id, pixels, s_double_bounce, s_specular_water, s_volume_scattering, cast(greatest(2, s_double_bounce // 120) as bigint) as structures, o_vegetation from c",
)
QUERIES["a11_concordance"] = lambda spark, sf: _counts(spark, sf).select(
    "scene_id", "agreeing_pixels", "claimed_pixels", "recovered_pixels", fixed("concordance_pct").alias("concordance"), "recovered_km2"
)
SQL["a11_concordance"] = sql(
    "px_multi px_sar",
    f"""with {FUSED} select scene_id, agreeing_pixels, claimed_pixels, recovered_pixels,
    {sfixed('agreeing_pixels * 100e0 / nullif(claimed_pixels, 0)')} as concordance, recovered_pixels * 100e0 / 1e6 as recovered_km2 from c""",
)
QUERIES["r9_fusion_job"] = lambda spark, sf: fuse(_optical(spark, sf), v.px_sar(spark, sf)).summary.select(
    "scene_id", "pixels", "o_urban", "o_water", "s_double_bounce", "structures", "agreeing_pixels", fixed("double_bounce_db").alias("db")
)
SQL["r9_fusion_job"] = sql(
    "px_multi px_sar",
    f"with {FUSED} select scene_id, pixels, o_urban, o_water, s_double_bounce, s_double_bounce // 120 as structures, agreeing_pixels, {sfixed('bdb')} as db from c",
)
QUERIES["u1_evidence_union"] = lambda spark, sf: fuse(_optical(spark, sf), v.px_sar(spark, sf)).evidence.select(
    "scene_id", "source", "metric", fixed("value").alias("value")
)
SQL["u1_evidence_union"] = sql(
    "px_multi px_sar",
    f"""with {FUSED} select scene_id, 'optical' as source, 'o_vegetation' as metric, {sfixed('o_vegetation')} as value from c where o_vegetation > 50
    union all select scene_id, 'optical', 'pixels', {sfixed('pixels')} from c
    union all select scene_id, 'sar', 'structures', {sfixed('s_double_bounce // 120')} from c
    union all select scene_id, 'sar', 's_specular_water', {sfixed('s_specular_water')} from c
    union all select scene_id, 'combined', 'recovered_km2', {sfixed('recovered_pixels * 100e0 / 1e6')} from c
    union all select scene_id, 'combined', 'concordance_pct', {sfixed('agreeing_pixels * 100e0 / nullif(claimed_pixels, 0)')} from c""",
)


def _fused(spark, sf):
    optical = v.px_multi(spark, sf).select(*PX, *[F.floor(F.col(b) * 255.0).cast("int").alias(c) for c, b in zip("rgb", ("b04", "b03", "b02"))])
    radar = v.px_sar(spark, sf).select(
        *PX, F.floor(F.col("vv") * 255.0).cast("int").alias("r"), F.floor(F.coalesce("vh", F.lit(0.0)) * 255.0).cast("int").alias("g"),
        F.lit(40).alias("b"),
    )
    return fusion.fused_rgb(optical, radar)


QUERIES["f7_fused_rgb"] = _fused


def _blend(o: str, s: str) -> str:
    return f"cast(floor(least(greatest(floor({o} * 255e0) * 0.55e0 + ({s}) * 0.45e0, 0e0), 255e0)) as integer)"


SQL["f7_fused_rgb"] = sql(
    "px_multi px_sar",
    f"""select o.scene_id, o.row, o.col, {_blend('b04', 'floor(vv * 255e0)')} as r, {_blend('b03', 'floor(coalesce(vh, 0e0) * 255e0)')} as g, {_blend('b02', '40')} as b
    from px_multi o join px_sar s on o.scene_id = s.scene_id and o.row = s.row and o.col = s.col""",
)
QUERIES["f12_area_units"] = lambda spark, sf: ch.class_extents(ch.change_class(v.px_pair(spark, sf))).select(
    "scene_id", "cls", *[c.alias(n) for n, c in area_units("pixels", 10.0).items()]
)
SQL["f12_area_units"] = sql("px_pair", f"with {EXT} select scene_id, cls, pixels * 100e0 as m2, pixels * 100e0 / 1e4 as ha, pixels * 100e0 / 1e6 as km2 from ext")
