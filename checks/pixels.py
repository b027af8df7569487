"""Registered queries over pixel tables: indices, statistics, display, radar, masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.views import fixed, sfixed, sql
from scenelake.functions import indices as ix
from scenelake.functions import optical as opt
from scenelake.functions import radar as sar
from scenelake.operators import display, headers, stats
from scenelake.operators.quantiles import quantiles
from scenelake.plans.index_product import index_product
from scenelake.sources.pixels import scan_bands

QUERIES: dict = {}
SQL: dict[str, str] = {}

PX = ["scene_id", "row", "col"]


def nd(a: str, b: str) -> str:
    total = f"(case when ({a}) + ({b}) = 0 then 1e-6 else ({a}) + ({b}) end)"
    return f"least(greatest((({a}) - ({b})) / {total}, -1e0), 1e0)"


NDVI, NDWI, NDBI = nd("b08", "b04"), nd("b03", "b08"), nd("b11", "b08")

# --- S1 band scan: two columns of a wide table, missing values filled
QUERIES["s1_scan_bands"] = lambda spark, sf: scan_bands(
    spark, f"{sf}/lineitem.parquet", bands=["l_quantity", "l_tax"], keys=["l_suppkey", "l_partkey"], fill=0.0
).groupBy("l_suppkey").agg(F.max("l_quantity").alias("q"), F.max("l_tax").alias("t"), F.count("*").alias("n"))
SQL["s1_scan_bands"] = """
select l_suppkey, max(coalesce(l_quantity, 0)) as q, max(coalesce(l_tax, 0)) as t, count(*) as n
from lineitem group by 1"""

# --- F1 / P14-free pixel indices
QUERIES["f1_indices"] = lambda spark, sf: v.px_multi(spark, sf).select(
    *PX, ix.ndvi().alias("ndvi"), ix.ndwi().alias("ndwi"), ix.ndbi().alias("ndbi")
)
SQL["f1_indices"] = sql("px_multi", f"select scene_id, row, col, {NDVI} as ndvi, {NDWI} as ndwi, {NDBI} as ndbi from px_multi")

QUERIES["f1_index_rules"] = lambda spark, sf: v.px_multi(spark, sf).select(
    *PX,
    ix.normalized_difference("b03", "b11", clip=False).alias("unclipped"),
    ix.normalized_difference("b03", "b11", eps_mode="add", clip=False).alias("added"),
    ix.normalized_difference("b03", "b11", nan_to_zero=False).alias("clipped"),
)
SQL["f1_index_rules"] = sql(
    "px_multi",
    f"""select scene_id, row, col,
        (b03 - b11) / (case when b03 + b11 = 0 then 1e-6 else b03 + b11 end) as unclipped,
        (b03 - b11) / (b03 + b11 + 1e-6) as added, {nd('b03', 'b11')} as clipped from px_multi""",
)

# --- P4 valid pixels
QUERIES["p4_valid_pixels"] = lambda spark, sf: (
    v.px_sar(spark, sf)
    .groupBy("scene_id")
    .agg(
        F.count_if(F.col("vh").isNotNull() & ~F.isnan("vh") & (F.col("vh") > 0)).alias("valid"),
        F.count_if(F.col("vh").isNull()).alias("missing"),
        F.count("*").alias("pixels"),
    )
)
SQL["p4_valid_pixels"] = sql(
    "px_sar",
    """select scene_id, count(*) filter (where vh > 0) as valid, count(*) filter (where vh is null) as missing,
       count(*) as pixels from px_sar group by 1""",
)

# --- P8 bare land
QUERIES["p8_bare_land"] = lambda spark, sf: (
    v.px_multi(spark, sf).filter(ix.bare_land(ix.ndvi(), ix.ndwi(), ix.ndbi())).select(*PX)
)
SQL["p8_bare_land"] = sql("px_multi", f"select scene_id, row, col from px_multi where {NDVI} < 0.25e0 and {NDWI} < 0e0 and {NDBI} < 0.15e0")


# --- P15 classes and colour ramp
def _classes(spark, sf):
    px = v.px_multi(spark, sf).select(*PX, ix.ndvi().alias("ndvi"), ix.ndwi().alias("ndwi"), ix.ndbi().alias("ndbi"))
    out = px.select(
        *PX,
        *[ix.index_class(i, i).alias(f"{i}_class") for i in ix.INDEX_BANDS],
        *[ix.ramp_class(i, i).alias(f"{i}_ramp") for i in ix.INDEX_BANDS],
    )
    flat = [c for i in ix.INDEX_BANDS for c in (f"{i}_class", F.col(f"{i}_ramp.legend").alias(f"{i}_legend"))]
    colour = [F.col(f"{i}_ramp.{c}").alias(f"{i}_{c}") for i in ix.INDEX_BANDS for c in "rgb"]
    return out.select(*PX, *flat, *colour)


def _class_case(index: str) -> str:
    high, low, top, middle, bottom = ix.INDEX_CLASSES[index]
    return f"case when {index} > {high}e0 then '{top}' when {index} >= {low}e0 then '{middle}' else '{bottom}' end"


def _ramp_case(index: str, pick) -> str:
    parts = []
    for limit, strict, legend, rgb in ix.INDEX_RAMPS[index]:
        value = pick(legend, rgb)
        value = f"'{value}'" if isinstance(value, str) else str(value)
        parts.append(f"else {value}" if limit is None else f"when {index} {'>' if strict else '>='} {limit}e0 then {value}")
    return "case " + " ".join(parts) + " end"


QUERIES["p15_index_classes"] = _classes
SQL["p15_index_classes"] = sql(
    "px_multi",
    f"with idx as (select scene_id, row, col, {NDVI} as ndvi, {NDWI} as ndwi, {NDBI} as ndbi from px_multi) select scene_id, row, col, "
    + ", ".join(
        f"{_class_case(i)} as {i}_class, {_ramp_case(i, lambda name, _: name)} as {i}_legend, "
        + ", ".join(f"{_ramp_case(i, lambda _, rgb, k=k: rgb[k])} as {i}_{c}" for k, c in enumerate("rgb"))
        for i in ix.INDEX_BANDS
    )
    + " from idx",
)


# --- A2 index statistics, A3 class shares, R10 index product (entry)
def _index_stats(spark, sf):
    s = stats.index_stats(v.px_multi(spark, sf))
    share = lambda name: F.try_element_at("shares", F.lit(name))
    first, second = F.map_values("shares")[0], F.try_element_at(F.map_values("shares"), F.lit(2))
    return s.select(
        "scene_id", "index", "valid_pixels", fixed("mean").alias("mean"), "min", "max", fixed("std").alias("std"),
        fixed(first).alias("share"), fixed(F.coalesce(second, F.lit(0.0))).alias("share2"),
    )


QUERIES["a2_index_stats"] = _index_stats
SQL["a2_index_stats"] = sql(
    "px_multi",
    f"""with idx as (select scene_id, {NDVI} as ndvi, {NDWI} as ndwi, {NDBI} as ndbi from px_multi)
    """
    + " union all ".join(
        f"""select scene_id, '{i}' as index, count(*) as valid_pixels, {sfixed(f'avg({i})')} as mean, min({i}) as min, max({i}) as max,
            {sfixed(f'stddev_pop({i})')} as std, {sfixed(f'avg(case when {a} then 100e0 else 0e0 end)')} as share,
            {sfixed(f'avg(case when {b} then 100e0 else 0e0 end)')} as share2 from idx group by 1"""
        for i, a, b in [
            ("ndvi", "ndvi > 0.4e0", "ndvi >= 0 and ndvi < 0.25e0"),
            ("ndwi", "ndwi > 0", "false"),
            ("ndbi", "ndbi > 0.1e0", "false"),
        ]
    ),
)

QUERIES["a3_class_breakdown"] = lambda spark, sf: (
    stats.class_breakdown(v.px_multi(spark, sf).select("scene_id", ix.index_class("ndvi", ix.ndvi()).alias("cls")), "cls")
    .select("scene_id", "pixels", F.explode("class_breakdown").alias("cls", "pct"))
    .select("scene_id", "pixels", "cls", fixed("pct").alias("pct"))
)
SQL["a3_class_breakdown"] = sql(
    "px_multi",
    f"""with idx as (select scene_id, {NDVI} as ndvi from px_multi),
    cls as (select scene_id, {_class_case('ndvi')} as cls, count(*) as n from idx group by 1, 2)
    select scene_id, cast(sum(n) over (partition by scene_id) as bigint) as pixels, cls,
           {sfixed('n * 100e0 / sum(n) over (partition by scene_id)')} as pct from cls""",
)


def flagship(spark, sf):
    """How green is each scene: NDVI statistics with class shares."""
    product = index_product(v.px_multi(spark, sf), "ndvi")
    high, low, top, middle, bottom = ix.INDEX_CLASSES["ndvi"]
    share = lambda name: fixed(F.col("class_breakdown")[name])
    return product.select(
        "scene_id", "valid_pixels", fixed("mean").alias("mean"), "min", "max", fixed("std").alias("std"),
        share(top).alias("healthy_pct"), share(middle).alias("moderate_pct"), share(bottom).alias("low_pct"),
    )


QUERIES["r10_index_product"] = flagship
SQL["r10_index_product"] = sql(
    "px_multi",
    f"""with idx as (select scene_id, {NDVI} as ndvi from px_multi)
    select scene_id, count(*) as valid_pixels, {sfixed('avg(ndvi)')} as mean, min(ndvi) as min, max(ndvi) as max,
           {sfixed('stddev_pop(ndvi)')} as std,
           {sfixed('avg(case when ndvi > 0.5e0 then 100e0 else 0e0 end)')} as healthy_pct,
           {sfixed('avg(case when ndvi >= 0.2e0 and ndvi <= 0.5e0 then 100e0 else 0e0 end)')} as moderate_pct,
           {sfixed('avg(case when ndvi < 0.2e0 then 100e0 else 0e0 end)')} as low_pct
    from idx group by 1""",
)

QUERIES["a1_band_stats"] = lambda spark, sf: stats.band_stats(v.px_long(spark, sf), digits=None).select(
    "scene_id", "band", "valid_pixels", "min", "max", fixed("mean").alias("mean"), fixed("std").alias("std")
)
SQL["a1_band_stats"] = sql(
    "px_long",
    f"""select scene_id, band, count(value) as valid_pixels, min(value) as min, max(value) as max,
        {sfixed('avg(value)')} as mean, {sfixed('stddev_pop(value)')} as std from px_long group by 1, 2""",
)

QUERIES["a4_percentiles"] = lambda spark, sf: quantiles(
    v.px_sar(spark, sf), ["scene_id"], "vv", (0.01, 0.02, 0.8, 0.98, 0.99), ("p1", "p2", "p80", "p98", "p99")
).select("scene_id", *[fixed(p, 9).alias(p) for p in ("p1", "p2", "p80", "p98", "p99")])
SQL["a4_percentiles"] = sql(
    "px_sar",
    "select scene_id, "
    + ", ".join(f"{sfixed(f'quantile_cont(vv, {p})', 9)} as {n}" for p, n in [(0.01, "p1"), (0.02, "p2"), (0.8, "p80"), (0.98, "p98"), (0.99, "p99")])
    + " from px_sar group by 1",
)

QUERIES["a9_missing_share"] = lambda spark, sf: stats.missing_share(v.px_sar(spark, sf), "vh").select(
    "scene_id", "pixels", fixed("nodata_percentage").alias("pct")
)
SQL["a9_missing_share"] = sql(
    "px_sar",
    f"""select scene_id, count(*) as pixels, {sfixed('avg(case when vh is null then 100e0 else 0e0 end)')} as pct
    from px_sar group by 1""",
)


def _caption(spark, sf):
    captioned = stats.scene_caption(stats.index_stats(v.px_multi(spark, sf)))
    phrase = F.col("caption").contains
    return captioned.select(
        "scene_id", fixed("veg").alias("veg"), fixed("built").alias("built"), fixed("water").alias("water"),
        phrase("vegetation canopy").alias("says_veg"), phrase("built-up").alias("says_built"), phrase("water").alias("says_water"),
    )


QUERIES["a18_scene_caption"] = _caption
SQL["a18_scene_caption"] = sql(
    "px_multi",
    f"""with idx as (select scene_id, {NDVI} as ndvi, {NDWI} as ndwi, {NDBI} as ndbi from px_multi),
    s as (select scene_id, avg(case when ndvi > 0.4e0 then 100e0 else 0e0 end) as veg,
      avg(case when ndbi > 0.1e0 then 100e0 else 0e0 end) as built, avg(case when ndwi > 0 then 100e0 else 0e0 end) as water
      from idx group by 1)
    select scene_id, {sfixed('veg')} as veg, {sfixed('built')} as built, {sfixed('water')} as water,
      veg > 0 as says_veg, built > 0 as says_built, water > 0 as says_water from s""",
)

# --- display
LIMITS = """lim as (select scene_id, quantile_cont(vv, 0.02) as lo, quantile_cont(vv, 0.98) as hi from px_sar where vv > 0 group by 1)"""
STRETCHED = "cast(floor(least(greatest((vv - lo) / ((case when hi <= lo then lo + 1 else hi end) - lo), 0e0), 1e0) * 255e0) as integer)"
QUERIES["f4_stretch"] = lambda spark, sf: display.stretch(v.px_sar(spark, sf), "vv").select(*PX, "byte")
SQL["f4_stretch"] = sql("px_sar", f"with {LIMITS} select scene_id, row, col, {STRETCHED} as byte from px_sar join lim using (scene_id)")

QUERIES["f2_to_db"] = lambda spark, sf: v.px_sar(spark, sf).select(
    *PX, fixed(sar.to_db("vv")).alias("vv_db"), fixed(sar.to_db("vh")).alias("vh_db"),
    fixed(sar.to_db("vv", 1e-5, 1e5)).alias("vv_clipped"),
)
SQL["f2_to_db"] = sql(
    "px_sar",
    f"""select scene_id, row, col, {sfixed('log10(greatest(vv, 1e-7)) * 10e0')} as vv_db,
    {sfixed('case when vh is not null then log10(greatest(vh, 1e-7)) * 10e0 end')} as vh_db,
    {sfixed('log10(least(greatest(vv, 1e-5), 1e5)) * 10e0')} as vv_clipped from px_sar""",
)

QUERIES["f3_linear_scenes"] = lambda spark, sf: display.linear_scenes(
    v.px_grid(spark, sf).select("scene_id", F.col("v").alias("vv"), (F.col("v") * F.col("v")).alias("vh")), ["vv", "vh"]
).unionByName(display.linear_scenes(v.px_sar(spark, sf)).withColumn("scene_id", -1 - F.col("scene_id")))
SQL["f3_linear_scenes"] = sql(
    "px_grid px_sar",
    """select scene_id, min(least(v, v * v)) >= 0 as is_linear from px_grid group by 1
    union all select -1 - scene_id, min(least(vv, coalesce(vh, vv))) >= 0 from px_sar group by 1""",
)

DB = """db as (select scene_id, row, col, log10(greatest(vv, 1e-7)) * 10e0 as vv,
  case when vh is not null then log10(greatest(vh, 1e-7)) * 10e0 end as vh from px_sar)"""
QUERIES["p11_radar_masks"] = lambda spark, sf: display.radar_to_db(v.px_sar(spark, sf)).select(
    *PX, *[c.alias(n) for n, c in sar.backscatter_masks().items()]
)
SQL["p11_radar_masks"] = sql(
    "px_sar",
    f"""with {DB} select scene_id, row, col, vv > -6.5e0 as double_bounce, vv < -20e0 as specular_water,
    coalesce(vh, vv - 6e0) > -14e0 and not (vv > -6.5e0) as volume_scattering from db""",
)
QUERIES["p12_radar_grounding_masks"] = lambda spark, sf: (
    v.px_sar(spark, sf)
    .select(*PX, sar.to_db("vv", 1e-5, 1e5).alias("vv"))
    .select(*PX, *[sar.grounding_mask(i).alias(i) for i in ("strong", "water", "rough", "other")])
)
SQL["p12_radar_grounding_masks"] = sql(
    "px_sar",
    """with db as (select scene_id, row, col, log10(least(greatest(vv, 1e-5), 1e5)) * 10e0 as vv from px_sar)
    select scene_id, row, col, vv >= -7e0 as strong, vv <= -18e0 as water, vv >= -14e0 and vv < -7e0 as rough,
    vv >= -9e0 as other from db""",
)


def _radar_composite(spark, sf):
    linear = v.px_sar(spark, sf)
    return display.radar_composite(linear)


QUERIES["f5_radar_composite"] = _radar_composite
SQL["f5_radar_composite"] = sql(
    "px_sar",
    """with lim as (select scene_id, quantile_cont(vv, 0.01) as lo, quantile_cont(vv, 0.99) as hi,
        quantile_cont(vh, 0.01) as lo2, quantile_cont(vh, 0.99) as hi2 from px_sar group by 1),
    s as (select px_sar.scene_id, row, col,
      cast(floor(least(greatest((vv - lo) / (hi - lo), 0e0), 1e0) * 255e0) as integer) as r,
      coalesce(cast(floor(least(greatest((vh - lo2) / (hi2 - lo2), 0e0), 1e0) * 255e0) as integer), 0) as g
      from px_sar join lim on px_sar.scene_id = lim.scene_id)
    select scene_id, row, col, r, g, abs(r - g) as b from s""",
)

QUERIES["f6_display_gain"] = lambda spark, sf: v.px_multi(spark, sf).select(
    *PX,
    *opt.display_rgb("true_color"),
    *[c.alias(f"n{n}") for n, c in zip("rgb", opt.display_rgb("false_color_nir"))],
)


def _gain(c: str, g: str) -> str:
    return f"cast(floor(least(greatest({c} * {g} * 255e0, 0e0), 255e0)) as integer)"


SQL["f6_display_gain"] = sql(
    "px_multi",
    f"""select scene_id, row, col, {_gain('b04', '2.5e0')} as r, {_gain('b03', '2.5e0')} as g, {_gain('b02', '2.5e0')} as b,
    {_gain('b08', '2.2e0')} as nr, {_gain('b04', '2.2e0')} as ng, {_gain('b03', '2.2e0')} as nb from px_multi""",
)

QUERIES["f8_reflectance"] = lambda spark, sf: display.normalize_reflectance(v.px_obs(spark, sf), keys=["scene_id", "ep"]).select(
    *PX, "ep", "r", "g", "b"
)
SQL["f8_reflectance"] = sql(
    "px_obs",
    """with peak as (select scene_id, ep, max(greatest(r, g, b)) as p from px_obs group by 1, 2)
    select o.scene_id, row, col, o.ep, """
    + ", ".join(f"least(greatest(case when p > 1 then {c} / 255e0 else cast({c} as double) end, 0e0), 1e0) as {c}" for c in "rgb")
    + " from px_obs o join peak on o.scene_id = peak.scene_id and o.ep = peak.ep",
)

LUM = "(r * 0.299e0 + g * 0.587e0 + b * 0.114e0)"
EXG = "(g * 2e0 - r - b)"
QUERIES["f9_luminance"] = lambda spark, sf: v.px_obs(spark, sf).select(
    *PX, "ep", opt.luminance().alias("lum"), opt.excess_green().alias("exg")
)
SQL["f9_luminance"] = sql("px_obs", f"select scene_id, row, col, ep, {LUM} as lum, {EXG} as exg from px_obs")

QUERIES["p9_optical_masks"] = lambda spark, sf: v.px_multi(spark, sf).select(
    *PX, *[c.alias(n) for n, c in opt.reflectance_masks("b04", "b03", "b02").items()]
)
SQL["p9_optical_masks"] = sql(
    "px_multi",
    """with m as (select *, b03 > b04 * 1.15e0 and b03 > 0.2e0 as veg from px_multi)
    select scene_id, row, col, veg as vegetation, b02 > b04 * 1.3e0 and b04 < 0.25e0 and b03 < 0.35e0 as water,
    b04 > 0.25e0 and b03 > 0.25e0 and b02 > 0.25e0 and not veg as urban,
    b04 > 0.85e0 and b03 > 0.85e0 and b02 > 0.85e0 as cloud_or_haze from m""",
)

MASK_SQL = {
    "trees": f"(g > r + 2 and g > b and {EXG} > 4e0) or ({LUM} < 75 and g >= r - 8 and b < 65 and {LUM} > 20)",
    "sports": f"(r > 165 and r > g + 40 and r > b + 70) or ({EXG} > 14e0 and g > r + 8 and {LUM} > 60 and {LUM} < 210)",
    "water": f"({LUM} < 55 and b >= r - 4) or (b > r + 15 and g > r + 8 and {LUM} < 120)",
    "urban": f"{LUM} > 180 and abs(r - g) < 30 and abs(g - b) < 30 and not ({EXG} > 10e0)",
}
QUERIES["p10_target_masks"] = lambda spark, sf: v.px_rgb(spark, sf).select(
    *PX, *[opt.target_mask(f).alias(f) for f in MASK_SQL]
)
SQL["p10_target_masks"] = sql("px_rgb", "select scene_id, row, col, " + ", ".join(f"({m}) as {n}" for n, m in MASK_SQL.items()) + " from px_rgb")

# --- headers
ROLE = r"""case when regexp_matches(d, '\b(vv|co-pol|co_pol)\b|copol') then 'VV' when regexp_matches(d, '\b(vh|cross-pol|cross_pol)\b|crosspol') then 'VH'
  when regexp_matches(d, '\b(b02|b2|blue)\b') then 'B02' when regexp_matches(d, '\b(b03|b3|green)\b') then 'B03'
  when regexp_matches(d, '\b(b04|b4|red)\b') then 'B04'
  when total_bands >= 12 then ['B01','B02','B03','B04','B05','B06','B07','B08','B8A','B09','B11','B12'][band_idx]
  when total_bands = 6 then ['B02','B03','B04','B08','B11','B12'][band_idx]
  when total_bands = 4 and regexp_matches(f, 'b04|b4|b08|b8') then ['B04','B08','B11','B12'][band_idx]
  when total_bands = 4 then ['B04','B03','B02','B08'][band_idx] when total_bands = 3 then ['Red','Green','Blue'][band_idx]
  when total_bands = 2 then ['VV','VH'][band_idx]
  when regexp_matches(f, 'vv|vh|sar|s1|grd|slc|sigma0|risat') then (case when contains(f, 'vh') then 'VH' else 'VV' end)
  when contains(f, 'b02') then 'B02' when contains(f, 'b03') then 'B03' when contains(f, 'b04') then 'B04'
  when contains(f, 'b08') then 'B08' when contains(f, 'b11') then 'B11' when contains(f, 'b12') then 'B12' else 'Pan' end"""
ROLES = f"roles as (select *, {ROLE} as role from (select *, lower(trim(description)) as d, lower(filename) as f from bands))"

QUERIES["p1_band_role"] = lambda spark, sf: v.bands(spark, sf).select("scene_id", "band_idx", headers.band_role().alias("role"))
SQL["p1_band_role"] = sql("bands", f"with {ROLES} select scene_id, band_idx, role from roles")

QUERIES["a17_role_map"] = lambda spark, sf: headers.role_map(v.bands(spark, sf)).select("scene_id", F.explode("role_map").alias("role", "idx"))
SQL["a17_role_map"] = sql("bands", f"with {ROLES} select scene_id, role, min(band_idx) as idx from roles where role <> 'Unknown' group by 1, 2")

SCENES = f"""{ROLES}, sc as (select scene_id, any_value(total_bands) as n, any_value(f) as f, list(distinct role) as rs from roles group by 1),
typed as (select *, case when list_has_any(rs, ['VV','VH','HH','HV']) or (n in (1, 2) and regexp_matches(f, 'sar|sentinel-1|s1|risat|sigma0|backscatter')) then 'SAR'
   when n >= 4 or (n > 1 and list_has_any(rs, ['B08','B11','B12'])) then 'OPTICAL MULTISPECTRAL' when n = 3 then 'OPTICAL RGB'
   else 'OPTICAL SINGLE-BAND' end as raster_type from sc)"""
QUERIES["p2_raster_type"] = lambda spark, sf: headers.classify_scenes(v.bands(spark, sf)).select(
    "scene_id", "raster_type", "sensor", "modality", F.concat_ws("+", "polarizations").alias("pols")
)
SQL["p2_raster_type"] = sql(
    "bands",
    f"""with {SCENES} select scene_id, raster_type, case raster_type when 'SAR' then (case when contains(f, 'risat') then 'RISAT-1A SAR'
      when contains(f, 's1') or n in (1, 2) then 'Sentinel-1 SAR' else 'Unknown' end)
     when 'OPTICAL MULTISPECTRAL' then (case when contains(f, 'landsat') then 'Landsat Multispectral' when n in (4, 6, 12, 13) then 'Sentinel-2 Multispectral' else 'Optical Multispectral' end)
     when 'OPTICAL RGB' then 'Optical RGB Sensor' else 'Panchromatic / Single-Band Optical' end as sensor,
     case raster_type when 'SAR' then 'SAR' when 'OPTICAL MULTISPECTRAL' then 'Multispectral' else 'Optical' end as modality,
     case when raster_type <> 'SAR' then '' when list_has_any(rs, ['VV','VH','HH','HV']) then array_to_string(list_filter(['VV','VH','HH','HV'], lambda r: list_contains(rs, r)), '+')
       when n = 1 then 'VV' else 'VV+VH' end as pols from typed""",
)
QUERIES["p3_capabilities"] = lambda spark, sf: headers.classify_scenes(v.bands(spark, sf)).select(
    "scene_id", "has_true_color", "ndvi_supported", "ndwi_supported", "ndbi_supported"
)
SQL["p3_capabilities"] = sql(
    "bands",
    f"""with {SCENES}, t as (select *, raster_type = 'OPTICAL MULTISPECTRAL' as ms from typed)
    select scene_id, (ms and list_has_any(rs, ['B04','Red']) and list_has_any(rs, ['B03','Green']) and list_has_any(rs, ['B02','Blue'])) or raster_type = 'OPTICAL RGB' as has_true_color,
    ms and list_contains(rs, 'B08') and list_has_any(rs, ['B04','Red']) as ndvi_supported,
    ms and list_has_any(rs, ['B03','Green']) and list_contains(rs, 'B08') as ndwi_supported,
    ms and list_contains(rs, 'B11') and list_contains(rs, 'B08') as ndbi_supported from t""",
)
QUERIES["u2_band_subset"] = lambda spark, sf: headers.with_bands(headers.role_map(v.bands(spark, sf)), ["B04", "B08"]).select("scene_id")
SQL["u2_band_subset"] = sql("bands", f"with {SCENES} select scene_id from typed where list_contains(rs, 'B04') and list_contains(rs, 'B08')")

CHOICE = f"""{ROLES}, m as (select scene_id, any_value(total_bands) as n, any_value(f) as f,
  min(band_idx) filter (where role = 'B04') as b4, min(band_idx) filter (where role = 'Red') as rr,
  min(band_idx) filter (where role = 'B03') as b3, min(band_idx) filter (where role = 'Green') as gg,
  min(band_idx) filter (where role = 'B02') as b2, min(band_idx) filter (where role = 'Blue') as bb,
  min(band_idx) filter (where role = 'B08') as nir, min(band_idx) filter (where role = 'VV') as vv,
  min(band_idx) filter (where role = 'VH') as vh from roles group by 1),
c as (select scene_id, n, coalesce(b4, rr) as red, coalesce(b3, gg) as green, coalesce(b2, bb) as blue, nir, coalesce(vv, 1) as v1,
  coalesce(vh, least(2, n)) as v2, vv is not null or vh is not null or (n in (1, 2) and regexp_matches(f, 'sar|sentinel-1|s1|risat|sigma0|backscatter')) as radar from m),
k as (select *, case when red is not null and green is not null and blue is not null then 'true color' when n = 3 then 'standard 3-band'
  when radar then 'radar polarimetric' when red is not null and nir is not null then 'false color nir-red' when red is not null then 'red grey' else 'single channel grey' end as tc,
  case when radar then 'radar polarimetric' when nir is not null and red is not null and green is not null then 'false color infrared'
  when nir is not null and red is not null then 'false color nir-red' when n >= 3 then 'simulated infrared' else 'single channel grey' end as fc from c)"""


def _choices(spark, sf):
    scenes = headers.classify_scenes(v.bands(spark, sf))
    return display.composite_choice(scenes).withColumn("kind", F.lit("tc")).unionByName(
        display.composite_choice(scenes, "false_color_nir").withColumn("kind", F.lit("fc"))
    ).drop("total_bands")


QUERIES["r4_composite_choice"] = _choices
SQL["r4_composite_choice"] = sql(
    "bands",
    f"""with {CHOICE} select scene_id, 'tc' as kind, tc as shows,
      cast(case tc when 'true color' then red when 'radar polarimetric' then v1 when 'false color nir-red' then nir when 'red grey' then red else 1 end as integer) as r,
      cast(case tc when 'true color' then green when 'standard 3-band' then 2 when 'radar polarimetric' then v2 when 'false color nir-red' then red when 'red grey' then red else 1 end as integer) as g,
      cast(case tc when 'true color' then blue when 'standard 3-band' then 3 when 'radar polarimetric' then v1 when 'false color nir-red' then red when 'red grey' then red else 1 end as integer) as b from k
    union all select scene_id, 'fc', fc,
      cast(case fc when 'radar polarimetric' then v1 when 'single channel grey' then 1 when 'simulated infrared' then 3 else nir end as integer),
      cast(case fc when 'radar polarimetric' then v2 when 'single channel grey' then 1 when 'simulated infrared' then 1 else red end as integer),
      cast(case fc when 'radar polarimetric' then v1 when 'single channel grey' then 1 when 'simulated infrared' then 2 when 'false color infrared' then green else red end as integer) from k""",
)


def _px_long_headers(spark, sf):
    return v.px_long(spark, sf).groupBy("scene_id").agg(
        F.max("band").alias("total_bands"), (F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width")
    )


QUERIES["r4_composite"] = lambda spark, sf: display.composite(
    v.px_long(spark, sf), display.custom_choice(_px_long_headers(spark, sf), (4, 1, 9))
)
BYTES = """lim as (select scene_id, band, quantile_cont(value, 0.02) as lo, quantile_cont(value, 0.98) as hi from px_long where value > 0 group by 1, 2),
s as (select p.scene_id, p.band, row, col, case when lo is null then 0 else cast(floor(least(greatest((value - lo) / ((case when hi <= lo then lo + 1 else hi end) - lo), 0e0), 1e0) * 255e0) as integer) end as byte
  from px_long p left join lim on p.scene_id = lim.scene_id and p.band = lim.band)"""
SQL["r4_composite"] = sql(
    "px_long",
    f"""with {BYTES} select scene_id, row, col, max(byte) filter (where band = 4) as r, max(byte) filter (where band = 1) as g,
    max(byte) filter (where band = 4) as b from s group by 1, 2, 3""",
)
QUERIES["s10_preview"] = lambda spark, sf: display.preview(
    display.composite(v.px_long(spark, sf), display.custom_choice(_px_long_headers(spark, sf), (3, 2, 1))),
    _px_long_headers(spark, sf),
    max_size=2,
)
SQL["s10_preview"] = sql(
    "px_long",
    f"""with {BYTES} select scene_id, row // 2 as row, col // 2 as col,
    """
    + ", ".join(f"cast(floor(sum(byte) filter (where band = {k}) / 4e0) as integer) as {c}" for k, c in [(3, "r"), (2, "g"), (1, "b")])
    + " from s group by 1, 2, 3",
)
