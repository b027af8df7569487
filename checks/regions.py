"""Registered queries over masks: window filters, density, components, target regions, grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.pixels import EXG, MASK_SQL
from checks.views import fixed, sfixed, sql
from scenelake.functions import crs
from scenelake.operators import components as cc
from scenelake.operators import morphology as mo
from scenelake.operators import regions as rg

QUERIES: dict = {}
SQL: dict[str, str] = {}
CELL = ["scene_id", "row", "col"]


def steps_sql(source: str, kinds: str, size: int, mask: str, prefix: str = "m") -> str:
    """CTEs of erosions (e) and dilations (d) by self-join on offsets; the last is <prefix><n>."""
    back = size // 2
    out, last = [], source
    for i, kind in enumerate(kinds):
        low, high = (-back, size - 1 - back) if kind == "e" else (-(size - 1 - back), back)
        hits = f"count(*) filter (where n.{mask} = 1)"
        test = f"{hits} = {size * size}" if kind == "e" else f"{hits} > 0"
        name = f"{prefix}{i}"
        out.append(
            f"""{name} as (select c.scene_id, c.row, c.col, cast({test} as integer) as {mask} from {last} c
            left join (select scene_id, row - dy as row, col - dx as col, {mask} from {last}, generate_series({low}, {high}) a(dy), generate_series({low}, {high}) b(dx) where {mask} = 1) n
            on n.scene_id = c.scene_id and n.row = c.row and n.col = c.col group by 1, 2, 3)"""
        )
        last = name
    return ", ".join(out)


def _grid(spark, sf):
    return v.px_grid(spark, sf).select(*CELL, "mask")


for _name, _kinds, _fn in (("opening", "ed", mo.opening), ("closing", "de", mo.closing)):
    for _size in (2, 3, 4):
        QUERIES[f"r1_{_name}_{_size}"] = lambda spark, sf, fn=_fn, size=_size: fn(_grid(spark, sf), size, block=4)
        SQL[f"r1_{_name}_{_size}"] = sql("px_grid", f"with {steps_sql('px_grid', _kinds, _size, 'mask')} select scene_id, row, col, mask from m1")


def _headers8(spark, sf):
    return v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("scene_id"), F.lit(8).alias("height"), F.lit(8).alias("width"))


QUERIES["r2_density"] = lambda spark, sf: mo.density(_grid(spark, sf), _headers8(spark, sf), 5, block=4).select(*CELL, "hits", "density")
REFLECT = "(case when {0} < 0 then -1 - ({0}) when {0} > 7 then 15 - ({0}) else {0} end)"
SQL["r2_density"] = sql(
    "px_grid",
    f"""with o as (select scene_id, row, col, {REFLECT.format('row + dy')} as r, {REFLECT.format('col + dx')} as c from px_grid, generate_series(-2, 2) a(dy), generate_series(-2, 2) b(dx))
    select o.scene_id, o.row, o.col, cast(sum(p.mask) as bigint) as hits, cast(sum(p.mask) as bigint) / 25e0 as density from o join px_grid p on p.scene_id = o.scene_id and p.row = o.r and p.col = o.c group by 1, 2, 3""",
)
QUERIES["w10_window_frames"] = lambda spark, sf: mo.window_fold(
    mo.window_fold(v.px_grid(spark, sf), "mask", -1, 2, "total", "sum", 4), "v", -2, 0, "peak", "max", 4
).select(*CELL, "total", "peak")
SQL["w10_window_frames"] = sql(
    "px_grid",
    """with s as (select a.scene_id, a.row, a.col, sum(b.mask) as t from px_grid a join px_grid b on a.scene_id = b.scene_id and b.row - a.row between -1 and 2 and b.col - a.col between -1 and 2 group by 1, 2, 3),
    m as (select a.scene_id, a.row, a.col, max(b.v) as peak from px_grid a join px_grid b on a.scene_id = b.scene_id and b.row - a.row between -2 and 0 and b.col - a.col between -2 and 0 group by 1, 2, 3)
    select s.scene_id, s.row, s.col, cast(t as bigint) as total, peak from s join m using (scene_id, row, col)""",
)


def label_sql(source: str, rounds: int) -> str:
    """Recursive CTE: smallest pixel number reachable, spread one step per round."""
    return f"""cells as (select scene_id, row, col, row * 4294967296 + col as id from {source} where mask = 1),
    nb as (select a.scene_id, a.id as dst, b.id as src from cells a join cells b on a.scene_id = b.scene_id and abs(a.row - b.row) + abs(a.col - b.col) <= 1),
    spread(scene_id, id, label, round) as (select scene_id, id, id, 0 from cells
      union all select nb.scene_id, nb.dst, min(s.label), any_value(s.round) + 1 from spread s join nb on s.scene_id = nb.scene_id and s.id = nb.src where s.round < {rounds} group by nb.scene_id, nb.dst),
    labelled as (select scene_id, id // 4294967296 as row, id % 4294967296 as col, label from spread where round = {rounds})"""


QUERIES["r3_components"] = lambda spark, sf: cc.components(_grid(spark, sf), block=4)
SQL["r3_components"] = sql("px_grid", f"with recursive {label_sql('px_grid', 40)} select scene_id, row, col, label from labelled")

QUERIES["w5_top_regions"] = lambda spark, sf: (
    rg.top_k(cc.component_sizes(cc.label_runs(_grid(spark, sf))), ["scene_id"], [F.col("pixels").desc(), F.col("label")], 3)
    .select("scene_id", "label", F.col("rank").cast("bigint").alias("rank"), "pixels", "row_min", "row_max", "col_min", "col_max")
)
SQL["w5_top_regions"] = sql(
    "px_grid",
    f"""with recursive {label_sql('px_grid', 40)}, s as (select scene_id, label, count(*) as pixels, min(row) as row_min, max(row) as row_max, min(col) as col_min, max(col) as col_max from labelled group by 1, 2)
    select *, row_number() over (partition by scene_id order by pixels desc, label) as rank from s qualify rank <= 3""",
)


def headers24(spark, sf):
    i = F.col("vec_id")
    return v.table(spark, sf, "embeddings").select(
        i.alias("scene_id"), F.lit(24).alias("height"), F.lit(24).alias("width"), F.lit(10.0).alias("a"), (i * 100.0 + 400000.0).alias("c"),
        F.lit(-10.0).alias("e"), (i * 50.0 + 1200000.0).alias("f"), F.lit(32644).alias("epsg"),
    )


SCORES = {
    "trees": ("sum(exg) + 10e0 * count(*)", 25, 0.5, True),
    "sports": ("count(*) + 25e0 * count(*) filter (where track)", 20, 0.8, True),
    "water": ("cast(count(*) as double)", 20, 0.5, False),
    "urban": ("cast(count(*) as double)", 40, 0.5, False),
}
REFLECT24 = "(case when {0} < 0 then -1 - ({0}) when {0} > 23 then 47 - ({0}) else {0} end)"
URBAN_SEED = f"""roofs as (select scene_id, row, col, cast(({MASK_SQL['urban']}) as integer) as roof from px_rgb),
 around as (select scene_id, row, col, {REFLECT24.format('row + dy')} as r, {REFLECT24.format('col + dx')} as c from roofs, generate_series(-2, 2) a(dy), generate_series(-2, 2) b(dx)),
 dens as (select o.scene_id, o.row, o.col, cast(sum(p.roof) as bigint) / 25e0 as density from around o join roofs p on p.scene_id = o.scene_id and p.row = o.r and p.col = o.c group by 1, 2, 3),
 thr as (select scene_id, quantile_cont(density, 0.8) as t from dens where density > 0 group by 1),
 seed as (select d.scene_id, row, col, cast(density >= coalesce(t, 0.05e0) as integer) as mask from dens d left join thr on d.scene_id = thr.scene_id)"""


def regions_sql(feature: str, kinds: str, size: int, k: int = 3, rounds: int = 120) -> str:
    score, least, pad, min_side = SCORES[feature]
    low = "greatest(0e0, {0} / 24e0 * 100e0 - %se0)" % pad
    high = "least(100e0, {0} / 24e0 * 100e0 + %se0)" % pad
    fallback = ""
    if feature == "sports":
        fallback = f"u as (select * replace (case when max(pixels) over (partition by scene_id) < {least} then pixels else score end as score) from s qualify pixels >= {least} or max(pixels) over (partition by scene_id) < {least}),"
    seed = f"seed as (select scene_id, row, col, cast(({MASK_SQL[feature]}) as integer) as mask from px_rgb)"
    if feature == "urban":
        seed = URBAN_SEED
    side = "where ymax - ymin > 1.5e0 and xmax - xmin > 1.5e0" if min_side else ""
    track = "r > 165 and r > g + 40 and r > b + 70"
    return f"""with recursive {seed}, {steps_sql('seed', kinds, size, 'mask')}, {label_sql('m1', rounds)},
    j as (select l.*, {EXG} as exg, {track} as track from labelled l join px_rgb p on l.scene_id = p.scene_id and l.row = p.row and l.col = p.col),
    s as (select scene_id, label, count(*) as pixels, {score} as score, quantile_cont(row, 0.01) as r0, quantile_cont(row, 0.99) as r1, quantile_cont(col, 0.01) as c0, quantile_cont(col, 0.99) as c1
      from j group by 1, 2{f' having count(*) >= {least}' if feature != 'sports' else ''}),
    {fallback}
    r as (select *, row_number() over (partition by scene_id order by score desc, label) as rank from {'u' if feature == 'sports' else 's'} qualify rank <= {k}),
    b as (select scene_id, rank, pixels, {low.format('r0')} as ymin, {low.format('c0')} as xmin, {high.format('r1')} as ymax, {high.format('c1')} as xmax from r),
    boxes as (select * from b {side})"""


FIELDS = ("ymin", "xmin", "ymax", "xmax")
for _feature, _kinds, _size in (("trees", "ed", 2), ("sports", "de", 3), ("water", "de", 2), ("urban", "ed", 2)):
    QUERIES[f"r6_regions_{_feature}"] = lambda spark, sf, feature=_feature: rg.target_regions(
        v.px_rgb(spark, sf), headers24(spark, sf), feature, digits=None
    ).select("scene_id", "rank", "pixels", *[fixed(c).alias(c) for c in FIELDS])
    SQL[f"r6_regions_{_feature}"] = sql(
        "px_rgb", regions_sql(_feature, _kinds, _size) + " select scene_id, rank, pixels, " + ", ".join(f"{sfixed(c)} as {c}" for c in FIELDS) + " from boxes"
    )
QUERIES["r6_scene_overview"] = lambda spark, sf: rg.scene_overview(v.px_rgb(spark, sf), headers24(spark, sf), digits=None).select(
    "scene_id", "label", *[fixed(c).alias(c) for c in FIELDS]
)


def _overview_sql() -> str:
    """The four region twins with one box each; every CTE gets the name of its target."""
    import re

    parts, labels = [], {"trees": "Dense Tree Canopy", "urban": "Built-Up Structures", "sports": "Open Ground / Facility", "water": "Hydrological Surface"}
    for feature, kinds, size in (("trees", "ed", 2), ("sports", "de", 3), ("water", "de", 2), ("urban", "ed", 2)):
        text = regions_sql(feature, kinds, size, 1).removeprefix("with recursive ")
        for cte in ("roofs", "around", "dens", "thr", "seed", "m0", "m1", "cells", "nb", "spread", "labelled", "boxes"):
            text = re.sub(rf"\b{cte}\b", f"{feature}_{cte}", text)
        for cte in ("j", "s", "u", "r", "b"):
            text = re.sub(rf"(?<![\w.'])({cte}) as \(", rf"{feature}_\1 as (", text)
            text = re.sub(rf"\b(from|join) {cte}\b(?!\w)(?! on)", rf"\1 {feature}_{cte}", text)
        parts.append((feature, text))
    picks = [f"select scene_id, '{labels[f]}' as label, {', '.join(f'{sfixed(c)} as {c}' for c in FIELDS)} from {f}_boxes" for f, _ in parts]
    return "with recursive " + ", ".join(t for _, t in parts) + " " + " union all ".join(picks)


SQL["r6_scene_overview"] = sql("px_rgb", _overview_sql())


def _grounded(spark, sf):
    h = headers24(spark, sf)
    return rg.ground(rg.target_regions(v.px_rgb(spark, sf), h, "water", 2, digits=None), h, "water").select(
        "scene_id", "rank", "label", fixed("confidence", 4).alias("confidence"), fixed("area_ha", 4).alias("area_ha"),
        fixed("min_lon", 2).alias("min_lon"), fixed("max_lat", 2).alias("max_lat"),
    )


QUERIES["r7_grounding"] = _grounded


def inverse_utm_sql(x: str, y: str, zone_meridian: float) -> tuple[str, str]:
    """lon, lat of northern UTM metres, written out from the published series."""
    xi, eta = f"(({y}) / {0.9996 * crs._RADIUS!r})", f"((({x}) - 500000e0) / {0.9996 * crs._RADIUS!r})"
    xi0 = xi + "".join(f" - {b!r} * sin({2 * j}e0 * {xi}) * cosh({2 * j}e0 * {eta})" for j, b in enumerate(crs._BETA, 1))
    eta0 = eta + "".join(f" - {b!r} * cos({2 * j}e0 * {xi}) * sinh({2 * j}e0 * {eta})" for j, b in enumerate(crs._BETA, 1))
    chi = f"asin(sin({xi0}) / cosh({eta0}))"
    lat = chi + "".join(f" + {d!r} * sin({2 * j}e0 * {chi})" for j, d in enumerate(crs._DELTA, 1))
    return f"({zone_meridian}e0 + degrees(atan2(sinh({eta0}), cos({xi0}))))", f"degrees({lat})"


_LON, _LAT = inverse_utm_sql("x", "y", 81.0)
SQL["r7_grounding"] = sql(
    "px_rgb",
    regions_sql("water", "de", 2, 2)
    + f""", px as (select *, floor(ymin / 100e0 * 24) as y0, floor(xmin / 100e0 * 24) as x0, floor(ymax / 100e0 * 24) as y1, floor(xmax / 100e0 * 24) as x1 from boxes),
    corner as (select scene_id, rank, greatest(1, (y1 - y0) * (x1 - x0)) * 100e0 / 1e4 as ha, unnest([x0, x1, x1, x0]) as cx, unnest([y0, y0, y1, y1]) as cy from px),
    at as materialized (select scene_id, rank, ha, 10e0 * (cx + 0.5e0) + scene_id * 100e0 + 400000e0 as x, -10e0 * (cy + 0.5e0) + scene_id * 50e0 + 1200000e0 as y from corner)
    select scene_id, rank, 'Water Body / Hydrological Basin #' || rank as label, {sfixed('0.93e0 - rank * 0.02e0', 4)} as confidence, {sfixed('any_value(ha)', 4)} as area_ha,
      {sfixed(f'min({_LON})', 2)} as min_lon, {sfixed(f'max({_LAT})', 2)} as max_lat from at group by 1, 2""".replace("at as materialized", "spot as materialized").replace("from at group", "from spot group"),
)


def _radar_grounding(spark, sf):
    from scenelake.operators.display import radar_to_db

    h = v.px_sar(spark, sf).groupBy("scene_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    return rg.radar_regions(radar_to_db(v.px_sar(spark, sf)), h, "rough", digits=None).select("scene_id", "rank", "pixels", *[fixed(c).alias(c) for c in FIELDS])


QUERIES["r7_radar_grounding"] = _radar_grounding
SQL["r7_radar_grounding"] = sql(
    "px_sar",
    f"""with recursive db as (select scene_id, row, col, log10(greatest(vv, 1e-7)) * 10e0 as vv from px_sar), seed as (select scene_id, row, col, cast(vv >= -14e0 and vv < -7e0 as integer) as mask from db),
    {label_sql('seed', 400)}, h as (select scene_id, max(row) + 1 as h, max(col) + 1 as w from px_sar group by 1),
    s as (select scene_id, label, count(*) as pixels, quantile_cont(row, 0.01) as r0, quantile_cont(row, 0.99) as r1, quantile_cont(col, 0.01) as c0, quantile_cont(col, 0.99) as c1 from labelled group by 1, 2 having count(*) >= 20),
    r as (select s.*, h, w, row_number() over (partition by s.scene_id order by pixels desc, label) as rank from s join h on s.scene_id = h.scene_id qualify rank <= 3)
    select scene_id, rank, pixels, {sfixed('greatest(0e0, r0 / h * 100e0 - 0.5e0)')} as ymin, {sfixed('greatest(0e0, c0 / w * 100e0 - 0.5e0)')} as xmin,
      {sfixed('least(100e0, r1 / h * 100e0 + 0.5e0)')} as ymax, {sfixed('least(100e0, c1 / w * 100e0 + 0.5e0)')} as xmax from r""",
)
