"""Registered queries over geometry: areas, rings, crops, tiles, resampling, footprints, CRS."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.views import fixed, sfixed, sql
from scenelake.functions import crs
from scenelake.functions import geometry as geo
from scenelake.operators import cover, overlap, raster

QUERIES: dict = {}
SQL: dict[str, str] = {}


def rings(spark, sf):
    """Footprints as skewed 4-vertex rings, open (the first vertex is not repeated)."""
    f = v.footprints(spark, sf)
    x, y, w = F.col("x0"), F.col("y0"), F.col("w")
    return f.select(
        "id", F.array(geo.point(x, y), geo.point(x + w, y + w * 0.25), geo.point(x + w, y + w), geo.point(x - w * 0.5, y + w)).alias("ring")
    )


VERTICES = """vert as (select id, x0 as lon, y0 as lat, 1 as ord from footprints union all select id, x0 + w, y0 + w * 0.25e0, 2 from footprints
 union all select id, x0 + w, y0 + w, 3 from footprints union all select id, x0 - w * 0.5e0, y0 + w, 4 from footprints)"""

QUERIES["a14_polygon_area"] = lambda spark, sf: rings(spark, sf).select("id", fixed(geo.polygon_area_km2("ring"), 3).alias("area"))
SQL["a14_polygon_area"] = sql(
    "footprints",
    f"""with {VERTICES}, e as (select id, ord, lon, lat, coalesce(lead(lon) over w, first_value(lon) over w) as lon2, coalesce(lead(lat) over w, first_value(lat) over w) as lat2
     from vert window w as (partition by id order by ord))
    select id, {sfixed('abs(sum((radians(lon2) - radians(lon)) * (sin(radians(lat)) + sin(radians(lat2)) + 2e0)) * (6371e0 * 6371e0 / 2e0))', 3)} as area from e group by 1""",
)
QUERIES["a15_ring_bbox"] = lambda spark, sf: rings(spark, sf).select("id", *[c.alias(n) for n, c in geo.ring_bbox("ring").items()])
SQL["a15_ring_bbox"] = sql(
    "footprints", f"with {VERTICES} select id, min(lon) as min_lon, min(lat) as min_lat, max(lon) as max_lon, max(lat) as max_lat from vert group by 1"
)
QUERIES["f22_ring_arrays"] = lambda spark, sf: rings(spark, sf).select(
    "id",
    F.size(geo.closed_ring("ring")).alias("closed_size"),
    F.size(F.filter("ring", lambda p: p["lon"] > 0)).alias("east"),
    F.array_contains(F.transform("ring", lambda p: p["lat"] > 0), True).alias("any_north"),
)
SQL["f22_ring_arrays"] = sql(
    "footprints",
    f"with {VERTICES} select id, 5 as closed_size, cast(count(*) filter (where lon > 0) as integer) as east, bool_or(lat > 0) as any_north from vert group by 1",
)


# --- affine headers of the 8x8 grids
def grid_headers(spark, sf):
    i = F.col("vec_id")
    return v.table(spark, sf, "embeddings").select(
        i.alias("scene_id"), F.lit(2.0).alias("a"), F.lit(0.0).alias("b"), (i % 7).cast("double").alias("c"), F.lit(0.0).alias("d"),
        F.lit(-2.0).alias("e"), ((i % 5) * 3 + 16).cast("double").alias("f"), F.lit(8).alias("width"), F.lit(8).alias("height"),
        F.lit(4326).alias("epsg"),
    )


HDR = "hdr as (select vec_id as scene_id, 2e0 as a, cast(vec_id % 7 as double) as c, -2e0 as e, cast(vec_id % 5 * 3 + 16 as double) as f from embeddings)"


def _affine(spark, sf):
    px = v.px_grid(spark, sf).join(grid_headers(spark, sf), "scene_id")
    x, y = geo.pixel_to_geo("row", "col")
    placed = px.select("scene_id", "row", "col", "a", "c", "e", "f", x.alias("x"), y.alias("y"))
    r, c = geo.geo_to_pixel("x", "y")
    return placed.select("scene_id", "row", "col", "x", "y", r.alias("fr"), c.alias("fc"))


QUERIES["f10_affine"] = _affine
SQL["f10_affine"] = sql(
    "px_grid",
    f"""with {HDR} select p.scene_id, row, col, a * (col + 0.5e0) + c as x, e * (row + 0.5e0) + f as y, row + 0.5e0 as fr, col + 0.5e0 as fc
    from px_grid p join hdr on p.scene_id = hdr.scene_id""",
)


def _crop_areas(spark, sf):
    i = F.col("vec_id")
    x, y = (i % 7 + 2.2), (i % 5 * 3 + 3.3)
    return v.table(spark, sf, "embeddings").select(
        i.alias("scene_id"),
        F.array(geo.point(x, y), geo.point(x + 11.6, y + 1.4), geo.point(x + 6.1, y + 5.2), geo.point(x + 4.4, y + 10.9)).alias("ring"),
    )


QUERIES["p5_crop_polygon"] = lambda spark, sf: raster.crop(
    v.px_grid(spark, sf).drop("mask"), grid_headers(spark, sf), _crop_areas(spark, sf), envelope=False
).pixels
SQL["p5_crop_polygon"] = sql(
    "px_grid",
    f"""with {HDR}, vert as (select vec_id as scene_id, unnest([[0e0, 0e0], [11.6e0, 1.4e0], [6.1e0, 5.2e0], [4.4e0, 10.9e0]]) as p,
      unnest([[11.6e0, 1.4e0], [6.1e0, 5.2e0], [4.4e0, 10.9e0], [0e0, 0e0]]) as q, vec_id % 7 + 2.2e0 as ox, vec_id % 5 * 3 + 3.3e0 as oy from embeddings),
    pt as (select p.*, a * (col + 0.5e0) + c as x, e * (row + 0.5e0) + f as y from px_grid p join hdr on p.scene_id = hdr.scene_id),
    hits as (select pt.scene_id, row, col, v, count(*) filter (where (oy + p[2] > y) <> (oy + q[2] > y)
       and x < ox + p[1] + (y - oy - p[2]) / (q[2] - p[2]) * (q[1] - p[1])) as n
      from pt join vert on pt.scene_id = vert.scene_id group by 1, 2, 3, 4)
    select scene_id, row, col, v from hits where n % 2 = 1""",
)


# The same polygons by a cover of cells: blocks of 4 pixels, cut down to 2.
QUERIES["p5_crop_cells"] = lambda spark, sf: cover.crop_by_cover(
    v.px_grid(spark, sf).drop("mask"), grid_headers(spark, sf), _crop_areas(spark, sf), envelope=False, block=4, leaf=2
).pixels
SQL["p5_crop_cells"] = SQL["p5_crop_polygon"]


def _geojson_areas(spark, sf, kind: str, boxes):
    """Areas written as GeoJSON: one ring per box, as parts or as an outer ring with a hole."""
    i = F.col("vec_id")
    x, y = (i % 7 + 2.2), (i % 5 * 3 + 3.3)

    def ring(x0, y0, x1, y1):
        corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
        return F.concat(F.lit("["), F.concat_ws(",", *[F.concat(F.lit("["), x + a, F.lit(","), y + b, F.lit("]")) for a, b in corners]), F.lit("]"))

    rings = [ring(*b) for b in boxes]
    parts = [F.concat(F.lit("["), r, F.lit("]")) for r in rings] if kind == "MultiPolygon" else rings
    text = F.concat(F.lit(f'{{"type":"{kind}","coordinates":['), F.concat_ws(",", *parts), F.lit("]}"))
    return v.table(spark, sf, "embeddings").select(i.alias("scene_id"), raster.geojson_rings(text).alias("rings"))


def _in_boxes(boxes, join: str) -> str:
    def inside(b):
        return f"(x > ox + {b[0]}e0 and x < ox + {b[2]}e0 and y > oy + {b[1]}e0 and y < oy + {b[3]}e0)"

    return f" {join} ".join(inside(b) for b in boxes)


PART_BOXES = [(0.1, 0.1, 5.2, 5.3), (8.1, 1.2, 11.3, 9.4)]
HOLE_BOXES = [(0.1, 0.1, 12.2, 11.3), (3.1, 3.2, 7.3, 8.4)]
for _name, _kind, _boxes, _join in (("multi", "MultiPolygon", PART_BOXES, "or"), ("hole", "Polygon", HOLE_BOXES, "and not")):
    QUERIES[f"p5_crop_{_name}"] = lambda spark, sf, kind=_kind, boxes=_boxes: raster.crop(
        v.px_grid(spark, sf).drop("mask"), grid_headers(spark, sf), _geojson_areas(spark, sf, kind, boxes), envelope=False
    ).pixels
    SQL[f"p5_crop_{_name}"] = sql(
        "px_grid",
        f"""with {HDR}, pt as (select p.*, a * (col + 0.5e0) + c as x, e * (row + 0.5e0) + f as y, hdr.scene_id % 7 + 2.2e0 as ox, hdr.scene_id % 5 * 3 + 3.3e0 as oy
          from px_grid p join hdr on p.scene_id = hdr.scene_id)
        select scene_id, row, col, v from pt where {_in_boxes(_boxes, _join)}""",
    )
QUERIES["p5_crop_box"] = lambda spark, sf: raster.crop(
    v.px_grid(spark, sf).drop("mask"), grid_headers(spark, sf), [3.3, 4.2, 12.4, 17.6]
).pixels
BOXED = f"""{HDR}, w as (select *, greatest(floor((3.3e0 - c) / a), 0) as col0, greatest(floor((17.6e0 - f) / e), 0) as row0,
  least(ceil((12.4e0 - c) / a), 8) as col1, least(ceil((4.2e0 - f) / e), 8) as row1 from hdr)"""
SQL["p5_crop_box"] = sql(
    "px_grid",
    f"""with {BOXED} select p.scene_id, cast(row - row0 as bigint) as row, cast(col - col0 as bigint) as col, v from px_grid p join w on p.scene_id = w.scene_id
    where a * (col + 0.5e0) + c between 3.3e0 and 12.4e0 and e * (row + 0.5e0) + f between 4.2e0 and 17.6e0""",
)
QUERIES["p5_crop_header"] = lambda spark, sf: raster.crop(
    v.px_grid(spark, sf), grid_headers(spark, sf), [3.3, 4.2, 12.4, 17.6]
).headers.select("scene_id", "c", "f", "width", "height")
SQL["p5_crop_header"] = sql(
    "px_grid",
    f"""with {BOXED} select scene_id, c + a * col0 as c, f + e * row0 as f, cast(col1 - col0 as bigint) as width, cast(row1 - row0 as bigint) as height from w""",
)

# --- tiles
TILES = f"""{HDR}, tiles as (select hdr.*, r as row_index, k as col_index, r * 3 as row_off, k * 3 as col_off, least(4, 8 - r * 3) as h, least(4, 8 - k * 3) as w,
  printf('tile_%04d', r * 3 + k) as tile_id from hdr cross join generate_series(0, 2) t(r) cross join generate_series(0, 2) u(k))"""
QUERIES["r5_tile_manifest"] = lambda spark, sf: raster.tile_manifest(grid_headers(spark, sf), 4, 1).drop("a", "e", "epsg", "tile_id")
SQL["r5_tile_manifest"] = sql(
    "px_grid",
    f"""with {TILES} select scene_id, row_index, col_index, row_off, col_off, cast(w as integer) as tile_width, cast(h as integer) as tile_height,
    c + a * col_off as c, f + e * row_off as f, c + a * col_off as left, f + e * row_off + e * h as bottom,
    c + a * col_off + a * w as right, f + e * row_off as top from tiles""",
)
QUERIES["w6_tile_numbers"] = lambda spark, sf: raster.tile_manifest(grid_headers(spark, sf), 4, 1).select("scene_id", "tile_id", "row_off", "col_off")
SQL["w6_tile_numbers"] = sql(
    "px_grid",
    f"""with {TILES} select scene_id, 'tile_' || lpad(cast(row_number() over (partition by scene_id order by row_off, col_off) - 1 as varchar), 4, '0') as tile_id, row_off, col_off from tiles""",
)
QUERIES["j7_assign_tiles"] = lambda spark, sf: raster.assign_tiles(v.px_grid(spark, sf), 4, 1).select("scene_id", "row", "col", "row_index", "col_index")
SQL["j7_assign_tiles"] = sql(
    "px_grid",
    f"""with {TILES} select p.scene_id, row, col, row_index, col_index from px_grid p join tiles t on p.scene_id = t.scene_id
    and row >= row_off and row < row_off + h and col >= col_off and col < col_off + w""",
)


def _tile_boxes(spark, sf):
    i = F.col("vec_id")
    boxes = v.table(spark, sf, "embeddings").select(
        i.alias("scene_id"), F.format_string("tile_%04d", i % 9).alias("tile_id"), (i % 50).cast("double").alias("ymin"),
        (i % 37).cast("double").alias("xmin"), (i % 50 + 25).cast("double").alias("ymax"), (i % 37 + 50).cast("double").alias("xmax"),
    )
    return raster.tile_boxes_to_geo(boxes, raster.tile_manifest(grid_headers(spark, sf), 4, 1))


QUERIES["j8_tile_boxes"] = lambda spark, sf: _tile_boxes(spark, sf).select(
    "scene_id", "tile_id", *[fixed(c, 4).alias(c) for c in ("px_ymax", "px_xmin", "geo_min_x", "geo_max_y")]
)
SQL["j8_tile_boxes"] = sql(
    "px_grid",
    f"""with {TILES} select scene_id, tile_id, {sfixed('round(row_off + (scene_id % 50 + 25) / 100e0 * h, 1)', 4)} as px_ymax, {sfixed('round(col_off + (scene_id % 37) / 100e0 * w, 1)', 4)} as px_xmin,
    {sfixed('c + a * col_off + a * ((scene_id % 37) / 100e0 * w)', 4)} as geo_min_x, {sfixed('f + e * row_off + e * ((scene_id % 50) / 100e0 * h)', 4)} as geo_max_y
    from tiles where tile_id = printf('tile_%04d', scene_id % 9)""",
)


# --- resampling and stacking
def _resample(spark, sf):
    wide = raster.stack_bands(v.px_long(spark, sf).withColumn("band", F.format_string("k%d", "band")), ["k1", "k2", "k3", "k4"])
    scenes = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("scene_id"))
    src = scenes.select("scene_id", F.lit(20.0).alias("a"), F.lit(100.0).alias("c"), F.lit(-20.0).alias("e"), F.lit(200.0).alias("f"), F.lit(4).alias("width"), F.lit(4).alias("height"))
    ref = scenes.select("scene_id", F.lit(10.0).alias("a"), F.lit(100.0).alias("c"), F.lit(-10.0).alias("e"), F.lit(200.0).alias("f"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    return raster.resample(wide, src, ref, ["k1", "k3"]).select("scene_id", "row", "col", fixed("k1").alias("k1"), fixed("k3").alias("k3"))


QUERIES["j6_resample"] = _resample
SQL["j6_resample"] = sql(
    "px_long",
    f"""with g as (select vec_id as scene_id, r as row, k as col, (r + 0.5e0) * 0.5e0 - 0.5e0 as sr, (k + 0.5e0) * 0.5e0 - 0.5e0 as sc
      from embeddings cross join generate_series(0, 7) t(r) cross join generate_series(0, 7) u(k)),
    w as (select g.scene_id, g.row, g.col, p.band, p.value, greatest(1e0 - abs(sr - p.row), 0e0) * greatest(1e0 - abs(sc - p.col), 0e0) as w
      from g join px_long p on g.scene_id = p.scene_id and abs(sr - p.row) < 1 and abs(sc - p.col) < 1)
    select scene_id, row, col, {sfixed('sum(w * value) filter (where band = 1) / sum(w) filter (where band = 1)')} as k1,
      {sfixed('sum(w * value) filter (where band = 3) / sum(w) filter (where band = 3)')} as k3 from w group by 1, 2, 3""",
)
QUERIES["s5_stack_bands"] = lambda spark, sf: raster.stack_bands(
    v.px_long(spark, sf).withColumn("band", F.element_at(F.array(*[F.lit(b) for b in ("B08", "VV", "B02", "Extra")]), F.col("band"))),
    ["VV", "Extra", "B08", "B02"],
)
SQL["s5_stack_bands"] = sql(
    "px_long",
    """select scene_id, row, col, max(value) filter (where band = 3) as B02, max(value) filter (where band = 1) as B08,
    max(value) filter (where band = 2) as VV, max(value) filter (where band = 4) as Extra from px_long group by 1, 2, 3""",
)
def _stack_summary(spark, sf):
    heads = v.bands(spark, sf).select(
        "scene_id", F.element_at(F.array(*[F.lit(b) for b in ("B04", "B11", "B02", "VV", "zz", "aa", "B03", "B08", "VH", "B12", "HH", "HV")]), F.col("band_idx")).alias("band"),
        F.when(F.col("scene_id") % 2 == 0, "uint16").otherwise("float32").alias("dtype"), F.col("total_bands").alias("width"), F.lit(7).alias("height"),
    )
    return raster.stack_summary(heads).select("scene_id", "bands_count", F.concat_ws(",", "band_descriptions").alias("names"), "dtype", "width")


QUERIES["s5_stack_summary"] = _stack_summary
SQL["s5_stack_summary"] = sql(
    "bands",
    """with h as (select scene_id, total_bands, ['B04','B11','B02','VV','zz','aa','B03','B08','VH','B12','HH','HV'][band_idx] as band from bands),
    o as (select *, coalesce(nullif(list_position(['B02','B03','B04','B08','B11','B12','VV','VH'], band), 0), 9) as p from h)
    select scene_id, cast(count(*) as integer) as bands_count, string_agg(band, ',' order by p, band) as names,
      case when scene_id % 2 = 0 then 'uint16' else 'float32' end as dtype, any_value(total_bands) as width from o group by scene_id""",
)


# --- footprints
def footprint_boxes(spark, sf):
    return v.footprints(spark, sf).select("id", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("w")).alias("y1"), "w", "grp")


BOXES = "bx as (select id, x0, y0, x0 + w as x1, y0 + w as y1, w, grp from footprints)"
MEET = "a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1"
SHARED = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0e0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0e0)"


def size_sql(s: str) -> str:
    return f"(({s}.x1 - {s}.x0) * ({s}.y1 - {s}.y0))"


def _requested(spark, sf):
    """Footprints with the request that wants pairs of them."""
    return footprint_boxes(spark, sf).withColumn("request", F.col("grp") % 5)


QUERIES["j3_footprint_pairs"] = lambda spark, sf: overlap.overlap_join(
    _requested(spark, sf), _requested(spark, sf), "id", "id", on=["request"]
).filter("id_a < id_b").select("id_a", "id_b", "shared", "overlap_pct")
SQL["j3_footprint_pairs"] = sql(
    "footprints",
    f"""with {BOXES} select a.id as id_a, b.id as id_b, {SHARED} as shared, {SHARED} * 100e0 / least({size_sql('a')}, {size_sql('b')}) as overlap_pct
    from bx a join bx b on a.id < b.id and a.grp % 5 = b.grp % 5 and {MEET}""",
)


def _scene_boxes(spark, sf):
    return v.catalog(spark, sf).select("ord", "x0", "y0", (F.col("x0") + F.col("w") * 2).alias("x1"), (F.col("y0") + F.col("w") * 2).alias("y1"))


QUERIES["j4_scene_aoi_overlap"] = lambda spark, sf: overlap.scene_aoi_overlap(_scene_boxes(spark, sf), footprint_boxes(spark, sf), "ord", "id", cell=2.0)
SQL["j4_scene_aoi_overlap"] = sql(
    "catalog footprints",
    f"""with {BOXES}, sc as (select ord as id, x0, y0, x0 + w * 2 as x1, y0 + w * 2 as y1 from catalog)
    select a.id as scene_id, b.id as aoi_id, {SHARED} * 100e0 / {size_sql('b')} as overlap_pct from sc a join bx b on {MEET}""",
)


def _pair_headers(spark, sf):
    i = F.col("id")
    return v.footprints(spark, sf).select(
        i.alias("scene_id"), F.when(i % 11 != 0, F.format_string("EPSG:%d", (i % 3 + 32643))).alias("crs"), "x0", "y0",
        (F.col("x0") + F.col("w") * 4).alias("x1"), (F.col("y0") + F.col("w") * 4).alias("y1"), (i % 2 + 10).alias("width"), F.lit(9).alias("height"),
        F.element_at(F.array(F.lit("SAR"), F.lit("Optical"), F.lit("Multispectral")), (i % 3 + 1).cast("int")).alias("modality"),
        (F.lit(10.0) + (i % 5) * 0.5).alias("res"),
    )


def _neighbours(spark, sf):
    f = v.footprints(spark, sf)
    near = f.select(F.col("id").alias("id_a"), F.explode(F.array(F.col("id") + 1, F.col("id") + 3)).alias("id_b"))
    return near.join(f.select(F.col("id").alias("id_b")), "id_b", "left_semi").select("id_a", "id_b")


PAIRS = """h as (select id as scene_id, case when id % 11 <> 0 then 'EPSG:' || (id % 3 + 32643) end as crs, x0, y0, x0 + w * 4 as x1, y0 + w * 4 as y1, id % 2 + 10 as width,
  ['SAR','Optical','Multispectral'][id % 3 + 1] as modality, 10e0 + id % 5 * 0.5e0 as res from footprints),
p as (select a.scene_id as id_a, b.scene_id as id_b, a.crs as crs_a, b.crs as crs_b, a.res as res_a, b.res as res_b, a.x0 as ax0, a.y0 as ay0, a.x1 as ax1, a.y1 as ay1,
  b.x0 as bx0, b.y0 as by0, b.x1 as bx1, b.y1 as by1, a.width as wa, b.width as wb, a.modality as ma, b.modality as mb
  from h a join h b on b.scene_id in (a.scene_id + 1, a.scene_id + 3))"""
QUERIES["j3_validate_pairs"] = lambda spark, sf: overlap.validate_pairs(_pair_headers(spark, sf), _neighbours(spark, sf)).select(
    "id_a", "id_b", "is_compatible", "pair_type", "crs_compatible", fixed("overlap_percentage").alias("overlap"), "dimensions_match",
    "is_bitemporal_pair", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"),
)
SQL["j3_validate_pairs"] = sql(
    "footprints",
    f"""with {PAIRS}, q as (select *, ax0 <= bx1 and bx0 <= ax1 and ay0 <= by1 and by0 <= ay1 as meets, coalesce(crs_a = crs_b, false) as cc from p)
    select id_a, id_b, meets as is_compatible, case when (ma = 'SAR') <> (mb = 'SAR') then 'Cross-Modal (Optical + SAR)' else 'Bi-Temporal / Multi-Date' end as pair_type,
    cc as crs_compatible, {sfixed('case when meets then greatest(least(ax1, bx1) - greatest(ax0, bx0), 0e0) * greatest(least(ay1, by1) - greatest(ay0, by0), 0e0) * 100e0 / least((ax1 - ax0) * (ay1 - ay0), (bx1 - bx0) * (by1 - by0)) else 0e0 end')} as overlap,
    wa = wb as dimensions_match, ma = mb as is_bitemporal_pair, cast(not meets as integer) as n_errors, cast(not cc as integer) + cast(wa <> wb as integer) as n_warnings from q""",
)
QUERIES["f18_alignment_rating"] = lambda spark, sf: overlap.alignment_rating(_pair_headers(spark, sf), _neighbours(spark, sf)).select(
    "id_a", "id_b", fixed("resolution_ratio").alias("ratio"), fixed("bounds_delta").alias("delta"), "alignment_rating", "crs_match"
)
SQL["f18_alignment_rating"] = sql(
    "footprints",
    f"""with {PAIRS}, q as (select *, greatest(res_a, res_b) / least(res_a, res_b) as ratio, abs(ax0 - bx0) + abs(ay0 - by0) + abs(ax1 - bx1) + abs(ay1 - by1) as delta from p)
    select id_a, id_b, {sfixed('ratio')} as ratio, {sfixed('delta')} as delta, case when ratio <= 1.0105e0 and delta < 0.00095e0 then 'PERFECT_PIXEL_MATCH' when ratio <= 1.2005e0 then 'NEAR_COREGISTERED'
    else 'REQUIRES_RESAMPLING' end as alignment_rating, crs_a is not distinct from crs_b as crs_match from q""",
)
QUERIES["f25_crs_message"] = lambda spark, sf: (
    _neighbours(spark, sf)
    .join(_pair_headers(spark, sf).select(F.col("scene_id").alias("id_a"), F.col("crs").alias("crs_a")), "id_a")
    .join(_pair_headers(spark, sf).select(F.col("scene_id").alias("id_b"), F.lower("crs").alias("crs_b")), "id_b")
    .select("id_a", "id_b", crs.crs_message("crs_a", "crs_b")["message"].alias("message"))
)
SQL["f25_crs_message"] = sql(
    "footprints",
    f"""with {PAIRS} select id_a, id_b, case when crs_a is null or crs_b is null then 'One or both images lack spatial CRS metadata.'
    when crs_a = crs_b then 'Matching ' || crs_a || '. Spatial alignment compatible.' else 'CRS mismatch: ' || crs_a || ' vs ' || lower(crs_b) || '. Reprojection required.' end as message from p""",
)
QUERIES["f11_gsd_metres"] = lambda spark, sf: _pair_headers(spark, sf).select(
    "scene_id", geo.gsd_metres(F.col("res") / 1000.0, F.when(F.col("scene_id") % 2 == 0, 4326).otherwise(32643)).alias("gsd")
)
SQL["f11_gsd_metres"] = sql("footprints", f"with {PAIRS} select scene_id, case when scene_id % 2 = 0 then res / 1000e0 * 111320e0 else res / 1000e0 end as gsd from h")


# --- radius boxes, distance, percent boxes
def _radius(spark, sf):
    box = geo.radius_bbox("y0", "x0", F.col("w") * 3.0)
    f = v.footprints(spark, sf).withColumns(box)
    area = geo.bbox_area_km2("y0", "min_lon", "min_lat", "max_lon", "max_lat")
    return f.select("id", *[fixed(n).alias(n) for n in box], fixed(area, 3).alias("area"))


QUERIES["f13_radius_bbox"] = _radius
SQL["f13_radius_bbox"] = sql(
    "footprints",
    f"""with d as (select *, w * 3e0 / 111e0 as dy, w * 3e0 / (cos(y0 * pi() / 180e0) * 111e0) as dx from footprints)
    select id, {sfixed('x0 - dx')} as min_lon, {sfixed('y0 - dy')} as min_lat, {sfixed('x0 + dx')} as max_lon, {sfixed('y0 + dy')} as max_lat, {sfixed('4 * (w * 3e0) * (w * 3e0)', 3)} as area from d""",
)
QUERIES["f14_distance"] = lambda spark, sf: v.cand(spark, sf).select("cand_id", fixed(geo.distance_km("lat", "lon", 12.5, 77.0), 4).alias("km"))
SQL["f14_distance"] = sql(
    "cand", f"select cand_id, {sfixed('sqrt(((lat - 12.5e0) * 111e0) ** 2 + ((lon - 77e0) * (cos(12.5e0 * pi() / 180e0) * 111e0)) ** 2)', 4)} as km from cand"
)


def _percent_boxes(spark, sf):
    i = F.col("id")
    out = geo.percent_box_to_geo((i % 50).cast("double"), (i % 30).cast("double"), (i % 50 + 20).cast("double"), (i % 30 + 40).cast("double"), "x0", "y0", F.col("x0") + F.col("w"), F.col("y0") + F.col("w"))
    return v.footprints(spark, sf).select("id", *[fixed(c).alias(n) for n, c in out.items()])


QUERIES["f15_percent_box_geo"] = _percent_boxes
SQL["f15_percent_box_geo"] = sql(
    "footprints",
    f"""with g as (select id, x0 + (id % 30) / 100e0 * w as gx0, y0 + w - (id % 50 + 20) / 100e0 * w as gy0, x0 + (id % 30 + 40) / 100e0 * w as gx1, y0 + w - (id % 50) / 100e0 * w as gy1 from footprints)
    select id, {sfixed('gx0')} as geo_min_lon, {sfixed('gy0')} as geo_min_lat, {sfixed('gx1')} as geo_max_lon, {sfixed('gy1')} as geo_max_lat,
    {sfixed('(gx0 + gx1) / 2e0')} as centroid_lon, {sfixed('(gy0 + gy1) / 2e0')} as centroid_lat from g""",
)


# --- coordinate systems
def _mercator(spark, sf):
    p = crs.from_wgs84("x0", "y0", 3857)
    return v.footprints(spark, sf).select("id", fixed(p["x"], 2).alias("x"), fixed(p["y"], 2).alias("y"))


QUERIES["f17_web_mercator"] = _mercator
SQL["f17_web_mercator"] = sql(
    "footprints",
    f"select id, {sfixed('radians(x0) * 6378137e0', 2)} as x, {sfixed('ln(tan(pi() / 4 + radians(y0) / 2)) * 6378137e0', 2)} as y from footprints",
)


def _utm_round_trip(spark, sf):
    f = v.footprints(spark, sf).withColumn("epsg", crs.utm_epsg("x0", "y0")).withColumn("p", crs.from_wgs84("x0", "y0", F.col("epsg")))
    back = crs.to_wgs84("p.x", "p.y", F.col("epsg"))
    inside = F.col("p.x").between(100000.0, 900000.0) & F.col("p.y").between(0.0, 10000000.0)
    return f.select("id", "epsg", fixed(back["lon"], 5).alias("lon"), fixed(back["lat"], 5).alias("lat"), inside.alias("inside"))


QUERIES["f17_utm_round_trip"] = _utm_round_trip
SQL["f17_utm_round_trip"] = sql(
    "footprints",
    f"""select id, cast((case when y0 >= 0 then 32600 else 32700 end) + least(floor((x0 + 180) / 6) + 1, 60) as integer) as epsg,
    {sfixed('x0', 5)} as lon, {sfixed('y0', 5)} as lat, true as inside from footprints""",
)


def _bounds(spark, sf):
    f = v.footprints(spark, sf).withColumn("p", crs.from_wgs84("x0", "y0", 3857)).withColumn("q", crs.from_wgs84(F.col("x0") + F.col("w"), F.col("y0") + F.col("w"), 3857))
    box = crs.bounds_to_wgs84(F.col("p.x"), F.col("p.y"), F.col("q.x"), F.col("q.y"), 3857)
    return f.select("id", *[fixed(c, 5).alias(n) for n, c in box.items()])


QUERIES["f17_bounds"] = _bounds
SQL["f17_bounds"] = sql(
    "footprints", f"select id, {sfixed('x0', 5)} as min_lon, {sfixed('y0', 5)} as min_lat, {sfixed('x0 + w', 5)} as max_lon, {sfixed('y0 + w', 5)} as max_lat from footprints"
)
