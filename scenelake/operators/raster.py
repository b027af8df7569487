"""Grid jobs: area crop, tiles, resampling onto a reference grid, band stacking."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions import geometry as geo
from scenelake.functions.crs import from_wgs84

# Order of bands in a stacked product; others follow by name.
STACK_ORDER = ["B02", "B03", "B04", "B08", "B11", "B12", "VV", "VH"]


class Cropped(NamedTuple):
    """Pixels inside the area and the header of the cropped window."""

    pixels: DataFrame
    headers: DataFrame


def literal_ring(aoi: Sequence) -> Column:
    """Ring column from a box of four numbers or a list of at least three lon, lat points."""
    if len(aoi) == 4 and all(isinstance(v, (int, float)) for v in aoi):
        return geo.box_ring(*[float(v) for v in aoi])
    if len(aoi) >= 3 and all(len(p) == 2 for p in aoi):
        return geo.closed_ring(F.array(*[geo.point(float(x), float(y)) for x, y in aoi]))
    raise ValueError(f"not an area of interest: {aoi!r}")


def geojson_ring(text: str | Column) -> Column:
    """Outer ring of a GeoJSON polygon text."""
    c = F.col(text) if isinstance(text, str) else text
    parsed = F.from_json(c, "type STRING, coordinates ARRAY<ARRAY<ARRAY<DOUBLE>>>")
    return F.transform(F.get(parsed["coordinates"], F.lit(0)), lambda p: geo.point(p[0], p[1]))


def geojson_rings(text: str | Column) -> Column:
    """All rings of a GeoJSON Polygon or MultiPolygon text, parts and holes alike.

    Any other text is an error when the row is read: an area that cannot be read must not look like an empty one.
    """
    c = F.col(text) if isinstance(text, str) else text
    kind = F.get_json_object(c, "$.type")
    ring = "ARRAY<ARRAY<DOUBLE>>"
    one = F.from_json(c, f"coordinates ARRAY<{ring}>")["coordinates"]
    many = F.flatten(F.from_json(c, f"coordinates ARRAY<ARRAY<{ring}>>")["coordinates"])
    rings = F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)
    whole = F.size(rings) > 0
    points = F.transform(rings, lambda r: F.transform(r, lambda p: geo.point(p[0], p[1])))
    unread = F.raise_error(F.concat(F.lit("not a polygon: "), F.coalesce(F.substring(c, 1, 200), F.lit("NULL"))))
    return F.when(whole, points).otherwise(unread.cast("ARRAY<ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>>"))


def _native_ring(ring: Column, epsg: Column) -> Column:
    """Ring in the raster's system: degrees are projected when the raster is not in degrees."""
    box = geo.ring_bbox(ring)
    degrees = (
        (box["min_lon"] >= -180) & (box["max_lon"] <= 180) & (box["min_lat"] >= -90) & (box["max_lat"] <= 90)
    )

    def project(p: Column) -> Column:
        q = from_wgs84(p["lon"], p["lat"], epsg)
        return F.struct(q["x"].alias("lon"), q["y"].alias("lat"))

    return F.when(degrees & (epsg != 4326), F.transform(ring, project)).otherwise(ring)


def crop(px: DataFrame, headers: DataFrame, aoi: DataFrame | Sequence, envelope: bool = True) -> Cropped:
    """Keep the pixels whose centre lies inside the area of their scene.

    ``headers``: scene_id, a, b, c, d, e, f, width, height, epsg. ``aoi`` is one area for all
    scenes (box or points) or a table (scene_id, ring) or (scene_id, rings), the latter with
    all rings of areas of several parts or with holes. The window comes from header
    arithmetic; pixels meet the ring test only after the row and column range. A raster that
    is turned against its axes (affine terms b, d) is an error.
    """
    windows = area_windows(headers, aoi)
    x, y = geo.pixel_to_geo("row", "col")
    inside = (
        px.join(windows.select("scene_id", "a", "c", "e", "f", "rings", "row0", "row1", "col0", "col1"), "scene_id")
        .filter("row >= row0 and row < row1 and col >= col0 and col < col1")
        .filter(geo.point_in_rings(x, y, "rings"))
    )
    return cropped(inside, windows, px.columns, headers.columns, envelope)


def area_windows(headers: DataFrame, aoi: DataFrame | Sequence) -> DataFrame:
    """Headers with the area of their scene as ``rings`` in the scene's system and the window row0, row1, col0, col1 around it."""
    if isinstance(aoi, DataFrame):
        rings = F.col("rings") if "rings" in aoi.columns else F.array("ring")
        areas = headers.join(aoi.select("scene_id", rings.alias("rings")), "scene_id")
    else:
        areas = headers.withColumn("rings", F.array(literal_ring(aoi)))
    turned = F.raise_error("a raster turned against its axes cannot be cropped").cast("double")
    straight = F.when((F.col("b") == 0) & (F.col("d") == 0), F.col("a")).otherwise(turned) if {"b", "d"} <= set(headers.columns) else F.col("a")
    native = F.transform("rings", lambda r: _native_ring(geo.closed_ring(r), F.col("epsg")))
    areas = areas.withColumn("a", straight).withColumn("rings", native)
    box = geo.ring_bbox(F.flatten("rings"))
    row_a, col_a = geo.geo_to_pixel(box["min_lon"], box["max_lat"])
    row_b, col_b = geo.geo_to_pixel(box["max_lon"], box["min_lat"])

    def window(lo: Column, size: str) -> Column:
        return F.least(F.greatest(lo, F.lit(0)), F.col(size)).cast("bigint")

    windows = areas.withColumns(
        {
            "row0": window(F.floor(F.least(row_a, row_b)), "height"),
            "row1": window(F.ceil(F.greatest(row_a, row_b)), "height"),
            "col0": window(F.floor(F.least(col_a, col_b)), "width"),
            "col1": window(F.ceil(F.greatest(col_a, col_b)), "width"),
        }
    ).filter("row1 > row0 and col1 > col0")
    return windows


def cropped(inside: DataFrame, windows: DataFrame, columns: Sequence[str], header_columns: Sequence[str], envelope: bool) -> Cropped:
    """Pixels inside and headers, both counted from the window's corner if ``envelope``."""
    if envelope:
        moved = {"row": F.col("row") - F.col("row0"), "col": F.col("col") - F.col("col0")}
        new = windows.withColumns(
            {
                "c": F.col("c") + F.col("a") * F.col("col0"),
                "f": F.col("f") + F.col("e") * F.col("row0"),
                "width": F.col("col1") - F.col("col0"),
                "height": F.col("row1") - F.col("row0"),
            }
        )
    else:
        moved, new = {}, windows
    pixels = inside.withColumns(moved).select(*columns)
    return Cropped(pixels, new.select(*header_columns))


def _stride(size: int, overlap: int) -> int:
    return size - overlap if size > overlap else size


def tile_manifest(headers: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """Row-major tile windows with their affine and bounds, from headers alone."""
    stride = _stride(size, overlap)
    across = F.floor((F.col("width") - 1) / stride) + 1
    tiles = (
        headers.withColumn("row_off", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("height").cast("bigint") - 1, F.lit(stride).cast("bigint"))))
        .withColumn("col_off", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("width").cast("bigint") - 1, F.lit(stride).cast("bigint"))))
        .withColumn("row_index", F.floor(F.col("row_off") / stride))
        .withColumn("col_index", F.floor(F.col("col_off") / stride))
    )
    w = F.least(F.lit(size), F.col("width") - F.col("col_off")).cast("int")
    h = F.least(F.lit(size), F.col("height") - F.col("row_off")).cast("int")
    left = F.col("c") + F.col("a") * F.col("col_off")
    top = F.col("f") + F.col("e") * F.col("row_off")
    right, bottom = left + F.col("a") * w, top + F.col("e") * h
    number = F.col("row_index") * across + F.col("col_index")
    return tiles.select(
        "scene_id",
        F.format_string("tile_%04d", number).alias("tile_id"),
        "row_index",
        "col_index",
        "row_off",
        "col_off",
        w.alias("tile_width"),
        h.alias("tile_height"),
        F.col("a"),
        left.alias("c"),
        F.col("e"),
        top.alias("f"),
        F.least(left, right).alias("left"),
        F.least(top, bottom).alias("bottom"),
        F.greatest(left, right).alias("right"),
        F.greatest(top, bottom).alias("top"),
        "epsg",
    )


def assign_tiles(px: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """One row per pixel and tile that holds it; arithmetic instead of a range join."""
    stride = _stride(size, overlap)

    def indices(axis: str) -> Column:
        first = F.greatest(F.ceil((F.col(axis) - (size - 1)) / float(stride)), F.lit(0))
        return F.sequence(first.cast("bigint"), F.floor(F.col(axis) / float(stride)).cast("bigint"))

    return px.withColumn("row_index", F.explode(indices("row"))).withColumn("col_index", F.explode(indices("col")))


def tile_boxes_to_geo(boxes: DataFrame, tiles: DataFrame) -> DataFrame:
    """Global pixel box and geographic bounds of percent boxes found inside tiles."""
    joined = boxes.join(tiles, ["scene_id", "tile_id"])

    def part(name: str, size: str) -> Column:
        return F.col(name) / 100.0 * F.col(size)

    y0, y1 = part("ymin", "tile_height"), part("ymax", "tile_height")
    x0, x1 = part("xmin", "tile_width"), part("xmax", "tile_width")
    gx0, gx1 = F.col("a") * x0 + F.col("c"), F.col("a") * x1 + F.col("c")
    gy0, gy1 = F.col("e") * y1 + F.col("f"), F.col("e") * y0 + F.col("f")
    return joined.select(
        *boxes.columns,
        F.round(F.col("row_off") + y0, 1).alias("px_ymin"),
        F.round(F.col("col_off") + x0, 1).alias("px_xmin"),
        F.round(F.col("row_off") + y1, 1).alias("px_ymax"),
        F.round(F.col("col_off") + x1, 1).alias("px_xmax"),
        F.round(F.least(gx0, gx1), 6).alias("geo_min_x"),
        F.round(F.least(gy0, gy1), 6).alias("geo_min_y"),
        F.round(F.greatest(gx0, gx1), 6).alias("geo_max_x"),
        F.round(F.greatest(gy0, gy1), 6).alias("geo_max_y"),
    )


def target_grid(headers: DataFrame) -> DataFrame:
    """All (scene, row, col) cells of the headers.

    Rows are spread over the cluster before columns are unfolded, so a huge scene does not
    grow inside one task.
    """
    rows = headers.withColumn("row", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("height").cast("bigint") - 1)))
    spread = rows.repartition("scene_id", "row")
    return spread.withColumn("col", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("width").cast("bigint") - 1)))


def resample(px: DataFrame, source: DataFrame, reference: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Bilinear values of ``bands`` on the reference grid of each scene.

    Both headers: scene_id, a, c, e, f, width, height in one coordinate system. Neighbours
    outside the source or without a value drop out and the weights are rescaled.
    """
    src = source.select("scene_id", *[F.col(n).alias(f"s_{n}") for n in ("a", "c", "e", "f")])
    grid = target_grid(reference.select("scene_id", "a", "c", "e", "f", "width", "height")).join(src, "scene_id")
    x, y = geo.pixel_to_geo("row", "col")
    row, col = geo.geo_to_pixel(x, y, prefix="s_")
    placed = grid.select("scene_id", "row", "col", (row - 0.5).alias("sr"), (col - 0.5).alias("sc"))
    r0, c0 = F.floor("sr"), F.floor("sc")
    wr, wc = F.col("sr") - r0, F.col("sc") - c0
    corners = F.array(
        *[
            F.struct((r0 + i).alias("r"), (c0 + j).alias("c"), ((wr if i else 1.0 - wr) * (wc if j else 1.0 - wc)).alias("w"))
            for i in (0, 1)
            for j in (0, 1)
        ]
    )
    neighbours = placed.select("scene_id", "row", "col", F.explode(corners).alias("n")).filter("n.w > 0")
    values = px.select("scene_id", F.col("row").alias("_r"), F.col("col").alias("_c"), *bands)
    joined = neighbours.select("scene_id", "row", "col", F.col("n.r").alias("_r"), F.col("n.c").alias("_c"), F.col("n.w").alias("_w")).join(
        values, ["scene_id", "_r", "_c"]
    )
    sums = [
        (F.sum(F.col("_w") * F.col(b)) / F.sum(F.when(F.col(b).isNotNull(), F.col("_w")))).alias(b) for b in bands
    ]
    return joined.groupBy("scene_id", "row", "col").agg(*sums)


def stack_bands(px_long: DataFrame, bands: Sequence[str], order: Sequence[str] = STACK_ORDER) -> DataFrame:
    """Long single-band pixels to one wide row per cell, bands in product order."""
    rank = {b: i for i, b in enumerate(order)}
    names = sorted(bands, key=lambda b: (rank.get(b, len(rank)), b))
    return px_long.groupBy("scene_id", "row", "col").pivot("band", names).agg(F.first("value", ignorenulls=True))


def stack_summary(headers: DataFrame, order: Sequence[str] = STACK_ORDER) -> DataFrame:
    """Header of the stacked product per scene from band headers (scene_id, band, dtype, width, height).

    The first band in product order is the reference grid.
    """
    rank = F.array_position(F.array(*[F.lit(b) for b in order]), F.col("band"))
    place = F.when(rank > 0, rank).otherwise(len(order) + 1)
    first = F.min_by(F.struct("dtype", "width", "height"), F.struct(place, "band"))
    folded = headers.groupBy("scene_id").agg(
        F.sort_array(F.collect_list(F.struct(place.alias("p"), F.col("band").alias("band")))).alias("listed"), first.alias("ref")
    )
    return folded.select(
        "scene_id",
        F.size("listed").alias("bands_count"),
        F.transform("listed", lambda s: s["band"]).alias("band_descriptions"),
        F.when(F.col("ref.dtype").isin("uint16", "int16"), "uint16").otherwise("float32").alias("dtype"),
        "ref.width",
        "ref.height",
    )
