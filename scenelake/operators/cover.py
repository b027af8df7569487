"""Crop by a cover of cells: inner cells take all their pixels, only pixels of border cells meet the ring test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions import geometry as geo
from scenelake.operators.raster import Cropped, area_windows, cropped
from scenelake.session import cut_lineage

BLOCK, LEAF = 256, 8
OUTER, INNER, BORDER = 0, 1, 2
#: Pixels by which a cell is widened, so that the last bits of an edge beside it do not matter.
MARGIN = 0.01


def _state(row0: Column, col0: Column, size: Column) -> Column:
    """Whether the pixel centres of a cell lie all outside the rings, all inside, or on both sides.

    A cell is a border cell if any edge meets the box of its centres; else its first centre speaks for all.
    """
    row1, col1 = F.least(row0 + size, F.col("row1")), F.least(col0 + size, F.col("col1"))
    ends = [geo.pixel_to_geo(row0 - MARGIN, col0 - MARGIN), geo.pixel_to_geo(row1 - 1 + MARGIN, col1 - 1 + MARGIN)]
    xs, ys = ([e[k] for e in ends] for k in (0, 1))
    box = F.struct(F.least(*xs).alias("x0"), F.greatest(*xs).alias("x1"), F.least(*ys).alias("y0"), F.greatest(*ys).alias("y1"))

    def meets(p: Column, q: Column, b: Column) -> Column:
        sides = [(q["lon"] - p["lon"]) * (y - p["lat"]) - (q["lat"] - p["lat"]) * (x - p["lon"]) for x in (b["x0"], b["x1"]) for y in (b["y0"], b["y1"])]
        near = (F.least(p["lon"], q["lon"]) <= b["x1"]) & (F.greatest(p["lon"], q["lon"]) >= b["x0"]) & (F.least(p["lat"], q["lat"]) <= b["y1"]) & (F.greatest(p["lat"], q["lat"]) >= b["y0"])
        return near & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)

    touched = F.transform(F.array(box), lambda b: F.exists("rings", lambda r: F.exists(geo._edges(r, lambda p, q: meets(p, q, b)), lambda t: t)))[0]
    x, y = geo.pixel_to_geo(row0, col0)
    return F.when(touched, BORDER).when(geo.point_in_rings(x, y, "rings"), INNER).otherwise(OUTER)


def cover_blocks(windows: DataFrame, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """Blocks that an area touches: scene_id, block_row, block_col, whole, states (one number a leaf cell, NULL where whole).

    ``windows`` are rows of ``area_windows``. A block is cut in four as long as an edge runs through it, down to
    ``leaf`` pixels a side; what is clear stays uncut.
    """
    number = lambda c, k: F.floor(F.col(c) / k).cast("int")
    spans = {a: F.sequence(number(f"{a}0", block), F.floor((F.col(f"{a}1") - 1) / block).cast("int")) for a in ("row", "col")}
    blocks = windows.withColumn("block_row", F.explode(spans["row"])).withColumn("block_col", F.explode(spans["col"]))
    # a cell begins where the window does, so that its first pixel is one of the window's
    cells = blocks.withColumns({"_r": F.col("block_row") * block, "_c": F.col("block_col") * block, "_size": F.lit(block)})
    first = lambda: (F.greatest("_r", F.col("row0").cast("int")), F.greatest("_c", F.col("col0").cast("int")))

    def judged(df: DataFrame) -> DataFrame:
        r, c = first()
        size = F.least(F.col("_r") + F.col("_size") - r, F.lit(block)), F.least(F.col("_c") + F.col("_size") - c, F.lit(block))
        return df.withColumn("_state", _state(r, c, F.greatest(*size)))

    cells = judged(cells)
    side = block
    while side > leaf:
        half = side // 2
        parts = [F.struct((F.col("_r") + dr).alias("_r"), (F.col("_c") + dc).alias("_c"), F.lit(half).alias("_size"), F.lit(BORDER).alias("_state")) for dr in (0, half) for dc in (0, half)]
        here = F.array(F.struct("_r", "_c", "_size", "_state"))
        split = cells.withColumn("_kids", F.explode(F.when((F.col("_state") == BORDER) & (F.col("_size") == side), F.array(*parts)).otherwise(here)))
        kids = split.withColumns({n: F.col(f"_kids.{n}") for n in ("_r", "_c", "_size", "_state")}).drop("_kids")
        inside = (F.col("_r") < F.col("row1")) & (F.col("_c") < F.col("col1")) & (F.col("_r") + F.col("_size") > F.col("row0")) & (F.col("_c") + F.col("_size") > F.col("col0"))
        kids = kids.filter(inside)
        known = F.col("_state")
        fresh = judged(kids.withColumn("_known", known))
        cells = fresh.withColumn("_state", F.when((F.col("_known") == BORDER) & (F.col("_size") == half), F.col("_state")).otherwise(F.col("_known"))).drop("_known")
        side = half
    kept = cells.filter(F.col("_state") != OUTER)
    across = block // leaf
    runs = lambda c: F.sequence(F.floor(F.col(c) % block / leaf).cast("int"), F.floor((F.col(c) % block + F.col("_size") - 1) / leaf).cast("int"))
    leaves = F.flatten(F.transform(runs("_r"), lambda i: F.transform(runs("_c"), lambda j: F.struct((i * across + j).alias("key"), F.col("_state").alias("value")))))
    whole = (F.col("_size") == block) & (F.col("_state") == INNER)
    listed = kept.groupBy("scene_id", "block_row", "block_col").agg(F.max(whole).alias("whole"), F.flatten(F.collect_list(F.when(~whole, leaves))).alias("leaves"))
    known = F.map_from_entries("leaves")
    states = F.transform(F.sequence(F.lit(0), F.lit(across * across - 1)), lambda i: F.coalesce(F.try_element_at(known, i), F.lit(OUTER)).cast("tinyint"))
    return listed.select("scene_id", "block_row", "block_col", "whole", F.when(~F.col("whole"), states).alias("states"))


def with_states(px: DataFrame, blocks: DataFrame, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """Pixels of the covered blocks with the ``_state`` of their cell: an equi-join by scene and block."""
    numbered = px.withColumns({"block_row": F.floor(F.col("row") / block).cast("int"), "block_col": F.floor(F.col("col") / block).cast("int")})
    across = block // leaf
    place = (F.floor(F.col("row") % block / leaf) * across + F.floor(F.col("col") % block / leaf) + 1).cast("int")
    state = F.when(F.col("whole"), F.lit(INNER)).otherwise(F.element_at("states", place))
    return numbered.join(blocks, ["scene_id", "block_row", "block_col"]).withColumn("_state", state).filter(F.col("_state") != OUTER)


def crop_by_cover(px: DataFrame, headers: DataFrame, aoi: DataFrame | Sequence, envelope: bool = True, block: int = BLOCK, leaf: int = LEAF) -> Cropped:
    """As ``crop``, for areas with many edges or scenes with most of the pixels.

    Pixels meet blocks by (scene, block), so a large scene is no hot key; the rings travel with border blocks alone.
    One table of areas is written on the way, a row per scene.
    """
    windows = cut_lineage(area_windows(headers, aoi))
    bounds = windows.select("scene_id", "a", "c", "e", "f", "rings", "row0", "row1", "col0", "col1")
    blocks = cover_blocks(bounds, block, leaf).join(bounds, "scene_id").withColumn("rings", F.when(~F.col("whole"), F.col("rings")))
    x, y = geo.pixel_to_geo("row", "col")
    near = with_states(px, blocks, block, leaf).filter("row >= row0 and row < row1 and col >= col0 and col < col1")
    inside = near.filter(F.when(F.col("_state") == INNER, True).otherwise(geo.point_in_rings(x, y, "rings")))
    return cropped(inside, windows, px.columns, headers.columns, envelope)
