"""Square-window filters on pixel masks: erosion, dilation, opening, closing, density.

Cells are cut into blocks with a halo, so one shuffle by block serves every pass of a filter. A block is one dense
numpy frame whose side follows from the halo; windows are running sums, so their size does not change the cost, and
each scene may have its own. Outside the raster, and where a cell is missing, the mask counts as 0.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.operators.blocks import BLOCK, Grid, frame_max, frame_sum, map_groups, with_blocks

_KEYS = ("scene_id", "_br", "_bc")


def _size(size: int | Column) -> Column:
    return (size if isinstance(size, Column) else F.lit(size)).cast("int")


def _schema(df: DataFrame, **changed: str) -> str:
    types = dict(df.dtypes) | changed
    return ", ".join(f"`{n}` {t}" for n, t in types.items())


def window_fold(cells: DataFrame, value: str, low: int, high: int, out: str, how: str = "sum", block: int = BLOCK) -> DataFrame:
    """Add ``out``: sum or maximum of a column over the square of offsets low..high (low <= 0 <= high)."""
    if how not in ("sum", "max") or not low <= 0 <= high:
        raise ValueError("how is sum or max, and the frame must hold the cell itself")
    whole = dict(cells.dtypes)[value] not in ("double", "float")
    kind = ("bigint" if whole else "double") if how == "sum" else dict(cells.dtypes)[value]
    names = [*cells.columns, out]

    def fold(table: pa.Table) -> pa.Table:
        grid = Grid(table)
        x = table[value].to_numpy()
        if how == "sum":
            done = frame_sum(grid.dense(x.astype(np.int64 if whole else float), 0), low, high)
        else:
            least = np.iinfo(x.dtype).min if whole else -np.inf
            done = frame_max(grid.dense(x, least).astype(x.dtype), low, high, least)
        return grid.result({out: done}, names)

    return map_groups(with_blocks(cells, F.lit(max(-low, high)), block), _KEYS, fold, _schema(cells, **{out: kind}))


class MaskFilter(NamedTuple):
    """Opening or closing of one mask column; the size may be a column of the cells."""

    size: int | Column
    closing: bool


def _erode(x: np.ndarray, size: int, _: np.ndarray) -> np.ndarray:
    """All size x size cells are set; an even window reaches one cell further up and left."""
    back = size // 2
    return (frame_sum(x, -back, size - 1 - back) == size * size).astype(np.int32)


def _dilate(x: np.ndarray, size: int, there: np.ndarray) -> np.ndarray:
    """Any cell of the mirrored window is set."""
    back = size // 2
    return (frame_sum(x, -(size - 1 - back), back) > 0).astype(np.int32) * there


def _passes(cells: DataFrame, plans: dict[str, tuple[Column, tuple]], block: int) -> DataFrame:
    """Run the passes of each mask over shared blocks."""
    masks = list(plans)
    sized = cells.withColumns({m: F.col(m).cast("int") for m in masks}).withColumns({f"_w_{m}": _size(w) for m, (w, _) in plans.items()})
    reach = [(F.floor(F.col(f"_w_{m}") / 2) + 1) * len(steps) for m, (_, steps) in plans.items()]
    halo = F.greatest(*reach) if len(reach) > 1 else reach[0]
    names, order = cells.columns, {m: steps for m, (_, steps) in plans.items()}

    def run(table: pa.Table) -> pa.Table:
        grid = Grid(table)
        there = grid.dense(np.ones(len(grid.row), np.int32), 0)
        done = {}
        for mask, steps in order.items():
            x, size = grid.dense(table[mask].to_numpy().astype(np.int32), 0), table[f"_w_{mask}"][0].as_py()
            for step in steps if size > 1 else ():
                x = step(x, size, there)
            done[mask] = x.astype(np.int32)
        return grid.result(done, names)

    return map_groups(with_blocks(sized, halo, block), _KEYS, run, _schema(cells, **dict.fromkeys(masks, "int")))


def erosion(cells: DataFrame, size: int | Column, mask: str = "mask", block: int = BLOCK) -> DataFrame:
    return _passes(cells, {mask: (size, (_erode,))}, block)


def dilation(cells: DataFrame, size: int | Column, mask: str = "mask", block: int = BLOCK) -> DataFrame:
    return _passes(cells, {mask: (size, (_dilate,))}, block)


def opening(cells: DataFrame, size: int | Column, mask: str = "mask", block: int = BLOCK) -> DataFrame:
    """Erosion, then dilation: drops specks smaller than the window."""
    return _passes(cells, {mask: (size, (_erode, _dilate))}, block)


def closing(cells: DataFrame, size: int | Column, mask: str = "mask", block: int = BLOCK) -> DataFrame:
    """Dilation, then erosion: bridges gaps smaller than the window."""
    return _passes(cells, {mask: (size, (_dilate, _erode))}, block)


def filter_masks(cells: DataFrame, filters: dict[str, MaskFilter], block: int = BLOCK) -> DataFrame:
    """Open or close several mask columns of one table together, in one shuffle."""
    return _passes(cells, {m: (f.size, (_dilate, _erode) if f.closing else (_erode, _dilate)) for m, f in filters.items()}, block)


def density(cells: DataFrame, headers: DataFrame, size: int | Column, mask: str = "mask", block: int = BLOCK) -> DataFrame:
    """Share of set cells in a size x size window, borders mirrored (d c b a | a b c d | d c b a).

    ``headers``: scene_id, height, width; ``size`` may be a column of them. Adds ``hits`` (exact count) and ``density``.
    """
    sides = headers.select("scene_id", F.col("height").alias("height"), F.col("width").alias("width"), _size(size).alias("_w"))
    framed = cells.withColumn(mask, F.col(mask).cast("int")).join(sides, "scene_id")
    names = [*cells.columns, "hits", "density"]

    def run(table: pa.Table) -> pa.Table:
        grid = Grid(table)
        w, height, width = (table[c][0].as_py() for c in ("_w", "height", "width"))
        back = w // 2
        # the dense frame must reach the raster's border wherever a window crosses it, set cells or not
        x = grid.dense(table[mask].to_numpy().astype(np.int64), 0)
        bottom, right = grid.top + grid.shape[0], grid.left + grid.shape[1]
        pad = [(w if grid.top == 0 else 0, w if bottom == height else 0), (w if grid.left == 0 else 0, w if right == width else 0)]
        total = frame_sum(np.pad(x, pad, mode="symmetric"), -back, w - 1 - back)
        hits = total[pad[0][0] : pad[0][0] + x.shape[0], pad[1][0] : pad[1][0] + x.shape[1]]
        return grid.result({"hits": hits, "density": hits / float(w * w)}, names)

    blocked = with_blocks(framed, F.col("_w") + 1, block, sides=True)
    return map_groups(blocked, _KEYS, run, _schema(cells, **{mask: "int"}, hits="bigint", density="double"))
