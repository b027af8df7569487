"""Alignment of rasters to a reference grid in any of the known coordinate systems, with a choice of kernels.

The warp is inverse and by block of the source. Source pixels go, with a halo, to their block in one shuffle; each
block fills the reference cells whose centre falls inside it. Where a centre falls is computed exactly on a sparse
lattice of the reference grid and interpolated between; the lattice is halved until the interpolation is within
``tolerance`` source pixels of the exact place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.functions import crs_arrays as ca
from scenelake.operators.raster import STACK_ORDER

BLOCK, STEP, TOLERANCE = 256, 16, 1 / 64
KERNELS = ("nearest", "bilinear", "cubic", "area")
#: Source pixels beside the centre that a kernel reads; for areas half the footprint comes on top.
REACH = {"nearest": 1, "bilinear": 1, "cubic": 2, "area": 1}
#: Reference cells that are worked on at once.
CELLS = 1 << 18

_GRID = ("a", "c", "e", "f", "width", "height", "epsg")


def _place(h: dict, side: str, row: np.ndarray, col: np.ndarray, other: str) -> tuple[np.ndarray, np.ndarray]:
    """Exact place of cell centres of one grid on the other, in rows and columns from centre to centre."""
    x, y = h[f"{side}_c"] + h[f"{side}_a"] * (col + 0.5), h[f"{side}_f"] + h[f"{side}_e"] * (row + 0.5)
    x, y = ca.transform(x, y, int(h[f"{side}_epsg"]), int(h[f"{other}_epsg"]))
    return (y - h[f"{other}_f"]) / h[f"{other}_e"] - 0.5, (x - h[f"{other}_c"]) / h[f"{other}_a"] - 0.5


def _between(nodes: np.ndarray, v: np.ndarray, u: np.ndarray) -> np.ndarray:
    i, j = np.minimum(v.astype(int), nodes.shape[0] - 2), np.minimum(u.astype(int), nodes.shape[1] - 2)
    p, q = v - i, u - j
    top = nodes[i, j] * (1 - q) + nodes[i, j + 1] * q
    return top * (1 - p) + (nodes[i + 1, j] * (1 - q) + nodes[i + 1, j + 1] * q) * p


def lattice_places(h: dict, rows: tuple[int, int], cols: tuple[int, int], step: int = STEP, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, int]:
    """Source rows and columns of the reference cells of a window, and the lattice step that was fine enough."""
    r, c = np.arange(*rows), np.arange(*cols)
    if h["s_epsg"] == h["t_epsg"]:
        sr, sc = _place(h, "t", r[:, None].astype(float), c[None, :].astype(float), "s")
        return np.broadcast_to(sr, (len(r), len(c))), np.broadcast_to(sc, (len(r), len(c))), 0
    while step > 1:
        at_r = rows[0] + step * np.arange(-(-(len(r) - 1) // step) + 1 if len(r) > 1 else 2)
        at_c = cols[0] + step * np.arange(-(-(len(c) - 1) // step) + 1 if len(c) > 1 else 2)
        nodes = _place(h, "t", at_r[:, None].astype(float), at_c[None, :].astype(float), "s")
        mid_r, mid_c = (at_r[:-1] + step / 2)[:, None], (at_c[:-1] + step / 2)[None, :]
        exact = _place(h, "t", mid_r, mid_c, "s")
        v, u = np.broadcast_arrays((mid_r - rows[0]) / step, (mid_c - cols[0]) / step)
        off = max(float(np.abs(_between(n, v, u) - e).max()) for n, e in zip(nodes, exact))
        if off <= tolerance:
            v, u = np.broadcast_arrays(((r - rows[0]) / step)[:, None], ((c - cols[0]) / step)[None, :])
            return _between(nodes[0], v, u), _between(nodes[1], v, u), step
        step //= 2
    sr, sc = _place(h, "t", r[:, None].astype(float), c[None, :].astype(float), "s")
    return sr, sc, 1


def _weights(kernel: str, distance: np.ndarray, half: np.ndarray | float) -> np.ndarray:
    """Weight of a source pixel at a distance (in pixels) from the centre that is asked for."""
    t = np.abs(distance)
    if kernel == "nearest":
        return ((distance > -0.5) & (distance <= 0.5)).astype(float)
    if kernel == "bilinear":
        return np.maximum(1 - t, 0)
    if kernel == "cubic":
        near, far = (1.5 * t - 2.5) * t * t + 1, ((-0.5 * t + 2.5) * t - 4) * t + 2
        return np.where(t <= 1, near, np.where(t < 2, far, 0.0))
    return np.clip(np.minimum(distance + 0.5, half) - np.maximum(distance - 0.5, -half), 0, None)


def _warp(h: dict, block: tuple[int, int], side: int, table: pa.Table, bands: Sequence[str], kernel: str, reach: int, step: int, tolerance: float) -> Iterator[dict]:
    """Reference cells whose centre falls into a source block, in pieces: row, col, one value a band."""
    height, width = int(h["s_height"]), int(h["s_width"])
    r0, r1 = block[0] * side, min((block[0] + 1) * side, height)
    c0, c1 = block[1] * side, min((block[1] + 1) * side, width)
    # centres beside the raster belong to the blocks at its border, as far as the kernel reaches
    own = [(-reach if r0 == 0 else r0 - 0.5), (height - 1 + reach if r1 == height else r1 - 0.5), (-reach if c0 == 0 else c0 - 0.5), (width - 1 + reach if c1 == width else c1 - 0.5)]
    v, u = np.meshgrid(np.linspace(own[0], own[1], 17), np.linspace(own[2], own[3], 17), indexing="ij")
    tr, tc = _place(h, "s", v, u, "t")
    if not (np.isfinite(tr).all() and np.isfinite(tc).all()):
        raise ValueError("a source raster reaches beyond what the reference system can show")
    bulge = [max(float(np.abs(np.diff(t, 2, axis=k)).max()) for k in (0, 1)) for t in (tr, tc)]
    rows = max(0, math.floor(tr.min() - bulge[0]) - 1), min(int(h["t_height"]), math.ceil(tr.max() + bulge[0]) + 2)
    cols = max(0, math.floor(tc.min() - bulge[1]) - 1), min(int(h["t_width"]), math.ceil(tc.max() + bulge[1]) + 2)
    if rows[0] >= rows[1] or cols[0] >= cols[1]:
        return
    pr, pc = table["row"].to_numpy(), table["col"].to_numpy()
    top, left = int(pr.min()), int(pc.min())
    shape = (int(pr.max()) - top + 1, int(pc.max()) - left + 1)
    there = np.zeros(shape, bool)
    there[pr - top, pc - left] = True
    frames = []
    for b in bands:
        frame = np.full(shape, np.nan)
        frame[pr - top, pc - left] = table[b].to_numpy(zero_copy_only=False).astype(float)
        frames.append(frame)
    tall = max(1, CELLS // (cols[1] - cols[0]))
    for first in range(rows[0], rows[1], tall):
        window = (first, min(first + tall, rows[1]))
        sr, sc, _ = lattice_places(h, window, cols, step, tolerance)
        mine = (sr >= own[0]) & (sr <= own[1] if r1 == height else sr < own[1]) & (sc >= own[2]) & (sc <= own[3] if c1 == width else sc < own[3])
        at = np.nonzero(mine)
        if not len(at[0]):
            continue
        half = 0.5, 0.5
        if kernel == "area":
            gr, gc = np.gradient(sr, axis=0) if len(sr) > 1 else 0 * sr + 1, np.gradient(sc, axis=1) if sc.shape[1] > 1 else 0 * sc + 1
            half = tuple(np.maximum(np.abs(g[at]), 1) / 2 for g in (gr, gc))
            if max(float(x.max()) for x in half) > reach - 0.5:
                raise ValueError("the reference cells cover more source pixels than the halo holds")
        y, x = sr[at], sc[at]
        base_r, base_c = np.floor(y).astype(int), np.floor(x).astype(int)
        sums, weights, seen = np.zeros((len(bands), len(y))), np.zeros((len(bands), len(y))), np.zeros(len(y), bool)
        for i in range(-reach + 1, reach + 1):
            wr = _weights(kernel, base_r + i - y, half[0])
            for j in range(-reach + 1, reach + 1):
                w = wr * _weights(kernel, base_c + j - x, half[1])
                a, b = base_r + i - top, base_c + j - left
                inside = (w != 0) & (a >= 0) & (a < shape[0]) & (b >= 0) & (b < shape[1])
                k = np.flatnonzero(inside)
                seen[k] |= there[a[k], b[k]]
                for n, frame in enumerate(frames):
                    value = frame[a[k], b[k]]
                    good = np.isfinite(value)
                    sums[n, k[good]] += w[k[good]] * value[good]
                    weights[n, k[good]] += w[k[good]]
        with np.errstate(invalid="ignore", divide="ignore"):
            values = np.where(np.abs(weights) > 1e-9, sums / weights, np.nan)
        keep = np.flatnonzero(seen)
        yield {"row": at[0][keep] + window[0], "col": at[1][keep] + cols[0], **{b: values[n, keep] for n, b in enumerate(bands)}}


def _change_of_size(headers: DataFrame) -> tuple[float, float]:
    """Most source pixels along a side of a reference cell, and most reference cells along a side of a source pixel."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, least = 0.0, np.inf
        for batch in batches:
            for h in batch.to_pylist():
                v, u = np.meshgrid(np.linspace(0, h["t_height"] - 1, 3), np.linspace(0, h["t_width"] - 1, 3))
                (r0, c0), (r1, c1) = _place(h, "t", v - 0.5, u - 0.5, "s"), _place(h, "t", v + 0.5, u + 0.5, "s")
                sides = np.abs(np.concatenate([r1 - r0, c1 - c0]))
                sides = sides[np.isfinite(sides) & (sides > 0)]
                if len(sides):
                    most, least = max(most, float(sides.max())), min(least, float(sides.min()))
        if most:
            yield pa.RecordBatch.from_arrays([pa.array([most]), pa.array([least])], ["most", "least"])

    found = headers.select([c for c in headers.columns if c[:2] in ("s_", "t_")]).mapInArrow(measure, "most double, least double")
    most, least = found.agg(F.max("most"), F.min("least")).first()
    return (most or 1.0) * 1.05, 1.05 / (least or 1.0)


def align(
    px: DataFrame,
    source: DataFrame,
    reference: DataFrame,
    bands: Sequence[str],
    kernel: str = "bilinear",
    keys: Sequence[str] = ("scene_id",),
    block: int | None = None,
    step: int = STEP,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Values of ``bands`` on the reference grid of each scene: keys, row, col, bands as doubles.

    Both headers: keys, a, c, e, f, width, height, epsg. ``kernel``: nearest, bilinear, cubic (convolution with -0.5)
    or area (mean of the source pixels under a reference cell, by covered share). Missing source pixels drop out and
    the weights are rescaled; cells without any source pixel under the kernel have no row. NULL and NaN count as
    missing. Source pixels are shuffled once; scenes without both headers have no rows.
    """
    if kernel not in KERNELS:
        raise ValueError(f"unknown kernel {kernel!r}")
    names = list(keys)
    grids = source.select(*names, *[F.col(c).alias(f"s_{c}") for c in _GRID]).join(reference.select(*names, *[F.col(c).alias(f"t_{c}") for c in _GRID]), names)
    smaller, larger = _change_of_size(grids)
    reach = REACH[kernel] + (math.ceil(max(smaller, 1.0) / 2) if kernel == "area" else 0)
    # a block of the source fills as many reference cells as one of usual size, however much finer these are
    side = block or max(32, 8 * reach, BLOCK // math.ceil(max(larger, 1.0)))
    fields = [f"{s}_{c}" for s in "st" for c in _GRID]

    def numbers(axis: str):
        low, high = F.greatest(F.floor((F.col(axis) - reach) / side), F.lit(0)), F.floor((F.col(axis) + reach) / side)
        return F.explode(F.sequence(low.cast("int"), high.cast("int")))

    copies = px.select(*names, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *bands)
    copies = copies.withColumn("_br", numbers("row")).withColumn("_bc", numbers("col"))
    tall = grids.withColumn("_br", F.explode(F.sequence(F.lit(0), F.floor((F.col("s_height") - 1) / side).cast("int"))))
    blocks = tall.withColumn("_bc", F.explode(F.sequence(F.lit(0), F.floor((F.col("s_width") - 1) / side).cast("int"))))
    kinds = [px.schema[k].dataType.simpleString() for k in names]
    schema = ", ".join([*(f"`{k}` {t}" for k, t in zip(names, kinds)), "row long", "col long", *(f"`{b}` double" for b in bands)])
    shape = pa.schema([(c, pa.float64()) for c in bands])

    def fill(pixels: pa.Table, heads: pa.Table) -> pa.Table:
        if not pixels.num_rows or not heads.num_rows:
            where = pixels if pixels.num_columns else heads
            empty = {k: where[k].slice(0, 0) for k in names} | {c: pa.array([], pa.int64()) for c in ("row", "col")}
            return pa.table(empty | {f.name: pa.array([], f.type) for f in shape})
        h = {f: heads[f][0].as_py() for f in fields}
        at = (heads["_br"][0].as_py(), heads["_bc"][0].as_py())
        parts = list(_warp(h, at, side, pixels, bands, kernel, reach, step, tolerance))
        merged = {c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64 if c in ("row", "col") else float) for c in ("row", "col", *bands)}
        n = len(merged["row"])
        key = {k: pa.array([heads[k][0].as_py()] * n, heads[k].type) for k in names}
        values = {b: pa.array(merged[b], from_pandas=True) for b in bands}
        return pa.table(key | {c: pa.array(merged[c].astype(np.int64)) for c in ("row", "col")} | values)

    cells = [*names, "_br", "_bc"]
    return copies.groupBy(*cells).cogroup(blocks.groupBy(*cells)).applyInArrow(fill, schema)


def stack_aligned(px_long: DataFrame, headers: DataFrame, bands: Sequence[str], order: Sequence[str] = STACK_ORDER, kernel: str = "bilinear") -> DataFrame:
    """Long single-band pixels on grids of their own to one wide row per cell of the first band in product order.

    ``px_long``: scene_id, band, row, col, value; ``headers``: scene_id, band and the grid.
    """
    rank = {b: i for i, b in enumerate(order)}
    names = sorted(bands, key=lambda b: (rank.get(b, len(rank)), b))
    wanted = headers.filter(F.col("band").isin(*names))
    place = F.array_position(F.array(*[F.lit(b) for b in names]), F.col("band"))
    first = wanted.groupBy("scene_id").agg(F.min_by(F.struct(*_GRID), place).alias("g")).select("scene_id", "g.*")
    reference = wanted.select("scene_id", "band").join(first, "scene_id")
    aligned = align(px_long, wanted, reference, ["value"], kernel, ("scene_id", "band"))
    return aligned.groupBy("scene_id", "row", "col").pivot("band", names).agg(F.first("value", ignorenulls=True))
