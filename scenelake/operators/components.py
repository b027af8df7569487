"""Connected regions of pixel masks (4-neighbour).

Two levels. Set pixels are shuffled once by block and labelled inside their block with numpy
(a group is never larger than one block). Blocks that touch then contribute edges between
their labels, and the published large-star / small-star contraction joins those: O(log n)
rounds of aggregations and equi-joins on (scene, label) over the few labels that reach a
block border, checkpointed, with one small count per round for the stop.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.operators.blocks import map_many_groups
from scenelake.session import cut_lineage, small

BLOCK = 256
_ROW = 2**32


def node_id(row: Column, col: Column) -> Column:
    """Number of a pixel in row-major order; unique inside a scene."""
    return row.cast("bigint") * F.lit(_ROW) + col.cast("bigint")


def _block_runs(pixels: pa.Table, group: np.ndarray, keys: list[str], sums: list[str], block: int) -> pa.Table:
    """Labelled horizontal runs of the set pixels of many blocks; ``group`` numbers the block of each pixel."""
    row, col = pixels["row"].to_numpy(), pixels["col"].to_numpy()
    order = np.lexsort((col, row, group))
    row, col, group = row[order], col[order], group[order]
    first = np.r_[True, (group[1:] != group[:-1]) | (row[1:] != row[:-1]) | (col[1:] != col[:-1] + 1)]
    start = np.flatnonzero(first)
    g, r, c0, c1 = group[start], row[start], col[start], col[np.r_[start[1:] - 1, len(row) - 1]]
    # Runs of the next row that share a column: a range in the row-major order of runs. Behind the last row of each
    # block lies an empty one, so no run meets those of the next block.
    line = (g * (block + 1) + r % block) * block
    lo = np.searchsorted(line + c1 % block, line + block + c0 % block, side="left")
    hi = np.searchsorted(line + c0 % block, line + block + c1 % block, side="right")
    n = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(r)), n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    label = np.arange(len(r))
    while True:
        least = np.minimum(label[a], label[b])
        wider = label.copy()
        np.minimum.at(wider, a, least)
        np.minimum.at(wider, b, least)
        wider = wider[wider]
        if np.array_equal(wider, label):
            break
        label = wider
    at = pa.array(order[start])
    out = {k: pixels[k].take(at) for k in keys}
    out |= {"row": r, "c0": c0, "c1": c1, "node": r[label] * _ROW + c0[label]}
    out |= {s: np.add.reduceat(pixels[s].to_numpy()[order], start) for s in sums}
    return pa.table(out)


def block_runs(
    cells: DataFrame, mask: str = "mask", keys: Sequence[str] = ("scene_id",), block: int = BLOCK, **sums: Column
) -> DataFrame:
    """Runs of set pixels (row, c0, c1), cut at block borders, with their label inside the block and sums.

    A pixel without row or column lies in no run.
    """
    on = cells.filter((F.col(mask).cast("int") == 1) & F.col("row").isNotNull() & F.col("col").isNotNull()).select(
        *keys,
        F.col("row").cast("bigint").alias("row"),
        F.col("col").cast("bigint").alias("col"),
        *[c.cast("double").alias(n) for n, c in sums.items()],
    )
    names, carried = list(keys), list(sums)
    types = dict(on.dtypes)
    schema = ", ".join(
        [f"{k} {types[k]}" for k in names] + ["row bigint, c0 bigint, c1 bigint, node bigint"] + [f"{s} double" for s in carried]
    )
    placed = on.withColumns({f"_{c}": F.floor(F.col(c) / block) for c in ("row", "col")})
    return map_many_groups(placed, [*names, "_row", "_col"], lambda table, group: _block_runs(table, group, names, carried, block), schema)


def border_edges(found: DataFrame, keys: Sequence[str] = ("scene_id",), block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of block labels that touch across a block border, a above b."""
    side = found.filter((F.col("c1") + 1) % block == 0).select(*keys, "row", (F.col("c1") + 1).alias("c0"), F.col("node").alias("x"))
    across = side.join(found.select(*keys, "row", "c0", F.col("node").alias("y")), [*keys, "row", "c0"])
    slot = F.floor(F.col("c0") / block).alias("_slot")
    bottom = found.filter((F.col("row") + 1) % block == 0).select(
        *keys, (F.col("row") + 1).alias("row"), slot, F.col("c0").alias("u0"), F.col("c1").alias("u1"), F.col("node").alias("x")
    )
    top = found.filter(F.col("row") % block == 0).select(*keys, "row", slot, "c0", "c1", F.col("node").alias("y"))
    down = bottom.join(top, [*keys, "row", "_slot"]).filter("c0 <= u1 and u0 <= c1")
    pairs = across.select(*keys, "x", "y").unionByName(down.select(*keys, "x", "y")).filter("x <> y")
    return pairs.select(*keys, F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _signature(edges: DataFrame, keys: Sequence[str]) -> tuple:
    h = F.xxhash64(*keys, "a", "b")
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1_000_003))).alias("s")).first()
    return row["n"], row["x"], row["s"]


def _large_star(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node around it."""
    both = edges.select(*keys, F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(*keys, F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.filter("v > u").join(least, [*keys, "u"]).select(*keys, F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    least = edges.groupBy(*keys, "a").agg(F.min("b").alias("m"))
    hung = edges.join(least, [*keys, "a"]).filter("b <> m").select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select(*keys, "a", F.col("m").alias("b"))).distinct()


def contract(edges: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """(keys, a, b): every node of an edge with the smallest node of its component.

    Rounds repeat until the edge set stays the same; their number is logarithmic in the size
    of the largest component, and no cap could cut it short.
    """
    current = cut_lineage(edges)
    before = _signature(current, keys)
    while before[0] > 0:
        current = cut_lineage(_small_star(_large_star(current, keys), keys))
        after = _signature(current, keys)
        if after == before:
            break
        before = after
    return current


def label_runs(
    cells: DataFrame, mask: str = "mask", keys: Sequence[str] = ("scene_id",), block: int = BLOCK, **sums: Column
) -> DataFrame:
    """Runs with ``label``: the first pixel, in row-major order, of their component."""
    found = cut_lineage(block_runs(cells, mask, keys, block, **sums))
    at_border = [F.col("c0") % block == 0, (F.col("c1") + 1) % block == 0, F.col("row") % block == 0, (F.col("row") + 1) % block == 0]
    near = cut_lineage(found.filter(reduce(Column.__or__, at_border)).select(*keys, "row", "c0", "c1", "node"))
    roots = contract(border_edges(near, keys, block), keys).select(*keys, F.col("a").alias("node"), F.col("b").alias("label"))
    # most labels touch no border: runs stay where they are while the roots of those that do are few
    return found.join(small(roots), [*keys, "node"], "left").withColumn("label", F.coalesce("label", "node"))


def components(cells: DataFrame, mask: str = "mask", keys: Sequence[str] = ("scene_id",), block: int = BLOCK) -> DataFrame:
    """keys, row, col, label of every set pixel."""
    labelled = label_runs(cells, mask, keys, block)
    return labelled.select(*keys, "row", F.explode(F.sequence("c0", "c1")).alias("col"), "label")


def component_sizes(labelled: DataFrame, keys: Sequence[str] = ("scene_id",), sums: Sequence[str] = ()) -> DataFrame:
    """Pixels, extent and carried sums per component, from labelled runs."""
    size = F.sum(F.col("c1") - F.col("c0") + 1)
    return labelled.groupBy(*keys, "label").agg(
        size.alias("pixels"),
        F.min("row").alias("row_min"),
        F.max("row").alias("row_max"),
        F.min("c0").alias("col_min"),
        F.max("c1").alias("col_max"),
        *[F.sum(c).alias(c) for c in sums],
    )
