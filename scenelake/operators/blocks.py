"""Numpy work on bounded blocks of rasters: one shuffle by block, many blocks per Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.session import spread

BLOCK = 256
#: A block's side is at least so many halos, so that copies of border cells stay a small share.
HALOS_PER_SIDE = 8
_OUT_ROWS = 50_000


def _changes(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Whether a row, from the second on, has another key than the row before it; nulls are equal."""
    change = np.zeros(table.num_rows - 1, bool)
    for k in names:
        column = table[k].combine_chunks()
        differs = pc.fill_null(pc.not_equal(column[1:], column[:-1]), False)
        change |= pc.or_(differs, pc.not_equal(column[1:].is_null(), column[:-1].is_null())).to_numpy(zero_copy_only=False)
    return change


def map_groups(df: DataFrame, keys: Sequence[str], fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Apply ``fn`` to the rows of each key, as ``groupBy(keys).applyInArrow``, without a call from the JVM per group.

    Rows are shuffled and sorted by key; each task cuts its batches where a key ends and joins small results again.
    """
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        done: list[pa.Table] = []
        rows = 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            if held and any(held[-1][k][-1].as_py() != table[k][0].as_py() for k in names):
                done.append(fn(pa.concat_tables(held)))
                held = []
            cuts = [0, *(np.flatnonzero(_changes(table, names)) + 1).tolist(), table.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a:
                    done.append(fn(pa.concat_tables(held)))
                    rows += done[-1].num_rows
                    held = []
                held.append(table.slice(a, b - a))
            if rows >= _OUT_ROWS:
                yield from pa.concat_tables(done).combine_chunks().to_batches(_OUT_ROWS)
                done, rows = [], 0
        if held:
            done.append(fn(pa.concat_tables(held)))
        if done:
            yield from pa.concat_tables(done).combine_chunks().to_batches(_OUT_ROWS)

    return spread(df, *names).sortWithinPartitions(*names).mapInArrow(run, schema)


def map_many_groups(df: DataFrame, keys: Sequence[str], fn: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """As ``map_groups``, but ``fn`` gets the rows of many whole groups at once, in order, and the number of each row's group."""
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def answer(table: pa.Table, change: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield from fn(table, np.r_[0, np.cumsum(change)]).combine_chunks().to_batches(_OUT_ROWS)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            # only the last row held may share its group with the batch
            seam = pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), table]) if held else table
            at = np.flatnonzero(_changes(seam, names)) + (0 if held else 1)
            if len(at):
                whole = pa.concat_tables([*held, table.slice(0, at[-1])]).combine_chunks()
                if whole.num_rows:
                    yield from answer(whole, _changes(whole, names))
                held = []
            held.append(table.slice(at[-1] if len(at) else 0))
        if held:
            whole = pa.concat_tables(held).combine_chunks()
            yield from answer(whole, _changes(whole, names))

    return spread(df, *names).sortWithinPartitions(*names).mapInArrow(run, schema)


def with_blocks(cells: DataFrame, halo: Column, block: int = BLOCK, sides: bool = False) -> DataFrame:
    """Copy each cell into every block whose halo holds it: adds ``_side``, ``_br``, ``_bc``.

    The side is ``block``, or more where the halo asks for it. Blocks before the first row or column are left out, and
    with ``sides`` (columns height, width) those behind the last as well.
    """
    sized = cells.withColumn("_halo", halo.cast("int")).withColumn("_side", F.greatest(F.lit(block), F.col("_halo") * HALOS_PER_SIDE))

    def numbers(axis: str, side: str) -> Column:
        low = F.greatest(F.floor((F.col(axis) - F.col("_halo")) / F.col("_side")), F.lit(0))
        high = F.floor((F.col(axis) + F.col("_halo")) / F.col("_side"))
        if sides:
            high = F.least(high, F.floor((F.col(side) - 1) / F.col("_side")))
        return F.explode(F.sequence(low.cast("int"), high.cast("int")))

    return sized.withColumn("_br", numbers("row", "height")).withColumn("_bc", numbers("col", "width"))


class Grid:
    """Dense frame of a block's cells."""

    def __init__(self, table: pa.Table):
        self.table = table
        self.row, self.col = (table[c].to_numpy().astype(np.int64) for c in ("row", "col"))
        self.top, self.left = self.row.min(), self.col.min()
        self.shape = (int(self.row.max() - self.top + 1), int(self.col.max() - self.left + 1))
        self.at = (self.row - self.top, self.col - self.left)
        side = table["_side"][0].as_py()
        self.own = (self.row // side == table["_br"][0].as_py()) & (self.col // side == table["_bc"][0].as_py())

    def dense(self, values: np.ndarray, missing) -> np.ndarray:
        out = np.full(self.shape, missing, np.result_type(values.dtype, type(missing)) if np.isscalar(missing) else values.dtype)
        out[self.at] = values
        return out

    def result(self, columns: dict[str, np.ndarray], names: Sequence[str]) -> pa.Table:
        """Own cells with the named columns, new ones from dense frames."""
        keep = pa.array(self.own)
        out = {n: pa.array(columns[n][self.at][self.own]) if n in columns else self.table[n].filter(keep) for n in names}
        return pa.table(out)


def frame_sum(x: np.ndarray, low: int, high: int) -> np.ndarray:
    """Sum over offsets low..high on both axes; outside counts as 0. The cost does not depend on the offsets."""
    for axis in (0, 1):
        n = x.shape[axis]
        total = np.concatenate([np.zeros_like(x.take([0], axis)), np.cumsum(x, axis=axis)], axis=axis)
        at = np.arange(n)
        x = total.take(np.clip(at + high + 1, 0, n), axis) - total.take(np.clip(at + low, 0, n), axis)
    return x


def frame_max(x: np.ndarray, low: int, high: int, outside) -> np.ndarray:
    """Maximum over the same frame, by steps of doubling width; needs low <= 0 <= high."""
    for axis in (0, 1):
        y = np.moveaxis(x, axis, 0)
        wide = np.pad(y, [(-low, high), (0, 0)], constant_values=outside)
        width, span = high - low + 1, 1
        while span * 2 <= width:
            wide = np.maximum(wide[:-span], wide[span:])
            span *= 2
        rest = width - span
        wide = np.maximum(wide[:-rest], wide[rest:]) if rest else wide
        x = np.moveaxis(wide, 0, axis)
    return x
