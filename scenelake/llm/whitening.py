"""Whitening of embeddings by leading principal components.

One pass sums the vectors, a second one the products of the centred entries, both as exact whole numbers, so that
neither the order of the rows nor the cut into tasks changes a bit of the covariance. Its ``dims`` x ``dims`` entries
are all that reaches the driver, where the symmetric matrix becomes a tridiagonal one by Householder reflections,
Sturm counts bisect the leading eigenvalues, and inverse iteration finds their vectors, made orthogonal to each other
inside a cluster of near values. The projection (``dims`` x ``k`` numbers) is broadcast, and a third pass measures how
far the covariance of the whitened rows is from the identity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.session import cut_lineage

#: Components at most, steps of the entries, and what is added to them.
COMPONENTS = 32
STEP, SHIFT = 64.0, 1_000_000
#: Whole numbers stay below this in size, as those of a long do.
_MOST = 2.0**62
#: Eigenvalues nearer than this part of the largest one are one cluster.
_CLUSTER = 1e-3


# --- the eigenproblem
def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the Householder vectors (unit or zero) of a symmetric matrix."""
    a = np.array(matrix, np.float64)
    n = len(a)
    mirrors = []
    for j in range(n - 2):
        x = a[j + 1 :, j].copy()
        size = np.abs(x[1:]).max(initial=0.0)
        if size == 0.0:
            mirrors.append(np.zeros(n - j - 1))
            continue
        scaled = x / max(size, abs(x[0]))
        scaled[0] += np.copysign(np.linalg.norm(scaled), scaled[0])
        v = scaled / np.linalg.norm(scaled)
        mirrors.append(v)
        rest = a[j + 1 :, j + 1 :]
        p = rest @ v
        w = p - v * (v @ p)
        rest -= 2.0 * (np.outer(v, w) + np.outer(w, v))
        x -= 2.0 * v * (v @ x)
        a[j + 1, j] = x[0]
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def values_above(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues of the tridiagonal matrix are larger than each of ``at``."""
    tiny = np.finfo(np.float64).tiny * max(1.0, float((off**2).max(initial=0.0)))
    pivot = diagonal[0] - at
    found = (pivot > 0).astype(np.int64)
    for i in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = diagonal[i] - at - off[i - 1] ** 2 / pivot
        found += pivot > 0
    return found


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, by bisection, falling."""
    reach = np.zeros(len(diagonal))
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    low = np.full(k, (diagonal - reach).min())
    high = np.full(k, (diagonal + reach).max())
    room = 1e-12 * max(abs(low[0]), abs(high[0]), 1e-300)
    low, high = low - room, high + room
    wanted = np.arange(1, k + 1)
    while True:
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high)
        if not open_.any():
            return middle
        above = values_above(diagonal, off, middle) >= wanted
        low, high = np.where(open_ & above, middle, low), np.where(open_ & ~above, middle, high)


def _solve(diagonal: np.ndarray, off: np.ndarray, value: float, right: np.ndarray) -> np.ndarray:
    """(T - value I) y = right by elimination with row exchange; zero pivots become the least number that counts."""
    n = len(diagonal)
    floor = np.finfo(np.float64).eps * max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), 1e-300)
    main, above, second, y = (diagonal - value).tolist(), [*off.tolist(), 0.0], [0.0] * n, right.tolist()
    for i in range(n - 1):
        below = float(off[i])
        if abs(main[i]) >= abs(below):
            main[i] = main[i] or floor
            f = below / main[i]
            main[i + 1] -= f * above[i]
            y[i + 1] -= f * y[i]
        else:
            f = main[i] / below
            main[i], next_main, next_above = below, main[i + 1], above[i + 1]
            main[i + 1] = above[i] - f * next_main
            above[i], second[i] = next_main, next_above
            above[i + 1] = -f * next_above
            y[i], y[i + 1] = y[i + 1], y[i] - f * y[i + 1]
    for i in range(n - 1, -1, -1):
        rest = y[i] - (above[i] * y[i + 1] if i + 1 < n else 0.0) - (second[i] * y[i + 2] if i + 2 < n else 0.0)
        y[i] = rest / (main[i] if abs(main[i]) > floor else np.copysign(floor, main[i]))
    return np.array(y)


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit vectors of the tridiagonal matrix, one column a value; those of a cluster are kept orthogonal at each step."""
    n, k = len(diagonal), len(values)
    scale = max(np.abs(values).max(initial=0.0), 1e-300)
    out = np.zeros((n, k))
    first = 0
    draw = np.random.default_rng(7)
    for j in range(k):
        if j and values[j - 1] - values[j] > _CLUSTER * scale:
            first = j
        # equal values would give the same vector: move them apart by what rounding hides anyway
        value = values[j] - (j - first) * 2 * np.finfo(np.float64).eps * scale
        y = draw.standard_normal(n)
        for _ in range(6):
            y -= out[:, first:j] @ (out[:, first:j].T @ y)
            y = _solve(diagonal, off, value, y / np.linalg.norm(y))
            y /= np.abs(y).max()
        for _ in range(2):
            y -= out[:, :j] @ (out[:, :j].T @ y)
            y /= np.linalg.norm(y)
        out[:, j] = y
    return out


def leading_pairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    diagonal, off, mirrors = tridiagonal(matrix)
    values = leading_values(diagonal, off, k)
    vectors = leading_vectors(diagonal, off, values)
    for j in range(len(mirrors) - 1, -1, -1):
        v = mirrors[j]
        vectors[j + 1 :] -= 2.0 * np.outer(v, v @ vectors[j + 1 :])
    # the quotient of each vector is the value to the second order of its error
    return (vectors * (matrix @ vectors)).sum(0), vectors


# --- vectors of a batch
def _usable(batch: pa.RecordBatch, dims: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, whole numbers as float64) of the vectors without null or non-finite entries, one item a length."""
    lists = batch.column("_v")
    lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    starts = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(np.maximum(lengths, 0), out=starts[1:])
    for d in [dims] if dims else sorted(set(lengths[lengths > 0].tolist())):
        rows = np.flatnonzero(lengths == d)
        vectors = flat[starts[rows][:, None] + np.arange(d)]
        fine = np.isfinite(vectors).all(1)
        yield rows[fine], np.clip(np.floor(STEP * vectors[fine]) + SHIFT, -_MOST, _MOST)


def _exact_sums(x: np.ndarray) -> tuple[list[int], list[int]]:
    """Column sums as high and low halves, each well inside a long."""
    whole = x.astype(np.int64)
    return (whole >> 32).sum(0).tolist(), (whole & 0xFFFFFFFF).sum(0).tolist()


def _sum_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: dict[int, int] = {}
    sums: dict[int, list[int]] = {}
    for batch in batches:
        for rows, x in _usable(batch, None):
            d = x.shape[1]
            n[d] = n.get(d, 0) + len(rows)
            high, low = _exact_sums(x)
            have = sums.setdefault(d, [0] * d)
            for i in range(d):
                have[i] += (high[i] << 32) + low[i]
    if n:
        lengths = list(n)
        yield pa.RecordBatch.from_pydict(
            {"dims": pa.array(lengths, pa.int32()), "n": pa.array([n[d] for d in lengths], pa.int64()), "sums": pa.array([[str(s) for s in sums[d]] for d in lengths], pa.list_(pa.string()))}
        )


def _products(cut_rows, k: int):
    """mapInArrow function: sums of products of the rows that ``cut_rows`` gives, one result row a dimension."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, plain = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            y = cut_rows(batch)
            total += y.T @ y
            plain += y.sum(0)
        if total.any() or plain.any():
            rows = pa.array(np.arange(k), pa.int32())
            yield pa.RecordBatch.from_arrays([rows, pa.array(total.tolist(), pa.list_(pa.float64())), pa.array(plain)], ["i", "products", "plain"])

    return task


_PRODUCTS = "i int, products array<double>, plain double"


def _added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a dimension: the tasks' rows added up as they stream in."""
    total, plain = None, 0.0
    for batch in batches:
        part = batch.column("products").flatten().to_numpy().reshape(batch.num_rows, -1).sum(0)
        total = part if total is None else total + part
        plain += float(batch.column("plain").to_numpy().sum())
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([plain])], ["i", "products", "plain"])


def _gathered(parts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k x k sums of products and the k plain sums: k rows of k numbers reach the driver."""
    out, plain = np.zeros((k, k)), np.zeros(k)
    for r in parts.groupBy("i").applyInArrow(_added, _PRODUCTS).collect():
        out[r.i], plain[r.i] = r.products, r.plain
    return out, plain


def _covariance(products: np.ndarray, rest: list[int], n: int) -> np.ndarray:
    """Covariance with divisor n from products of whole numbers whose sums are ``rest``: exact before the last division."""
    if np.abs(products).max(initial=0.0) < 2.0**53:
        p = np.array([[int(v) for v in row] for row in products.tolist()], object)
        t = np.array(rest, object)
        return np.array((p * n - np.outer(t, t)) / (n * n), np.float64)
    mean = np.array([s / n for s in rest])
    return products / n - np.outer(mean, mean)


def fit(vectors: DataFrame, k: int = COMPONENTS) -> dict | None:
    """n, sums, shift, values, directions and trace for a table of ``_v array<double>``; None without any usable vector."""
    sums = cut_lineage(vectors.mapInArrow(_sum_task, "dims int, n long, sums array<string>").withColumns({"n": F.col("n").cast("decimal(38,0)")}))
    counts = {r.dims: int(r.n) for r in sums.groupBy("dims").agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return None
    dims = max(counts, key=lambda d: (counts[d], d))
    n = counts[dims]
    each = sums.where(F.col("dims") == dims).select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    s = [0] * dims
    for r in each.collect():
        s[r.i] = int(r.s)
    shift = [(2 * v + n) // (2 * n) for v in s]
    centre = np.array(shift, np.float64)

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        return next(_usable(batch, dims))[1] - centre

    products, _ = _gathered(vectors.mapInArrow(_products(centred, dims), _PRODUCTS), dims)
    matrix = _covariance(products, [v - n * m for v, m in zip(s, shift)], n)
    trace = float(np.trace(matrix))
    if not trace:
        return {"dims": dims, "n": n, "sums": s, "shift": shift, "trace": trace, "values": np.zeros(0), "directions": np.zeros((dims, 0))}
    values, directions = leading_pairs(matrix, min(k, dims))
    order = np.argsort(-values, kind="stable")
    values, directions = values[order], directions[:, order]
    real = values > dims * np.finfo(np.float64).eps * trace
    return {"dims": dims, "n": n, "sums": s, "shift": shift, "trace": trace, "values": values[real], "directions": directions[:, real]}


def whiten(rows: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: one row per usable vector and component.

    Vectors that are null or hold a null, NaN or infinite entry are left out, as are empty ones and those of another
    length than the commonest (of equally common ones the longer). Whole numbers are held within 2^62 in size; sums of
    products are exact below 2^53, beyond it they are rounded as doubles are. Components without variance (as all are
    if all vectors are equal) have no direction and give no rows; an empty table gives none. A deviation beyond a long
    is null. Repeated and null ids are rows of their own; further columns are not read.
    """
    table = rows.select(F.col(id_col).alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    vectors = table.select("_v")
    fitted = fit(vectors, k)
    kind = table.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, component int, n long, deviation long, whitened double, explained double"
    if fitted is None or not len(fitted["values"]):
        return table.sparkSession.createDataFrame([], f"{schema}, identity_error double").withColumnRenamed("_id", id_col)
    dims, n, found = fitted["dims"], fitted["n"], len(fitted["values"])
    rest = [v - n * m for v, m in zip(fitted["sums"], fitted["shift"])]
    square = sum(t * t for t in rest)
    share = (fitted["values"] / fitted["trace"]).tolist()
    context = table.sparkSession.sparkContext
    model = context.broadcast(
        (np.array(fitted["shift"], np.float64), np.array([t / n for t in rest]), fitted["directions"] / np.sqrt(fitted["values"]), rest)
    )

    def projected(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shift, mean, directions, _ = model.value
        kept, x = next(_usable(batch, dims))
        near = x - shift
        return kept, near, (near - mean) @ directions

    def only(batch: pa.RecordBatch) -> np.ndarray:
        return projected(batch)[2]

    products, plain = _gathered(vectors.mapInArrow(_products(only, found), _PRODUCTS), found)
    error = float(np.abs(products / n - np.outer(plain / n, plain / n) - np.eye(found)).max())

    def deviations(near: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 = n^2 sum x^2 - 2 n sum x t + sum t^2 over the entries near the mean, in whole numbers."""
        t = model.value[3]
        if np.abs(near).max(initial=0.0) < 2.0**24 and n < 2**32:
            whole = near.astype(np.int64)
            squares, mixed = (whole * whole).sum(1).tolist(), (whole @ np.array(t, np.int64)).tolist()
        else:
            lists = [[int(v) for v in row] for row in near.tolist()]
            squares, mixed = [sum(v * v for v in row) for row in lists], [sum(v * w for v, w in zip(row, t)) for row in lists]
        out = [n * n * a - 2 * n * b + square for a, b in zip(squares, mixed)]
        return [v if v < 1 << 63 else None for v in out]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, near, white = projected(batch)
            m = len(kept)
            each = np.repeat(np.arange(m), found)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id").take(pa.array(kept)).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * found, n, np.int64)),
                    pa.array(deviations(near), pa.int64()).take(pa.array(each)),
                    pa.array(white.ravel()),
                    pa.array(np.tile(np.array(share), m)),
                ],
                ["_id", "component", "n", "deviation", "whitened", "explained"],
            )

    return table.mapInArrow(task, schema).withColumn("identity_error", F.lit(error)).withColumnRenamed("_id", id_col)
