"""Percent boxes: normalisation of the scales models use, and box filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column | float) -> Column:
    if isinstance(c, str):
        return F.col(c)
    return c if isinstance(c, Column) else F.lit(c)


def normalize_box(
    c1, c2, c3, c4, width=None, height=None, fmt: str | None = None, digits: int | None = 2
) -> Column:
    """STRUCT<ymin, xmin, ymax, xmax> in percent.

    The scale is pixels when the size is known (or ``fmt`` is "pixel"), unit floats up to
    1.05, percent up to 100, thousandths up to 1005, else pixels of a 1024 canvas. ``fmt``
    "token" keeps the size out of it.
    """
    y1, x1, y2, x2 = (_c(c).cast("double") for c in (c1, c2, c3, c4))
    top = F.greatest(y1, x1, y2, x2)
    w = F.lit(None).cast("double") if width is None else _c(width).cast("double")
    h = F.lit(None).cast("double") if height is None else _c(height).cast("double")
    known = w.isNotNull() & h.isNotNull()
    if fmt == "pixel":
        pixels = F.lit(True)
    elif fmt == "token":
        pixels = F.lit(False)
    else:
        pixels = known & (top > 1.05)
    loose = ~(top <= 1005.0)
    size_y = F.when(pixels, F.greatest(h, F.lit(1.0))).when(loose, F.coalesce(F.nullif(h, F.lit(0.0)), F.lit(1024.0)))
    size_x = F.when(pixels, F.greatest(w, F.lit(1.0))).when(loose, F.coalesce(F.nullif(w, F.lit(0.0)), F.lit(1024.0)))

    def percent(v: Column, size: Column) -> Column:
        return (
            F.when(pixels, v / size * 100.0)
            .when(top <= 1.05, v * 100.0)
            .when(top <= 100.0, v)
            .when(top <= 1005.0, v / 1000.0 * 100.0)
            .otherwise(v / size * 100.0)
        )

    def fit(v: Column) -> Column:
        inside = F.greatest(F.least(v, F.lit(100.0)), F.lit(0.0))
        return F.round(inside, digits) if digits is not None else inside

    ya, yb, xa, xb = percent(y1, size_y), percent(y2, size_y), percent(x1, size_x), percent(x2, size_x)
    return F.struct(
        fit(F.least(ya, yb)).alias("ymin"),
        fit(F.least(xa, xb)).alias("xmin"),
        fit(F.greatest(ya, yb)).alias("ymax"),
        fit(F.greatest(xa, xb)).alias("xmax"),
    )


def checked_box(coords: str | Column, **options) -> Column:
    """``normalize_box`` of an array column; any other length than four fails the job."""
    c = _c(coords)
    box = normalize_box(*[F.get(c, F.lit(i)) for i in range(4)], **options)
    wrong = F.raise_error(F.format_string("expected 4 coordinate values, got %d", F.size(c)))
    return F.when(F.size(c) == 4, box).otherwise(wrong)


def is_degenerate(ymin="ymin", xmin="xmin", ymax="ymax", xmax="xmax", side: float = 0.5) -> Column:
    """Both sides below a minimum."""
    return (F.abs(_c(ymax) - _c(ymin)) < side) & (F.abs(_c(xmax) - _c(xmin)) < side)


def is_large_enough(ymin="ymin", xmin="xmin", ymax="ymax", xmax="xmax", side: float = 1.5) -> Column:
    """Both sides above a minimum."""
    return (_c(ymax) - _c(ymin) > side) & (_c(xmax) - _c(xmin) > side)


def is_unreliable(ymin="ymin", xmin="xmin", ymax="ymax", xmax="xmax") -> Column:
    """Small box in the centre patch models fall back to."""
    centre = _c(ymin).between(54.0, 66.0) & _c(xmin).between(54.0, 66.0)
    small = (F.abs(_c(ymax) - _c(ymin)) <= 12.0) & (F.abs(_c(xmax) - _c(xmin)) <= 12.0)
    return centre & small


def iou(a: str, b: str) -> Column:
    """Intersection over union of two box structs."""

    def side(s: str, n: str) -> Column:
        return F.col(f"{s}.{n}")

    h = F.greatest(F.least(side(a, "ymax"), side(b, "ymax")) - F.greatest(side(a, "ymin"), side(b, "ymin")), F.lit(0.0))
    w = F.greatest(F.least(side(a, "xmax"), side(b, "xmax")) - F.greatest(side(a, "xmin"), side(b, "xmin")), F.lit(0.0))

    def area(s: str) -> Column:
        return (side(s, "ymax") - side(s, "ymin")) * (side(s, "xmax") - side(s, "xmin"))

    shared = h * w
    return F.coalesce(shared / F.nullif(area(a) + area(b) - shared, F.lit(0.0)), F.lit(0.0))
