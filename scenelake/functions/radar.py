"""Radar pixel expressions: decibels and backscatter classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLE_BOUNCE_DB = -6.5
SPECULAR_DB = -20.0
VOLUME_DB = -14.0
CROSS_POL_OFFSET_DB = 6.0


def _c(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def to_db(power: str | Column, floor: float = 1e-7, ceiling: float | None = None) -> Column:
    """10 log10 of linear power, floored (and optionally capped) first; NULL stays NULL."""
    p = _c(power)
    bounded = F.greatest(p, F.lit(floor))
    if ceiling is not None:
        bounded = F.least(bounded, F.lit(ceiling))
    return F.when(p.isNotNull(), F.log10(bounded) * 10.0)


def backscatter_masks(
    vv: str | Column = "vv",
    vh: str | Column | None = "vh",
    double: float = DOUBLE_BOUNCE_DB,
    specular: float = SPECULAR_DB,
    volume: float = VOLUME_DB,
) -> dict[str, Column]:
    """Class masks on dB; a missing cross-polarised value is taken as co-polarised minus 6 dB."""
    v = _c(vv)
    fallback = v - CROSS_POL_OFFSET_DB
    cross = fallback if vh is None else F.coalesce(_c(vh), fallback)
    bounce = v > double
    return {
        "double_bounce": bounce,
        "specular_water": v < specular,
        "volume_scattering": (cross > volume) & ~bounce,
    }


def grounding_mask(intent: str, vv: str | Column = "vv") -> Column:
    """Seed mask on dB for a text target: strong, water, rough (vegetation or bare), other."""
    v = _c(vv)
    if intent == "strong":
        return v >= -7.0
    if intent == "water":
        return v <= -18.0
    if intent == "rough":
        return (v >= -14.0) & (v < -7.0)
    if intent == "other":
        return v >= -9.0
    raise ValueError(f"unknown intent {intent!r}")
