"""Spectral index expressions and their per-pixel classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# index = (first - second) / (first + second) on these bands.
INDEX_BANDS = {
    "ndvi": ("b08", "b04"),
    "ndwi": ("b03", "b08"),
    "ndbi": ("b11", "b08"),
}

# Class limits (upper class strictly above, lower class strictly below) and names.
INDEX_CLASSES = {
    "ndvi": (
        0.50,
        0.20,
        "Healthy Vegetation (NDVI > 0.50)",
        "Moderate Canopy (0.20 - 0.50)",
        "Low / Barren / Water (< 0.20)",
    ),
    "ndwi": (
        0.0,
        -0.20,
        "Open Water Surface (NDWI > 0.0)",
        "High Moisture / Saturated (-0.2 - 0.0)",
        "Dry Land / Non-Water (< -0.20)",
    ),
    "ndbi": (
        0.10,
        -0.10,
        "Built-up / Concrete / Asphalt (NDBI > 0.10)",
        "Barren / Mixed Ground (-0.10 - 0.10)",
        "Vegetated / Water (< -0.10)",
    ),
}

# Colour ramp steps as (limit, strict, legend, (r, g, b)), first hit wins;
# the last step takes the rest.
INDEX_RAMPS = {
    "ndvi": [
        (0.60, True, "Dense Vegetation (0.6 - 1.0)", (21, 128, 61)),
        (0.40, True, "Moderate Canopy (0.4 - 0.6)", (74, 222, 128)),
        (0.20, True, "Sparse / Grass (0.2 - 0.4)", (250, 204, 21)),
        (0.0, False, "Bare Soil (0.0 - 0.2)", (180, 83, 9)),
        (None, False, "Water / Saturated (< 0.0)", (14, 116, 144)),
    ],
    "ndwi": [
        (0.10, True, "Deep Water (> 0.1)", (2, 132, 199)),
        (0.0, True, "Shallow / Turbid Water (0.0 - 0.1)", (56, 189, 248)),
        (-0.20, False, "Wetland / Saturated Soil (-0.2 - 0.0)", (16, 185, 129)),
        (None, False, "Dry / Terrestrial (< -0.2)", (51, 65, 85)),
    ],
    "ndbi": [
        (0.20, True, "High-Density Built-up (> 0.2)", (225, 29, 72)),
        (0.0, True, "Medium Built-up (0.0 - 0.2)", (249, 115, 22)),
        (-0.20, False, "Barren / Mixed Surface (-0.2 - 0.0)", (148, 163, 184)),
        (None, False, "Natural / Vegetated (< -0.2)", (34, 197, 94)),
    ],
}

EPSILON = 1e-6


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalized_difference(
    first: str | Column,
    second: str | Column,
    eps_mode: str = "replace",
    clip: bool = True,
    nan_to_zero: bool = True,
) -> Column:
    """(first - second) / (first + second) in DOUBLE.

    ``eps_mode`` "replace" swaps a zero denominator for a small constant, "add" always
    adds it. A NULL band gives NULL; a NaN result gives 0 unless ``nan_to_zero`` is off,
    then NULL.
    """
    a, b = _col(first).cast("double"), _col(second).cast("double")
    total = a + b
    if eps_mode == "replace":
        total = F.when(total == 0, F.lit(EPSILON)).otherwise(total)
    elif eps_mode == "add":
        total = total + F.lit(EPSILON)
    else:
        raise ValueError(f"eps_mode must be 'replace' or 'add', not {eps_mode!r}")
    ratio = (a - b) / total
    ratio = F.nanvl(ratio, F.lit(0.0) if nan_to_zero else F.lit(None).cast("double"))
    if clip:
        ratio = F.when(ratio.isNotNull(), F.least(F.greatest(ratio, F.lit(-1.0)), F.lit(1.0)))
    return ratio


def index_column(index: str, **options) -> Column:
    """Index expression over the standard band columns of a pixel table."""
    first, second = INDEX_BANDS[index]
    return normalized_difference(first, second, **options)


def ndvi(nir: str | Column = "b08", red: str | Column = "b04", **options) -> Column:
    return normalized_difference(nir, red, **options)


def ndwi(green: str | Column = "b03", nir: str | Column = "b08", **options) -> Column:
    return normalized_difference(green, nir, **options)


def ndbi(swir: str | Column = "b11", nir: str | Column = "b08", **options) -> Column:
    return normalized_difference(swir, nir, **options)


def index_class(index: str, value: str | Column) -> Column:
    """Three-way class name of an index value."""
    high, low, top, middle, bottom = INDEX_CLASSES[index]
    v = _col(value)
    return F.when(v > high, top).when(v >= low, middle).when(v < low, bottom)


def ramp_class(index: str, value: str | Column) -> Column:
    """STRUCT<legend, r, g, b> of the colour ramp step an index value falls into."""
    v = _col(value)
    chain = None
    for limit, strict, legend, (r, g, b) in INDEX_RAMPS[index]:
        step = F.struct(
            F.lit(legend).alias("legend"), F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b")
        )
        if limit is None:
            hit = v.isNotNull()
        else:
            hit = (v > limit) if strict else (v >= limit)
        chain = F.when(hit, step) if chain is None else chain.when(hit, step)
    return chain


def bare_land(v_ndvi: str | Column, v_ndwi: str | Column, v_ndbi: str | Column) -> Column:
    """Bare, dry and unbuilt ground by the three indices."""
    return (_col(v_ndvi) < 0.25) & (_col(v_ndwi) < 0.0) & (_col(v_ndbi) < 0.15)


def delta_class(delta: str | Column, band: float = 0.10) -> Column:
    """improved / stable / declined by an index difference."""
    d = _col(delta)
    return F.when(d > band, "improved").when(d < -band, "declined").when(d.isNotNull(), "stable")


def clipped_delta(after: str | Column, before: str | Column) -> Column:
    d = _col(after) - _col(before)
    return F.when(d.isNotNull(), F.least(F.greatest(d, F.lit(-1.0)), F.lit(1.0)))
