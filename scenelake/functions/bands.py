"""Band role of a raster band from its description, position and file name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Description patterns by role, tried in this order on the lower-cased description.
ROLE_PATTERNS = [
    ("VV", r"\b(vv|co-pol|co_pol)\b|copol"),
    ("VH", r"\b(vh|cross-pol|cross_pol)\b|crosspol"),
    ("HH", r"\bhh\b"),
    ("HV", r"\bhv\b"),
    ("B01", r"\b(b01|b1|coastal)\b"),
    ("B02", r"\b(b02|b2|blue)\b"),
    ("B03", r"\b(b03|b3|green)\b"),
    ("B04", r"\b(b04|b4|red)\b"),
    ("B05", r"\b(b05|b5|rededge1|red_edge_1)\b"),
    ("B06", r"\b(b06|b6|rededge2|red_edge_2)\b"),
    ("B07", r"\b(b07|b7|rededge3|red_edge_3)\b"),
    ("B08", r"\b(b08|b8|nir|near_infrared|near-infrared)\b"),
    ("B8A", r"\b(b8a|narrow_nir|narrow-nir)\b"),
    ("B09", r"\b(b09|b9|watervapour|water_vapour)\b"),
    ("B11", r"\b(b11|swir1|swir_1|swir-1)\b"),
    ("B12", r"\b(b12|swir2|swir_2|swir-2)\b"),
]

# Roles by position for stacks of a known size.
STACK_12 = ["B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B09", "B11", "B12"]
STACK_6 = ["B02", "B03", "B04", "B08", "B11", "B12"]
STACK_4 = ["B04", "B03", "B02", "B08"]
STACK_4_NAMED = ["B04", "B08", "B11", "B12"]
STACK_3 = ["Red", "Green", "Blue"]
STACK_2 = ["VV", "VH"]

# File-name hints.
NAMED_STACK_HINT = r"b04|b4|b08|b8"
RADAR_BAND_HINT = r"vv|vh|sar|s1|grd|slc|sigma0|risat"
SINGLE_BAND_HINTS = ["b02", "b03", "b04", "b08", "b11", "b12"]
RADAR_FILE_HINT = r"sar|sentinel-1|s1|risat|sigma0|backscatter"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _nth(names: list[str], idx: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), idx - 1)


def band_role(
    desc: str | Column = "description",
    idx: str | Column = "band_idx",
    total: str | Column = "total_bands",
    filename: str | Column = "filename",
) -> Column:
    """Role of one band; description first, then the position in a stack of known size."""
    text = F.lower(F.trim(F.coalesce(_c(desc), F.lit(""))))
    name = F.lower(F.coalesce(_c(filename), F.lit("")))
    i, n = _c(idx).cast("int"), _c(total).cast("int")
    chain: Column | None = None
    for role, pattern in ROLE_PATTERNS:
        hit = text.rlike(pattern)
        if role == "B08":
            hit = hit & ~text.contains("b8a")
        chain = F.when(hit, role) if chain is None else chain.when(hit, role)
    chain = chain.when((n >= 12) & (i <= 12), _nth(STACK_12, i))
    chain = chain.when((n == 6) & (i <= 6), _nth(STACK_6, i))
    chain = chain.when((n == 4) & name.rlike(NAMED_STACK_HINT), _nth(STACK_4_NAMED, i))
    chain = chain.when(n == 4, _nth(STACK_4, i)).when(n == 3, _nth(STACK_3, i)).when(n == 2, _nth(STACK_2, i))
    single = F.when(name.rlike(RADAR_BAND_HINT), F.when(name.contains("vh"), "VH").otherwise("VV"))
    for hint in SINGLE_BAND_HINTS:
        single = single.when(name.contains(hint), hint.upper())
    return F.coalesce(chain.when(n == 1, single.otherwise("Pan")), F.lit("Unknown"))
