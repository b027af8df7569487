"""Optical pixel expressions: brightness, class masks, fixed-gain display, blending."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def luminance(r: str | Column = "r", g: str | Column = "g", b: str | Column = "b") -> Column:
    return _c(r) * 0.299 + _c(g) * 0.587 + _c(b) * 0.114


def excess_green(r: str | Column = "r", g: str | Column = "g", b: str | Column = "b") -> Column:
    return _c(g) * 2.0 - _c(r) - _c(b)


# Limits of the class masks on reflectance 0..1. A class holds where every limit of one line holds.
REFLECTANCE_LIMITS = {
    "vegetation": [[("g - 1.15 r", ">", 0.0), ("g", ">", 0.20)]],
    "water": [[("b - 1.3 r", ">", 0.0), ("r", "<", 0.25), ("g", "<", 0.35)]],
    "urban": [[("r", ">", 0.25), ("g", ">", 0.25), ("b", ">", 0.25)]],
    "cloud_or_haze": [[("r", ">", 0.85), ("g", ">", 0.85), ("b", ">", 0.85)]],
}

# Limits of the target masks on 0..255 colour, in the same form.
TARGET_LIMITS = {
    "trees": [
        [("g - r", ">", 2.0), ("g - b", ">", 0.0), ("excess green", ">", 4.0)],
        [("luminance", "<", 75.0), ("g - r", ">=", -8.0), ("b", "<", 65.0), ("luminance", ">", 20.0)],
    ],
    "track": [[("r", ">", 165.0), ("r - g", ">", 40.0), ("r - b", ">", 70.0)]],
    "sports": [
        [("r", ">", 165.0), ("r - g", ">", 40.0), ("r - b", ">", 70.0)],
        [("excess green", ">", 14.0), ("g - r", ">", 8.0), ("luminance", ">", 60.0), ("luminance", "<", 210.0)],
    ],
    "water": [
        [("luminance", "<", 55.0), ("b - r", ">=", -4.0)],
        [("b - r", ">", 15.0), ("g - r", ">", 8.0), ("luminance", "<", 120.0)],
    ],
    "urban": [[("luminance", ">", 180.0), ("|r - g|", "<", 30.0), ("|g - b|", "<", 30.0), ("excess green", "<=", 10.0)]],
}


def _within(lines: list, r: Column, g: Column, b: Column) -> Column:
    """Whether all limits of any line hold."""
    quantities = {
        "r": r,
        "g": g,
        "b": b,
        "g - r": g - r,
        "r - g": r - g,
        "g - b": g - b,
        "b - r": b - r,
        "r - b": r - b,
        "g - 1.15 r": g - r * 1.15,
        "b - 1.3 r": b - r * 1.3,
        "|r - g|": F.abs(r - g),
        "|g - b|": F.abs(g - b),
        "luminance": luminance(r, g, b),
        "excess green": excess_green(r, g, b),
    }
    test = {">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__}
    lines = [[test[sign](quantities[name], F.lit(bound)) for name, sign, bound in line] for line in lines]
    return reduce(Column.__or__, [reduce(Column.__and__, line) for line in lines])


def reflectance_masks(r: str | Column = "r", g: str | Column = "g", b: str | Column = "b") -> dict[str, Column]:
    """Class masks on reflectance 0..1; vegetation is never urban."""
    masks = {name: _within(lines, _c(r), _c(g), _c(b)) for name, lines in REFLECTANCE_LIMITS.items()}
    return masks | {"urban": masks["urban"] & ~masks["vegetation"]}


def track_mask(r: str | Column = "r", g: str | Column = "g", b: str | Column = "b") -> Column:
    """Red athletic surface on 0..255 colour."""
    return _within(TARGET_LIMITS["track"], _c(r), _c(g), _c(b))


def target_mask(feature: str, r: str | Column = "r", g: str | Column = "g", b: str | Column = "b") -> Column:
    """Seed mask of a target on 0..255 colour: trees, sports, water or urban."""
    if feature not in ("trees", "sports", "water", "urban"):
        raise ValueError(f"unknown feature {feature!r}")
    return _within(TARGET_LIMITS[feature], _c(r), _c(g), _c(b))


# Words that name a target, in the order they are tried.
FEATURE_WORDS = {
    "trees": ["tree", "trees", "forest", "dense vegetation", "canopy", "woodland", "jungle"],
    "sports": [
        "playground", "stadium", "sports", "track", "court", "pitch", "arena", "open ground",
        "running track", "field", "baseball",
    ],
    "water": ["water", "ocean", "sea", "river", "bay", "basin", "hydrology", "pond", "lake"],
    "urban": [
        "urban", "city", "building", "buildings", "built", "structure", "settlement", "houses", "roof", "rooftops",
    ],
}


def feature_of(text: str | Column) -> Column:
    """Target named by a phrase, NULL when none is."""
    lowered = F.lower(F.col(text) if isinstance(text, str) else text)
    chain = None
    for feature, words in FEATURE_WORDS.items():
        hit = lowered.rlike("|".join(words))
        chain = F.when(hit, feature) if chain is None else chain.when(hit, feature)
    return chain


def to_byte(value: Column) -> Column:
    """Clip to 0..255 and drop the fraction."""
    return F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(255.0))).cast("int")


# Display gain per composite.
DISPLAY_GAIN = {"true_color": 2.5, "false_color_nir": 2.2}
DISPLAY_BANDS = {"true_color": ("b04", "b03", "b02"), "false_color_nir": ("b08", "b04", "b03")}


def display_rgb(kind: str) -> list[Column]:
    """Fixed-gain 8-bit r, g, b columns of a reflectance pixel table."""
    gain = DISPLAY_GAIN[kind]
    return [to_byte(_c(band) * gain * 255.0).alias(name) for name, band in zip("rgb", DISPLAY_BANDS[kind])]


def blend(optical: str | Column, radar: str | Column, w_optical: float = 0.55, w_radar: float = 0.45) -> Column:
    """Weighted 8-bit blend of an optical and a radar channel."""
    return to_byte(_c(optical) * w_optical + _c(radar) * w_radar)
