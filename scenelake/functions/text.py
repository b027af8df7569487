"""Display texts and model-output cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def size_text(n_bytes: str | Column) -> Column:
    """KB below one MiB, else MB; exact halves go to the even digit."""
    n = _c(n_bytes)
    return F.when(n < 1024 * 1024, F.format_string("%.1f KB", F.bround(n / 1024.0, 1))).otherwise(
        F.format_string("%.2f MB", F.bround(n / 1048576.0, 2))
    )


def percent_text(value: str | Column) -> Column:
    """One digit, exact halves to the even digit."""
    return F.format_string("%.1f%%", F.bround(_c(value).cast("double"), 1))


def signed_text(value: str | Column, digits: int = 3) -> Column:
    return F.format_string(f"%+.{digits}f", _c(value).cast("double"))


def confidence_text(value: str | Column) -> Column:
    return F.format_string("%d%%", F.floor(_c(value) * 100.0).cast("int"))


# Replacements that turn raw model output into plain text, in order.
CLEANING = [
    (r"\{\s*<\d+>\s*<\d+>\s*<\d+>\s*<\d+>(?:\s*\|\s*<?\d+>?)?\s*\}", ""),
    (r"<delim>", ""),
    (r"<p>(.*?)</p>", "$1"),
    (r"<box>.*?</box>", ""),
    (r"\s{2,}", " "),
    (r"\s+([.,;:!?])", "$1"),
]


def clean_output(text: str | Column) -> Column:
    """Model output without box tokens and tags."""
    c = F.coalesce(_c(text), F.lit(""))
    for pattern, replacement in CLEANING:
        c = F.regexp_replace(c, pattern, replacement)
    return F.regexp_replace(c, r"^\s+|\s+$", "")


# Leading words dropped from a grounding request.
TARGET_LEAD = r"(?i)^(highlight|show|find|locate|detect|segment|where is|where are|the|all)\s+"


def target_phrase(text: str | Column) -> Column:
    """Grounding request without its leading verb."""
    trimmed = F.trim(_c(text))
    return F.trim(F.regexp_replace(trimmed, TARGET_LEAD, ""))


# Keyword groups of grounding requests.
GROUNDING_WORDS = {
    "playground": [
        "playground", "stadium", "sports", "track", "court", "pitch", "field", "baseball", "arena", "running track", "open ground",
    ],
    "vegetation": ["vegetat", "tree", "forest", "crop", "canopy", "agriculture", "farm", "green", "woodland", "jungle"],
    "urban": ["built", "urban", "building", "structure", "city", "industrial", "settlement", "house", "roof", "rooftops"],
    "water": ["water", "lake", "river", "pond", "reservoir", "ocean", "sea", "inlet", "hydrolog"],
    "vacant_bare": ["bare", "vacant", "empty", "unused", "cleared", "soil", "uncultivated"],
    "sar_strong": ["strong sar", "backscatter", "radar", "double bounce", "double-bounce", "high backscatter"],
}


def any_word(lowered: Column, words: list[str]) -> Column:
    """Lower-cased text holds one of the words, also inside longer words."""
    hit = F.lit(False)
    for word in words:
        hit = hit | lowered.contains(word)
    return hit


def grounding_flags(text: str | Column) -> dict[str, Column]:
    """One boolean per keyword group."""
    lowered = F.lower(_c(text))
    return {f"is_{name}": any_word(lowered, words) for name, words in GROUNDING_WORDS.items()}
