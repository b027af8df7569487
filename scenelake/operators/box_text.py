"""Boxes out of model-output text, and merging them with boxes found otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions.boxes import is_degenerate, is_unreliable, normalize_box

# Patterns of boxes in text, label lead words, palette, default score.
TOKEN = r"\{\s*<(\d+)>\s*<(\d+)>\s*<(\d+)>\s*<(\d+)>(?:\s*\|\s*<?(\d+)>?)?\s*\}"
CLUSTER = r"(?:<p>(.*?)</p>|([A-Za-z\s\-]{2,35}))?\s*((?:" + TOKEN + r"\s*(?:<delim>)?\s*)+)"
LABELLED_BRACKET = r"[A-Za-z\s]{0,40}:?\s*\[\s*(\d+(?:\.\d+)?)\s*,\s*(\d+(?:\.\d+)?)\s*,\s*(\d+(?:\.\d+)?)\s*,\s*(\d+(?:\.\d+)?)\s*\]"
LABEL_LEAD = r"(?i)^(there are|there is|in the|here are|some|all|the|a|an)\s+"
PALETTE = ["#10b981", "#06b6d4", "#38bdf8", "#f59e0b", "#ec4899", "#8b5cf6", "#14b8a6"]
DEFAULT_SCORE = 0.92

_BOX = "STRUCT<label: STRING, confidence: DOUBLE, box: STRUCT<ymin: DOUBLE, xmin: DOUBLE, ymax: DOUBLE, xmax: DOUBLE>>"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _entry(label: Column, score: Column, box: Column) -> Column:
    return F.struct(label.alias("label"), score.alias("confidence"), box.alias("box"))


def _numbers(match: Column, pattern: str) -> Column:
    """All numbers of one match as doubles, so that later steps do not parse again."""
    return F.transform(F.regexp_extract_all(match, F.lit(pattern), F.lit(0)), lambda n: n.cast("double"))


def _token_boxes(text: Column, default_label: str, digits: int | None) -> Column:
    def named(c: Column) -> Column:
        label = F.coalesce(_part(c, CLUSTER, 1), _part(c, CLUSTER, 2), F.lit(default_label))
        clean = F.initcap(_strip(F.regexp_replace(_strip(label), LABEL_LEAD, "")))
        tokens = F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), lambda t: _numbers(t, r"\d+"))
        return F.struct(clean.alias("label"), tokens.alias("tokens"))

    def boxes(c: Column) -> Column:
        label = F.when(F.length(c["label"]) < 2, default_label).otherwise(c["label"])

        def token(n: Column) -> Column:
            score = F.coalesce(F.get(n, F.lit(4)) / 100.0, F.lit(DEFAULT_SCORE))
            return _entry(label, F.round(score, 2), normalize_box(n[0], n[1], n[2], n[3], fmt="token", digits=digits))

        return F.transform(c["tokens"], token)

    clusters = F.transform(F.regexp_extract_all(text, F.lit(CLUSTER), F.lit(0)), named)
    return F.when(text.contains("{"), F.flatten(F.transform(clusters, boxes))).otherwise(F.array().cast(f"ARRAY<{_BOX}>"))


def _bracket_boxes(text: Column, default_label: str, width, height, digits: int | None) -> Column:
    def parsed(m: Column) -> Column:
        words = _strip(F.regexp_extract(m, r"^[A-Za-z\s]*", 0))
        return F.struct(words.alias("words"), _numbers(m, r"\d+(?:\.\d+)?").alias("n"))

    def bracket(p: Column) -> Column:
        label = F.when(F.length(p["words"]) > 2, p["words"]).otherwise(default_label)
        n = p["n"]
        box = normalize_box(n[0], n[1], n[2], n[3], width=width, height=height, digits=digits)
        return _entry(label, F.lit(DEFAULT_SCORE), box)

    boxes = F.transform(F.transform(F.regexp_extract_all(text, F.lit(LABELLED_BRACKET), F.lit(0)), parsed), bracket)
    return F.when(text.contains("["), boxes).otherwise(F.array().cast(f"ARRAY<{_BOX}>"))


def extract_boxes(
    df: DataFrame,
    text: str = "text",
    width: str | None = None,
    height: str | None = None,
    default_label: str = "Detected Target",
    digits: int | None = 2,
) -> DataFrame:
    """One row per box found in each text: position, label, confidence, color, ymin..xmax.

    Box tokens go first; bracketed numbers count only in texts without tokens. Works row by
    row without a shuffle.
    """
    t = F.col(text)

    def usable(boxes: Column) -> Column:
        return F.filter(
            boxes, lambda b: ~is_degenerate(b["box"]["ymin"], b["box"]["xmin"], b["box"]["ymax"], b["box"]["xmax"])
        )

    found = df.withColumn("_tokens", usable(_token_boxes(t, default_label, digits)))
    brackets = usable(_bracket_boxes(t, default_label, width, height, digits))
    found = found.withColumn("_boxes", F.when(F.size("_tokens") > 0, F.col("_tokens")).otherwise(brackets)).drop("_tokens")
    opened = found.select(*df.columns, F.posexplode("_boxes").alias("position", "b"))
    palette = F.array(*[F.lit(c) for c in PALETTE])
    return opened.select(
        *df.columns,
        "position",
        F.col("b.label").alias("label"),
        F.col("b.confidence").alias("confidence"),
        F.get(palette, F.col("position") % len(PALETTE)).alias("color"),
        "b.box.*",
    )


def reliable_boxes(boxes: DataFrame) -> DataFrame:
    """Without small boxes of the centre fallback patch."""
    return boxes.filter(~is_unreliable())


def merge_boxes(
    anchors: DataFrame, parsed: DataFrame, gap: float = 8.0, cap: int | None = None, image: str = "image_id", order: str = "ord"
) -> DataFrame:
    """Anchor boxes of an image plus parsed boxes that are not near a kept one, in their order.

    Images without an anchor keep all their parsed boxes. The boxes of one image, which one model output names, meet in
    one row and are walked once. ``cap``: at most so many boxes for an image with anchors.
    """
    fields = ["ymin", "xmin", "ymax", "xmax", "label"]
    entry = F.struct(F.col(order).alias("ord"), *fields)
    kept = anchors.groupBy(image).agg(F.sort_array(F.collect_list(entry)).alias("kept"))
    waiting = parsed.groupBy(image).agg(F.sort_array(F.collect_list(entry)).alias("waiting"))

    def step(acc: Column, p: Column) -> Column:
        near = F.exists(acc, lambda k: (F.abs(k["ymin"] - p["ymin"]) < gap) & (F.abs(k["xmin"] - p["xmin"]) < gap))
        full = F.size(acc) >= cap if cap is not None else F.lit(False)
        return F.when(near | full, acc).otherwise(F.concat(acc, F.array(p)))

    both = kept.join(waiting, image, "full")
    walked = F.aggregate(F.coalesce("waiting", F.expr("slice(kept, 1, 0)")), F.col("kept"), step)
    merged = both.withColumn("k", F.when(F.col("kept").isNull(), F.col("waiting")).otherwise(walked))
    return merged.select(image, F.explode("k").alias("k")).select(image, "k.ord", *[f"k.{f}" for f in fields])
