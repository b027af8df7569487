"""Candidate regions of land searches: persistence, ranking, roll-ups, follow-ups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions.text import any_word
from scenelake.operators.ranking import rank_within
from scenelake.session import cut_lineage, spread

MIN_AREA_HECTARES = 0.5
LARGE_HECTARES = 3.0
PERSISTENT_RATIO = 0.80

# Follow-up words.
FOLLOWUP_AREA = r"(?:larger than|greater than|above|minimum)\s+(\d+(?:\.\d+)?)\s*(?:hectares?|ha)"
FOLLOWUP_NEAREST = ["closest", "nearest", "near to"]
FOLLOWUP_PERSISTENT = ["persistent", "last year", "consistent"]


def persistence(px: DataFrame, holds: Column, date: str, keys: Sequence[str] = ("scene_id", "row", "col")) -> DataFrame:
    """k of n observation dates on which a condition holds, per cell.

    One shuffle by cell serves both steps: rows of one date are folded first, then dates. Four hash tables of a
    partition are held at once, so partitions are not merged.
    """
    placed = spread(px.select(*keys, F.col(date).alias("date"), holds.alias("holds")), *keys)
    dated = placed.groupBy(*keys, "date").agg(F.bool_or("holds").alias("holds"))
    cells = dated.groupBy(*keys).agg(
        F.count("*").alias("observations"), F.count_if("holds").alias("hits"), F.max("date").alias("last_date")
    )
    ratio = F.col("hits") / F.col("observations")
    label = F.when(ratio >= PERSISTENT_RATIO, "high").when(ratio >= 0.5, "medium").otherwise("low")
    return cells.withColumns(
        {
            "persistence_ratio": ratio,
            "temporal_persistence": F.format_string("%d/%d observations", "hits", "observations"),
            "persistence_label": label,
        }
    )


def persistent_cells(
    px: DataFrame, conditions: dict[str, Column], date: str, min_ratio: float, keys: Sequence[str] = ("scene_id", "row", "col")
) -> DataFrame:
    """(target, cell, hits, observations) of the cells that show a target on enough of their dates.

    All targets share one shuffle by cell; only cells that pass become rows.
    """
    # one number holds what a row shows, a bit for each target
    bit = {t: F.lit(1 << i).cast("bigint") for i, t in enumerate(conditions)}
    shows = [F.when(c, bit[t]).otherwise(F.lit(0).cast("bigint")) for t, c in conditions.items()]
    bits = reduce(lambda x, y: x.bitwiseOR(y), shows)
    placed = spread(px.select(*keys, F.col(date).alias("date"), bits.alias("bits")), *keys)
    dated = placed.groupBy(*keys, "date").agg(F.bit_or("bits").alias("bits"))
    cells = dated.groupBy(*keys).agg(F.count("*").alias("observations"), *[F.count_if(F.col("bits").bitwiseAND(bit[t]) != 0).alias(t) for t in conditions])
    rows = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("hits")) for t in conditions])
    passed = F.filter(rows, lambda r: r["hits"] / F.col("observations") >= min_ratio)
    return cells.select(*keys, "observations", F.inline(passed))


def minimum_area(cand: DataFrame, hectares: float | str | Column = MIN_AREA_HECTARES) -> DataFrame:
    """Candidates of at least a size."""
    size = F.col(hectares) if isinstance(hectares, str) else (hectares if isinstance(hectares, Column) else F.lit(float(hectares)))
    return cand.filter(F.col("area_hectares") >= size)


def _primary(criteria: str) -> tuple[Column, list[tuple[str, Column]]]:
    if criteria == "distance_asc":
        return F.col("distance_km"), []
    if criteria == "persistence_desc":
        return -F.col("persistence_ratio"), [("_by_area", -F.col("area_hectares"))]
    if criteria == "confidence_desc":
        return -F.col("confidence_score"), []
    return -F.col("area_hectares"), []


def rank_candidates(
    cand: DataFrame, criteria: str = "area_desc", keys: Sequence[str] = ("search_id",), order: str = "cand_id"
) -> DataFrame:
    """Dense 1..n rank per search by area, distance, persistence or confidence; ties by ``order``."""
    first, more = _primary(criteria)
    extended = cand.withColumns(dict(more)) if more else cand
    ranked = rank_within(extended, keys, first, [*[name for name, _ in more], order])
    return ranked.drop(*[name for name, _ in more])


def nearest(cand: DataFrame, keys: Sequence[str] = ("search_id",), order: str = "cand_id") -> DataFrame:
    """Closest candidate of each search."""
    rest = [c for c in cand.columns if c not in keys]
    far = F.coalesce(to_the_metre("distance_km"), F.lit(float("inf")))
    return cand.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(far, order)).alias("_best")).select(*keys, "_best.*")


def rollup(cand: DataFrame, keys: Sequence[str] = ("search_id",), order: str = "cand_id") -> DataFrame:
    """Count, total hectares, count of large ones and the largest candidate per search."""
    return cand.groupBy(*keys).agg(
        F.count("*").alias("candidates"),
        F.sum("area_hectares").alias("total_hectares"),
        F.count_if(F.col("area_hectares") >= LARGE_HECTARES).alias("large_candidates"),
        F.min_by(order, F.struct(-F.coalesce("area_hectares", F.lit(float("-inf"))), order)).alias("largest"),
    )


def to_the_metre(km: str | Column) -> Column:
    """Kilometres rounded to the metre: what the last bits of equal distances say must not decide an order."""
    return F.round(F.col(km) if isinstance(km, str) else km, 3)


def refine_candidates(
    cand: DataFrame, prompts: DataFrame, keys: Sequence[str] = ("search_id",), order: str = "cand_id"
) -> DataFrame:
    """Candidates after a follow-up prompt per search, with their position.

    The first rule that matches wins: minimum area keeps the large ones, nearest sorts by
    distance to the metre (then by ``order``), persistence keeps the lasting ones, else nothing changes.
    """
    text = F.lower("prompt")
    area = F.nullif(F.regexp_extract(text, FOLLOWUP_AREA, 1), F.lit("")).cast("double")
    rule = (
        F.when(area.isNotNull(), "area")
        .when(any_word(text, FOLLOWUP_NEAREST), "nearest")
        .when(any_word(text, FOLLOWUP_PERSISTENT), "persistence")
        .otherwise("none")
    )
    asked = prompts.select(*keys, rule.alias("rule"), area.alias("threshold"))
    joined = cand.join(asked, list(keys))
    kept = joined.filter(
        ((F.col("rule") != "area") | (F.col("area_hectares") >= F.col("threshold")))
        & ((F.col("rule") != "persistence") | (F.col("persistence_ratio") >= PERSISTENT_RATIO))
    )
    by = F.when(F.col("rule") == "nearest", to_the_metre("distance_km")).otherwise(0.0)
    return rank_within(kept, keys, by, [order], out="position")


#: Each side of ``hand_out`` is dealt into so many parts, every one of which meets all parts of the other side.
PARTS = 4


def hand_out(shared: DataFrame, searches: DataFrame, key: str, parts: int = PARTS) -> DataFrame:
    """Rows of each ``key`` for every search of that key, without the key.

    Few rows on both sides make many: partitions are not merged, and the rows and searches of one key are dealt over several.
    """
    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64(*df.columns), F.lit(parts)).cast("int")
        return spread(df.withColumn(own, part).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), key, "_x", "_y")

    return dealt(searches, "_x", "_y").join(dealt(shared, "_y", "_x"), [key, "_x", "_y"]).drop(key, "_x", "_y")


def shared_searches(searches: DataFrame, prompts: DataFrame) -> DataFrame:
    """search_id, group, specs, said: searches of the same requests with the same prompts have the same group.

    ``searches``: search_id, spec; ``prompts``: search_id, prompt. Both may repeat a search.
    """
    asked = searches.groupBy("search_id").agg(F.array_sort(F.collect_list("spec")).alias("specs"))
    said = prompts.groupBy("search_id").agg(F.array_sort(F.collect_list(F.struct("prompt"))).alias("said"))
    return cut_lineage(asked.join(said, "search_id").withColumn("group", F.sha2(F.to_json(F.struct("specs", "said")), 256)))


def refine_shared(shared: DataFrame, grouped: DataFrame, order: str = "cand_id") -> DataFrame:
    """``refine_candidates`` once per group of ``shared_searches``, from the candidates of each spec."""
    groups = grouped.select("group", "specs", "said").dropDuplicates(["group"])
    cand = groups.select("group", F.explode("specs").alias("spec")).join(shared, "spec").drop("spec")
    return refine_candidates(cand, groups.select("group", F.inline("said")), ("group",), order)


def refine_reply(refined: DataFrame, keys: Sequence[str] = ("search_id",)) -> DataFrame:
    """Reply text per search for rows of ``refine_candidates``."""
    first = F.max_by(F.struct("name", "distance_km", "area_hectares"), -F.col("position")).alias("top")
    folded = refined.groupBy(*keys, "rule", "threshold").agg(F.count("*").alias("count"), first)
    reply = (
        F.when(F.col("rule") == "area", F.format_string("%d candidate area(s) larger than %s hectares.", "count", "threshold"))
        .when(
            F.col("rule") == "nearest",
            F.format_string("The closest candidate is '%s', %.1f km away (%.1f ha).", "top.name", "top.distance_km", "top.area_hectares"),
        )
        .when(F.col("rule") == "persistence", F.format_string("%d candidate(s) stay bare across most observations.", "count"))
        .otherwise(F.format_string("%d candidate areas remain active.", "count"))
    )
    return folded.select(*keys, "rule", "count", reply.alias("reply"))
