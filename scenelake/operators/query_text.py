"""Fields and tasks out of a log of natural-language requests, as column jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions.text import any_word
from scenelake.operators.gazetteer import match_places

HECTARES_PER_ACRE = 0.40468564224

# Tasks, their tools, and the words that pick them, in the order they are tried.
TASK_TOOLS = {
    "SINGLE_VQA": ["SingleImageVQA"],
    "SINGLE_CAPTION": ["Captioning"],
    "GROUNDING": ["Grounding"],
    "TEMPORAL_CHANGE": ["ChangeDetection"],
    "OPTICAL_SAR": ["OpticalSAR"],
    "GENERAL_ANALYSIS": ["SingleImageVQA", "SpectralAnalysis"],
}
COMPOUND_TOOLS = ["ChangeDetection", "SpectralAnalysis", "SingleImageVQA"]
CROSS_MODAL_WORDS = ["sar and optical", "optical and sar", "cross-modal", "radar and optical"]
COMPOUND_WORDS = ["has vegetation decreased", "vegetation change", "where did change occur"]
TWO_DATE_WORDS = ["between", "dates"]
CHANGE_WORDS = ["change", "differ", "before and after", "temporal", "increased", "decreased"]
GROUNDING_WORDS = [
    "highlight", "ground", "where is", "where are", "locate", "find the", "find", "bounding box", "draw box",
    "delineate", "show me", "mark",
]
CAPTION_WORDS = ["describe", "caption", "what land-cover", "overview", "summarize scene"]
AUTO_CAPTION_WORDS = ["describe", "caption", "overview", "what land-cover", "summarize scene"]
AUTO_GROUNDING_WORDS = [
    "find", "locate", "highlight", "ground", "where is", "where are", "box", "detect", "segment", "show",
    "tree", "trees", "forest", "canopy", "vegetation", "playground", "playgrounds", "stadium", "sports",
    "building", "buildings", "urban", "houses", "water", "river", "lake", "pond", "crop", "farm", "ships",
]

# Words and defaults of land searches.
UNSUPPORTED_WORDS = [
    "buy", "purchase", "price", "cost", "owner", "ownership", "legal status", "title deed", "tax value", "for sale",
]
LOCATION_PATTERN = r"(?i)\b(?:around|near|in|of|at|within \d+ km of)\s+([A-Za-z]+)\b"
NOT_A_LOCATION = [
    "large", "small", "poor", "low", "high", "new", "empty", "vacant", "bare", "vegetation", "water", "built", "10", "5",
    "20", "from", "to", "between",
]
RADIUS_PATTERN = r"within\s+(\d+(?:\.\d+)?)\s*km"
AREA_PATTERN = r"(?:larger than|greater than|above|minimum)\s+(\d+(?:\.\d+)?)\s*(hectares?|ha|acres?)"
YEAR_PATTERN = r"\b(201\d|202\d)\b"
NEAREST_WORDS = ["closest", "nearest", "close to", "near to"]
LARGEST_WORDS = ["largest", "biggest", "large"]
PERSISTENT_WORDS = ["persistent", "permanently", "consistent"]
SEARCH_CHANGE_WORDS = ["change", "changed", "converted", "difference", "compare", "transition"]
VACANT_WORDS = ["vacant", "empty", "bare", "unused", "open land", "barren"]
VEGETATION_WORDS = ["vegetation", "crop", "agriculture", "forest", "green", "canopy", "plant", "flora"]
POOR_WORDS = ["poor", "low", "stress", "unhealthy", "loss", "decline"]
WATER_WORDS = ["water", "river", "lake", "pond", "reservoir", "canal", "wetland"]
BUILT_WORDS = ["built-up", "building", "development", "developed", "urban", "construction", "industrial"]
DEFAULT_FROM_YEAR, DEFAULT_TO_YEAR = 2024, 2026

# Words and defaults of scene retrievals.
RETRIEVAL_LOCATION = r"(?i)(?:compare|in|around|at|for)\s+([A-Za-z\s]+?)(?:\s+between|\s+from|\s+in|\s+using|\s+during|$)"
RETRIEVAL_YEAR = r"\b(201[5-9]|202[0-9])\b"
MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
]
RADAR_WORDS = r"\b(sar|radar|backscatter)\b|sentinel-1"
RETRIEVAL_CHANGE_WORDS = ["compare", "change", "between", "difference"]

# Topics of questions about statistics.
TOPIC_WORDS = {
    "built": [
        "building", "built", "urban", "construction", "structure", "city", "industrial", "sipcot", "infrastructure", "impervious",
    ],
    "vegetation": ["vegetation", "crop", "agriculture", "tree", "forest", "green", "canopy", "farm", "flora", "plant"],
    "water": ["water", "river", "lake", "pond", "reservoir", "dam", "canal", "wetland", "flood", "aqua"],
}


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _number(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("double")


def route_tasks(
    df: DataFrame,
    text: str = "text",
    preferred: str | None = None,
    has_pair: str | None = None,
    has_optical_sar: str | None = None,
) -> DataFrame:
    """Add task, tools and is_multi_tool; an explicit valid task goes before the words."""
    q = F.lower(F.trim(F.col(text)))
    pair = F.coalesce(F.col(has_pair), F.lit(False)) if has_pair else F.lit(False)
    cross = F.coalesce(F.col(has_optical_sar), F.lit(False)) if has_optical_sar else F.lit(False)

    def plan(task: str, tools: list[str]) -> Column:
        return F.struct(F.lit(task).alias("task"), _strings(tools).alias("tools"))

    chain = None
    if preferred:
        wanted = F.upper(F.col(preferred))
        for task, tools in TASK_TOOLS.items():
            chain = (F.when if chain is None else chain.when)(wanted == task, plan(task, tools))
        chain = chain.when(wanted == "MULTI_TOOL", plan("MULTI_TOOL", ["SingleImageVQA"]))
    rules = [
        (cross | any_word(q, CROSS_MODAL_WORDS), "OPTICAL_SAR", TASK_TOOLS["OPTICAL_SAR"]),
        (any_word(q, COMPOUND_WORDS) & (pair | any_word(q, TWO_DATE_WORDS)), "TEMPORAL_CHANGE", COMPOUND_TOOLS),
        (pair | any_word(q, CHANGE_WORDS), "TEMPORAL_CHANGE", TASK_TOOLS["TEMPORAL_CHANGE"]),
        (any_word(q, GROUNDING_WORDS), "GROUNDING", TASK_TOOLS["GROUNDING"]),
        (any_word(q, CAPTION_WORDS), "SINGLE_CAPTION", TASK_TOOLS["SINGLE_CAPTION"]),
    ]
    for hit, task, tools in rules:
        chain = (F.when if chain is None else chain.when)(hit, plan(task, tools))
    routed = df.withColumn("_plan", chain.otherwise(plan("SINGLE_VQA", TASK_TOOLS["SINGLE_VQA"])))
    multi = (F.size("_plan.tools") > 1).alias("is_multi_tool")
    return routed.select(*df.columns, "_plan.task", "_plan.tools", multi)


def auto_task(text: str | Column) -> Column:
    """captioning, grounding or vqa for a request about one image."""
    q = F.lower(F.trim(F.col(text) if isinstance(text, str) else text))
    return (
        F.when(any_word(q, AUTO_CAPTION_WORDS), "captioning").when(any_word(q, AUTO_GROUNDING_WORDS), "grounding").otherwise("vqa")
    )


def parse_land_queries(df: DataFrame, gaz: DataFrame, text: str = "text") -> DataFrame:
    """Add the fields of a land search: intent, target, location, radius, area, years, ranking."""
    placed = match_places(df, gaz, text, "word")
    raw, q = F.trim(F.col(text)), F.lower(F.trim(F.col(text)))
    word = F.nullif(F.regexp_extract(raw, LOCATION_PATTERN, 1), F.lit(""))
    named = F.when(~F.lower(word).isin(*NOT_A_LOCATION), F.initcap(word))
    location = F.coalesce(F.initcap("place.key"), named)
    near = any_word(q, ["around", "near"])
    radius = F.coalesce(_number(q, RADIUS_PATTERN), F.when(near, 6.0).otherwise(5.0))
    unit = F.regexp_extract(q, AREA_PATTERN, 2)
    size = _number(q, AREA_PATTERN) * F.when(unit.startswith("acre"), HECTARES_PER_ACRE).otherwise(1.0)
    min_area = F.coalesce(size, F.when(q.contains("large"), 2.0))
    years = F.regexp_extract_all(q, F.lit(YEAR_PATTERN), F.lit(1))
    year1 = F.get(years, F.lit(0)).cast("int")
    year2 = F.coalesce(F.get(years, F.lit(1)).cast("int"), F.when(year1.isNotNull(), DEFAULT_TO_YEAR))
    ranking = (
        F.when(any_word(q, NEAREST_WORDS), "distance_asc")
        .when(any_word(q, LARGEST_WORDS), "area_desc")
        .when(any_word(q, PERSISTENT_WORDS), "persistence_desc")
        .otherwise("area_desc")
    )
    supported = ~any_word(q, UNSUPPORTED_WORDS)
    change = any_word(q, SEARCH_CHANGE_WORDS) | year1.isNotNull()

    def kind(intent: str, target: str | Column, analysis: str | None) -> Column:
        return F.struct(
            F.lit(intent).alias("intent"),
            (F.lit(target) if isinstance(target, str) else target).alias("target"),
            F.lit(analysis).cast("string").alias("analysis"),
        )

    health = F.when(any_word(q, POOR_WORDS), "low_vegetation_health").otherwise("healthy_vegetation")
    vacant = kind("vacant_land_search", "potentially_vacant_land", "bare_land_detection")
    fields = (
        F.when(~supported, kind("unsupported_query", "unsupported_legal_financial", None))
        .when(change, kind("temporal_change", "land_use_change", "ndvi_ndbi_change"))
        .when(any_word(q, VACANT_WORDS), vacant)
        .when(any_word(q, VEGETATION_WORDS), kind("vegetation_analysis", health, "ndvi"))
        .when(any_word(q, WATER_WORDS), kind("water_detection", "water_bodies", "ndwi"))
        .when(any_word(q, BUILT_WORDS), kind("built_up_detection", "built_up_infrastructure", "ndbi"))
        .otherwise(vacant)
    )
    reason = "Imagery shows physical surfaces; it cannot tell land ownership, legal status, prices or availability."
    return placed.withColumn("_kind", fields).select(
        *df.columns,
        "_kind.intent",
        "_kind.target",
        "_kind.analysis",
        F.when(supported, location).alias("location"),
        F.when(supported, radius).alias("radius_km"),
        F.when(supported, min_area).alias("minimum_area_hectares"),
        F.when(supported, ranking).alias("ranking_criteria"),
        F.when(supported & change, F.coalesce(year1, F.lit(DEFAULT_FROM_YEAR))).alias("from_year"),
        F.when(supported & change, F.coalesce(year2, F.lit(DEFAULT_TO_YEAR))).alias("to_year"),
        supported.alias("is_supported"),
        F.when(~supported, reason).alias("unsupported_reason"),
        F.col("place.lat").alias("lat"),
        F.col("place.lon").alias("lon"),
    )


def parse_retrieval_queries(df: DataFrame, gaz: DataFrame, text: str = "text") -> DataFrame:
    """Add location, the two wanted dates, sensor and task of a scene retrieval."""
    placed = match_places(df, gaz, text, "word")
    raw, q = F.trim(F.col(text)), F.lower(F.trim(F.col(text)))
    phrase = F.nullif(F.trim(F.regexp_extract(raw, RETRIEVAL_LOCATION, 1)), F.lit(""))
    titled = F.nullif(F.array_join(F.regexp_extract_all(raw, F.lit(r"\b([A-Z][a-z]+)\b"), F.lit(1)), " "), F.lit(""))
    years = F.transform(F.regexp_extract_all(raw, F.lit(RETRIEVAL_YEAR), F.lit(1)), lambda y: y.cast("int"))
    count = F.size(years)
    first, second = F.get(years, F.lit(0)), F.get(years, F.lit(1))
    found = F.filter(
        F.transform(_strings(MONTHS), lambda m, i: F.when(q.contains(m), i + 1)), lambda m: m.isNotNull()
    )
    month = F.get(found, F.lit(0))
    year_a = (
        F.when(month.isNotNull(), F.coalesce(first, F.lit(2024)))
        .when(count >= 2, F.least(first, second))
        .when(count == 1, first - 2)
        .otherwise(2024)
    )
    year_b = (
        F.when(month.isNotNull(), F.coalesce(second, F.lit(2026)))
        .when(count >= 2, F.greatest(first, second))
        .when(count == 1, first)
        .otherwise(2026)
    )
    m = F.coalesce(month, F.lit(1))
    radar = q.rlike(RADAR_WORDS)
    task = (
        F.when(any_word(q, RETRIEVAL_CHANGE_WORDS), "Bi-Temporal Change Analysis")
        .when(radar, "SAR Radar Analysis")
        .otherwise("Single Optical Analysis")
    )
    return placed.select(
        *df.columns,
        F.coalesce("place.key", phrase, titled).alias("location"),
        F.format_string("%d-%02d-15", year_a, m).alias("date_a"),
        F.format_string("%d-%02d-15", year_b, m).alias("date_b"),
        F.when(radar, "Sentinel-1 SAR C-Band").otherwise("Sentinel-2 MSI").alias("sensor"),
        radar.alias("is_sar"),
        task.alias("task"),
        F.col("place.lat").alias("lat"),
        F.col("place.lon").alias("lon"),
    )


def topic(text: str | Column) -> Column:
    """built, vegetation, water or general."""
    q = F.lower(F.col(text) if isinstance(text, str) else text)
    chain = None
    for name, words in TOPIC_WORDS.items():
        chain = (F.when if chain is None else chain.when)(any_word(q, words), name)
    return chain.otherwise("general")


# Class whose share answers a topic, by index.
TOPIC_CLASS = {
    "built": "Built-up / Concrete / Asphalt (NDBI > 0.10)",
    "vegetation": "Healthy Vegetation (NDVI > 0.50)",
    "water": "Open Water Surface (NDWI > 0.0)",
}


def describe_stats(df: DataFrame, text: str = "text", place: str = "location", area: str = "area_km2") -> DataFrame:
    """Answer a question from one row of index statistics (index, mean, min, max, std, class_breakdown)."""
    names = F.create_map(*[F.lit(x) for pair in TOPIC_CLASS.items() for x in pair])
    share = F.try_element_at("class_breakdown", F.try_element_at(names, F.col("topic")))
    km2 = share / 100.0 * F.greatest(F.col(area), F.lit(0.1))
    out = df.withColumn("topic", topic(text)).withColumn("share_pct", share).withColumn("share_km2", km2)
    where = F.trim(F.substring_index(F.col(place), ",", 1))
    specific = F.format_string("In %s, %s covers %.1f%% (%.2f km²); mean %.2f, peak %.2f.", where, "topic", "share_pct", "share_km2", "mean", "max")
    general = F.format_string("In %s, %s has mean %.2f (min %.2f, max %.2f, std %.2f).", where, F.upper("index"), "mean", "min", "max", "std")
    return out.withColumn("answer", F.when(F.col("share_pct").isNotNull(), specific).otherwise(general))


def describe_change(df: DataFrame, text: str = "text", place: str = "location", area: str = "area_km2") -> DataFrame:
    """Answer a question from one row of ``index_change`` with before_date and after_date."""
    size = F.greatest(F.col(area), F.lit(0.1))
    out = df.withColumn("topic", topic(text))
    for name in ("improved", "stable", "declined"):
        out = out.withColumn(f"{name}_km2", F.col(f"{name}_percent") / 100.0 * size)
    answer = F.format_string(
        "Between %s and %s in %s, %s gained on %.1f%% (%.2f km²), was stable on %.1f%% (%.2f km²) and lost on %.1f%% (%.2f km²); mean shift %+.3f.",
        F.substring_index(F.col("before_date").cast("string"), "T", 1),
        F.substring_index(F.col("after_date").cast("string"), "T", 1),
        F.trim(F.substring_index(F.col(place), ",", 1)),
        "topic",
        *[f"{n}_{c}" for n in ("improved", "stable", "declined") for c in ("percent", "km2")],
        "mean_change",
    )
    return out.withColumn("answer", answer)
