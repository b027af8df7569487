"""Place names in text to coordinates and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COORDINATES = r"(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)"


_WORD = r"(?U)\w+"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _word_pieces(t: Column, counts: list[int], edges: bool) -> Column:
    """Runs of so many words, with what lies between them; with ``edges`` also what lies on both sides, else distinct."""
    parts = F.struct(F.regexp_extract_all(t, F.lit(_WORD), F.lit(0)).alias("words"), F.split(t, _WORD, -1).alias("gaps"))

    def runs(p: Column, n: int) -> Column:
        def run(i: Column) -> Column:
            pieces = [x for j in range(n) for x in ([F.get(p["gaps"], i + j)] if j else []) + [F.get(p["words"], i + j)]]
            core = F.concat(*pieces)
            if not edges:
                return core
            before, after = F.get(p["gaps"], i), F.get(p["gaps"], i + n)
            # a text begins and ends as if a blank stood there
            return F.struct(core.alias("core"), F.when(i == 0, F.concat(F.lit(" "), before)).otherwise(before).alias("before"), F.when(i + n == F.size(p["words"]), F.concat(after, F.lit(" "))).otherwise(after).alias("after"))

        return F.when(F.size(p["words"]) >= n, F.transform(F.sequence(F.lit(0), F.size(p["words"]) - n), run))

    empty = F.array().cast("array<struct<core: string, before: string, after: string>>" if edges else "array<string>")
    every = lambda p: F.flatten(F.array(*[F.coalesce(runs(p, n), empty) for n in counts]))
    # only texts are told apart by hashing; structs would be compared with each other
    return _let(parts, every if edges else lambda p: F.array_distinct(every(p)))


def _char_pieces(t: Column, lengths: list[int]) -> Column:
    """Distinct runs of so many characters."""
    chars = F.split(t, "")

    def runs(c: Column, n: int) -> Column:
        run = F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.array_join(F.slice(c, i, n), ""))
        return F.when(F.size(c) >= n, run).otherwise(F.array().cast("array<string>"))

    return _let(chars, lambda c: F.array_distinct(F.flatten(F.array(*[runs(c, n) for n in lengths]))))


def match_places(df: DataFrame, gaz: DataFrame, text: str = "text", mode: str = "word") -> DataFrame:
    """Add ``place`` (STRUCT of the gazetteer row): the first entry by ``ord`` named in the text.

    Each distinct text is cut once into its words and runs of words (or of characters), as long as keys are, and
    distinct runs meet keys in an equi-join: the work is in proportion to the text and does not grow with the
    gazetteer. With ``mode="word"`` a key counts when no letter, digit or underscore touches it (a key without any of
    these never does), with ``"contains"`` anywhere. Of keys with equal ``ord`` the smaller key comes first.
    """
    if mode not in ("word", "contains"):
        raise ValueError(f"mode must be 'word' or 'contains', not {mode!r}")
    keys = gaz.filter("key is not null and key <> ''").withColumns({"_o": F.struct("ord", "key"), "place": F.struct(*gaz.columns)})
    # runs carry a digest of their text: the text itself would be copied for each of its words
    texts = df.select(F.col(text).alias("_text")).filter("_text is not null").distinct().withColumn("_of", F.sha2("_text", 256))
    lower = F.lower("_text")
    if mode == "contains":
        named = keys.select(F.col("key").alias("core"), "_o", "place")
        lengths = sorted(named.select(F.length("core")).distinct().agg(F.collect_set("length(core)")).first()[0])
        pieces = texts.select("_of", F.explode(_char_pieces(lower, lengths)).alias("core")) if lengths else texts.select("_of", F.lit("").alias("core"))
    else:
        cut = F.regexp_extract("key", r"(?Us)^(\W*)(.*\w)(\W*)$", 2)
        lead, trail = F.regexp_extract("key", r"(?Us)^(\W*)(.*\w)(\W*)$", 1), F.regexp_extract("key", r"(?Us)^(\W*)(.*\w)(\W*)$", 3)
        named = keys.select(cut.alias("core"), lead.alias("lead"), trail.alias("trail"), "_o", "place").filter("core <> ''")
        found = named.agg(F.collect_set(F.size(F.regexp_extract_all("core", F.lit(_WORD), F.lit(0)))), F.max((F.col("lead") != "") | (F.col("trail") != ""))).first()
        counts, edges = sorted(found[0]), bool(found[1])
        pieces = texts.select("_of", F.explode(_word_pieces(lower, counts, edges)).alias("core"))
        pieces = pieces.select("_of", "core.*") if edges else pieces
    joined = pieces.join(named, "core")
    if mode == "word" and edges:
        fits = lambda side, part, place: (F.col(part) == "") | (place(F.col(side), F.col(part)) & (F.length(side) > F.length(part)))
        joined = joined.filter(fits("before", "lead", Column.endswith) & fits("after", "trail", Column.startswith))
    first = joined.groupBy("_of").agg(F.min_by("place", "_o").alias("place"))
    return df.join(first, F.sha2(F.col(text), 256) == F.col("_of"), "left").drop("_of")


def coordinates(text: str | Column) -> Column:
    """STRUCT<lat, lon> of the first "lat, lon" pair in a text, NULL without one."""
    c = F.col(text) if isinstance(text, str) else text
    lat = F.nullif(F.regexp_extract(c, COORDINATES, 1), F.lit("")).cast("double")
    lon = F.nullif(F.regexp_extract(c, COORDINATES, 2), F.lit("")).cast("double")
    return F.when(lat.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def geocode(
    df: DataFrame,
    gaz: DataFrame,
    text: str = "text",
    half_side: float = 0.04,
    mode: str = "word",
) -> DataFrame:
    """Add lat, lon, place_name, resolved_by (gazetteer, coordinates or NULL) and a box.

    ``gaz``: key, ord, name, lat, lon and optionally min_lon, min_lat, max_lon, max_lat. A
    text that names no known place keeps NULL.
    """
    found = match_places(df, gaz, text, mode).withColumn("_pair", coordinates(text))
    lat = F.coalesce("place.lat", "_pair.lat")
    lon = F.coalesce("place.lon", "_pair.lon")
    own = {"min_lon", "min_lat", "max_lon", "max_lat"} <= set(gaz.columns)

    def edge(name: str, centre: Column, sign: int) -> Column:
        around = F.round(centre + sign * half_side, 4)
        return F.coalesce(F.col(f"place.{name}"), around) if own else around

    return found.select(
        *df.columns,
        lat.alias("lat"),
        lon.alias("lon"),
        F.col("place.name").alias("place_name"),
        F.when(F.col("place").isNotNull(), "gazetteer").when(F.col("_pair").isNotNull(), "coordinates").alias("resolved_by"),
        edge("min_lon", lon, -1).alias("min_lon"),
        edge("min_lat", lat, -1).alias("min_lat"),
        edge("max_lon", lon, 1).alias("max_lon"),
        edge("max_lat", lat, 1).alias("max_lat"),
    )


def hashed_place(text: str | Column) -> Column:
    """STRUCT<lat, lon> placed by the md5 of a text, for stable demo coordinates of unknown names."""
    c = F.col(text) if isinstance(text, str) else text
    h = F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.struct(
        ((h % 1500) / 100.0 + 10.0).alias("lat"), ((F.shiftright(h, 4) % 1200) / 100.0 + 75.0).alias("lon")
    )
