"""Quality rules with adaptive thresholds, in DataFrame functions only.

Fixed cutoffs suit one language and one source. Here each rule's measure is summarised by mergeable quantile
sketches per (language, source), merged on to per language and to all; a group that is too small for a sketch of its
own takes the next wider one. Fences from the quartiles are joined back to the documents and filter them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.session import cut_lineage

#: Fixed values of the base rules: white space, symbols, window, limits.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Adaptive rules: measure, side on which documents fail, least width of the fence beyond the quartile.
RULES = (
    ("symbol_share", "high", 0.05),
    ("shout_share", "high", 0.10),
    ("repeat_share", "high", 0.15),
    ("next_same_share", "high", 0.10),
    ("dup_line_share", "high", 0.30),
    ("mean_word", "high", 2.0),
    ("mean_word", "low", 2.0),
)
#: Quartile distances that a fence lies outside the quartile.
REACH = 4.0
#: Documents that a group must hold to have fences of its own.
MIN_GROUP = 200


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _dup_positions(hashes: Column) -> Column:
    """Sorted positions (from 0) of the hashes that occur more than once in an array."""

    def flagged(pairs: Column) -> Column:
        after = F.concat(F.slice(pairs, 2, F.greatest(F.size(pairs) - 1, F.lit(0))), F.array(pairs[0]))
        before = F.concat(F.array(F.element_at(pairs, -1)), F.slice(pairs, 1, F.greatest(F.size(pairs) - 1, F.lit(0))))
        with_next = F.zip_with(pairs, after, lambda p, q: F.struct(p["h"].alias("h"), p["i"].alias("i"), (p["h"] == q["h"]).alias("e")))
        marked = F.zip_with(with_next, before, lambda p, q: F.when(p["e"] | (p["h"] == q["h"]), p["i"]))
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(pairs, flagged)


def _covered(positions: Column, width: int) -> Column:
    """Places covered by the runs of ``width`` that begin at the sorted positions."""
    nexts = F.concat(F.slice(positions, 2, F.greatest(F.size(positions) - 1, F.lit(0))), F.array(F.lit(1 << 30)))
    steps = F.zip_with(positions, nexts, lambda p, q: F.least(q - p, F.lit(width)))
    return F.when(F.size(positions) == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), lambda a, b: a + b))


def repeat_words(words: Column, width: int = REPEAT_WINDOW) -> Column:
    """Words inside windows of ``width`` words that the array of words holds twice or more."""

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(_dup_positions(h), lambda p: _covered(p, width)))

    return F.when(F.size(words) <= width, F.lit(0)).otherwise(_let(_let(words, hashes), count))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the contract's counts and the rules' measures of every whole text.

    Null texts are empty; without words all counts and shares are 0, and null lang or source is a group of its own.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split("_t", "\n"), lambda line: F.translate(line, SPACES, "") != "")
    words = F.array_remove(F.split("_t", "[\\x20\\x09-\\x0D]+"), "")
    bare = F.translate("_t", SPACES, "")

    def of_words(w: Column) -> Column:
        follow = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: (a == b).cast("int"))
        same = F.aggregate(follow, F.lit(0), lambda a, b: a + b)
        return F.struct(F.size(w).alias("n_words"), repeat_words(w).alias("n_repeat_words"), same.alias("n_next_same"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))

    found = docs.select("doc_id", "lang", "source", text.alias("_t")).select(
        "doc_id",
        "lang",
        "source",
        _let(words, of_words).alias("w"),
        _let(lines, of_lines).alias("l"),
        F.length(bare).alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).alias("n_symbols"),
        F.length(F.regexp_replace("_t", "[^A-Z\\u00c0-\\u00de]+", "")).alias("n_upper"),
    )
    n = F.col("w.n_words")
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    return found.select(
        "doc_id",
        "lang",
        "source",
        n.cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.col("l.n_dup_lines").cast("long").alias("n_dup_lines"),
        F.col("w.n_repeat_words").cast("long").alias("n_repeat_words"),
        share(F.col("n_symbols"), n).alias("symbol_share"),
        share(F.col("n_upper"), F.col("word_chars")).alias("shout_share"),
        share(F.col("w.n_repeat_words"), n).alias("repeat_share"),
        share(F.col("w.n_next_same"), n).alias("next_same_share"),
        share(F.col("l.n_dup_lines"), F.col("l.n_lines")).alias("dup_line_share"),
        share(F.col("word_chars"), n).alias("mean_word"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _sketch_columns() -> list[str]:
    return list(dict.fromkeys(name for name, _, _ in RULES))


def fences(measured: DataFrame, min_group: int = MIN_GROUP, reach: float = REACH) -> DataFrame:
    """lang, source, and per rule the fence that its measure must not pass.

    One sketch per measure and (lang, source), from all documents that pass the base rules; the sketches merge to
    languages and to the whole, and a group of fewer than ``min_group`` documents takes the wider one.
    """
    names = _sketch_columns()
    fine = (
        measured.filter(~base_failed())
        .groupBy("lang", "source")
        .agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(F.col(c)).alias(c) for c in names])
    )
    merge = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(F.col(c)).alias(c) for c in names]]
    by_lang = fine.groupBy("lang").agg(*merge)
    whole = by_lang.agg(*merge)

    def bounds(prefix: str) -> list[Column]:
        out = []
        for name, side, least in RULES:
            sketch = F.col(f"{prefix}{name}")
            low, mid, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.5, 0.75))
            if side == "high":
                bound = high + F.greatest(F.lit(reach) * (high - mid), F.lit(least))
            else:
                bound = low - F.greatest(F.lit(reach) * (mid - low), F.lit(least))
            out.append(bound.alias(f"{name}_{side}"))
        return out

    fine_b = fine.select("lang", "source", "n", F.struct(*bounds("")).alias("own"))
    lang_b = by_lang.select(F.col("lang").alias("lang_"), F.col("n").alias("lang_n"), F.struct(*bounds("")).alias("wide"))
    whole_b = whole.select(F.struct(*bounds("")).alias("widest"))
    chosen = F.when(F.col("n") >= min_group, F.col("own")).when(F.col("lang_n") >= min_group, F.col("wide")).otherwise(F.col("widest"))
    joined = fine_b.join(lang_b, F.col("lang").eqNullSafe(F.col("lang_")), "left").withColumn("_one", F.lit(1))
    joined = joined.join(whole_b.withColumn("_one", F.lit(1)), "_one")
    return joined.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), chosen.alias("fence"))


def judge(docs: DataFrame, min_group: int = MIN_GROUP, reach: float = REACH) -> DataFrame:
    """doc_id, the counts, base_failed, failed_rules (names), kept: one row per row of ``docs``.

    A document is kept if it passes the base rules and every fence of its group; a group in which no document passes
    the base rules has no fences, and needs none. Further columns are not read, repeated rows stay.
    """
    measured = cut_lineage(measures(docs))
    fence = fences(measured, min_group, reach)
    same = F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source"))
    judged = measured.join(fence, same, "left").withColumn("base_failed", base_failed())
    broken = [
        F.when((F.col(name) > F.col(f"fence.{name}_{side}")) if side == "high" else (F.col(name) < F.col(f"fence.{name}_{side}")), F.lit(f"{name}_{side}"))
        for name, side, _ in RULES
    ]
    failed = F.filter(F.array(*broken), lambda x: x.isNotNull())
    judged = judged.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *counts, "base_failed", "kept", F.concat_ws(",", "failed_rules").alias("failed_rules"))
