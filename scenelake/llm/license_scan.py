"""License scans with a trained paragraph classifier, in DataFrame functions and Spark ML only.

A sparse logistic regression over word n-grams tells license families from one another and from other text. It is
trained on notices of each family, cut and padded in many ways, against paragraphs of the corpus; its unknown class
is calibrated on notices that the fit has not seen. A prediction counts once a template of the family agrees.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Notices by family.
TEMPLATES = {
    "AGPL-3.0": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache License 2.0.",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0-1.0": [
        "This work is dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
        "Licensed under the GNU GPL, version 3 or later.",
    ],
    "LGPL-3.0": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
    ],
}
#: SPDX identifiers by family, lower case; a tag that names one alone is a notice of the family.
SPDX = {
    "AGPL-3.0": "agpl-3.0(-only|-or-later)?",
    "Apache-2.0": "apache-2.0",
    "BSD": "(0bsd|bsd-[1-4]-clause)",
    "CC-BY-4.0": "cc-by-4.0",
    "CC-BY-NC-4.0": "cc-by-nc-4.0",
    "CC-BY-SA-4.0": "cc-by-sa-4.0",
    "CC0-1.0": "cc0-1.0",
    "GPL-3.0": "gpl-3.0(-only|-or-later)?",
    "LGPL-3.0": "lgpl-3.0(-only|-or-later)?",
    "MIT": "mit",
    "MPL-2.0": "mpl-2.0",
    "Unlicense": "unlicense",
}
_CC = "(cc|creative commons)"
#: What a paragraph must name before a template of the family confirms it, what it must not, and the family's version.
TELLING = {
    "AGPL-3.0": ("affero|agpl", None, "3"),
    "Apache-2.0": ("apache", None, "2"),
    "BSD": ("bsd|redistribution and use", None, None),
    "CC-BY-4.0": (_CC, "by-(nc|sa|nd)|non-?commercial|share-?alike|no-?deriv", "4"),
    "CC-BY-NC-4.0": (_CC, "by-nc-(sa|nd)|by-(sa|nd)|share-?alike|no-?deriv", "4"),
    "CC-BY-SA-4.0": (_CC, "by-(nc|nd)|non-?commercial|no-?deriv", "4"),
    "CC0-1.0": ("cc0|public domain|waived all copyright", None, "1"),
    "GPL-3.0": ("gnu general public|gnu gpl|gplv?", "affero|agpl|lesser|lgpl", "3"),
    "LGPL-3.0": ("lesser|lgpl", None, "3"),
    "MIT": ("mit|permission is hereby granted", None, None),
    "MPL-2.0": ("mozilla|mpl", None, "2"),
    "Unlicense": ("unlicense|unencumbered", None, None),
}
UNKNOWN = "unknown"
#: Notices of no family above, for the unknown class.
OTHER = [
    "All rights reserved.",
    "Licensed under the terms of the enclosed agreement.",
    "This work is licensed under a proprietary license.",
    "Released under the terms of use of the publisher.",
    "Licensed under the Example Company Source License, version 7.",
    "See the license for details.",
]
#: Corpus paragraphs that the unknown class is trained on at most: those of least hash.
CORPUS_SAMPLE = 2_000
#: Share of a template's n-grams that must occur, or of the paragraph's n-grams that a template must hold.
CONFIRM = 0.6
#: Share of the unseen notices that the calibrated unknown class may still take.
CALIBRATION_LOSS = 0.02

#: Function words: a run of these alone says nothing about a license and is no feature.
FUNCTION_WORDS = (
    "a all an and any are as at be but by can for from has have in into is it its may more no not of on or other out see so such text than that "
    "the their then they this to under up was which will with without you your"
).split()

_WORD = "[^a-z0-9.\\-]+"


def _words(text: Column) -> Column:
    """Lower-cased words of a text."""
    return F.array_remove(F.transform(F.split(F.lower(text), _WORD), lambda w: F.rtrim(w, F.lit(".-"))), "")


def _grams(words: Column) -> Column:
    """Distinct runs of two and three words that are not function words alone; one word alone is a run too."""

    def runs(w: Column) -> Column:
        many = lambda k: F.when(
            F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), " "))
        ).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(F.when(F.size(w) == 1, w).otherwise(F.array().cast("array<string>")), many(2), many(3)))

    found = F.transform(F.array(words), runs)[0]
    return F.filter(found, lambda g: ~F.forall(F.split(g, " "), lambda w: w.isin(FUNCTION_WORDS)))


def _named(words: Column) -> Column:
    """Families whose telling words occur, without another version behind them than the family's own."""
    said = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    out = []
    for family, (name, never, version) in sorted(TELLING.items()):
        ok = said.rlike(f" ({name})")
        if never:
            ok &= ~said.rlike(never)
        if version:
            behind = rf" ({name})([^ ]*( [^ ]+){{0,12}} (version |v\.?)|[^ ]*( [^ ]+){{0,3}} (?=[0-9.]+ )|[a-z]*[-v]*(?=[0-9]))"
            ok &= ~said.rlike(behind + "[0-9]") | said.rlike(behind + rf"{version}(\.0)*(-only|-or-later|\+)? ")
        out.append(F.when(ok, F.lit(family)))
    return F.array_compact(F.array(*out))


def _tagged(p: Column) -> Column:
    """The family of an SPDX tag that names a single license; null without one."""
    tag = F.regexp_extract(F.lower(p), r"spdx-license-identifier:\s*([a-z0-9.+-]+)\s*(?:\*/|-->)?\s*$", 1)
    return F.coalesce(*[F.when(tag.rlike(f"^{pattern}$"), F.lit(family)) for family, pattern in SPDX.items()])


def anchor_words(grams: list[str]) -> list[str]:
    """One word of each run, so that a text without any of them holds none of the runs: the longest telling one."""
    return sorted({max((w for w in g.split() if w not in FUNCTION_WORDS), key=lambda w: (len(w), w)) for g in grams})


def _notices() -> list[tuple[str, str, bool]]:
    """(family, text, for calibration): each notice whole, without its first or last words, and inside other words."""
    out = []
    for family, texts in [*TEMPLATES.items(), (UNKNOWN, OTHER)]:
        for text in texts:
            words = text.split()
            cuts = [words, words[1:], words[:-1], words[2:], ["note", *words], [*words, "see", "file"], [*words, *words]]
            cuts += [words[: max(3, len(words) * 3 // 4)], ["this", "text", "is", *words, "and", "more"]]
            out += [(family, " ".join(c), i % 4 == 3) for i, c in enumerate(cuts) if len(c) >= 3]
    return out


class LicenseModel:
    """Weights per n-gram and family, intercepts, and the log-odds against unknown from which a family counts."""

    def __init__(self, families: list[str], weights: DataFrame, intercepts: list[float], cutoff: float):
        self.families, self.weights, self.intercepts, self.cutoff = families, weights, intercepts, cutoff


def starts_with_any(words: list[str]) -> str:
    """Pattern of a word start followed by any of the words, common beginnings written once; for lower-cased text.

    Wherever a word of ``_words`` equals one of ``words`` it matches, so it only spares lines without them the cut.
    """

    def tree(rest: list[str]) -> str:
        if "" in rest:
            return ""
        heads = sorted({w[0] for w in rest})
        parts = [re.escape(h) + tree([w[1:] for w in rest if w[0] == h]) for h in heads]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return r"(?<![a-z0-9.\-])" + tree(sorted(set(words))) if words else "$^"


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), par, p: the lines of every whole text that hold a word; null texts have none."""
    lines = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("par", "p"))
    return lines.filter(F.col("p").rlike("[A-Za-z]"))


def train(spark: SparkSession, docs: DataFrame, sample: int = CORPUS_SAMPLE) -> LicenseModel:
    """Fit on the notices and at most ``sample`` corpus paragraphs without the letters "licens"; calibrate on the rest.

    The paragraphs come from the documents of least hash, as many as are needed.

    The vocabulary is that of the notices, so its size, and that of the weights, does not depend on the corpus.
    """
    families = [UNKNOWN, *sorted(TEMPLATES)]
    notices = spark.createDataFrame(_notices(), "family string, p string, later boolean").withColumn("g", _grams(_words(F.col("p"))))
    span = 1 << 40
    bound = int(span * min(1.0, 1.3 * sample / max(1, docs.count())))  # a document has a paragraph or more
    few = docs.filter(F.pmod(F.xxhash64("text"), F.lit(span)) < bound)
    plain = paragraphs(few).filter(~F.lower("p").contains("licens")).select(F.xxhash64("p").alias("k"), "p").orderBy("k", "p").limit(sample)
    other = plain.select(F.lit(UNKNOWN).alias("family"), (F.pmod("k", F.lit(4)) == 3).alias("later"), _grams(_words(F.col("p"))).alias("g"))
    vectors = CountVectorizer(inputCol="g", outputCol="features", binary=True, minDF=1.0).fit(notices)
    rows = notices.select("family", "later", "g").unionByName(other)
    label = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")).cast("double") - 1
    table = vectors.transform(rows.withColumn("label", label)).select("label", "later", "features").coalesce(1).cache()  # a bounded table
    fitted = LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=0.5, maxIter=60).fit(table.filter("not later"))
    coefficients, intercepts = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray().tolist()
    held = vectors.transform(rows.withColumn("label", label)).filter("later").select("label", "features").collect()
    table.unpersist()
    margins = []
    for row in held:
        z = coefficients @ row["features"].toArray() + intercepts
        if row["label"] > 0:
            margins.append(float(z[int(row["label"])] - z[0]))
    margins.sort()
    cutoff = min(margins[int(len(margins) * CALIBRATION_LOSS)], 4.0) if margins else 0.0
    weights = [(g, coefficients[:, j].tolist()) for j, g in enumerate(vectors.vocabulary) if abs(coefficients[:, j]).max() > 0]
    return LicenseModel(families, spark.createDataFrame(weights, "g string, w array<double>"), intercepts, max(cutoff, 0.0))


def _template_table(spark: SparkSession) -> DataFrame:
    """g, t (template), family, size: the n-grams of each template."""
    rows = [(f"{family}/{i}", family, text) for family, texts in TEMPLATES.items() for i, text in enumerate(texts)]
    table = spark.createDataFrame(rows, "t string, family string, p string").withColumn("gs", _grams(_words(F.col("p"))))
    return table.select("t", "family", F.size("gs").alias("size"), F.explode("gs").alias("g"))


def scan(docs: DataFrame, sample: int = CORPUS_SAMPLE) -> DataFrame:
    """doc_id, n_paragraphs, n_license, families (sorted, comma-joined), n_unconfirmed: one row per row of ``docs``.

    Paragraphs of one family without a template's agreement, or that name another license or version, count as
    unconfirmed, and so do SPDX tags of other licenses. Null, empty and license-free texts
    have no family. Repeated rows have equal answers; further columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    model = train(spark, docs, sample)
    templates = _template_table(spark)
    known = model.weights.select("g").unionByName(templates.select("g")).distinct()
    # paragraphs that hold no word of any known run have no feature at all; the notices fix the number of these words
    telling = anchor_words([r["g"] for r in known.collect()])
    anchors = F.array(*[F.lit(w) for w in telling])
    tag = F.lower("p").contains("spdx-license-identifier")
    lines = paragraphs(docs).filter(F.lower("p").rlike(starts_with_any(telling)) | tag)
    tagged = lines.filter(F.lower("p").contains("spdx-license-identifier")).select("doc_id", "h", "par", _tagged(F.col("p")).alias("family"))
    worded = lines.filter(~F.lower("p").contains("spdx-license-identifier")).select("doc_id", "h", "par", _words(F.col("p")).alias("words"))
    grams = worded.filter(F.arrays_overlap("words", anchors)).select("doc_id", "h", "par", _named(F.col("words")).alias("named"), _grams(F.col("words")).alias("gs"))
    single = grams.select("doc_id", "h", "par", "named", F.size("gs").alias("m"), F.explode("gs").alias("g"))
    hits = single.join(F.broadcast(known), "g").distinct()  # the notices fix the size of the broadcast side
    key = ("doc_id", "h", "par")
    n = len(model.families)
    zeros = F.array(*[F.lit(0.0)] * n)
    weighted = hits.join(F.broadcast(model.weights), "g", "left").select(*key, "m", "named", F.coalesce("w", zeros).alias("w"))
    sums = weighted.groupBy(*key).agg(F.max("m").alias("m"), F.max("named").alias("named"), *[F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(n)])
    z = F.array(*[F.col(f"z{i}") + model.intercepts[i] for i in range(n)])
    best = F.array_max(F.transform(F.slice(z, 2, n - 1), lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    names = F.array(*[F.lit(f) for f in model.families[1:]])
    told = sums.withColumn("best", best).filter(F.col("best.v") - (F.col("z0") + model.intercepts[0]) >= model.cutoff)
    told = told.select(*key, "m", "named", F.element_at(names, F.col("best.i") + 1).alias("family"))
    shared = hits.join(F.broadcast(templates), "g").groupBy(*key, "m", "family", "t", "size").agg(F.count("*").alias("c"))
    agree = shared.groupBy(*key, "family").agg(F.max(F.greatest(F.col("c") / F.col("size"), F.col("c") / F.col("m"))).alias("agreement"))
    same = told["doc_id"].eqNullSafe(agree["doc_id"]) & (told["h"] == agree["h"]) & (told["par"] == agree["par"]) & (told["family"] == agree["family"])
    judged = told.join(agree, same, "left").select(told["doc_id"], told["h"], told["family"], ((F.coalesce("agreement", F.lit(0.0)) >= CONFIRM) & F.array_contains("named", told["family"])).alias("ok"))
    judged = judged.unionByName(tagged.select("doc_id", "h", "family", F.col("family").isNotNull().alias("ok")))
    found = judged.groupBy("doc_id", "h").agg(
        F.sum(F.col("ok").cast("long")).alias("n_license"),
        F.concat_ws(",", F.sort_array(F.collect_set(F.when(F.col("ok"), F.col("family"))))).alias("families"),
        F.sum((~F.col("ok")).cast("long")).alias("n_unconfirmed"),
    )
    found = found.withColumnRenamed("doc_id", "_d").withColumnRenamed("h", "_h")
    text = F.coalesce("text", F.lit(""))
    n_lines = F.size(F.filter(F.split(text, "\n"), lambda p: p.rlike("[A-Za-z]"))).cast("long")
    base = docs.select("doc_id", F.xxhash64(text).alias("h"), n_lines.alias("n_paragraphs"))
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")), "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "doc_id", "n_paragraphs", F.coalesce("n_license", zero).alias("n_license"), F.coalesce("families", F.lit("")).alias("families"),
        F.coalesce("n_unconfirmed", zero).alias("n_unconfirmed"),
    )
