"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose spans; labelers (shape check, gazetteer, context, surroundings, usual length, strict pattern) vote
yes, no or nothing on each. Expectation-maximisation over the counts of the vote patterns, which are few whatever the
corpus, estimates how far each labeler is to be trusted, and the resulting probabilities train the span classifier
that decides on every span that the fixed base patterns have not settled.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")

#: The base patterns, written so that no text makes them slow. A match starts at the first character
#: that could start it, or right after the match before; nothing in them can be given back with any effect.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns: spelt-out mail addresses, colon addresses, cards with other separators, local phone numbers.
LOOSE = {
    "email": r"(?i)\b[a-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}| at ) ?[a-z0-9-]{1,63} ?(?:\(dot\)|\[dot\]|\{dot\}| dot ) ?[a-z]{2,12}\b",
    "ip": r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:])",
    "card": r"(?<![0-9./_])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9./_])",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: What a text must hold for a pattern to be worth trying.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
LOOSE_NEEDS = {"email": r"(?i)\bat\b|[(\[{]at", "ip": ":[0-9a-fA-F]{1,4}:", "card": "[0-9]{4}[./_][0-9]{4}", "phone": "[0-9]{3}[ .-][0-9]{4}"}
#: Gazetteers and context words.
TOP_DOMAINS = "com org net edu gov info biz io de fr es it nl uk us ca au ch at be eu jp in br mx ar cl co".split()
CALLING_CODES = "1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 7 81 82 84 86 90 91 92 93 94 95 98".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|62|35)"
CONTEXT = {
    "email": r"mail|contact|write to|kontakt|correo|courriel|schreib",
    "ip": r"\bip\b|address|host|server|login|adresse|direcci",
    "card": r"card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte",
    "phone": r"phone|tel|call|mobile|fax|cell|anruf|handy|llama|appel",
}
AGAINST = r"version|chapter|section|isbn|doi|order no|invoice|serial|build|token|password|secret|key ?="
#: Characters before a span in which context is looked for.
CONTEXT_CHARS = 40
LABELERS = ("strict", "check", "gazetteer", "context", "edges", "usual")

_SPAN = "struct<s: int, e: int, m: string>"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _matches(text: Column, pattern: str, needs: str) -> Column:
    """All matches from left to right as (s, e, m), in code points; gaps and matches lie in turn."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{_SPAN}>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["0"]
        e = s + F.length(x["1"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["1"].alias("m")))).alias("out"))

    def walk(m: Column) -> Column:
        both = F.zip_with(F.slice(gaps, 1, F.size(m)), m, lambda g, x: F.struct(g.alias("0"), x.alias("1")))
        return F.aggregate(both, start, step, lambda acc: acc["out"])

    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    return F.when(text.rlike(needs), _let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(walk(m)))).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)
    doubled = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda i: _let(F.substr(turned, i, F.lit(1)).cast("int"), lambda d: F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    """The contract's conditions on a match of the base pattern."""
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.substring(bare(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        return _let(_digits(m), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _check(kind: str, m: Column, valid: Column) -> Column:
    if kind == "email":
        good = F.regexp_extract(m, r"([A-Za-z]+)$", 1)
        return F.when(F.length(good).between(2, 12), 1).otherwise(-1)
    if kind == "ip":
        return F.when(m.contains(":") | (m.rlike(r"^[0-9.]+$") & valid), 1).otherwise(-1)
    return F.when(valid, 1).otherwise(-1)


def _listed(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.when(F.lower(F.regexp_extract(m, r"([A-Za-z]+)$", 1)).isin(TOP_DOMAINS), 1).otherwise(0)
    if kind == "ip":
        return F.when(m.rlike(r"^(?:0|127|22[4-9]|2[3-5][0-9])\."), -1).otherwise(1)
    if kind == "card":
        return F.when(_digits(m).rlike(ISSUERS), 1).otherwise(-1)
    code = F.regexp_extract(m, r"^\+([0-9]+)", 1)
    known = [F.substring(code, 1, n).isin([c for c in CALLING_CODES if len(c) == n]) for n in (1, 2)]
    return F.when(code == "", 0).when(known[0] | known[1], 1).otherwise(-1)


def _usual(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.when(F.length(m) <= 64, 1).otherwise(-1)
    if kind == "ip":
        return F.when(m.rlike(r"(?:^|\.)0[0-9]"), -1).otherwise(1)
    low, high = (13, 16) if kind == "card" else (10, 13)
    return F.when(F.length(_digits(m)).between(low, high), 1).otherwise(-1)


def _candidate(kind: str, k: int, text: Column, x: Column, strict: bool) -> Column:
    """Span with its votes, one per labeler."""
    before = F.lower(F.substr(text, F.greatest(x["s"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(x["s"], F.lit(CONTEXT_CHARS))))
    around = F.concat(F.when(x["s"] > 0, F.substr(text, x["s"], F.lit(1))).otherwise(" "), F.substr(text, x["e"] + 1, F.lit(1)))

    def votes(b: Column, valid: Column) -> Column:
        context = F.when(b.rlike(CONTEXT[kind]), 1).when(b.rlike(AGAINST), -1).otherwise(0)
        edges = F.when(around.rlike(r"[A-Za-z0-9_]"), -1).otherwise(1)
        first = F.when(valid, 1).otherwise(-1) if strict else F.lit(0)
        return F.array(*[v.cast("int") for v in (first, _check(kind, x["m"], valid), _listed(kind, x["m"]), context, edges, _usual(kind, x["m"]))])

    return _let(
        F.struct(before.alias("b"), _valid(kind, x["m"]).alias("v")),
        lambda p: F.struct(
            F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), (p["v"] if strict else F.lit(False)).alias("base"), votes(p["b"], p["v"]).alias("votes")
        ),
    )


def candidates(text: Column) -> Column:
    """All proposed spans of a text, by kind, then start: array of (k, s, e, base, votes)."""

    def of_kind(k: int, kind: str) -> Column:
        strict = _matches(text, STRICT[kind], NEEDS[kind])
        loose = _matches(text, LOOSE[kind], LOOSE_NEEDS[kind])

        def both(found: Column) -> Column:
            apart = F.filter(loose, lambda y: ~F.exists(found, lambda x: (x["s"] < y["e"]) & (y["s"] < x["e"])))
            return F.concat(
                F.transform(found, lambda x: _candidate(kind, k, text, x, True)), F.transform(apart, lambda x: _candidate(kind, k, text, x, False))
            )

        return _let(strict, both)

    return F.concat(*[of_kind(k, kind) for k, kind in enumerate(KINDS)])


def expectation_maximisation(counts: dict[tuple, int], rounds: int = 50) -> dict[tuple, float]:
    """Probability that spans of each (kind, votes) are personal data.

    Labelers are independent given the truth; per kind each has its shares of yes, nothing and no for true and for
    false spans, with one pseudo-count each. It starts from the share of yes votes, which also settles which of the
    two classes is which; a failed check starts as false.
    """
    check = LABELERS.index("check")
    belief = {}
    for key in counts:
        yes, no = sum(v > 0 for v in key[1]), sum(v < 0 for v in key[1])
        belief[key] = 0.05 if key[1][check] < 0 else (yes + 0.5) / (yes + no + 1)
    for _ in range(rounds):
        nxt = {}
        for kind in {k for k, _ in counts}:
            own = [key for key in counts if key[0] == kind]
            weight = [{key: counts[key] * (belief[key] if truth else 1 - belief[key]) for key in own} for truth in (0, 1)]
            total = [sum(w.values()) for w in weight]
            prior = (total[1] + 1) / (total[0] + total[1] + 2)
            table = {
                (truth, j, v): (sum(weight[truth][key] for key in own if key[1][j] == v) + (2 if v == (1 if truth else -1) else 1)) / (total[truth] + 4)
                for truth in (0, 1)
                for j in range(len(LABELERS))
                for v in (-1, 0, 1)
            }
            for key in own:
                odds = math.log(prior / (1 - prior)) + sum(math.log(table[1, j, v] / table[0, j, v]) for j, v in enumerate(key[1]))
                nxt[key] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        belief = nxt
    return belief


def train_classifier(counts: dict[tuple, int], belief: dict[tuple, float], steps: int = 300, rate: float = 0.3) -> dict[str, float]:
    """Logistic weights over kind and votes, from the probabilities of the vote patterns, weighted by log count.

    Frequent patterns must not drown the rare ones, which are the undecided ones.
    """
    names = ["one", *[f"{k}" for k in KINDS], *[f"{a}{v}" for a, v in itertools.product(LABELERS, (-1, 1))]]
    w = dict.fromkeys(names, 0.0)
    rows = []
    for (kind, votes), n in counts.items():
        on = ["one", KINDS[kind], *[f"{a}{v}" for a, v in zip(LABELERS, votes) if v]]
        rows.append((on, belief[kind, votes], math.log1p(n)))
    total = sum(r[2] for r in rows) or 1.0
    for _ in range(steps):
        grad = dict.fromkeys(names, 0.0)
        for on, p, n in rows:
            z = sum(w[x] for x in on)
            miss = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * n / total
            for x in on:
                grad[x] += miss
        for x in names:
            w[x] -= rate * (grad[x] + 1e-4 * w[x])
    return w


def learn(found: DataFrame) -> dict[str, float]:
    """Classifier weights from all candidates of ``found.cands``; the vote patterns (at most 2,916) reach the driver."""
    spans = found.select(F.explode("cands").alias("c")).select("c.k", "c.votes")
    counts = {(r["k"], tuple(r["votes"])): r["n"] for r in spans.groupBy("k", "votes").agg(F.count("*").alias("n")).collect()}
    return train_classifier(counts, expectation_maximisation(counts))


def _accepted(weights: dict[str, float], c: Column) -> Column:
    """Whether the classifier takes a span; one that fails its own check is never taken."""
    z = F.lit(weights["one"])
    for k, kind in enumerate(KINDS):
        z = z + F.when(c["k"] == k, weights[kind]).otherwise(0.0)
    for j, name in enumerate(LABELERS):
        v = c["votes"][j]
        z = z + F.when(v > 0, weights[f"{name}1"]).when(v < 0, weights[f"{name}-1"]).otherwise(0.0)
    return (z > 0) & (c["votes"][LABELERS.index("check")] >= 0)


def chosen(cands: Column, weights: dict[str, float]) -> Column:
    """Base spans, and accepted others that touch no base span nor an accepted one of a kind before."""

    def pick(own: Column) -> Column:
        base = F.filter(own, lambda c: c["base"])

        def add(extra: Column) -> Column:
            clear = lambda c: ~F.exists(extra, lambda d: (d["k"] < c["k"]) & (d["s"] < c["e"]) & (c["s"] < d["e"]))
            return F.concat(base, F.filter(extra, clear))

        free = F.filter(own, lambda c: ~c["base"] & _accepted(weights, c) & ~F.exists(base, lambda d: (d["s"] < c["e"]) & (c["s"] < d["e"])))
        return _let(free, add)

    spans = F.transform(_let(cands, pick), lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e"), c["base"].alias("base")))
    return F.sort_array(spans)


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.element_at(names, c["k"] + 1), c["s"].cast("string"), c["e"].cast("string"))), ",")


def _proposed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t")).select("doc_id", candidates(F.col("_t")).alias("cands"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row per row of ``docs``.

    Null and empty texts have no spans; a corpus without any candidate trains nothing and finds nothing. Offsets count
    code points. Further columns are not read.
    """
    found = cut_lineage(_proposed(docs))
    spans = found.select("doc_id", chosen(F.col("cands"), learn(found)).alias("all")).select("doc_id", "all", F.filter("all", lambda c: c["base"]).alias("own"))
    kinds = F.transform("own", lambda c: c["k"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(_written(F.col("own")), 256).alias("base_sha256"), _written(F.col("all")).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind in angle brackets; n_chars, if there, follows.

    All rows and columns stay; null texts stay null.
    """
    weights = learn(cut_lineage(_proposed(docs).filter(F.size("cands") > 0)))
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("text")

    def cover(spans: Column) -> Column:
        ordered = F.sort_array(F.transform(spans, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["k"].alias("k"))))

        def step(acc: Column, c: Column) -> Column:
            gap = F.substr(text, acc["at"] + 1, F.greatest(c["s"] - acc["at"], F.lit(0)))
            tag = F.when(c["e"] > acc["at"], F.element_at(names, c["k"] + 1)).otherwise("")
            return F.struct(F.greatest(acc["at"], c["e"]).alias("at"), F.concat(acc["out"], gap, tag).alias("out"))

        whole = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
        return F.when(F.size(spans) == 0, text).otherwise(whole)

    clean = F.when(text.isNotNull(), _let(chosen(candidates(text), weights), cover))
    out = docs.withColumn("text", clean)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
