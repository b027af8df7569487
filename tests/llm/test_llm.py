"""Text operators against brute force on small tables, with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from scenelake.llm import adaptive_rules, common, decontaminate, license_scan, lm_score, ngram_join, packing, pii_weak, quality_pu, span_dedup, suffix_levels
from scenelake.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, h string, n int, token string, score string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPACE_WORD.findall((text or "").translate(LOWER))


def prose(seed, n, vocabulary=300):
    rng = random.Random(seed)
    return " ".join(rng.choice("aé ñ b The of and".split()) if rng.random() < 0.1 else f"w{rng.randrange(vocabulary)}" for _ in range(n))


def made_texts():
    base = prose(1, 120)
    parts = base.split()
    near = [" ".join(parts[:k] + [f"new{k}"] + parts[k + 1 :]) for k in (0, 5, 40, 41, 118)]
    passage = "This passage is shared. It has several sentences in it. Each of them is long enough to count. And so it goes on."
    texts = [None, "", " \n\t ", "one", "one", "Two words", "a b c d", "a b c d e", base, base, base.upper(), *near]
    texts += [f"{prose(i, 60)}.\n{passage} {prose(i + 50, 30)}" for i in range(20, 26)]
    texts += [prose(90, 9000, 5000), "be " * 700, "x" * 3000, "Ünï 😀 code " * 30, passage, "Mail joe@ex.com or +49 (30) 123-4567, ip 10.0.0.256 or 10.0.0.25.", "4111 1111 1111 1111 and 4111111111111112"]
    return texts


@pytest.fixture(scope="module")
def rows():
    return [(i, t) for i, t in enumerate(made_texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, ["en", "de", None][i % 3], f"s{i % 2}", len(t or ""), 1, "x", 2, "y", "z") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, repeated rows."""
    texts = [(None, prose(7, 40)), (None, None), (3, prose(7, 40)), (3, prose(7, 40)), (3, "other text"), (4, None)]
    return spark.createDataFrame([(i, t, None, None, None, None, None, None, None, None) for i, t in texts], SCHEMA)


def jaccard_components(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 80 * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_join(docs, none, odd, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(docs).collect()}
    assert got == jaccard_components(rows)
    assert ngram_join.link_components(none).count() == 0
    assert ngram_join.link_components(odd).count() == 6
    kept = {r.doc_id for r in ngram_join.keep_one(docs).collect()}
    assert kept == {i for i, (n, c) in jaccard_components(rows).items() if not n or i == c}
    assert ngram_join.keep_one(docs).columns == docs.columns


def test_ngram_join_large_group(spark):
    """A chain and a star of near copies, and texts that share much yet not enough."""
    rng = random.Random(5)
    base = prose(3, 150, 4000).split()
    texts = []
    for k in range(150):
        w = list(base)
        for _ in range(k % 9):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    chain = list(base)
    for k in range(30):
        chain[k * 5] = f"c{k}"
        texts.append(" ".join(chain))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = jaccard_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(df).collect()} == want
    few = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(df, most=10).collect()}
    assert few == want


def test_decontamination(spark, docs, none, odd, rows):
    items = [(1, rows[8][1][30:400]), (2, "One"), (3, None), (4, ""), (10, "This passage is shared; it HAS several sentences"), (11, "w1 w2")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = decontaminate.brute_force(rows, items)
    for limit in (10**6, 12):
        found = decontaminate.find_items(docs, bench, block_words=limit)
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.digest(found).collect()}
        assert got == want
    texts = dict(rows)
    for r in decontaminate.find_items(docs, bench).filter("n_hit > 0").collect():
        cut = " ".join(texts[r.doc_id][s.start : s.end] for s in r.spans)
        assert len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", cut.translate(LOWER))) == r.n_hit
    assert {r.doc_id for r in decontaminate.without_contaminated(docs, bench).collect()} == {i for i, w in want.items() if not w[1]}
    empty = bench.limit(0)
    assert decontaminate.find_items(docs, empty).filter("n_hit > 0").count() == 0
    assert decontaminate.find_items(none, bench).count() == 0 and decontaminate.find_items(odd, bench).count() == 6


def test_span_dedup(docs, none, odd, rows):
    split = span_dedup.Sentences([(t or "").encode() for _, t in rows])
    for i, t in rows:
        assert split.pieces(i) == span_dedup.plain_sentences(t) and b"".join(split.pieces(i)) == (t or "").encode()
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in span_dedup.dedup(docs).collect()}
    assert got == span_dedup.brute_force(rows)
    assert got[17][1] > 0 and "Each of them" not in got[17][2]
    assert span_dedup.dedup(none).count() == 0 and span_dedup.dedup(odd).count() == 6


def test_span_dedup_finds_passages_of_any_sentences(spark):
    """51 words in one and two sentences, from within a sentence, between other words; and words that repeat."""
    rng = random.Random(8)
    new = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    passages = [new(51) for _ in range(40)]
    for k, p in enumerate(passages):
        if k % 2:
            p[5 + k] += "."
    passages += [["be"] * 51, ["so", "it", "is"] * 17, new(20) + ["be"] * 31, new(21) + ["."] + new(29)]
    texts = [" ".join([*new(9 + k % 5), *p, *new(7 + k % 3)]) for _ in range(2) for k, p in enumerate(passages)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for size in (1 << 22, 2000):
        got = {r.doc_id: r for r in span_dedup.dedup(df, block_bytes=size).collect()}
        assert {i: (r.n_sentences, r.n_removed, r.text) for i, r in got.items()} == span_dedup.brute_force(rows)
        for i, t in rows[len(passages) :]:
            lost = len(t.split()) - len(got[i].text.split())
            assert 15 <= lost <= 51, i
        assert all(got[i].text == t for i, t in rows[:40])


def test_lm_scores(docs, none, odd, rows):
    mu = 30.0
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    tokens = {i: [*words(t), "</s>"] for i, t in rows}
    one, two, starts = Counter(), Counter(), 0
    for i, t in tokens.items():
        if not held[i]:
            one.update(t)
            two.update(zip(["<s>", *t], t))
            starts += 1
    n, v = sum(one.values()), len(one)
    for r in lm_score.score_corpus(docs, mu=(mu,)).collect():
        t = tokens[r.doc_id]
        p = [(one[x] + 0.1) / (n + 0.1 * (v + 1)) for x in t]
        model = [(two[h, x] + mu * q) / ((starts if h == "<s>" else one[h]) + mu) for h, x, q in zip(["<s>", *t], t, p)]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(one[x] > 0 for x in t), n)
        assert r.base_score == pytest.approx(sum(map(math.log10, p))) and r.score == pytest.approx(sum(map(math.log10, model)))
    small = {r.doc_id: r.score for r in lm_score.score_corpus(docs, order=3, mu=(mu, mu)).collect()}
    split = {r.doc_id: r.score for r in lm_score.score(docs, ~lm_score.held_out(10, 0), 3, (mu, mu), block_bytes=5000).collect()}
    assert small == pytest.approx(split)
    assert lm_score.score_corpus(none).count() == 0 and lm_score.score_corpus(odd).count() == 6


def test_lm_arcs_sum_to_one():
    """All arcs of a state, with the unknown word, carry the whole probability."""
    texts = [b"a b a b c", b"b a", b"c c c"]
    data = lm_score.Block(texts, np.ones(3, bool), 2)
    tokens, types = int(data.counts[0].sum()), int((data.counts[0] > 0).sum())
    vocabulary = ["a", "b", "c"]
    total = 0.0
    for w in [*vocabulary, "never"]:
        probe = lm_score.Block([f"a {w}".encode()], np.zeros(1, bool), 2)
        totals = []
        for k in range(2):
            known = dict(zip(data.keys[k].tolist(), data.counts[k].tolist()))
            totals.append(np.array([known.get(x, 0) for x in probe.keys[k].tolist()]))
        _, _, whole = lm_score._traverse(probe, totals, tokens, types, 3, (5.0,))
        _, _, first = lm_score._traverse(_end_only(b"a"), [np.array([_count(data, 0, x) for x in _end_only(b"a").keys[0].tolist()]), np.array([_count(data, 1, x) for x in _end_only(b"a").keys[1].tolist()])], tokens, types, 3, (5.0,))
        assert np.isfinite(whole[0]) and np.isfinite(first[0])
        total += 10 ** (_step(data, tokens, types, "a", w))
    total += 10 ** (_step(data, tokens, types, "a", None))
    assert total == pytest.approx(1.0)


def _end_only(text):
    return lm_score.Block([text], np.zeros(1, bool), 2)


def _count(data, k, key):
    return dict(zip(data.keys[k].tolist(), data.counts[k].tolist())).get(key, 0)


def _step(data, tokens, types, context, word):
    """log10 of P(word | context), the end for None."""
    text = context if word is None else f"{context} {word}"
    probe = _end_only(text.encode())
    totals = [np.array([_count(data, k, x) for x in probe.keys[k].tolist()]) for k in range(2)]
    uni = totals[0][probe.at[0]]
    p = (uni + 0.1) / (tokens + 0.1 * (types + 1))
    gram = totals[1][probe.at[1]]
    before = np.concatenate([[3], uni[:-1]])
    return math.log10(((gram + 5.0 * p) / (before + 5.0))[1])


def test_quality_scores(spark, none, odd):
    good = [(i, ". ".join(prose(i * 7 + k, 9, 2000).capitalize() for k in range(6)), 1) for i in range(240)]
    junk = [(1000 + i, " ".join([f"w{i}!!"] * 40).upper(), 0) for i in range(60)]
    table = spark.createDataFrame([(i, t, "q", 5) for i, t, _ in good + junk] + [(5000, None, "q", 5), (5001, "", "q", 5)], "doc_id long, text string, quality string, score int")
    labels = spark.createDataFrame([(i, q, i) for i, _, q in good + junk], "doc_id long, quality int, h int")
    got = {r.doc_id: r for r in quality_pu.score(table, labels).collect()}
    assert len(got) == 302 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    out = {i for i in got if zlib.crc32(str(i).encode()) % 4 == 2}
    assert {i for i, r in got.items() if r.held_out} == out
    right = [got[i].predicted == q for i, _, q in good + junk if i in out]
    assert sum(right) / len(right) > 0.95
    kept = quality_pu.keep_good(table, labels)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    assert quality_pu.keep_good(none, labels).count() == 0 and quality_pu.keep_good(odd, labels.limit(0)).count() == 6
    assert quality_pu.score(none, labels).count() == 0
    assert {r.score for r in quality_pu.score(odd, labels.limit(0)).collect()} == {0.5}


def _plain_risk(w, p, u, prior):
    """Risk of the weights and its gradient, in plain numpy over all rows."""
    loss = lambda z: np.logaddexp(0, z).mean()
    negative = loss(u @ w) - prior * loss(p @ w)
    share = 1 / (1 + np.exp(-negative / quality_pu.BEND))
    pulled = u.T @ quality_pu._sigmoid(u @ w) / len(u) - prior * p.T @ quality_pu._sigmoid(p @ w) / len(p)
    gradient = -prior * p.T @ quality_pu._sigmoid(-p @ w) / len(p) + share * pulled + quality_pu.RIDGE * w
    return prior * loss(-p @ w) + quality_pu.BEND * np.logaddexp(0, negative / quality_pu.BEND) + quality_pu.RIDGE / 2 * w @ w, gradient


def test_quality_sums_reach_the_driver_once(spark, monkeypatch):
    """However many tasks there are, the driver gets one array: check_h, with 211, took more memory than it has."""
    n, width = 800, len(quality_pu.MEASURES)
    m = np.random.default_rng(3).random((n, width)).astype(np.float32)
    rows = [(k, row) for k, row in enumerate(m.tolist())]
    table = spark.createDataFrame(rows, "doc_id long, m array<float>").repartition(40, "doc_id")
    unlabelled, size = quality_pu.Unlabelled(table), 5 * width + 1
    got, collect = [], type(table).collect
    setting = "spark.sql.adaptive.coalescePartitions.enabled"  # else arrays as small as these meet in one task
    merging = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    monkeypatch.setattr(type(table), "collect", lambda self: got.append(collect(self)) or got[-1])
    try:
        sums = unlabelled.summed(lambda x, half: np.concatenate([[len(x)], *(x.sum(axis=0, dtype=float) * c for c in range(1, 6))]), size)
    finally:
        spark.conf.set(setting, merging)
    assert np.allclose(sums, np.concatenate([[n], *(m.sum(axis=0, dtype=float) * c for c in range(1, 6))]))
    assert sum(len(r.sums) for out in got for r in out) == 8 * size
    assert np.array_equal(unlabelled.summed(lambda x, half: np.array([len(x), half.sum()], float), 2)[:1], [n])
    assert not quality_pu.Unlabelled(table.limit(0)).summed(lambda x, half: np.ones(3), 3).any()


def test_quality_risk_is_over_all_rows(spark):
    """Knots, prior and weights against plain numpy on all rows: no other weights found by plain descent have less risk."""
    rng = np.random.default_rng(4)
    good = rng.random(3000) < 0.6
    m = np.abs(rng.normal(np.where(good, 0.3, 0.7)[:, None], 0.15, (3000, len(quality_pu.MEASURES)))).astype(np.float32)
    m[:, 5:] = rng.random((3000, m.shape[1] - 5))
    table = spark.createDataFrame([(i, x) for i, x in enumerate(m.tolist())], "doc_id long, m array<float>").repartition(4)
    labels = spark.createDataFrame([(i, 1) for i in range(3000) if good[i] and i % 3 == 0], "doc_id long, quality int")
    model = quality_pu.learn(table, labels, quality_pu.held_out(1, 0))
    for (values, counts), column in zip(quality_pu.Unlabelled(table).histograms(), m.T):
        assert counts.sum() == 3000 and np.allclose(np.repeat(values, counts.astype(int)), np.sort(column), rtol=2**-8)
    assert model.prior == pytest.approx(good.mean(), abs=0.12)
    u = quality_pu.Model.basis(m.astype(float), model.knots, model.scale)
    p = u[[i for i in range(3000) if good[i] and i % 3 == 0]]
    w = np.zeros(u.shape[1])
    for _ in range(1500):
        w -= 0.1 * _plain_risk(w, p, u, model.prior)[1]
    risk, gradient = _plain_risk(model.weights, p, u, model.prior)
    assert risk <= _plain_risk(w, p, u, model.prior)[0] + 1e-5 and np.abs(gradient).max() < 0.01
    few = quality_pu.learn(table, labels, quality_pu.held_out(1, 0), sample=40)
    assert (few.knots == model.knots).all() and few.score(m)[good].mean() > few.score(m)[~good].mean() + 0.1


def test_license_prefilter_spares_no_line_with_an_anchor(spark):
    """Lines that hold an anchor among their words always match the pattern that is tried first."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    anchors = ["license", "licensed", "mit", "gpl", "2.0", "by-nc", "apache"]
    bits = [*anchors, "x", " ", " ", ".", "-", ",", "(", "é", "MIT", "License", "licens", "\t", "3", "/"]
    df = spark.createDataFrame([("".join(rng.choice(bits) for _ in range(rng.randrange(1, 9))),) for _ in range(2000)], "p string")
    kept = F.lower("p").rlike(license_scan.starts_with_any(anchors))
    words = F.arrays_overlap(license_scan._words(F.col("p")), F.array(*[F.lit(a) for a in anchors]))
    counts = df.select(F.count_if(words & ~kept), F.count_if(words), F.count_if(~kept)).first()
    assert counts[0] == 0 and counts[1] > 100 and counts[2] > 100


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y\n<|endoftext|>", "<|endoftext| > <|endoftext|", "é<|endoftext|>\n\n z"])
def test_special_literals_are_tokens(text):
    from tokenizers import Tokenizer

    import public_tokenizers

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert np.frombuffer(packing.ByteTokenizer(*tokenizer()).encode(text), "<u4").tolist() == exact.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(docs, none, odd, rows):
    from tokenizers import Tokenizer

    import public_tokenizers

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs, tokenizer(), 256).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text in rows:
        ids = [*exact.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 256)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(none, tokenizer()).count() == 0 and packing.pack_documents(odd, tokenizer()).count() == 6


def test_frequent_shingles_are_counted_in_little_memory():
    """A task's counts, in blocks merged by ranges, against one count of all (174 MB where all were sorted at once)."""
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 1 << 20, 300))) for _ in range(8000)]
    texts += [text for text in texts[:50] for _ in range(4)] + ["one two", None, "", " "] * 5
    batches = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    most = {}

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            list(run(iter([batches.slice(0, 10)])))  # tables that are kept
            tracemalloc.start()
            most["rows"] = {s: c for out in run(iter([batches])) for s, c in zip(*(x.to_pylist() for x in out.columns))}
            most["bytes"] = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            raise StopIteration

    with pytest.raises(StopIteration):
        ngram_join.frequent_shingles(Docs())
    want = Counter()
    for text in texts:
        want.update(ngram_join.shingle_set(common.word_hashes([(text or "").encode()])[0], 5).view(np.int64).tolist())
    assert most["rows"] == {s: c for s, c in want.items() if c >= ngram_join.REPORT}
    assert most["bytes"] < 140e6


def test_tokenizer_cuts_like_the_vocabulary():
    encoder = packing.ByteTokenizer(*tokenizer())
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "Zo", " ", " ", "\n", "\t", "'s", "é", "12", "!", " ", "\x1c", "\0", "<|endoftext|>"]) for _ in range(rng.randrange(14)))
        assert encoder.encode(text) == encoder.whole(text), repr(text)


def test_fullest_bin_is_fullest():
    rng = random.Random(4)
    for _ in range(200):
        lengths = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 9))]
        limit = 50
        counts = np.bincount(lengths, minlength=limit + 1).tolist()
        chosen = packing.fullest(counts, limit)
        top, best = max(lengths), 0
        rest = sorted(lengths)
        rest.remove(top)
        sums = {0}
        for n in rest:
            sums |= {s + n for s in sums if s + n + top <= limit}
        best = top + max(sums)
        assert sum(chosen) == best and not Counter(chosen) - Counter(lengths)


def base_measures(text):
    w = SPACE_WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACE_WORD.search(x)]
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    often = {x for x, c in Counter(windows).items() if c > 1}
    hit = {p for k, x in enumerate(windows) if x in often for p in range(k, k + 8)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(docs, none, odd, rows):
    got = {r.doc_id: r for r in adaptive_rules.judge(docs).collect()}
    for i, t in rows:
        r, want = got[i], base_measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)
    assert adaptive_rules.judge(none).count() == 0 and adaptive_rules.judge(odd).count() == 6


def test_quality_rules_adapt(spark):
    """A source in which every text carries symbols keeps them; elsewhere they are out of line."""
    marked = lambda seed: prose(seed, 50).replace(" w", " #w")
    rich = [(i, marked(i), "en", "code") for i in range(300)]
    plain = [(1000 + i, prose(i + 400, 50), "en", "web") for i in range(300)] + [(2000, marked(9), "en", "web")]
    df = spark.createDataFrame(rich + plain, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in adaptive_rules.judge(df).filter("kept").collect()}
    assert {i for i, *_ in rich} <= kept and 2000 not in kept and 1000 in kept


def test_license_scan(spark, none, odd):
    texts = [
        "Some text.\nReleased under the MIT License.", "Licensed under the Apache License, Version 2.0.\nmore", "nothing here", None, "",
        "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.", "The license of the driver was lost in the street.",
    ]
    df = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in enumerate(texts)], "doc_id long, text string, g string, h string, par int")
    got = {r.doc_id: r.families for r in license_scan.scan(df.unionByName(df.limit(1))).collect()}
    assert got == {0: "MIT", 1: "Apache-2.0", 2: "", 3: "", 4: "", 5: "CC-BY-NC-4.0,GPL-3.0", 6: ""}
    assert license_scan.scan(none).count() == 0 and license_scan.scan(odd).count() == 6


def test_license_scan_tells_versions_apart(spark):
    other = [
        "This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 1.1.", "SPDX-License-Identifier: GPL-2.0-only",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Released under the Apache License 1.1.",
    ]
    family = {f"# SPDX-License-Identifier: {x}": f for x, f in (("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("GPL-3.0-or-later", "GPL-3.0"))}
    family |= {t: f for f, texts in license_scan.TEMPLATES.items() for t in texts}
    rows = [*((t, "") for t in other), *family.items()]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.families for r in license_scan.scan(df).collect()}
    assert {rows[i][0]: f for i, f in got.items()} == dict(rows)


def test_suffix_levels(docs, none, odd, rows):
    want = suffix_levels.brute_force(rows)
    for size in (1 << 22, 3000):
        got = {r.doc_id: tuple(r)[1:] for r in suffix_levels.digest(suffix_levels.repeated_bytes(docs, block_bytes=size)).collect()}
        assert got == want
    assert suffix_levels.repeated_bytes(none).count() == 0
    out = [(r.doc_id, r.n_removed) for r in suffix_levels.repeated_bytes(odd).collect()]
    assert sorted(n for i, n in out if i == 3) == [0, len(prose(7, 40).encode()), len(prose(7, 40).encode())]


def test_suffix_blocks_are_bounded_whatever_the_ids(spark):
    """One far id, one id on many rows (some of them alike), and null ids: no block above its size, order as the ids."""
    far = [(i, prose(i, 40)) for i in range(60)] + [(10**9, prose(7, 40)), (-(1 << 63), prose(8, 40)), ((1 << 63) - 1, prose(9, 40))]
    tied = [(20, prose(500 + i % 25, 40)) for i in range(50)] + [(None, prose(600 + i % 30, 40)) for i in range(40)] + [(None, None), (20, None)]
    df = spark.createDataFrame(far + tied, "doc_id long, text string").repartition(5)
    limit = 1500
    blocks = {}
    for r in suffix_levels._in_blocks(df, limit, 10).collect():
        blocks.setdefault(r.block, []).append((r.doc_id is not None, r.doc_id or 0, bytes(r.text)))
    assert sum(map(len, blocks.values())) == len(far + tied)
    assert all(sum(len(t) for *_, t in rows) <= limit for rows in blocks.values())
    ordered = [blocks[b] for b in sorted(blocks)]
    assert all(max(a) <= min(b) for a, b in zip(ordered, ordered[1:]))
    got = Counter(tuple(r) for r in suffix_levels.digest(suffix_levels.repeated_bytes(df, block_bytes=limit)).collect())
    rows = sorted(far + tied, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want = suffix_levels.brute_force([(k, t) for k, (_, t) in enumerate(rows)])
    assert got == Counter((i, *want[k]) for k, (i, _) in enumerate(rows))


def test_hash_ranges_grow_with_the_text(docs, rows, monkeypatch):
    """More ranges than the session has partitions, with the same answers."""
    least = common.shuffle_parts(docs)
    assert common.hash_ranges(docs, 1) == least and common.hash_ranges(docs, least * common.RANGE_BYTES + 1) == least + 1
    before = {r.doc_id: r.score for r in lm_score.score_corpus(docs).collect()}
    monkeypatch.setattr(common, "RANGE_BYTES", 9000)
    assert common.hash_ranges(docs, 200_000) > least
    got = {r.doc_id: r.score for r in lm_score.score(docs, ~lm_score.held_out(10, 0), block_bytes=200_000).collect()}
    assert got == pytest.approx(before)
    cut = suffix_levels.repeated_bytes(docs, block_bytes=200_000)
    assert {r.doc_id: tuple(r)[1:] for r in suffix_levels.digest(cut).collect()} == suffix_levels.brute_force(rows)


def test_suffix_anchors_are_dealt_evenly():
    """Anchors are least hashes, all of them small; as keys they must not all meet in the first hash range."""
    texts = [prose(i, 400, 10**6).encode() for i in range(80)]
    judged = suffix_levels._Judged(suffix_levels.Segments(texts, suffix_levels.WIDTH, suffix_levels.SEED), None)
    for keys in (judged.keys, judged.anchors):
        sizes = np.diff(suffix_levels._cuts(keys, 32))
        assert sizes.max() < 2 * sizes.mean()


def test_level_family_grows_geometrically():
    family = suffix_levels.LevelFamily()
    rng = np.random.default_rng(1)
    seen = set()
    for _ in range(60):
        keys = np.unique(rng.integers(0, 2000, 40, dtype=np.uint64))
        assert family.add(keys).tolist() == [k in seen for k in keys.tolist()]
        seen |= set(keys.tolist())
        assert len(family.levels) <= 12


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            good = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}
            if good[kind]():
                out.append((kind, m.start(), m.end()))
    return out


def test_pii(spark, none, odd, rows):
    more = [
        "a@b.cx%y@z.w x", "1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.0004", "x@y@z.com", "+1 (234) 555-1234.", "4242 4242-4242 4242 5", "a@b..c a@b.c.",
        "é 😀 joe@ex.com +49 30 123456", "call (212) 555-1234 now", "+1+123456789 0", "1" * 4000, "a" * 20000, "1 " * 3000, "joe@ex.com " * 300,
    ]
    rng = random.Random(11)
    more += ["".join(rng.choice(["1", "23", "4111111111111111", ".", "-", " ", "+", "@", "a.b", "(", "c"]) for _ in range(25)) for _ in range(150)]
    every = [*rows, *[(100 + i, t) for i, t in enumerate(more)]]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in every], "doc_id long, text string, cands string, all int")
    texts = dict(every)
    for r in pii_weak.find(df).collect():
        want = base_spans(texts[r.doc_id])
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        kinds = Counter(k for k, _, _ in want)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest(), texts[r.doc_id][:80]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in PII)
        assert set(filter(None, written.split(","))) <= set(r.spans.split(","))
    hidden = {r.doc_id: r.text for r in pii_weak.masked(df).collect()}
    assert hidden[0] is None and hidden[106] == "é 😀 <email> <phone>" and len(hidden) == len(every)
    assert pii_weak.find(none).count() == 0 and pii_weak.find(odd).count() == 6


def test_expectation_maximisation_separates():
    counts = {(0, (1, 1, 1, 1, 1, 1)): 500, (0, (1, 1, 1, 0, 1, 1)): 300, (0, (-1, -1, 0, -1, -1, -1)): 200, (0, (-1, -1, 1, 0, -1, 1)): 80, (0, (-1, 1, 1, 0, 1, 1)): 20}
    belief = pii_weak.expectation_maximisation(counts)
    assert belief[0, (1, 1, 1, 0, 1, 1)] > 0.9 and belief[0, (-1, -1, 0, -1, -1, -1)] < 0.1
    assert belief[0, (-1, 1, 1, 0, 1, 1)] > belief[0, (-1, -1, 1, 0, -1, 1)]
