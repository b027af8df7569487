"""The conversation trie against plain dictionaries: copies, shared first turns, bursts, nulls, ties, absent bases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from scenelake.llm import conversation_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, id long, key string, base int, words string"


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        rest = abs(c) % 20
        built[c] = tuple(turns.get(c - rest if c >= 0 else c + rest, [])[:h] + own[h:])
    members, below = defaultdict(list), defaultdict(set)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                below[path[: d - 1]].add(path[:d])
    out = {}

    def walk(path):
        parts = [walk(p) for p in below[path]]
        own = (len(members[path]) - 1) * len(WORD.findall(path[-1][1])) if path else 0
        leaves, saved = sum(p[0] for p in parts) if parts else 1, own + sum(p[1] for p in parts)
        ends = ",".join(map(str, sorted(c for c in members[path] if len(built[c]) == len(path))))
        parent = min(members[path[:-1]]) if path else None
        out[min(members[path]), len(path)] = (parent, len(members[path]), len(parts), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
        return leaves, saved

    if members:
        walk(())
    return out


def of(df):
    rows = df.collect()
    got = {(r.conv_id, r.depth): tuple(r)[2:] for r in rows}
    assert len(got) == len(rows)
    return got


def made(seed, n):
    rng = random.Random(seed)
    stems = [[], [("s", "be brief")], [("s", "be brief"), ("u", "hello  you")], [("s", "be brief"), ("u", "hello  you"), ("a", "é ü\tz")]]
    rows = []
    for c in rng.sample(range(-60, 500), n):
        turns = rng.choice(stems) + [(rng.choice(["u", "a", None]), rng.choice(["x", "y z", "", None, "w w w"])) for _ in range(rng.randrange(6))]
        rows += [(c, k or rng.choice([None, 0]), r, t, 1, "k", 2, "w") for k, (r, t) in enumerate(turns)]
    return rows


@pytest.mark.parametrize(("seed", "n", "limit"), [(1, 150, 4096), (2, 150, 4)])
def test_against_brute_force(spark, seed, n, limit):
    rows = made(seed, n)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert of(conversation_trie.build(df, limit)) == brute(rows)


def test_copies_and_long_paths(spark):
    """One conversation in many copies, two that part after 300 turns, one that ends where others go on."""
    long = [("u", f"turn {k}") for k in range(300)]
    rows = [(c, k, r, t) for c in range(400, 1000) for k, (r, t) in enumerate([("s", "one"), ("u", "two words")])]
    rows += [(c, k, r, t) for c, tail in ((20, "a"), (40, "b"), (60, None)) for k, (r, t) in enumerate(long + ([("a", tail)] if tail else []))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    assert of(conversation_trie.build(df, 50)) == brute(rows)


def test_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    none = spark.createDataFrame([], schema)
    assert conversation_trie.build(none).count() == 0
    assert conversation_trie.build(spark.createDataFrame([(None, 1, "u", "x")], schema)).count() == 0
    # a conversation without turns of its own left, a repeated row, and one very long text
    rows = [(7, 0, "u", "x"), (5, 0, "u", "a"), (5, 0, "u", "a"), (20, 0, None, "w " * 50_000), (21, None, "u", None)]
    assert of(conversation_trie.build(spark.createDataFrame(rows, schema))) == brute(rows)
    only = [(1, 0, "u", "x")]
    got = of(conversation_trie.build(spark.createDataFrame(only, schema)))
    assert got == brute(only) and got[1, 0][2:4] == (0, 1)


def test_members_hash_is_cut_in_pieces(spark):
    ids = list(range(0, 3 * conversation_trie.PIECE * 20, 20))
    df = spark.createDataFrame([(i, 0, "u", "same") for i in ids], "conv_id long, turn long, role string, text string").repartition(6)
    got = of(conversation_trie.build(df))
    assert got[0, 1][5] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
