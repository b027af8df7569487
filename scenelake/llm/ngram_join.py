"""N-gram Jaccard join: a grouped prefix join over sets of word shingles.

Equal sets are one class. Shingles have one global order (frequent ones last), and two sets that reach the threshold
share a shingle among the first ``n - ceil(t n) + 1`` of each. Classes of equal prefix and size form a group; group
pairs are filtered by size and by how many prefix shingles they share; what is left is expanded to classes and
verified on the whole sets. Links are found first against the most central group of each shingle; after that only
pairs across different components are tried, so groups of near copies never meet in all pairs, yet no two texts
that are linked end up in different components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import batches_of_text, cut, mix, shingle_hashes, word_hashes
from scenelake.operators.components import contract

SHINGLE = 5
#: The similarity, in hundredths.
PERCENT = 80
#: Shingles placed last in the global order: the most frequent ones, at most so many, so their table is bounded.
FREQUENT = 1 << 18
#: Candidate ids that are broadcast to the scan of their texts at most (8 bytes each); more are met in a shuffle.
BROADCAST_IDS = 1_000_000
#: Documents of one task that must share a shingle before the task reports it as frequent.
REPORT = 4
#: Shingles that a task sorts and counts at once.
BLOCK = 250_000
#: Bounds of the ranges of hashes that blocks are merged by.
RANGES = np.arange(1, 32, dtype=np.uint64) << np.uint64(59)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles of a text's word hashes; fewer than k words make one shingle."""
    if not len(words):
        return words
    if len(words) < k:
        x = np.array([len(words)], np.uint64)
        for w in words:
            x = mix(x) + w
        return mix(x)
    return np.unique(shingle_hashes(words, k))


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch, texts in batches_of_text(batches):
        words, first = word_hashes(texts)
        yield batch, [shingle_set(words[a:b], k) for a, b in zip(first, first[1:])]


def _counted(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of the sets, sorted, and how many sets hold each."""
    x = np.concatenate(sets)
    x.sort()
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]]))
    return x[first], np.diff(first, append=len(x)).astype(np.int32)


def _merged(blocks: list[tuple[np.ndarray, np.ndarray]], least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Sorted blocks of shingles and counts as one, counts below ``least`` left out.

    One range of hashes after the other, so that the copies made to sort them stay small.
    """
    edges = [[0, *np.searchsorted(keys, RANGES).tolist(), len(keys)] for keys, _ in blocks]
    out = []
    for r in range(len(RANGES) + 1):
        keys = np.concatenate([b[0][e[r] : e[r + 1]] for b, e in zip(blocks, edges)])
        counts = np.concatenate([b[1][e[r] : e[r + 1]] for b, e in zip(blocks, edges)])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
        if len(first):
            sums = np.add.reduceat(counts[order], first)
            keep = sums >= least
            out.append((keys[first][keep], sums[keep]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def frequent_shingles(docs: DataFrame, k: int = SHINGLE, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles over all documents and their counts, sorted by shingle; at most ``most``.

    Each task reports the shingles that at least ``REPORT`` of its documents hold; reports are summed. The table
    steers the order only: any order gives the same links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[tuple[np.ndarray, np.ndarray]] = []
        fresh: list[np.ndarray] = []
        waiting = size = 0
        for _, sets in _sets(batches, k):
            fresh += sets
            waiting += sum(map(len, sets))
            if waiting > BLOCK:
                blocks.append(_counted(fresh))
                size += waiting
                fresh, waiting = [], 0
            if size > 2_000_000:
                blocks, size = [_merged(blocks)], 0
                if len(blocks[0][0]) > 4_000_000:  # a long task reports in instalments
                    yield report(*_merged(blocks, REPORT))
                    blocks = []
        if fresh:
            blocks.append(_counted(fresh))
        if blocks:
            yield report(*_merged(blocks, REPORT))
        pa.default_memory_pool().release_unused()

    def report(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["s", "c"])

    counted = docs.select("text").mapInArrow(run, "s long, c long").groupBy("s").agg(F.sum("c").alias("c"))
    counted = cut(counted)
    # counts in classes of a quarter octave; whole classes are taken, from the largest down, while they fit
    size_class = F.floor(F.log2(F.col("c").cast("double")) * 4).cast("int")
    held, least = 0, None
    for k, n in sorted(((r[0], r[1]) for r in counted.groupBy(size_class.alias("k")).count().collect()), reverse=True):
        if held + n > most:
            break
        held, least = held + n, k
    top = counted.filter(size_class >= least if least is not None else F.lit(False)).toArrow()
    keys, counts = top.column("s").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def prefix_table(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, most: int = FREQUENT) -> DataFrame:
    """doc_id, n, sig (digest of the whole set), prefix (packed shingles in global order), rare (not frequent ones)."""
    keys, counts = frequent_shingles(docs, k, most)
    shared = docs.sparkSession.sparkContext.broadcast((keys, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = shared.value
        for batch, sets in _sets(batches, k):
            sizes, sigs, prefixes, rare = [], [], [], []
            for s in sets:
                n = len(s)
                sizes.append(n)
                sigs.append((mix(s + np.uint64(n)).sum(), mix(s ^ mix(s)).sum()) if n else (0, 0))
                length = n - (percent * n + 99) // 100 + 1 if n else 0
                if len(known) and n:
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    rank = np.where(known[at] == s, weight[at], 0)
                    s = s[np.argsort(rank, kind="stable")[:length]]
                    rare.append(int((np.sort(rank)[:length] == 0).sum()))
                else:
                    s = s[:length]
                    rare.append(length)
                prefixes.append(s.astype("<u8").tobytes())
            digest = np.array(sigs, np.uint64).reshape(-1, 2).view(np.int64)
            columns = [
                batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()),
                pa.array(prefixes, pa.binary()), pa.array(rare, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "sig1", "sig2", "prefix", "rare"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sig1 long, sig2 long, prefix binary, rare int")


def _tokens(table: DataFrame) -> DataFrame:
    """(token, gid, pos): the prefix shingles of each group with their place in the global order, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = {g: p for g, p in zip(batch.column("gid").to_pylist(), batch.column("prefix").to_pylist()) if p and g not in seen}
            seen.update(fresh)
            lists = [np.frombuffer(p, "<i8") for p in fresh.values()]
            if lists:
                gid = np.repeat(np.array(list(fresh), np.int64), [len(x) for x in lists])
                pos = np.concatenate([np.arange(len(x), dtype=np.int32) for x in lists])
                columns = [pa.array(np.concatenate(lists).astype(np.int64)), pa.array(gid), pa.array(pos)]
                yield pa.RecordBatch.from_arrays(columns, ["token", "gid", "pos"])

    return table.select("gid", "prefix").mapInArrow(run, "token long, gid long, pos int")


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether two sizes can reach the threshold at all."""
    low, high = F.least(f"{a}n", f"{b}n"), F.greatest(f"{a}n", f"{b}n")
    return low * 100 >= high * percent


def _enough_shared(a: str, b: str, percent: int) -> Column:
    """Whether so many shared prefix shingles leave the threshold within reach.

    Of the set whose prefix ends first in the global order, what lies behind the prefix can all be shared; nothing
    else can. Which of the two it is does not matter for the bound with the longer rest.
    """
    n = F.col(f"{a}n") + F.col(f"{b}n")
    need = F.ceil(n * percent / (100 + percent))
    rest = F.greatest(F.ceil(F.col(f"{a}n") * percent / 100), F.ceil(F.col(f"{b}n") * percent / 100)) - 1
    return F.col("shared") >= need - rest


def _size_class(n: Column) -> Column:
    """Sizes in classes of about twelve per cent, so that the sizes of possible partners lie in three."""
    return F.floor(F.log(n.cast("double")) * 8.3).cast("int")


def _meeting(spots: DataFrame, percent: int) -> DataFrame:
    """(ggid, hgid): pairs of groups from different components that can still reach the threshold.

    ``spots``: token, gid, pos, n, comp (null for a group of several components). With their first common shingle at
    ``pos``, sets share at most ``n - pos``, so both places must leave room for the overlap needed at the two sizes.
    The smaller set of a pair can only use the front of its prefix, and a place of the larger one reaches sizes up to
    a bound: postings meet by shingle and size class, and sets that have too much of their own in front never meet.
    """
    need = lambda n: F.ceil(n * percent / (100 + percent))
    names = ("gid", "n", "comp", "pos")
    front = spots.filter(F.col("pos") <= F.col("n") - need(2 * F.col("n")))
    left = front.select("token", _size_class(F.col("n")).alias("size"), *[F.col(c).alias(f"g{c}") for c in names])
    reach = F.floor((F.col("n") - F.col("pos")) * (100 + percent) / percent) - F.col("n")
    low, high = F.ceil(F.col("n") * percent / 100), F.least(F.col("n"), reach)
    classes = F.sequence(_size_class(low), _size_class(F.greatest(low, high)))
    right = spots.filter(low <= high).select("token", F.explode(classes).alias("size"), *[F.col(c).alias(f"h{c}") for c in names])
    both = need(F.col("gn") + F.col("hn"))
    return (
        left.join(right, ["token", "size"])
        .filter("gn < hn or (gn = hn and ggid < hgid)")
        .filter("coalesce(gcomp <> hcomp, true)")
        .filter(_may_link("g", "h", percent))
        .filter((F.col("gpos") <= F.col("gn") - both) & (F.col("hpos") <= F.col("hn") - both))
        .select("ggid", "hgid")
        .distinct()
    )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole sets reach the threshold."""

    @F.pandas_udf("boolean")
    def linked(x, y):
        import pandas as pd

        def test(p: bytes, q: bytes) -> bool:
            p, q = np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8")
            if len(p) > len(q):
                p, q = q, p
            common = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
            return 100 * common >= percent * (len(p) + len(q) - common)

        return pd.Series([test(p, q) for p, q in zip(x, y)], dtype=bool)

    one = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("x"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("s").alias("y"))
    return pairs.select("a", "b").join(two, "b").join(one, "a").filter(linked("x", "y")).select("a", "b")


def _set_table(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """doc_id, s: packed shingle set of the documents in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, k):
            packed = pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), packed], ["doc_id", "s"])

    ids = cut(ids)
    small = ids.count() <= BROADCAST_IDS
    wanted = docs.select("doc_id", "text").join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")
    return wanted.mapInArrow(run, "doc_id long, s binary")


def _links(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    pairs = cut(pairs.distinct())
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    return cut(_verified(pairs, cut(_set_table(docs, ids, k)), percent))


def _components(links: DataFrame) -> DataFrame:
    """(cid, comp) of every class in a link."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    return contract(edges, ()).select(F.col("a").alias("cid"), F.col("b").alias("comp"))


def link_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, most: int = FREQUENT) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs``.

    Texts that are null, empty or without words have no shingles and are linked with nothing. Repeated rows have the
    same answer; rows that share a doc_id share a component. A null doc_id stays null and is linked with nothing.
    Documents of equal sets need no verification: their class answers for all. Further columns are not read.
    """
    docs = docs.select("doc_id", "text")
    table = cut(prefix_table(docs.filter("doc_id is not null"), k, percent, most).withColumn("gid", F.xxhash64("n", "prefix")))
    same_set = table.filter("n > 0").groupBy("n", "sig1", "sig2")
    classes = cut(same_set.agg(F.min("doc_id").alias("cid"), F.min("gid").alias("gid"), F.min("rare").alias("rare")))
    members = classes.select("gid", "cid", "n")
    groups = classes.groupBy("gid").agg(F.min("n").alias("n"), F.min("rare").alias("rare"), F.min("cid").alias("first"), F.count("*").alias("m"))
    all_tokens = _tokens(table)
    lists = all_tokens.groupBy("token").agg(F.min("gid").alias("lo"), F.max("gid").alias("hi")).filter("lo <> hi").select("token")
    posted = cut(all_tokens.join(lists, "token").distinct())
    listed = groups.join(posted.select("gid").distinct(), "gid", "left_semi")
    facts = cut(groups.filter("m > 1").unionByName(listed).distinct().drop("m"))

    # classes of one group against the first of it
    inside = members.join(facts.select("gid", "first"), "gid").filter("cid <> first").select(F.col("first").alias("a"), F.col("cid").alias("b"))

    # each group against the central group of its shingles with which it shares most
    fact = lambda p: facts.select(*[F.col(c).alias(f"{p}{c}") for c in facts.columns])
    rich = posted.join(facts, "gid")
    hubs = rich.groupBy("token").agg(F.min(F.struct(F.col("rare") / F.col("n"), "first", "gid", "n")).alias("h")).select(
        "token", F.col("h.gid").alias("hgid"), F.col("h.first").alias("a"), F.col("h.n").alias("hn")
    )
    star = (
        rich.select("token", "gid", F.col("n").alias("gn"), F.col("first").alias("b"))
        .join(hubs, "token")
        .filter(F.col("gid") != F.col("hgid"))
        .filter(_may_link("g", "h", percent))
        .groupBy("a", "b", "gn", "hn")
        .agg(F.count("*").alias("shared"))
        .filter(_enough_shared("g", "h", percent))
        .groupBy("b")
        .agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a"))
    )
    found = _links(docs, inside.unionByName(star.select("a", "b")), k, percent)
    comps = _components(found)

    # whatever still lies in different components and shares enough
    place = cut(members.join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")))
    mixed_groups = place.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    mixed = posted.join(mixed_groups, "gid").groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select("token")
    alone = mixed_groups.select("gid", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("comp"))
    spots = posted.join(mixed, "token").join(alone.join(facts.select("gid", "n"), "gid"), "gid").withColumn("n", F.col("n").cast("int"))
    # of each group, the shingles that any other group shares; a prefix bounds their number
    shares = posted.groupBy("gid").agg(F.collect_list("token").alias("t")).join(facts.select("gid", "n"), "gid")
    side = lambda p: shares.select(*[F.col(c).alias(f"{p}{c}") for c in ("gid", "n", "t")])
    met = cut(_meeting(spots, percent)).join(side("g"), "ggid").join(side("h"), "hgid")
    group_pairs = met.withColumn("shared", F.size(F.array_intersect("gt", "ht"))).filter(_enough_shared("g", "h", percent)).select("ggid", "hgid")
    same_group = mixed_groups.filter("lo <> hi").select(F.col("gid").alias("ggid"), F.col("gid").alias("hgid"))
    one = place.select(F.col("gid").alias("ggid"), F.col("cid").alias("a"), F.col("comp").alias("ca"))
    two = place.select(F.col("gid").alias("hgid"), F.col("cid").alias("b"), F.col("comp").alias("cb"))
    rest = group_pairs.unionByName(same_group).join(one, "ggid").join(two, "hgid").filter("ca <> cb")
    tried = inside.unionByName(star.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(cut(tried), ["a", "b"], "left_anti")
    late = _links(docs, rest, k, percent)
    comps = _components(found.unionByName(late))

    named = classes.select("n", "sig1", "sig2", "cid").join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    answer = (
        table.select("doc_id", "n", "sig1", "sig2")
        .join(named.select("n", "sig1", "sig2", "comp"), ["n", "sig1", "sig2"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))
    )
    blank = docs.filter("doc_id is null")
    if blank.isEmpty():
        return answer
    own = prefix_table(blank, k, percent, 0)
    return answer.unionByName(own.select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def keep_one(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each component, that of the smallest doc_id, all columns as they are.

    Documents without words stay, and so do those without doc_id. Rows that repeat a doc_id stay together.
    """
    linked = link_components(docs, k, percent).filter("doc_id is not null")
    gone = linked.filter("n_shingles > 0 and doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
