"""Prefix trie of conversations by distributed burst tries.

Turns become 64-bit ids and a conversation one row of ids. Equal conversations are one weighted sequence first, so that
a conversation with a third of all copies is one row. A container holds the sequences below one trie node; at first
there is one for each first turn. A container of too many turns bursts: the turns that all its sequences share become
head nodes, and its sequences move on to one container for each next turn id. Containers that stay are sorted and swept
once from left to right, with no more in memory than the open path and the nodes below it that wait for their parent.
Totals of containers flow back to the heads, last burst first.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import shuffle_parts
from scenelake.session import cut_lineage

#: Conversations of one template share their first turns; turns that may be shared.
FAMILY, MOST_SHARED = 20, 3
#: Turns that a container may hold before it bursts, and tasks that the sequences of one container are dealt to until then.
LIMIT, SALTS = 1024, 64
#: Rows of a result batch, and ids whose decimal text is one piece of a hash.
BATCH, PIECE = 20_000, 400

NO_ENDS = hashlib.sha256(b"").hexdigest()
_WORD = r"[^\x20\x09-\x0D]+"
_SEQUENCE = "conv_id long, ids array<long>, words array<int>"
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, up string"
_NODE_TYPES = [pa.int64()] * 7 + [pa.string()] * 2
_NODE_NAMES = [f.split()[0] for f in _NODE.split(", ")]


def shared_turns(conv_id: int) -> int:
    """How many turns a conversation takes from the first of its family."""
    return zlib.crc32(str(conv_id).encode()) % (MOST_SHARED + 1)


# --- sequences of turn ids
def _turns(conversations: DataFrame) -> DataFrame:
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.col("conv_id").cast("long")
    return conversations.where(F.col("conv_id").isNotNull()).select(
        own.alias("conv_id"), (own - own % FAMILY).alias("base"), F.col("turn").alias("turn"), F.xxhash64(role, text).alias("id"), F.regexp_count(text, F.lit(_WORD)).cast("int").alias("words")
    )


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order of (base, whether another than the base, conversation, turn) become rebuilt conversations.

    A conversation may run over any number of batches; only its ids and word counts are kept, 12 bytes a turn.
    """
    shared: tuple[int, np.ndarray, np.ndarray] | None = None
    pieces: list[tuple[np.ndarray, np.ndarray]] = []
    current: tuple[int, int] | None = None
    done: list[tuple[int, np.ndarray, np.ndarray]] = []
    held = 0

    def close() -> None:
        nonlocal shared, held
        ids, words = (np.concatenate([p[k] for p in pieces]) if len(pieces) > 1 else pieces[0][k] for k in (0, 1))
        conv, base = current
        if conv == base:
            shared = (base, ids[:MOST_SHARED].copy(), words[:MOST_SHARED].copy())
        h = shared_turns(conv)
        if conv != base:
            known = shared is not None and shared[0] == base
            ids = np.concatenate([shared[1][:h], ids[h:]]) if known else ids[h:]
            words = np.concatenate([shared[2][:h], words[h:]]) if known else words[h:]
        done.append((conv, ids, words))
        held += len(ids) + 8

    def batch_of() -> pa.RecordBatch:
        ends = np.zeros(len(done) + 1, np.int32)
        np.cumsum([len(d[1]) for d in done], out=ends[1:])
        ids, words = np.concatenate([d[1] for d in done]), np.concatenate([d[2] for d in done])
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (ids, words)]
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), *lists], ["conv_id", "ids", "words"])

    for batch in batches:
        if not batch.num_rows:
            continue
        conv, base, ids, words = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("conv_id", "base", "id", "words"))
        edges = [0, *(np.flatnonzero(np.diff(conv)) + 1).tolist(), len(conv)]
        for s, e in zip(edges, edges[1:]):
            key = (int(conv[s]), int(base[s]))
            if current is not None and key != current:
                close()
                pieces = []
            current = key
            pieces.append((ids[s:e].copy(), words[s:e].copy()))
        if held > BATCH:
            yield batch_of()
            done, held = [], 0
    if current is not None:
        close()
        yield batch_of()


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, ids, words: the rebuilt conversations, by one shuffle of ids; turns of one number go by their id."""
    turns = _turns(conversations)
    dealt = turns.repartition(shuffle_parts(turns), "base")
    ordered = dealt.sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "id", "words")
    return ordered.mapInArrow(_rebuilt, _SEQUENCE)


# --- hashes of the members that end at a node
def _cut_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in order of (k1, k2, conv_id) become comma-joined pieces of one key each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2", "conv_id"))
        edges = [0, *(np.flatnonzero((np.diff(k1) != 0) | (np.diff(k2) != 0)) + 1).tolist(), len(ids)]
        cuts = [s for a, b in zip(edges, edges[1:]) for s in range(a, b, PIECE)]
        text = [",".join(map(str, ids[s:e].tolist())) for a, b in zip(edges, edges[1:]) for s in range(a, b, PIECE) for e in [min(s + PIECE, b)]]
        at = pa.array(cuts, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("k1", "k2")), batch.column("conv_id").take(at), pa.array(text)], ["k1", "k2", "first", "text"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of (k1, k2, first): one running hash a key, whatever the number of its members."""
    key, sha, rows = None, None, []
    for batch in batches:
        for k1, k2, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text"))):
            if (k1, k2) != key:
                if key is not None:
                    rows.append((*key, sha.hexdigest()))
                key, sha = (k1, k2), hashlib.sha256(text.encode())
            else:
                sha.update(b",")
                sha.update(text.encode())
        if len(rows) > BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["k1", "k2", "sha"])
            rows = []
    if key is not None:
        rows.append((*key, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["k1", "k2", "sha"])


def _keys(ids: Column) -> list[Column]:
    return [F.xxhash64(ids).alias("k1"), F.xxhash64(F.lit(1), ids).alias("k2")]


def _end_hashes(seqs: DataFrame) -> DataFrame:
    """k1, k2, sha of every distinct sequence: ids are sorted over all tasks, so that copies of one sequence are spread."""
    parts = shuffle_parts(seqs)
    members = seqs.select("conv_id", *_keys(F.col("ids")))
    pieces = members.repartitionByRange(parts, "k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id").mapInArrow(_cut_ids, "k1 long, k2 long, first long, text string")
    return pieces.repartition(parts, "k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_hashed, "k1 long, k2 long, sha string")


# --- bursting
def _next_container(key: Column, turn: Column) -> Column:
    return F.md5(F.concat_ws(":", key, turn.cast("string")).cast("binary"))


def _with_container(held: DataFrame, facts: DataFrame, how: str) -> DataFrame:
    """Sequences with what is known of their container; those of one container meet its row in many tasks."""
    spread = held.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS)).cast("int"))
    copies = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.join(copies, ["key", "salt"], how).drop("salt")


def _burst(held: DataFrame, limit: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Containers that stay, and the heads of each round.

    Rounds go on until no container of several sequences holds more than ``limit`` turns beyond its head; each round
    ends at the next turn in which the sequences of a container differ, so their number follows the branching only.
    """
    stay, heads = [], []
    while True:
        sizes = held.groupBy("key").agg(F.sum(F.size("ids") - F.col("k") + 1).alias("turns"), F.count(F.lit(1)).alias("many"))
        large = sizes.where((F.col("turns") > limit) & (F.col("many") > 1)).select("key", F.lit(True).alias("large"))
        marked = cut_lineage(_with_container(held, large, "left"))
        stay.append(marked.where("large is null").drop("large"))
        hot = marked.where("large").drop("large")
        if hot.isEmpty():
            return stay, heads
        own = F.struct("ids", "words")
        both = hot.groupBy("key").agg(
            F.first("k").alias("k"), F.first("up").alias("up"), F.first("up_lo").alias("up_lo"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.min(own).alias("a"), F.max("ids").alias("b")
        )
        same = F.zip_with(F.col("a.ids"), F.col("b"), lambda x, y: x.eqNullSafe(y))
        shared = both.withColumn("l", (F.array_position(same, False) - 1).cast("int"))
        shared = shared.select("key", "k", "up", "up_lo", "n", "lo", "l", F.slice("a.words", F.col("k"), F.col("l") - F.col("k") + 1).alias("chain"))
        moved = cut_lineage(_with_container(hot, shared.select("key", "l", F.col("lo").alias("head_lo")), "inner"))
        ends = F.size("ids") == F.col("l")
        ended = moved.where(ends).select("key", "sha")
        heads.append(cut_lineage(shared.join(ended, "key", "left")))
        turn = F.get("ids", F.col("l"))
        held = moved.where(~ends).select("ids", "words", "n", "lo", "sha", _next_container(F.col("key"), turn).alias("key"), (F.col("l") + 1).alias("k"), F.col("key").alias("up"), F.col("head_lo").alias("up_lo"))


# --- sweeping
class _Open:
    """A stretch of turns (depths top..last) that the same members share, still open in the sweep."""

    __slots__ = ("below", "children", "last", "leaves", "lo", "n", "saved", "sha", "top", "words")

    def __init__(self, top: int, words: np.ndarray, n: int, lo: int, sha: str, children: int, leaves: int, saved: int):
        self.top, self.last, self.words = top, top + len(words) - 1, words
        self.n, self.lo, self.sha, self.children, self.leaves, self.saved = n, lo, sha, children, leaves, saved
        self.below: list[_Open] = []


def _rows_of(node: _Open, parent: int | None, up: str | None, out: list[tuple]) -> None:
    """Rows of a closed stretch; ``saved`` counts what lies below its last depth."""
    saved, words = node.saved, node.words.tolist()
    for d in range(node.last, node.top - 1, -1):
        saved += (node.n - 1) * words[d - node.top]
        end, top = d == node.last, d == node.top
        out.append((node.lo, d, parent if top else node.lo, node.n, node.children if end else 1, node.leaves, saved, node.sha if end else NO_ENDS, up if top else None))


def _total(node: _Open) -> int:
    return node.saved + (node.n - 1) * int(node.words.sum(dtype=np.int64))


class _Sweep:
    """One container after another, each with its sequences in order."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.path: list[_Open] = []
        self.ids: np.ndarray | None = None
        self.key: tuple | None = None

    def _close(self, depth: int) -> None:
        """Close what lies deeper than ``depth``, splitting the stretch that crosses it."""
        while self.path and self.path[-1].last > depth:
            node = self.path.pop()
            if node.top <= depth:
                keep = depth - node.top + 1
                lower = _Open(depth + 1, node.words[keep:], node.n, node.lo, node.sha, node.children, node.leaves, node.saved)
                lower.below = node.below
                upper = _Open(node.top, node.words[:keep], node.n, node.lo, NO_ENDS, 1, node.leaves, _total(lower))
                self._finish(lower)
                upper.below = [lower]
                self.path.append(upper)
            else:
                self._finish(node)
                if self.path:
                    above = self.path[-1]
                    above.below.append(node)
                    above.n, above.lo = above.n + node.n, min(above.lo, node.lo)
                    above.leaves = above.leaves + node.leaves if above.children else node.leaves
                    above.children, above.saved = above.children + 1, above.saved + _total(node)
                else:
                    _rows_of(node, self.key[2], self.key[1], self.rows)

    def _finish(self, node: _Open) -> None:
        """The members of ``node`` are known: write what waits below it."""
        for child in node.below:
            _rows_of(child, node.lo, None, self.rows)
        node.below = []

    def add(self, key: tuple, k: int, ids: np.ndarray, words: np.ndarray, n: int, lo: int, sha: str) -> None:
        if key != self.key:
            self.end()
            self.key, shared = key, k - 1
        else:
            m = min(len(ids), len(self.ids))
            differ = np.flatnonzero(ids[:m] != self.ids[:m])
            shared = int(differ[0]) if len(differ) else m
            self._close(shared)
        # the members of an open stretch are counted as its children close, so the new part starts with its own alone
        self.path.append(_Open(shared + 1, words[shared:], n, lo, sha, 0, 1, 0))
        self.ids = ids

    def end(self) -> None:
        self._close(-1)
        self.path, self.ids = [], None

    def batch(self) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*self.rows), _NODE_TYPES)]
        self.rows = []
        return pa.RecordBatch.from_arrays(columns, _NODE_NAMES)


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sweep = _Sweep()
    for batch in batches:
        lists = {c: batch.column(c) for c in ("ids", "words")}
        edges = lists["ids"].offsets.to_numpy()
        ids, words = lists["ids"].values.to_numpy(), lists["words"].values.to_numpy()
        rest = [batch.column(c).to_pylist() for c in ("key", "up", "up_lo", "k", "n", "lo", "sha")]
        for j, (key, up, up_lo, k, n, lo, sha) in enumerate(zip(*rest)):
            sweep.add((key, up, up_lo), k, ids[edges[j] : edges[j + 1]].copy(), words[edges[j] : edges[j + 1]].copy(), n, lo, sha)
            if len(sweep.rows) > BATCH:
                yield sweep.batch()
    sweep.end()
    if sweep.rows:
        yield sweep.batch()


def _head_rows(heads: DataFrame, tops: DataFrame) -> DataFrame:
    """Rows of the head nodes of one round; ``tops`` has the totals of the containers below each."""
    full = heads.join(tops, heads["key"] == tops["below"]).drop("below")
    every = full.select("*", F.posexplode("chain").alias("p", "w"))
    last = F.col("p") == F.size("chain") - 1
    deeper = F.aggregate(F.slice("chain", F.col("p") + 1, F.size("chain")), F.lit(0).cast("long"), lambda s, x: s + x)
    return every.select(
        F.col("lo").alias("conv_id"),
        (F.col("k") + F.col("p")).cast("long").alias("depth"),
        F.when(F.col("p") == 0, F.col("up_lo")).otherwise(F.col("lo")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") + (F.col("n") - 1) * deeper).alias("saved_tokens"),
        F.when(last, F.coalesce("sha", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends_sha256"),
        F.when(F.col("p") == 0, F.col("up")).alias("up"),
    )


def _tops(nodes: DataFrame) -> DataFrame:
    below = nodes.where("up is not null").groupBy(F.col("up").alias("below"))
    return below.agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))


def build(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per trie node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty, null turns come first, turns of one number go by the hash of role and text;
    repeated rows are turns of their own. Rows without conv_id belong to no conversation. The root is there as soon as
    one conversation is; an empty table gives no rows. Further columns are not read. A conversation is one row of 12
    bytes a turn; turns are told apart by 64-bit hashes below one parent.
    """
    seqs = cut_lineage(sequences(conversations))
    distinct = seqs.groupBy("ids", "words").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("lo"))
    weighted = cut_lineage(distinct.select("*", *_keys(F.col("ids"))).join(_end_hashes(seqs), ["k1", "k2"]).drop("k1", "k2"))
    none = F.size("ids") == 0
    root = weighted.agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max(F.when(none, F.col("sha"))).alias("sha"))
    n, lo, sha = root.first()
    if n is None:
        return seqs.sparkSession.createDataFrame([], _NODE).drop("up")
    first = F.get("ids", F.lit(0))
    held = weighted.where(~none).select("ids", "words", "n", "lo", "sha", _next_container(F.lit(""), first).alias("key"), F.lit(1).alias("k"), F.lit("").alias("up"), F.lit(lo).alias("up_lo"))
    stay, heads = _burst(held, limit)
    calm = stay[0]
    for part in stay[1:]:
        calm = calm.unionByName(part)
    ordered = calm.repartition(shuffle_parts(calm), "key").sortWithinPartitions("key", "ids")
    swept = cut_lineage(ordered.mapInArrow(_swept, _NODE))
    calm_tops = cut_lineage(_tops(swept))
    parts, tops = [swept], calm_tops
    for part in reversed(heads):
        parts.append(_head_rows(part, tops))
        both = calm_tops.unionByName(_tops(parts[-1])).groupBy("below")
        tops = cut_lineage(both.agg(*[F.sum(c).alias(c) for c in ("children", "leaves", "saved")]))
    below = tops.where("below = ''").first()
    children, leaves, saved = (below.children, below.leaves, below.saved) if below else (0, 1, 0)
    nodes = seqs.sparkSession.createDataFrame([(lo, 0, None, n, children, leaves, saved, sha or NO_ENDS, None)], _NODE)
    for part in parts:
        nodes = nodes.unionByName(part)
    return nodes.drop("up")
