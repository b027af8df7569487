"""Exact substring dedup with a logarithmic family of sparse suffix indexes.

A byte window of the given width is removed when the same string starts earlier (in a smaller doc_id, or before in
the same document). Every window is represented by the least hash of the short strings inside it; windows in a row
with the same least hash make a segment, so equal windows lie at equal places of segments with equal anchors.

1. Texts are cut into blocks in the order of doc_id. Each block sends its distinct segments, as fingerprints, by
   hash range. A range keeps an index family: each new batch is sorted, merge-scanned against the levels so far
   (what is found there starts earlier), and becomes a level of its own; levels of like size merge.
2. Segments that occur before are repeats as a whole. Of the others, only anchors with several different segments
   (the edges of repeated passages, and self-repeating text) can hide repeated windows: these send every window,
   and go through a second family of levels.
3. Each block gathers its repeated windows and takes the bytes they cover out of the texts.

The suffixes are sparse (one segment in some thirty bytes) and sorted by fingerprint instead of by bytes: equal
prefixes are neighbours all the same, and no text needs to be kept in the index.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import BUFFER_BYTES, RollingHash, hash_ranges, joined, mix, shuffle_parts, sliding_min, text_blocks
from scenelake.session import cut_lineage

WIDTH = 100
#: Length of the strings from which a window's anchor is taken.
SEED = 40
BLOCK_BYTES = 2 << 20
#: Segments looked into at once.
SLICE = 1 << 12
#: Blocks that one task lays out, about.
BLOCKS_PER_RANGE = 8


class LevelFamily:
    """Sorted arrays of distinct keys; no two levels are within a factor of two in size for long."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def known(self, keys: np.ndarray) -> np.ndarray:
        """Which of the sorted keys lie in any level."""
        found = np.zeros(len(keys), bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level, keys), len(level) - 1)
            found |= level[at] == keys
        return found

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Scan a sorted batch against all levels, then make what is new a level; returns what was known."""
        found = self.known(keys)
        fresh = keys[~found]
        while len(fresh) and self.levels and len(self.levels[-1]) <= 2 * len(fresh):
            both = np.concatenate([self.levels.pop(), fresh])
            both.sort(kind="stable")
            fresh = both
        if len(fresh):
            self.levels.append(fresh)
            self.levels.sort(key=len, reverse=True)
        return found


class Segments:
    """Segments of a block's texts, in order: first and last window start, anchor, fingerprint, self-repeat."""

    def __init__(self, texts: list[bytes], width: int, seed: int):
        self.width, self.texts = width, texts
        self.base, self.hashes = [], []
        parts: list[tuple] = []
        first = size = offset = 0
        for i, t in enumerate(texts):
            size += len(t) + 1
            if size >= BUFFER_BYTES or i == len(texts) - 1:
                parts.append(self._scan(texts[first : i + 1], offset, seed))
                offset += size
                first, size = i + 1, 0
        kinds = (np.int64, np.int64, np.uint64, np.uint64, bool, np.int64)
        columns = zip(*parts) if parts else [[]] * 6
        self.start, self.end, self.anchor, self.print, self.folds, self.buffer = (
            np.concatenate([np.zeros(0, k), *c]) for c, k in zip(columns, kinds)
        )
        self.total = offset

    def _scan(self, texts: list[bytes], offset: int, seed: int) -> tuple:
        data, starts = joined(texts)
        rolling = RollingHash(data)
        self.base.append(offset)
        self.hashes.append(rolling)
        width, n = self.width, len(data) - self.width + 1
        inside = np.zeros(max(n, 0) + 1, np.int8)
        long = np.flatnonzero(np.diff(starts) - 1 >= width)
        inside[starts[long]] += 1
        inside[starts[long + 1] - width] -= 1
        at = np.flatnonzero(np.cumsum(inside[:-1]))
        if not len(at):
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool), none
        seeds = rolling.windows(seed)
        reach = width - seed + 1
        anchor = sliding_min(seeds, reach)[at]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (anchor[1:] != anchor[:-1])
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(at)) - 1
        s, e, a = at[begin], at[last], anchor[begin]
        span = np.arange(reach)
        left, right = s + 0, e + reach - 1
        for k in range(0, len(s), SLICE):
            part = slice(k, k + SLICE)
            left[part] += np.argmin(seeds[s[part, None] + span], axis=1)
            right[part] -= np.argmin(seeds[e[part, None] + span[::-1]], axis=1)
        return s + offset, e + offset, a, rolling.ranges(s, e + width), left != right, np.full(len(s), len(self.base) - 1)

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and fingerprints of all windows of the chosen segments, in order."""
        starts, prints = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for b, (base, rolling) in enumerate(zip(self.base, self.hashes)):
            own = chosen[self.buffer[chosen] == b]
            if len(own):
                size = self.end[own] - self.start[own] + 1
                at = np.repeat(self.start[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
                starts.append(at)
                prints.append(rolling.ranges(at - base, at - base + self.width))
        return np.concatenate(starts), np.concatenate(prints)


def _first_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the first place of each, and the distinct key of each place."""
    return np.unique(keys, return_index=True, return_inverse=True)


def _cuts(keys: np.ndarray, parts: int) -> list[int]:
    step = (1 << 64) // parts
    return [0, *np.searchsorted(keys, np.array([step * p for p in range(1, parts)], np.uint64)).tolist(), len(keys)]


def _send(block: int, kind: int, keys: np.ndarray, extra: np.ndarray | None, parts: int) -> Iterator[pa.RecordBatch]:
    cuts = _cuts(keys, parts)
    rows = [(p, a, b) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    none = np.zeros(0, np.uint32)
    columns = [
        pa.array([p for p, _, _ in rows], pa.int32()),
        pa.array([block] * len(rows), pa.int64()),
        pa.array([kind] * len(rows), pa.int32()),
        pa.array([keys[a:b].astype("<u8").tobytes() for _, a, b in rows], pa.binary()),
        pa.array([(none if extra is None else extra[a:b]).astype("<u4").tobytes() for _, a, b in rows], pa.binary()),
    ]
    yield pa.RecordBatch.from_arrays(columns, ["part", "block", "kind", "keys", "extra"])


_ASKED = "part int, block long, kind int, keys binary, extra binary"
_ANSWERED = "part int, block long, kind int, n int, flags binary"


def _reply(rows: list[tuple], flags: list[np.ndarray]) -> pa.Table:
    part, block, kind = zip(*rows)
    return pa.table(
        {
            "part": pa.array(part, pa.int32()),
            "block": pa.array(block, pa.int64()),
            "kind": pa.array(kind, pa.int32()),
            "n": pa.array([len(f) for f in flags], pa.int32()),
            "flags": pa.array([np.packbits(f).tobytes() for f in flags], pa.binary()),
        }
    )


def _tidy(result: pa.Table) -> pa.Table:
    """Hand memory of a finished group back, so that a worker does not keep the most that any group took."""
    pa.default_memory_pool().release_unused()
    return result


def _answer(table: pa.Table) -> pa.Table:
    """Kind 0: which keys lie in a block before. Kind 1: which anchors have several segments anywhere."""
    asked = sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "block", "part", "keys", "extra"))), key=lambda r: r[:3])
    if asked[0][0] == 0:
        family = LevelFamily()
        flags = [family.add(np.frombuffer(r[3], "<u8")) for r in asked]
    else:
        keys = [np.frombuffer(r[3], "<u8") for r in asked]
        prints = np.concatenate([np.frombuffer(r[4], "<u4") for r in asked])
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        low, high = np.full(len(every), 1 << 32, np.int64), np.full(len(every), -1, np.int64)
        np.minimum.at(low, at, prints)
        np.maximum.at(high, at, prints)
        several = (low != high) | (low == 0)
        flags = np.split(several[at], np.cumsum([len(k) for k in keys])[:-1])
    return _tidy(_reply([(r[2], r[1], r[0]) for r in asked], flags))


def _flags(table: pa.Table, kind: int) -> np.ndarray:
    """A block's answers of one kind, in the order of its keys."""
    rows = [r for r in zip(*(table.column(c).to_pylist() for c in ("part", "kind", "n", "flags"))) if r[1] == kind]
    return np.concatenate([np.zeros(0, bool), *[np.unpackbits(np.frombuffer(f, np.uint8), count=n).astype(bool) for _, _, n, f in sorted(rows)]])


class _Judged:
    """A block's segments with the first round's answers: which are repeats, and which must send their windows."""

    def __init__(self, seg: Segments, answers: pa.Table | None):
        self.keys, first, at = _first_of(seg.print)
        # least hashes are all small: spread over the whole range of keys before they are dealt to hash ranges
        self.anchors, _, which = _first_of(mix(seg.anchor))
        if answers is None:
            lead = first
            anchor_of = which[lead]
            n = np.bincount(anchor_of, minlength=len(self.anchors))
            own = np.zeros(len(self.anchors), np.uint32)
            own[anchor_of] = (seg.print[lead] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
            self.own = np.where(n > 1, 0, own).astype(np.uint32)
            return
        before, several = _flags(answers, 0), _flags(answers, 1)
        leads = np.zeros(len(seg.print), bool)
        leads[first] = True
        leads &= ~before[at]
        self.repeats = ~leads
        self.ask = np.flatnonzero(leads & (several[which] | seg.folds))


def _layout(docs: DataFrame, block_bytes: int, n_blocks: int) -> list[tuple[int, bool]]:
    """First doc_id of each block, in order, and whether the block is one id with several rows that must be split.

    The bytes of each id, in order of the ids, are summed up until a block is full; a null id is in no block here. One
    number per block of text reaches the driver.
    """
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    ranges = max(1, min(shuffle_parts(docs), n_blocks // BLOCKS_PER_RANGE))
    ids = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.sum(size).alias("b"), F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            starts = []
            for i, size, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "b", "n"))):
                split = n > 1 and size > block_bytes
                if held is None or split or held + size > block_bytes:
                    starts.append((i, split))
                    held = 0
                held = None if split else held + size
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in starts], pa.int64()), pa.array([x for _, x in starts], pa.bool_())], ["first", "split"])

    starts = ids.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, "first long, split boolean")
    return sorted((r["first"], r["split"]) for r in starts.collect())


def _numbers(x: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, x))), ",").cast("array<long>")


def _rank(value: Column, borders: list[int]) -> Column:
    """How many of the sorted borders are at most the value; looks at two times the root of their number."""
    if not borders:
        return F.lit(0)
    k = math.isqrt(len(borders)) + 1
    below = lambda x: F.size(F.filter(x, lambda b: b <= value))
    skipped = F.greatest(below(_numbers(borders[::k])) - 1, F.lit(0)) * k
    return skipped + below(F.slice(_numbers(borders), skipped + 1, k))


def _in_blocks(docs: DataFrame, block_bytes: int, n_blocks: int) -> DataFrame:
    """doc_id, text (binary), block: blocks of about ``block_bytes``, whose numbers rise with (doc_id, text), null first.

    Rows of one id that are more than a block are sorted by text and cut by running bytes. A row is never cut.
    """
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    layout = _layout(docs, block_bytes, n_blocks)
    void = docs.filter("doc_id is null").agg(F.sum(size).alias("b"), F.count("*").alias("n")).first()
    split = [k for k, x in enumerate([void["n"] > 1 and void["b"] > block_bytes, *(x for _, x in layout)]) if x]
    # 0 for null, from 1 on the block
    spot = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(_rank(F.col("doc_id"), [i for i, _ in layout])).cast("long")
    table = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), spot.alias("s"))
    whole = ("doc_id", "text", F.shiftleft("s", 40).alias("block"))
    if not split:
        return table.select(*whole)
    apart = F.array_contains(_numbers(split), F.col("s"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 20
        last, held, block = None, 0, 0
        for batch in batches:
            blocks = []
            for s, n in zip(batch.column("s").to_pylist(), pa.compute.binary_length(batch.column("text")).to_pylist()):
                if s != last or (held and held + n > block_bytes):
                    last, held, block = s, 0, block + 1
                held += n
                blocks.append((s << 40) + base + block)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(blocks, pa.int64())], ["doc_id", "text", "block"])

    # the start of a text, as Spark brings samples of the keys to the driver
    several = table.filter(apart).repartitionByRange(shuffle_parts(docs), "s", F.substring("text", 1, 64)).sortWithinPartitions("s", "text")
    return table.filter(~apart).select(*whole).unionByName(cut_lineage(several.mapInArrow(number, "doc_id long, text binary, block long")))


def repeated_bytes(docs: DataFrame, width: int = WIDTH, seed: int = SEED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256: one row per row of ``docs``.

    Null and empty texts, and texts shorter than ``width``, lose nothing. Rows of one doc_id are ordered by their
    text, a null doc_id comes before all others. Matches never cross documents; further columns are not read.
    """
    n_blocks = text_blocks(docs, block_bytes=block_bytes)
    parts = hash_ranges(docs, n_blocks * block_bytes)
    dealt = _in_blocks(docs.select("doc_id", "text"), block_bytes, n_blocks).repartition(parts, "block")

    def load(table: pa.Table) -> tuple[pa.Table, Segments]:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if table.num_rows > 1 else table
        if table.num_rows > 1 and table.column("doc_id").null_count:
            table = pa.concat_tables([table.filter(table.column("doc_id").is_null()), table.filter(table.column("doc_id").is_valid())])
        return table, Segments(table.column("text").to_pylist(), width, seed)

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        _, seg = load(table)
        judged, b = _Judged(seg, None), key[0].as_py()
        sent = [*_send(b, 0, judged.keys, None, parts), *_send(b, 1, judged.anchors, judged.own, parts)]
        return _tidy(pa.Table.from_batches(sent))

    def ask_windows(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        _, seg = load(left)
        _, prints = seg.windows(_Judged(seg, right).ask)
        return _tidy(pa.Table.from_batches(list(_send(key[0].as_py(), 0, np.unique(prints), None, parts))))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        table, seg = load(left)
        rounds = right.column("round")
        first, second = (right.filter(pa.compute.equal(rounds, r)) for r in (1, 2))
        judged = _Judged(seg, first)
        starts, prints = seg.windows(judged.ask)
        keys, lead, at = _first_of(prints)
        gone = np.ones(len(prints), bool)
        gone[lead] = False
        if len(prints):
            gone |= _flags(second, 0)[at]
        edge = np.zeros(seg.total + 1, np.int32)
        np.add.at(edge, seg.start[judged.repeats], 1)
        np.add.at(edge, seg.end[judged.repeats] + width, -1)
        np.add.at(edge, starts[gone], 1)
        np.add.at(edge, starts[gone] + width, -1)
        covered = np.cumsum(edge, out=edge) > 0
        removed, spans, kept = [], [], []
        offset = 0
        for t in seg.texts:
            mark = covered[offset : offset + len(t)]
            n = int(mark.sum())
            removed.append(n)
            spans.append(int(np.count_nonzero(np.diff(mark.astype(np.int8), prepend=0) == 1)) if n else 0)
            kept.append(np.frombuffer(t, np.uint8)[~mark].tobytes() if n else t)
            offset += len(t) + 1
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "n_bytes": pa.array([len(t) for t in seg.texts], pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(spans, pa.int64()),
                "kept": pa.array(kept, pa.binary()),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            }
        )

    def judge(asked: DataFrame) -> DataFrame:
        return asked.groupBy("part", "kind").applyInArrow(_answer, _ANSWERED)

    first = judge(dealt.groupBy("block").applyInArrow(ask, _ASKED))
    second = judge(dealt.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(ask_windows, _ASKED))
    answers = reduce(DataFrame.unionByName, (df.withColumn("round", F.lit(r)) for r, df in ((1, first), (2, second))))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)


def digest(cut: DataFrame) -> DataFrame:
    """The contract's columns."""
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute_force(docs: list[tuple[int, str | None]], width: int = WIDTH) -> dict:
    """Plain reference for tests, for documents with distinct ids."""
    seen: set[bytes] = set()
    out = {}
    for doc_id, text in sorted(docs):
        data = (text or "").encode()
        mark = bytearray(len(data))
        for i in range(len(data) - width + 1):
            w = data[i : i + width]
            if w in seen:
                mark[i : i + width] = b"\1" * width
            seen.add(w)
        kept = bytes(b for b, m in zip(data, mark) if not m)
        spans = sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1]))
        out[doc_id] = (len(data), sum(mark), spans, hashlib.sha256(kept).hexdigest())
    return out
