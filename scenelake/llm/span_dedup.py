"""Substring dedup by sliding sentence spans.

A run is the fewest consecutive sentences from a given one on that reach both a number of sentences and a number of
words. Every run of every text is hashed and the hashes are compared globally; sentences that a non-first occurrence of
a repeated run covers are taken out.

Long sentences are cut by their content, where a word's hash is the least of some ``REACH`` words in a row. What is cut
depends on the words nearby alone, so a passage is cut alike wherever it stands, but for its first and last
``REACH`` - 1 words. Hence every passage of 46 words holds a whole run, whatever its sentences and its neighbours: 14
words at most to the first sure cut, 24 for three pieces or fifteen words, 8 behind them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import BUFFER_BYTES, SPACE, RollingHash, joined, mix, shuffle_parts, sliding_min, text_blocks, word_hashes

SENTENCES = 3
WORDS = 15
#: Any so many words in a row hold an end of a sentence or a cut.
REACH = 8
BLOCK_BYTES = 4 << 20
#: Bytes of text whose runs a hash range gets at most, about.
RANGE_BYTES = 32 << 20

_ENDS = np.zeros(256, bool)
_ENDS[[0x2E, 0x21, 0x3F]] = True


class Sentences:
    """Sentences of some texts: a word opens one if the word before ends in . ! or ?, or a line ends between them.

    White space belongs to the sentence before it, so the pieces of a text join to the whole. A sentence of more than
    ``REACH`` words is also cut behind each word that has the least hash of some ``REACH`` words in a row, ties included.
    """

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        data, self.starts = joined(texts)
        edge = np.flatnonzero(np.diff(SPACE[data].astype(np.int8), prepend=1))
        self.begin, end = edge[0::2], edge[1::2]
        n = len(self.begin)
        self.hashes = RollingHash(data, lower=True).ranges(self.begin, end)
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        new = np.ones(n, bool)
        new[1:] = _ENDS[data[end[:-1] - 1]] | (lines[self.begin[1:]] > lines[end[:-1]])
        if n >= REACH:
            # an end counts as least, so that stretches with an end, and those over two texts, have no other cut
            key = np.where(np.append(new[1:], True), np.uint64(0), np.maximum(self.hashes, np.uint64(1)))
            edges = np.zeros(REACH - 1, np.uint64)
            most = ~sliding_min(~np.concatenate([edges, sliding_min(key, REACH), edges]), REACH)
            new[1:] |= (most == key)[:-1]
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.append(self.first, n))
        #: First sentence of each text, one more at the end.
        self.of_text = np.searchsorted(self.begin[self.first], self.starts)

    def runs(self, least: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, first sentence, sentence after the last (both counted in the text) and hash of each run."""
        n = len(self.first)
        text = np.repeat(np.arange(len(self.texts)), np.diff(self.of_text))
        edges = np.append(self.first, len(self.hashes))
        stop = np.maximum(np.searchsorted(edges, self.first + words), np.arange(n) + least)
        ok = np.flatnonzero(stop <= self.of_text[text + 1]) if n else np.zeros(0, np.int64)
        place = (np.arange(len(self.hashes)) - np.repeat(self.first, self.size)).astype(np.uint64)
        code = np.add.reduceat(mix(self.hashes + mix(place + np.uint64(1))), self.first) if n else np.zeros(0, np.uint64)
        stop = stop[ok]
        out = np.zeros(len(ok), np.uint64)
        for step in range(int((stop - ok).max(initial=0))):
            live = ok + step < stop
            out[live] = mix(out[live] + code[ok[live] + step] + np.uint64(step))
        base = self.of_text[text[ok]]
        return text[ok], ok - base, stop - base, out

    def pieces(self, i: int) -> list[bytes]:
        """The sentences of one text; a text without words is one piece, an empty one none."""
        t = self.texts[i]
        cuts = (self.begin[self.first[self.of_text[i] : self.of_text[i + 1]]] - self.starts[i]).tolist()[1:]
        return [t[a:b] for a, b in zip([0, *cuts], [*cuts, len(t)])] if t else []


_ASKED = "part int, block long, keys binary, docs binary, places binary"
_ANSWERED = "part int, block long, n int, flags binary"
_LEFT = "doc_id long, n_sentences long, n_removed long, n_spans long, text string"


class _Runs:
    """All runs of a block's texts, and of each distinct hash the first run by doc_id and sentence."""

    def __init__(self, table: pa.Table, least: int, words: int):
        self.ids = table.column("doc_id").fill_null(-(1 << 63)).to_numpy()
        self.texts = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
        self.splits: list[tuple[int, Sentences]] = []
        found = []
        first = size = 0
        for k, t in enumerate(self.texts):
            size += len(t) + 1
            if size >= BUFFER_BYTES or k == len(self.texts) - 1:
                split = Sentences(self.texts[first : k + 1])
                text, i, j, h = split.runs(least, words)
                found.append((text + first, i, j, h))
                self.splits.append((first, split))
                first, size = k + 1, 0
        self.text, self.i, self.j, h = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((self.i, self.ids[self.text], h))
        ranked = h[order]
        new = np.ones(len(h), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        lead = order[new]
        self.keys, self.docs, self.places = h[lead], self.ids[self.text[lead]], self.i[lead]
        self.key_of = np.empty(len(h), np.int64)
        self.key_of[order] = np.cumsum(new) - 1

    def gone(self, stays: np.ndarray) -> np.ndarray:
        """Which runs are not the first of all; stays: by key, whether this block has the first."""
        k = self.key_of
        return ~(stays[k] & (self.docs[k] == self.ids[self.text]) & (self.places[k] == self.i))


def _first_of_all(table: pa.Table) -> pa.Table:
    """Of each block's keys in a hash range: is its first run that of the least doc_id and sentence anywhere?"""
    column = lambda name, kind: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    each = column("keys", "<u8")
    keys, docs, places = np.concatenate(each), np.concatenate(column("docs", "<i8")), np.concatenate(column("places", "<i4"))
    order = np.lexsort((places, docs, keys))
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    stays = np.empty(len(keys), bool)
    stays[order] = (docs[order] == docs[lead]) & (places[order] == places[lead])
    flags = np.split(stays, np.cumsum([len(x) for x in each])[:-1])
    columns = [table.column("part"), table.column("block"), pa.array([len(x) for x in each], pa.int32()), pa.array([np.packbits(f).tobytes() for f in flags], pa.binary())]
    return pa.table(columns, names=["part", "block", "n", "flags"])


def dedup(docs: DataFrame, least: int = SENTENCES, words: int = WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_sentences, n_removed, n_spans, text (what is left): one row per row of ``docs``.

    The first occurrence is that of the smallest doc_id, then of the earliest sentence, and stays. Null and empty texts
    have no sentences and give an empty text. Rows that repeat a doc_id are treated alike: all keep the first
    occurrence. A null doc_id comes first in the order. Further columns are not read.

    Texts are dealt to blocks by hash. A block sends each distinct hash of a run once, with its first place, packed by
    hash range, and gets one bit back.
    """
    blocks = text_blocks(docs, block_bytes=block_bytes)
    parts = max(shuffle_parts(docs), -(-blocks * block_bytes // RANGE_BYTES))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block")
    dealt = docs.select("doc_id", "text", block).repartition(shuffle_parts(docs), "block")
    step = (1 << 64) // parts
    bounds = np.array([step * p for p in range(1, parts)], np.uint64)

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        runs = _Runs(table, least, words)
        cuts = [0, *np.searchsorted(runs.keys, bounds).tolist(), len(runs.keys)]
        rows = [(p, a, b) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        packed = [pa.array([x[a:b].astype(kind).tobytes() for _, a, b in rows], pa.binary()) for x, kind in ((runs.keys, "<u8"), (runs.docs, "<i8"), (runs.places, "<i4"))]
        columns = [pa.array([p for p, _, _ in rows], pa.int32()), pa.array([key[0].as_py()] * len(rows), pa.int64()), *packed]
        return pa.table(columns, names=["part", "block", "keys", "docs", "places"])

    def take_out(left: pa.Table, right: pa.Table) -> pa.Table:
        runs = _Runs(left, least, words)
        answers = sorted(zip(*(right.column(c).to_pylist() for c in ("part", "n", "flags"))))
        stays = np.concatenate([np.zeros(0, bool), *[np.unpackbits(np.frombuffer(f, np.uint8), count=n).astype(bool) for _, n, f in answers]])
        gone = np.flatnonzero(runs.gone(stays))
        text, i, j = runs.text[gone], runs.i[gone], runs.j[gone]
        of_text = np.searchsorted(text, np.arange(len(runs.texts) + 1)).tolist()
        rows: list[list] = [[], [], [], []]
        for first, split in runs.splits:
            for k, t in enumerate(split.texts):
                a, b = of_text[first + k], of_text[first + k + 1]
                n = int(split.of_text[k + 1] - split.of_text[k]) or int(len(t) > 0)
                edge = np.bincount(i[a:b], minlength=n + 1) - np.bincount(j[a:b], minlength=n + 1)
                out = np.cumsum(edge)[:-1] > 0
                kept = b"".join(p for p, o in zip(split.pieces(k), out) if not o) if b > a else t
                values = (n, int(out.sum()), int(np.count_nonzero(np.diff(out.astype(np.int8), prepend=0) == 1)), kept.decode())
                for to, value in zip(rows, values):
                    to.append(value)
        columns = [left.column("doc_id"), *[pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]]
        return pa.table(columns, names=["doc_id", "n_sentences", "n_removed", "n_spans", "text"])

    answers = dealt.groupBy("block").applyInArrow(ask, _ASKED).groupBy("part").applyInArrow(_first_of_all, _ANSWERED)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(take_out, _LEFT)


def plain_sentences(text: str | None) -> list[bytes]:
    """The same cutting word by word, for tests."""
    data = (text or "").encode()
    words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    if not words:
        return [data] if data else []
    hashes = word_hashes([b" ".join(data[a:b] for a, b in words)])[0].tolist()
    ends = {k for k in range(len(words)) if k + 1 == len(words) or data[words[k][1] - 1 : words[k][1]] in b".!?" or b"\n" in data[words[k][1] : words[k + 1][0]]}
    picked = set(ends)
    for k in range(len(words) - REACH + 1):
        near = range(k, k + REACH)
        if not ends & set(near):
            picked |= {x for x in near if hashes[x] == min(hashes[y] for y in near)}
    cuts = [words[k + 1][0] for k in sorted(picked) if k + 1 < len(words)]
    return [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]


def brute_force(docs: list[tuple[int, str | None]], least: int = SENTENCES, words: int = WORDS) -> dict:
    """Plain reference for tests, for documents with distinct ids: doc_id to (n_sentences, n_removed, text left)."""
    seen: set[tuple] = set()
    out = {}
    for doc_id, text in sorted(docs):
        pieces = plain_sentences(text)
        plain = [tuple(p.lower().split()) for p in pieces]
        full = [i for i, p in enumerate(plain) if p]
        gone = [False] * len(pieces)
        for a in range(len(full)):
            n = b = 0
            while a + b < len(full) and (b < least or n < words):
                n += len(plain[full[a + b]])
                b += 1
            if b < least or n < words:
                continue
            run = tuple(plain[x] for x in full[a : a + b])
            if run in seen:
                for x in range(full[a], full[a + b - 1] + 1):
                    gone[x] = True
            seen.add(run)
        left = b"".join(p for p, g in zip(pieces, gone) if not g)
        out[doc_id] = (len(pieces), sum(gone), left.decode())
    return out
