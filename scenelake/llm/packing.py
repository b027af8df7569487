"""Best-fit packing of token sequences by minimum bin slack.

Per bin, a bitset subset-sum over the lengths at hand finds the fullest feasible combination;
it is taken out, as often as the lengths allow, and the search goes on with what is left.
"""

from __future__ import annotations

import base64
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import shuffle_parts
from scenelake.session import cut_lineage

MAX_TOKENS = 2048
#: Pieces that one packing group holds on average; only the last bins of a group can be slack.
GROUP_PIECES = 20_000
#: Distinct chunks that a task remembers with their ids.
REMEMBERED = 600_000

#: A blank with white space on both sides: there a text can't be cut at the blank.
_UNSURE = re.compile(r"\s \s")


class ByteTokenizer(dict):
    """Ids of a text under a byte-level vocabulary file, packed as little-endian unsigned 32-bit numbers.

    The vocabulary's own pattern always cuts before a blank between a non-blank and a word, so a text is split at
    blanks first and equal chunks are encoded once (this dict: chunk after a blank to ids). Texts with a blank
    amid other white space are encoded whole. A special token's literal is that token's id, and what stands before and
    after it is encoded by itself.
    """

    def __init__(self, vocabulary: str, pattern: str, special: dict[str, int] | None = None):
        import tiktoken

        super().__init__()
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._special = {literal: array("I", [i]) for literal, i in (special or {}).items()}
        if sys.byteorder == "big":
            for ids in self._special.values():
                ids.byteswap()
        longest = sorted(self._special, key=len, reverse=True)
        self._literal = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self._encode = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _ordinary(self, text: str) -> bytes:
        ids = array("I", self._encode(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = self[chunk] = self._ordinary(" " + chunk)
        return ids

    def _around_literals(self, text: str, encode: Callable[[str], bytes]) -> bytes:
        if self._literal is None or not self._literal.search(text):
            return encode(text)
        parts = self._literal.split(text)
        return b"".join(self._special[p].tobytes() if k % 2 else encode(p) for k, p in enumerate(parts))

    def whole(self, text: str) -> bytes:
        """The same ids as ``encode``, without cuts at blanks."""
        return self._around_literals(text, self._ordinary)

    def encode(self, text: str) -> bytes:
        return self._around_literals(text, self._plain)

    def _plain(self, text: str) -> bytes:
        if _UNSURE.search(text):
            return self._ordinary(text)
        if len(self) > REMEMBERED:
            self.clear()
        first, *rest = text.split(" ")
        return self._ordinary(first) + b"".join([self[chunk] for chunk in rest])


def token_pieces(docs: DataFrame, tokenizer: tuple[str, str, dict[str, int]], max_tokens: int = MAX_TOKENS, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids, then ``end_id``, in pieces of ``max_tokens``.

    The first piece takes the odd rest, so that all further ones are full. A null text is empty: one piece
    with the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = ByteTokenizer(*tokenizer), np.array([end_id], "<u4").tobytes()
        width = 4 * max_tokens
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encoder.encode(text or "") + end
                edge = len(ids) % width or width
                cuts = [0, *range(edge, len(ids) + 1, width)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for to, value in zip(rows, (doc_id, k, a // 4, (b - a) // 4, zlib.crc32(ids[a:b]))):
                        to.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: list[int], limit: int) -> list[int]:
    """The combination of lengths with the greatest sum up to ``limit``; long lengths first.

    ``counts[n]``: pieces of length n at hand. The longest length at hand is always part of the result, as it is
    the hardest to place. Sums are the bits of one integer; the states before each length give the way back.
    """
    lengths = [n for n in range(min(limit, len(counts) - 1), 0, -1) if counts[n]]
    if not lengths:
        return []
    first, mask = lengths[0], (1 << (limit + 1)) - 1
    reach, steps, goal = 1 << first, [], 1 << limit
    for n in lengths:
        left = min(counts[n] - (n == first), (limit - first) // n)
        take = 1
        while left > 0 and not reach & goal:  # binary parts of the multiplicity
            part = min(take, left)
            steps.append((n, part, reach))
            reach = (reach | reach << (n * part)) & mask
            left, take = left - part, take * 2
        if reach & goal:
            break
    total = reach.bit_length() - 1
    chosen = [first]
    for n, part, before in reversed(steps):
        if not before >> total & 1:
            chosen += [n] * part
            total -= n * part
    return chosen


def pack_lengths(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of each length; bins are numbered from 0 and have no gaps."""
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=limit + 1).tolist()
    start = np.concatenate([[0], np.cumsum(counts)[:-1]])
    used = [0] * (limit + 1)
    bins, places, n_bins = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    while chosen := fullest(counts, limit):
        need = {n: chosen.count(n) for n in chosen}
        for _ in range(min(counts[n] // k for n, k in need.items())):
            at = 0
            for n in chosen:
                i = order[start[n] + used[n]]
                bins[i], places[i] = n_bins, at
                used[n] += 1
                counts[n] -= 1
                at += n
            n_bins += 1
    return bins, places


def pack(pieces: DataFrame, limit: int = MAX_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with sequence_id and offset: every piece in one sequence of at most ``limit`` tokens.

    Pieces are dealt by hash into groups of about ``group_pieces``; each is packed by itself, so a group costs
    one slack bin or so and no task sees more. Repeated rows stay rows of their own; an empty table gives no rows.
    """
    n_groups = max(1, -(-pieces.count() // group_pieces))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        bins, places = pack_lengths(lengths, limit)
        out = table.drop_columns(["_group"])
        sequence = bins + (key[0].as_py() << 32)
        return out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(places))

    group = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_groups)).alias("_group")
    dealt = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", group)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("_group").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: tuple[str, str, dict[str, int]], max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Tokenise whole texts (null: empty) and pack the pieces; one row per piece. See ``token_pieces`` and ``pack``.

    Only doc_id and text are read, so further columns never clash; a null doc_id stays null.
    """
    spread = docs.select("doc_id", "text")
    if docs.sparkSession.sparkContext.defaultParallelism > 1 and spread.rdd.getNumPartitions() == 1:
        spread = spread.repartition(shuffle_parts(docs))
    return pack(cut_lineage(token_pieces(spread, tokenizer, max_tokens)), max_tokens)
