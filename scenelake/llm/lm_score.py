"""Language-model scoring with a weighted backoff automaton, trained on the corpus itself.

States are the n-grams seen in training; an arc leads from a context to the longest known context after the next
word, a failure arc to the next shorter context. Arc weights are Dirichlet-smoothed:

    P(w | h) = (c(h w) + mu * P(w | h')) / (c(h) + mu),  h' = h without its first word,

so a failure arc weighs mu / (c(h) + mu) and every state's arcs sum to one; the root is the additive unigram model.

The model grows with the corpus, so no task ever holds it. Texts are dealt into blocks of bounded size. Each block
lists its distinct n-grams once and asks for their training counts by hash range; what comes back is exactly the
part of the automaton that its texts can reach, and each text is then traversed once, left to right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import batches_of_text, hash_ranges, held_out, mix, text_blocks, word_hashes

ORDER = 2
#: Weight of the shorter context, per order above 1, in counts.
MU = (100.0,)
#: Added to each unigram count.
ADD = 0.1
BLOCK_BYTES = 8 << 20

END = np.uint64(0x2545F4914F6CDD1D)
START = np.uint64(0x9FB21C651E98DF25)


class Block:
    """Tokens of some texts (words, then one end each) and their distinct n-grams of each order."""

    def __init__(self, texts: list[bytes], train: np.ndarray, order: int):
        words, self.starts = _tokens(texts)
        self.train = np.repeat(train, np.diff(self.starts))
        self.order, self.keys, self.at, self.counts = order, [], [], []
        gram, known = words, words
        n = len(words)
        first = np.zeros(n, bool)
        first[self.starts[:-1]] = True
        context = np.full(n, START, np.uint64)
        for k in range(1, order + 1):
            if k > 1:  # the context of a token: its up to k - 1 predecessors in the text, or the start
                context = np.where(first, START, np.concatenate([[START], known[:-1]])) if n else context
                gram = mix(mix(context) + words + np.uint64(k))
            keys, at = np.unique(gram, return_inverse=True)
            self.keys.append(keys)
            self.at.append(at)
            self.counts.append(np.bincount(at[self.train], minlength=len(keys)).astype(np.int64))
            known = gram
        self.first = first

    def start_count(self) -> int:
        return int((self.first & self.train).sum())


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    hashes, starts = [], [0]
    held: list[bytes] = []
    size = 0

    def flush() -> None:
        words, first = word_hashes(held)
        ends = np.insert(words, first[1:], END)
        hashes.append(ends)
        starts.extend((first[1:] + np.arange(1, len(first)) + starts[-1]).tolist())

    for t in texts:
        held.append(t)
        size += len(t) + 1
        if size >= 1 << 20:
            flush()
            held, size = [], 0
    if held:
        flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.array(starts, np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """Counts in the least width that holds them, behind a letter for it."""
    kind = np.min_scalar_type(int(counts.max(initial=0)))
    return kind.char.encode() + counts.astype(kind).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, data[:1].decode(), offset=1).astype(np.int64)


def _parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each hash range begins in sorted keys; ranges are equal cuts of the 64-bit numbers."""
    step = (1 << 64) // parts
    return np.searchsorted(keys, np.array([step * p for p in range(1, parts)], np.uint64))


def _requests(block: int, data: Block, parts: int) -> Iterator[pa.RecordBatch]:
    rows: list[list] = [[], [], [], [], [], []]
    for k in range(data.order):
        for p, (keys, counts) in enumerate(zip(np.split(data.keys[k], cuts := _parts_of(data.keys[k], parts)), np.split(data.counts[k], cuts))):
            for to, value in zip(rows, (p, block, k + 1, keys.tobytes(), _packed(counts), data.start_count() if p == 0 else 0)):
                to.append(value)
    types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types)], ["part", "block", "n", "keys", "counts", "starts"])


def _answer(table: pa.Table) -> pa.Table:
    """Training counts over all blocks for every key that a block asked for, in the block's own key order."""
    keys = [np.frombuffer(b, np.uint64) for b in table.column("keys").to_pylist()]
    counts = [_unpacked(b) for b in table.column("counts").to_pylist()]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts), minlength=len(every)).astype(np.int64)
    answers = [_packed(a) for a in np.split(total[at], np.cumsum([len(k) for k in keys])[:-1])]
    n = len(answers)
    return pa.table(
        {
            "block": table.column("block"),
            "n": table.column("n"),
            "part": table.column("part"),
            "totals": pa.array(answers, pa.binary()),
            "tokens": pa.array([int(total.sum())] * n, pa.int64()),
            "types": pa.array([int((total > 0).sum())] * n, pa.int64()),
            "starts": pa.array([int(sum(table.column("starts").to_pylist()))] * n, pa.int64()),
        }
    )


def _traverse(data: Block, totals: list[np.ndarray], tokens: int, types: int, starts: int, mu: tuple[float, ...]) -> tuple:
    """Per text: known tokens, base score, model score.

    One pass per order over all positions at once: the state before a token is its context; where the context is
    unknown the failure arc has weight one.
    """
    unigram = totals[0][data.at[0]]
    p = (unigram + ADD) / (tokens + ADD * (types + 1))
    base = np.log10(p)
    before = unigram
    for k in range(2, data.order + 1):
        gram = totals[k - 1][data.at[k - 1]]
        context = np.where(data.first, starts, np.concatenate([[starts], before[:-1]])) if len(p) else before
        p = (gram + mu[k - 2] * p) / (context + mu[k - 2])
        before = gram
    edges = data.starts
    sums = [np.add.reduceat(x, edges[:-1]) if len(edges) > 1 else np.zeros(0) for x in ((unigram > 0).astype(np.int64), base, np.log10(p))]
    return tuple(sums)


def score(docs: DataFrame, train_filter, order: int = ORDER, mu: tuple[float, ...] = MU, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, train (took part in training), n_tokens, n_known, train_tokens, base_score, score: one row per row.

    ``train_filter``: a Column that tells which rows are learnt from. Null texts are empty: one end token. With no
    training row all counts are 0 and the root alone scores. Repeated rows count as often as they occur.
    """
    if len(mu) < order - 1:
        raise ValueError("one mu for each order above 1")
    n_blocks = text_blocks(docs, "text", block_bytes)
    parts = hash_ranges(docs, n_blocks * block_bytes)
    block = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n_blocks)).alias("block")
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), train_filter.alias("train"), block).repartition(n_blocks, "block")

    def load(table: pa.Table) -> Block:
        return Block(table.column("text").cast(pa.binary()).to_pylist(), table.column("train").to_numpy(zero_copy_only=False).astype(bool), order)

    def ask(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _requests(key[0].as_py(), load(pa.Table.from_batches(batches)), parts)

    def respond(table: pa.Table) -> pa.Table:
        return _answer(table)

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        data = load(left)
        totals: list[list] = [[None] * parts for _ in range(order)]
        tokens = types = starts = 0
        for n, p, got, t, v, s in zip(*(right.column(c).to_pylist() for c in ("n", "part", "totals", "tokens", "types", "starts"))):
            totals[n - 1][p] = _unpacked(got)
            if n == 1:
                tokens, types, starts = tokens + t, types + v, starts + s
        known, base, model = _traverse(data, [np.concatenate(x) for x in totals], tokens, types, starts, mu)
        n = left.num_rows
        return pa.table(
            {
                "doc_id": left.column("doc_id"),
                "train": left.column("train"),
                "n_tokens": pa.array(np.diff(data.starts), pa.int64()),
                "n_known": pa.array(known, pa.int64()),
                "train_tokens": pa.array([tokens] * n, pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(model, pa.float64()),
            }
        )

    asked = dealt.groupBy("block").applyInArrow(ask, "part int, block long, n int, keys binary, counts binary, starts long")
    answered = asked.groupBy("part", "n").applyInArrow(respond, "block long, n int, part int, totals binary, tokens long, types long, starts long")
    schema = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(walk, schema)


def score_corpus(docs: DataFrame, order: int = ORDER, mu: tuple[float, ...] = MU) -> DataFrame:
    """The contract's columns: rows whose crc32(doc_id) mod 10 is 0 are held out of the training."""
    out = held_out(10, 0)
    scored = score(docs, ~out, order, mu)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
