"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of all test items.

Texts are normalised byte by byte (A-Z lower-cased, everything but digits, letters and bytes from 0x80 on is a
gap), so each normalised word keeps its place in the original; every text is scanned once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.session import cut_lineage

WINDOW = 10
#: Words of test items that one automaton holds at most; further items get automata of their own.
BLOCK_WORDS = 400_000

_GAPS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORD = re.compile(rb"[^ ]+")


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_GAPS).split()


def _windows(words: list[bytes], width: int) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def _as_keys(window: bytes) -> str:
    return f" {window.decode('latin-1')} "


class ItemAutomaton:
    """All windows of a block of items; ``scan`` gives hit words and items of one text."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        holders: dict[str, set[str]] = {}
        lengths: dict[str, int] = {}
        for item_id, text in items:
            for window in _windows(_words(text), width):
                key = _as_keys(window)
                holders.setdefault(key, set()).add(item_id)
                lengths[key] = window.count(b" ") + 1
        self.machine = ahocorasick.Automaton()
        for key, ids in holders.items():
            self.machine.add_word(key, (lengths[key], len(key), tuple(sorted(ids))))
        if holders:
            self.machine.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words; hit runs of words as byte ranges of the text; ids of the items that occur."""
        if not text:
            return 0, [], set()
        plain = text.encode().translate(_GAPS)
        words = plain.split()
        if not words or not len(self.machine):
            return len(words), [], set()
        line = f" {b' '.join(words).decode('latin-1')} "
        found, ids = [], set()
        for end, (n, size, holders) in self.machine.iter(line):
            found.append((end + 1 - size, n))
            ids.update(holders)
        if not found:
            return len(words), [], ids
        runs: list[list[int]] = []
        at = word = 0
        for start, n in sorted(found):
            word += line.count(" ", at, start)
            at = start
            if runs and word <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], word + n)
            else:
                runs.append([word, word + n])
        return len(words), [(a, b) for a, b in runs], ids

    @staticmethod
    def offsets(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Runs of words as code point ranges of the original text."""
        data = text.encode()
        places = [m.span() for m in _WORD.finditer(data.translate(_GAPS))]
        return [(len(data[: places[a][0]].decode()), len(data[: places[b - 1][1]].decode())) for a, b in runs]


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, str | None]]]:
    """Items in blocks of at most ``block_words`` words (a longer item is a block of its own), at least one block."""
    block: list[tuple[str, str | None]] = []
    held = 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        n = len(_words(row[1]))
        if block and held + n > block_words:
            yield block
            block, held = [], 0
        block.append((row[0] or "", row[1]))
        held += n
    yield block


_FOUND = "doc_id long, text string, n_words long, runs array<struct<a: long, b: long>>, items array<string>"


def _pass(df: DataFrame, items: list[tuple[str, str | None]], width: int) -> DataFrame:
    """One scan of all texts with one automaton; adds to the runs and items found so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ItemAutomaton(items, width)
        pair = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for batch in batches:
            counts, runs, ids = [], [], []
            earlier = zip(batch.column("runs").to_pylist(), batch.column("items").to_pylist())
            for text, (old_runs, old_ids) in zip(batch.column("text").to_pylist(), earlier):
                n, now, holders = machine.scan(text)
                now = _united(now + [(r["a"], r["b"]) for r in old_runs]) if old_runs else now
                counts.append(n)
                runs.append([{"a": a, "b": b} for a, b in now])
                ids.append(sorted(holders.union(old_ids)))
            columns = [batch.column("doc_id"), batch.column("text"), pa.array(counts, pa.int64()), pa.array(runs, pair), pa.array(ids, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_words", "runs", "items"])

    return df.mapInArrow(run, _FOUND)


def _offsets(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            hits, spans = [], []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                found = [(r["a"], r["b"]) for r in runs]
                hits.append(sum(b - a for a, b in found))
                spans.append([{"start": a, "end": b} for a, b in ItemAutomaton.offsets(text, found)] if found else [])
            columns = [batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array(spans, span), batch.column("items")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "spans", "items"])

    return df.mapInArrow(run, "doc_id long, n_words long, n_hit long, spans array<struct<start: long, end: long>>, items array<string>")


def find_items(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, spans (code point ranges in the text), items (ids as sorted strings).

    Null, empty and wordless texts have no words and no hits; an empty benchmark hits nothing; repeated rows of
    documents give repeated rows; a null item id counts as the empty string. A benchmark of more than
    ``block_words`` words is worked through block by block, one scan each, so an automaton never outgrows a task.
    """
    nothing = (F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<a: long, b: long>>)").alias("runs"))
    found = docs.select("doc_id", "text", *nothing, F.expr("cast(array() as array<string>)").alias("items"))
    for k, items in enumerate(item_blocks(benchmark, block_words)):
        found = _pass(cut_lineage(found) if k else found, items, width)
    return _offsets(found)


def _united(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents in which no window of any item occurs, all columns as they are; null texts stay.

    Each block of items is a filter over the rows themselves, so nothing is joined back.
    """
    for items in item_blocks(benchmark, block_words):
        docs = _filter(docs, items, width)
    return docs


def _filter(docs: DataFrame, items: list[tuple[str, str | None]], width: int) -> DataFrame:
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ItemAutomaton(items, width)
        for batch in batches:
            yield batch.filter(pa.array([not machine.scan(t)[2] for t in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``find_items``."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "spans",
    )


def brute_force(docs: list[tuple], items: list[tuple], width: int = WINDOW) -> dict:
    """Plain reference for tests: doc_id to (n_words, n_hit, n_items, sha256)."""
    out = {}
    for doc_id, text in docs:
        words, hit, ids = _words(text), set(), set()
        for item_id, item in items:
            for window in _windows(_words(item), width):
                parts = window.split()
                for i in range(len(words) - len(parts) + 1):
                    if words[i : i + len(parts)] == parts:
                        hit.update(range(i, i + len(parts)))
                        ids.add(str(item_id))
        out[doc_id] = (len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest())
    return out
