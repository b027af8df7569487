"""Shared pieces of the text operators: word hashes on whole byte buffers, Spark-side helpers.

Words here are the maximal runs of bytes other than ASCII white space, with A-Z lower-cased.
All hashes are 64 bits wide and the same in every process.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.session import cut_lineage

#: Bytes of text that a buffer of the numpy code holds before it is worked on.
BUFFER_BYTES = 1 << 20

#: Bytes of text whose keys one hash range gets, about.
RANGE_BYTES = 32 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_S31, _S29 = np.uint64(31), np.uint64(29)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[65:91] = _BYTE[97:123]
#: ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> _S31)) * _ODD
    return (x ^ (x >> _S29)) * _ODD


def _power_of(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, BUFFER_BYTES + (1 << 16))
        steps = np.full(size, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have


class RollingHash:
    """Hash of any byte range of a buffer in constant time."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        table = _LOWER_BYTE if lower else _BYTE
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * _power_of("up", _BASE, len(data))[: len(data)], out=self.sums[1:])
        self.down = _power_of("down", _INVERSE, len(data) + 1)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        n = len(self.sums) - 1
        if n < width:
            return np.zeros(0, np.uint64)
        return mix((self.sums[width:] - self.sums[: n - width + 1]) * self.down[: n - width + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` values in a row; at least so many must be there."""
    span, least = 1, x
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def joined(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts, a line feed after each, and where each text starts (one more at the end)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), starts


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the first word of each text (one more at the end)."""
    data, starts = joined(texts)
    gap = SPACE[data]
    edge = np.flatnonzero(np.diff(gap.astype(np.int8), prepend=1))
    begin, end = edge[0::2], edge[1::2]
    words = RollingHash(data, lower=True).ranges(begin, end)
    return words, np.searchsorted(begin, starts)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    x = words[:n].copy()
    for i in range(1, k):
        x = mix(x) + words[i : n + i]
    return mix(x)


def batches_of_text(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BUFFER_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Record batches cut so that their texts (null: empty) stay near ``limit`` bytes, with the texts as bytes."""
    for batch in batches:
        texts = [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
        first = size = 0
        for i, t in enumerate(texts):
            size += len(t) + 1
            if size >= limit or i == len(texts) - 1:
                yield batch.slice(first, i + 1 - first), texts[first : i + 1]
                first, size = i + 1, 0


def cut(df: DataFrame) -> DataFrame:
    """``cut_lineage``, and let the driver's cleaner drop the shuffle files that only the work before it needed.

    The cleaner acts on what the driver has collected as garbage, which a long job of small plans seldom does by itself.
    """
    done = cut_lineage(df)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return done


def shuffle_parts(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hash_ranges(df: DataFrame, n_bytes: int) -> int:
    """Ranges that the keys of so many bytes of text are dealt to: bounded ones, and no fewer than shuffle partitions."""
    return max(shuffle_parts(df), -(-n_bytes // RANGE_BYTES))


def text_blocks(docs: DataFrame, column: str = "text", block_bytes: int = 8 << 20) -> int:
    """How many blocks of about ``block_bytes`` the texts make; one scan, one number to the driver."""
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(1, -(-total // block_bytes))


def held_out(modulus: int, remainder: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, by a modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
