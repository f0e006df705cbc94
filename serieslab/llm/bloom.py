"""Bloom filters that tasks build over their own rows and Spark merges chunk by chunk."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from serieslab.llm.common import splitmix

#: Bytes of a filter that are merged as one row.
CHUNK = 1 << 16
HASHES = 4


def bits_for(n: int, max_bits: int, per_key: int = 8) -> int:
    """A power of two with about ``per_key`` bits for each of n keys, between 2**20 and ``max_bits``.

    Beyond ``max_bits`` a filter only lets more keys through; users of a filter confirm exactly.
    """
    return max(1 << 20, min(max_bits, 1 << int(max(1, n) * per_key - 1).bit_length()))


def places(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bit numbers of each key, one row of HASHES numbers a key."""
    step = splitmix(keys ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (keys[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)


def contains(table: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter."""
    at = places(keys, bits)
    return ((table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def add(table: np.ndarray, bits: int, keys: np.ndarray) -> None:
    at = places(keys, bits).ravel()
    np.bitwise_or.at(table, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8), dtype=np.uint8))


class OnceTwice:
    """The pair of filters: keys seen at least once, and keys seen at least twice (or suspected of it)."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def see(self, keys: np.ndarray) -> None:
        own, count = np.unique(keys, return_counts=True)
        add(self.twice, self.bits, own[(count > 1) | contains(self.once, self.bits, own)])
        add(self.once, self.bits, own)

    def chunks(self) -> pa.RecordBatch:
        rows = [(i, self.once[i * CHUNK : (i + 1) * CHUNK], self.twice[i * CHUNK : (i + 1) * CHUNK]) for i in range(max(1, self.bits // 8 // CHUNK))]
        rows = [(i, a.tobytes(), b.tobytes()) for i, a, b in rows if a.any()]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], ["chunk", "once", "twice"])


def merge_chunks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one chunk: a bit is twice-seen if it was so in a part, or once-seen in two parts."""
    once = twice = at = None
    for part in parts:
        for i, a, b in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            at, once, twice = i, a if once is None else once | a, b if once is None else twice | b | (once & a)
    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([once.tobytes()], pa.binary()), pa.array([twice.tobytes()], pa.binary())], ["chunk", "once", "twice"])


def build(df: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray], bits: int, which: str = "twice") -> np.ndarray:
    """The ``once`` or ``twice`` filter over what ``keys`` gives for each batch of ``df``.

    Each task fills filters of its own; their 64 KB chunks are shuffled by chunk number and merged, so
    the driver receives one filter of ``bits`` bits, whatever the number of tasks.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OnceTwice(bits)
        for batch in batches:
            own.see(keys(batch))
        yield own.chunks()

    parts = df.mapInArrow(fill, "chunk int, once binary, twice binary")
    merged = parts.groupBy("chunk").applyInArrow(merge_chunks, parts.schema).select("chunk", which)
    table = np.zeros(bits // 8, np.uint8)
    for row in merged.collect():
        table[row[0] * CHUNK : row[0] * CHUNK + len(row[1])] = np.frombuffer(row[1], np.uint8)
    return table
