"""What the operators of this subpackage share: tables, scratch space, words and hashes over UTF-8 bytes."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quirefold.scratch import BROADCAST_BYTES, Scope, Scratch, bounded, shared_dir, small

__all__ = ["BROADCAST_BYTES", "Scope", "Scratch", "bounded", "shared_dir", "small"]

#: Bytes of text that a kernel handles at once; a longer text is handled alone and whole.
SLICE_BYTES = 1 << 19

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULT, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240917).integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: Other values, for a second hash that is independent of the first.
OTHER_VALUES = np.random.default_rng(7130).integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_memos: dict[str, Callable[[], None]] = {}
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(kind: str, forget: Callable[[], None] | None = None) -> None:
    """Within a Python worker: the memos of other kinds of kernels are dropped, and `forget` drops those of this kind later."""
    others = [_memos.pop(k) for k in list(_memos) if k != kind]
    for f in others:
        f()
    if others:
        tidy()
    if forget:
        _memos[kind] = forget


def tidy() -> None:
    """Give memory that was freed back to the system; a worker's heap would keep it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of runs of rows of at most `most` bytes, or of one longer row. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, count=n + 1, offset=8 * texts.offset)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def _table_of_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    for key, base in (("up", _MULT), ("down", _INVERSE)):
        if len(_powers[key]) < n:
            full = np.full(max(n, 1 << 16), np.uint64(base))
            full[0] = 1
            _powers[key] = np.cumprod(full, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Spans:
    """64-bit hashes of any byte ranges of one buffer, from running sums of a polynomial over random byte values."""

    def __init__(self, buf: np.ndarray, values: np.ndarray = _BYTE_VALUES):
        up, self.down = _table_of_powers(len(buf) + 1)
        self.sums = np.empty(len(buf) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(values[buf] * up[: len(buf)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def hash_without(self, start: np.ndarray, end: np.ndarray, gap: np.ndarray, gap_end: np.ndarray) -> np.ndarray:
        """What hash() gives for the range's bytes without those of the gap in it."""
        cut = gap_end - gap
        joined = (self.sums[gap] - self.sums[start]) * self.down[start] + (self.sums[end] - self.sums[gap_end]) * self.down[start + cut]
        return mix(joined + (end - start - cut).astype(np.uint64))


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word `[^\\x20\\x09-\\x0D]+`, and for each row the index of its first word (one more entry than rows)."""
    solid = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    before = np.concatenate(([False], solid[:-1])) if len(buf) else solid
    after = np.concatenate((solid[1:], [False])) if len(buf) else solid
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, off)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def row_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of values (one for each byte or item) in each row's range."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[off[1:]] - total[off[:-1]]
