"""Texts as flat byte arrays: Arrow string columns cut into bounded pieces, words and their hashes by numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once; one longer text is a piece of its own.
PIECE_BYTES = 1 << 20

#: The separators between words: space and the control characters 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes are hashed one by one, by XXH3.
LONG_WORD = 64
_LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def flat(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def give_back() -> None:
    """Returns freed memory to the system: workers live on for the next stage, which needs it elsewhere."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows with at most limit bytes of text, or one longer text, with (bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = flat(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j
    give_back()


def runs(sizes: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes in all, or one larger row."""
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
        yield i, j
        i = j


def byte_sizes(col: pa.Array) -> np.ndarray:
    """The bytes of each value of a string or binary column, 0 for null."""
    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of all words; text i has the words first[i]..first[i+1]."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    black = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    begin = black.copy()
    begin[1:] &= ~black[:-1] | cut[1:-1]
    end = black.copy()
    end[:-1] &= ~black[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, grown when a longer piece needs them."""

    def __init__(self, base: np.uint64 = _BASE):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, x in (("up", self.base), ("down", self.inverse)):
                p = np.full(max(n, 1 << 12), x, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


def prefix(values: np.ndarray, powers: Powers) -> np.ndarray:
    """Prefix sums of values[i] * base^i, with a leading 0."""
    up, _ = powers.to(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def ranged(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """The polynomial hash of each range, independent of its place."""
    _, down = powers.to(len(pre))
    return (pre[ends] - pre[starts]) * down[starts]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """A keyed 64-bit hash of the bytes of each word; hashes under different keys are independent.

    Eight bytes at a time go through the finaliser, so no pattern of repeated letters cancels out, and words of up
    to eight bytes of one size never collide.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    h = mix((size.astype(np.uint64) + np.uint64(1)) * _BASE + np.uint64(key * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    long = np.flatnonzero(size > LONG_WORD)
    some = np.flatnonzero((size > 0) & (size <= LONG_WORD)) if len(long) or not size.all() else np.arange(len(size))
    at = 0
    while len(some):
        h[some] = mix(h[some] ^ (eight[starts[some] + at] & _LOW[np.minimum(size[some] - at, 8)]))
        at += 8
        some = some[size[some] > at]
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        h[long] = [xxhash.xxh3_64_intdigest(raw[a:b], key + 1) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
    return h
