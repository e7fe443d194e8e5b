"""Counts of overlapping character pairs, many texts at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Characters that are counted at once; one longer text is a piece of its own.
PIECE_CHARS = 1 << 20
#: Bits of a code point in a pair's number.
BITS = 21


def pair_counts(texts: Sequence[str], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owners, pairs, counts) of the pairs within each text, counted by the owner of the text; a pair is
    first << BITS | second.  Characters are numbered densely first, so that what is sorted is narrow."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    if len(code) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    seen = np.zeros(int(code.max()) + 1, bool)
    seen[code] = True
    letters = np.flatnonzero(seen)
    dense = np.zeros(len(seen), np.uint64)
    dense[letters] = np.arange(len(letters), dtype=np.uint64)
    place, base = dense[code], np.uint64(len(letters))
    within = np.ones(len(code) - 1, bool)  # no pair crosses from one text to the next
    ends = np.cumsum(size)
    within[ends[(ends > 0) & (ends < len(code))] - 1] = False
    key = np.repeat(owner.astype(np.uint64), size)[:-1] * (base * base) + place[:-1] * base + place[1:]
    key = key[within]
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.sort(key.astype(np.uint32) if key.max() < 1 << 32 else key)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n, key = np.diff(np.append(first, len(key))), key[first].astype(np.uint64)
    who, pair = key // (base * base), key % (base * base)
    return who.astype(np.int64), letters[(pair // base).astype(np.int64)] << BITS | letters[(pair % base).astype(np.int64)], n


def pieces(sizes: np.ndarray, limit: int = PIECE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most limit characters in all, or one longer text."""
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield i, j
        i = j
