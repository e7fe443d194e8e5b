"""Phrases of texts as 96-bit keys, many texts at once."""

from __future__ import annotations

import numpy as np

from .arrowtext import Powers, mix, prefix, ranged, word_hashes

#: Bytes of a phrase's key: 64 bits of one hash of its words and 32 of another.
KEY_BYTES = 12
_POWERS = Powers(np.uint64(0xC2B2AE3D27D4EB4F)), Powers(np.uint64(0x165667B19E3779F9))

#: What makes words, as in stylometry.WORD, of lower-cased text.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), 0x27]] = True


def word_ranges(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the byte ranges of all words; text i has the words first[i]..first[i + 1]."""
    inside = np.concatenate([[False], _WORD[data], [False]])
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True  # no word reaches over the end of a text
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def phrase_keys(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts, a, b): the text of each phrase of size words, and the 64 and 32 bits of its key."""
    starts, ends, first = word_ranges(data, off)
    at = np.arange(max(0, len(starts) - size + 1))
    text = np.searchsorted(first, at, "right") - 1
    at, text = at[at + size <= first[text + 1]], text[at + size <= first[text + 1]]
    keys = []
    for which, powers in enumerate(_POWERS):
        h = word_hashes(data, starts, ends, 1 + which)
        keys.append(mix(ranged(prefix(h, powers), at, at + size, powers) + np.uint64(size)))
    return text, keys[0], (keys[1] >> np.uint64(32)).astype(np.uint32)


def pack(a: np.ndarray, b: np.ndarray) -> bytes:
    return a.tobytes() + b.tobytes()


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // KEY_BYTES
    return np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.uint32, n, 8 * n)


def distinct(a: np.ndarray, b: np.ndarray, owner: np.ndarray | None = None) -> np.ndarray:
    """Places of one of each of the keys, of each owner if there are any."""
    order = np.argsort(a, kind="stable") if owner is None else np.lexsort((a, owner))
    a, b, owner = a[order], b[order], a[order] if owner is None else owner[order]
    if ((a[1:] == a[:-1]) & (owner[1:] == owner[:-1]) & (b[1:] != b[:-1])).any():  # two phrases of one a
        by = np.lexsort((b, a, owner))
        order, a, b, owner = order[by], a[by], b[by], owner[by]
    return order[np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (owner[1:] != owner[:-1]))[: len(a)]]
