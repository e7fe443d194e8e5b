"""Locally consistent parsing by recompression, vectorised over the words of many documents.

Each round names runs of one symbol and pairs of neighbours.  A name is a hash of what it stands for, so equal
material gets equal names in every document of the corpus without any exchange.  Pairs follow the left/right
halves of the alphabet, drawn by a bit of the name: a left symbol merges with the right symbol after it.
Symbols longer than `active` words rest, which bounds every symbol.

Each symbol carries the range of words that its existence depends on.  If that range lies within a window, every
other occurrence of the window, in whatever surroundings, is parsed into the same symbol at the same place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .arrowtext import mix

_P, _Q, _R = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x2545F4914F6CDD1D)


@dataclass
class Parse:
    """Symbols in text order: name, words start..end, document, and the words low..high they depend on."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _runs(p: Parse, active: int) -> Parse:
    n = len(p.name)
    length = p.end - p.start
    same = np.zeros(n, bool)  # as the symbol before
    same[1:] = (p.name[1:] == p.name[:-1]) & (p.doc[1:] == p.doc[:-1]) & (length[1:] == length[:-1]) & (length[1:] <= active)
    head = np.flatnonzero(~same)
    size = np.diff(np.append(head, n))
    inside = np.arange(n) - np.repeat(head, size)
    piece = np.maximum(1, 2 * active // length)
    lead = np.flatnonzero(inside % piece == 0)  # long runs are cut into pieces, alike wherever they begin
    count = np.diff(np.append(lead, n))
    run = np.cumsum(~same) - 1
    before, after = np.maximum(head - 1, 0), np.minimum(head + size, n - 1)
    low, high = np.minimum(p.low[head], p.low[before]), np.maximum(p.high[head + size - 1], p.high[after])
    first, last = np.ones(len(head), bool), np.ones(len(head), bool)
    first[1:], last[:-1] = p.doc[head[1:]] != p.doc[head[1:] - 1], p.doc[head[1:]] != p.doc[head[1:] - 1]
    low = np.where(first, p.start[head] - 1, low)
    high = np.where(last, p.end[head + size - 1] + 1, high)
    still = length[head] > active  # resting symbols depend on nothing more
    low, high = np.where(still, p.low[head], low), np.where(still, p.high[head], high)
    name = p.name[lead].copy()
    many = count > 1
    name[many] = mix((name[many] ^ _R) * _P + count[many].astype(np.uint64) * _Q)
    end = p.end[np.append(lead[1:], n) - 1]
    return Parse(name, p.start[lead], end, p.doc[lead], low[run[lead]], high[run[lead]])


def _pairs(p: Parse, active: int, turn: int) -> Parse:
    salt = (turn * int(_Q)) & 0xFFFFFFFFFFFFFFFF
    rest = p.end - p.start > active
    bit = ((p.name ^ np.uint64(salt)) * _R) >> np.uint64(63) == 0
    left, right = bit & ~rest, ~bit & ~rest
    edge = p.doc[1:] != p.doc[:-1]  # between a symbol and the next
    joint = left[:-1] & right[1:] & ~edge
    a = np.flatnonzero(joint)
    low, high = p.low.copy(), p.high.copy()
    alone = left
    alone[a] = False
    one = np.flatnonzero(alone[:-1])
    high[one] = np.where(edge[one], p.end[one] + 1, np.maximum(high[one], p.high[one + 1]))
    if alone[-1]:
        high[-1] = p.end[-1] + 1
    alone = right
    alone[a + 1] = False
    one = np.flatnonzero(alone[1:]) + 1
    low[one] = np.where(edge[one - 1], p.start[one] - 1, np.minimum(low[one], p.low[one - 1]))
    if alone[0]:
        low[0] = p.start[0] - 1
    name, end = p.name.copy(), p.end.copy()
    name[a] = mix(p.name[a] * _P + (p.name[a + 1] ^ _Q) * _R + np.uint64(turn + 1))
    end[a] = p.end[a + 1]
    high[a], low[a] = np.maximum(p.high[a + 1], p.high[a]), np.minimum(p.low[a], p.low[a + 1])
    keep = np.ones(len(name), bool)
    keep[a + 1] = False
    return Parse(name[keep], p.start[keep], end[keep], p.doc[keep], low[keep], high[keep])


def parse(names: np.ndarray, first: np.ndarray, rounds: int, active: int, runs_at: tuple[int, ...]) -> Parse:
    """The symbols of documents whose words are names[first[i]:first[i + 1]]."""
    n = len(names)
    at = np.arange(n, dtype=np.int32)
    p = Parse(names, at, at + np.int32(1), np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first)), at, at + np.int32(1))
    for turn in range(rounds if n else 0):
        if turn in runs_at:
            p = _runs(p, active)
        p = _pairs(p, active, turn)
    return p
