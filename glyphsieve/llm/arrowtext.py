"""Texts as flat byte arrays, as the rest of the library has them."""

from __future__ import annotations

from ..functions.arrowtext import PIECE_BYTES, SPACE, Powers, flat, give_back, mix, pieces, prefix, ranged, word_hashes, words

__all__ = ["PIECE_BYTES", "SPACE", "Powers", "flat", "give_back", "mix", "pieces", "prefix", "ranged", "word_hashes", "words"]
