"""Byte-pair encoding with word ends, by a segment tree over the ranks of adjacent pairs.

Each distinct word gets a segment tree whose leaves are the ranks of its adjacent pairs and whose nodes hold the
least (rank, place) below.  The root is the leftmost pair of lowest rank; merging it changes three leaves, each
brought up to the root in a logarithmic number of steps, until the root is empty.  The trees of many words are
worked on together as rows of one array; a very long word has a tree of its own.

Texts are cut into words by Python where all their characters are of long settled blocks, on whose classes, case and
composition every Unicode version agrees; other texts are normalised and cut by the tokenizers library itself, whose
tables are of another version.  The merges are those of the trees here in either case.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import give_back, pieces

#: Bytes of words, ids and their bookkeeping that a worker keeps; when they are too many, it starts anew.
KEPT_BYTES = 48 << 20
_ENTRY_BYTES = 200
#: Bytes beyond which a word has a tree of its own.
LONG_WORD = 256
_EMPTY = np.int64(1 << 62)
#: White space, as Unicode's property has it.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Anything but settled characters that neither combine nor change with what stands beside them: Latin, Greek, Cyrillic,
#: Hebrew and Arabic letters, punctuation and symbols, kana, the first ideographs, Hangul syllables and full-width forms.
_UNSETTLED = re.compile(
    "[^\0-ʯΑ-ΡΣ-ώЀ-҂Ҋ-ӿא-תء-غف-ي٠-٩"
    "Ḁ-ẛẠ-ỹ -‧‪-⁞₠-₵←-⇿∀-⋿─-◿"
    "　-〩ぁ-ゖ゛-ゞァ-ヾ一-龥가-힣！-～]"
)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(0x100 + extra), extra + 1
    return out


class Vocabulary:
    """A vocabulary file in the JSON form of the tokenizers library: NFC, lower case, byte-level BPE with word ends."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [x["type"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or splits != ["Split", "ByteLevel"] or spec["decoder"] or model["dropout"] or model["continuing_subword_prefix"] or model["byte_fallback"]:
            raise ValueError("not a lower-case byte-level BPE vocabulary with word ends")
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + end] for c in letters], np.int64)
        pairs = [x.split(" ", 1) if isinstance(x, str) else x for x in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        texts = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = [texts[i].encode() if i in texts else b"" for i in range(max(texts) + 1)]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace("[^\\s", f"[^{_WHITE}"))
        self.at_special = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self._table()
        self.ranks = {(a, b): r for r, (a, b) in reversed(list(enumerate(zip(self.left.tolist(), self.right.tolist()))))}
        self.raw, self.library, self.byte_of = raw, None, {c: b for b, c in enumerate(letters)}
        self.kept: dict[str, bytes] = {}
        self.kept_bytes = 0

    def _table(self) -> None:
        """An open-addressed table from pairs to ranks."""
        self.bits = max(4, int(len(self.left) * 4).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.zeros(1 << self.bits, np.int64)
        key = self.left << 32 | self.right
        for r in range(len(key) - 1, -1, -1):
            k = int(key[r])
            at = ((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> 64 - self.bits
            while self.slots[at] not in (-1, k):
                at = (at + 1) & (1 << self.bits) - 1
            self.slots[at], self.slot_rank[at] = k, r

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, _EMPTY >> 32 where there is none."""
        key = left << 32 | right
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(key), _EMPTY >> 32)
        open_ = np.arange(len(key))
        while len(open_):
            found = self.slots[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        return out

    # -- encoding ---------------------------------------------------------------------------------------------

    def split(self, text: str) -> list[str]:
        """The words of a text, special tokens among them as they are."""
        if self.at_special is None or not any(x in text for x in self.special):
            return self._plain(text)
        out, at = [], 0
        for m in self.at_special.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.words.findall(text.lower())
        if _UNSETTLED.search(text):
            return self._by_library(text)
        # lower case letter by letter: no final sigma
        return self.words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _by_library(self, text: str) -> list[str]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.raw.decode())
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        byte = self.byte_of
        return [bytes(byte[c] for c in w).decode() for w, _ in cut]

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        if self.kept_bytes > KEPT_BYTES or not self.kept:
            self.kept = {x: np.uint32(i).astype("<u4").tobytes() for x, i in self.special.items()}
            self.kept_bytes = 0
        new = list(set().union(*split).difference(self.kept)) if split else []
        ids = self.encode_words(new)
        self.kept.update(zip(new, ids))
        self.kept_bytes += _ENTRY_BYTES * len(new) + 2 * sum(map(len, new)) + sum(map(len, ids))
        get = self.kept.__getitem__
        return [b"".join(map(get, w)) for w in split]

    def encode_words(self, words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        out: list[bytes] = [b""] * len(raw)
        classes: dict[int, list[int]] = {}
        for i, w in enumerate(raw):
            if len(w) > LONG_WORD:
                out[i] = self._alone(w)
            elif w:
                classes.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(i)
        for size, members in classes.items():
            step = max(1, (1 << 19) // size)
            for a in range(0, len(members), step):
                some = members[a : a + step]
                for i, ids in zip(some, self._together([raw[i] for i in some], size)):
                    out[i] = ids
        return out

    def _together(self, raw: list[bytes], size: int) -> list[bytes]:
        m = len(raw)
        length = np.array([len(w) for w in raw])
        data = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in raw), np.uint8).reshape(m, size)
        place = np.arange(size)
        ids = np.where(place == length[:, None] - 1, self.final[data], self.inner[data])
        ids[place >= length[:, None]] = -1
        after = np.broadcast_to(place + 1, (m, size)).copy()
        after[after >= length[:, None]] = size
        before = np.broadcast_to(place - 1, (m, size)).copy()
        tree = np.full((m, 2 * size), _EMPTY)
        row, col = np.nonzero(place[:-1] < length[:, None] - 1)
        tree[row, size + col] = self.rank(ids[row, col], ids[row, col + 1]) << 32 | col
        tree[tree >= _EMPTY] = _EMPTY
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        act = np.flatnonzero(tree[:, 1] < _EMPTY)
        while len(act):
            best = tree[act, 1]
            at, rank = best & 0xFFFFFFFF, best >> 32
            gone = after[act, at]
            new = self.merged[rank]
            beyond = after[act, gone]
            ids[act, at], ids[act, gone] = new, -1
            after[act, at] = beyond
            inside = beyond < size
            before[act[inside], beyond[inside]] = at[inside]
            tree[act, size + gone] = _EMPTY
            leaf = np.full(len(act), _EMPTY)
            leaf[inside] = self.rank(new[inside], ids[act[inside], beyond[inside]]) << 32 | at[inside]
            tree[act, size + at] = np.minimum(leaf, _EMPTY)
            prev = before[act, at]
            led = np.flatnonzero(prev >= 0)
            leaf = self.rank(ids[act[led], prev[led]], new[led]) << 32 | prev[led]
            tree[act[led], size + prev[led]] = np.minimum(leaf, _EMPTY)
            x, y, z = size + at, size + gone, size + np.maximum(prev, 0)
            while x[0] > 1:
                x, y, z = x >> 1, y >> 1, z >> 1
                for node in (x, y, z):
                    tree[act, node] = np.minimum(tree[act, 2 * node], tree[act, 2 * node + 1])
            act = act[tree[act, 1] < _EMPTY]
        alive = ids >= 0
        flat, n = ids[alive].astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(alive.sum(1))]) * 4
        return [flat[a:b] for a, b in zip(n[:-1].tolist(), n[1:].tolist())]

    def _alone(self, word: bytes) -> bytes:
        n = len(word)
        size = 1 << (n - 1).bit_length()
        ids = self.inner[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.final[word[-1]])
        empty, ranks = int(_EMPTY), self.ranks
        leaf = lambda i, j: ranks[k] << 32 | i if (k := (ids[i], ids[j])) in ranks else empty
        tree = [empty] * size + [leaf(i, i + 1) for i in range(n - 1)] + [empty] * (size - n + 1)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                value = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == value:
                    break
                tree[i] = value

        while (best := tree[1]) < empty:
            at, gone = best & 0xFFFFFFFF, after[best & 0xFFFFFFFF]
            ids[at], ids[gone] = int(self.merged[best >> 32]), -1
            beyond = after[at] = after[gone]
            put(gone, empty)
            if beyond < n:
                before[beyond] = at
                put(at, leaf(at, beyond))
            else:
                put(at, empty)
            if before[at] >= 0:
                put(before[at], leaf(before[at], at))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    # -- decoding ---------------------------------------------------------------------------------------------

    def decode(self, ids: bytes) -> bytes:
        """The tokens of the ids, special ones included, joined by spaces (the file names no decoder), in UTF-8."""
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(raw: bytes) -> Vocabulary:
    """The vocabulary of these bytes, built once in a process."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(raw)
    return _LOADED[key]


#: A vocabulary file is sent to the executors; larger files than this are refused.
MOST_VOCABULARY_BYTES = 64 << 20


def _sent(df: DataFrame, path: str):
    with open(path, "rb") as f:
        raw = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(raw) > MOST_VOCABULARY_BYTES:
        raise ValueError("the vocabulary file is too large to send to the executors")
    return df.sparkSession.sparkContext.broadcast(raw)


def _run(df: DataFrame, path: str, column: str, id_col: str, want: tuple[str, ...]) -> DataFrame:
    sent, kind = _sent(df, path), df.select(id_col).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(sent.value)
        for part, _, _ in pieces(batches, "x"):
            col = part.column(1).to_pylist()
            ids = v.encode([x or "" for x in col]) if "ids" in want else [x or b"" for x in col]
            out = [part.column(0)]
            if "ids" in want:
                out += [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if "decoded" in want:
                out.append(pa.array([v.decode(x) for x in ids], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=["id", *(["n_tokens"] if "ids" in want else []), *want])
        v.kept, v.kept_bytes = {}, 0  # the worker lives on; the next task begins anew
        give_back()

    fields = {"ids": "n_tokens bigint, ids binary", "decoded": "decoded string"}
    return df.select(F.col(id_col).alias("id"), F.col(column).alias("x")).mapInArrow(run, f"id {kind}, " + ", ".join(fields[w] for w in want))


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids): ids as little-endian unsigned 32-bit integers.  No shuffle; a row for each row.

    A null text counts as empty and has no ids; the strings of special tokens inside a text are those tokens;
    ids and other columns may be null, repeated or of clashing names, as only the two named columns are read.  A text
    is worked on whole, in some 90 bytes of memory for each of its bytes, its words being Python strings.
    """
    return _run(docs, vocabulary_path, text_col, id_col, ("ids",))


def decode(encoded: DataFrame, vocabulary_path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): the tokens of each row's ids joined by spaces; null ids count as none."""
    return _run(encoded, vocabulary_path, ids_col, id_col, ("decoded",))


def encode_and_decode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded): both in one pass over the texts."""
    return _run(docs, vocabulary_path, text_col, id_col, ("ids", "decoded"))
