"""Language mixtures: EM over word likelihoods from byte trigrams, the language set chosen by penalised likelihood.

Each language is a smoothed distribution over hashed trigrams of UTF-8 bytes, counted over all training texts.
The words of a document are the units of the mixture: EM estimates the share of words that each language wrote, and
goes on until the shares stand still.  The sets {best single language} and {the k heaviest languages of the full
mixture}, for every k up to 16, some above and the number of languages in the mixture, compete by their likelihood less
1 and half the logarithm of the number of words for each language after the first; sets that cannot win, as all
languages together are likelier than any set, are passed over.

A word is recognised if one of the document's languages gives it a higher likelihood than chance, chance being equal
probabilities of all trigrams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import Powers, mix, pieces
from .rowfilter import keep_rows
from .storage import Scratch

BUCKETS, BLOCK = 1 << 16, 1 << 10
SMOOTHING = 0.5
#: EM ends once no share moves by more; the number of rounds is a safeguard that is not met in practice.
STILL, MOST_ROUNDS = 1e-4, 2000
#: A column with more languages than this is taken for a wrong one: models are sent to every task.
MOST_LANGUAGES = 256
UNKNOWN = "und"
_POWERS = Powers(np.uint64(0x8CB92BA72F3D8DD7))

#: Letters in lower case and all bytes of longer characters; every other ASCII byte is a border.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_ASCII_LETTER = (_FOLD >= 0x61) & (_FOLD < 0x7B)


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word, words): the trigrams of all texts, each with its word's number, and text i's words[i]..words[i+1].

    A word is a run of letter bytes; its trigrams begin at the border before it and end at the border after it.
    """
    n = len(off) - 1
    spread = np.full(len(data) + 2 * n + 2, 0x20, np.uint8)  # two borders between texts
    at = np.arange(len(data)) + 2 * np.repeat(np.arange(n), np.diff(off)) + 1
    spread[at] = _FOLD[data]
    letter = spread != 0x20
    begin = np.flatnonzero(letter[1:] & ~letter[:-1])  # the border before each word
    where = np.searchsorted(begin, off[:-1] + 2 * np.arange(n))
    word = np.cumsum(letter[1:] & ~letter[:-1]) - 1
    whole = np.flatnonzero(letter[1:-1])  # a trigram for each letter byte as its middle
    wide = spread.astype(np.uint32)
    code = wide[whole] << np.uint32(16) | wide[whole + 1] << np.uint32(8) | wide[whole + 2]
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return bucket, word[whole], np.append(where, len(begin))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and their log probabilities by bucket, from all rows with text and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, c in counts.items():
                some = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int64()), pa.array(c[some])], names=["lang", "bucket", "n"])
            counts.clear()

        for part, data, off in pieces(batches, "t"):
            bucket, word, words = trigrams(data, off)
            codes = part.column(1).dictionary_encode()
            text = np.searchsorted(words, word, "right") - 1
            lang = codes.indices.to_numpy()[text] if len(text) else np.zeros(0, np.int64)
            for i, name in enumerate(codes.dictionary.to_pylist()):
                c = np.bincount(bucket[lang == i], minlength=BUCKETS)
                counts[name] = counts[name] + c if name in counts else c
            if len(counts) > 64:
                yield from flush()
        yield from flush()

    rows = docs.select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("lang")).filter("t is not null and lang is not null")
    scratch = Scratch(docs.sparkSession, "languages")
    found = scratch.write(rows.mapInArrow(run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "counts")
    totals = found.groupBy("lang").agg(F.sum("n").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in {lang_col}")
    weight = {r["lang"]: r["n"] + SMOOTHING * BUCKETS for r in totals}

    def dense(t: pa.Table) -> pa.Table:
        """The log probabilities of a block of buckets; blocks keep the largest language from being one task's work."""
        lang, block = t["lang"][0].as_py(), t["block"][0].as_py()
        row = np.full(BLOCK, SMOOTHING)
        row[t["bucket"].to_numpy() - block * BLOCK] += t["n"].to_numpy()
        return pa.table({"lang": t["lang"].slice(0, 1), "block": t["block"].slice(0, 1), "logs": pa.array([np.log(row / weight[lang]).astype(np.float32).tobytes()], pa.binary())})

    blocks = found.withColumn("block", F.floor(F.col("bucket") / BLOCK).cast("long")).groupBy("lang", "block").applyInArrow(dense, "lang string, block bigint, logs binary").collect()  # 64 rows of 4 KB a language
    langs = sorted(weight)
    logs = np.stack([np.full(BUCKETS, np.log(SMOOTHING / weight[x]), np.float32) for x in langs]) if langs else np.zeros((0, BUCKETS), np.float32)
    for r in blocks:
        logs[langs.index(r["lang"]), r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(bytes(r["logs"]), np.float32)
    scratch.drop(found)
    return langs, logs


#: Languages that EM begins with; the others join a document's when they would raise its likelihood.
FIRST_LANGUAGES = 8
#: Sizes of sets that are tried, besides that of the whole mixture; a language with less of it is none of its own.
SET_SIZES, LEAST_SHARE = (*range(2, 17), 20, 25, 32, 40, 50, 64, 80, 100, 128, 160, 200), 1e-7
#: Likelihoods (words times languages) worked out at once.
CELLS = 1 << 20


class Likelihoods:
    """The distinct words of each document with their counts, and their log likelihoods by language, a block of words
    at a time: never all words by all languages."""

    def __init__(self, bucket: np.ndarray, word: np.ndarray, words: np.ndarray, logs: np.ndarray):
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        size = np.diff(np.append(starts, len(word)))
        doc = np.repeat(np.arange(len(words) - 1), np.diff(words))
        up, _ = _POWERS.to(int(size.max(initial=0)) + 1)
        sums = mix(bucket.astype(np.uint64) + np.uint64(1)) * up[np.arange(len(bucket)) - np.repeat(starts, size)]
        key = mix(np.add.reduceat(sums, starts) + size.astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)
        order = np.lexsort((key, doc))
        head = np.flatnonzero(np.append(True, (key[order][1:] != key[order][:-1]) | (doc[order][1:] != doc[order][:-1]))[: len(order)])
        one = order[head]
        self.weight = np.diff(np.append(head, len(order))).astype(np.float64)
        self.doc, self.start, self.size = doc[one], starts[one], size[one]
        self.first = np.searchsorted(self.doc, np.arange(len(words)))
        self.bucket, self.logs, self.langs = bucket, logs, len(logs)

    @classmethod
    def given(cls, likely: np.ndarray, first: np.ndarray) -> Likelihoods:
        """Words whose likelihoods are known, each of weight 1."""
        out = cls.__new__(cls)
        out.weight, out.first, out.langs = np.ones(len(likely)), np.asarray(first), likely.shape[1]
        out.doc, out.size = np.repeat(np.arange(len(first) - 1), np.diff(first)), np.ones(len(likely), np.int64)
        out.rows = lambda which: likely[which]
        return out

    def rows(self, which: np.ndarray) -> np.ndarray:
        """Log likelihoods (word, language) of some words."""
        size = self.size[which]
        first = np.cumsum(size) - size
        bucket = self.bucket[np.arange(size.sum()) - np.repeat(first - self.start[which], size)]
        return np.stack([np.add.reduceat(t[bucket], first) for t in self.logs], 1)

    def blocks(self, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(words, their likelihoods), as many at once as CELLS allows in words and in trigrams."""
        step, i = max(1, CELLS // max(1, self.langs)), 0
        ends = np.cumsum(self.size[which])
        while i < len(which):
            before = ends[i - 1] if i else 0
            j = max(i + 1, min(i + step, int(np.searchsorted(ends, before + CELLS, "right"))))
            yield which[i:j], self.rows(which[i:j])
            i = j


def _by_doc(first: np.ndarray, a: int, b: int, values: np.ndarray, out: np.ndarray) -> None:
    """Adds the values of words a to b to out by document."""
    low, high = np.searchsorted(first, a, "right") - 1, np.searchsorted(first, b - 1, "right") - 1
    out[low : high + 1] += np.add.reduceat(values, np.maximum(first[low : high + 1], a) - a, axis=0, dtype=np.float64)


class _Words:
    """The words of some documents under as many languages of each document's own, relative to each word's best."""

    def __init__(self, like: Likelihoods, docs: np.ndarray, columns: np.ndarray, peak: np.ndarray):
        self.like, self.docs, self.columns = like, docs, columns
        n = np.diff(like.first)[docs]
        self.first = np.append(0, np.cumsum(n))
        self.doc = np.repeat(np.arange(len(docs)), n)
        self.word = np.arange(self.first[-1]) - np.repeat(self.first[:-1] - like.first[docs], n)
        self.weight, self.peak = like.weight[self.word], peak[self.word]
        self.p, at = np.empty((len(self.word), columns.shape[1]), np.float32), 0
        for which, rows in like.blocks(self.word):
            some = slice(at, at + len(which))
            self.p[some] = np.exp(np.take_along_axis(rows, columns[self.doc[some]], 1) - self.peak[some, None])
            at += len(which)
        self.count = np.add.reduceat(self.weight, self.first[:-1])
        self.peaks = np.add.reduceat(self.weight * self.peak, self.first[:-1], dtype=np.float64)

    def em(self, some: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shares, log likelihoods) of some of the documents that EM settles at from shares w; languages at 0 stay."""
        out, value = w.copy(), np.zeros(len(some))
        open_, taken = np.arange(len(some)), some
        for turn in range(MOST_ROUNDS):
            if not turn or len(open_) != len(taken):
                taken = some[open_]
                n = np.diff(self.first)[taken]
                first = np.cumsum(n) - n
                doc = np.repeat(np.arange(len(taken)), n)
                word = np.arange(n.sum()) - np.repeat(first - self.first[:-1][taken], n)
            new, x = np.zeros(w.shape), np.zeros(len(taken))
            step = max(1, CELLS // w.shape[1])
            for a in range(0, len(word), step):
                which, here = word[a : a + step], doc[a : a + step]
                r = self.p[which] * w.astype(np.float32)[here]
                inside = np.maximum(r.sum(1), np.float32(1e-30))
                r *= (self.weight[which] / inside)[:, None].astype(np.float32)
                _by_doc(first, a, a + len(which), r, new)
                _by_doc(first, a, a + len(which), self.weight[which] * np.log(inside), x)
            new /= self.count[taken][:, None]
            done = np.abs(new - w).max(1) < STILL if turn + 1 < MOST_ROUNDS else np.ones(len(w), bool)
            w = new
            if done.sum() * 4 >= len(done):  # settled documents leave, now and then
                out[open_[done]], value[open_[done]] = w[done], self.peaks[taken[done]] + x[done]
                open_, w = open_[~done], w[~done]
                if not len(open_):
                    break
        return out, value

    def pull(self, w: np.ndarray) -> np.ndarray:
        """(document, language): how much the likelihood of each document, by word, would grow along each language at
        shares w; 1 for those in the mixture, and at its best at most 1 for all others."""
        out, at = np.zeros((len(self.docs), self.like.langs)), 0
        for which, rows in self.like.blocks(self.word):
            some = slice(at, at + len(which))
            inside = np.maximum((self.p[some] * w[self.doc[some]]).sum(1), 1e-30)
            _by_doc(self.first[:-1], at, at + len(which), np.exp(rows - self.peak[some, None]) * (self.weight[some] / inside)[:, None], out)
            at += len(which)
        return out / self.count[:, None]


def mixture(likely: np.ndarray, first: np.ndarray) -> np.ndarray:
    """mixtures() of words with known likelihoods."""
    return mixtures(Likelihoods.given(likely, first))


def mixtures(like: Likelihoods) -> np.ndarray:
    """Weights (document, language) of the chosen mixtures.  Each document has a word at least.

    The mixture of all languages is found by an active set: EM over a document's best few, then a look at which of the
    others would raise its likelihood, and once more with these, until none would by as much as half a nat.
    """
    docs, langs = len(like.first) - 1, like.langs
    total, hard = np.zeros((docs, langs)), np.zeros((docs, langs))
    peak, at = np.empty(len(like.doc), np.float32), 0
    for which, rows in like.blocks(np.arange(len(like.doc))):
        peak[which] = rows.max(1)
        _by_doc(like.first[:-1], at, at + len(which), rows * like.weight[which][:, None], total)
        np.add.at(hard, (like.doc[which], rows.argmax(1)), like.weight[which])
        at += len(which)
    out = np.zeros((docs, langs))
    out[np.arange(docs), total.argmax(1)] = 1
    if langs < 2:
        return out
    value, width = total.max(1), min(langs, FIRST_LANGUAGES)
    hard[np.arange(docs), total.argmax(1)] += 0.5  # the best single language takes part
    left, columns = np.arange(docs), np.argsort(-hard, axis=1, kind="stable")[:, :width]
    while len(left):
        words = _Words(like, left, columns, peak)
        begin = np.take_along_axis(hard[left], columns, 1) + 1
        full, most = words.em(np.arange(len(left)), begin / begin.sum(1, keepdims=True))
        ready = np.ones(len(left), bool)
        if width < langs:
            more = words.pull(full)
            np.put_along_axis(more, columns, -1, 1)
            ready = words.count * (more.max(1) - 1) <= 0.5
        _choose(words, np.flatnonzero(ready), full, most, value, out)
        width = min(langs, 2 * width)
        if not ready.all():  # the others go on with their languages and those that pull most
            np.put_along_axis(more, columns, 2 + full * words.count.max(), 1)
            columns = np.argsort(-more[~ready], axis=1, kind="stable")[:, :width]
        left = left[~ready]
    return out


def _choose(words: _Words, ready: np.ndarray, full: np.ndarray, most: np.ndarray, value: np.ndarray, out: np.ndarray) -> None:
    """Holds the sets of the heaviest languages of the documents that are ready against the best single one (value), and
    puts the better shares into out."""
    docs, count = words.docs, words.count
    penalty = 0.5 * np.log(np.maximum(count, 2)) + 1
    order, support = np.argsort(-full, axis=1, kind="stable"), (full > LEAST_SHARE).sum(1)
    rising = ready[support[ready] > 1]
    sizes = [k for k in SET_SIZES if k < full.shape[1]] + [full.shape[1]]
    for k in sizes:
        rising = rising[most[rising] - penalty[rising] * (np.minimum(k, support[rising]) - 1) > value[docs[rising]]]
        if not len(rising):
            break
        own = np.minimum(k, support[rising])
        chosen = np.zeros((len(rising), full.shape[1]))
        np.put_along_axis(chosen, order[rising], np.take_along_axis(full[rising], order[rising], 1) + 1e-6, 1)
        np.put_along_axis(chosen, order[rising], np.where(np.arange(full.shape[1]) < own[:, None], np.take_along_axis(chosen, order[rising], 1), 0), 1)
        w, now = words.em(rising, chosen / chosen.sum(1, keepdims=True))
        now -= penalty[rising] * (own - 1)
        better = rising[now > value[docs[rising]]]
        out[docs[better]] = 0
        np.put_along_axis(shares := out[docs[better]], words.columns[better], w[now > value[docs[rising]]], 1)
        out[docs[better]] = shares
        value[docs[better]] = now[now > value[docs[rising]]]
        rising = rising[support[rising] > k]


def shares_of(data: np.ndarray, off: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, languages) shares of each text's words, all 0 for texts without a letter, and the share of its words
    that are recognised."""
    n = len(off) - 1
    shares, known = np.zeros((n, len(logs))), np.zeros(n)
    bucket, word, words = trigrams(data, off)
    some = np.flatnonzero(np.diff(words)) if len(logs) else np.zeros(0, np.int64)
    if len(some):
        like = Likelihoods(bucket, word, np.append(words[some], words[-1]), logs)
        mine = mixtures(like)
        shares[some] = mine
        fits = np.zeros(len(some))
        for which, rows in like.blocks(np.arange(len(like.doc))):
            fit = np.where(mine[like.doc[which]] > 0, rows, -np.inf).max(1) > -np.log(BUCKETS) * like.size[which]
            fits += np.bincount(like.doc[which], fit * like.weight[which], len(some))
        known[some] = fits / np.add.reduceat(like.weight, like.first[:-1])
        plain = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])[off]
        for i in some[np.diff(plain)[some] == 0]:
            if not any(c.isalpha() for c in data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")):
                shares[i] = known[i] = 0
    return shares, known


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score, languages, shares (heaviest first).

    lang_pred is the language with the largest share, ties to the first in order, and score its share.  Texts
    that are null or have no letter get `und`, score 0 and empty lists, as does every text when nothing was
    learned.  Ids may be null or repeated, and repeated rows get equal rows; other columns, of whatever names, are
    not read; an empty table gives no rows.  A text is worked on whole, in some 60 bytes of memory for each of its bytes,
    and for each of its distinct words 8 bytes for each language that its mixture is tried with, 8 languages at first.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages x 65,536 floats
    kind = docs.select(id_col).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs = sent.value
        for part, data, off in pieces(batches, "t"):
            shares, _ = shares_of(data, off, logs)
            top = shares.argmax(1) if names else np.zeros(len(shares), np.int64)
            score = np.clip(shares.max(1), 0, 1) if names else np.zeros(len(shares))
            order = np.argsort(-shares, axis=1, kind="stable")
            kept = [[j for j in o if s[j] > 1e-3] for o, s in zip(order.tolist(), shares)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([names[t] if s > 0 else UNKNOWN for t, s in zip(top.tolist(), score.tolist())], pa.string()),
                    pa.array(score),
                    pa.array([[names[j] for j in k] for k in kept], pa.list_(pa.string())),
                    pa.array([[float(s[j]) for j in k] for k, s in zip(kept, shares)], pa.list_(pa.float64())),
                ],
                names=["id", "lang_pred", "score", "languages", "shares"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, languages array<string>, shares array<double>")


def keep_recognised(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of whose words that share at least is recognised in the languages inferred for the text.

    So texts that are `und` go, and texts in a language that was not learned or in none; mixtures stay.  All columns
    are as they are.  Null and empty texts go; repeated rows fare alike; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def mask(part: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        shares, known = shares_of(data, off, sent.value[1])
        return (shares.max(1, initial=0) > 0) & (known >= least)

    return keep_rows(docs, text_col, mask)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3


def train_and_predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """predict() with a model from the rows whose fold is not 1."""
    return predict(docs, train(docs.filter(fold(id_col) != 1), text_col, lang_col), id_col, text_col)
