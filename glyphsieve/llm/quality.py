"""Quality by co-training: a text-content and a page-metadata classifier that teach each other.

Each view is a naive Bayes model held as counts: the text view over the words of a text (which of WORDS hashed words it
holds) and over binned measures of its style, the metadata view over source, language and length.  Labelled rows are
dealt by a hash of the id: half to training, others to tuning (the scores at which a view is sure, and its isotonic
curve), to the combination of both views, to its calibration, and a tenth to nothing, so that accuracy can be measured
on rows that no step has seen.  In each round a view labels the documents it is sure of, sure meaning beyond the score
at which it was right in PRECISION of the tuning rows, and the other view counts them in.  At the end a logistic model
of the two calibrated views, calibrated in turn, scores every document.  The texts are read once; the rounds read a
narrow table of bins and word numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import SPACE, pieces, word_hashes, words
from .storage import Scratch

ROUNDS, PRECISION, SMOOTHING = 3, 0.97, 1.0
#: What a pseudo-label counts against a true one.
PSEUDO_WEIGHT = 0.25
#: Labelled rows that tuning, combination and calibration are each fitted on at most, drawn by a hash.
FIT_ROWS = 50_000
#: Tenths of the labelled rows: up to the first for training, then tuning, combination, calibration; the last is held out.
TRAIN, TUNE, COMBINE, CALIBRATE, HELD_OUT = 5, 7, 8, 9, 10
BINS = 32
#: Hashed words; a text's words are sent about as their numbers, each once.
WORDS = 1 << 16
#: Sums travel in blocks of so many counts.
BLOCK = 1024
TEXT_FEATURES = ("length", "word_length", "symbols", "capitals", "digits", "distinct", "repeats", "lines", "same_lines", "long_words", "marked_words", "high_bytes")
#: Bins of each metadata feature: source and language by hash, the logarithm of the length.
META_BINS = (1024, 128, BINS)


def _share(x: np.ndarray) -> np.ndarray:
    """Bins of a share from 0 to 1, finer near both ends."""
    x = np.clip(x, 0, 1)
    return np.minimum(BINS - 1, (BINS / 2 * (np.sqrt(x) + 1 - np.sqrt(1 - x))).astype(np.int64))


def _log(x: np.ndarray, step: float) -> np.ndarray:
    return np.clip(np.log2(np.maximum(x, 0) + 1) / step, 0, BINS - 1).astype(np.int64)


def _counted(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[off])


def _distinct(value: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    if not len(value):
        return np.zeros(n, np.int64)
    order = np.lexsort((value, doc))
    v, d = value[order], doc[order]
    return np.bincount(d[np.append(True, (v[1:] != v[:-1]) | (d[1:] != d[:-1]))], minlength=n)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def word_numbers(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, first): text i holds the words numbers[first[i]:first[i + 1]], each once; ASCII letters in lower case."""
    starts, ends, first = words(data, off)
    number = (word_hashes(_LOWER[data], starts, ends) >> np.uint64(48)).astype(np.int64)
    both = np.unique(np.repeat(np.arange(len(off) - 1), np.diff(first)) * WORDS + number)
    return both % WORDS, np.searchsorted(both, np.arange(len(off)) * WORDS)


def text_bins(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, features) bins of whole texts; an empty text has its own bins, all from zero counts."""
    n, size = len(off) - 1, np.maximum(np.diff(off), 1)
    starts, ends, first = words(data, off)
    doc = np.repeat(np.arange(n), np.diff(first))
    count = np.maximum(np.diff(first), 1)
    h = word_hashes(data, starts, ends)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    upper, lower = (data >= 0x41) & (data <= 0x5A), (data >= 0x61) & (data <= 0x7A)
    digit, high = (data >= 0x30) & (data <= 0x39), data >= 0x80
    symbol = ~(upper | lower | digit | high | SPACE[data])
    marks = np.concatenate([[0], np.cumsum(symbol)])
    line_end = data == 0x0A
    cut = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], np.flatnonzero(line_end) + 1]))
    cut = cut[cut < len(data)]
    line_doc = np.searchsorted(off, cut, "right") - 1
    lines = np.bincount(line_doc, minlength=n) if len(cut) else np.zeros(n, np.int64)
    line_end_at = np.append(cut[1:], len(data)) if len(cut) else cut
    line_value = word_hashes(data, cut, line_end_at)
    wlen = ends - starts
    by_doc = lambda x: np.bincount(doc[x], minlength=n)
    marked = marks[ends] - marks[starts] >= 2
    out = [
        _log(np.diff(off), 0.75),
        _log(_counted(~SPACE[data], off) / count, 0.2),
        _share(_counted(symbol, off) / size),
        _share(_counted(upper, off) / size),
        _share(_counted(digit, off) / size),
        _share(_distinct(h, doc, n) / count),
        _share(by_doc(same) / count),
        _log(lines, 0.4),
        _share(1 - _distinct(line_value, line_doc, n) / np.maximum(lines, 1)),
        _share(by_doc(wlen > 24) / count),
        _share(by_doc(marked) / count),
        _share(_counted(high, off) / size),
    ]
    return np.stack(out, 1).astype(np.uint16)


def features(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, chars_col: str) -> DataFrame:
    """(id, text, words, meta): the bins of both views and the numbers of the words, as 16-bit integers."""
    kind = docs.select(id_col).dtypes[0][1]
    hashed = lambda c, n: F.when(F.col(c).isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(n - 1))).cast("int")
    length = F.least(F.lit(BINS - 1), F.coalesce((F.log2(F.greatest(F.col(chars_col), F.lit(0)).cast("double") + 1) / 0.75).cast("int") + 1, F.lit(0)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), hashed(source_col, META_BINS[0]).alias("s"), hashed(lang_col, META_BINS[1]).alias("l"), length.alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in pieces(batches, "t"):
            text, (number, first) = text_bins(data, off), word_numbers(data, off)
            meta = np.stack([part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4)], 1).astype(np.uint16)
            number = number.astype(np.uint16)
            held = [number[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.binary()) for x in ([x.tobytes() for x in text], held, [x.tobytes() for x in meta]))], names=["id", "text", "words", "meta"])

    return rows.mapInArrow(run, f"id {kind}, text binary, words binary, meta binary")


class View:
    """Counts by class, feature and bin, and by class and word; the score of a row is its log odds."""

    def __init__(self, bins: tuple[int, ...], words: int = 0):
        self.at = np.concatenate([[0], np.cumsum(bins)])[:-1]
        self.bins, self.words = bins, words
        self.counts = np.zeros((2, sum(bins) + words))
        self.sure = (-np.inf, np.inf)

    def read(self, column: list[bytes], words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bins by row and feature, words of all rows, first word of each row)."""
        places = np.frombuffer(b"".join(column), np.uint16).reshape(-1, len(self.bins)).astype(np.int64) + self.at
        if not self.words:
            return places, np.zeros(0, np.int64), np.zeros(len(places) + 1, np.int64)
        first = np.concatenate([[0], np.cumsum([len(x) // 2 for x in words])]).astype(np.int64)
        return places, np.frombuffer(b"".join(words), np.uint16).astype(np.int64) + sum(self.bins), first

    def add(self, rows: tuple, labels: np.ndarray) -> np.ndarray:
        places, words, first = rows
        of_word = np.repeat(labels, np.diff(first))
        return np.stack([np.bincount(np.concatenate([places[labels == c].ravel(), words[of_word == c]]), minlength=self.counts.shape[1]) for c in (0, 1)]).astype(float)

    def score(self, rows: tuple) -> np.ndarray:
        """Bins count in full; a text's words, which are far from independent, as their sum over the root of their number."""
        places, words, first = rows
        n = self.counts[:, : self.bins[0]].sum(1)  # rows of each class
        share = [(self.counts[:, a : a + b] + SMOOTHING) / (n[:, None] + SMOOTHING * b) for a, b in zip(self.at, self.bins)]
        share.append((self.counts[:, sum(self.bins) :] + SMOOTHING) / (n[:, None] + 2 * SMOOTHING))
        share = np.concatenate(share, 1)
        odds = np.log(share[1]) - np.log(share[0])
        sums = np.concatenate([[0], np.cumsum(odds[words])])
        held = (sums[first[1:]] - sums[first[:-1]]) / np.sqrt(np.maximum(np.diff(first), 1))
        return odds[places].sum(1) + held + np.log((n[1] + 1) / (n[0] + 1))

    def set_sure(self, score: np.ndarray, label: np.ndarray) -> None:
        """The largest tails of the tuning rows in which PRECISION of the labels agree; none if they are too few."""
        edges = [-np.inf, np.inf]
        for c, sign in ((0, 1), (1, -1)):
            order = np.argsort(sign * score, kind="stable")
            right = np.cumsum(label[order] == c) / np.arange(1, len(order) + 1)
            last = sign * score[order]
            whole = np.append(last[1:] != last[:-1], True) if len(order) else np.zeros(0, bool)
            good = np.flatnonzero((right >= PRECISION) & whole & (np.arange(len(order)) >= 19))
            # where all rows are c, a tail tells nothing
            if len(good) and (label == c).mean() < PRECISION:
                edges[c] = sign * last[good[-1]]
        if edges[0] >= edges[1]:  # both tails would do beyond where they meet
            middle = (edges[0] + edges[1]) / 2
            edges = [np.nextafter(middle, -np.inf), middle]
        self.sure = tuple(edges)

    def calls(self, score: np.ndarray) -> np.ndarray:
        """0 or 1 where sure, else -1."""
        return np.where(score >= self.sure[1], 1, np.where(score <= self.sure[0], 0, -1))


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: scores and non-decreasing probabilities to interpolate between."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # rate, weight, first and last score
    for s, y in zip(score[order].tolist(), label[order].tolist()):
        if blocks and blocks[-1][3] == s:
            r, w, s1, _ = blocks.pop()
            blocks.append([(r * w + y) / (w + 1), w + 1, s1, s])
        else:
            blocks.append([float(y), 1, s, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            r, w, _, s2 = blocks.pop()
            r1, w1, s1, _ = blocks.pop()
            blocks.append([(r * w + r1 * w1) / (w + w1), w + w1, s1, s2])
    rate = np.maximum.accumulate([(b[0] * b[1] + 0.5) / (b[1] + 1) for b in blocks]) if blocks else np.zeros(0)
    return np.array([x for b in blocks for x in b[2:]]), np.repeat(rate, 2)


def _apply(curve: tuple[np.ndarray, np.ndarray], score: np.ndarray) -> np.ndarray:
    return np.interp(score, *curve) if len(curve[0]) else np.full(len(score), 0.5)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _combine(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.array([0.0, 1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (label - p) - 0.1 * w
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), g)
    return w


def fold(id_: Column) -> Column:
    """Tenths of the ids, by a hash."""
    return F.pmod(F.xxhash64(id_), F.lit(10))


def co_train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", label_col: str = "quality", rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: id, p_text, p_meta, score (the probability of label 1), held_out.

    held_out marks the ids whose labels no step has seen.  Defined cases: a document with several labels takes the
    more frequent one, 0 on a tie; null labels and null ids count for nothing; a null text is an empty one, and null
    metadata are a value of their own; without labels of both classes for tuning every probability is 0.5, and
    without them for combination or calibration that step is left out.  Repeated rows each get a row and count as
    rows, an empty table gives none, and other columns are not read.  A text is worked on whole, in some 40 bytes of
    memory for each of its bytes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    own = (id_col, text_col, source_col, lang_col, chars_col)
    known = labels.select(F.col(id_col).alias("lid"), F.col(label_col).cast("double").alias("y")).filter("lid is not null and y is not null")
    known = known.groupBy("lid").agg((F.avg((F.col("y") > 0).cast("double")) > 0.5).cast("int").alias("label"))
    table = features(docs.filter(F.col(id_col).isNotNull()), *own).join(known, F.col("id") == F.col("lid"), "left").drop("lid")
    table = table.unionByName(features(docs.filter(F.col(id_col).isNull()), *own).withColumn("label", F.lit(None).cast("int")))  # they join nothing
    table = scratch.write(table.withColumn("fold", fold(F.col("id"))), "bins")
    views = View((BINS,) * len(TEXT_FEATURES), WORDS), View(META_BINS)

    fit = scratch.write(table.filter(F.col("label").isNotNull() & (F.col("fold") >= TRAIN) & (F.col("fold") < CALIBRATE)).select("text", "words", "meta", "label", "fold", F.xxhash64("id", F.lit(1)).alias("o")), "fit")

    def scored(low: int, high: int) -> tuple[list[np.ndarray], np.ndarray]:
        """At most FIT_ROWS labelled rows of some folds, by a hash: their scores in both views now, and their labels."""
        rows = fit.filter((F.col("fold") >= low) & (F.col("fold") < high))
        n = rows.count()
        if n > FIT_ROWS:
            rows = rows.filter(F.col("o") < int((2 * FIT_ROWS / n - 1) * 2**63))
        sent = spark.sparkContext.broadcast(views)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                held = b.column(1).to_pylist()
                s = [pa.array(v.score(v.read(b.column(i).to_pylist(), held))) for v, i in zip(sent.value, (0, 2))]
                yield pa.RecordBatch.from_arrays([*s, b.column(3), b.column(4)], names=["text", "meta", "label", "o"])

        t = rows.select("text", "words", "meta", "label", "o").mapInArrow(run, "text double, meta double, label int, o bigint").toArrow()
        t = t.sort_by([("o", "ascending"), ("text", "ascending"), ("meta", "ascending")]).slice(0, FIT_ROWS)
        y = t["label"].to_numpy().astype(int) if len(t) else np.zeros(0, int)
        return [t[c].to_numpy() if len(t) else np.zeros(0) for c in ("text", "meta")], y

    def gather(models, call: bool) -> list[np.ndarray]:
        """Summed counts of both views: of true labels, or of what the other view is sure of."""
        sent = spark.sparkContext.broadcast(models)

        def blocks(total: dict[int, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "sums"])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v = sent.value
            total = [np.zeros_like(x.counts) for x in v]
            for b in batches:
                held = b.column(1).to_pylist()
                at = [x.read(b.column(i).to_pylist(), held) for x, i in zip(v, (0, 2))]
                if call:
                    told = [x.calls(x.score(p)) for x, p in zip(v, at)][::-1]
                else:
                    told = [b.column(3).to_numpy(zero_copy_only=False)] * 2
                for t, x, p, y in zip(total, v, at, told):
                    t += x.add(p, y)
            flat = np.concatenate([t.ravel() for t in total])
            yield blocks({i: x for i, a in enumerate(range(0, len(flat), BLOCK)) if (x := flat[a : a + BLOCK]).any()})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    total[i] = total[i] + np.frombuffer(x, float) if i in total else np.frombuffer(x, float)
            yield blocks(total)

        rows = table.filter("label is null" if call else f"label is not null and fold < {TRAIN}").select("text", "words", "meta", "label")
        parts = rows.mapInArrow(count, "block int, sums binary").repartition(32, "block").mapInArrow(add, "block int, sums binary").collect()  # a row for each block
        sizes = [x.counts.size for x in models]
        flat = np.zeros(sum(sizes))
        for r in parts:
            flat[r.block * BLOCK : r.block * BLOCK + len(r.sums) // 8] = np.frombuffer(bytes(r.sums), float)
        return [x.reshape(2, -1) for x in np.split(flat, [sizes[0]])]

    curves, weights = [(np.zeros(0), np.zeros(0))] * 2, np.array([0.0, 1.0, 0.0])
    last = (np.zeros(0), np.zeros(0))
    kinds = {r.label for r in fit.filter(F.col("fold") < TUNE).select("label").distinct().collect()}
    if len(kinds) == 2:
        true = gather(views, False)
        for v, c in zip(views, true):
            v.counts = c
        for _ in range(rounds):
            scores, y = scored(TRAIN, TUNE)
            for v, s in zip(views, scores):
                v.set_sure(s, y)
            extra = gather(views, True)
            for v, c, e in zip(views, true, extra):
                v.counts = c + PSEUDO_WEIGHT * e
        scores, y = scored(TRAIN, TUNE)
        curves = [isotonic(s, y) for s in scores]
        both = lambda scores: np.column_stack([_logit(_apply(c, s)) for c, s in zip(curves, scores)])
        scores, y = scored(TUNE, COMBINE)
        if 0 < y.sum() < len(y):
            weights = _combine(both(scores), y)
        scores, y = scored(COMBINE, CALIBRATE)
        if 0 < y.sum() < len(y):
            last = isotonic(weights[0] + both(scores) @ weights[1:], y)
    sent = spark.sparkContext.broadcast((views, curves, weights, last))
    kind = docs.select(id_col).dtypes[0][1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, c, w, end = sent.value
        for b in batches:
            held = b.column(2).to_pylist()
            p = [_apply(curve, x.score(x.read(b.column(i).to_pylist(), held))) for x, curve, i in zip(v, c, (1, 3))]
            both = w[0] + w[1] * _logit(p[0]) + w[2] * _logit(p[1])
            both = _apply(end, both) if len(end[0]) else 1 / (1 + np.exp(-both))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in (*p, both)), b.column(4)], names=["id", "p_text", "p_meta", "score", "held_out"])

    return table.select("id", "text", "words", "meta", (F.col("fold") >= CALIBRATE).alias("held_out")).mapInArrow(score, f"id {kind}, p_text double, p_meta double, score double, held_out boolean")
