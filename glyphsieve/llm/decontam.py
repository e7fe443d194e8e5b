"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

For each size of benchmark item the windows of that many words are fingerprinted.  Fingerprints within RADIUS bits
agree up to RADIUS // 8 bits in one of eight one-byte blocks at least.  So there is a table for each block and size: under
each value of the byte it has all items whose byte is that near.  Eight look-ups give the candidates of a window, their
union every item within the radius.  Candidates are verified by the exact weighted (multiset) similarity of their word
shingles, as 64-bit hashes.

Two exact bounds save work and leave nothing out: only windows with as many shingles known from items of their size as
the threshold asks for are fingerprinted, and of the candidates only those are measured that hold one of the window's
rarest shingles, as many of these as an item at the threshold cannot all lack.  A document shorter than an item is its
own window, held to the share that both lengths ask for.

A benchmark of up to SLICE_BYTES goes to the documents.  A larger one is parted into slices; one scan of the documents
holds each against bit filters of up to SCAN_SLICES slices, and what may hold an item of a slice goes, salted, to where
that slice is.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .arrowtext import Powers, mix, pieces, prefix, ranged, word_hashes, words
from .rowfilter import keep_rows
from .storage import Scratch

SHINGLE, THRESHOLD, RADIUS = 5, 0.8, 31
BLOCKS = 8
#: Benchmark text that a worker holds at once; a larger benchmark is parted into slices of this size.
SLICE_BYTES = 8 << 20
#: Slices that one scan of the documents is held against, and the bits of the filter of each.
SCAN_SLICES, _SLICE_BITS = 8, 24
#: The documents for one slice are dealt to so many copies of it.
SALTS = 16
_POWERS = Powers(np.uint64(0xA0761D6478BD642F))
_FILTER_BITS = 20

#: ASCII letters in lower case, digits and all bytes of longer characters make words; the rest parts them.
FOLD = np.full(256, 0x20, np.uint8)
FOLD[0x80:] = np.arange(0x80, 0x100)
for _a, _b, _d in ((0x30, 0x3A, 0), (0x61, 0x7B, 0), (0x41, 0x5B, 0x20)):
    FOLD[_a:_b] = np.arange(_a, _b) + _d


def _grams(h: np.ndarray, pre: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words, in place of their first words."""
    at = np.arange(max(0, len(h) - size + 1))
    return mix(ranged(pre, at, at + size, _POWERS) + np.uint64(size))


def _simhash(grams: np.ndarray) -> np.uint64:
    votes = np.unpackbits(grams.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(votes * 2 > len(grams)).view(">u8")[0].astype(np.uint64)


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers from each first up to its last, one range after the other."""
    n = last - first
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


class Items:
    """A slice of the benchmark: items by size, with their fingerprints, and their shingles in both directions."""

    def __init__(self, texts: list[str | None], threshold: float, radius: int):
        self.threshold, self.radius = threshold, radius
        self.by_size: dict[int, list[int]] = defaultdict(list)
        self.prints = np.zeros(len(texts), np.uint64)
        held: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for i, text in enumerate(texts):
            data = FOLD[np.frombuffer((text or "").encode(), np.uint8)]
            starts, ends, _ = words(data, np.array([0, len(data)]))
            h, n = word_hashes(data, starts, ends), len(starts)
            if n:
                k = min(SHINGLE, n)
                g = _grams(h, prefix(h, _POWERS), k)
                self.by_size[n].append(i)
                self.prints[i] = _simhash(g)
                held[k].append((i, g))
        #: by shingle size: known shingles in order; items by shingle (from, item), and their sizes, each once (from, size);
        #: shingles by item (from, to, shingle, weight)
        self.known, self.items, self.sizes, self.own, self.filters = {}, {}, {}, {}, {}
        size_of = np.zeros(len(texts), np.int64)
        for n, members in self.by_size.items():
            size_of[members] = n
        for k, found in held.items():
            item = np.repeat([i for i, _ in found], [len(g) for _, g in found])
            known, gram = np.unique(np.concatenate([g for _, g in found]), return_inverse=True)
            pair, weight = np.unique(np.stack([item, gram.reshape(-1)], 1), axis=0, return_counts=True)
            ids = np.arange(len(texts))
            self.own[k] = np.searchsorted(pair[:, 0], ids), np.searchsorted(pair[:, 0], ids, "right"), pair[:, 1].copy(), weight
            order = np.argsort(pair[:, 1], kind="stable")
            self.items[k] = np.searchsorted(pair[order, 1], np.arange(len(known) + 1)), pair[order, 0]
            pair = np.unique(np.stack([pair[:, 1], size_of[pair[:, 0]]], 1), axis=0)
            self.sizes[k] = np.searchsorted(pair[:, 0], np.arange(len(known) + 1)), pair[:, 1].copy()
            self.known[k], self.filters[k] = known, np.zeros(1 << _FILTER_BITS, bool)
            self.filters[k][(known >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        #: by size: for each block and value of its byte, the items (a bit each) whose byte is within radius // BLOCKS bits
        self.tables = {n: self._table(np.array(members)) for n, members in self.by_size.items()}

    def _table(self, members: np.ndarray) -> np.ndarray:
        own = self.prints[members].view(np.uint8).reshape(-1, BLOCKS)
        values = np.arange(256, dtype=np.uint8)[:, None]
        return np.stack([np.packbits(np.bitwise_count(values ^ own[:, b]) <= self.radius // BLOCKS, axis=1) for b in range(BLOCKS)])

    def near(self, size: int, fingerprint: int) -> np.ndarray:
        """The items of that size within the radius of a fingerprint, looked up by its blocks."""
        blocks = np.array([fingerprint], np.uint64).view(np.uint8)
        found = np.bitwise_or.reduce(self.tables[size][np.arange(BLOCKS), blocks], axis=0)
        items = np.array(self.by_size[size])[np.flatnonzero(np.unpackbits(found, count=len(self.by_size[size])))]
        return items[np.bitwise_count(self.prints[items] ^ np.uint64(fingerprint)) <= self.radius]

    def sharing(self, k: int, gram: np.ndarray, weight: np.ndarray, total: int, need: int) -> np.ndarray:
        """The items that can share shingles of a weight of need with a window.

        gram, weight: the window's known shingles; total: the weight of all its shingles.  An item that shares need
        lacks total - need at most, so it holds one of any shingles that together weigh more.
        """
        first, item = self.items[k]
        order = np.argsort(first[gram + 1] - first[gram], kind="stable")
        spare = total - need - (total - int(weight.sum()))  # what of the known shingles may be missing
        some = gram[order[: int(np.searchsorted(np.cumsum(weight[order]), spare, "right")) + 1]]
        return item[_ranges(first[some], first[some + 1])]

    def similarity(self, k: int, item: int, gram: np.ndarray, weight: np.ndarray, total: int) -> float:
        """Shared weight over mean weight, a shingle weighing as often as it occurs."""
        first, last, grams, weights = self.own[k]
        a, b = int(first[item]), int(last[item])
        _, x, y = np.intersect1d(gram, grams[a:b], assume_unique=True, return_indices=True)
        return 2 * int(np.minimum(weight[x], weights[a:b][y]).sum()) / (total + int(weights[a:b].sum()))

    def matches(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, float, int, int, int]]:
        """(text, item, similarity, first word, words, differing bits): the best window of each text and item."""
        data = FOLD[data]
        starts, ends, first = words(data, off)
        if not len(starts):
            return
        h = word_hashes(data, starts, ends)
        pre = prefix(h, _POWERS)
        best: dict[tuple[int, int], tuple] = {}
        count = np.diff(first)

        def keep(doc: int, n: int, s: int, size: int, window: np.ndarray) -> None:
            """Hold the window of size words from s, given as shingles, against the items of n words."""
            fingerprint, total = int(_simhash(window)), len(window)
            gram, weight = np.unique(window, return_counts=True)
            at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
            there = known[at] == gram
            gram, weight = at[there], weight[there]
            need = int(np.ceil(self.threshold * (total + n - k + 1) / 2 - 1e-9))
            if weight.sum() < max(need, 1):
                return
            for item in np.intersect1d(self.near(n, fingerprint), self.sharing(k, gram, weight, total, need)).tolist():
                value = self.similarity(k, item, gram, weight, total)
                key = (doc, item)
                if value >= self.threshold - 1e-12 and (key not in best or value > best[key][0]):
                    best[key] = (value, s - int(first[doc]), size, (int(self.prints[item]) ^ fingerprint).bit_count())

        for k, known in self.known.items():
            grams = _grams(h, pre, k)
            hit = np.flatnonzero(self.filters[k][(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            at = np.minimum(np.searchsorted(known, grams[hit]), len(known) - 1)
            gram = at[known[at] == grams[hit]]
            hit = hit[known[at] == grams[hit]]
            text = np.searchsorted(first, hit, "right") - 1
            inside = hit + k <= first[text + 1]
            start, size_at = self.sizes[k]
            a, b = start[gram[inside]], start[gram[inside] + 1]
            size_at, where = size_at[_ranges(a, b)], np.repeat(hit[inside], b - a)
            order = np.argsort(size_at, kind="stable")
            size_at, where = size_at[order], where[order]
            edges = np.flatnonzero(np.append(True, size_at[1:] != size_at[:-1])) if len(where) else np.zeros(0, np.int64)
            for x, y in zip(edges.tolist(), np.append(edges[1:], len(where)).tolist()):
                n, hit = int(size_at[x]), where[x:y]
                text = np.searchsorted(first, hit, "right") - 1
                held = np.bincount(text, minlength=len(count))
                m = n - k + 1
                for i in np.flatnonzero((held > 0) & (count >= k) & (count < n) & (held >= self.threshold * (m + count - k + 1) / 2 - 1e-9)).tolist():
                    a0, size = int(first[i]), int(count[i])
                    keep(i, n, a0, size, grams[a0 : a0 + size - k + 1])
                need = max(1, int(np.ceil(self.threshold * m - 1e-9)))
                if len(hit) < need:
                    continue
                a, b = hit[: len(hit) - need + 1], hit[need - 1 :]
                near = (b - a < m) & (text[: len(a)] == text[need - 1 :])
                a, b, t = a[near], b[near], text[: len(near)][near]
                low, high = np.maximum(b - m + 1, first[t]), np.minimum(a, first[t + 1] - n)
                for i in np.flatnonzero(low <= high).tolist():
                    a0 = int(low[i])
                    if i and t[i] == t[i - 1]:
                        a0 = max(a0, int(high[i - 1]) + 1)
                    for s in range(a0, int(high[i]) + 1):
                        keep(int(t[i]), n, s, n, grams[s : s + m])
        for (doc, item), (value, s, n, bits) in sorted(best.items()):
            yield doc, item, value, s, n, bits


class _Sent:
    """A broadcast benchmark, as texts; each worker builds its index once and holds the last one."""

    last: tuple[str, Items] | None = None

    def __init__(self, context, rows: list, threshold: float, radius: int):
        self.name, self.how = uuid.uuid4().hex, (threshold, radius)
        self.rows = context.broadcast(([r.item for r in rows], [r.t for r in rows]))

    def ids(self) -> list:
        return self.rows.value[0]

    def items(self) -> Items:
        if _Sent.last is None or _Sent.last[0] != self.name:
            _Sent.last = self.name, Items(self.rows.value[1], *self.how)
        return _Sent.last[1]


_FOUND = ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("bits", pa.int32())


def _columns(found: list[tuple], ids: list, kind: pa.DataType) -> tuple[pa.Array, list[pa.Array]]:
    """Matches as (places of the texts, columns after them)."""
    doc, item, *rest = zip(*found)
    return pa.array(doc), [pa.array([ids[x] for x in item], kind), *[pa.array(c, t) for c, (_, t) in zip(rest, _FOUND)]]


class _Slices:
    """A benchmark of any size in slices, matched where the slices are: it never passes through the driver."""

    def __init__(self, benchmark: DataFrame, total: int, threshold: float, radius: int, scratch: Scratch):
        self.count, self.how, self.scratch = -(-total // SLICE_BYTES), (threshold, radius), scratch
        sliced = benchmark.withColumn("slice", F.pmod(F.xxhash64("item", "t"), F.lit(self.count)).cast("int"))
        self.items = scratch.write(sliced.repartition(self.count, "slice"), "slices")

    def filters(self, which: list[int]) -> list[tuple[int, dict[int, tuple[int, np.ndarray]]]]:
        """For each slice, by shingle size: the fewest shingles that a document must share with an item, and a bit
        for each of the shingles' hashes.  2 MiB a slice and shingle size come to the driver, in a few slices at a time."""
        threshold = self.how[0]

        def made(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            seen: dict[int, np.ndarray] = {}
            least: dict[int, int] = {}
            for text in rows["t"]:
                data = FOLD[np.frombuffer((text or "").encode(), np.uint8)]
                starts, ends, _ = words(data, np.array([0, len(data)]))
                if not len(starts):
                    continue
                k = min(SHINGLE, len(starts))
                g = _grams(h := word_hashes(data, starts, ends), prefix(h, _POWERS), k)
                seen.setdefault(k, np.zeros(1 << _SLICE_BITS, bool))[(g >> np.uint64(64 - _SLICE_BITS)).astype(np.int64)] = True
                least[k] = min(least.get(k, 1 << 62), max(1, int(np.ceil(threshold * len(g) / 2 - 1e-9))))
            return pd.DataFrame({"slice": [key[0]] * len(seen), "k": list(seen), "least": [least[k] for k in seen], "bits": [np.packbits(b).tobytes() for b in seen.values()]})

        rows = self.items.filter(F.col("slice").isin(which)).groupBy("slice").applyInPandas(made, "slice int, k int, least long, bits binary").collect()
        return [(s, {r.k: (r.least, np.frombuffer(r.bits, np.uint8)) for r in rows if r.slice == s}) for s in which]

    def marked(self, docs: DataFrame, which: list[int]) -> DataFrame:
        """docs (..., t) with slices: those of which an item may be in the text."""
        sent = docs.sparkSession.sparkContext.broadcast(self.filters(which))
        fields = [*docs.schema, T.StructField("slices", T.ArrayType(T.IntegerType()))]
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, data, off in pieces(batches, "t"):
                data = FOLD[data]
                starts, ends, first = words(data, off)
                h = word_hashes(data, starts, ends)
                pre, out = prefix(h, _POWERS), [[] for _ in range(part.num_rows)]
                for k in sorted({k for _, f in sent.value for k in f}):
                    at = (_grams(h, pre, k) >> np.uint64(64 - _SLICE_BITS)).astype(np.int64)
                    last = np.maximum(np.minimum(first[1:], len(at)), np.minimum(first[:-1], len(at)))
                    for s, f in sent.value:
                        if k in f and len(at):
                            hit = f[k][1][at >> 3] >> (7 - (at & 7)) & 1  # shingles over the end of a text only add
                            held = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
                            for i in np.flatnonzero(held[last] - held[np.minimum(first[:-1], len(at))] >= f[k][0]):
                                if s not in out[i]:
                                    out[i].append(s)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.list_(pa.int32()))], names=schema.names)

        return docs.mapInArrow(run, schema)

    def matches(self, docs: DataFrame, item_type: T.DataType) -> DataFrame:
        """(id, t, slice) -> id, item_id, similarity, first_word, n_words, bits."""
        spark, how = docs.sparkSession, self.how
        kind = docs.schema["id"].dataType
        own = docs.select("slice", F.pmod(F.xxhash64("id", "t"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(1).alias("turn"), "t", "id", F.lit(None).cast(item_type).alias("item"))
        copies = self.items.select("slice", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("turn"), "t", F.lit(None).cast(kind).alias("id"), "item")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), SALTS)
        met = copies.unionByName(own).repartition(parts, "slice", "salt").sortWithinPartitions("slice", "salt", "turn")
        schema = T.StructType([T.StructField("id", kind), T.StructField("item_id", item_type), *[T.StructField(n, t) for n, t in zip((n for n, _ in _FOUND), (T.DoubleType(), T.LongType(), T.LongType(), T.IntegerType()))]])
        arrow_item = to_arrow_type(item_type)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group, ids, texts, index = None, [], [], None
            for part, data, off in pieces(batches, "t"):
                tag = np.stack([part.column(i).to_numpy() for i in range(3)], 1)
                edges = np.flatnonzero(np.append(True, (tag[1:] != tag[:-1]).any(1)))
                for a, b in zip(edges.tolist(), np.append(edges[1:], part.num_rows).tolist()):
                    if group != tuple(tag[a, :2]):
                        group, ids, texts, index = tuple(tag[a, :2]), [], [], None
                    rows = part.slice(a, b - a)
                    if tag[a, 2] == 0:  # the slice's items come first
                        ids += rows.column("item").to_pylist()
                        texts += rows.column("t").to_pylist()
                        continue
                    index = index or Items(texts, *how)
                    found = list(index.matches(data[off[a] : off[b]], off[a : b + 1] - off[a]))
                    if found:
                        doc, columns = _columns(found, ids, arrow_item)
                        yield pa.RecordBatch.from_arrays([rows.column("id").take(doc), *columns], names=schema.names)

        return met.mapInArrow(run, schema)

    def scans(self) -> Iterator[list[int]]:
        for i in range(0, self.count, SCAN_SLICES):
            yield list(range(i, min(i + SCAN_SLICES, self.count)))


def _checked(benchmark: DataFrame, item_id: str, item_text: str, threshold: float, radius: int) -> tuple[DataFrame, int]:
    """(item, t) and its bytes of text."""
    if not 0 < threshold <= 1 or not 0 <= radius < 64:
        raise ValueError("threshold must be in (0, 1] and radius in 0..63")
    items = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("t"))
    return items, items.agg(F.sum(F.octet_length("t"))).first()[0] or 0


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """(id, item_id, similarity, first_word, n_words, bits): the best window of each document for each item it holds.

    Words are runs of letters and digits, ASCII letters in lower case.  Similarity is that of five-word shingles;
    an item of fewer words is one shingle, and one without words matches nothing.  A document shorter than the
    item is one window as a whole.  Defined cases: null texts have no words; repeated rows of documents give
    their rows again, repeated items too; null ids are kept as they are; empty tables give no rows.  Of windows of equal
    similarity the first counts.  Other columns are not read, whatever their names.

    Up to SLICE_BYTES of benchmark there is no shuffle; beyond it, documents that share shingles with a slice are
    shuffled to it, and the documents are scanned once for every SCAN_SLICES slices.  A text is worked on whole, in some
    15 bytes of memory for each of its bytes, 60 if its words are single letters.
    """
    spark = docs.sparkSession
    items, total = _checked(benchmark, item_id, item_text, threshold, radius)
    kind, item_type = docs.select(id_col).dtypes[0][1], items.schema["item"].dataType
    schema = f"id {kind}, item_id {item_type.simpleString()}, similarity double, first_word bigint, n_words bigint, bits int"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).filter("t is not null")
    if not total:
        return spark.createDataFrame([], schema)
    if total > SLICE_BYTES:
        slices, out = _Slices(items, total, threshold, radius, Scratch(spark, "decontam")), None
        for which in slices.scans():
            near = slices.marked(rows, which).select("id", "t", F.explode("slices").alias("slice"))
            found = slices.matches(near, item_type)
            out = found if out is None else out.unionByName(found)
        return out
    sent, arrow_item = _Sent(spark.sparkContext, items.collect(), threshold, radius), to_arrow_type(item_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, data, off in pieces(batches, "t"):
            found = list(sent.items().matches(data, off))
            if found:
                doc, columns = _columns(found, sent.ids(), arrow_item)
                yield pa.RecordBatch.from_arrays([piece.column(0).take(doc), *columns], names=["id", "item_id", *[n for n, _ in _FOUND]])

    return rows.mapInArrow(run, schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """The rows of docs that hold no benchmark item, all columns as they are, whatever their names.

    Defined cases: null, empty and wordless texts hold none and stay; repeated rows go or stay together; an empty
    benchmark drops nothing and an empty table gives no rows.  Up to SLICE_BYTES of benchmark this is one pass without a
    shuffle; beyond it, docs are written once for every SCAN_SLICES slices and lose the rows found.  Memory for long
    texts as in find_leaks.
    """
    spark = docs.sparkSession
    items, total = _checked(benchmark, item_id, item_text, threshold, radius)
    if not total:
        return docs
    if total <= SLICE_BYTES:
        sent = _Sent(spark.sparkContext, items.collect(), threshold, radius)

        def mask(part: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> np.ndarray:
            keep = np.ones(len(off) - 1, bool)
            keep[[x[0] for x in sent.items().matches(data, off)]] = False
            return keep

        return keep_rows(docs, text_col, mask)
    scratch, names = Scratch(spark, "decontam"), docs.columns
    plain = [f"c{i}" for i in range(len(names))]
    slices = _Slices(items, total, threshold, radius, scratch)
    rows = docs.toDF(*plain).withColumns({"t": F.col(plain[names.index(text_col)]).cast("string"), "id": F.monotonically_increasing_id()})
    for which in slices.scans():
        rows = scratch.write(slices.marked(rows, which), "marked")  # so that a row keeps its id
        near = rows.select("id", "t", F.explode("slices").alias("slice"))
        gone = slices.matches(near, items.schema["item"].dataType).select("id").distinct()
        rows = rows.join(gone, "id", "left_anti").drop("slices")
    return rows.select(*plain).toDF(*names)
