"""Removal of repeated word windows, found by recompression.

1. Every text is parsed by `recompression`.  A symbol whose dependency range lies within a window must recur
   with every other occurrence of that window.  The symbols of all documents meet in one exchange.
2. A window is left as a candidate only if each such symbol inside it occurs more than once (windows that hold
   no such symbol always stay candidates, so long repetitive stretches lose nothing).  The candidates' hashes meet
   in a second exchange, which verifies the repeats: 64 bits from one hash of each word and 32 from another under
   its own key, so that neither a colliding word nor a pattern of words makes different windows equal.
3. The words of the repeated windows go.

Before each exchange a task settles what it can see itself: material that repeats within HELD rows of it is known to
repeat and sends one row of these, however often it occurs.  So a hot passage sends a row for every HELD rows, not for
every document, and these few meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import Powers, pieces, prefix, ranged, word_hashes, words
from .recompression import Parse, parse
from .storage import Scratch

WINDOW = 35
ROUNDS, ACTIVE, RUNS_AT = 7, 6, (0, 4)
#: Rows that a task holds back to settle among themselves, and rows that it sends at once.
HELD, SENT = 1 << 19, 1 << 16

_ONE, _TWO = Powers(np.uint64(0xC2B2AE3D27D4EB4F)), Powers(np.uint64(0x165667B19E3779F9))


def _spans(p: Parse, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol: is any window bound to hold it, and the first and last such window."""
    begin, end = first[p.doc], first[p.doc + 1] - window
    low, high = np.maximum(p.high.astype(np.int64) - window, begin), np.minimum(p.low.astype(np.int64), end)
    return (low <= high) & (p.low >= begin) & (p.high <= first[p.doc + 1]), low, high


def _covered(n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the ranges low..high."""
    return np.cumsum(np.bincount(low, minlength=n + 1) - np.bincount(high + 1, minlength=n + 1)[: n + 1])[:n] > 0


def _window_places(first: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which words begin a whole window of their document."""
    length = np.diff(first)
    fits = length >= window
    out = np.zeros(n + 1, np.int64)
    np.add.at(out, first[:-1][fits], 1)
    np.add.at(out, first[1:][fits] - window + 1, -1)
    return np.cumsum(out)[:n] > 0


def _cut(places: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Sorted (owner, place) pairs as one int32 block for each owner."""
    order = np.lexsort((places, owner))
    owner, places = owner[order], places[order].astype(np.int32)
    at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(owner))
    return owner[at], [places[a:b].tobytes() for a, b in zip(at, ends)]


def _groups(key: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, heads): order sorts the keys, heads marks the first of each group of equals."""
    order = np.argsort(key, kind="stable") if more is None else np.lexsort((more, key))
    k = key[order]
    head = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
    if more is not None and len(k):
        head[1:] |= more[order][1:] != more[order][:-1]
    return order, head


def _settle(key: np.ndarray, more: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of (rows alone in the task, one row of each repeated group, all rows of repeated groups)."""
    order, head = _groups(key, more)
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, len(order)))
    return np.sort(order[at[size == 1]]), order[at[size > 1]], order[np.repeat(size > 1, size)]


def _sliced(columns: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, names=names)
    for a in range(0, whole.num_rows, SENT):
        yield whole.slice(a, SENT)


def _symbol_rows(window: int) -> Callable:
    def flush(held: list, rows: list[list[pa.Array]]) -> Iterator[pa.RecordBatch]:
        """held: (names, row, order in the row, rows with windows that no symbol tells about)."""
        ids = pa.concat_arrays([r[0] for r in rows])
        keys = np.concatenate([r[1].to_numpy() for r in rows])
        name, row, at = (np.concatenate([h[i] for h in held]) for i in range(3))
        alone, lead, known = _settle(name, None)
        owner, blocks = _cut(at[known], row[known])
        silent = np.setdiff1d(np.concatenate([h[3] for h in held]), owner)
        owner, blocks = np.concatenate([owner, silent]), blocks + [b""] * len(silent)
        m, k, s = len(alone), len(lead), len(owner)
        who = np.concatenate([row[alone], np.zeros(k, np.int64), owner])
        yield from _sliced(
            [
                pa.array(np.concatenate([name[alone], name[lead], keys[owner].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)]).view(np.int64)),
                ids.take(pa.array(who)),
                pa.array(keys[who]),
                pa.array(np.concatenate([at[alone], np.full(k + s, -1)]).astype(np.int32)),
                pa.array([None] * (m + k) + blocks, pa.binary()),
            ],
            ["key", "id", "k", "at", "sure"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, n, base = [], [], 0, 0
        for part, data, off in pieces(batches, "t"):
            starts, ends, first = words(data, off)
            p = parse(word_hashes(data, starts, ends), first, ROUNDS, ACTIVE, RUNS_AT)
            useful, low, high = _spans(p, first, window)
            silent = _window_places(first, len(starts), window) & ~_covered(len(starts), low[useful], high[useful])
            silent = np.unique(np.searchsorted(first, np.flatnonzero(silent), "right") - 1)
            lead = np.searchsorted(p.doc, np.arange(part.num_rows))
            doc = p.doc[useful].astype(np.int64)
            held.append((p.name[useful], (doc + base).astype(np.int32), (np.flatnonzero(useful) - lead[doc]).astype(np.int32), silent + base))
            every = pa.array(np.arange(part.num_rows))
            rows.append([part.column(i).take(every) for i in (0, 1)])  # copies, so that the texts can go
            n, base = n + len(doc) + part.num_rows, base + part.num_rows
            if n >= HELD:
                yield from flush(held, rows)
                held, rows, n, base = [], [], 0, 0
        if rows:
            yield from flush(held, rows)

    return run


def _binary_lists(col: pa.Array) -> list[list[bytes]]:
    return [x or [] for x in col.to_pylist()]


def _window_rows(window: int) -> Callable:
    def flush(held: list) -> Iterator[pa.RecordBatch]:
        one, two, rid, at = (np.concatenate([h[i] for h in held]) for i in range(4))
        alone, lead, known = _settle(one, two)
        owner, blocks = _cut(at[known], rid[known])
        m, k, s = len(alone), len(lead), len(owner)
        some = np.concatenate([alone, lead])
        yield from _sliced(
            [
                pa.array(np.concatenate([one[some], owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)]).view(np.int64)),
                pa.array(np.concatenate([two[some], np.zeros(s, np.int32)])),
                pa.array(np.concatenate([rid[alone], np.zeros(k, np.int64), owner])),
                pa.array(np.concatenate([at[alone], np.full(k + s, -1)]).astype(np.int32)),
                pa.array([None] * (m + k) + blocks, pa.binary()),
            ],
            ["one", "two", "rid", "at", "sure"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part, data, off in pieces(batches, "t"):
            starts, ends, first = words(data, off)
            h = word_hashes(data, starts, ends)
            p = parse(h, first, ROUNDS, ACTIVE, RUNS_AT)
            useful, low, high = _spans(p, first, window)
            lead = np.searchsorted(p.doc, np.arange(part.num_rows))
            lists, sure = part.column(part.schema.get_field_index("ats")), _binary_lists(part.column(part.schema.get_field_index("sures")))
            shared = np.zeros(len(p.name), bool)
            shared[lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(lead, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))] = True
            for i, blocks in enumerate(sure):
                for x in blocks:
                    shared[np.frombuffer(x, np.int32) + lead[i]] = True
            out = useful & ~shared
            at = np.flatnonzero(_window_places(first, len(starts), window) & ~_covered(len(starts), low[out], high[out]))
            one = ranged(prefix(h, _ONE), at, at + window, _ONE)
            other = word_hashes(data, starts, ends, 1)
            two = (ranged(prefix(other, _TWO), at, at + window, _TWO) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            doc = np.searchsorted(first, at, "right") - 1
            held.append((one, two, part.column(0).to_numpy()[doc], (at - first[doc]).astype(np.int32)))
            n += len(at)
            if n >= HELD:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    return run


def _removal(window: int, carry: tuple[str, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in pieces(batches, "t"):
            raw, names = data.tobytes(), part.schema.names
            text = part.column(names.index("t"))
            alone, sure = part.column(names.index("ats")).to_pylist(), _binary_lists(part.column(names.index("sures")))
            n, gone, kept, spans = [], [], [], []
            for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                w = raw[a:b].split()
                n.append(len(w))
                if not alone[i] and not sure[i]:
                    gone.append(0)
                    kept.append((raw[a:b] if text[i].is_valid else None) if carry else b" ".join(w))
                    spans.append([])
                    continue
                at = np.concatenate([np.array(alone[i] or [], np.int64), *[np.frombuffer(x, np.int32) for x in sure[i]]]).astype(np.int64)
                cover = _covered(len(w), at, at + window - 1)
                gone.append(int(cover.sum()))
                kept.append(b" ".join(compress(w, (~cover).tolist())))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], cover.view(np.int8), [0]])))
                spans.append([{"first": x, "last": y} for x, y in zip(edge[::2].tolist(), (edge[1::2] - 1).tolist())])
            span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            own = [names.index(x) for x in ("id", "k", *carry)]
            yield pa.RecordBatch.from_arrays(
                [*map(part.column, own), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, span)],
                names=["id", "k", *carry, "n_words", "n_removed", "kept", "spans"],
            )

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, row: bool = False) -> DataFrame:
    """One row per input row: id, k, n_words, n_removed, kept, spans, and with row=True the input row without its text as `row`.

    Removes each word covered by a window of that many consecutive words whose word sequence also starts
    anywhere else in the corpus, the same document included; windows are judged on the input.  kept joins the
    other words by one space; spans lists the removed word ranges; k is a hash of id and text.
    Defined cases: a null text has no words (kept is empty), texts shorter than the window lose nothing,
    overlapping repeats of one stretch count as repeats, rows equal in id and text repeat each other and each
    get a row, null ids are ordinary values, an empty table gives no rows.  Other columns are only carried.
    With row=True a text that loses nothing is kept as it is, spacing and null included.  A text is worked on whole,
    in some 25 bytes of memory for each of its bytes, 100 if its words are single letters.
    """
    if window < 2:
        raise ValueError("window must be 2 words at least")
    scratch = Scratch(docs.sparkSession, "substrings")
    kind = docs.select(id_col).dtypes[0][1]
    # the text travels as t; of the row only the rest is carried
    carry = (F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"),) if row else ()
    names = ("row",) if row else ()
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col).cast("string")).alias("k"), F.col(text_col).cast("string").alias("t"), *carry)
    symbols = base.select("id", "k", "t").mapInArrow(_symbol_rows(window), f"key bigint, id {kind}, k bigint, at int, sure binary")
    symbols = symbols.withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("sure is not null or (n > 1 and at >= 0)")
    found = symbols.groupBy("id", "k").agg(F.collect_list(F.expr("if(at >= 0, at, null)")).alias("ats"), F.collect_list("sure").alias("sures"))
    found = scratch.write(found.select(F.monotonically_increasing_id().alias("rid"), "id", "k", "ats", "sures"), "found")
    two = found.withColumnsRenamed({"id": "id2", "k": "k2"})
    joined = base.join(two, (base["k"] == two["k2"]) & base["id"].eqNullSafe(two["id2"]))
    # the carried row goes along here too, so that both joins read one exchange of the texts
    windows = joined.select("rid", "t", "ats", "sures", *names).mapInArrow(_window_rows(window), "one bigint, two int, rid bigint, at int, sure binary")
    windows = windows.withColumn("n", F.count("*").over(Window.partitionBy("one", "two"))).filter("sure is not null or (n > 1 and at >= 0)")
    cuts = windows.groupBy("rid").agg(F.collect_list(F.expr("if(at >= 0, at, null)")).alias("ats"), F.collect_list("sure").alias("sures"))
    cuts = found.select("rid", F.col("id").alias("id2"), F.col("k").alias("k2")).join(cuts, "rid")
    whole = base.join(cuts, (base["k"] == cuts["k2"]) & base["id"].eqNullSafe(cuts["id2"]), "left").select("id", "k", "t", "ats", "sures", *names)
    carried = f"row {base.schema['row'].dataType.simpleString()}, " if row else ""
    return whole.mapInArrow(_removal(window, names), f"id {kind}, k bigint, {carried}n_words bigint, n_removed bigint, kept string, spans array<struct<first:bigint,last:bigint>>")


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", window: int = WINDOW) -> DataFrame:
    """docs without their repeated windows: texts that lose words become the others joined by one space, texts
    that lose none stay as they are, and a text that loses every word goes with its row.

    Defined cases: null, empty and wordless texts stay; repeated rows repeat each other, so their windows go from all
    of them; null ids are ordinary values; chars_col, if there is one, is made to fit the new text (null for a null
    text); an empty table gives no rows; all columns come back, whatever their names.  Memory for long texts as in
    dedup_substrings."""
    out = dedup_substrings(docs, id_col, text_col, window, row=True)
    out = out.filter("n_removed < n_words or n_words = 0")
    column = lambda c: F.col("row").getField(c)
    text = F.col("kept")
    return out.select(*[(text if c == text_col else F.length(text).cast(docs.schema[c].dataType) if c == chars_col else column(c)).alias(c) for c in docs.columns])
