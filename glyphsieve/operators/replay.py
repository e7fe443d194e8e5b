"""A stored ledger of findings applied to texts by position: an anti-join of characters, without a row a character.

The ledger's rows meet their text as one sorted list of positions; the text is cut between them in Arrow batches, as
bytes, in time linear in the text however many positions there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .purify import PurifyOptions, normalise

#: Bytes of text cut at once; one longer text is a piece of its own.
PIECE_BYTES = 1 << 22


def cut(texts: pa.Array, positions: pa.Array, codes: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(texts without the characters at their positions, (n, 2) characters taken out and stale positions, a mask of the
    positions used).  positions: sorted code points from 0 for each text, codes: the code point that the finding was
    of, -1 if it isn't known.  A position outside the text or with another character there is stale."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(starts, off)  # the number of each text's first character, and of the one after its last
    size = np.diff(first)
    owner = np.repeat(np.arange(n), np.diff(positions.offsets.to_numpy()))
    at, want = positions.flatten().to_numpy(), codes.flatten().to_numpy()
    inside = (at >= 0) & (at < size[owner])
    char = first[owner] + np.where(inside, at, 0)
    ends = np.append(starts, len(data))
    # the code point of each character pointed at, from its one to four bytes
    found = np.full(len(at), -2, np.int64)
    some = np.flatnonzero(inside)
    if len(some):
        begin, width = starts[char[some]], ends[char[some] + 1] - starts[char[some]]
        value = data[begin].astype(np.int64) & np.array([0, 0x7F, 0x1F, 0x0F, 0x07])[width]
        for k in range(1, 4):
            more = width > k
            value[more] = value[more] << 6 | data[begin[more] + k] & 0x3F
        found[some] = value
    used = inside & ((want < 0) | (want == found))
    gone = np.zeros(len(starts), bool)
    gone[char[used]] = True
    keep = ~np.repeat(gone, np.diff(ends)) if len(starts) else np.zeros(0, bool)
    left = np.concatenate([[0], np.cumsum(keep)])[off]
    out = pa.LargeStringArray.from_buffers(n, pa.py_buffer(left.astype(np.int64).tobytes()), pa.py_buffer(data[keep].tobytes()))
    removed = np.bincount(owner[used], minlength=n)
    return out, np.stack([removed, np.bincount(owner[~used], minlength=n)], 1), used


def replay(df: DataFrame, ledger: DataFrame, keys: list[str], text: str = "text", options: PurifyOptions = PurifyOptions()) -> DataFrame:
    """df with original_length, purified_length, removed_count, removed_by_category, stale_count, purified_text and
    normalization_applied: purify's fields, from the findings of a ledger (keys, position, category, and codepoint if it
    has it) instead of a scan.  Only categories that the options strip are taken out.

    Defined cases: a position that a ledger names more than once counts once, with the first category in order; a null
    position or category, a position outside the text, and one where the text has another code point than the ledger
    says (if that is one) are not applied, and the latter two counted in stale_count; findings of keys that df has not are ignored; rows
    of df with equal keys all get the findings of their key; null keys equal each other; a row without findings keeps its
    text; a null text gives nulls.  The other columns of df stay, whatever their names.  Texts meet the ledger by their
    keys: Spark broadcasts the grouped findings if they are small, and else sorts both sides once.
    """
    col = lambda c: F.col(f"`{c}`")
    told = F.col("codepoint") if "codepoint" in ledger.columns else F.lit(None).cast("string")
    code = F.when(told.rlike("^U[+][0-9A-F]{4,6}$"), F.conv(F.substring(told, 3, 6), 16, 10).cast("long"))
    rows = ledger.select(*[col(c).alias(f"__k{i}") for i, c in enumerate(keys)], F.col("position").cast("long").alias("p"), F.col("category").alias("c"), F.coalesce(code, F.lit(-1)).cast("long").alias("u"))
    rows = rows.filter(F.col("p").isNotNull() & F.col("c").isin(*options.categories)) if options.categories else rows.filter(F.lit(False))
    own = [f"__k{i}" for i in range(len(keys))]
    rows = rows.groupBy(*own, "p").agg(F.min(F.struct("c", "u")).alias("x"))
    rows = rows.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("p", F.col("x.c").alias("c"), F.col("x.u").alias("u")))).alias("__found"))

    names = df.columns
    plain = [f"c{i}" for i in range(len(names))]
    docs = df.toDF(*plain)
    place = dict(zip(names, plain))
    same = [docs[place[k]].eqNullSafe(rows[o]) for k, o in zip(keys, own)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    met = docs.join(rows, on, "left").select(*plain, F.col(place[text]).cast("string").alias("t"), F.coalesce("__found", F.array().cast("array<struct<p:bigint,c:string,u:bigint>>")).alias("f"))
    met = met.select(*plain, "t", F.col("f.p").alias("p"), F.col("f.u").alias("u"), F.col("f.c").alias("k"))
    counted = T.MapType(T.StringType(), T.LongType())
    kept = T.StructType([T.StructField(f.name, f.dataType) for f in met.schema if f.name in plain])
    schema = T.StructType([*kept, T.StructField("purified_text", T.StringType()), T.StructField("removed_count", T.LongType()), T.StructField("stale_count", T.LongType()), T.StructField("kinds", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, n = 0, batch.num_rows
            sizes = np.cumsum(batch.column("t").cast(pa.large_string()).fill_null("").cast(pa.large_binary()).value_lengths().to_numpy()) if n and hasattr(batch.column("t"), "value_lengths") else np.cumsum([len((x or "").encode()) for x in batch.column("t").to_pylist()])
            while i < n:
                before = sizes[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(sizes, before + PIECE_BYTES, "right")))
                part = batch.slice(i, j - i)
                none = part.column("t").is_null()
                out, counts, used = cut(part.column("t").fill_null(""), part.column("p"), part.column("u"))
                kinds = part.column("k")
                where = np.concatenate([[0], np.cumsum(used)])[kinds.offsets.to_numpy() - kinds.offsets[0].as_py()]
                applied = pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), kinds.flatten().filter(pa.array(used)))
                nulls = none.to_numpy(zero_copy_only=False)
                text_ = pa.compute.if_else(none, pa.scalar(None, pa.large_string()), out).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(p) for p in plain], text_, pa.array(counts[:, 0], mask=nulls), pa.array(counts[:, 1], mask=nulls), applied], names=[f.name for f in schema])
                i = j

    out = met.mapInArrow(run, schema)
    order = F.array(*map(F.lit, options.categories)).cast("array<string>")
    by_kind = F.map_from_arrays(order, F.transform(order, lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long")))
    by_kind = F.when(F.col("purified_text").isNotNull(), F.map_filter(by_kind, lambda _, n: n > 0).cast(counted))
    known = F.col("purified_text").isNotNull()
    done = out.select(*plain, "removed_count", by_kind.alias("removed_by_category"), "stale_count", normalise(F.col("purified_text"), options.form).alias("purified_text"))
    return done.select(
        *[F.col(p).alias(c) for p, c in zip(plain, names)],
        F.length(place[text]).cast("long").alias("original_length"),
        F.length("purified_text").cast("long").alias("purified_length"),
        "removed_count", "removed_by_category", "stale_count", "purified_text",
        F.when(known, F.lit(options.form)).alias("normalization_applied"),
    )
