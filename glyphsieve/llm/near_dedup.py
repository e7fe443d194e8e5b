"""Near-duplicate groups at a similarity of five-word shingles, from SimHash candidates verified exactly.

Copies at a Jaccard similarity of 0.8 differ in 4 to 18 bits of a whole-document SimHash, where no lattice of bit
counts tells them from unrelated texts.  So a document has, besides its own fingerprint (linked within 2 bits by
`simhash.near_links`), SimHashes of BANDS small samples of its shingles: each sample is ROWS min-wise shingles, so
two documents share its fingerprint with probability similarity^ROWS.  Sharing any makes a candidate; candidates
are verified on their whole shingle sets.

Documents with equal shingle sets, by 128 bits, are one node.  Buckets of up to FEW nodes are verified pair by pair.  In larger
ones each node is first held against the bucket's hub, the node that meets most others over all its buckets, which
for a family of edited copies is the text that they were made from.  Where that leaves a bucket in several groups,
the nodes outside its largest group are compared with all of its nodes, in pairs of blocks of bounded size.  So every
candidate is decided, and pairs within the largest group, which are linked already, are never made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import Powers, mix, pieces, prefix, ranged, word_hashes, words
from .components import connected_components
from .simhash import near_links
from .storage import Scratch

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, FEW = 16, 3, 8
#: A crowded bucket is compared in pairs of blocks of about so many nodes and bytes of shingles; shingles at once.
BLOCK, BLOCK_BYTES, COLUMNS = 256, 8 << 20, 2048
_POWERS = Powers(np.uint64(0xA0761D6478BD642F))
_SALTS = np.random.default_rng(5).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
#: A shingle set is told by two sums over its hashes, 128 bits.
_SET_SALTS = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the sorted distinct shingles of text i are hashes[first[i]:first[i + 1]].

    ASCII letters count in lower case; a text of fewer words is one shingle; one without words has none.
    """
    n = len(off) - 1
    starts, ends, first = words(data, off)
    count = np.diff(first)
    h = word_hashes(_LOWER[data], starts, ends)
    pre = prefix(h, _POWERS)
    size = np.minimum(count, SHINGLE)
    many = np.where(count > 0, count - size + 1, 0)
    doc = np.repeat(np.arange(n), many)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + first[doc]
    g = mix(ranged(pre, at, at + size[doc], _POWERS) + size[doc].astype(np.uint64))
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    keep = np.append(True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1]))[: len(g)]
    g, doc = g[keep], doc[keep]
    return g, np.searchsorted(doc, np.arange(n + 1))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, off in pieces(batches, "t"):
        g, first = shingles(data, off)
        n = part.num_rows
        some = np.flatnonzero(np.diff(first))
        fp, keys, bands = np.zeros(n, np.uint64), np.zeros((2, n), np.uint64), np.zeros((n, BANDS), np.uint64)
        if len(some):
            at = first[some]
            for key, salt in zip(keys, _SET_SALTS):
                key[some] = mix(np.add.reduceat(mix(g ^ salt), at) + np.diff(first)[some].astype(np.uint64))
            low = np.stack([np.minimum.reduceat(mix(g * s), at) for s in _SALTS], 1).reshape(-1, BANDS, ROWS)
            x, y, z = low[:, :, 0], low[:, :, 1], low[:, :, 2]
            bands[some] = x & y | y & z | x & z  # the majority of three, bit by bit
            for i, (a, b) in enumerate(zip(first[some].tolist(), first[some + 1].tolist())):
                votes = np.zeros(64, np.int64)
                for c in range(a, b, 1 << 15):
                    votes += np.unpackbits(g[c : min(b, c + (1 << 15))].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint32)
                fp[some[i]] = int.from_bytes(np.packbits(votes * 2 > b - a).tobytes(), "big")
        yield pa.RecordBatch.from_arrays(
            [*(part.column(c) for c in ("id", "k", "l")), *(pa.array(key.view(np.int64)) for key in keys), pa.array(np.diff(first)), pa.array(fp.view(np.int64)), pa.array(list(bands.view(np.int64)), pa.list_(pa.int64()))],
            names=["id", "k", "l", "s1", "s2", "many", "fp", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle set of each text, as sorted hashes."""
    for part, data, off in pieces(batches, "t"):
        g, first = shingles(data, off)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())], names=["node", "grams"])


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2), b.column(3)
            keep = []
            for i in range(b.num_rows):
                p, q = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                small, large = min(len(p), len(q)), max(len(p), len(q))
                if small < similarity * large:
                    keep.append(False)
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= similarity * (len(p) + len(q) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    return run


def _across(similarity: float):
    """Links between groups, from a block of nodes outside the largest group to a block of all nodes: as few as join
    all that similar pairs join.

    A pair is compared in the first bucket that both share, so in one band.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        node, label, out = (t[c].to_numpy(zero_copy_only=False) for c in ("node", "label", "out"))
        left, right = np.flatnonzero(out), np.flatnonzero(~out)
        keys = pa.concat_arrays(t["keys"].chunks).flatten().to_numpy().reshape(len(node), -1)
        open_ = label[left][:, None] != label[right][None, :]
        for band in range(t["band"][0].as_py()):
            open_ &= keys[left, band][:, None] != keys[right, band][None, :]
        a, b = [], []
        if open_.any():
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["grams"]]
            size = np.array([len(x) for x in sets])
            row = np.repeat(np.arange(len(sets)), size)
            _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            row, column = row[times[column] > 1], (np.cumsum(times > 1) - 1)[column[times[column] > 1]]
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            both = np.zeros(open_.shape, np.float32)
            for c in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
                lo, hi = np.searchsorted(column, (c, c + COLUMNS))
                held = np.zeros((len(sets), COLUMNS), np.float32)
                held[row[lo:hi], column[lo:hi] - c] = 1
                both += held[left] @ held[right].T
            both = both.astype(np.int64)
            x, y = np.nonzero(open_ & (both >= similarity * (size[left][:, None] + size[right][None, :] - both)))
            group = {g: g for g in np.unique(label).tolist()}
            for p, q in zip(left[x].tolist(), right[y].tolist()):
                g, h = int(label[p]), int(label[q])
                while group[g] != g:
                    group[g] = g = group[group[g]]
                while group[h] != h:
                    group[h] = h = group[group[h]]
                if g != h:
                    group[g] = h
                    a.append(int(node[p]))
                    b.append(int(node[q]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _keys(id_: Column, t: Column) -> tuple[Column, Column]:
    """128 bits of a row's id and text, which stand for both in joins."""
    parts = (id_.isNull(), id_, t.isNull(), t)
    return F.xxhash64(*parts).alias("k"), F.xxhash64(F.lit(1), *parts).alias("l")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: id, k, l, root, keeper.

    root numbers the group within this run; keeper is true for its document of least id (null ids last, then by k), one per group
    unless rows are equal in id and text.  k and l are hashes of id and text.  Null and empty texts and those without
    words form one group.  An empty table gives no rows.  Other columns are not read.  A text is worked on whole, in
    some 20 bytes of memory for each of its bytes.
    """
    scratch = Scratch(docs.sparkSession, "near")
    kind = docs.select(id_col).dtypes[0][1]
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).select("id", *_keys(F.col("id"), F.col("t")), "t")
    sketch = scratch.write(base.mapInArrow(_sketches, f"id {kind}, k bigint, l bigint, s1 bigint, s2 bigint, many bigint, fp bigint, bands array<bigint>"), "sketch")
    who = F.struct(F.col("id").isNull().alias("none"), "id", "k", "l")
    nodes = sketch.groupBy("s1", "s2").agg(F.min(who).alias("who"), *[F.first(c).alias(c) for c in ("many", "fp", "bands")])
    # a number for each node, its own once it is written
    nodes = scratch.write(nodes.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "who.id", "who.k", "who.l", "many", "fp", "bands"), "nodes")

    # candidates
    buckets = nodes.select("node", F.posexplode(F.concat("bands", F.array("fp"))).alias("band", "value"))
    shared = scratch.write(buckets.groupBy("band", "value").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    members = scratch.write(buckets.join(shared, ["band", "value"]).select("band", "value", "n", "node"), "members")
    few = members.filter(F.col("n") <= FEW)
    left = few.select("band", "value", F.col("node").alias("a"))
    pairs = left.join(few.select("band", "value", F.col("node").alias("b")), ["band", "value"]).filter("a < b").select("a", "b")
    crowd = members.filter(F.col("n") > FEW)
    degree = crowd.groupBy("node").agg(F.sum("n").alias("degree"))
    crowd = scratch.write(crowd.join(degree, "node").select("band", "value", "node", "degree"), "crowd")
    hubs = scratch.write(crowd.groupBy("band", "value").agg(F.max(F.struct("degree", "node")).alias("hub")).select("band", "value", F.col("hub.node").alias("hub")), "hubs")
    spokes = crowd.join(hubs, ["band", "value"]).filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    prints = scratch.write(nodes.groupBy("fp").agg(F.min("node").alias("node")), "prints")
    close = near_links(prints.select("fp"), scratch)
    close = close.join(prints.select(F.col("fp").alias("a"), F.col("node").alias("na")), "a").join(prints.select(F.col("fp").alias("b"), F.col("node").alias("nb")), "b")
    links = pairs.unionByName(spokes).unionByName(close.select(F.col("na").alias("a"), F.col("nb").alias("b")))
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    many = lambda side: nodes.select(F.col("node").alias(side), F.col("many").alias(f"m{side}"))
    able = F.least("ma", "mb") >= similarity * F.greatest("ma", "mb")  # by the numbers of their shingles
    links = scratch.write(links.join(many("a"), "a").join(many("b"), "b").filter(able).select("a", "b"), "links")

    # verification on whole sets; rows equal in id and text are one already before the texts meet those wanted
    asked = links.select(F.explode(F.array("a", "b")).alias("node")).unionByName(crowd.select("node")).distinct()
    wanted = asked.join(nodes.select("node", "k", "l"), "node")
    first = F.row_number().over(Window.partitionBy("k", "l").orderBy("k"))
    one = base.select("k", "l", "t", first.alias("r")).filter("r = 1").select("k", "l", "t")
    found = one.join(wanted, ["k", "l"]).select("node", "t")
    sets = scratch.write(found.mapInArrow(_sets, "node bigint, grams binary").withColumn("size", F.octet_length("grams")), "sets")
    both = links.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    true = scratch.write(both.select("a", "b", "x", "y").mapInArrow(_verified(similarity), "a bigint, b bigint"), "true")
    roots = scratch.write(connected_components(true, scratch), "roots")

    # what the hubs left open in crowded buckets
    label = F.coalesce("root", "node").alias("label")
    labelled = crowd.join(roots, "node", "left").join(sets.select("node", "size"), "node").select("band", "value", "node", label, "size")
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES)).cast("int")
    groups = labelled.groupBy("band", "value", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    most = F.max(F.struct("n", "label", "size")).alias("most")
    parted = groups.groupBy("band", "value").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), most).filter(F.col("n") > F.col("most.n"))
    rest_of = blocks(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size"))
    parted = scratch.write(parted.select("band", "value", F.col("most.label").alias("largest"), blocks(F.col("n"), F.col("size")).alias("blocks"), rest_of.alias("parts")), "parted")
    if parted.head(1):
        rest = labelled.select("band", "value", "node", "label").join(parted, ["band", "value"])
        rest = rest.join(nodes.select("node", F.concat("bands", F.array("fp")).alias("keys")), "node").join(sets.select("node", "grams"), "node")
        place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        columns = ("band", "value", "node", "label", "keys", "grams")
        all_ = rest.select(*columns, F.lit(False).alias("out"), place(F.col("blocks")).alias("i"), every(F.col("parts")).alias("j"))
        out = rest.filter("label <> largest").select(*columns, F.lit(True).alias("out"), every(F.col("blocks")).alias("i"), place(F.col("parts")).alias("j"))
        more = all_.unionByName(out).groupBy("band", "value", "i", "j").applyInArrow(_across(similarity), "a bigint, b bigint")
        joined = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
        roots = scratch.write(connected_components(joined, scratch), "roots")
    scratch.drop(shared, members, crowd, hubs, prints, links, sets, parted)

    rooted = scratch.write(nodes.join(roots, "node", "left").select("s1", "s2", "id", "k", "l", F.coalesce("root", "node").alias("root")), "rooted")
    best = scratch.write(rooted.groupBy("root").agg(F.min(who).alias("w")).select(F.col("root").alias("broot"), F.col("w.k").alias("bk"), F.col("w.l").alias("bl")), "best")
    named = scratch.write(rooted.join(best, F.col("root") == F.col("broot")).select("s1", "s2", "root", "bk", "bl"), "named")
    out = sketch.select("id", "k", "l", "s1", "s2").join(named, ["s1", "s2"])
    out = out.select("id", "k", "l", "root", ((F.col("k") == F.col("bk")) & (F.col("l") == F.col("bl"))).alias("keeper"))
    scratch.drop(nodes, roots, rooted, best)
    return out


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, one for each group; of rows equal in id and text the first by a hash of all columns.

    The texts move once: each task first drops all but one of its rows that are equal in id and text, and the rows
    then lie by the two hashes that the keepers are joined on.
    """
    scratch = Scratch(docs.sparkSession, "keep")
    keepers = near_duplicate_groups(docs, id_col, text_col, similarity).filter("keeper").select(F.col("k").alias("__kk"), F.col("l").alias("__kl")).distinct()
    keepers = scratch.write(keepers, "keepers")
    k, l = _keys(F.col(id_col), F.col(text_col).cast("string"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), k.alias("__k"), l.alias("__l"))
    first = F.row_number().over(Window.partitionBy("__k", "__l").orderBy(F.xxhash64("__row")))
    one = row.withColumn("__n", first).filter("__n = 1")
    kept = one.join(keepers, (F.col("__k") == F.col("__kk")) & (F.col("__l") == F.col("__kl")), "left_semi")
    return kept.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
