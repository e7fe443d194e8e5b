"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is embedded as the bit counts of its 16 four-bit segments.  One differing bit moves one
count by one, so the Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints.  Two lattice points at Manhattan distance 2 or less have a lattice point within 1 of both: each
distinct fingerprint is filed under the 1 + 2 * 16 points within 1 of its own (the grid range-join), and
fingerprints that share a point are compared exactly.  Crowded points take an exact route without pairs: their
fingerprints are filed under the 65 words within one bit; sharing one means a distance of 2 or less, and two
fingerprints that close always share one.  So no cell is capped and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import pieces
from .components import connected_components
from .storage import Scratch

SEED = 42
SEGMENTS = 16
#: Points with more fingerprints than this are verified by shared one-bit neighbours, not by pairs.
CROWD = 48
#: Links join fingerprints that differ in at most this many bits; the geometry above is that of 2.
RADIUS = 2


def fingerprint(text: bytes, size: int = 3) -> int:
    """The SimHash of one UTF-8 text: majority vote of the XXH64 bits of its word shingles, 0 without words."""
    w = text.lower().split()  # bytes: only A-Z, and only the six ASCII separators
    if not w:
        return 0
    if len(w) <= size:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    h = np.fromiter(map(_xxh, map(b" ".join, zip(*(w[i:] for i in range(size))))), np.uint64, len(w) - size + 1)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        votes += np.unpackbits(h[i : i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(votes * 2 > len(h)).tobytes(), "big")


def _xxh(shingle: bytes) -> int:
    return xxhash.xxh64_intdigest(shingle, SEED)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp): fp the signed 64 bits of the fingerprint; a null text has no words and so 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in pieces(batches, "t"):
            raw = data.tobytes()
            fp = np.array([fingerprint(raw[a:b], size) for a, b in zip(off[:-1].tolist(), off[1:].tolist())], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    kind = docs.select(id_col).dtypes[0][1]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, fp bigint")


def _own_point() -> F.Column:
    """Four bits a segment, each holding its bit count plus 1, so that 0 to 6 leave room for steps down and up."""
    own = F.lit(0).cast("long")
    for k in range(SEGMENTS):
        count = F.bit_count(F.shiftrightunsigned("fp", 4 * k).bitwiseAND(F.lit(15).cast("long")))
        own = own.bitwiseOR(F.shiftleft((count + 1).cast("long"), 4 * k))
    return own


def _points_around() -> F.Column:
    """own and its neighbours one step away; sums never carry, as each segment stays within four bits."""
    steps = F.array(*[F.lit(1 << 4 * k).cast("long") for k in range(SEGMENTS)])
    return F.concat(F.array("own"), F.transform(steps, lambda u: F.col("own") + u), F.transform(steps, lambda u: F.col("own") - u))


def near_links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct fp -> edges (a, b) between fingerprints at RADIUS or fewer bits that connect all those linked so."""
    filed = fps.select("fp", _own_point().alias("own")).select("fp", F.explode(_points_around()).alias("point"))
    shared = scratch.write(filed.groupBy("point").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    members = scratch.write(filed.join(shared, "point").select("point", "fp", "n"), "members")
    some = members.filter(F.col("n") <= CROWD)
    left, right = some.select(F.col("point").alias("p"), F.col("fp").alias("a")), some.select(F.col("point").alias("q"), F.col("fp").alias("b"))
    pairs = left.join(right, (F.col("p") == F.col("q")) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS))
    bits = F.array(F.lit(0).cast("long"), *[F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long") for k in range(64)])
    crowd = members.filter(F.col("n") > CROWD).select("fp").distinct()
    beside = scratch.write(crowd.select("fp", F.explode(F.transform(bits, lambda u: F.col("fp").bitwiseXOR(u))).alias("w")), "beside")
    least = scratch.write(beside.groupBy("w").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1").select("w", "b"), "least")
    out = scratch.write(pairs.select("a", "b").unionByName(beside.join(least, "w").filter("fp <> b").select(F.col("fp").alias("a"), "b")).distinct(), "links")
    scratch.drop(shared, members, beside, least)
    return out


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """One row per input row: id, fp, component_id.

    component_id is the least id among all documents reachable over links of RADIUS or fewer differing bits,
    the document itself included.  Defined cases: a null or empty text and one without words has fingerprint 0
    and links like any other; fewer words than size make one shingle; repeated rows each get a row; a row with
    a null id takes part and gets the least non-null id of its component, or null; an empty table gives no
    rows.  Other columns, whatever their names, are not read.  A text is worked on whole, in some 12 bytes of memory
    for each of its bytes.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.write(fingerprints(docs, id_col, text_col, size), "fps")
    nodes = scratch.write(fps.groupBy("fp").agg(F.min("id").alias("rep")), "nodes")
    links = near_links(nodes.select("fp"), scratch)
    roots = connected_components(links, scratch).select(F.col("node").alias("fp"), "root")
    rooted = scratch.write(nodes.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "rooted")
    least = scratch.write(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    named = scratch.write(rooted.join(least, "root").select("fp", "component_id"), "named")
    scratch.drop(links, nodes, rooted, least)
    return fps.join(named, "fp", "left").select("id", "fp", "component_id")
