"""Centroid clustering (Lloyd's rounds) over integer vectors, filtered by ball trees.

Vectors are packed into blocks within their partitions, without a shuffle, and each block gets a metric tree once:
every node holds its ball's radius, count and integer sum, and the vectors lie in the order of the leaves.  A round
walks the trees from their roots.  By the triangle inequality, a centroid is out for a whole ball if it is further from
the ball's centre than the nearest centroid by more than twice the radius; a ball with one centroid left is assigned
by its count and sum, without a look at its vectors, and any other descends, to exact integer distances in the leaves.
Bounds are in double precision with a margin far above its error, so they only ever send a ball further down; what
decides is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import Scratch

#: Vectors of a block, and of a leaf at most (more only if they are all equal).
BLOCK, LEAF = 4096, 32
#: Components up to this size have exact squared distances of 64 dimensions in 64 bits; larger ones are an error.
LARGEST = 1 << 27
#: Up to here the products below are exact in double precision too, where they are faster.
_DOUBLE = 1 << 22


def quantise(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as integers."""
    q = np.floor(x.astype(np.float64) * scale)
    if q.size and np.abs(q).max() > LARGEST:
        raise OverflowError(f"a component times {scale} exceeds {LARGEST}; its squared distances don't fit in 64 bits")
    return q.astype(np.int64)


class Tree:
    """order: the vectors' places by leaf; first, last: each node's range in it; child: its left child (the right one
    follows), -1 in leaves; radius and sums by node."""

    def __init__(self, q: np.ndarray):
        self.order = np.arange(len(q))
        first, last, child, radius, sums = [0], [len(q)], [-1], [], []
        i = 0
        while i < len(first):
            own = self.order[first[i] : last[i]]
            x = q[own]
            sums.append(x.sum(0))
            away = ((x - sums[i] / len(x)) ** 2).sum(1)
            radius.append(float(np.sqrt(away.max())))
            if len(x) > LEAF and (x != x[0]).any():
                # split at the median along the line between two vectors far from each other
                one = x[away.argmax()]
                two = x[((x - one).astype(np.float64) ** 2).sum(1).argmax()]
                by = np.argsort((x @ (two - one)).astype(np.float64), kind="stable")
                self.order[first[i] : last[i]] = own[by]
                middle = first[i] + len(x) // 2
                child[i] = len(first)
                first += [first[i], middle]
                last += [middle, last[i]]
                child += [-1, -1]
            i += 1
        self.first, self.last, self.child = (np.array(a, np.int32) for a in (first, last, child))
        self.radius, self.sums = np.array(radius), np.array(sums, np.int64)


_NODES = (("first", np.int32), ("last", np.int32), ("child", np.int32), ("radius", np.float64), ("sums", np.int64))


def blocks(kept: DataFrame, scale: int, dims: int) -> DataFrame:
    """(id, v) -> a row for each block: ids and points in the order of the leaves, and the nodes of its tree."""
    kind = kept.schema["id"].dataType
    fields = [("ids", T.ArrayType(kind)), ("narrow", T.BooleanType()), ("points", T.BinaryType()), *[(name, T.BinaryType()) for name, _ in _NODES]]
    schema = T.StructType([T.StructField(name, t) for name, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                q = quantise(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), scale)
                tree = Tree(q)
                narrow = bool(np.abs(q).max() < 1 << 15)
                ids = part.column(0).take(pa.array(tree.order))
                row = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([narrow]), pa.array([q[tree.order].astype(np.int16 if narrow else np.int32).tobytes()], pa.binary())]
                row += [pa.array([getattr(tree, name).astype(t).tobytes()], pa.binary()) for name, t in _NODES]
                yield pa.RecordBatch.from_arrays(row, names=schema.names)

    return kept.mapInArrow(run, schema)


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors to all centres."""
    if max(np.abs(x).max(initial=0), np.abs(centres).max(initial=0)) <= _DOUBLE:
        x, centres = x.astype(np.float64), centres.astype(np.float64)
    return ((x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1)).astype(np.int64)


class Block:
    """A block read back, and its assignment to some centres."""

    def __init__(self, row: dict, dims: int):
        for name, t in _NODES:
            setattr(self, name, np.frombuffer(row[name], t))
        self.sums = self.sums.reshape(-1, dims)
        self.points = np.frombuffer(row["points"], np.int16 if row["narrow"] else np.int32).reshape(-1, dims)

    def settle(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nodes, their cluster, open): whole balls with the cluster of each, and the leaves that none of them covers."""
        _, where = np.unique(centres, axis=0, return_index=True)
        at, maybe = np.zeros(1, np.int64), np.zeros((1, len(centres)), bool)
        maybe[:, where] = True  # of equal centres only the first can win
        nodes, clusters, leaves = [], [], []
        while len(at):
            mean = self.sums[at] / (self.last[at] - self.first[at])[:, None]
            away = np.sqrt(((mean[:, None, :] - centres[None]) ** 2).sum(2))
            away[~maybe] = np.inf
            best, r = away.argmin(1), self.radius[at]
            reach = away[np.arange(len(at)), best] + 2 * r
            maybe &= away <= (reach * (1 + 1e-9) + 1e-6)[:, None]
            whole = maybe.sum(1) == 1
            nodes.append(at[whole])
            clusters.append(best[whole])
            child = self.child[at]
            leaves.append(at[~whole & (child < 0)])
            down = ~whole & (child >= 0)
            at, maybe = np.concatenate([child[down], child[down] + 1]).astype(np.int64), np.concatenate([maybe[down], maybe[down]])
        return np.concatenate(nodes), np.concatenate(clusters), np.concatenate(leaves)

    def _within(self, nodes: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *[np.arange(a, b) for a, b in zip(self.first[nodes], self.last[nodes])]])

    def totals(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, sums) by cluster."""
        nodes, clusters, leaves = self.settle(centres)
        counts, sums = np.zeros(len(centres), np.int64), np.zeros(centres.shape, np.int64)
        np.add.at(counts, clusters, self.last[nodes] - self.first[nodes])
        np.add.at(sums, clusters, self.sums[nodes])
        x = self.points[self._within(leaves)].astype(np.int64)
        near = squared(x, centres).argmin(1)
        for c in np.unique(near):
            counts[c] += (near == c).sum()
            sums[c] += x[near == c].sum(0)
        return counts, sums

    def labels(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of each vector, in the block's order."""
        nodes, clusters, leaves = self.settle(centres)
        out = np.zeros(len(self.points), np.int64)
        for n, c in zip(nodes, clusters):
            out[self.first[n] : self.last[n]] = c
        open_ = self._within(leaves)
        out[open_] = squared(self.points[open_].astype(np.int64), centres).argmin(1)
        away = self.points.astype(np.int64) - centres[out]
        return out, (away * away).sum(1)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.Array | None]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names if name != "ids"}
            yield row, batch.column("ids")[i].values if "ids" in batch.schema.names else None


def moved(packed: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centres after one round: each that has vectors becomes the floor of their mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centres), np.int64), np.zeros(centres.shape, np.int64)
        for row, _ in _rows(batches):
            n, s = Block(row, centres.shape[1]).totals(centres)
            counts += n
            sums += s
        told = np.concatenate([counts[:, None], sums], 1)[counts > 0]
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(counts).astype(np.int32)), pa.array(list(told), pa.list_(pa.int64()))], names=["cluster", "total"])

    by_task = packed.drop("ids").mapInArrow(run, "cluster int, total array<bigint>")
    total = by_task.select("cluster", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    found: dict[int, dict[int, int]] = {}
    for c, i, x in total.collect():  # a number for each centroid and dimension
        found.setdefault(c, {})[i] = int(x)
    out = centres.copy()
    for c, x in found.items():
        out[c] = [x[i + 1] // x[0] for i in range(centres.shape[1])]
    return out


def assigned(packed: DataFrame, centres: np.ndarray) -> DataFrame:
    """id, cluster, distance (squared) of every vector."""
    kind = packed.schema["ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids in _rows(batches):
            label, away = Block(row, centres.shape[1]).labels(centres)
            yield pa.RecordBatch.from_arrays([ids, pa.array(label.astype(np.int32)), pa.array(away)], names=["id", "cluster", "distance"])

    return packed.mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """One row per vector of exactly dims components, none null or not finite: id, cluster, distance (squared),
    cluster_inertia, inertia (distances summed over the cluster and over all) and centroid, the cluster's final one.

    A component x counts as floor(scale * x).  The centroids start as the k vectors whose ids have the smallest SHA-256
    of `<seed>:<id>`; each round assigns all vectors (ties to the smaller number) and moves every centroid that has
    any to the floor of their mean.

    Defined cases: other vectors, null ones among them, give no row; a null id is clustered like any other but comes
    last among the starting vectors; repeated rows each count and get a row; among repeated ids the smaller vector
    starts first; fewer than k vectors give fewer centroids; an empty table gives no rows.  A component beyond
    LARGEST / scale raises, as its distances would not fit in a long.  Columns other than these two are not read,
    whatever their names.  A task holds one block at a time; to the driver come k x (dims + 1) sums a round.
    """
    scratch = Scratch(df.sparkSession, "balltree")
    v = F.col(f"`{vec_col}`")
    if df.select(v).schema[0].dataType.elementType not in (T.FloatType(), T.DoubleType()):
        v = v.cast("array<double>")
    kept = df.select(F.col(f"`{id_col}`").alias("id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = kept.filter(F.col("v").isNotNull() & (F.size("v") == dims)).filter(finite)
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.orderBy(named.asc_nulls_last(), "v").limit(k).collect()
    packed = scratch.write(blocks(kept, scale, dims), "blocks")
    centres = quantise(np.array([r["v"] for r in first], np.float64).reshape(-1, dims), scale)
    for _ in range(rounds):
        before, centres = centres, moved(packed, centres) if len(centres) else centres
        if (before == centres).all():
            break  # every further round would give the same
    out = scratch.write(assigned(packed, centres), "assigned")
    scratch.drop(packed)
    sums = dict(out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long")).collect())
    by_cluster = F.array(*[F.lit(sums.get(c, 0)).cast("long") for c in range(len(centres))]).cast("array<bigint>")
    at = F.array(*[F.array(*[F.lit(int(x)).cast("long") for x in c]) for c in centres]).cast("array<array<bigint>>")
    return out.select("id", "cluster", "distance", F.get(by_cluster, F.col("cluster")).alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), F.get(at, F.col("cluster")).alias("centroid"))
