"""Nearest neighbours by inner product: a forest of random-projection trees searched through one priority queue.

Vectors get one more component so that the largest inner product becomes the least distance; each tree halves
its rows at the median of a projection onto the difference of two random rows.  A query keeps one queue for all
trees, ordered by the squared distance that its path has crossed so far, and visits leaves until it has seen a
budget of rows; the budget is the least that reaches the target recall on a bounded sample of queries held
against an exact pass.  The candidates of a leaf are ranked exactly, in blocks.

Equal vectors are one entry of the index with its least ids (more could never be among the k nearest, as ties
go to the smaller id), so a vector that a third of all rows share is one candidate and one query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch

#: The trees are fitted on at most so many vectors and bytes, drawn by a hash; every vector is indexed.
SAMPLE_VECTORS, SAMPLE_BYTES = 65_536, 64 << 20
#: Queries that the search effort is set by.
SAMPLE_QUERIES = 96
TREES = 4
LEAF_ROWS = 256
TARGET_RECALL = 0.97
#: Queries that a cell holds at once; one that more queries visit is split by query and its vectors repeated.
CELL_QUERIES = 65_536
#: Vectors and queries ranked at once, pairs multiplied at once, and rows held before they are cut to the best of each query.
BLOCK, QUERIES, PAIRS, HELD = 2048, 512, 1 << 15, 400_000
#: Queries whose floors a task remembers.
FLOORS = 500_000


def _matrix(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """(row numbers, vectors) of usable vectors: not null, finite throughout and not zero; -0 counts as 0."""
    col = batch.column(batch.schema.get_field_index(name))
    size = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten()  # without the values of null rows
    v = flat.to_numpy(zero_copy_only=False)
    off = np.concatenate([[0], np.cumsum(size)])
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(v))])  # a null reads as not a number
    some = np.concatenate([[0], np.cumsum(v != 0)])
    rows = np.flatnonzero((odd[off[1:]] == odd[off[:-1]]) & (some[off[1:]] > some[off[:-1]]))
    v = v + v.dtype.type(0)
    return rows, [v[a:b] for a, b in zip(off[rows].tolist(), off[rows + 1].tolist())]


def _keys(v: np.ndarray) -> tuple[int, int]:
    raw = v.tobytes()
    both = xxhash.xxh3_128_digest(raw)
    return int.from_bytes(both[:8], "big", signed=True), int.from_bytes(both[8:], "big", signed=True)


def _unique_rows(k: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 20_000):
                batch = whole.slice(a, 20_000)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                found: dict[tuple[int, int], list] = {}
                for i, v in zip(*_matrix(batch, "v")):
                    entry = found.setdefault(_keys(v), [v, []])
                    entry[1].append(int(ids[i]))
                rows = [(a, b, len(v), v.tobytes(), sorted(set(x))[: k + 1], any(i % every == 0 for i in x)) for (a, b), (v, x) in found.items()]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["h1", "h2", "dim", "vec", "ids", "asks"])

    return run


class Forest:
    """Trees as arrays: node n has the children 2n and 2n + 1; the leaves of depth d are 2^d to 2^(d+1) - 1."""

    def __init__(self, sample: np.ndarray, depth: int, top: float, trees: int = TREES, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.depth, self.top = depth, max(top, float(np.sqrt((sample**2).sum(1).max(initial=0))))
        a = self.lift(sample)
        self.normal = np.zeros((trees, 1 << depth, a.shape[1]))
        self.cut = np.zeros((trees, 1 << depth))
        for t in range(trees):
            node = np.ones(len(a), np.int64)
            for level in range(depth):
                for n in range(1 << level, 2 << level):
                    rows = np.flatnonzero(node == n)
                    if len(rows) < 2:
                        continue
                    x, y = a[rng.choice(rows, 2, replace=False)]
                    length = np.linalg.norm(x - y)
                    self.normal[t, n] = (x - y) / length if length else 0
                    along = a[rows] @ self.normal[t, n]
                    self.cut[t, n] = np.median(along)
                    node[rows] = 2 * n + (along > self.cut[t, n])

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(0, self.top**2 - (x**2).sum(1)))[:, None]])

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        a, out = self.lift(x), np.ones((len(x), len(self.normal)), np.int64)
        for t in range(len(self.normal)):
            for _ in range(self.depth):
                n = out[:, t]
                out[:, t] = 2 * n + (np.einsum("ij,ij->i", a, self.normal[t, n]) > self.cut[t, n])
        return out

    def visits(self, q: np.ndarray) -> Iterator[tuple[int, int]]:
        """The leaves in the order of the shared queue."""
        d = len(q)
        margin = (self.normal[:, :, :d] @ q - self.cut).tolist()
        queue, leaves = [(0.0, t, 1) for t in range(len(self.normal))], 1 << self.depth
        while queue:
            far, t, n = heapq.heappop(queue)
            if n >= leaves:
                yield t, n
                continue
            m = margin[t][n]
            heapq.heappush(queue, (far + min(m, 0.0) ** 2, t, 2 * n + 1))
            heapq.heappush(queue, (far + max(m, 0.0) ** 2, t, 2 * n))


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, summed from left to right."""
    return np.add.accumulate(q.astype(np.float64) * x.astype(np.float64), axis=1)[:, -1]


def _best(group: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best of each group, by score and then the smaller tie."""
    order = np.lexsort((tie, -score, group))
    g = group[order]
    head = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(g)))
    return order[np.arange(len(g)) - np.repeat(head, size) < k]


def _rank_block(q: np.ndarray, x: np.ndarray, k: int, tie: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of the k best vectors for each query in a block, ties to the smaller tie.

    Pairs below a query's floor, a score that k vectors are known to reach, are left out.  Products of matrices find
    the pairs worth an exact product, rounding allowed for; those are worked out a bounded number at a time.
    """
    row, col, score = [], [], []
    width = np.sqrt((x**2).sum(1).max(initial=0)) * 1e-12
    for a in range(0, len(q), QUERIES):
        some = q[a : a + QUERIES]
        s, low = some @ x.T, floor[a : a + QUERIES].copy()
        slack = np.sqrt((some**2).sum(1)) * width
        if k < len(x):
            crowded = np.flatnonzero((s >= (low - slack)[:, None]).sum(1) > k)
            low[crowded] = np.maximum(low[crowded], np.partition(s[crowded], len(x) - k, axis=1)[:, len(x) - k])
        r, c = np.nonzero(s >= (low - slack)[:, None])
        e = np.zeros(len(r))
        for b in range(0, len(r), PAIRS):
            e[b : b + PAIRS] = exact_products(some[r[b : b + PAIRS]], x[c[b : b + PAIRS]])
        keep = _best(r, e, tie[c], k)
        row.append(r[keep] + a)
        col.append(c[keep])
        score.append(e[keep])
    return np.concatenate(row), np.concatenate(col), np.concatenate(score)


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, every: int = 20, target: float = TARGET_RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row whose id is divisible by `every`.

    Defined cases: vectors that are null, empty, zero or hold null or non-finite components, rows with a null id
    and vectors of another length than the most frequent one take no part, neither as queries nor as candidates;
    a candidate with the query's own id is never returned; rows equal in id and vector count once; fewer than k
    candidates give as many rows; an empty table gives none.  Other columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "ann")
    kind = np.float64 if "double" in df.select(vec_col).dtypes[0][1] else np.float32
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).filter("id is not null and v is not null")
    unique = base.mapInArrow(_unique_rows(k, every), "h1 bigint, h2 bigint, dim bigint, vec binary, ids array<bigint>, asks boolean")
    unique = unique.groupBy("h1", "h2").agg(F.first("dim").alias("dim"), F.first("vec").alias("vec"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"), F.max("asks").alias("asks"))
    unique = held_unique = scratch.write(unique, "unique")
    out_type = "query_id bigint, rank int, vec_id bigint, score double"
    most = unique.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if most is None:
        return spark.createDataFrame([], out_type)
    dim, n = most["dim"], most["count"]
    unique = unique.filter(F.col("dim") == dim)

    def vectors(batch: pa.RecordBatch) -> np.ndarray:
        col = batch.column(batch.schema.get_field_index("vec"))
        return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(-1, dim).astype(np.float64)

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = max((float((vectors(b) ** 2).sum(1).max()) for b in batches if b.num_rows), default=0.0)
        yield pa.RecordBatch.from_arrays([pa.array([top])], names=["top"])

    top = float(np.sqrt(unique.select("vec").mapInArrow(norms, "top double").agg(F.max("top")).first()[0]))

    def drawn(rows: DataFrame, count: int, most: int) -> np.ndarray:
        """About most of the rows, and no more, by a hash of the vector; nearly as many reach the driver."""
        rows = rows.select("vec", F.xxhash64("h1", "h2").alias("o"))
        if count > most:
            rows = rows.filter(F.col("o") < int((2 * most / count - 1) * 2**63))
        rows = sorted(((r.o, bytes(r.vec)) for r in rows.collect()), key=lambda r: r[0])[:most]
        return np.frombuffer(b"".join(r[1] for r in rows), kind).reshape(-1, dim).astype(np.float64)

    sample = drawn(unique, n, max(16, min(SAMPLE_VECTORS, SAMPLE_BYTES // (8 * dim))))
    depth = max(0, min(int(np.log2(max(1, n / LEAF_ROWS))), int(np.log2(max(1, len(sample) / 16)))))
    forest = spark.sparkContext.broadcast(Forest(sample, depth, top))  # at most TREES x SAMPLE_VECTORS / 16 nodes
    asking = unique.filter("asks").count()
    tried = drawn(unique.filter("asks"), asking, SAMPLE_QUERIES)
    if not len(tried):
        return spark.createDataFrame([], out_type)
    asked = spark.sparkContext.broadcast(tried)

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, BLOCK):
                b = whole.slice(a, BLOCK)
                leaves = forest.value.route(vectors(b))
                yield pa.RecordBatch.from_arrays([pa.array(list(leaves), pa.list_(pa.int64())), b.column(b.schema.get_field_index("vec")), b.column(b.schema.get_field_index("ids"))], names=["leaves", "vec", "ids"])

    index = scratch.write(unique.select("vec", "ids").mapInArrow(filed, "leaves array<bigint>, vec binary, ids array<bigint>"), "index")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sizes of leaves, and the nearest rows of the sampled queries with their leaves."""
        sizes = np.zeros((TREES, 2 << depth), np.int64)
        q, best = asked.value, None
        for whole in batches:
            for a in range(0, whole.num_rows, BLOCK):
                b = whole.slice(a, BLOCK)
                leaves = np.array(b.column(0).to_pylist(), np.int64)
                for t in range(TREES):
                    sizes[t] += np.bincount(leaves[:, t], minlength=2 << depth)
                row, col, score = _rank_block(q, vectors(b), k + 1, np.zeros(b.num_rows), np.full(len(q), -np.inf))
                new = (row, score, leaves[col])
                best = new if best is None else tuple(np.concatenate(x) for x in zip(best, new))
                keep = _best(best[0], best[1], np.zeros(len(best[0])), k + 1)
                best = tuple(x[keep] for x in best)
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array([sizes.tobytes()], pa.binary()), pa.array([None], pa.int64()), pa.array([None], pa.float64()), pa.array([None], pa.list_(pa.int64()))], names=["sizes", "q", "score", "leaves"])
            m = len(best[0])
            yield pa.RecordBatch.from_arrays([pa.array([None] * m, pa.binary()), pa.array(best[0]), pa.array(best[1]), pa.array(list(best[2]), pa.list_(pa.int64()))], names=["sizes", "q", "score", "leaves"])

    told = scratch.write(index.mapInArrow(counted, "sizes binary, q bigint, score double, leaves array<bigint>"), "told")

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((TREES, 2 << depth), np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x, np.int64).reshape(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sizes"])

    sums = told.filter("sizes is not null").select("sizes").mapInArrow(added, "sizes binary").repartition(16).mapInArrow(added, "sizes binary").collect()
    sizes = sum(np.frombuffer(bytes(r.sizes), np.int64).reshape(TREES, -1) for r in sums)
    truth = told.filter("sizes is null").withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("r") <= k + 1).collect()
    budget = _budget(forest.value, asked.value, truth, sizes, target)
    share = spark.sparkContext.broadcast((sizes, budget))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, (size, most_rows) = forest.value, share.value
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                b = whole.slice(a, 256)
                cells = []
                for q in vectors(b):
                    seen, mine = 0, []
                    for t, leaf in f.visits(q):
                        if size[t, leaf]:
                            mine.append(t << 32 | leaf)
                            seen += size[t, leaf]
                            if seen >= most_rows:
                                break
                    cells.append(mine)
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.list_(pa.int64())), b.column(0), b.column(1), b.column(2)], names=["cells", "h1", "h2", "vec"])

    probed = scratch.write(unique.filter("asks").select("h1", "h2", "vec").mapInArrow(probes, "cells array<bigint>, h1 bigint, h2 bigint, vec binary"), "probed")
    asks = probed.select(F.explode("cells").alias("cell"), "h1", "h2", "vec")
    met = asks.groupBy("cell").agg(F.count("*").alias("n"))
    cells = index.select(F.posexplode("leaves").alias("t", "leaf"), "vec", "ids").select(F.shiftleft(F.col("t").cast("long"), 32).bitwiseOR(F.col("leaf")).alias("cell"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"), "vec", "ids")
    asks, cells = _dealt(asks, cells, {r.cell: r.n for r in met.filter(F.col("n") > CELL_QUERIES).collect()})  # of TREES x SAMPLE_VECTORS / 16 cells at most
    both = asks.select("cell", "part", F.lit(0).alias("kind"), "h1", "h2", "vec", F.lit(None).cast("array<bigint>").alias("ids")).unionByName(cells)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(parts, "cell", "part").sortWithinPartitions("cell", "part", "kind")

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per cell the queries come first and stay; its vectors pass by in blocks."""
        cell, q, keys, at_floor, held, n_held = None, [], [], None, [], 0
        floors: dict[tuple[int, int], float] = {}  # by query: a score that k + 1 of the vectors seen reach

        def cut() -> tuple:
            one = tuple(np.concatenate(x) for x in zip(*held))
            group = np.unique(np.stack([one[0], one[1]], 1), axis=0, return_inverse=True)[1].reshape(-1)
            _, first = np.unique(np.stack([group, one[2]], 1), axis=0, return_index=True)  # a vector met in two trees
            first = first[_best(group[first], one[3][first], one[2][first], k + 1)]
            if len(floors) > FLOORS:
                floors.clear()
            ends = np.flatnonzero(np.append(group[first][1:] != group[first][:-1], True))
            for e, size in zip(first[ends].tolist(), np.diff(np.append(-1, ends)).tolist()):
                if size == k + 1:
                    floors[int(one[0][e]), int(one[1][e])] = float(one[3][e])
            return tuple(x[first] for x in one)

        for whole in batches:
            names = whole.schema.names
            column = lambda x: whole.column(names.index(x))  # noqa: E731, B023
            kinds = column("kind").to_numpy()
            at = np.stack([column("cell").to_numpy(), column("part").to_numpy()], 1)
            h = np.stack([column(x).fill_null(0).to_numpy() for x in ("h1", "h2")], 1)
            edges = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]).any(1) | (kinds[1:] != kinds[:-1]), [True]]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if tuple(at[a]) != cell:
                    cell, q, keys, at_floor = tuple(at[a]), [], [], None
                if kinds[a] == 0:
                    q.append(vectors(whole.slice(a, b - a)))
                    keys.append(h[a:b])
                elif q:
                    if len(q) > 1:
                        q, keys = [np.concatenate(q)], [np.concatenate(keys)]
                    if at_floor is None:
                        at_floor = np.array([floors.get(x, -np.inf) for x in map(tuple, keys[0].tolist())])
                    for c in range(a, b, BLOCK):
                        some = whole.slice(c, min(BLOCK, b - c))
                        x, ids = vectors(some), some.column(names.index("ids"))
                        least = ids.flatten().take(pa.array(ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py())).to_numpy()
                        lists = np.array([*ids.to_pylist(), None], object)[:-1]
                        row, col, score = _rank_block(q[0], x, k + 1, least, at_floor)
                        held.append((keys[0][row, 0], keys[0][row, 1], least[col], score, lists[col]))
                        n_held += len(row)
                        if n_held > HELD:
                            held[:] = [cut()]
                            n_held = len(held[0][0])
                            at_floor = np.array([floors.get(x, -np.inf) for x in map(tuple, keys[0].tolist())])
                            if n_held > HELD // 2:  # so many queries: what is settled here goes out
                                yield from sent_out(held.pop())
                                n_held = 0
        if held:
            yield from sent_out(cut())

    def sent_out(one: tuple) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(one[0]), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 20_000].tolist(), t) for x, t in zip(one, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64())))], names=["h1", "h2", "least", "score", "ids"])

    hits = both.mapInArrow(ranked, "h1 bigint, h2 bigint, least bigint, score double, ids array<bigint>")
    entry = F.struct(F.negative("score").alias("s"), "least", "ids")
    tops = hits.groupBy("h1", "h2").agg(F.slice(F.sort_array(F.collect_set(entry)), 1, k + 1).alias("tops"))
    flat = F.flatten(F.transform("tops", lambda e: F.transform(e["ids"], lambda i: F.struct(e["s"].alias("s"), i.alias("id")))))
    tops = scratch.write(tops.select("h1", "h2", F.slice(F.array_sort(flat), 1, k + 1).alias("tops")), "tops")
    scratch.drop(held_unique, index, told, probed)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, v = _matrix(b, "v")
            keys = [_keys(x) for x in v if len(x) == dim]
            rows = rows[[len(x) == dim for x in v]] if len(rows) else rows
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array([x[0] for x in keys], pa.int64()), pa.array([x[1] for x in keys], pa.int64())], names=["query_id", "h1", "h2"])

    queries = base.filter(F.col("id") % every == 0).mapInArrow(keyed, "query_id bigint, h1 bigint, h2 bigint").dropDuplicates()
    mine = queries.join(tops, ["h1", "h2"]).select("query_id", F.slice(F.filter("tops", lambda e: e["id"] != F.col("query_id")), 1, k).alias("tops"))
    return mine.select("query_id", F.posexplode("tops").alias("p", "e")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("e.id").alias("vec_id"), F.negative("e.s").alias("score"))


def _dealt(asks: DataFrame, cells: DataFrame, crowded: dict[int, int]) -> tuple[DataFrame, DataFrame]:
    """Both with part: the queries of a crowded cell are dealt to as many parts as it needs, each with a copy of the
    cell's vectors; every other cell has one part."""
    slices = F.lit(1).cast("long")
    if crowded:
        parts = F.create_map(*[F.lit(x).cast("long") for c, n in crowded.items() for x in (c, -(-n // CELL_QUERIES))])
        slices = F.coalesce(F.element_at(parts, F.col("cell")), slices)
    copies = F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)) if crowded else F.lit(0).cast("long")
    return asks.withColumn("part", F.pmod(F.col("h2"), slices)), cells.withColumn("part", copies)


def _budget(forest: Forest, queries: np.ndarray, truth: list, sizes: np.ndarray, target: float) -> int:
    """The least number of rows to see that finds the target share of the true neighbours, a tenth added."""
    met: list[int] = []
    for i, q in enumerate(queries):
        wanted = [tuple(r.leaves) for r in truth if r.q == i]
        seen, at = 0, {}
        for t, leaf in forest.visits(q):
            seen += int(sizes[t, leaf])
            at[t, leaf] = seen
        met += [min(at[t, leaf] for t, leaf in enumerate(w)) for w in wanted]
    met.sort()
    return int(1.1 * met[min(len(met) - 1, int(target * len(met)))]) + 1 if met else 1
