import math
import tracemalloc

import numpy as np
import pytest

from glyphsieve.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def brute(ids, x, k, every):
    x = np.asarray(x, np.float32).astype(np.float64)
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            s = (x * q).sum(1)
            order = sorted((j for j in range(len(ids)) if ids[j] != i), key=lambda j: (-round(s[j], 12), ids[j]))
            out[i] = [(ids[j], s[j]) for j in order[:k]]
    return out


def run(spark, rows, schema=SCHEMA, **more):
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, schema).repartition(3), **more).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return got


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 24))
    x = (centres[rng.integers(0, 8, 3000)] + 0.5 * rng.normal(size=(3000, 24))).astype(np.float32)
    want = brute(list(range(3000)), x, 20, 20)
    got = run(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)])
    assert got.keys() == want.keys()
    hit = [len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]
    assert np.mean(hit) >= 0.9
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == list(range(1, 21)) and all(v != q for _, v, _ in rows)
        scores = [s for _, _, s in rows]
        assert scores == sorted(scores, reverse=True)
        assert all(math.isclose(s, float(x[q].astype(float) @ x[v].astype(float)), rel_tol=1e-12, abs_tol=1e-12) for _, v, s in rows)


def test_all_candidates_if_fewer_than_k(spark):
    x = [[1.0, 0.0], [0.5, 0.5], [-1.0, 2.0], [0.0, 1.0], [3.0, 3.0]]
    got = run(spark, [(i * 20, v) for i, v in enumerate(x)])
    want = brute([i * 20 for i in range(5)], x, 20, 20)
    assert {q: [(v, s) for _, v, s in r] for q, r in got.items()} == want


def test_equal_vectors_ties_and_repeats(spark):
    rows = [(i, [1.0, 2.0, 2.0]) for i in range(100)] + [(200, [2.0, 0.0, 0.0]), (200, [2.0, 0.0, 0.0]), (201, [2.0, 0.0, -0.0])]
    got = run(spark, rows)
    assert [v for _, v, _ in got[0]] == list(range(1, 21)) and [v for _, v, _ in got[80]] == list(range(20))
    assert [v for _, v, _ in got[200]] == [201, *range(19)] and len(got) == 6


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0]), (20, None), (40, [0.0, -0.0]), (60, [1.0, None]), (80, [nan, 1.0]), (100, [inf, 1.0]), (None, [5.0, 5.0]), (120, []), (140, [1.0, 2.0, 3.0]), (3, [1.0, 0.0]), (4, [0.5, 0.0])]
    got = run(spark, rows)
    assert {q: [v for _, v, _ in r] for q, r in got.items()} == {0: [3, 4]}


def test_empty_and_without_queries(spark):
    assert run(spark, []) == {} and run(spark, [(1, [1.0]), (2, [2.0])]) == {} and run(spark, [(20, [0.0])]) == {}


def test_doubles_and_clashing_columns(spark):
    rows = [(i, [float(i), 1e-300 if i else 1.0], "x", [1]) for i in range(45)]
    got = run(spark, rows, "vec_id long, embedding array<double>, score string, ids array<int>", k=2)
    assert [v for _, v, _ in got[40]] == [44, 43] and [v for _, v, _ in got[0]] == [1, 2]


def test_cells_are_split_by_queries(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_QUERIES", 7)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 6)).astype(np.float32)
    got = run(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)], every=5, k=5)
    want = brute(list(range(400)), x, 5, 5)
    assert np.mean([len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) / 5 for q in want]) >= 0.9


def test_only_crowded_cells_are_copied(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_QUERIES", 10)
    asks = spark.range(60).selectExpr("if(id < 45, 1L, 2L + id % 3) AS cell", "id AS h1", "hash(id) AS h2")
    cells = spark.createDataFrame([(c, v) for c in (1, 2, 3, 4, 9) for v in range(4)], "cell long, vec int")
    a, b = ann._dealt(asks, cells, {1: 45})
    parts = {r.cell: r.n for r in b.groupBy("cell").agg({"part": "count"}).withColumnRenamed("count(part)", "n").collect()}
    assert parts == {1: 20, 2: 4, 3: 4, 4: 4, 9: 4}  # five parts of the crowded cell, each with all its vectors
    met = a.join(b, ["cell", "part"]).groupBy("cell", "h1").count().collect()
    assert len(met) == 60 and {r["count"] for r in met} == {4}
    assert all(x["part"] == 0 for t in ann._dealt(asks, cells, {}) for x in t.collect())


def test_forest_visits_every_leaf_once():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 5))
    forest = ann.Forest(x, 4, 0.0)
    seen = list(forest.visits(x[0]))
    assert len(seen) == len(set(seen)) == ann.TREES * 16
    leaves = forest.route(x)
    assert leaves.min() >= 16 and leaves.max() < 32
    assert max(np.bincount(leaves[:, 0])) <= 2 * 500 / 16 + 2


@pytest.mark.parametrize("k", [1, 3, 10])
def test_block_keeps_the_k_best_and_smallest(k):
    rng = np.random.default_rng(k)
    x, q = rng.integers(-2, 3, (300, 4)).astype(float), rng.integers(-2, 3, (40, 4)).astype(float)
    tie = rng.permutation(300)
    row, col, score = ann._rank_block(q, x, k, tie, np.full(40, -np.inf))
    for i in range(40):
        want = sorted((-(q[i] @ x[j]), tie[j]) for j in range(300))[:k]
        assert sorted(zip(-score[row == i], tie[col[row == i]])) == want
    floor = np.array([np.sort(x @ v)[-k] for v in q])
    again = ann._rank_block(q, x, k, tie, floor)
    assert all(sorted(zip(a.tolist(), b.tolist())) == sorted(zip(c.tolist(), d.tolist())) for a, b, c, d in [(row, tie[col], again[0], tie[again[1]])])


def test_ties_take_bounded_memory():
    """Queries that are orthogonal to a whole block tie with all of it."""
    q, x = np.zeros((1024, 64)), np.zeros((2048, 64))
    q[:, 0], x[:, 1] = 1, np.arange(2048) + 1
    tracemalloc.start()
    row, col, score = ann._rank_block(q, x, 21, np.arange(2048)[::-1], np.full(1024, -np.inf))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(row) == 1024 * 21 and set(col) == set(range(2027, 2048)) and not score.any()
    assert peak < 400e6


def test_ties_between_queries_and_all_vectors(spark):
    rows = [(i, [1.0, 0.0] if i % 20 == 0 else [0.0, 1.0 + i]) for i in range(600)]
    got = run(spark, rows)
    queries = [i for i in range(600) if i % 20 == 0]
    for q in queries:
        assert [v for _, v, _ in got[q]] == [i for i in queries if i != q][:20]
