import hashlib
import math

import numpy as np
import pytest

from glyphsieve.llm import balltree, queries

SCHEMA = "vec_id long, embedding array<float>, id string, cluster int"


def brute(rows, k=8, rounds=10, dims=64):
    """(vec_id, vector) -> the query's rows, by plain integers."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    whole = lambda v: np.array([math.floor(1024 * float(x)) for x in v], object)
    centres, points = [whole(v) for _, v in first], [(i, whole(v)) for i, v in kept]

    def nearest(p):
        return min((((p - c) ** 2).sum(), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, p in points:
            groups.setdefault(nearest(p)[1], []).append(p)
        centres = [np.array([x // len(groups[n]) for x in sum(groups[n])], object) if n in groups else c for n, c in enumerate(centres)]
    found = [(i, *nearest(p)[::-1]) for i, p in points]
    inertia = {n: sum(d for _, c, d in found if c == n) for n in range(k)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted([(i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in found], key=repr)


def answer(spark, rows, monkeypatch):
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    monkeypatch.setattr(queries, "_table", lambda *_: table)
    return sorted(map(tuple, queries.op11_centroid_clustering(spark, "").collect()), key=repr)


def f32(x):
    return np.asarray(x, np.float32).astype(float).tolist()


def test_clusters_copies_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(5)
    groups = rng.normal(size=(6, 64))
    rows = [(i, f32(groups[i % 6] * (i % 5 > 0) + rng.normal(size=64) * (0.02 if i % 7 else 1))) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)] + [rows[8]] * 3
    rows += [(2000 + i, [float(i % 2)] * 64) for i in range(40)]
    assert answer(spark, rows, monkeypatch) == brute(rows)


def test_vectors_that_take_no_part(spark, monkeypatch):
    good = [(i, f32(np.random.default_rng(i).normal(size=64))) for i in range(12)]
    bad = [(90, None), (91, []), (92, [1.0] * 63), (93, [1.0] * 65), (94, [1.0] * 63 + [None]), (95, [float("nan")] + [1.0] * 63), (96, [float("-inf")] + [1.0] * 63)]
    rows = good + bad + [(None, [0.5] * 64), (None, [0.5] * 64), (7, [0.25] * 64)]
    got = answer(spark, rows, monkeypatch)
    assert got == brute(rows) and len(got) == 15


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_centroids(spark, monkeypatch, n):
    rows = [(i, [float(-i)] * 64) for i in range(n)]
    assert answer(spark, rows, monkeypatch) == brute(rows)


def test_large_components_stay_exact(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, f32(rng.normal(size=64) * 20_000)) for i in range(100)]
    assert answer(spark, rows, monkeypatch) == brute(rows)


def test_too_large_a_component_is_an_error(spark, monkeypatch):
    with pytest.raises(Exception, match="don't fit in 64 bits"):
        answer(spark, [(1, [1e9] * 64), (2, [1.0] * 64)], monkeypatch)


def test_other_kinds_and_parameters(spark):
    df = spark.createDataFrame([(f"v{i}", [i, i % 3]) for i in range(50)], "`a.b` string, v array<int>")
    out = balltree.cluster(df, "a.b", "v", k=3, dims=2, scale=1).collect()
    assert len(out) == 50 and sum(r["distance"] for r in out) == out[0]["inertia"]


def by_hand(q, centres):
    d = ((q[:, None, :] - centres[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


@pytest.mark.parametrize("spread", [0.0, 5.0, 300.0])
def test_a_tree_assigns_as_brute_force_does(spread):
    rng = np.random.default_rng(3)
    heart = rng.integers(-1000, 1000, size=(4, 64))
    q = heart[rng.integers(0, 4, 3000)] + np.rint(rng.normal(size=(3000, 64)) * spread).astype(np.int64)
    tree = balltree.Tree(q)
    row = {name: getattr(tree, name).astype(t).tobytes() for name, t in balltree._NODES} | {"narrow": True, "points": q[tree.order].astype(np.int16).tobytes()}
    block = balltree.Block(row, 64)
    leaves = block.child < 0
    assert (block.last - block.first)[leaves].sum() == 3000 and (block.sums[leaves].sum(0) == q.sum(0)).all()
    centres = np.concatenate([heart, heart[:2], heart[:1] + 1])  # equal ones too: the first wins
    label, away = block.labels(centres)
    want, least = by_hand(q[tree.order], centres)
    assert (label == want).all() and (away == least).all()
    counts, sums = block.totals(centres)
    assert (counts == np.bincount(want, minlength=len(centres))).all()
    assert all((sums[c] == q[tree.order][want == c].sum(0)).all() for c in range(len(centres)))
    nodes, _, _ = block.settle(heart)
    if spread < 100:  # balls of one group are settled by their count and sum
        assert (block.last - block.first)[nodes].sum() > 2500 and len(nodes) < 300
