import random

from glyphsieve.llm.components import connected_components
from glyphsieve.llm.storage import Scratch


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def run(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    return {r.node: r.root for r in connected_components(df, Scratch(spark, "cc")).collect()}


def test_shapes(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1001 + i) for i in range(300)]
    cloud = [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    edges = chain + star + cloud + [(-5, 3000), (7, 7), (5000, 5000)] + chain[:5]
    rng.shuffle(edges)
    assert run(spark, edges) == brute(edges)


def test_none(spark):
    assert run(spark, []) == {} and run(spark, [(3, 3)]) == {}
