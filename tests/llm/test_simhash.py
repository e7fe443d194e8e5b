import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from glyphsieve.llm import simhash
from glyphsieve.llm.storage import Scratch


def slow_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values):
    """Of values within 2 bits, by brute force: the least index of each one's component."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def groups(spark, values, monkeypatch=None):
    df = spark.createDataFrame([(signed(v),) for v in sorted(set(values))], "fp long")
    links = simhash.near_links(df, Scratch(spark, "test")).collect()
    return {(min(r.a, r.b), max(r.a, r.b)) for r in links}


def test_fingerprints(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["The", "a", "É", "x1", "longer"]) for _ in range(rng.randint(0, 30))) for _ in range(50)] + ["", None, "one", "two words", "a b c", "A\tB\nc", " \x0b\x0c "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = simhash.fingerprints(df).orderBy("id").collect()
    assert [r.fp for r in got] == [signed(slow_print(t)) for t in texts]


def test_spark_hash_is_the_same(spark):
    assert spark.createDataFrame([("a b é",)], "s string").select(F.xxhash64("s")).first()[0] == signed(simhash._xxh("a b é".encode()))


def family(seed, n):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(4):
        out += [rng.choice(out) ^ (1 << rng.randrange(64)) ^ (rng.getrandbits(1) << rng.randrange(64)) for _ in range(n)]
    return out + [0, (1 << 64) - 1, 3, (1 << 63) | 1]


def test_links_connect_like_brute_force(spark):
    values = sorted(set(family(1, 60)))
    places = {signed(v): i for i, v in enumerate(values)}
    linked = groups(spark, values)
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in linked)
    want = {(min(signed(a), signed(b)), max(signed(a), signed(b))) for a in values for b in values if a != b and (a ^ b).bit_count() <= 2}
    assert linked == want and places


def test_crowded_points(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 3)
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(3)]
    values = sorted({b ^ (1 << i) ^ (1 << j) for b in base for i in range(0, 64, 3) for j in range(0, 64, 5)} | set(family(2, 20)))
    linked = groups(spark, values)
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in linked)
    index, root = {signed(v): i for i, v in enumerate(values)}, list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        x, y = find(index[a]), find(index[b])
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(values))] == components(values)


def test_components_of_documents(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(30):
        w = [f"w{rng.randrange(500)}" for _ in range(rng.randint(1, 400))]
        texts.append(" ".join(w))
        for _ in range(rng.randint(0, 3)):
            v = list(w)
            if rng.random() < 0.6:
                v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v).upper() if rng.random() < 0.3 else " ".join(v))
    texts += ["", None, "  "]
    rng.shuffle(texts)
    df = spark.createDataFrame([(i + 10, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = simhash.simhash_components(df).orderBy("id").collect()
    assert [r.component_id - 10 for r in got] == components([slow_print(t) for t in texts])


def test_null_ids_repeats_and_clashing_columns(spark):
    rows = [(None, "a b c d", 1), (5, "a b c d", 1), (5, "a b c d", 1), (None, "z y x", 1), (7, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.id, r.component_id) for r in simhash.simhash_components(df).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (None, 5), (None, None), (7, 7)], key=str)
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_embedding_bounds_the_distance():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (int(x) for x in rng.integers(0, 1 << 63, 2))
        far = sum(abs((a >> 4 * k & 15).bit_count() - (b >> 4 * k & 15).bit_count()) for k in range(16))
        assert far <= (a ^ b).bit_count()


def test_long_texts_ties_and_clashing_columns(spark):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(10**5)}" for _ in range(400_000))  # 2.7 MB
    rows = [(5, long, "x", 1), (3, long, "x", 1), (3, long, "x", 1), (8, "y" * 2_000_000, "x", 1), (None, "y" * 2_000_000, "x", 1), (9, None, "x", 1), (7, "", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = sorted((r.id or -1, r.component_id) for r in simhash.simhash_components(df).collect())
    assert got == [(-1, 8), (3, 3), (3, 3), (5, 3), (7, 7), (8, 8), (9, 7)]
    assert simhash.fingerprints(df).filter("id = 5").first().fp == signed(slow_print(long))
