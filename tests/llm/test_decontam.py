import random
from collections import Counter

import numpy as np
import pytest

from glyphsieve.llm import decontam
from glyphsieve.llm.queries import op9_decontamination

SF = "/root/testdata/sf0.01"


def words_of(text):
    return "".join(c.lower() if c.isascii() else c for c in "".join(c if not c.isascii() or c.isalnum() else " " for c in text or "")).split(" ")


def shingles(w):
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(docs, items, threshold=0.8):
    out = {}
    for d, text in docs:
        w = [x for x in words_of(text) if x]
        for i, item in items:
            v = [x for x in words_of(item) if x]
            if not v:
                continue
            mine, n = shingles(v), len(v)
            best = max(((2 * (shingles(w[s : s + n]) & mine).total() / (2 * mine.total()), -s) for s in range(len(w) - n + 1)), default=(0, 0))
            if best[0] >= threshold - 1e-12:
                out[d, i] = (best[0], -best[1])
    return out


def run(spark, docs, items, **more):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {(r.id, r.item_id): (r.similarity, r.first_word) for r in decontam.find_leaks(d, b, **more).collect()}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("aeiou") + rng.choice("klmnop")
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 5, 12, 30, 31, 60])))) for i in range(12)]
    docs = []
    for d in range(80):
        w = [word() for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.7:
            v = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                v[rng.randrange(len(v))] = "other"
            if rng.random() < 0.3:
                v = [x.upper() + rng.choice(["", ",", "!"]) for x in v]
            at = rng.randint(0, len(w))
            w[at:at] = v
        docs.append((d, rng.choice([" ", "\n"]).join(w)))
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    docs, items = corpus(seed)
    got, want = run(spark, docs, items), brute(docs, items)
    assert got.keys() == want.keys() and len(want) > 10
    assert all(abs(got[k][0] - want[k][0]) < 1e-12 for k in want)


def brute_short(docs, items, threshold=0.8):
    """The documents shorter than an item, each held against it as a whole."""
    out = {}
    for d, text in docs:
        for i, item in items:
            w, v = words_of(text), words_of(item)
            if 5 <= len(w) < len(v):
                value = 2 * (shingles(w) & shingles(v)).total() / (shingles(w).total() + shingles(v).total())
                if value >= threshold - 1e-12:
                    out[d, i] = (value, 0)
    return out


def test_documents_shorter_than_the_item(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"v{rng.randrange(200)}" for _ in range(n))) for i, n in enumerate([5, 6, 12, 30, 40, 40, 60])]
    docs = []
    for _, item in items:
        for cut in (1, 1, 2, 4, 12):
            v = item.split()
            for _ in range(min(cut, len(v) - 1)):
                del v[rng.choice([0, len(v) - 1, rng.randrange(len(v))])]
            docs.append((len(docs), " ".join(v)))
    got, want = run(spark, docs, items), brute(docs, items) | brute_short(docs, items)
    assert got.keys() == want.keys() and len(want) > 10
    assert all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1] == want[k][1] for k in want)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id for r in decontam.drop_leaks(d, b).collect()} == {x for x, _ in docs} - {x for x, _ in want}


@pytest.mark.parametrize("scan", [1, 8])
def test_slices_find_and_drop_the_same(spark, monkeypatch, scan):
    docs, items = corpus(7)
    docs += [(100, None), (101, ""), docs[0], docs[0]]
    whole = run(spark, docs, items)
    d, b = spark.createDataFrame([(*x, "a", 1) for x in docs], "doc_id long, text string, item string, slice int"), spark.createDataFrame(items, "item_id long, text string")
    kept = sorted(map(repr, decontam.drop_leaks(d, b).collect()))
    monkeypatch.setattr(decontam, "SLICE_BYTES", 300)
    monkeypatch.setattr(decontam, "SCAN_SLICES", scan)
    monkeypatch.setattr(decontam, "SALTS", 3)
    assert run(spark, docs, items) == whole
    out = decontam.drop_leaks(d, b)
    assert out.columns == d.columns and sorted(map(repr, out.collect())) == kept and len(kept) < len(docs)
    assert run(spark, [], items) == {} and decontam.drop_leaks(d.limit(0), b).count() == 0


def test_many_slices_take_one_scan_of_the_documents(spark, monkeypatch, tmp_path):
    docs, items = corpus(8)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    monkeypatch.setattr(decontam, "SLICE_BYTES", 300)
    d = spark.read.parquet(str(tmp_path / "docs"))
    plan = decontam.find_leaks(d, spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert sum("doc_id" in line and "Relation" in line for line in plan.splitlines()) == 1


def test_edits_at_the_threshold_are_all_found(spark):
    """Items with words changed at their end until the similarity is just 0.8: the hardest to find by fingerprint."""
    rng = random.Random(6)
    items = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(n))) for i, n in enumerate([24, 44, 104] * 100)]
    docs = []
    for i, item in items:
        for side in (0, 1):
            w = item.split()
            changed = int((len(w) - 4) * 0.2 + 1e-9)  # shingles that a change of so many words at one end touches
            span = range(changed) if side else range(len(w) - changed, len(w))
            for x in span:
                w[x] = f"n{rng.randrange(10**6)}"
            docs.append((2 * i + side, " ".join(w)))
    got = run(spark, docs, items)
    assert {(d, d // 2) for d, _ in docs} <= got.keys() and len(docs) == 600
    assert all(v[0] >= 0.8 - 1e-12 for v in got.values()) and min(v[0] for v in got.values()) < 0.81


@pytest.mark.parametrize("radius", [7, 23, 31])
def test_blocks_give_all_items_within_the_radius_and_no_others(radius):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(9)) for _ in range(60)]
    items = decontam.Items(texts, 0.8, radius)
    for _ in range(300):
        f = rng.getrandbits(64) if rng.random() < 0.5 else int(items.prints[rng.randrange(60)]) ^ sum(1 << rng.randrange(64) for _ in range(20)) & (1 << 64) - 1
        assert items.near(9, f).tolist() == [i for i in range(60) if (int(items.prints[i]) ^ f).bit_count() <= radius]


def test_items_of_one_template(spark):
    """Items that share most of their words, and windows that hold repeated shingles."""
    rng = random.Random(9)
    lead = [f"t{i}" for i in range(14)] * 3
    items = [(i, " ".join(lead + [f"x{rng.randrange(40)}" for _ in range(8)])) for i in range(60)]
    docs = [(d, " ".join(["before", *rng.choice(items)[1].split(), "after"] if d % 2 else lead * 2 + [f"x{rng.randrange(40)}" for _ in range(8)])) for d in range(40)]
    got, want = run(spark, docs, items, radius=63), brute(docs, items)
    assert got.keys() == want.keys() and len(want) > 200
    assert all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1] == want[k][1] for k in want)


def test_long_texts(spark):
    rng = random.Random(1)
    item = " ".join(f"q{i}" for i in range(40))
    body = " ".join(f"w{rng.randrange(10**5)}" for _ in range(700_000))  # 5 MB
    docs = [(1, body + " " + item + " " + body), (2, body), (3, "x" * 2_000_000), (4, "q1 " * 500_000)]
    assert run(spark, docs, [(7, item)]) == {(1, 7): (1.0, 700_000)}


def test_planted_passages(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id) for r in op9_decontamination(spark, SF).collect()}
    whole = {(d, i) for d, t in docs for i, x in items if x in t}
    assert whole and got >= whole and len(got) <= 1.1 * len(whole)


def test_nulls_empties_repeats_and_clashing_columns(spark):
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, text, 0), (1, text, 0), (None, text, 0), (2, None, 0), (3, "", 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(5, text), (5, text), (None, text), (6, None), (7, " ,")], "item_id long, text string")
    got = Counter((r.id, r.item_id) for r in decontam.find_leaks(docs, items).collect())
    assert got == {(1, 5): 4, (None, 5): 2, (1, None): 2, (None, None): 1}
    assert decontam.find_leaks(docs, items.limit(0)).count() == 0 and decontam.find_leaks(docs.limit(0), items).count() == 0
    kept = decontam.drop_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert decontam.drop_leaks(docs, items.limit(0)).count() == 5
