import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from glyphsieve.llm import substring_dedup
from glyphsieve.llm.recompression import parse

SCHEMA = "doc_id long, text string"


def brute(texts, window):
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def run(spark, texts, window=35, parts=3):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(parts)
    return [(r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup_substrings(df, window=window).orderBy("id").collect()]


def corpus(seed, docs=60, vocabulary=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["é", "漢字", "a\xa0b", "x" * 300]
    passages = [[rng.choice(words) for _ in range(rng.randint(20, 90))] for _ in range(6)]
    out = []
    for _ in range(docs):
        w = []
        for _ in range(rng.randint(0, 5)):
            kind = rng.random()
            if kind < 0.4:
                p = rng.choice(passages)
                a = rng.randint(0, 10)
                w += p[a : len(p) - rng.randint(0, 10)]
            elif kind < 0.5:
                w += [rng.choice(words)] * rng.randint(1, 120)
            elif kind < 0.6:
                w += [rng.choice(words), rng.choice(words), rng.choice(words)] * rng.randint(1, 40)
            else:
                w += [rng.choice(words) for _ in range(rng.randint(0, 80))]
        out.append(rng.choice([" ", "\n", "\t \x0b", "\x1c "][:3]).join(w))
    return out + [None, "", "   ", out[0], out[1]]


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    texts = corpus(seed)
    assert run(spark, texts) == brute(texts, 35)


@pytest.mark.parametrize("window", [2, 7, 60])
def test_other_windows(spark, window):
    texts = corpus(9, docs=30)
    assert run(spark, texts, window) == brute(texts, window)


def test_many_small_flushes(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HELD", 50)
    texts = corpus(5)
    assert run(spark, texts, parts=5) == brute(texts, 35)


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_patterned_words_do_not_collide(spark):
    """Words of a pattern on which polynomial hashes modulo a power of two collide, and windows of such words."""
    same = " ".join(f"s{i}" for i in range(34))
    texts = [f"{same} {x}" for n in (64, 1024, 2048, 4096) for x in (thue_morse(n), thue_morse(n, "b", "a"))]
    pattern = [thue_morse(64, "x ", "y ") + "z", thue_morse(64, "y ", "x ") + "z", "u " * 2000 + "v " * 2000]
    assert run(spark, texts + pattern) == brute(texts + pattern, 35)


def test_one_very_long_text_and_word(spark):
    rng = random.Random(3)
    long = " ".join(f"q{rng.randrange(10**6)}" for _ in range(700_000))  # 5 MB
    texts = [long, "start " + long[:300] + " end", "x" * 2_000_000 + " " + "y " * 40, None]
    assert run(spark, texts) == brute(texts, 35)


def test_single_word_runs(spark):
    texts = ["a " * 34, "a " * 35, "a " * 36, "b " * 500, "c d " * 18 + "c", "e " * 35 + "f", "g " + "h " * 34]
    assert run(spark, texts) == brute(texts, 35)


def test_repeated_rows_nulls_and_clashing_columns(spark):
    text = " ".join(f"t{i}" for i in range(50))
    rows = [(1, text, "x", "y"), (1, text, "x", "y"), (None, text + " more", "x", "y"), (None, None, "x", "y"), (2, "short text", "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA + ", k string, kept string")
    got = sorted((r.id is None, r.id or 0, r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(df).collect())
    assert got == [(False, 1, 50, 50), (False, 1, 50, 50), (False, 2, 2, 0), (True, 0, 0, 0), (True, 0, 51, 50)]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_strip_repeats_keeps_other_texts(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(1, f"own  words\n{text}", "en", 3), (2, f"{text} tail", "fr", 4), (3, "left  as\nit is", None, 5), (4, text, "de", 6), (5, None, "de", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, n_chars long")
    out = substring_dedup.strip_repeats(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert sorted(map(tuple, out.collect())) == [(1, "own words", "en", 9), (2, "tail", "fr", 4), (3, "left  as\nit is", None, 14), (5, None, "de", None)]


def test_symbols_are_consistent():
    """A symbol whose dependency range lies within a stretch recurs with it in other surroundings."""
    rng = np.random.default_rng(2)
    stretch = rng.integers(0, 5, 60, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    found = []
    for _ in range(20):
        a, b = (rng.integers(0, 5, rng.integers(0, 50), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
        names = np.concatenate([a, stretch, b])
        p = parse(names, np.array([0, len(names)]), 7, 6, (0, 4))
        inside = (p.low >= len(a)) & (p.high <= len(a) + 60)
        found.append(set(zip(p.name[inside].tolist(), (p.start[inside] - len(a)).tolist(), (p.end[inside] - len(a)).tolist())))
        assert (p.end - p.start <= 12).all() and p.end[-1] == len(names) and (p.start[1:] == p.end[:-1]).all()
    assert len(found[0]) > 3 and all(f == found[0] for f in found)


def test_query_digest(spark):
    from glyphsieve.llm.queries import op8_substring_dedup

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    want = brute([r.text for r in rows], 35)
    got = op8_substring_dedup(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in got] == [(n, m, hashlib.sha256(k.encode()).hexdigest()) for n, m, k in want]
