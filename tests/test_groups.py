"""Measures of groups against plain counts, and the one-text measures that they generalise."""

import math
import re
import statistics
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphsieve.functions import phrases
from glyphsieve.operators import groups, stylometry

WORD, WHITE = re.compile("[a-z0-9']+"), re.compile(r"\s+")
ROWS = [
    ("a", 1, "The cat sat. The dog sat! Did the cat? Yes."),
    ("a", 1, "The cat sat. The dog sat! Did the cat? Yes."),
    ("a", None, "one"),
    ("b", 1, None),
    ("b", 2, ""),
    ("b", 2, "　 \n"),
    (None, 1, "tie tie tie tie tie tie tie tie tie tie tie"),
    (None, 1, "é ü 漢字 😀😀 x"),
    ("hot", 1, "w1 w2 w3. " * 400 + "İK end"),
    *[("hot", 1, f"w1 w2 w3 {i % 7}. And so on {i}!") for i in range(200)],
]
SCHEMA = "g string, h int, body string"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


def by_group(columns=(0, 1)):
    out = {}
    for r in ROWS:
        out.setdefault(tuple(r[c] for c in columns), []).append(r[2] or "")
    return out


def bits(counts):
    n = sum(counts.values())
    return -sum(c / n * math.log2(c / n) for c in counts.values()) if n else None


def test_word_entropy(df):
    got = {(r.g, r.h): r for r in groups.word_entropy(df, ["g", "h"], "body").collect()}
    assert len(got) == len(by_group())
    for key, texts in by_group().items():
        c = Counter(w for t in texts for w in WORD.findall(t.lower()))
        r, n = got[key], sum(c.values())
        assert (r.words, r.distinct_words) == (n, len(c))
        assert r.entropy_bits is None if not n else math.isclose(r.entropy_bits, bits(c), abs_tol=1e-9)
        assert r.lexical_diversity == (round(min(bits(c) / math.log2(n), 1) * 10, 3) if n > 1 else 0.0)
        assert (r.band == "no_words") == (n == 0)


def test_pair_entropy(df):
    got = {(r.g, r.h): r for r in groups.pair_entropy(df, ["g", "h"], "body").collect()}
    assert len(got) == len(by_group())
    for key, texts in by_group().items():
        c = Counter()
        for t in texts:
            t = WHITE.sub(" ", t.lower())
            c.update(t[i : i + 2] for i in range(len(t) - 1))
        r = got[key]
        assert (r.pairs, r.distinct_pairs) == (sum(c.values()), len(c))
        assert r.entropy_bits is None if not c else math.isclose(r.entropy_bits, bits(c), abs_tol=1e-9)
        assert r.bigram_entropy == (round(min(bits(c) / 4.2, 1) * 10, 3) if c else 0.0)


def lengths(texts):
    return [len(re.findall("[A-Za-z0-9']+", s)) for t in texts for s in re.split(r"(?<=[.!?])\s+", t.strip()) if s.strip()]


def test_sentence_variation_and_its_merging(df):
    fine = groups.sentence_moments(df, ["g", "h"], "body")
    for moments, columns in ((fine, (0, 1)), (groups.merge_moments(fine, ["g"]), (0,)), (groups.merge_moments(fine.unionByName(fine.limit(0)), []), ())):
        got = {tuple(r[c] for c in ("g", "h")[: len(columns)]): r for r in groups.variation(moments).collect()}
        want = by_group(columns)
        assert set(got) == set(want)
        for key, texts in want.items():
            x, r = lengths(texts), got[key]
            assert r.sentences == len(x)
            if x:
                assert math.isclose(r.mean_words, statistics.fmean(x)) and math.isclose(r.m2, statistics.pvariance(x) * len(x), abs_tol=1e-9)
            if len(x) >= 3 and sum(x):
                v = statistics.pstdev(x) / statistics.fmean(x)
                assert math.isclose(r.variation, v, abs_tol=1e-9) and r.sentence_variance == round(min(v / 0.5, 1) * 10, 3)
            else:
                assert r.variation is None and (r.sentence_variance, r.band) == (5.0, "too_few_sentences")


def test_moments_of_long_sentences_don_t_lose_their_digits(spark):
    n = 10**9
    moments = spark.createDataFrame([("x", 3, Decimal(3 * n + 3), Decimal(3 * n * n + 6 * n + 5))], "g string, n long, s1 decimal(38,0), s2 decimal(38,0)")
    assert groups.variation(moments).first()["m2"] == pytest.approx(2.0)  # of n, n + 1, n + 2


@pytest.mark.parametrize("size", [1, 3])
def test_phrase_repetition(df, size):
    got = {(r.g, r.h): r for r in groups.phrase_repetition(df, ["g", "h"], "body", size).collect()}
    assert len(got) == len(by_group())
    for key, texts in by_group().items():
        p = [tuple(w[i : i + size]) for w in (WORD.findall(t.lower()) for t in texts) for i in range(len(w) - size + 1)]
        r = got[key]
        assert (r.phrases, r.distinct_phrases) == (len(p), len(set(p)))
        assert r.phrase_repetition == (round(len(set(p)) / len(p) * 10, 3) if len(p) > 10 - size else 5.0)


def test_a_group_of_one_text_measures_as_the_text_does(spark):
    texts = [r[2] for r in ROWS if r[2]][:9]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    one = {r.id: [s.value for s in r.signals] for r in stylometry.stylometry(df).collect()}
    word = {r.id: r.lexical_diversity for r in groups.word_entropy(df, ["id"]).collect()}
    pair = {r.id: r.bigram_entropy for r in groups.pair_entropy(df, ["id"]).collect()}
    sentence = {r.id: r.sentence_variance for r in groups.variation(groups.sentence_moments(df, ["id"])).collect()}
    phrase = {r.id: r.phrase_repetition for r in groups.phrase_repetition(df, ["id"]).collect()}
    assert {i: [word[i], pair[i], sentence[i], phrase[i]] for i in one} == one


def test_empty_table_and_no_key(spark, df):
    none = spark.createDataFrame([], SCHEMA)
    for f in (groups.word_entropy, groups.pair_entropy, groups.phrase_repetition):
        assert f(none, ["g"], "body").count() == 0
    assert groups.word_entropy(df, [], "body").first()["words"] == sum(len(WORD.findall((r[2] or "").lower())) for r in ROWS)


def test_names_that_clash(spark):
    df = spark.createDataFrame([("a", "n", "the pair"), ("a", "n", "the t")], "word string, `pair` string, t string")
    assert groups.pair_entropy(df, ["word", "pair"], "t").columns[:2] == ["word", "pair"]
    assert groups.word_entropy(df, ["word"], "t").first()["words"] == 4
    assert groups.phrase_repetition(df, ["word", "pair"], "t", 2).first()["phrases"] == 2


def test_what_is_shuffled_is_counts(df):
    plan = groups.word_entropy(df, ["g"], "body")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_") >= 2 and "Window" not in plan and "collect" not in plan


def test_pairs_of_very_long_texts(spark):
    df = spark.createDataFrame([(1, "ab " * 800_000), (1, "É" * 1_000_001)], "g int, text string")
    got = {r.pair: r.n for r in groups.pair_counts_by(df, ["g"]).collect()}
    code = lambda a, b: ord(a) << 21 | ord(b)
    assert got == {code("a", "b"): 800_000, code("b", " "): 800_000, code(" ", "a"): 799_999, code("é", "é"): 1_000_000}


def test_bits_by_row_stay_apart(spark):
    texts = ["ab", "a", "", None, "abab", "É😀É", "x" * 50]
    got = [r.b for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(1).sortWithinPartitions("i").select(stylometry.bigram_bits(F.col("t")).alias("b")).collect()]
    want = [None if t is None or len(t) < 2 else bits(Counter(t.lower()[i : i + 2] for i in range(len(t) - 1))) for t in texts]
    assert [x is None for x in got] == [x is None for x in want] and all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got, want) if b is not None)


@pytest.mark.parametrize("held", [1, 300, 1 << 25])
def test_many_groups_and_buckets_settle_as_they_come(spark, monkeypatch, held):
    monkeypatch.setattr(groups, "HELD_BYTES", held)
    monkeypatch.setattr(groups, "PHRASE_BYTES", 200)
    rows = [(i % 37 if i % 5 else None, f"a b c d{i % 3} e f g h{i % 4}") for i in range(400)]
    got = {r.g: (r.phrases, r.distinct_phrases) for r in groups.phrase_repetition(spark.createDataFrame(rows, "g int, text string").repartition(3), ["g"], size=2).collect()}
    want = {}
    for g, t in rows:
        w = t.split()
        want.setdefault(g, []).extend(zip(w, w[1:]))
    assert got == {g: (len(p), len(set(p))) for g, p in want.items()}


def test_keys_that_agree_in_part_are_told_apart():
    a, b, owner = np.array([5, 5, 5, 5, 7], np.uint64), np.array([1, 2, 1, 1, 1], np.uint32), np.array([0, 0, 0, 1, 1])
    assert len(phrases.distinct(a, b)) == 3 and sorted(phrases.distinct(a, b, owner)) == [0, 1, 3, 4]
    assert len(phrases.distinct(a[:0], b[:0])) == 0
