"""Phrases that run on from row to row, against joined texts."""

import random
import re

import pytest

from glyphsieve.operators import ordered

SCHEMA = "conv string, turn int, body string, h string, w string"


def brute(rows, size):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        each = [re.findall("[a-z0-9']+", (r[2] or "").lower()) for r in mine]
        w = [x for e in each for x in e]
        p = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
        inside = sum(max(len(e) - size + 1, 0) for e in each)
        value = round(len(set(p)) / len(p) * 10, 3) if len(p) > 10 - size else 5.0
        out[conv] = (len(w), len(p), len(p) - inside, len(set(p)), value)
    return out


def answer(spark, rows, size=3, parts=4):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(parts)
    got = ordered.phrase_repetition(df, ["conv"], ["turn"], "body", size).collect()
    assert len({r.conv for r in got}) == len(got)
    return {r.conv: (r.words, r.phrases, r.crossing_phrases, r.distinct_phrases, r.phrase_repetition) for r in got}


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_rows_of_any_length(spark, size):
    rnd = random.Random(size)
    rows = [(f"c{c}" if c else None, t, " ".join(rnd.choice("ab cd e f".split()) for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 9])))) for c in range(8) for t in range(rnd.randrange(1, 12))]
    rnd.shuffle(rows)
    assert answer(spark, rows, size) == brute(rows, size)


def test_nulls_empties_and_sequences_without_words(spark):
    rows = [("a", 1, None), ("a", 2, ""), ("b", None, "first"), ("b", 1, None), ("b", 2, "and"), ("b", 3, " ... "), ("b", 4, "last"), (None, 1, "x y"), (None, 2, "z")]
    got = answer(spark, rows)
    assert got == brute(rows, 3) and got["b"][1] == 1 and got["a"][0] == 0


def test_a_hot_sequence_reaches_over_many_parts(spark):
    rows = [("hot", t, ["one two", "three", ""][t % 3] + f" {t % 5}" * (t % 2)) for t in range(900)] + [(f"c{t}", 1, "one two three four") for t in range(60)]
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert answer(spark, rows, 4, 9) == brute(rows, 4)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_equal_orders_and_repeated_rows(spark):
    same = [("a", 1, "p q r s")] * 3
    assert answer(spark, same) == brute(same, 3)
    tied = answer(spark, [("a", 1, "b c d"), ("a", 1, "a b c")])
    assert tied == brute([("a", 1, "a b c"), ("a", 2, "b c d")], 3)  # by their first words


def test_long_texts_and_empty_table(spark):
    long = [("a", i, "word other " * 100_000) for i in range(3)]
    assert answer(spark, long) == brute(long, 3)
    assert answer(spark, []) == {}


def test_only_border_words_are_shuffled(spark):
    df = spark.createDataFrame([("a", 1, "one two three four five")], "conv string, turn int, body string")
    out = ordered.phrase_repetition(df, ["conv"], ["turn"], "body")
    for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines():
        assert "Window" not in line or "body" not in line
