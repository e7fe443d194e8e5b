import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphsieve.functions.numbers import round3
from glyphsieve.operators import stylometry

from . import model


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return stylometry.stylometry(df).orderBy("id").collect()


def check(spark, texts):
    for t, r in zip(texts, run(spark, texts)):
        values, total, band = model.style(t)
        assert [(s.value, s.weight) for s in r.signals] == values, t
        assert r.composite_score == total and r.confidence == band, t


def test_short_text(spark):
    r = run(spark, ["Hi."])[0]
    assert r.confidence == "low" and 0 <= r.composite_score <= 10 and r.summary == "short_sample"


def test_repeated_phrase_is_not_diverse(spark):
    assert run(spark, ["same words " * 50])[0].signals[0].value < 5


def test_edges(spark):
    sentence = "One two three four five six seven eight nine ten. "
    check(spark, ["", " ", "a", "ab", "word", "same same same", "漢字だけ", "一。 A! B? C.", "a. b. c.", "!. ?. ..", "one two three four five six seven eight nine", "one two three four five six seven eight nine ten"])
    check(spark, [sentence * 5 + "a " * 9, sentence * 6, sentence * 19 + "a " * 9, sentence * 20, sentence * 60, "\u0130stanbul \u212a ΑΣ. " * 20, "x\x85y z\x1cw. v"])


def test_prose(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", ".", "!", ","]) for _ in range(rng.randint(1, 900))) for _ in range(40)]
    check(spark, texts)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aAbB'9 .!?\n\t\xa0é\x1c", max_size=120), min_size=1, max_size=20))
def test_against_the_model(spark, texts):
    check(spark, texts)


def test_null(spark):
    r = run(spark, [None])[0]
    assert r.signals is None and r.composite_score is None and r.confidence is None and r.summary is None


@pytest.mark.parametrize("many", [False, True])
def test_rounding_is_pythons(spark, many):
    values = [9.0625, 2.0005, 0.0, 10.0, 0.0005, 1.0005] + ([k / n * 10 for n in range(1, 400) for k in range(0, n + 1, 3)] if many else [])
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(round3(F.col("x"))).collect()]
    assert got == [round(v, 3) for v in values]
    assert got[:2] == [9.062, 2.001]


def test_words_differ_from_counted_words(spark):
    r = spark.createDataFrame([("\u212a \u0130x",)], "t string").select(F.size(stylometry.words(F.col("t"))), stylometry.word_count(F.col("t"))).first()
    assert tuple(r) == (3, 1)


def test_words_phrases_and_pairs_take_one_bounded_pass(spark, monkeypatch):
    import pyarrow as pa

    from glyphsieve.operators import stylometry as style

    df = spark.createDataFrame([("a b c " * 9,)], "text string")
    plan = style.stylometry(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all(lower" not in plan and "sort_array" not in plan
    monkeypatch.setattr(style, "PIECE_BYTES", 200)
    got = list(style._pieces(iter([pa.array(["a b c " * 9, None, "x" * 500] * 20)])))
    assert max(map(len, got)) <= 5 and sum(map(len, got)) == 60
    assert [x["triples"] for part in got for x in part.to_pylist()] == [3, 0, 0] * 20
