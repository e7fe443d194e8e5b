"""Ledgers applied by position, against a walk over the characters."""

import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphsieve.operators import purify, replay, scan

LEDGER = "doc_id long, position long, codepoint string, category string"
ALL = purify.PurifyOptions(form="none")


def walk(text, rows, options):
    """(text, removed by category, stale) of one text and its (position, codepoint, category) rows."""
    first = {}
    for p, code, kind in sorted((r for r in rows if r[0] is not None and r[2] in options.categories), key=lambda r: (r[0], r[2], int(r[1][2:], 16) if r[1] else -1)):
        first.setdefault(p, (code, kind))
    kept, removed, stale = [], Counter(), 0
    for p, (code, kind) in first.items():
        if not 0 <= p < len(text) or (code and f"U+{ord(text[p]):04X}" != code):
            stale += 1
        else:
            removed[kind] += 1
            kept.append(p)
    out = "".join(c for i, c in enumerate(text) if i not in set(kept))
    return unicodedata.normalize(options.form, out) if options.form != "none" else out, dict(removed), stale


def test_a_full_ledger_does_what_purify_does(spark):
    text = ["plain", "a​b‮c d", "﻿\U000e0041é́😀‍😀", "", None, "​" * 500]
    df = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    for options in (purify.PurifyOptions(), purify.PurifyOptions(strip_bidi=False, form="none"), purify.PurifyOptions(False, False, False, "NFKC")):
        got = replay.replay(df, scan.ledger(df, ["doc_id"]), ["doc_id"], options=options)
        want = purify.purify(df, options=options)
        assert sorted(map(str, got.drop("stale_count").select(*want.columns).collect())) == sorted(map(str, want.collect()))
        assert {r.stale_count for r in got.collect()} == {0, None}


def test_stale_repeated_and_odd_findings(spark):
    docs = [(1, "x​y​z"), (1, "x​y"), (2, None), (None, "a​"), (3, "no findings"), (4, ""), (5, "É ")]
    rows = [
        (1, 1, "U+200B", "zero_width"), (1, 1, "U+200B", "zero_width"), (1, 1, None, "zero_width"), (1, 3, "U+200B", "zero_width"), (1, 2, "U+200B", "zero_width"),
        (1, -1, None, "control"), (1, 99, None, "control"), (1, None, "U+200B", "zero_width"), (1, 0, "U+0078", None), (1, 0, "U+0078", "bidi_control"),
        (2, 0, None, "control"), (None, 1, "U+200B", "zero_width"), (4, 0, "U+200B", "zero_width"), (5, 1, "U+00A0", "unicode_space"), (5, 0, "odd", "control"), (77, 0, None, "control"),
    ]
    df, ledger = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, LEDGER)
    options = purify.PurifyOptions(strip_bidi=False, form="none")
    got = replay.replay(df, ledger, ["doc_id"], options=options).collect()
    known = [(i, p, c if c and c.startswith("U+") else None, k) for i, p, c, k in rows]
    want = []
    for i, text in docs:
        told = walk(text, [r[1:] for r in known if r[0] == i], options) if text is not None else (None, None, None)
        want.append((i, text, *told))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.text, r.purified_text, r.removed_by_category, r.stale_count)) for r in got)


def test_keys_of_several_columns_and_clashing_names(spark):
    df = spark.createDataFrame([("a", 1, "x​", "keep"), ("a", 2, "x​", "me")], "f string, p int, text string, `c.u` string")
    ledger = spark.createDataFrame([("a", 2, 1, "zero_width")], "f string, p int, position int, category string")
    got = {r.p: r for r in replay.replay(df, ledger, ["f", "p"], options=ALL).collect()}
    assert (got[1].purified_text, got[2].purified_text, got[2]["c.u"]) == ("x​", "x", "me")


def test_empty_tables(spark):
    df, none = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], LEDGER)
    assert replay.replay(df, none, ["doc_id"], options=ALL).first()["purified_text"] == "a"
    assert replay.replay(df.limit(0), none, ["doc_id"], options=ALL).count() == 0


def test_long_texts_and_many_findings(spark):
    text = "aé​😀" * 400_000
    df = spark.createDataFrame([(1, text), (2, "b​")], "doc_id long, text string")
    ledger = df.filter("doc_id = 1").select("doc_id", F.explode(F.sequence(F.lit(2), F.lit(1_599_999), F.lit(4))).alias("position"), F.lit("U+200B").alias("codepoint"), F.lit("zero_width").alias("category"))
    got = {r.doc_id: r for r in replay.replay(df, ledger, ["doc_id"], options=ALL).collect()}
    assert got[1].purified_text == "aé😀" * 400_000 and got[1].removed_count == 400_000 and got[2].removed_count == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(st.characters(exclude_categories=["Cs"]), max_size=12), st.lists(st.integers(-2, 14), max_size=6, unique=True)), min_size=1, max_size=5))
def test_cutting_equals_a_walk(cases):
    texts, places = [t for t, _ in cases], [sorted(p) for _, p in cases]
    out, counts, used = replay.cut(pa.array(texts), pa.array(places, pa.list_(pa.int64())), pa.array([[-1] * len(p) for p in places], pa.list_(pa.int64())))
    assert out.to_pylist() == ["".join(c for i, c in enumerate(t) if i not in p) for t, p in zip(texts, places)]
    inside = [sum(0 <= i < len(t) for i in p) for t, p in zip(texts, places)]
    assert counts[:, 0].tolist() == inside and counts.sum(1).tolist() == [len(p) for p in places] and int(np.sum(used)) == sum(inside)


@pytest.mark.parametrize("size", [10, 70_000])
def test_findings_with_a_dimension(spark, size):
    found = spark.createDataFrame([(i, "U+200B" if i % 3 else f"U+{i:04X}") for i in range(30)] + [(99, None)], "id int, codepoint string")
    rows = [(f"U+{i:04X}", f"name {i}") for i in range(size)] + [("U+200B", "zwsp"), ("U+200B", "again"), (None, "nothing")]
    got = {r.id: r.label for r in scan.described(found, spark.createDataFrame(rows, "codepoint string, label string")).collect()}
    # a repeated key doesn't double a finding: the least row counts
    want = {i: ("again" if size < 9000 else min("again", "name 8203")) if i % 3 else f"name {i}" if i < size else None for i in range(30)} | {99: None}
    assert got == want
    with pytest.raises(ValueError, match="id"):
        scan.described(found, spark.createDataFrame([("U+200B", 1)], "codepoint string, id int"))
