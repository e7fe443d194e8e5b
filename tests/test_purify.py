import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from glyphsieve.functions.codepoints import CATEGORIES
from glyphsieve.operators import purify as purify_module
from glyphsieve.operators.purify import PurifyOptions, purify

from . import model
from .test_scan import ODD, PLAIN


def run(spark, texts, options=PurifyOptions()):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return purify(df, options=options).orderBy("id").collect()


def test_space_switch(spark):
    kept, gone = run(spark, ["A\xa0B"], PurifyOptions(strip_spaces=False))[0], run(spark, ["A\xa0B"])[0]
    assert (kept.removed_count, gone.removed_count, gone.purified_text) == (0, 1, "AB")


def test_several_categories(spark):
    r = run(spark, ["a\u200bb\u200bc\u202e"])[0]
    assert r.removed_count == 3 and r.removed_by_category == {"zero_width": 2, "bidi_control": 1}


def test_keep_bidi(spark):
    r = run(spark, ["abc\u202edef"], PurifyOptions(strip_bidi=False))[0]
    assert r.removed_count == 0 and "\u202e" in r.purified_text


@pytest.mark.parametrize(
    "text, options, want",
    [
        ("cafe\u0301", PurifyOptions(), "caf\u00e9"),
        ("e\u200b\u0301", PurifyOptions(), "é"),
        ("\u2000", PurifyOptions(strip_spaces=False), "\u2002"),
        ("\u3000", PurifyOptions(strip_spaces=False, form="NFKC"), " "),
        ("\u3164", PurifyOptions(strip_hidden=False, form="NFKC"), "\u1160"),
        ("a\u200b", PurifyOptions(False, False, False, "none"), "a\u200b"),
    ],
)
def test_normalisation_comes_last(spark, text, options, want):
    r = run(spark, [text], options)[0]
    assert r.purified_text == want and r.purified_length == len(want) and r.original_length == len(text) and r.normalization_applied == options.form


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=ODD + PLAIN + "e\u0301", max_size=40), min_size=1, max_size=20), st.booleans(), st.booleans(), st.booleans(), st.sampled_from(["none", "NFC", "NFKC"]))
def test_against_the_model(spark, texts, hidden, bidi, spaces, form):
    options = PurifyOptions(hidden, bidi, spaces, form)
    off = [c for c in CATEGORIES if c not in options.categories]
    for t, r in zip(texts, run(spark, texts, options)):
        assert r.purified_text == model.purified(t, off, form)
        removed = [f[3] for f in model.findings(t) if f[3] not in off]
        assert r.removed_by_category == {c: removed.count(c) for c in set(removed)} and r.removed_count == len(removed)


def test_null_and_bad_form(spark):
    r = run(spark, [None])[0]
    assert r.purified_text is None and r.removed_count is None and r.removed_by_category is None and r.original_length is None
    with pytest.raises(ValueError):
        PurifyOptions(form="NFD")


def test_batches_are_normalised_in_bounded_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(purify_module, "PIECE_BYTES", 100)
    texts = [f"ﬁ{i}" * 5 for i in range(40)] + [None, "", "ﬁ" * 200]
    got = list(purify_module.normalised(pa.array(texts), "NFKC"))
    assert max(map(len, got)) <= 6 and [x for part in got for x in part.to_pylist()] == [t and t.replace("ﬁ", "fi") for t in texts]
