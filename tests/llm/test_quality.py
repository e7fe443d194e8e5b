import math

import numpy as np

from glyphsieve.llm import quality
from glyphsieve.llm.queries import op5_quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    """On labels that no step has seen; label_use says which these are."""
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in op5_quality(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    unseen = [(got[r.doc_id].score, r.quality > 0) for r in labels if got[r.doc_id].label_use == "held out"]
    assert 250 < len(unseen) < 0.15 * len(labels)
    assert sum((s >= 0.5) == y for s, y in unseen) >= 0.95 * len(unseen)
    assert all(0 <= x <= 1 for g in got.values() for x in (g.p_text, g.p_meta, g.score))


# -- a plain version: the same models as dictionaries of counts ---------------------------------------------------------


def plain(rows, rounds):
    """rows: (id, text features, words, meta features, label or None, fold) -> id: (text score, meta score), counts."""
    views = [lambda r: ([(j, x) for j, x in enumerate(r[1])], r[2]), lambda r: ([(j, x) for j, x in enumerate(r[3])], [])]
    sizes = [[quality.BINS] * len(quality.TEXT_FEATURES), list(quality.META_BINS)]

    def count(chosen, view, weight, into):
        for r, label in chosen:
            bins, words = view(r)
            into["n"][label] += weight
            for key in [("b", x) for x in bins] + [("w", w) for w in words]:
                into[key] = into.get(key, [0, 0])
                into[key][label] += weight

    def score(model, view, size, r):
        bins, words = view(r)
        n = model["n"]
        odds = math.log((n[1] + 1) / (n[0] + 1))
        for j, x in bins:
            c = model.get(("b", (j, x)), [0, 0])
            odds += math.log((c[1] + 1) / (n[1] + size[j])) - math.log((c[0] + 1) / (n[0] + size[j]))
        held = 0
        for w in words:
            c = model.get(("w", w), [0, 0])
            held += math.log((c[1] + 1) / (n[1] + 2)) - math.log((c[0] + 1) / (n[0] + 2))
        return odds + held / math.sqrt(max(1, len(words)))

    def fitted(extra):
        out = []
        for view, more in zip(views, extra):
            model = {"n": [0, 0]}
            count([(r, r[4]) for r in rows if r[4] is not None and r[5] < quality.TRAIN], view, 1, model)
            count(more, view, quality.PSEUDO_WEIGHT, model)
            out.append(model)
        return out

    tune = [r for r in rows if r[4] is not None and quality.TRAIN <= r[5] < quality.TUNE]
    models = fitted([[], []])
    for _ in range(rounds):
        calls = []
        for model, view, size in zip(models, views, sizes):
            edges = quality.View((4,))
            edges.set_sure(np.array([score(model, view, size, r) for r in tune]), np.array([r[4] for r in tune]))
            told = [(r, score(model, view, size, r)) for r in rows if r[4] is None]
            calls.append([(r, 1 if s >= edges.sure[1] else 0) for r, s in told if s >= edges.sure[1] or s <= edges.sure[0]])
        models = fitted(calls[::-1])
    return {r[0]: tuple(score(m, v, z, r) for m, v, z in zip(models, views, sizes)) for r in rows}, models


def test_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = quality.features(docs, "doc_id", "text", "source", "lang", "n_chars").withColumn("fold", quality.fold(quality.F.col("id"))).collect()
    numbers = lambda x: np.frombuffer(bytes(x), np.uint16).tolist()
    rows = [(r.id, numbers(r.text), numbers(r.words), numbers(r.meta), labels.get(r.id), r.fold) for r in found]
    want, models = plain(rows, quality.ROUNDS)
    assert sum(models[1]["n"]) > sum(1 for r in rows if r[4] is not None and r[5] < quality.TRAIN)  # pseudo-labels counted
    got = {r.doc_id: r for r in op5_quality(spark, SF).collect()}
    for which, name in ((0, "p_text"), (1, "p_meta")):
        tune = [r for r in rows if r[4] is not None and quality.TRAIN <= r[5] < quality.TUNE]
        curve = quality.isotonic(np.array([want[r[0]][which] for r in tune]), np.array([r[4] for r in tune]))
        assert all(abs(np.interp(w[which], *curve) - got[i][name]) < 1e-6 for i, w in want.items())


def test_views_teach_each_other(spark):
    """Labels only where both views agree; sources tell the quality of texts that the text view alone can't judge."""
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(600):
        good = i % 2 == 0
        words = ["plain", "words", "here", "and", "there", "again"] if good else ["W!!", "X??", "Y##", "Z%%"]
        docs.append((i, " ".join(rng.choice(words, 40)), "fine" if good else "spam", "en", 200))
        if i < 200:
            labels.append((i, int(good)))
    table = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long")
    got = {r.id: r for r in quality.co_train(table, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert all((got[i].score > 0.5) == (i % 2 == 0) for i in range(600))
    assert all((got[i].p_meta > 0.5) == (i % 2 == 0) for i in range(600))


def test_without_labels_nulls_and_repeats(spark):
    rows = [(1, "a b", "s", "en", 3), (1, "a b", "s", "en", 3), (None, None, None, None, None), (2, "", "s", None, -4), (3, "x" * 200_000, "s", "en", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").withColumn("label", quality.F.lit(1)).withColumn("t", quality.F.lit("x"))
    for labels in ([], [(1, 1)], [(1, None), (None, 1)], [(1, 1), (1, 0)]):
        got = quality.co_train(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert len(got) == 5 and all(r.score == 0.5 for r in got)
    many = spark.createDataFrame([(i % 7 or None, "w" * (i % 5) + " x", "s", "en", 1) for i in range(300)] + [(500, "long words " * 500_000, "s", "en", 5_500_000)], "doc_id long, text string, source string, lang string, n_chars long")
    assert quality.co_train(many, spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, quality int")).count() == 301
    assert quality.co_train(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_isotonic_is_monotone_and_right():
    rng = np.random.default_rng(3)
    score = np.round(rng.normal(size=3000), 2)
    label = (rng.random(3000) < 1 / (1 + np.exp(-2 * score))).astype(int)
    x, p = quality.isotonic(score, label)
    assert (np.diff(p) >= 0).all() and (np.diff(x) >= 0).all()
    assert abs(np.interp(0.0, x, p) - 0.5) < 0.1 and np.interp(2.0, x, p) > 0.9


def test_sure_tails_are_precise():
    view = quality.View((4,))
    score, label = np.arange(1000) / 100, (np.arange(1000) > 500).astype(int)
    view.set_sure(score, label)
    calls = view.calls(score)
    for c in (0, 1):
        assert (label[calls == c] == c).mean() >= quality.PRECISION and (calls == c).sum() > 400
    view.set_sure(score, np.random.default_rng(0).integers(0, 2, 1000))
    assert (view.calls(score) >= 0).sum() < 100


def test_bins_do_not_depend_on_neighbours():
    texts = ["Hello there!\nHello there!", "", "1234 AAA", "word " * 50, "éé !! ?? x"]
    data = [t.encode() for t in texts]
    off = np.cumsum([0] + [len(d) for d in data])
    number, first = quality.word_numbers(np.frombuffer(b"".join(data), np.uint8), off)
    assert np.diff(first).tolist() == [2, 0, 2, 1, 4]  # each word once
    whole = quality.text_bins(np.frombuffer(b"".join(data), np.uint8), off)
    for d, w in zip(data, whole):
        assert (quality.text_bins(np.frombuffer(d, np.uint8), np.array([0, len(d)]))[0] == w).all()
