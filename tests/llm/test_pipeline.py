import math
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from glyphsieve.llm import language_id  # noqa: E402
from glyphsieve.llm.queries import vocabulary_path  # noqa: E402

from . import test_decontam, test_language_id, test_near_dedup, test_substring_dedup  # noqa: E402

SF = "/root/testdata/sf0.001"


def recognised(spark, rows):
    """The rows of whose words half are likelier in one of their languages than by chance, counted by hand."""
    trained = test_language_id.plain_train([(r.text, r.lang) for r in rows if r.lang and zlib.crc32(str(r.doc_id).encode()) % 3 != 1])
    docs = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in rows], "doc_id long, text string, lang string")
    sets = {r.id: r.languages for r in language_id.train_and_predict(docs).collect()}
    logs = {x: {b: math.log((c[b] + 0.5) / total) for b in c} for x, (c, total) in trained.items()}
    least = {x: math.log(0.5 / total) for x, (_, total) in trained.items()}
    out = []
    for r in rows:
        words = test_language_id.plain_words(r.text)
        fits = [max(sum(logs[x].get(b, least[x]) for b in w) for x in sets[r.doc_id]) > -len(w) * math.log(65536) for w in words] if sets[r.doc_id] else []
        if fits and 2 * sum(fits) >= len(words):
            out.append(r)
    return out


def test_run_against_brute_force(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    noise = [(10**6 + i, " ".join("".join(random.Random(i * 99 + j).choice("bcdfghjkqxzvw") for _ in range(8)) for j in range(40)), None, "web", 0) for i in range(5)]
    table.unionByName(spark.createDataFrame([*noise, (10**6 + 9, "12 34", "en", "web", 5)], table.schema)).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    (tmp_path / "benchmark.parquet").symlink_to(f"{SF}/benchmark.parquet")
    rows = sorted(spark.read.parquet(str(tmp_path / "documents.parquet")).select("doc_id", "text", "lang").collect())
    kept = recognised(spark, rows)
    assert {r.doc_id for r in rows} - {r.doc_id for r in kept} == {10**6 + i for i in (0, 1, 2, 3, 4, 9)}
    texts = {r.doc_id: r.text for r in kept}
    ids = list(texts)
    groups = test_near_dedup.brute([texts[i] for i in ids])
    texts = {ids[g]: texts[ids[g]] for g in sorted(set(groups))}
    cut = test_substring_dedup.brute(list(texts.values()), 35)
    texts = {i: (t if not gone else kept) for (i, t), (n, gone, kept) in zip(texts.items(), cut) if gone < n or n == 0}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    leaked = {d for d, _ in test_decontam.brute(list(texts.items()), items) | test_decontam.brute_short(list(texts.items()), items)}
    texts = {i: t for i, t in texts.items() if i not in leaked}
    library = Tokenizer.from_file(vocabulary_path())
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and 0 < len(got) < len(rows)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_stages_take_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x" * 100_000, None, None, None)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() <= len(rows)


def test_stages_take_clashing_columns_and_long_texts(spark):
    """Extra columns named as the operators name theirs, ties, repeated rows and a text of 2 MB pass every stage."""
    long = "some words of a long text that goes on and on " * 45_000
    rows = [(1, long, "en", "s", 0), (1, long, "en", "s", 0), (2, "the house and the garden were quiet", "en", "s", 0), (None, "der Hund und die Katze", "de", None, None)]
    docs = spark.createDataFrame([r + tuple("x" * 12) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, k string, l string, t string, id string, node string, row string, keeper string, c0 string, score string, ids string, kept string, root string")
    for _, stage in corpus_pipeline.STAGES:
        assert 1 <= stage(spark, docs, SF).count() <= len(rows)


def test_stages_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "BPE encoding and decoding"]
    assert corpus_pipeline.ORACLE_SQL is None
