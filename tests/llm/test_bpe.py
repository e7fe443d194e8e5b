import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from glyphsieve.llm import bpe
from glyphsieve.llm.queries import op4_bpe_round_trip, vocabulary_path

ODD = "aA'sS 1٣ÉéΣςσİıK\x1c\x1d\x85\xa0　​!?漢字が그́\U0001f600\U0001d400ǅ\xdfẞŉﬁ\x00\n\t\r\x0b\x0c'LL'veŸⅷ\xb2<|>"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def vocabulary():
    with open(vocabulary_path(), "rb") as f:
        return bpe.Vocabulary(f.read())


def texts():
    rng = random.Random(6)
    out = ["", " ", "a" * 5000, "ab" * 900, "xyz" * 100, "the " * 200, "<|startoftext|>hi<|endoftext|>", "<|endoftext|", "x<|startoftext|><|startoftext|>Y", "漢" * 400, "'s't're've'm'll'd", "!" * 700]
    return out + ["".join(rng.choice(ODD) for _ in range(rng.randint(1, 80))) for _ in range(1500)]


def test_ids_and_text_are_the_librarys(vocabulary, library):
    for text, ids in zip(texts(), vocabulary.encode(texts())):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert vocabulary.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


def test_trees_agree(vocabulary):
    """The tree of its own gives what the trees worked on together give."""
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    assert vocabulary.encode_words(words) == [vocabulary._alone(w.encode()) for w in words]


def test_documents(spark, library):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in op4_bpe_round_trip(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text, add_special_tokens=False).ids
        g = got[r.doc_id]
        assert g.n_tokens == len(ids) and g.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, None, "x"), (1, "hello", "x"), (1, "hello", "x"), (2, "", "x")], "doc_id long, text string, ids string")
    out = bpe.encode(df, vocabulary_path())
    assert sorted((r.id or 0, r.n_tokens, bytes(r.ids)) for r in out.collect()) == sorted([(0, 0, b""), (1, 1, out.filter("id = 1").first().ids), (1, 1, out.filter("id = 1").first().ids), (2, 0, b"")])
    back = {r.id: r.decoded for r in bpe.decode(out, vocabulary_path()).collect()}
    assert back == {None: "", 1: "hello</w>", 2: ""}
    assert bpe.encode_and_decode(df.limit(0), vocabulary_path()).count() == 0


def test_cache_starts_anew(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_BYTES", 300)
    for text in ("one two three four five", "six seven", "one two"):
        assert np.frombuffer(vocabulary.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_other_files_are_refused():
    with open(vocabulary_path("byte_bpe_50k.json"), "rb") as f, pytest.raises(ValueError):
        bpe.Vocabulary(f.read())


def test_every_code_point_alone_and_with_marks(vocabulary, library):
    """Frames around every code point that a text can hold, with and without combining marks."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    settled = [c for c in points if not bpe._UNSETTLED.search(c)]
    assert len(settled) > 30_000
    texts = [f.format(c) for f in ("a{0}b {0}1{0}A{0}Z {0}{0}", "a{0}b {0}1{0}\u0301A{0}Z", "\u0327{0}\u0301\u0323{0}") for c in settled]
    texts += [" ".join(f"a{c}b {c}1{c}A{c}Z {c}\u0301" for c in points[at : at + 64]) for at in range(0, len(points), 64)]
    for at in range(0, len(texts), 20_000):
        want = [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(texts[at : at + 20_000], add_special_tokens=False)]
        assert vocabulary.encode(texts[at : at + 20_000]) == want


def test_texts_of_some_megabytes(spark, library):
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(5000)]
    long = [" ".join(rng.choice(words) for _ in range(500_000)), "ab" * 300_000, "漢字 é\u0301 " * 100_000]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    for r in bpe.encode_and_decode(df, vocabulary_path()).collect():
        want = library.encode(long[r.id], add_special_tokens=False).ids
        assert bytes(r.ids) == np.array(want, "<u4").tobytes() and r.n_tokens == len(want)
        assert r.decoded == library.decode(want, skip_special_tokens=False)
