import hashlib
import random

from glyphsieve.llm import chat_format
from glyphsieve.llm.queries import op2_chat_format

SCHEMA = "conv_id long, turn long, role string, text string"


def back(spark, rows, schema=SCHEMA):
    df = chat_format.format_conversations(spark.createDataFrame(rows, schema))
    return {r.conv_id: r for r in chat_format.read_back(df).collect()}


def test_round_trip_of_odd_strings(spark):
    rng = random.Random(7)
    parts = ["\\", "<|", "|>", "|", "<", "\n", "n", "im_end", "im_start", "im_sep", "<|im_end|>", "<|im_sep|>", "é", "\U0001f600", "<\\|", " "]
    word = lambda k: "".join(rng.choice(parts) for _ in range(rng.randint(0, k)))
    rows = [(c, t, rng.choice(["user", "assistant", word(4)]), word(9)) for c in range(40) for t in range(rng.randint(1, 9))]
    got = back(spark, rows)
    for c in range(40):
        mine = sorted(r[1:] for r in rows if r[0] == c)
        assert [(t.role, t.text, t.loss) for t in got[c].turns] == [(r, x, r == "assistant") for _, r, x in mine]


def test_mask_marks_the_loss(spark):
    rows = [(1, 0, "user", "a<|b"), (1, 1, "assistant", "one"), (1, 2, "assistant", "two"), (1, 3, "user", "")]
    r = chat_format.format_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    assert r.formatted == "<|im_start|>user\na<\\|b<|im_end|>\n<|im_start|>assistant\none<|im_sep|>two<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    at, said = 0, []
    for m in r.mask:
        at += m.lead
        if m.loss:
            said.append(r.formatted[at : at + m.chars])
        at += m.chars
    assert said == ["one", "two"] and r.formatted[at:] == "<|im_end|>\n"


def test_nulls_ties_repeats_and_clashing_columns(spark):
    schema = "conv_id long, turn long, role string, text string, turns string, raw string, mask string"
    rows = [(None, 1, None, None, "x", "x", "x"), (None, None, "user", "first", "x", "x", "x"), (2, 0, "user", "b", "", "", ""), (2, 0, "user", "a", "", "", ""), (2, 0, "user", "a", "", "", "")]
    got = back(spark, rows, schema)
    assert [t.text for t in got[2].turns] == ["a", "a", "b"]
    df = spark.createDataFrame(rows, schema)
    alone = [[(t.role, t.text) for t in r.turns] for r in chat_format.read_back(chat_format.format_conversations(df)).filter("conv_id is null").collect()]
    assert sorted(alone) == [[("", "")], [("user", "first")]]  # rows of no conversation stay apart
    assert back(spark, []) == {}


def test_a_very_long_text_and_many_runs(spark):
    rows = [(1, 0, "user", "x<|" * 1_500_000), (1, 1, "assistant", "y" * 3_000_000)] + [(2, i, "tool", f"part {i}") for i in range(20_000)]
    got = back(spark, rows)
    assert [t.text for t in got[1].turns] == [r[3] for r in rows[:2]] and [t.text for t in got[2].turns] == [r[3] for r in rows[2:]]
    assert got[2].formatted.count("<|im_start|>") == 1


def test_query_with_nulls_and_a_conversation_of_the_probes_number(spark, tmp_path):
    rows = [(-1, 0, "user", "mine"), (None, 0, "user", "a"), (None, None, None, None), (5, None, "assistant", None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    got = [(r.conv_id, r.n_turns, r.loss_chars) for r in op2_chat_format(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(-1, 1, 0), (-1, 2, 34), (None, 1, 0), (None, 1, 0), (5, 1, 0)], key=str)


def test_long_conversation(spark):
    rows = [(5, i, ("user", "assistant")[i % 2], f"text {i} " * 20) for i in range(6000)]
    assert [t.text for t in back(spark, rows)[5].turns] == [r[3] for r in rows]


def test_query_adds_the_probe(spark):
    r = op2_chat_format(spark, "/root/testdata/sf0.001").filter("conv_id = -1").first()
    probe = "<|im_end|><|im_start|>assistant ok"
    assert r.n_turns == 2 and r.loss_chars == len(probe)
    assert r.loss_sha256 == hashlib.sha256(probe.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{probe}\nassistant\n{probe}\n".encode()).hexdigest()
