import hashlib
import zlib
from itertools import groupby

import pytest

from glyphsieve.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, key string, place long, leaf string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """The root over some digests, and for each the siblings (left, right) on its way up."""
    at, ways = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for i, p in enumerate(at):
            run = runs[p // 16]
            ways[i].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
            at[i] = p // 16
        nodes = [sha(*run) for run in runs]
    return nodes[0] if nodes else None, ways


def brute(rows):
    """Rows (doc_id, source, lang, n_chars, text) -> what the query returns, sorted."""
    byte = lambda s: (s is not None, (s or "").encode())
    rows = sorted(rows, key=lambda r: (byte(r[1]), r[0] is not None, r[0] or 0, leaf_of(*r)))
    groups = [list(g) for _, g in groupby(rows, key=lambda r: r[1])]
    trees = [climb([leaf_of(*r) for r in g]) for g in groups]
    root, tops = climb([t[0] for t in trees])
    out = []
    for g, (subroot, ways), top in zip(groups, trees, tops):
        for r, way in zip(g, ways):
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            h, steps = leaf_of(*r[:4], text), way + top
            for left, right in steps:
                h = sha(left, h, right)
            out.append((r[0], leaf_of(*r), subroot, root, sha(*[a + b for a, b in steps]), h, h == root))
    return sorted(out, key=repr)


def answer(spark, rows, monkeypatch):
    """The query over rows, with columns more whose names the operator uses within."""
    table = spark.createDataFrame([(*r, "k", 3, "l") for r in rows], SCHEMA)
    monkeypatch.setattr(queries, "_table", lambda *_: table)
    found = queries.op13_merkle_manifest(spark, "")
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, found.collect()), key=repr)


def test_groups_of_all_sizes(spark, monkeypatch):
    sizes = {"one": 1, "two": 2, "Full": 16, "more": 17, "level": 256, "deep": 257, "": 3, None: 18}
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            i += 7919
            rows.append((i % 10007, source, ("en", None, "")[i % 3], i % 50 or None, f"Text {i % 11} É" if i % 5 else None))
    want = brute(rows)
    assert answer(spark, rows, monkeypatch) == want
    assert {w[-1] for w in want} == {True, False}


def test_more_groups_than_the_fanout(spark, monkeypatch):
    rows = [(i, f"s{i % 300}", "en", 1, "Aa") for i in range(600)]
    assert answer(spark, rows, monkeypatch) == brute(rows)


def test_nulls_ties_repeats_and_long_texts(spark, monkeypatch):
    rows = [(1, "a", None, None, None)] * 20 + [(1, "a", "x", 1, ""), (1, "a", "x", 1, "B"), (None, "a", "x", 1, "B"), (None, None, None, None, None)]
    rows += [(5, "a", "x", 2, "Long É " * 300_000), (-5, "a", "x", 2, "below zero")]
    assert answer(spark, rows, monkeypatch) == brute(rows)


@pytest.mark.parametrize("rows", [[(4, "s", "en", 1, "A")], [(1, "s", "en", 1, "Same"), (2, "s", "en", 1, "Same")], [(4, None, None, None, None), (5, "", None, None, None)]])
def test_small_tables(spark, monkeypatch, rows):
    assert answer(spark, rows, monkeypatch) == brute(rows)


def test_empty_table(spark, monkeypatch):
    assert answer(spark, [], monkeypatch) == []


def test_a_hot_group_is_placed_by_many_tasks(spark):
    from glyphsieve.llm.storage import Scratch

    rows = spark.range(4000).selectExpr("if(id % 3 = 0, concat('s', id % 97), 'hot') AS key", "cast(id as long) AS id", "'h' AS h")
    placed = merkle._placed(rows, ["id"], Scratch(spark, "placed")).toPandas()
    for key, g in placed.groupby("key"):
        assert g.sort_values("id").place.tolist() == list(range(len(g))) and set(g.n) == {len(g)}


def test_any_fields_group_and_id(spark):
    df = spark.createDataFrame([("b", 2, 1.5), ("a", 1, None)], "name string, part int, `x.y` double")
    out = merkle.manifest(df, id_col="name", group_col="part", fields=("name", "x.y")).orderBy("id").collect()
    assert [r["leaf"] for r in out] == [leaf_of("a", None), leaf_of("b", 1.5)]
    assert {r["root"] for r in out} == {sha(out[0]["subroot"], out[1]["subroot"])}
