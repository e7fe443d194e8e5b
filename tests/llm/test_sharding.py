import zlib
from collections import Counter, defaultdict

import pytest

from glyphsieve.llm import queries, sharding

SCHEMA = "doc_id long, text string, shard string, g int, size int"


def answer(spark, rows, monkeypatch):
    """The query over (doc_id, text) rows; held to the rules that hold for any answer."""
    table = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in rows], SCHEMA)
    monkeypatch.setattr(queries, "_table", lambda *_: table)
    got = queries.op12_sharding(spark, "").collect()
    raw = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(raw(t)) + 8, zlib.crc32(raw(t))) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 24
    sizes = [len(slots[j]) for j in range(24)]
    assert sizes == [len(rows) // 24 + (j < len(rows) % 24) for j in range(24)]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got


def spread(got):
    """By text (its size and CRC): how many of its rows lie in which shard."""
    out = defaultdict(Counter)
    for r in got:
        out[r.size, r.text_crc32][r.shard] += 1
    return out


def cut(counts):
    n = sum(counts.values())
    return (n * n - sum(c * c for c in counts.values())) // 2


def least_cut(n, share):
    """Of n equal documents: as many whole shards as they fill, the rest together."""
    return cut(Counter({i: min(share, n - i * share) for i in range(-(-n // share))}))


def test_groups_stay_together_where_there_is_room(spark, monkeypatch):
    rows, i = [], 0
    for g in range(120):
        for _ in range(2 + g % 9):
            rows.append(((i * 7919) % 100003, f"text {g} é"))
            i += 1
    rows += [(200_000 + i, f"alone {i}") for i in range(300)]
    assert all(len(s) == 1 for s in spread(answer(spark, rows, monkeypatch)).values())


def test_a_hot_text_fills_whole_shards(spark, monkeypatch):
    rows = [(i, "hot" if i % 3 == 0 else f"pair {i // 6}" if i % 3 == 1 else f"alone {i}") for i in range(2400)]
    found = spread(answer(spark, rows, monkeypatch))
    hot = found.pop((11, zlib.crc32(b"hot")))
    assert sum(hot.values()) == 800 and cut(hot) <= 1.15 * least_cut(800, 100)
    assert sum(cut(s) for s in found.values()) <= 0.05 * sum(sum(s.values()) > 1 for s in found.values())


def test_pairs_without_any_free_place(spark, monkeypatch):
    rows = [(i, f"pair {i // 2}") for i in range(1200)]
    assert sum(cut(s) for s in spread(answer(spark, rows, monkeypatch)).values()) <= 30  # of 600


def test_one_text_only(spark, monkeypatch):
    found = spread(answer(spark, [(i, "same") for i in range(500)], monkeypatch))
    assert len(found) == 1


def test_nulls_empties_repeats_and_long_texts(spark, monkeypatch):
    long = "word é " * 300_000
    rows = [(1, None), (2, ""), (3, None), (None, "x"), (None, "x"), (5, "y"), (5, "y"), (5, "y"), (6, long), (7, long), (8, "A\x00b")]
    rows += [(100 + i, f"alone {i}") for i in range(60)]
    assert all(len(s) == 1 for s in spread(answer(spark, rows, monkeypatch)).values())


@pytest.mark.parametrize("rows", [[], [(1, "a")], [(1, "a"), (2, "a"), (3, "b")]])
def test_small_tables(spark, monkeypatch, rows):
    answer(spark, rows, monkeypatch)


def test_quotas_keep_every_shard_within_its_share():
    wanted = {(0, 1): 10, (1, 0): 4, (2, 1): 5, (1, 2): 1, (0, 2): 3}
    room = [0, 2, 1]
    got = sharding.quotas(wanted, room)
    for j in range(3):
        inward, outward = sum(n for (a, b), n in got.items() if b == j), sum(n for (a, b), n in got.items() if a == j)
        assert inward - outward <= room[j]
    assert all(got[k] <= wanted[k] for k in got) and got[1, 0] == 4


def test_running_sums_are_exact(spark):
    df = spark.range(1000).selectExpr("cast(id as long) AS g", "id % 7 AS n", "id % 3 AS k")
    got = sharding._running(df, "n", ["k"], ["g"], 16).toPandas()
    for _, x in got.groupby("k"):
        x = x.sort_values(["before", "n"])
        assert (x.before.to_numpy() == x.n.cumsum().to_numpy() - x.n.to_numpy()).all()


def test_the_plan_has_no_python_and_no_rdd(spark):
    docs = spark.createDataFrame([(i, f"t{i % 9}") for i in range(40)], "doc_id long, text string")
    asked = sharding._requests(spark.sql("SELECT unhex('aa') AS g, array(named_struct('shard', 0, 'n', 3L), named_struct('shard', 1, 'n', 1L)) AS members"), [5] * 24, 0)
    plans = [df._jdf.queryExecution().toString() for df in (sharding.shard(docs), sharding._let_through(asked, {(1, 0): 1}))]
    assert not any(word in plan for plan in plans for word in ("Python", "Arrow", "Pandas", "ExternalRDD", "SerializeFromObject"))
