"""Shards of equal row counts that keep linked documents together, by balanced label propagation.

Documents of equal text are linked.  Equal ones are interchangeable, so what moves is a number of them: the state is one
row for each text that occurs more than once, with how many of its documents lie in which shard (as many entries as
there are shards at most, however hot the text).  In every round each such text picks, among the shards its documents
lie in, those that could take them all, and asks to move the rest there.  Requests are summed by pair of shards; quotas
let through what the opposite direction or free places make up for, best gains first, so no shard ever holds more than
its share.  Texts in one shard are done and leave the rounds.  Documents without links fill what is free at the end.

Everything is DataFrame functions.  Numbers along an order (first places, slots) are exact sums over hash buckets, never
a window over a whole shard or a whole hot text; to the driver come tables of shard by shard only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch

#: Rows of a text or an order that one task puts in order; more are split into parts by a hash.
PART_ROWS = 1 << 20
#: A text's rows are dealt into so many parts at least, so that a hot text is never one task's.
LEAST_PARTS = 64
#: Requests of a pair of shards are let through cell by cell; within a gain there are so many.
CELLS = 16


def _running(df: DataFrame, value: str, by: list[str], order: list[str], parts: int) -> DataFrame:
    """df with before: the exact sum of value over the rows ahead in one order of each group.  The order is by buckets
    of a hash first, so each bucket is a task's and their sums make up for the rest."""
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(parts)))
    keys = [*by, "__bucket"]
    ahead = Window.unboundedPreceding, -1
    sums = df.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    sums = sums.select(*keys, F.coalesce(F.sum("__sum").over(Window.partitionBy(*by, F.lit(0)).orderBy("__bucket").rowsBetween(*ahead)), F.lit(0)).alias("__start"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*ahead)), F.lit(0))
    return df.withColumn("__own", own).join(sums, keys).withColumn("before", F.col("__start") + F.col("__own")).drop("__bucket", "__own", "__start")


def _loads(state: DataFrame, shards: int) -> list[int]:
    found = dict(state.select(F.explode("members").alias("m")).groupBy("m.shard").agg(F.sum("m.n")).collect())
    return [int(found.get(j, 0)) for j in range(shards)]


def _dealt(groups: DataFrame, shards: int) -> DataFrame:
    """(g, size, before) -> (g, members): the documents of each text dealt to the shards in turn, from where the text
    before left off, which is even to one row."""
    n = F.floor((F.col("size") - 1 - F.col("t")) / shards).cast("long") + 1
    rows = groups.select("g", "size", "before", F.explode(F.sequence(F.lit(0), (F.least("size", F.lit(shards)) - 1).cast("int"))).alias("t"))
    rows = rows.select("g", F.pmod(F.col("before") + F.col("t"), F.lit(shards)).cast("int").alias("shard"), n.alias("n"))
    return rows.groupBy("g").agg(F.collect_list(F.struct("shard", "n")).alias("members"))


def _requests(state: DataFrame, room: list[int], turn: int) -> DataFrame:
    """(g, i, j, n, cell): n documents of a text in more than one shard that would go from shard i to j.

    A shard could hold of a text what it has and what it has room for.  The shards that could hold most are its homes,
    as few as could hold it all; what lies elsewhere asks for one of them.
    """
    free = F.array(*[F.lit(max(r, 0)).cast("long") for r in room])
    size = F.aggregate("members", F.lit(0).cast("long"), lambda a, m: a + m["n"])
    rows = state.filter(F.size("members") > 1).withColumn("size", size)

    def seen(m: Column) -> Column:
        could = F.least(m["n"] + F.get(free, m["shard"]), F.col("size"))
        return F.struct((-could).alias("a"), (-m["n"]).alias("b"), F.xxhash64(F.col("g"), m["shard"], F.lit(turn)).alias("c"), m["shard"].alias("shard"), m["n"].alias("n"))

    rows = rows.withColumn("best", F.sort_array(F.transform("members", seen)))
    upto = lambda t: F.aggregate(F.slice("best", F.lit(1), t), F.lit(0).cast("long"), lambda s, m: s - m["a"])
    short = F.filter(F.sequence(F.lit(1), F.size("best")), lambda t: upto(t) < F.col("size"))
    rows = rows.withColumn("homes", F.least(F.size(short) + 1, F.size("best")))
    rows = rows.select("g", "best", "homes", F.explode(F.slice("best", F.col("homes") + 1, F.size("best"))).alias("m"))
    home = F.get("best", F.pmod(F.xxhash64("g", "m.shard", F.lit(turn)), F.col("homes")).cast("int"))
    rows = rows.select("g", F.col("m.shard").alias("i"), F.col("m.n").alias("n"), home.alias("home"))
    gain = F.lit(63) - F.floor(F.log2(F.col("home.n").cast("double"))).cast("int")  # larger homes first
    return rows.select("g", "i", F.col("home.shard").alias("j"), "n", (gain * CELLS + F.pmod(F.xxhash64("g", F.lit("cell")), F.lit(CELLS))).cast("int").alias("cell"))


def quotas(wanted: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many may go from shard to shard, so that no shard gains more than its room: what two shards exchange, what
    there is room for (and for what then leaves room behind), and what goes round in circles."""
    out, free = {(i, j): min(n, wanted.get((j, i), 0)) for (i, j), n in wanted.items()}, list(room)
    left: dict[int, dict[int, int]] = {i: {} for i in range(len(room))}
    for (i, j), n in sorted(wanted.items()):
        if n > out[i, j]:
            left[i][j] = n - out[i, j]

    def let(i: int, j: int, n: int) -> None:
        out[i, j] += n
        left[i][j] -= n
        if not left[i][j]:
            del left[i][j]

    going = True
    while going:
        going = False
        for i in left:
            for j in list(left[i]):
                if (n := min(left[i][j], free[j])) > 0:
                    let(i, j, n)
                    free[j] -= n
                    free[i] += n
                    going = True
    for v in range(len(room)):
        while circle := _circle(left, v):
            n = min(left[a][b] for a, b in circle)
            for a, b in circle:
                let(a, b, n)
        for ends in (left[v], *left.values()):  # no circle goes through v any more
            ends.pop(v, None)
        left[v] = {}
    return {k: n for k, n in out.items() if n}


def _circle(left: dict[int, dict[int, int]], v: int) -> list[tuple[int, int]]:
    """The edges of a shortest way from v back to itself."""
    back, now = {}, [v]
    while now:
        then = []
        for a in now:
            for b in left[a]:
                if b == v:
                    edges = [(a, b)]
                    while a != v:
                        edges.append((back[a], a))
                        a = back[a]
                    return edges
                if b not in back:
                    back[b] = a
                    then.append(b)
        now = then
    return []


def _let_through(asked: DataFrame, allowed: dict[tuple[int, int], int]) -> DataFrame:
    """(g, i, j, m): of each request what its pair's quota admits, cell by cell, and of the cell in which it runs out
    the same share of every request, so rounded that the quota is used to the last row: what goes one way must make up
    for what comes the other way."""
    most = max(max(pair) for pair in allowed) + 1
    quota = F.array(*[F.lit(allowed.get((i, j), 0)).cast("long") for i in range(most) for j in range(most)])
    cells = asked.groupBy("i", "j", "cell").agg(F.sum("n").alias("whole"))
    ahead = F.coalesce(F.sum("whole").over(Window.partitionBy("i", "j").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("ahead", ahead).filter((F.col("i") < most) & (F.col("j") < most))
    cells = cells.withColumn("part", F.least("whole", F.get(quota, F.col("i") * most + F.col("j")) - F.col("ahead"))).filter("part > 0")
    # a row for each pair of shards and cell: 24 x 23 x 64 x CELLS at most, whatever the input
    met = asked.join(cells.select("i", "j", "cell", "part", "whole"), ["i", "j", "cell"])
    whole = met.filter("part = whole").select("g", "i", "j", F.col("n").alias("m"))
    some = met.filter("part < whole").withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("i", "j", "cell").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    share = lambda n: F.floor(n.cast("decimal(19,0)") * F.col("part").cast("decimal(18,0)") / F.col("whole").cast("decimal(18,0)")).cast("long")
    some = some.select("g", "i", "j", (share(F.col("ahead") + F.col("n")) - share(F.col("ahead"))).alias("m"))
    return whole.unionByName(some).filter("m > 0")


def _propagate(state: DataFrame, caps: list[int], rounds: int, scratch: Scratch) -> tuple[DataFrame, list[int]]:
    """The state after the rounds, and the rows in each shard."""
    shards, slack = len(caps), max(1, min(caps) // 8)
    settled, still = [], state  # texts that lie in one shard, and the others
    fixed, idle = [0] * shards, 0
    for turn in range(rounds):
        done = still.filter(F.size("members") == 1)
        settled.append(done)
        loads = [a + b for a, b in zip(fixed, _loads(still, shards))]
        fixed = [a + b for a, b in zip(fixed, _loads(done, shards))]
        room = [c - n for c, n in zip(caps, loads)]
        still = still.filter(F.size("members") > 1)
        # every other turn asks for places that an exchange may free, the turns between only for those that are free
        asked = scratch.write(_requests(still, [r + (turn % 2 == 0) * slack for r in room], turn), "asked")
        wanted = {(i, j): int(n) for i, j, n in asked.groupBy("i", "j").agg(F.sum("n")).collect()}
        allowed = quotas(wanted, room)
        if not wanted:
            break
        idle = 0 if sum(allowed.values()) * 1000 > sum(wanted.values()) else idle + 1
        if idle == 2:
            break
        if idle:
            continue
        moves = scratch.write(_let_through(asked, allowed), "moves")
        now = still.select("g", F.inline("members")).unionByName(moves.select("g", F.col("i").alias("shard"), (-F.col("m")).alias("n"))).unionByName(moves.select("g", F.col("j").alias("shard"), F.col("m").alias("n")))
        now = now.groupBy("g", "shard").agg(F.sum("n").alias("n")).filter("n > 0")
        still = scratch.write(now.groupBy("g").agg(F.collect_list(F.struct("shard", "n")).alias("members")), "state")
        scratch.drop(asked, moves)
    for done in settled:
        still = still.unionByName(done)
    out = scratch.write(still, "settled")
    return out, _loads(out, shards)


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, rounds: int = 16) -> DataFrame:
    """One row per input row: id, size (UTF-8 bytes of the text plus 8), crc (of the text's UTF-8 bytes), shard, slot.

    Shards differ by one row at most, the first ones having more; slots count from 0 without a gap.  Documents of
    equal text share a shard wherever the shares leave room; a text with more rows than a share fills as few shards as
    the rounds achieve.

    Defined cases: a null text counts as an empty one, so all of these are linked; null ids are placed like any other;
    repeated rows are rows of their own; fewer rows than shards leave the last shards empty; an empty table gives no
    rows.  Other columns are not read, whatever their names.  Texts are read once, in the first pass; what moves after
    it are ids and 128-bit digests, which are what decides that texts are equal.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    t = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), t.alias("t"))
    rows = rows.select("id", (F.octet_length("t") + 8).cast("long").alias("size"), F.crc32(F.col("t").cast("binary")).alias("crc"), F.unhex(F.md5(F.col("t").cast("binary"))).alias("g"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    rows = scratch.write(rows, "rows")  # so that a row keeps its salt
    total = rows.count()
    parts = max(LEAST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART_ROWS)
    rows = rows.withColumn("salt", F.pmod("salt", F.lit(parts)))
    caps = [total // shards + (j < total % shards) for j in range(shards)]

    cells = scratch.write(rows.groupBy("g", "salt").agg(F.count("*").alias("n")), "cells")
    groups = scratch.write(cells.groupBy("g").agg(F.sum("n").alias("size"), F.min("salt").alias("salt")), "groups")
    linked = groups.filter("size > 1").select("g", "size")
    state = scratch.write(_dealt(_running(linked, "size", [], ["g"], parts), shards), "state")
    state, loads = _propagate(state, caps, rounds, scratch)

    # linked documents: by the place in its text a document is in the shard up to whose bound the place is
    portions = scratch.write(_running(state.select("g", F.inline("members")), "n", ["shard"], ["g"], parts), "portions")
    by_text = portions.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("shard", "n", "before"))).alias("bins"))
    starts = cells.join(linked.select("g"), "g", "left_semi").withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    plan = starts.join(by_text, "g").select("g", "salt", "start", "bins")
    # the others: by their number in all of them they fill the free places of shard after shard
    lone = _running(groups.filter("size = 1").withColumn("one", F.lit(1).cast("long")), "one", [], ["g"], parts)
    at, bounds = 0, []
    for c, n in zip(caps, loads):
        bounds.append((at, at + c - n, n))
        at += c - n
    which = F.size(F.filter(F.array(*[F.lit(b).cast("long") for _, b, _ in bounds]), lambda b: b <= F.col("before"))).alias("shard")
    begin = F.get(F.array(*[F.lit(n - a).cast("long") for a, _, n in bounds]), which)
    bins = F.array(F.struct(which, F.lit(1).cast("long").alias("n"), (F.col("before") + begin).alias("before")))
    plan = plan.unionByName(lone.select("g", "salt", F.lit(0).cast("long").alias("start"), bins.alias("bins")))

    place = F.row_number().over(Window.partitionBy("g", "salt").orderBy("id")) - 1
    met = rows.withColumn("place", place.cast("long")).join(plan, ["g", "salt"]).withColumn("place", F.col("place") + F.col("start"))
    # walk the bins: what is left of the place after those before, and the bin it falls into
    start = F.struct(F.col("place").alias("left"), F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot"))

    def step(a: Column, b: Column) -> Column:
        here = a["shard"].isNull() & (a["left"] < b["n"])
        return F.struct((a["left"] - F.when(a["shard"].isNull() & ~here, b["n"]).otherwise(0)).alias("left"), F.when(here, b["shard"]).otherwise(a["shard"]).alias("shard"), F.when(here, b["before"] + a["left"]).otherwise(a["slot"]).alias("slot"))

    found = met.withColumn("at", F.aggregate("bins", start, step))
    return found.select("id", "size", "crc", F.col("at.shard").alias("shard"), F.col("at.slot").alias("slot"))
