"""Admission against a walk over the requests, and the stream against the batch."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from glyphsieve.operators import admission
from glyphsieve.operators.admission import Rate
from glyphsieve.streaming import admission as stream_admission
from glyphsieve.streaming import batches

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, user_id long, ts timestamp, client string, at int"


def requests(n, users, seconds, seed=1):
    rnd = random.Random(seed)
    return [(i, rnd.choice([0, 0, rnd.randrange(users)]), T0 + dt.timedelta(milliseconds=rnd.randrange(seconds * 1000))) for i in range(n)]


def walk(rows, rate):
    """event id -> (start of its window, admitted)"""
    taken, out = defaultdict(int), {}
    for i, user, ts in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[2], r[0])):
        start = int((ts - dt.datetime(1970, 1, 1)).total_seconds() // rate.seconds * rate.seconds)
        taken[user, start] += 1
        out[i] = (start, taken[user, start] <= rate.limit)
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def seconds(ts):
    return int((ts - dt.datetime(1970, 1, 1)).total_seconds()) if ts else None


@pytest.fixture(autouse=True)
def utc(monkeypatch):
    monkeypatch.setenv("TZ", "UTC")
    import time

    time.tzset()


@pytest.mark.parametrize("rate", [Rate(), Rate(3, 60), Rate(1, 7), Rate(0, 60)])
def test_requests_are_taken_in_order(spark, rate):
    rows = requests(900, 12, 400)
    got = {r.event_id: (seconds(r.window_start), r.admitted) for r in admission.admit(table(spark, rows).repartition(7), rate=rate).collect()}
    assert got == walk(rows, rate)
    sums = defaultdict(lambda: [0, 0])
    users = {r[0]: r[1] for r in rows}
    for i, (start, ok) in got.items():
        sums[users[i], start][0] += 1
        sums[users[i], start][1] += ok
    told = {(r.client, seconds(r.window_start)): [r.requests, r.admitted] for r in admission.totals(table(spark, rows), rate=rate).collect()}
    assert told == dict(sums)


def test_nulls_ties_repeats_and_borders(spark):
    edge = T0 + dt.timedelta(seconds=60)
    rows = [(1, 7, edge), (2, 7, edge), (3, 7, edge - dt.timedelta(microseconds=1)), (4, 7, T0), (5, 7, T0), (6, None, T0), (7, 7, None), (8, 9, T0), (8, 9, T0), (9, 9, T0), (10, 5, dt.datetime(1969, 12, 31, 23, 59, 59))]
    got = sorted((r.event_id, r.admitted) for r in admission.admit(table(spark, rows), rate=Rate(1, 60)).collect())
    # of a client at one time the smaller id; the rows of id 8 are one request told twice
    assert got == [(1, True), (2, False), (3, False), (4, True), (5, False), (6, True), (7, False), (8, True), (8, True), (9, False), (10, True)]
    assert admission.admit(table(spark, []), rate=Rate(1, 60)).count() == 0


def test_rates_are_checked():
    for bad in ((-1, 60), (1, 0)):
        with pytest.raises(ValueError):
            Rate(*bad)


def test_a_hot_client_is_cut_down_before_the_shuffle(spark):
    plan = admission.last_admitted(table(spark, requests(10, 2, 60)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 or "WindowGroupLimit" in plan


def folder(spark, tmp_path, rows, files):
    rnd = random.Random(3)
    rnd.shuffle(rows)
    for k in range(files):
        table(spark, rows[k::files]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")


def test_stream_and_batch_agree_in_any_order_of_arrival(spark, tmp_path):
    rate, rows = Rate(4, 60), requests(600, 9, 300, 5)
    folder(spark, tmp_path, rows, 5)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = stream_admission.admissions(stream, rate=rate)
    batches.run(out, lambda b: b, {"all": F.lit(True)}, f"{tmp_path}/out", f"{tmp_path}/state", "update").awaitTermination()
    newest = {}
    for r in batches.read(spark, f"{tmp_path}/out", "all").collect():
        key = (r.client, seconds(r.window_start))
        newest[key] = max(newest.get(key, (0,)), (r.requests, r.admitted, r.refused, r.last_id))
    want = {(r.client, seconds(r.window_start)): (r.requests, r.admitted, r.refused) for r in admission.totals(table(spark, rows), rate=rate).collect()}
    last = {(r.client, r.window): r.last.id for r in admission.last_admitted(table(spark, rows), rate=rate).collect()}
    assert {k: v[:3] for k, v in newest.items()} == want and {k: v[3] for k, v in newest.items() if v[3] is not None} == last


@pytest.mark.parametrize("seconds_", [7, 60, 3600])
def test_totals_of_a_stream_agree_too(spark, tmp_path, seconds_):
    rate, rows = Rate(4, seconds_), [*requests(400, 9, 300, 6), (900, None, T0), (901, 3, None)]
    folder(spark, tmp_path, rows, 3)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    batches.run(stream_admission.totals(stream, rate=rate, late="1 hour"), lambda b: b, {"all": F.lit(True)}, f"{tmp_path}/out", f"{tmp_path}/state", "update").awaitTermination()
    newest = {}
    for r in batches.read(spark, f"{tmp_path}/out", "all").collect():
        key = (r.client, seconds(r.window_start))
        newest[key] = max(newest.get(key, (0,)), (r.requests, r.admitted, r.refused))
    assert newest == {(r.client, seconds(r.window_start)): (r.requests, r.admitted, r.refused) for r in admission.totals(table(spark, rows), rate=rate).collect()}


def test_closed_windows_leave_the_state(spark, tmp_path):
    rate = Rate(2, 10)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    counts = []
    for step in range(4):  # runs on from the checkpoint; the watermark passes what came before
        table(spark, [(step * 10 + i, i % 3, T0 + dt.timedelta(seconds=600 * step + i)) for i in range(6)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = stream_admission.admissions(stream, rate=rate, late="5 seconds")
        run = batches.run(out, lambda b: b, {"all": F.lit(True)}, f"{tmp_path}/out", f"{tmp_path}/state", "update")
        run.awaitTermination()
        counts.append(run.lastProgress.stateOperators[0].numRowsTotal)
    assert max(counts) <= 6
    # what comes behind the watermark is dropped
    table(spark, [(99, 0, T0)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    batches.run(stream_admission.admissions(stream, rate=rate, late="5 seconds"), lambda b: b, {"all": F.lit(True)}, f"{tmp_path}/out", f"{tmp_path}/state", "update").awaitTermination()
    assert batches.read(spark, f"{tmp_path}/out", "all").filter("window_start < '2024-01-01 00:01:00' AND requests > 2").count() == 0


def test_state_rows_are_slots_and_not_clients(spark, tmp_path):
    rate, rows = Rate(2, 60), requests(900, 400, 100, 8)
    folder(spark, tmp_path, rows, 3)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("user", F.concat(F.lit("u"), "user_id"))
    out = stream_admission.admissions(stream, client="user", rate=rate)
    run = batches.run(out, lambda b: b, {"all": F.lit(True)}, f"{tmp_path}/out", f"{tmp_path}/state", "update")
    run.awaitTermination()
    assert run.lastProgress.stateOperators[0].numRowsTotal <= 2 * stream_admission.SLOTS
    newest = {}
    for r in batches.read(spark, f"{tmp_path}/out", "all").collect():
        key = (r.client, seconds(r.window_start))
        newest[key] = max(newest.get(key, (0,)), (r.requests, r.admitted, r.refused, r.last_id or -1))
    last = {(f"u{r.client}", r.window): r["last"].id for r in admission.last_admitted(table(spark, rows), rate=rate).collect()}
    want = {(f"u{r.client}", seconds(r.window_start)): (r.requests, r.admitted, r.refused) for r in admission.totals(table(spark, rows), rate=rate).collect()}
    assert newest == {k: (*v, last.get(k, -1)) for k, v in want.items()}
