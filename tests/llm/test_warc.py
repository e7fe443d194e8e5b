import gzip
import hashlib
import io
import tracemalloc

import pytest

from glyphsieve.llm import warc
from glyphsieve.llm.queries import ORACLE_SQL, op3_warc

DATE = "2000-01-01T00:00:00Z"


def records(data: bytes):
    return list(warc.read_records(io.BytesIO(data)))


def test_round_trip_of_one_file():
    payloads = [b"", b"a", b"x" * 700_000, "é\r\n\r\nWARC/1.1\r\n\r\n".encode()]
    data = b"".join(warc.record(str(i), f"http://x/ y\r\n{i}", p, None, DATE) for i, p in enumerate(payloads)) + warc.record("9", None, payloads[2], "2", DATE)
    got = records(data)
    assert [r.error for r in got] == [None] * 5
    assert [r.payload for r in got[:4]] == payloads
    assert got[4].fields["warc-type"] == "revisit" and got[4].fields["warc-payload-digest"] == got[2].fields["warc-payload-digest"] and got[4].payload == b""
    assert "\r" not in got[0].fields["warc-target-uri"]
    members = gzip.decompress(data)
    assert members.count(b"WARC/1.1\r\nWARC-Type") == 5
    for r, after in zip(got, got[1:]):  # a member is a record by itself
        assert gzip.decompress(data[r.offset : after.offset]).startswith(b"WARC/1.1")


def rebuilt(head: bytes, block: bytes, tail: bytes = b"\r\n\r\n") -> bytes:
    return gzip.compress(b"WARC/1.1\r\n" + head + b"\r\n\r\n" + block + tail)


@pytest.mark.parametrize(
    "data, error",
    [
        (rebuilt(b"Content-Length: 3", b"abcd"), "goes on"),
        (rebuilt(b"Content-Length: 30", b"abcd"), "shorter"),
        (rebuilt(b"X: 1", b"abcd"), "no content length"),
        (rebuilt(b"Content-Length: 4", b"abcd", b"zzzz"), "blank lines"),
        (rebuilt(b"Content-Length: 4\r\nWARC-Block-Digest: " + warc.sha1_32(b"abce").encode(), b"abcd"), "block differs"),
        (rebuilt(b"Content-Length: 4\r\nWARC-Type: response\r\nWARC-Payload-Digest: " + warc.sha1_32(b"abce").encode(), b"abcd"), "payload differs"),
        (gzip.compress(b"HTTP/1.1\r\n\r\n"), "version"),
        (warc.record("1", "u", b"payload" * 99, None, DATE)[:-9], "cut short"),
        (gzip.compress(b"WARC/1.1 without end"), "no end"),
    ],
)
def test_damage_is_told(data, error):
    got = records(warc.record("0", "u", b"fine", None, DATE) + data)
    assert got[0].error is None and error in got[1].error


def test_a_member_that_goes_on_is_not_held():
    bomb = rebuilt(b"Content-Length: 4", b"abcd", b"\0" * 300_000_000)
    tracemalloc.start()
    got = records(bomb)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert "goes on" in got[0].error and got[0].block == b"abcd" and peak < 20e6


def test_records_without_digests_are_not_verified():
    plain, other = rebuilt(b"Content-Length: 4", b"abcd"), rebuilt(b"Content-Length: 4\r\nWARC-Block-Digest: md5:xyz", b"abcd")
    got = records(plain + other + warc.record("1", "u", b"payload", None, DATE))
    assert [r.error for r in got] == [None] * 3 and [warc.verified(r) for r in got] == [False, False, True]


def test_revisits_are_held_against_their_responses(spark, tmp_path):
    big, other = b"p" * 2000, b"q" * 2000
    data = warc.record("1", "u", big, None, DATE) + warc.record("2", "u", big, "1", DATE) + warc.record("3", "u", other, "1", DATE) + warc.record("4", "u", big, "9", DATE)
    (tmp_path / "a.warc.gz").write_bytes(data)
    out = warc.check_revisits(warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "path string")))
    assert [(r.page_id, r.error is None) for r in out.orderBy("offset").collect()] == [("1", True), ("2", True), ("3", False), ("4", False)]


def test_pages_that_share_an_id_have_records_of_their_own():
    got = records(warc.record("a:b", "u", b"one", None, DATE) + warc.record("a:b", "u", b"two", None, DATE) + warc.record("c", "u", b"one", "a:b", DATE) + warc.record(None, "u", b"one", None, DATE))
    names = [r.fields["warc-record-id"] for r in got]
    assert len(set(names)) == 4 and got[2].fields["warc-refers-to"] == names[0]
    assert [warc._page(x) for x in names] == ["a:b", "a:b", "c", None]


def test_a_very_long_page(spark, tmp_path):
    pages = [(1, "u", "é<p>" * 4_000_000), (2, "u", "é<p>" * 4_000_000), (3, "u", "")]
    manifest = warc.write_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    got = sorted((r.page_id, r.payload_bytes, r.record_type) for r in warc.read_archives(manifest, payloads=False).collect())
    assert got == [("1", 20_000_000, "revisit"), ("2", 20_000_000, "response"), ("3", 0, "response")]


def test_a_very_long_address(spark, tmp_path):
    """Three megabytes of address, between records of common size and next to columns of clashing names."""
    url = "http://x/" + "a%20b" * 600_000
    rows = [(1, "http://y", "one", "p", 1), (2, url, "two", "q", 2), (3, "http://z", "three" * 400, None, 3), (4, None, "three" * 400, "r", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string, n int").coalesce(1)
    got = {r.page_id: r for r in warc.read_archives(warc.write_pages(pages, f"file://{tmp_path}/a")).collect()}
    assert {r.error for r in got.values()} == {None} and got["2"].target_uri == url and [got[str(i)].payload_bytes for i in range(1, 5)] == [3, 3, 2000, 2000]
    assert got["3"].record_type == "revisit" and got["3"].refers_to == "4"


def test_a_header_without_an_end_is_told(monkeypatch):
    monkeypatch.setattr(warc, "MOST_HEADER", 1 << 20)
    assert "no end" in records(gzip.compress(b"WARC/1.1\r\nX: " + b"y" * (3 << 20)))[0].error


def test_locations_as_spark_names_them(monkeypatch):
    seen = []

    class Fake:
        from_uri = staticmethod(lambda uri: seen.append(uri) or (None, ""))

    monkeypatch.setattr(warc.pyarrow.fs, "FileSystem", Fake)
    for path in ("s3a://bucket/a", "s3n://b/c", "s3://b/c", "file:///x/y", "/x/y", "hdfs://n/z", "gs://b/c"):
        warc._open(path)
    assert seen == ["s3://bucket/a", "s3://b/c", "s3://b/c", "file:///x/y", "/x/y", "hdfs://n/z", "gs://b/c"]


def test_null_and_repeated_paths(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    path = warc.write_pages(pages, str(tmp_path)).first().path
    assert warc.read_archives(spark.createDataFrame([(path,), (None,), (path,)], "path string")).count() == 2


def test_empty_and_foreign_streams():
    assert records(b"") == []
    assert records(b"not gzip")[0].error


def test_revisits_nulls_and_repeats(spark, tmp_path):
    big, small = "y" * 1000, "z" * 999
    rows = [(1, "a", big, "x"), (2, None, big, "x"), (7, "c", big, "x"), (3, "d", small, "x"), (4, "e", small, "x"), (5, "f", None, "x"), (None, "g", big, "x"), (8, "h", "é" * 500, "x"), (9, "h", "é" * 500, "x"), (9, "h", "é" * 500, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    manifest = warc.write_pages(df, f"file://{tmp_path}/w")
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows)
    got = warc.read_archives(manifest).collect()
    assert all(r.error is None for r in got) and len(got) == len(rows)
    kinds = sorted((r.page_id or "", r.record_type, r.refers_to or "") for r in got)
    assert kinds == sorted([("1", "revisit", "7"), ("2", "revisit", "7"), ("7", "response", ""), ("3", "response", ""), ("4", "response", ""), ("5", "response", ""), ("", "revisit", "7"), ("8", "revisit", "9"), ("9", "response", ""), ("9", "response", "")])
    for r in got:
        assert r.payload_bytes == (0 if r.page_id == "5" else 999 if r.page_id in ("3", "4") else 1000)
        if r.record_type == "response":
            assert hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_pages(df, f"file://{tmp_path}/w")).count() == 0


def test_small_archives(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, "u", f"{i}" * 2000) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    data = b"".join(warc.record(str(i), "u", b"1" * 50, None, DATE) for i in range(3))
    (tmp_path / "plain.warc.gz").write_bytes(data)
    paths = spark.createDataFrame([(f"file://{tmp_path}/plain.warc.gz",)], "path string")
    assert [r.page_id for r in warc.read_archives(paths).orderBy("offset").collect()] == ["0", "1", "2"]
    assert warc.read_archives(warc.write_pages(df, f"file://{tmp_path}/w"), payloads=False).filter("payload is null").count() == 20


def test_query_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    want = con.execute(ORACLE_SQL["op3_warc"]).fetchall()
    assert sorted(map(tuple, op3_warc(spark, "/root/testdata/sf0.001").collect()), key=str) == sorted(want, key=str)
