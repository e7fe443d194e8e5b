"""Streams of files, totals and counters: restarts, order, and what a table of the same rows gives."""

import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from glyphsieve.operators import scan
from glyphsieve.sources import files
from glyphsieve.sources.counters import Counters
from glyphsieve.streaming import batches, rollup
from glyphsieve.streaming import files as file_stream

ZW = "​"


def put(folder, names):
    folder.mkdir(exist_ok=True)
    for name, content in names.items():
        (folder / name).write_bytes(content)


def docx(text):
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


# e and i.txt hold no byte: Spark's file sources list no such files
FIRST = {"a.txt": b"plain", "b.docx": docx("in a docx"), "c.doc": b"old", "d.docx": b"no zip", "e": b"", "f.html": "<p>é</p>".encode()}
SECOND = {"g.TXT": b"\xff\xfe", "h.pdf": b"%PDF-no", "i.txt": b"", "a.txt.zip": b"PK"}


def told(spark, out):
    rows = {}
    for sink in (file_stream.SOUND, file_stream.REFUSED):
        for r in batches.read(spark, out, sink).collect():
            name = r.path.rpartition("/")[2]
            assert name not in rows, "written twice"
            rows[name] = (sink, r.text, r.error_code)
    return rows


def as_batch(spark, folder):
    return {r.path.rpartition("/")[2]: ("refused" if r.error_code else "sound", r.text, r.error_code) for r in files.extract(files.read_files(spark, str(folder))).collect()}


def test_files_go_to_two_sinks_and_a_restart_goes_on(spark, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    put(tmp_path / "in", FIRST)
    stream = file_stream.read_files(spark, str(tmp_path / "in"), files_per_trigger=2)
    file_stream.extract_stream(stream, out, state).awaitTermination()
    assert told(spark, out) == as_batch(spark, tmp_path / "in") and len(told(spark, out)) == 5
    put(tmp_path / "in", SECOND)
    file_stream.extract_stream(stream, out, state).awaitTermination()
    assert told(spark, out) == as_batch(spark, tmp_path / "in") and len(told(spark, out)) == 8


def test_a_batch_that_broke_off_is_written_again(spark, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    put(tmp_path / "in", FIRST)
    stream = file_stream.read_files(spark, str(tmp_path / "in"))
    sinks = {"sound": F.col("error_code").isNull(), "refused": F.raise_error(F.lit("lost")).cast("boolean")}
    with pytest.raises(Exception, match="lost"):  # after the first sink is written, before the batch is done
        batches.run(stream, files.extract, sinks, out, state).awaitTermination()
    assert batches.read(spark, out, "sound").count() == 3
    put(tmp_path / "in", SECOND)
    file_stream.extract_stream(stream, out, state).awaitTermination()
    assert told(spark, out) == as_batch(spark, tmp_path / "in")


def test_totals_of_a_stream_end_as_those_of_the_table(spark, tmp_path):
    rows = [(i, ["a", "b", None][i % 3], [f"x{ZW}{i}\xa0", None, "", "‮" * i][i % 4]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, g string, text string")
    for k in range(3):
        df.filter(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        rollup.run(stream, ["g"], str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = batches.newest(batches.read(spark, str(tmp_path / "out"), rollup.TOTALS))
    assert sorted(map(str, got.collect())) == sorted(map(str, scan.category_totals(df, ["g"]).collect()))


def test_counters_of_runs_and_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, "four"), (2, None), (3, ""), (4, "é😀")], "id int, text string")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    seen = Counters(spark)
    try:
        seen.observe(df, "run").filter("id > 1").count()
        seen.observe(df.limit(0), "nothing").collect()
        stream = seen.observe(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "stream")
        query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        seen.wait(query)
        with pytest.raises(ValueError, match="counted already"):
            seen.observe(df, "run")
        rows = seen.rows()
        by_name = {r.name: (r["rows"], r.texts, r.characters, r.longest) for r in rows.groupBy("name").agg(*[F.sum(c).alias(c) for c in ("rows", "texts", "characters")], F.max("longest").alias("longest")).collect()}
        assert by_name == {"run": (4, 3, 6, 4), "nothing": (0, 0, 0, 0), "stream": (4, 3, 6, 4)}
        assert rows.filter("name = 'stream'").count() >= 2 and "text" not in rows.columns
    finally:
        seen.close()
