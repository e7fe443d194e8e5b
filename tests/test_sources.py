import io
import zipfile
import zlib

import pytest

from glyphsieve.operators import scan
from glyphsieve.plans import analyze
from glyphsieve.plans.samples import docx_bytes, pdf_bytes
from glyphsieve.settings import Settings
from glyphsieve.sources import docx, files, pdf

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def extracted(spark, named: dict[str, bytes], settings=Settings()):
    df = spark.createDataFrame([(k, len(v), bytearray(v)) for k, v in named.items()], "path string, length long, content binary")
    return {r.path: r for r in files.extract(df, settings).collect()}


def hits(spark, text):
    return [f.category for f in spark.createDataFrame([(text,)], "text string").select(scan.findings(scan.F.col("text")).alias("f")).first().f]


def test_text_files(spark):
    got = extracted(spark, {"d/a.txt": "Hello\u200bWorld".encode(), "b.TXT": b"\xff\xfecaf\xe9", "c.txt": b"\xef\xbb\xbfx", "d.txt": bytes([0x93, 0xE9]), "e.txt": b"a\r\nb", "f.txt": b""})
    assert got["d/a.txt"].text == "Hello\u200bWorld" and hits(spark, got["d/a.txt"].text) == ["zero_width"] and got["d/a.txt"].warnings == []
    assert got["b.TXT"].text == "ÿþcafé" and got["b.TXT"].warnings == [files.LATIN] and got["b.TXT"].source_type == "txt"
    assert hits(spark, got["c.txt"].text) == ["zero_width"]
    assert hits(spark, got["d.txt"].text) == ["control"]
    assert got["e.txt"].text == "a\r\nb" and got["f.txt"].text == ""


def test_html_keeps_its_markup(spark):
    page = "<p>Hello\u200bWorld</p><!-- x\u202ey -->"
    got = extracted(spark, {"a.html": page.encode(), "b.htm": page.encode()})
    assert all(r.text == page and r.source_type == "html" for r in got.values())
    assert hits(spark, page) == ["zero_width", "bidi_control"]


def test_docx(spark):
    got = extracted(spark, {"a.docx": docx_bytes(["Hello\u200bWorld", "Second."]), "blank.docx": docx_bytes([" "])})
    assert got["a.docx"].text == "Hello\u200bWorld\nSecond." and got["a.docx"].source_type == "docx" and got["a.docx"].warnings == []
    assert got["blank.docx"].warnings == [files.NO_TEXT]


def test_docx_parts_and_oddities():
    part = lambda inner: f"<w:x {W}>{inner}</w:x>"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/header1.xml", part(p("head")))
        z.writestr("word/document.xml", part("<w:p><w:pPr><w:tabs><w:tab/></w:tabs></w:pPr><w:r><w:t>a</w:t><w:br/><w:t>b</w:t><w:tab/><w:cr/><w:delText>no</w:delText><w:noBreakHyphen/></w:r></w:p>" + f"<w:p><w:r>{p('box')}<w:t>out</w:t></w:r></w:p>"))
        z.writestr("word/comments.xml", part(p("comment")))
        z.writestr("word/footnotes.xml", part(p("note")))
        z.writestr("word/glossary/document.xml", part(p("glossary")))
        z.writestr("word/footer1.xml", part(""))
    assert docx.docx_text(out.getvalue()) == "head\n\ta\nb\t\n\nboxout\nbox\nnote\nglossary"
    with pytest.raises(docx.TooLarge):
        docx.docx_text(docx_bytes(["x" * 1000]), most=100)


def test_docx_of_many_short_paragraphs_takes_little_more_than_its_text():
    import tracemalloc

    lines = ["", "ab", "c & d"] * 20_000

    def peak(work):
        tracemalloc.start()
        try:
            return work(), tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    content, making = peak(lambda: docx_bytes(lines))
    text, reading = peak(lambda: docx.docx_text(content))
    assert text == "\n".join(lines)
    assert making < 2e6 and reading < 2e6  # as one string and as a tree of elements: 10 and 52 MB


def test_docx_parts_are_parsed_alike_in_any_pieces(monkeypatch):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    inside = f"<w:p><w:r>{p('in' + p('most') + 'lost')}<w:t>o<!-- x -->u<w:x>no</w:x>no</w:t>no{p('2nd')}<w:t>&amp;é<![CDATA[<]]></w:t></w:r></w:p>"
    content = docx_bytes(["漢\u200b", ""], {"word/header1.xml": f"<w:x {W}>{inside}<w:t>no</w:t>{p('')}{p('end')}</w:x>"})
    for n in (1, 7, 1 << 16):
        monkeypatch.setattr(docx, "PIECE_BYTES", n)
        assert docx.docx_text(content) == "漢\u200b\n\ninmostou2nd&é<\ninmost\nmost\n2nd\n\nend"


def test_a_damaged_archive_is_corrupt_even_if_its_xml_breaks_first(monkeypatch):
    monkeypatch.setattr(docx, "PIECE_BYTES", 10)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:x {W}>" + "<w:p/>" * 50 + "</w:x>")
    with pytest.raises(docx.CorruptFile):
        docx.docx_text(out.getvalue().replace(b"<w:p/>", b"<w:p<>", 1))


def test_what_unpacks_to_too_much_has_a_code_of_its_own(spark):
    """No page is lost without a word, and a sound file isn't called corrupt."""
    lines = [f"line {i} of the second page" for i in range(400)]
    small, large = pdf_bytes([["short"], ["second"]]), pdf_bytes([["short"], lines])
    at = large.rindex(b"BT /F1")
    shown = large[at : large.index(b" ET", at) + 3]
    large = large.replace(b"<< /Length %d >>\nstream\n%s" % (len(shown), shown), b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s" % (len(x := zlib.compress(shown)), x))
    named = {"a.pdf": small, "b.pdf": large, "c.docx": docx_bytes(["y" * 3000]), "d.docx": docx_bytes(["y"]), "e.pdf": b"garbage", "f.txt": b"z" * 3000}
    rows = spark.createDataFrame([(n, len(c), bytearray(c)) for n, c in named.items()], "path string, length long, content binary")
    got = {r.path: r for r in files.extract(rows, Settings(max_unpacked_mb=2000 / 1_048_576)).collect()}
    assert {k: r.error_code for k, r in got.items()} == {"a.pdf": None, "b.pdf": "TOO_LARGE", "c.docx": "TOO_LARGE", "d.docx": None, "e.pdf": "CORRUPT", "f.txt": None}
    assert got["b.pdf"].text is None and "2000 bytes" in got["b.pdf"].error_detail and got["a.pdf"].text == "short\nsecond"
    assert {r.error_code for r in files.extract(rows).collect()} == {None, "CORRUPT"}


@pytest.mark.parametrize("unpack", [lambda most: pdf._run_length(b"\x81a" * 9, most), lambda most: pdf._lzw(bytes.fromhex("800B6050220C0C8501"), 1, most)])
def test_filters_stop_at_the_limit(unpack):
    unpack(2000)
    with pytest.raises(docx.TooLarge):
        unpack(5)


def test_bad_files_keep_their_rows(spark):
    empty = io.BytesIO()
    with zipfile.ZipFile(empty, "w") as z:
        z.writestr("other.xml", "<a/>")
    broken = io.BytesIO()
    with zipfile.ZipFile(broken, "w") as z:
        z.writestr("word/document.xml", "<a>")
    got = extracted(spark, {"a.docx": b"no zip", "b.docx": empty.getvalue(), "c.docx": broken.getvalue(), "d.pdf": b"garbage", "e.doc": b"x", "f.zip": b"x", "noext": b"x", "g.pdf": b"%PDF-1.4 nothing"})
    codes = {k: r.error_code for k, r in got.items()}
    assert codes == {"a.docx": "CORRUPT", "b.docx": "CORRUPT", "c.docx": "INTERNAL", "d.pdf": "CORRUPT", "e.doc": "UNSUPPORTED", "f.zip": "UNSUPPORTED", "noext": "UNSUPPORTED", "g.pdf": "CORRUPT"}
    assert "docx" in got["e.doc"].error_detail and "unknown" in got["noext"].error_detail and all(r.text is None for r in got.values())


def test_limits(spark):
    got = extracted(spark, {"a.txt": b"x" * 1048576, "b.txt": b"x" * 1048577}, Settings(max_upload_size_mb=1, max_text_length=2_000_000))
    assert got["a.txt"].error_code is None and got["b.txt"].error_code == "TOO_LARGE"
    got = extracted(spark, {"a.txt": b"x" * 10, "b.txt": b"x" * 11, "c.docx": docx_bytes(["x" * 11])}, Settings(max_text_length=10))
    assert [got[k].error_code for k in ("a.txt", "b.txt", "c.docx")] == [None, "TOO_LONG", "TOO_LONG"] and got["b.txt"].character_count == 11


def test_pdf_with_a_map():
    text, warnings = pdf.pdf_text(pdf_bytes([["first line", "zwsp\u200b and 漢"], ["second page"]]))
    assert text == "first line\nzwsp\u200b and 漢\nsecond page" and warnings == ["PDF_MAY_LOSE_ZERO_WIDTH_AND_BIDI"]


def test_pdf_warnings():
    assert pdf.pdf_text(pdf_bytes([None])) == ("", ["FONT_WITHOUT_UNICODE_MAP" for _ in ()] + ["PDF_MAY_LOSE_ZERO_WIDTH_AND_BIDI", "NO_TEXT_LAYER"])
    text, warnings = pdf.pdf_text(pdf_bytes([["plain “quoted”"], None], unicode_map=False))
    assert text == "plain “quoted”\n" and warnings == ["FONT_WITHOUT_UNICODE_MAP", "PDF_MAY_LOSE_ZERO_WIDTH_AND_BIDI", "EMPTY_PAGES 1 OF 2"]
    assert pdf.pdf_text(pdf_bytes([]))[1] == ["PDF_MAY_LOSE_ZERO_WIDTH_AND_BIDI"]


def lzw(data: bytes, early: int) -> bytes:
    """A plain encoder, to read back."""
    table, out, w = {bytes([i]): i for i in range(256)}, [(256, 9)], b""
    following, width = 258, 9
    for b in data:
        if w + bytes([b]) in table:
            w += bytes([b])
            continue
        out.append((table[w], width))
        table[w + bytes([b])], following = following, following + 1
        width = max(9, (following + early - 1).bit_length())
        w = bytes([b])
        if following == 4000:
            out += [(table[w], width), (256, max(9, (following + early).bit_length()))]
            table, w, following, width = {bytes([i]): i for i in range(256)}, b"", 258, 9
    out += [(table[w], width)] * bool(w)
    out.append((257, max(9, (following + early).bit_length()) if w else width))
    bits = "".join(f"{c:0{n}b}" for c, n in out)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def filtered(name: bytes, pack, more: bytes = b"") -> bytes:
    body = pdf_bytes([["some text of a page, some text of a page"]], unicode_map=False)
    at = body.index(b"BT /F1")
    shown = body[at : body.index(b" ET", at) + 3]
    packed = pack(shown)
    return body.replace(b"<< /Length %d >>\nstream\n%s" % (len(shown), shown), b"<< /Length %d /Filter /%s %s >>\nstream\n%s" % (len(packed), name, more, packed))


def test_pdf_stream_filters():
    want = "some text of a page, some text of a page"
    runs = lambda d: b"".join(bytes([len(d[i : i + 100]) - 1]) + d[i : i + 100] for i in range(0, len(d), 100)) + b"\x80"
    assert pdf.pdf_text(filtered(b"LZWDecode", lambda d: lzw(d, 1)))[0] == want
    assert pdf.pdf_text(filtered(b"LZWDecode", lambda d: lzw(d, 0), b"/DecodeParms << /EarlyChange 0 >>"))[0] == want
    assert pdf.pdf_text(filtered(b"RunLengthDecode", runs))[0] == want
    text, warnings = pdf.pdf_text(filtered(b"JBIG2Decode", bytes))
    assert text == "" and "STREAM_FILTER_NOT_READ" in warnings
    # the example of the PDF specification
    assert pdf._lzw(bytes.fromhex("800B6050220C0C8501"), 1) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert pdf._run_length(bytes([2, 65, 66, 67, 254, 90, 128, 1])) == b"ABCZZZ"
    for early in (0, 1):
        data = bytes(i * i % 251 for i in range(20_000)) + b"a" * 5000
        assert pdf._lzw(lzw(data, early), early) == data


def test_pdf_in_a_job(spark):
    got = extracted(spark, {"a.pdf": pdf_bytes([["one", "two"]])})
    assert got["a.pdf"].text == "one\ntwo" and got["a.pdf"].source_type == "pdf"


def test_names_from_disk(spark, tmp_path):
    (tmp_path / "my file.TXT").write_bytes("a\u200b\xa0b".encode())
    (tmp_path / "x.html").write_bytes("<b>a\u200b\xa0</b>".encode())
    rows = analyze.extract_and_analyze(spark, str(tmp_path)).collect()
    assert sorted((r.source_type, r.hidden_character_count) for r in rows) == [("html", 2), ("txt", 2)]


@pytest.mark.parametrize("kind", ["pdf", "docx"])
def test_batches_of_files_are_worked_on_in_bounded_pieces(kind, monkeypatch):
    import pyarrow as pa

    made = [pdf_bytes([["some line " * 40]]) if kind == "pdf" else docx_bytes(["some line " * 40])] * 50
    monkeypatch.setattr(files, "PIECE_BYTES", 3 * len(made[0]))
    got = list(files.parsed(pa.array([kind] * 51), pa.array([*made, None], pa.binary()), 1 << 20))
    assert max(map(len, got)) <= 4 and sum(map(len, got)) == 51
    assert [x["text"] for part in got for x in part.to_pylist()] == ["some line " * 40] * 50 + [None]


def test_files_that_rows_hold_are_made_once_and_give_the_same(spark):
    made, one = spark.sparkContext.accumulator(0), b"x" * 2_000_000
    rows = [("a.txt", 5, b"plain"), ("b.pdf", 9, pdf_bytes([["x"]])), ("big.txt", 2_000_000, one), ("big.pdf", 2_000_000, one), ("big.doc", 2_000_000, one), ("latin.txt", 1, b"\xe9"), ("none.txt", None, b"x"), ("a.doc", 1, b"x")]

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    df = spark.createDataFrame(rows, "path string, length long, content binary").mapInPandas(count, "path string, length long, content binary")
    told = lambda held: sorted(map(str, files.extract(df, Settings(max_upload_size_mb=1), held=held).collect()))
    want, before = told(False), made.value
    assert told(True) == want and len(want) == 7
    assert made.value - before == len(rows)


def test_heads_of_objects_however_far_apart():
    for gap in (b" ", b"\n" * 3000):
        assert pdf._head(b"x 12" + gap + b"7" + gap, len(b"x 12" + gap + b"7" + gap)) == (12, 7)
    assert pdf._head(b"9" * 100 + b" 0 ", 103) == (int("9" * 100), 0) and pdf._head(b"endobj ", 7) is None


@pytest.mark.parametrize("kind", ["pdf", "docx"])
def test_files_are_made_and_read_a_piece_at_a_time(kind):
    import pyarrow as pa
    from glyphsieve.functions.arrowtext import PIECE_BYTES
    from glyphsieve.plans import samples

    texts, held = ["some line " * 10_000 + str(i) for i in range(30)] + [None], []
    make = samples.packer(kind)

    def counted(keys, some):
        held.append(sum(len(t or "") for t in some.to_pylist()))
        return make(keys, some)

    got = list(files.made(pa.array([kind] * 31), [pa.array(range(31)), pa.array(texts)], counted, 1 << 24, 1 << 24))
    assert [x["text"] for part in got for x in part.to_pylist()] == texts
    assert max(held) <= PIECE_BYTES and len(held) > 2


def test_files_made_in_the_pass_that_reads_them_give_the_same(spark):
    import pyarrow as pa

    rows = [("a.txt", b"plain"), ("b.pdf", pdf_bytes([["x"]])), ("c.docx", docx_bytes(["y", "z"])), ("d.docx", b"no"), ("big.pdf", b"x" * 2_000_000), ("big.txt", b"x" * 2_000_000), ("latin.HTM", b"\xe9"), ("a.doc", b"x"), ("none", b"x"), ("empty.txt", b"")]
    df, settings = spark.createDataFrame(rows, "path string, raw binary"), Settings(max_upload_size_mb=1)
    want = files.extract(df.selectExpr("path", "length(raw)::bigint AS length", "raw AS content"), settings).collect()
    got = files.extract(df, settings, make=lambda raw: raw).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == len(rows)
    gone = files.extract(spark.createDataFrame([("e.pdf", None)], "path string, raw binary"), settings, make=lambda raw: pa.array(raw)).first()
    assert gone.text is None and gone.error_code is None and gone.warnings == []


@pytest.mark.parametrize("name", ["extract_pdf", "extract_docx", "extract_pdf_fonts"])
def test_no_content_goes_between_python_workers(spark, name):
    from glyphsieve.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan


UNUSUAL = ["plain", "", " ", "\n\n", "\xa0\x1c", "a\rb\r\nc\r", "".join(map(chr, range(32))), "\ufffe\uffff", "\U0001f600", "a\U0001f600\U0001f600\nb\U0010ffff", "_x0001_ <&#13;]]>", "\u200b", None]


def against_sql(spark, name, folder, rows):
    """Rows of a query over documents of such ids and texts, and of its SQL."""
    import duckdb

    import __spark_entry__ as entry

    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    mine = entry.queries()[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(mine.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted(map(repr, map(tuple, mine.collect()))), sorted(map(repr, want))


def test_extract_docx_of_unusual_texts_is_as_its_sql(spark, tmp_path):
    rows = [(i - 6, t) for i, t in enumerate(UNUSUAL)] + [(None, "x"), (None, ""), (None, None), (3, "twice"), (3, "twice")]
    mine, want = against_sql(spark, "extract_docx", tmp_path, rows)
    assert mine == want


def test_docx_holds_what_xml_does_not():
    text = "".join(chr(c) for c in (*range(0x300), 0xFFFD, 0xFFFE, 0xFFFF, 0x1F600)) + "\r\r\n\x00"
    assert docx.docx_text(docx_bytes(text.split("\n"))) == text
    font = f'<w:x {W}><w:p><w:r><w:t>a</w:t><w:sym w:font="Symbol" w:char="F0B7"/><w:sym/><w:sym w:char="fffe"/><w:t>b</w:t></w:r></w:p></w:x>'
    assert docx.docx_text(docx_bytes([], {"word/footer1.xml": font})) == "a\ufffeb"


def test_the_queries_do_not_take_the_services_limit_on_what_is_unpacked():
    from glyphsieve.plans.queries import _WHOLE

    text = "\n" * 5_000_000  # its XML is larger than 256 MB
    content = docx_bytes(text.split("\n"))
    assert docx.docx_text(content, _WHOLE.max_unpacked_bytes) == text
    assert files._read("docx", content, Settings().max_unpacked_bytes)[2] == "TOO_LARGE"


@pytest.mark.parametrize("kind", ["docx", "pdf"])
def test_a_lack_of_memory_is_no_fault_of_the_file(kind, monkeypatch):
    def none_left(*_):
        raise MemoryError

    monkeypatch.setattr(files, f"{kind}_text", none_left)
    with pytest.raises(MemoryError):
        files._read(kind, b"x", 1)


@pytest.mark.parametrize("name", ["extract_pdf", "extract_pdf_fonts"])
def test_extract_pdf_of_unusual_texts_is_as_its_sql(spark, tmp_path, name):
    rows = [(i - 6, t) for i, t in enumerate(UNUSUAL * 2)] + [(None, "x"), (None, "漢"), (None, ""), (None, None), (3, "twice"), (3, "twice")]
    mine, want = against_sql(spark, name, tmp_path, rows)
    assert mine == want


def test_pdf_characters_that_codes_give_in_halves():
    for text in ("\U0001f600", "a\U0001f600\U0010ffff漢\n\U00010000"):
        assert pdf.pdf_text(pdf_bytes([text.split("\n")]))[0] == text
    whole = pdf_bytes([["a\U0001f600b"]])
    assert b"<0061d83dde000062> Tj" in whole
    assert pdf.pdf_text(whole.replace(b"<0061d83dde000062> Tj", b"<0061d83d> Tj <de000062> Tj"))[0] == "a\U0001f600b"
    assert pdf.pdf_text(whole.replace(b"d83dde00", b"de00d83d"))[0] == "a\ufffd\ufffdb"
    assert pdf.pdf_text(whole.replace(b"d83dde00", b"d83d0063"))[0] == "a\ufffdcb"


def test_a_page_is_not_taken_for_empty_for_lack_of_memory(monkeypatch):
    def none_left(*_):
        raise MemoryError

    monkeypatch.setattr(pdf.Pdf, "page_text", none_left)
    with pytest.raises(MemoryError):
        files._read("pdf", pdf_bytes([["x"]]), 1 << 20)
