"""Deterministic inputs for the registered queries: the supplied tables hold no hidden character, so the queries
put some in, by the row's id, with one rule stated for both engines."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.docx import UNFIT

#: (way, where, code points) by the remainder of the id modulo RULES.
RULES = 12
_RULES = {
    0: ("after", 3, (0x200B,)),
    1: ("before", "e", (0x202E,)),
    2: ("instead", " ", (0x00A0,)),
    3: ("end", None, (0xE0041, 0xE0042)),
    4: ("before", "a", (0xFE0F, 0xFE0F)),
    5: ("after", 5, (0x0007, 0x0085)),
    6: ("before", "th", (0x00AD,)),
    7: ("after", 2, (0x3164, 0x2800)),
    8: ("start", None, (0xFEFF, 0x2003)),
    9: ("behind", "o", (0x200B, 0x0301)),
    10: ("start", None, (0x1F600, 0x200D, 0x1F600)),
}
#: Paragraphs of a document that are written at once.
PARAGRAPHS = 1000
#: What does not stay as it is in XML: a carriage return is read as a line feed, and code points that XML can't hold break it.
_AS_ELSE = {"\r": "&#13;"} | {c: f'</w:t><w:sym w:char="{code}"/><w:t xml:space="preserve">' for code, c in UNFIT.items()}
_ELSE = re.compile("[" + "".join(map(re.escape, _AS_ELSE)) + "]")


def inject(text: Column, key: Column) -> Column:
    out = text
    for r, (way, where, points) in _RULES.items():
        s = F.lit("".join(map(chr, points)))
        if way == "after":
            new = F.concat(F.substring(text, F.lit(1), F.lit(where)), s, F.substring(text, F.lit(where + 1), F.length(text)))
        elif way in ("before", "behind", "instead"):
            w = F.lit(where)
            new = F.replace(text, w, F.concat(s, w) if way == "before" else F.concat(w, s) if way == "behind" else s)
        else:
            new = F.concat(text, s) if way == "end" else F.concat(s, text)
        out = F.when(key % RULES == r, new).otherwise(out)
    return out


def inject_sql(text: str, key: str) -> str:
    cases = []
    for r, (way, where, points) in _RULES.items():
        s = "(" + " || ".join(f"chr({p})" for p in points) + ")"
        if way == "after":
            new = f"substr({text}, 1, {where}) || {s} || substr({text}, {where + 1})"
        elif way in ("before", "behind", "instead"):
            put = f"{s} || '{where}'" if way == "before" else f"'{where}' || {s}" if way == "behind" else s
            new = f"replace({text}, '{where}', {put})"
        else:
            new = f"{text} || {s}" if way == "end" else f"{s} || {text}"
        cases.append(f"WHEN {r} THEN {new}")
    return f"CASE {key} % {RULES} {' '.join(cases)} ELSE {text} END"


def as_files(df: DataFrame, key: str, text: str, ext: str, latin_every: int = 0) -> DataFrame:
    """path, length and content of text files, every so many in Latin-1 where their text allows."""
    content = F.encode(F.col(text), "UTF-8")
    if latin_every:
        content = F.when((F.col(key) % latin_every == 0) & F.col(text).rlike(r"\A[\x{0}-\x{FF}]*\z"), F.encode(F.col(text), "ISO-8859-1")).otherwise(content)
    return df.select(F.concat(F.lit("in/"), F.col(key).cast("string"), F.lit(f".{ext}")).alias("path"), content.alias("content")).withColumn("length", F.octet_length("content").cast("long"))


def docx_bytes(paragraphs: list[str], more: dict[str, str] | None = None) -> bytes:
    """A minimal document; more: further parts by name, as XML."""
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
        with z.open("word/document.xml", "w", force_zip64=True) as f:
            f.write(f'<?xml version="1.0" encoding="UTF-8"?><w:document {space}><w:body>'.encode())
            for i in range(0, len(paragraphs), PARAGRAPHS):
                said = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in paragraphs[i : i + PARAGRAPHS])
                f.write(_ELSE.sub(lambda m: _AS_ELSE[m[0]], said).encode())
            f.write(b"</w:body></w:document>")
        for name, xml in (more or {}).items():
            z.writestr(name, xml)
    return out.getvalue()


def pdf_bytes(pages: list[list[str] | None], unicode_map: bool = True) -> bytes:
    """A PDF of lines of text by page, None for a page without any; with a ToUnicode map, or else Latin only."""
    objects: list[bytes] = []

    def add(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    def stream(data: bytes) -> bytes:
        return b"<< /Length %d >>\nstream\n%s\nendstream" % (len(data), data)

    catalog, tree = add(b""), add(b"")
    if unicode_map:
        cmap = add(stream(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange"))
        font = add(b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H /ToUnicode %d 0 R >>" % cmap)
    else:
        font = add(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>")
    kids = []
    for lines in pages:
        code = (lambda t: t.encode("utf-16-be")) if unicode_map else (lambda t: t.encode("cp1252"))
        shown = b"" if lines is None else b"BT /F1 12 Tf 72 800 Td 14 TL " + b" T* ".join(b"<%s> Tj" % code(t).hex().encode() for t in lines) + b" ET"
        content = add(stream(shown))
        kids.append(add(b"<< /Type /Page /Parent %d 0 R /Resources << /Font << /F1 %d 0 R >> >> /Contents %d 0 R >>" % (tree, font, content)))
    objects[catalog - 1] = b"<< /Type /Catalog /Pages %d 0 R >>" % tree
    objects[tree - 1] = b"<< /Type /Pages /Count %d /Kids [ %s ] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    body = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, x) for i, x in enumerate(objects, 1))
    return body + b"trailer << /Size %d /Root %d 0 R >>\n%%%%EOF" % (len(objects) + 1, catalog)


def packer(ext: str, simple_every: int = 0) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """What makes the content of docx or pdf files of keys and texts, null for null: a paragraph or line of text for
    each line; of pdf files those of positive or null keys, all but every so many, have a simple font without a Unicode map,
    where their text is printable Latin-1."""

    def one(k: int | None, t: str) -> bytes:
        if ext == "docx":
            return docx_bytes(t.split("\n"))
        simple = simple_every and (k is None or k > 0 and k % simple_every) and all(c == "\n" or " " <= c <= "~" or "\xa0" <= c <= "\xff" for c in t)
        return pdf_bytes([t.split("\n")], not simple)

    def make(keys: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else one(k, t) for k, t in zip(keys.to_pylist(), texts.to_pylist())], pa.binary())

    return make


def as_packed_files(df: DataFrame, key: str, text: str, ext: str) -> DataFrame:
    """The paths of docx or pdf files, without a number for a null key, with the key and text that a packer makes them of."""
    path = F.concat(F.lit("in/"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f".{ext}"))
    return df.select(path.alias("path"), F.col(key).alias("k"), F.col(text).alias("t"))
