"""Files to texts: txt and html with built-in functions, docx and pdf in Arrow batches.  Bad files keep their row."""

from __future__ import annotations

from collections.abc import Callable
from typing import Iterator, Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrowtext import byte_sizes, give_back, runs
from ..operators.validate import TOO_LARGE, TOO_LONG
from ..settings import Settings
from .docx import CorruptFile, TooLarge, docx_text
from .pdf import pdf_text

# The extensions that can be read, and the type each is reported as.
SUPPORTED = {"docx": "docx", "htm": "html", "html": "html", "pdf": "pdf", "txt": "txt"}
UNSUPPORTED, CORRUPT, INTERNAL = "UNSUPPORTED", "CORRUPT", "INTERNAL"
LATIN, NO_TEXT = "DECODED_AS_LATIN_1", "NO_TEXT_FOUND"


def read_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """Files as rows: path, modificationTime, length, content.  Spark lists no file without a byte."""
    return spark.read.format("binaryFile").options(**options).load(path)


def extension(path: Column) -> Column:
    """What follows the last dot of the file's name, in lower case; empty without a dot."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, "[.]"), -1))).otherwise("")


def decode_utf8(content: Column) -> Column:
    """Strict UTF-8, null if it isn't; a byte order mark stays."""
    return F.try_validate_utf8(content.cast("string"))


def decode(content: Column) -> Column:
    """Strict UTF-8, or else Latin-1."""
    return F.coalesce(decode_utf8(content), F.decode(content, "ISO-8859-1"))


def _read(kind: str, content: bytes, most: int) -> tuple[str | None, list[str], str | None, str | None]:
    """(text, warnings, error code, detail)"""
    try:
        if kind == "docx":
            text = docx_text(content, most)
            return text, [] if text.strip() else [NO_TEXT], None, None
        if kind == "pdf":
            return *pdf_text(content, most), None, None
        try:
            return content.decode(), [], None, None
        except UnicodeDecodeError:
            return content.decode("latin-1"), [LATIN], None, None
    except TooLarge as why:
        return None, [], TOO_LARGE, str(why)
    except CorruptFile as why:
        return None, [], CORRUPT, str(why)
    except MemoryError:  # a fault of the machine, not of the file: the task is tried again
        raise
    except Exception as why:
        return None, [], INTERNAL, type(why).__name__


_PARSED = T.StructType([T.StructField("text", T.StringType()), T.StructField("warnings", T.ArrayType(T.StringType())), T.StructField("error_code", T.StringType()), T.StructField("error_detail", T.StringType())])


_ARROW = pa.struct([("text", pa.string()), ("warnings", pa.list_(pa.string())), ("error_code", pa.string()), ("error_detail", pa.string())])
#: Makes contents, null for no file, of columns.
Make = Callable[..., pa.Array]
#: Bytes of files whose texts are held before they are handed on; one larger file is a piece of its own.
PIECE_BYTES = 4 << 20


def parsed(kinds: pa.Array, contents: pa.Array, most: int, upload: int | None = None) -> Iterator[pa.Array]:
    """What is read of a batch of files, a bounded piece of it at a time, file by file; upload: the most bytes of a file."""

    def one(kind: str, content: bytes) -> tuple:
        return (None, [], TOO_LARGE, None) if upload is not None and len(content) > upload else _read(kind, content, most)

    for i, j in runs(byte_sizes(contents), PIECE_BYTES):
        found = ((None, [], None, None) if not c.is_valid else one(k.as_py(), c.as_py()) for k, c in zip(kinds[i:j], contents[i:j]))
        yield pa.array([dict(zip(_PARSED.names, x)) for x in found], _ARROW)


def made(kinds: pa.Array, columns: list[pa.Array], make: Make, most: int, upload: int) -> Iterator[pa.Array]:
    """What is read of files that are made of a batch's columns, as few at a time as make up a piece."""
    sizes = np.zeros(len(kinds), np.int64)
    for c in columns:
        if str(c.type).removeprefix("large_") in ("string", "binary"):
            sizes += byte_sizes(c)
    for i, j in runs(sizes):
        yield from parsed(kinds[i:j], make(*(c[i:j] for c in columns)), most, upload)


def _parser(most: int) -> Callable[..., Column]:
    @F.arrow_udf(_PARSED)
    def parse(batches: Iterator[Tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for kinds, contents in batches:
            yield from parsed(kinds, contents, most)
            give_back()

    return parse


def _maker(make: Make, most: int, upload: int) -> Callable[..., Column]:
    @F.arrow_udf(_PARSED)
    def read(batches: Iterator[Tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for kinds, *columns in batches:
            yield from made(kinds, columns, make, most, upload)
            give_back()

    return read


def extract(files: DataFrame, settings: Settings = Settings(), held: bool = False, make: Make | None = None) -> DataFrame:
    """path, length, content -> path, source_type, text, character_count, warnings, error_code, error_detail.

    Files are refused before their content is read: TOO_LARGE by length, a filter that the source takes over, and
    UNSUPPORTED by name.  TOO_LARGE are also docx and pdf files that unpack to more than the settings allow.  The others are read once; only the content of docx and pdf files goes to Python.
    held: the rows hold their content already, as those of a table do, and it is not to be made twice: one pass.
    make: makes the content of the columns beside path, which stand for length and content, in the pass that reads it
    and a bounded piece at a time: no content is handed to Spark and back, and one Python worker does both.
    """
    kinds = F.create_map(*[F.lit(x) for pair in SUPPORTED.items() for x in pair])
    ext = extension(F.col("path"))
    hint = F.when(ext == "doc", "old binary format; save as docx or txt").otherwise(F.concat(F.lit("not one of docx, htm, html, pdf, txt: "), F.when(ext == "", "unknown").otherwise(ext)))
    empty, large = F.array().cast("array<string>"), F.col("length") > settings.max_upload_bytes
    kind = F.element_at(kinds, ext)
    none = F.lit(None).cast("string")

    if make:
        own = [c for c in files.columns if c != "path"]
        rows = files.select("path", kind.alias("source_type"), F.when(kind.isNull(), hint).alias("hint"), *[F.when(kind.isNotNull(), F.col(c)).alias(c) for c in own])
        rows = rows.withColumn("p", _maker(make, settings.max_unpacked_bytes, settings.max_upload_bytes)("source_type", *own))
        text, warnings, code = F.col("p.text"), F.coalesce("p.warnings", empty), F.col("p.error_code")
    else:
        if held:
            rows = files.filter(F.col("length").isNotNull()).select("path", kind.alias("source_type"), F.when(kind.isNull(), hint).alias("hint"), F.when(~large, F.col("content")).alias("content"), large.alias("large"))
        else:
            rows = files.filter(F.col("length") <= settings.max_upload_bytes).select("path", kind.alias("source_type"), F.when(kind.isNull(), hint).alias("hint"), "content", F.lit(False).alias("large"))
        packed = F.col("source_type").isin("docx", "pdf")
        rows = rows.withColumn("p", _parser(settings.max_unpacked_bytes)(F.col("source_type"), F.when(packed, F.col("content"))))
        plain = F.col("source_type").isin("txt", "html")
        strict = decode_utf8(F.col("content"))
        text = F.when(plain, decode(F.col("content"))).otherwise(F.col("p.text"))
        warnings = F.when(plain & strict.isNull() & ~F.col("large"), F.array(F.lit(LATIN))).otherwise(F.coalesce("p.warnings", empty))
        code = F.when(F.col("large"), TOO_LARGE).otherwise(F.col("p.error_code"))
    out = rows.select(
        "path",
        "source_type",
        text.alias("text"),
        warnings.alias("warnings"),
        F.when(F.col("source_type").isNull(), UNSUPPORTED).otherwise(code).alias("error_code"),
        F.coalesce("hint", "p.error_detail").alias("error_detail"),
    )
    if not held and not make:
        refused = files.filter(large).select("path", kind.alias("source_type"), none.alias("text"), empty.alias("warnings"), F.when(kind.isNull(), UNSUPPORTED).otherwise(TOO_LARGE).alias("error_code"), F.when(kind.isNull(), hint).alias("error_detail"))
        out = out.unionByName(refused)
    long_ = F.length("text") > settings.max_text_length
    return out.select(
        "path",
        "source_type",
        F.when(~F.coalesce(long_, F.lit(False)), F.col("text")).alias("text"),
        F.length("text").cast("long").alias("character_count"),
        "warnings",
        F.when(long_, TOO_LONG).otherwise(F.col("error_code")).alias("error_code"),
        "error_detail",
    )
