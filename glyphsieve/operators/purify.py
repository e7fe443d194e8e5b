"""Removal of hidden code points under three switches, with optional normalisation afterwards."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codepoints as cp
from ..functions.arrowtext import byte_sizes, give_back, runs
from .scan import counts_map

FORMS = ("none", "NFC", "NFKC")


@dataclass(frozen=True)
class PurifyOptions:
    strip_hidden: bool = True
    strip_bidi: bool = True
    strip_spaces: bool = True
    form: str = "NFC"

    def __post_init__(self):
        if self.form not in FORMS:
            raise ValueError(f"form must be one of {', '.join(FORMS)}")

    @property
    def categories(self) -> tuple[str, ...]:
        return cp.stripped_categories(self.strip_hidden, self.strip_bidi, self.strip_spaces)


def strip(text: Column, options: PurifyOptions = PurifyOptions()) -> Column:
    if not options.categories:
        return text
    return F.regexp_replace(text, cp.quick_class(*options.categories), "")


#: Bytes of text that are held as strings at once; one longer text is a piece of its own.
PIECE_BYTES = 1 << 20


def normalised(texts: pa.Array, form: str) -> Iterator[pa.Array]:
    """A batch of texts in that form, a bounded piece of it at a time."""
    for i, j in runs(byte_sizes(texts), PIECE_BYTES):
        yield pa.array((t if t is None or t.isascii() else unicodedata.normalize(form, t) for t in texts[i:j].to_pylist()), pa.string())


def _normaliser(form: str) -> Callable[..., Column]:
    @F.arrow_udf(T.StringType())
    def normal(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield from normalised(texts, form)
        give_back()

    return normal


def normalise(text: Column, form: str) -> Column:
    """text in that form; Spark has no such function, so this is the one Arrow pass here."""
    return text if form == "none" else _normaliser(form)(text)


def purify(df: DataFrame, text: str = "text", options: PurifyOptions = PurifyOptions()) -> DataFrame:
    """df with original_length, purified_length, removed_count, removed_by_category, purified_text and
    normalization_applied.  Stripping comes before normalisation, and the purified length after it; a null text
    gives nulls."""
    t = F.col(text)
    out = df.withColumn("purified_text", strip(t, options))
    out = out.withColumns(
        {
            "original_length": F.length(t).cast("long"),
            "removed_count": (F.length(t) - F.length("purified_text")).cast("long"),
            "removed_by_category": counts_map(t, options.categories),
        }
    )
    out = out.withColumn("purified_text", normalise(F.col("purified_text"), options.form))
    return out.withColumns({"purified_length": F.length("purified_text").cast("long"), "normalization_applied": F.when(t.isNotNull(), F.lit(options.form))})
