"""Checks of texts and files before any work: rows get an error code and stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codepoints as cp
from ..settings import Settings

EMPTY, BLANK, TOO_LONG, TOO_LARGE = "EMPTY", "BLANK", "TOO_LONG", "TOO_LARGE"


def not_empty(text: Column) -> Column:
    return F.length(text) >= 1


def not_blank(text: Column) -> Column:
    """A character other than white space is in it; zero-width ones count, exotic spaces do not."""
    return text.rlike(cp.NOT_WS)


def short_enough(text: Column, settings: Settings = Settings()) -> Column:
    return F.length(text) <= settings.max_text_length


def small_enough(size: Column, settings: Settings = Settings()) -> Column:
    return size <= settings.max_upload_bytes


def text_error(text: Column, settings: Settings = Settings()) -> Column:
    """The error code of a text, null if it is sound.  A null text is EMPTY."""
    bad = F.when(text.isNull() | ~not_empty(text), EMPTY).when(~not_blank(text), BLANK)
    return bad.when(~short_enough(text, settings), TOO_LONG)


def validate(df: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """df with error_code."""
    return df.withColumn("error_code", text_error(F.col(text), settings))


def valid(df: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The sound rows only."""
    return df.filter(text_error(F.col(text), settings).isNull())
