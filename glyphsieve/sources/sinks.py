"""Results out: Parquet, JSON lines and plain text, and counters that hold no text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_results(df: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    if form not in ("parquet", "json"):
        raise ValueError("form must be parquet or json")
    df.write.mode(mode).format(form).save(path)


def write_texts(df: DataFrame, path: str, text: str = "purified_text", mode: str = "errorifexists") -> None:
    """One text per line file; line feeds inside texts are kept, so use Parquet where rows must be told apart."""
    df.select(F.col(text).alias("value")).write.mode(mode).text(path)


def counted(df: DataFrame, text: str = "text", name: str = "glyphsieve") -> tuple[DataFrame, Observation]:
    """df observed while it runs: rows and characters, never content."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(F.length(text)).alias("characters")), seen
