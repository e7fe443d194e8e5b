"""Totals over streams: one stateful aggregation, whose last state is the total of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import scan
from . import batches

TOTALS = "totals"


def category_totals(stream: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """by, category, n of all rows so far.  Texts are counted where they lie, so a batch sends a row for each group,
    category and task at most, and the state has a row for each group and category."""
    counts = scan.count_by_category(F.col(f"`{text}`"))
    rows = stream.select(*[F.col(f"`{c}`") for c in by], F.explode(counts).alias("category", "n"))
    return rows.groupBy(*[F.col(f"`{c}`") for c in by], "category").agg(F.sum("n").alias("n"))


def run(stream: DataFrame, by: list[str], path: str, checkpoint: str, text: str = "text", trigger: dict | None = None) -> StreamingQuery:
    """Keeps category_totals of a stream in the sink TOTALS under path; batches.newest() has the totals so far."""
    return batches.run(category_totals(stream, by, text), lambda rows: rows, {TOTALS: F.lit(True)}, path, checkpoint, "complete", trigger)
