"""Rounding that agrees with Python's round() to the last case, in plain double arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A double splits into a head of 42 bits and a tail of 11, so both times 1000 are exact, and so is the sign of
# the distance from the tie.  Good for values from 0 to 2^31.
_SPLIT = 2049.0


def round3(x: Column) -> Column:
    """x to three decimals: correctly rounded, exact ties to even; -0.0 becomes 0.0.  x should be a plain column,
    as it is named many times."""
    t = x * _SPLIT
    head = t - (t - x)
    low = F.floor(head * 1000)
    above = (head * 1000 - low - 0.5) + (x - head) * 1000
    up = (above > 0) | ((above == 0) & (low % 2 == 1))
    return (low + F.when(up, 1).otherwise(0)).cast("double") / 1000.0


def round3_sql(x: str) -> str:
    """The same arithmetic as SQL text; x must be cheap, as it is repeated."""
    head = f"(({x}) * 2049.0::DOUBLE - (({x}) * 2049.0::DOUBLE - ({x})))"
    low = f"floor({head} * 1000)"
    above = f"(({head} * 1000 - {low} - 0.5::DOUBLE) + (({x}) - {head}) * 1000)"
    return f"(({low} + CASE WHEN {above} > 0 OR ({above} = 0 AND {low}::BIGINT % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE / 1000.0::DOUBLE)"
