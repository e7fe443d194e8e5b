"""Filters and additions that look at whole texts, in one pass that carries every column along unshuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrowtext import PIECE_BYTES, pieces

Mask = Callable[[pa.RecordBatch, np.ndarray, np.ndarray], np.ndarray]


def keep_rows(df: DataFrame, text_col: str, mask: Mask, limit: int = PIECE_BYTES) -> DataFrame:
    """The rows of df for which mask(rows, bytes, offsets) is true; all columns as they are, in their order."""
    names = df.columns
    plain = [f"c{i}" for i in range(len(names))]
    text = plain[names.index(text_col)]
    schema = T.StructType([T.StructField(p, f.dataType, True) for p, f in zip(plain, df.schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in pieces(batches, text, limit):
            yield part.filter(pa.array(mask(part, data, off), pa.bool_()))

    return df.toDF(*plain).mapInArrow(run, schema).toDF(*names)
