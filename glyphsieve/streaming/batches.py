"""Sinks of streams whose batches may run twice: each batch writes a folder of its own, and a second run replaces it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def run(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], sinks: dict[str, Column], path: str, checkpoint: str, mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    """Start the stream: plan is worked out once for each batch, and its rows go to every sink whose condition they
    meet, a folder for each sink and batch.  When a run ends within a batch, the next one takes the same rows under the
    same number from the checkpoint and overwrites what is there, so no row is lost or written twice."""

    def write(batch: DataFrame, number: int) -> None:
        rows = plan(batch).persist()
        try:
            for name, wanted in sinks.items():
                rows.filter(wanted).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        finally:
            rows.unpersist()

    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return out.outputMode(mode).trigger(**(trigger or {"availableNow": True})).start()


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of a sink with the number of their batch."""
    return spark.read.parquet(f"{path}/{name}").withColumn("batch", F.col("batch").cast("long"))


def newest(rows: DataFrame) -> DataFrame:
    """The rows of the last batch: the whole result of a stream in complete mode."""
    last = rows.agg(F.max("batch")).first()[0]
    return rows.filter(F.col("batch") == F.lit(last)).drop("batch")
