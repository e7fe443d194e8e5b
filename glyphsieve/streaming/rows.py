"""The row-wise operators over streams: no state, no watermark, exactly once into files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def read_texts(spark: SparkSession, path: str, schema, form: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of rows from files as they arrive in a folder, or from one file by its path."""
    reader = spark.readStream.format(form).schema(schema)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        reader, path = reader.option("pathGlobFilter", at.getName()), path.rpartition("/")[0]
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def run(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, form: str = "parquet", trigger: dict | None = None) -> StreamingQuery:
    """Start plan over the stream into files; by default it works off what is there and ends."""
    out = plan(stream).writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint)
    return out.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
