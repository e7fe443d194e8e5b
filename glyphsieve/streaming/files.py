"""Files to texts as they arrive: sound and refused ones apart, each exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..settings import Settings
from ..sources.files import extract
from . import batches

FILES = "path string, modificationTime timestamp, length long, content binary"
SOUND, REFUSED = "sound", "refused"


def read_files(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Files as rows as they arrive under path: path, modificationTime, length, content.  Spark lists no file
    without a byte."""
    reader = spark.readStream.format("binaryFile").schema(FILES)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def extract_stream(files: DataFrame, path: str, checkpoint: str, settings: Settings = Settings(), trigger: dict | None = None) -> StreamingQuery:
    """The extraction of every file of a stream (path, length, content), into the sinks SOUND and REFUSED under path.
    A bad file is a refused row with its error code and stops nothing; read the sinks with batches.read()."""
    sinks = {SOUND: F.col("error_code").isNull(), REFUSED: F.col("error_code").isNotNull()}
    return batches.run(files, lambda rows: extract(rows, settings), sinks, path, checkpoint, trigger=trigger)
