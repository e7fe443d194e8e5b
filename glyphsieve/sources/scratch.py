"""Lineage cuts that survive lost executors: Parquet tables in the shared folder of spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from .shared import shared_dir


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_ROOTS: list[tuple[SparkSession, str]] = []


def _clear() -> None:
    """What results still needed goes when the application ends."""
    for spark, root in _ROOTS:
        try:
            at, fs = _fs(spark, root)
            fs.delete(at, True)
        except Exception:  # the JVM is gone already, or the folder is
            return


class Scratch:
    """A folder of tables for one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}  # the table is held, so its id stays its own
        if not _ROOTS:
            atexit.register(_clear)
        _ROOTS.append((spark, self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df, computed once, written and read back."""
        path = f"{self.path(name)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in tables:
            if found := self.paths.pop(id(df), None):
                at, fs = _fs(self.spark, found[1])
                fs.delete(at, True)
