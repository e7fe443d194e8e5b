"""Counters of runs and streams: how many rows and characters went through, never what they said."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

_METRICS = ("rows", "texts", "characters", "longest")


def metrics(text: str = "text") -> list[Column]:
    size = F.length(F.col(f"`{text}`")).cast("long")
    return [F.count(F.lit(1)).alias("rows"), F.count(size).alias("texts"), F.coalesce(F.sum(size), F.lit(0)).alias("characters"), F.coalesce(F.max(size), F.lit(0)).alias("longest")]


class Counters(StreamingQueryListener):
    """Counts by name of run: observe() a table or a stream, run it, then read rows().

    A table is counted when its first action ends, a stream with every batch.  Counting goes along with the run and
    reads nothing again.  close() when done.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._runs: list[tuple[str, Observation]] = []
        self._batches: dict[tuple[str, str, int], tuple] = {}
        self._names: set[str] = set()
        self._over: dict[str, threading.Event] = {}
        self._lock = threading.Lock()
        spark.streams.addListener(self)

    def observe(self, df: DataFrame, name: str, text: str = "text") -> DataFrame:
        if name in self._names:
            raise ValueError(f"{name} is counted already")
        self._names.add(name)
        if df.isStreaming:
            return df.observe(name, *metrics(text))
        seen = Observation(name)
        self._runs.append((name, seen))
        return df.observe(seen, *metrics(text))

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until the counts of all batches of a query that has ended are here."""
        if not self._ended(str(query.id)).wait(seconds):
            raise TimeoutError(f"no end of {query.id} was reported")

    def rows(self) -> DataFrame:
        """name, batch (null for a table), rows, texts, characters, longest.  Waits for tables whose action runs."""
        found = [(name, None, *[seen.get[m] for m in _METRICS]) for name, seen in self._runs]
        with self._lock:
            found += [(name, batch, *counts) for (name, _, batch), counts in sorted(self._batches.items())]
        return self.spark.createDataFrame(found, "name string, batch long, rows long, texts long, characters long, longest long")

    def close(self) -> None:
        self.spark.streams.removeListener(self)

    def _ended(self, query: str) -> threading.Event:
        with self._lock:
            return self._over.setdefault(query, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._ended(str(event.id)).clear()

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        for name, row in progress.observedMetrics.items():
            if name in self._names:
                with self._lock:  # a batch that runs again after a restart replaces its counts
                    self._batches[name, str(progress.id), progress.batchId] = tuple(row[m] for m in _METRICS)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._ended(str(event.id)).set()
