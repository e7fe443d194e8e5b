"""Admission of requests: at most so many of a client in each fixed window of time, first come, first served."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rate:
    """limit requests of a client in each window of so many seconds, counted from the epoch."""

    # The default rate.
    limit: int = 60
    seconds: int = 60

    def __post_init__(self):
        if self.limit < 0 or self.seconds < 1:
            raise ValueError("limit must be 0 or more and seconds 1 or more")

    def window(self, ts: Column) -> Column:
        """The start of the window, in seconds since the epoch."""
        at = F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000 * self.seconds).cast("double")).cast("long")
        return at * self.seconds


def _named(events: DataFrame, client: str, ts: str, id_col: str, rate: Rate) -> DataFrame:
    col = lambda c: F.col(f"`{c}`")
    return events.select(col(client).alias("client"), rate.window(col(ts)).alias("window"), F.struct(col(ts).alias("ts"), col(id_col).alias("id")).alias("at"))


def last_admitted(events: DataFrame, client: str = "user_id", ts: str = "ts", id_col: str = "event_id", rate: Rate = Rate()) -> DataFrame:
    """client, window, last: the last request that a full window took, for windows with limit requests or more.

    Tasks keep the first limit requests of each client and window that they read, and only these are shuffled, so a
    client that sends a third of all requests is no one task's load.
    """
    rows = _named(events, client, ts, id_col, rate).filter("client IS NOT NULL AND window IS NOT NULL")
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("client", "window").orderBy("at")))
    first = ranked.filter(F.col("n") <= rate.limit)
    return first.groupBy("client", "window").agg(F.max("at").alias("last"), F.count("*").alias("n")).filter(F.col("n") == rate.limit).drop("n")


def admit(events: DataFrame, client: str = "user_id", ts: str = "ts", id_col: str = "event_id", rate: Rate = Rate()) -> DataFrame:
    """events with window_start (a timestamp) and admitted.

    Requests of a client in a window are taken in order of ts and then id until there are limit of them.  Defined
    cases: equal ids at one time are taken together or not at all, as nothing tells them apart, so such repeats at the
    border are all admitted; a null client, as one without a name can't be told from others, is admitted without limit;
    a null ts belongs to no window and is refused; limit 0 refuses all with a client.
    """
    names = events.columns
    plain = [f"c{i}" for i in range(len(names))]
    place = dict(zip(names, plain))
    rows = events.toDF(*plain).withColumns({"__w": rate.window(F.col(place[ts])), "__at": F.struct(F.col(place[ts]).alias("ts"), F.col(place[id_col]).alias("id"))})
    if rate.limit:
        last = last_admitted(events, client, ts, id_col, rate)
        rows = rows.join(last, (rows[place[client]] == last["client"]) & (rows["__w"] == last["window"]), "left")
        inside = F.col("last").isNull() | (F.col("__at") <= F.col("last"))
    else:
        inside = F.lit(False)
    admitted = F.when(F.col("__w").isNull(), False).when(F.col(place[client]).isNull(), True).otherwise(inside)
    return rows.select(*[F.col(p).alias(c) for p, c in zip(plain, names)], F.timestamp_seconds("__w").alias("window_start"), admitted.alias("admitted"))


def totals(events: DataFrame, client: str = "user_id", ts: str = "ts", id_col: str = "event_id", rate: Rate = Rate()) -> DataFrame:
    """client, window_start, requests, admitted, refused, for each client and window with a request."""
    rows = _named(events, client, ts, id_col, rate).filter("client IS NOT NULL AND window IS NOT NULL")
    out = rows.groupBy("client", "window").agg(F.count("*").alias("requests"))
    admitted = F.least("requests", F.lit(rate.limit).cast("long"))
    return out.select("client", F.timestamp_seconds("window").alias("window_start"), "requests", admitted.alias("admitted"), (F.col("requests") - admitted).alias("refused"))
