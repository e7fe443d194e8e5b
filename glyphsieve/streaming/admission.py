"""Admission over a stream of requests: keyed state in event time, agreeing with operators.admission.

totals() counts in Spark's own state.  admissions() also knows the last request that a full window took: its state of a
client and window is a count and the first limit requests so far, by time and id.  Clients of a window are dealt to some
slots by hash, and a slot's clients are one state and settled together as arrays, so the calls of a batch are windows
times slots and not clients.  Both are bounded, whatever arrives, and the same in whatever order it arrives; a window's
state is dropped once the watermark has passed its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.admission import Rate

#: Slots of a window's clients: more make its states smaller, and the work of one window wider.
SLOTS = 8
#: Stands for a null id within the state; it comes first, as null does.
_NO_ID = -(1 << 63)


class Held:
    """The clients of a slot, each with its number of requests and its first limit ones, by time and id."""

    def __init__(self, limit: int, clients=(), requests: bytes = b"", sizes: bytes = b"", us: bytes = b"", ids: bytes = b""):
        self.limit, self.clients = limit, list(clients)
        self.requests, self.sizes, self.us, self.ids = (np.frombuffer(bytes(x), np.int64) for x in (requests, sizes, us, ids))

    def add(self, clients: list, us: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Takes in requests; the places of their clients, each once."""
        known = len(self.clients)
        both = np.empty(known + len(clients), object)
        both[:] = [*self.clients, *clients]
        code, names = pd.factorize(both, use_na_sentinel=False)  # numbered as they come, so known clients keep their places
        new = code[known:]
        counts = np.bincount(new, minlength=len(names))
        counts[:known] += self.requests
        owner = np.concatenate([np.repeat(np.arange(known), self.sizes), new])
        us, ids = np.concatenate([self.us, us]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, us, owner))
        owner = owner[order]
        order = order[np.arange(len(owner)) - np.searchsorted(owner, owner) < self.limit]
        self.clients, self.requests, self.us, self.ids = list(names), counts, us[order], ids[order]
        self.sizes = np.minimum(counts, self.limit)
        return np.unique(new)

    def state(self) -> tuple:
        return (self.clients, *(x.astype(np.int64).tobytes() for x in (self.requests, self.sizes, self.us, self.ids)))

    def told(self, window: int, some: np.ndarray) -> pd.DataFrame:
        full = (self.sizes == self.limit) & (self.limit > 0)
        last = np.where(full, np.cumsum(self.sizes) - 1, 0)[some]
        at = lambda x: x[last] if len(x) else np.zeros(len(some), np.int64)
        return pd.DataFrame({"client": [self.clients[i] for i in some], "window": window, "requests": self.requests[some], "admitted": self.sizes[some], "full": full[some], "last_us": at(self.us), "last_id": at(self.ids)})


def totals(stream: DataFrame, client: str = "user_id", ts: str = "ts", rate: Rate = Rate(), late: str = "1 hour") -> DataFrame:
    """client, window_start, requests, admitted, refused, for update or append mode: operators.admission.totals so far.
    Requests behind the watermark (late after the newest) are dropped, as are those from before 1970, where Spark's
    watermark begins, and those without client or ts."""
    rows = stream.select(F.col(f"`{client}`").alias("client"), F.col(f"`{ts}`").cast("timestamp").alias("ts")).filter("client IS NOT NULL AND ts IS NOT NULL")
    counts = rows.withWatermark("ts", late).groupBy("client", F.window("ts", f"{rate.seconds} seconds").alias("w")).agg(F.count("*").alias("requests"))
    admitted = F.least("requests", F.lit(rate.limit).cast("long"))
    return counts.select("client", F.col("w.start").alias("window_start"), "requests", admitted.alias("admitted"), (F.col("requests") - admitted).alias("refused"))


def admissions(stream: DataFrame, client: str = "user_id", ts: str = "ts", id_col: str = "event_id", rate: Rate = Rate(), late: str = "1 hour", slots: int = SLOTS) -> DataFrame:
    """client, window_start, requests, admitted, refused, last_ts, last_id, in update mode: a row whenever a batch brought
    requests of a client and window, with the totals so far; last_... is the last request that a full window took.

    Requests behind the watermark (late after the newest) are dropped, as are those without client or ts.  ids must be
    long; a null one comes first.  The newest row of a client and window is the one with the most requests.
    """
    col = lambda c: F.col(f"`{c}`")
    rows = stream.select(col(client).alias("client"), col(ts).cast("timestamp").alias("ts"), col(id_col).cast("long").alias("id")).filter("client IS NOT NULL AND ts IS NOT NULL")
    rows = rows.withWatermark("ts", late).select("ts", "client", rate.window(F.col("ts")).alias("window"), F.pmod(F.xxhash64("client"), F.lit(slots)).alias("slot"), F.unix_micros("ts").alias("us"), F.coalesce("id", F.lit(_NO_ID)).alias("id"))
    limit, seconds = rate.limit, rate.seconds

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window = int(key[0])
        if state.hasTimedOut:
            state.remove()
            return
        held = Held(limit, *(state.get if state.exists else ()))
        some = [held.add(b["client"].tolist(), b["us"].to_numpy(np.int64), b["id"].to_numpy(np.int64)) for b in batches]
        state.update(held.state())
        state.setTimeoutTimestamp(max((window + seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        yield held.told(window, np.unique(np.concatenate(some)))

    kind = rows.schema["client"].dataType.simpleString()
    schema = f"client {kind}, window long, requests long, admitted long, full boolean, last_us long, last_id long"
    out = rows.groupBy("window", "slot").applyInPandasWithState(step, schema, f"clients array<{kind}>, requests binary, sizes binary, ts binary, ids binary", "update", GroupStateTimeout.EventTimeTimeout)
    last = F.when(F.col("full"), F.timestamp_micros("last_us")).alias("last_ts"), F.when(F.col("full") & (F.col("last_id") != _NO_ID), F.col("last_id")).alias("last_id")
    return out.select("client", F.timestamp_seconds("window").alias("window_start"), "requests", "admitted", (F.col("requests") - F.col("admitted")).alias("refused"), *last)
