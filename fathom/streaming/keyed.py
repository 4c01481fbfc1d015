"""The rate limit with state per client, kept by Spark between micro-batches.

Each client has one value, the time of its last accepted row, and a timer that removes it when it no longer matters, so the
state holds the clients of the last ``limit_s`` only. All of a client's rows in a micro-batch pass through one task, which
holds their ids and times; where one client sends a large part of all rows, ``jobs.stream_rate_limit`` spreads it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fathom import config
from fathom.operators.submissions import accepted_from

#: Timers and many clients need a store with its data on disk.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = "id bigint, ip bigint, accepted boolean, wait_s bigint"


def decided(ids: np.ndarray, times: np.ndarray, last: int | None, limit_s: int) -> tuple[np.ndarray, np.ndarray, int | None]:
    """Accepted and wait of each row of one client, and its last accepted time. Rows of a second go by id."""
    order = np.lexsort((ids, times))
    ranked = times[order]
    taken = np.array(accepted_from(ranked, np.iinfo(np.int64).min if last is None else last + limit_s, limit_s), np.int64)
    known = taken if last is None else np.concatenate([[last], taken])
    first = np.zeros(len(times), bool)
    first[order[np.searchsorted(ranked, taken)]] = True
    before = known[np.maximum(np.searchsorted(known, times, "right") - 1, 0)] if len(known) else times
    # A row older than what was accepted before waits the full time.
    wait = np.where(first, 0, limit_s - np.maximum(times - before, 0))
    return first, wait, int(known[-1]) if len(known) else None


class _Clients(StatefulProcessor):
    def __init__(self, limit_s: int):
        self.limit_s = limit_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        given = pd.concat([r[["id", "timestamp"]] for r in rows], ignore_index=True)
        last = self.last.get()[0] if self.last.exists() else None
        accepted, wait, newest = decided(given["id"].to_numpy(), given["timestamp"].to_numpy(), last, self.limit_s)
        if newest is not None and newest != last:
            self.last.update((newest,))
            self.handle.registerTimer((newest + self.limit_s) * 1000)
        yield pd.DataFrame({"id": given["id"], "ip": key[0], "accepted": accepted, "wait_s": wait})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.last.exists() and (self.last.get()[0] + self.limit_s) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def keyed_rate_limit(subs: DataFrame, limit_s: int = config.RATE_LIMIT_S, lateness_s: int | None = None) -> DataFrame:
    """id, ip, accepted and wait_s of a stream of submissions (id, ip, timestamp); rows later than ``lateness_s`` are dropped."""
    spark: SparkSession = subs.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    late = limit_s if lateness_s is None else lateness_s
    timed = subs.select("id", "ip", "timestamp", F.timestamp_seconds("timestamp").alias("at")).withWatermark("at", f"{late} seconds")
    return timed.groupBy("ip").transformWithStateInPandas(
        statefulProcessor=_Clients(limit_s), outputStructType=RESULT, outputMode="Append", timeMode="EventTime")
