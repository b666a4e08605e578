"""A cache of answers (or tokens) that are good for a fixed time from when they were stored.

A request for a key is a ``hit`` while the key's entry lives, else a ``miss``; a
request may also ask for a ``refresh``.  Miss and refresh store the request's own
value, and the entry lives ``ttl`` seconds from then; hits do not prolong it.

Three forms: a fold over a table in time order, a stream in event time whose
timers take entries out, and a stream by the clock whose state expires by itself.
The streams need the RocksDB state store.  Rows of a stream that come out of order, before the time that
the entry was stored at, are ``late``: they are answered with their own value and
leave the entry alone.  Requests with a null time are dropped, a null key is a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.runs import grouped

#: The state store that entries with timers or a lifetime need.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
ANSWER = "tie long, t long, outcome string, value double, stored_t long"


def answer(entry: tuple[int, float] | None, t: int, value: float, fresh: bool, ttl: int) -> tuple[str, float, int, tuple[int, float] | None]:
    """Outcome, value, the time it was stored at and the entry afterwards; times are in microseconds."""
    if entry and t < entry[0]:
        return "late", value, t, entry
    if entry and not fresh and t < entry[0] + ttl * 1_000_000:
        return "hit", entry[1], entry[0], entry
    return "refresh" if fresh else "miss", value, t, (t, value)


def _requests(requests: DataFrame, key: str, at: str, tie: str, value: str, refresh: Column | None) -> DataFrame:
    fresh = F.lit(False) if refresh is None else F.coalesce(refresh, F.lit(False))
    rows = requests.select(F.col(key).cast("string").alias("key"), F.col(tie).cast("long").alias("tie"), F.col(at).cast("timestamp").alias("at"), F.col(value).cast("double").alias("value"), fresh.alias("fresh"))
    return rows.where(F.col("at").isNotNull()).withColumn("t", F.unix_micros("at"))


def ttl_cache(requests: DataFrame, key: str, at: str, tie: str, value: str, ttl: int, refresh: Column | None = None) -> DataFrame:
    """Each request with its outcome; a key's requests are folded as they stream past in time order."""
    rows = _requests(requests, key, at, tie, value, refresh).select("key", "tie", "t", "value", "fresh")
    spread = rows.repartition("key").sortWithinPartitions("key", "t", "tie")

    def run(batches):
        entry = None
        for batch, a, b, same in grouped(batches, 0):
            if not same:
                entry = None
            part = batch.slice(a, b - a)
            out = []
            for t, v, fresh in zip(*(part.column(c).to_pylist() for c in ("t", "value", "fresh"))):
                *found, entry = answer(entry, t, v, fresh, ttl)
                out.append(found)
            outcome, values, stored = zip(*out)
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("tie"), part.column("t"), pa.array(outcome), pa.array(values, pa.float64()), pa.array(stored, pa.int64())], ["key", "tie", "t", "outcome", "value", "stored_t"])

    return spread.mapInArrow(run, f"key string, {ANSWER}")


class _Cache(StatefulProcessor):
    """One entry a key; ``lifetime`` in milliseconds lets the state itself expire, else timers do it."""

    def __init__(self, ttl: int, by_clock: bool):
        self.ttl, self.by_clock = ttl, by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "t long, value double", self.ttl * 1000 if self.by_clock else None)

    def _out(self, key, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([(key[0], *r) for r in rows], columns=["key", "tie", "t", "outcome", "value", "stored_t"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.entry.get()) if self.entry.exists() else None
        entry, out = held, []
        for x in pd.concat(list(rows)).sort_values(["t", "tie"]).itertuples():
            # by the clock the state is gone when its time is over; what is there is alive
            outcome, value, stored, entry = answer(entry, x.t, x.value, bool(x.fresh), self.ttl)
            out.append((x.tie, x.t, outcome, value, stored))
        if entry != held:
            self.entry.update(entry)
            if not self.by_clock:
                if held:
                    self.handle.deleteTimer(self._over(held))
                self.handle.registerTimer(self._over(entry))
        yield from self._out(key, out)

    def _over(self, entry: tuple[int, float]) -> int:
        return entry[0] // 1000 + self.ttl * 1000

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.entry.exists():
            return
        entry = tuple(self.entry.get())
        if self._over(entry) <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
            yield from self._out(key, [(-1, entry[0] + self.ttl * 1_000_000, "expired", entry[1], entry[0])])


def ttl_cache_stream(requests: DataFrame, key: str, at: str, tie: str, value: str, ttl: int, late: str = "10 minutes", refresh: Column | None = None) -> DataFrame:
    """The cache in event time: rows later than the watermark are dropped, and an ``expired`` row (tie -1) tells when it has passed an entry's end."""
    rows = _requests(requests, key, at, tie, value, refresh).withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(_Cache(ttl, False), f"key string, {ANSWER}", "Append", "EventTime")


def token_cache_stream(requests: DataFrame, key: str, at: str, tie: str, value: str, ttl: int, refresh: Column | None = None) -> DataFrame:
    """The cache by the clock: a key's state is removed by the store itself ``ttl`` seconds after it was written."""
    rows = _requests(requests, key, at, tie, value, refresh)
    return rows.groupBy("key").transformWithStateInPandas(_Cache(ttl, True), f"key string, {ANSWER}", "Append", "ProcessingTime")
