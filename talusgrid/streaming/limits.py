"""Rate limits and error-rate latches per key.

The limiter's windows begin at a key's first event and restart lazily at the
next event after they ended; denied events leave the counters as they are.
"""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def step(state: list[tuple[float, int]], now: float, tiers: tuple[tuple[int, int], ...]) -> tuple[bool, int, list[tuple[float, int]]]:
    """(allowed, seconds to wait, new state); ``tiers`` are (window seconds, most events), shortest first.

    ``state`` holds each tier's window start and count, and is empty at first.
    """
    fresh = [(start, used) if state and now < start + window else (now, 0) for (start, used), (window, _) in zip(state or [(now, 0)] * len(tiers), tiers)]
    for (start, used), (window, most) in zip(fresh, tiers):
        if used >= most:
            return False, max(1, math.ceil(start + window - now)), fresh if state else fresh
    return True, 0, [(start, used + 1) for start, used in fresh]


def rate_limit(events: DataFrame, key: str, at: str, tie: str, tiers: tuple[tuple[int, int], ...]) -> DataFrame:
    """Each event with ``allowed`` and ``retry_after`` seconds, events of a key in time order.

    A key's events arrive sorted and are folded in Arrow batches as they come, so
    a key with very many events is never held as a whole.
    """
    rows = events.select(F.col(key), F.col(tie), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("_t"))
    kinds = [rows.schema[c].dataType.simpleString() for c in (key, tie)]
    spread = rows.repartition(F.col(key)).sortWithinPartitions(key, "_t", tie)

    def run(batches):
        current, state = object(), []
        for batch in batches:
            allowed, wait = [], []
            for k, now in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != current:
                    current, state = k, []
                ok, seconds, state = step(state, now, tiers)
                allowed.append(ok)
                wait.append(seconds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(allowed, pa.bool_()), pa.array(wait, pa.int64())], names=[key, tie, "allowed", "retry_after"])

    return spread.mapInArrow(run, f"`{key}` {kinds[0]}, `{tie}` {kinds[1]}, allowed boolean, retry_after long")


def rate_limit_stream(events: DataFrame, key: str, at: str, tie: str, tiers: tuple[tuple[int, int], ...]) -> DataFrame:
    """The limiter as streaming state; idle keys leave the state after the longest window."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(tie).cast("long").alias("tie"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("t"))
    longest = max(w for w, _ in tiers) * 1000

    def run(group, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(state.get[0], state.get[1])) if state.exists else []
        out = []
        for x in pd.concat(list(frames)).sort_values(["t", "tie"]).itertuples():
            ok, wait, held = step(held, x.t, tiers)
            out.append((group[0], x.tie, ok, wait))
        state.update(([s for s, _ in held], [n for _, n in held]))
        state.setTimeoutDuration(longest)
        yield pd.DataFrame(out, columns=["key", "tie", "allowed", "retry_after"])

    return rows.groupBy("key").applyInPandasWithState(
        run, "key string, tie long, allowed boolean, retry_after long", "starts array<double>, used array<int>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def error_latch(events: DataFrame, key: str, at: str, failed: Column, seconds: int = 300, least: int = 5, most: float = 0.2) -> DataFrame:
    """Events with the number and failures of the last ``seconds`` and ``disabled``: whether the rate was ever above ``most``."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    rows = events.withColumn("_t", micros).withColumn("_bad", failed.cast("long"))
    recent = Window.partitionBy(key).orderBy("_t").rangeBetween(-seconds * 1_000_000, 0)
    rows = rows.withColumn("n", F.count("*").over(recent)).withColumn("bad", F.sum("_bad").over(recent))
    over = (F.col("n") >= least) & (F.col("bad") / F.col("n") > most)
    ever = Window.partitionBy(key).orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_over", over).withColumn("disabled", F.max("_over").over(ever)).drop("_t", "_bad", "_over")


def windowed_counts(events: DataFrame, at: str, width: str = "5 minutes", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Counts per event-time window with a watermark, for streams as for tables."""
    rows = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    out = rows.groupBy(F.window("_at", width), by).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), by, "n")
