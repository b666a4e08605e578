"""The cache with a lifetime: a fold against plain Python, a stream in event time with timers, a stream by the clock."""

import random
import time

import pytest
from pyspark.sql import functions as F

from talusgrid.streaming import cache

REQUESTS = "k string, id long, at timestamp, v double, fresh boolean"


def requests(spark, rows):
    """Rows of (key, id, seconds, value, fresh)."""
    df = spark.createDataFrame(rows, "k string, id long, s double, v double, fresh boolean")
    return df.select("k", "id", F.timestamp_seconds("s").alias("at"), "v", "fresh")


@pytest.fixture
def rocks(spark):
    for k, v in cache.ROCKSDB.items():
        spark.conf.set(k, v)
    yield
    for k in cache.ROCKSDB:
        spark.conf.unset(k)


def test_fold(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", None]), i, float(rnd.randint(0, 400)), float(i), rnd.random() < 0.1) for i in range(500)]
    df = requests(spark, [*rows]).unionByName(spark.createDataFrame([("a", 1000, None, 1.0, False)], REQUESTS))
    got = {r.tie: (r.outcome, r.value, r.stored_t) for r in cache.ttl_cache(df, "k", "at", "id", "v", 30, F.col("fresh")).collect()}
    want, entries = {}, {}
    for k, i, s, v, fresh in sorted(rows, key=lambda r: (r[2], r[1])):
        t = int(s * 1e6)
        if not fresh and k in entries and t < entries[k][0] + 30_000_000:
            want[i] = ("hit", entries[k][1], entries[k][0])
        else:
            entries[k] = (t, v)
            want[i] = ("refresh" if fresh else "miss", v, t)
    assert got == want
    assert cache.ttl_cache(df.limit(0), "k", "at", "id", "v", 30).count() == 0


def run_files(spark, out, folder, steps):
    """Each step's file is taken by a stream that goes on from the last one's checkpoint; the rows of all."""
    for n, rows in enumerate(steps):
        requests(spark, rows).coalesce(1).write.parquet(f"{folder}/in{n}")
        query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        assert query.awaitTermination(60)
    return spark.read.parquet(f"{folder}/out").collect()


def test_event_time_with_timers(spark, rocks, tmp_path):
    """Expiry, refresh, a late row within the watermark and one beyond it, file by file."""
    stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    out = cache.ttl_cache_stream(stream, "k", "at", "id", "v", 60, "20 seconds", F.col("fresh"))
    steps = [
        [("a", 1, 1000.0, 1.0, False), ("a", 2, 1030.0, 2.0, False), ("b", 3, 1010.0, 3.0, False)],
        [("a", 4, 1050.0, 4.0, True), ("b", 5, 1040.0, 5.0, False), ("a", 6, 1045.0, 6.0, False)],
        [("a", 7, 1041.0, 7.0, False), ("a", 8, 1005.0, 8.0, False)],
        [("c", 9, 1200.0, 9.0, False)],
        [("a", 10, 1210.0, 10.0, False), ("b", 11, 1190.0, 11.0, False)],
    ]
    got = run_files(spark, out, tmp_path, steps)
    seen = {r.tie: (r.outcome, r.value) for r in got if r.tie >= 0}
    assert seen[1] == ("miss", 1.0) and seen[2] == ("hit", 1.0) and seen[3] == ("miss", 3.0)
    assert seen[6] == ("hit", 1.0) and seen[4] == ("refresh", 4.0) and seen[5] == ("hit", 3.0)
    assert seen[7] == ("late", 7.0) and 8 not in seen
    assert seen[10] == ("miss", 10.0) and seen[11] == ("miss", 11.0)
    assert sorted((r.key, r.t // 1_000_000) for r in got if r.outcome == "expired") == [("a", 1110), ("b", 1070)]


def test_state_lives_by_the_clock(spark, rocks, tmp_path):
    stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    out = cache.token_cache_stream(stream, "k", "at", "id", "v", 20)
    query = out.writeStream.format("memory").queryName("tokens").outputMode("append").option("checkpointLocation", str(tmp_path / "checkpoint")).start()
    try:
        for n, wait in enumerate((0, 0, 22)):
            time.sleep(wait)
            requests(spark, [("a", n, 100.0 + n, float(n), False)]).coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
            for _ in range(60):  # in this mode batches never end, so rows are waited for
                if spark.table("tokens").where(f"tie = {n}").count():
                    break
                time.sleep(0.5)
    finally:
        query.stop()
    got = spark.table("tokens").collect()
    # in event time the third would be a hit: the store has removed the entry
    assert {r.tie: (r.outcome, r.value) for r in got} == {0: ("miss", 0.0), 1: ("hit", 0.0), 2: ("miss", 2.0)}
