"""Stores that follow changes: batches that are replayed or killed, segments against a rebuilt index, block bounds against a full search."""

import random

import pytest
from pyspark.sql import functions as F

from talusgrid.operators import blockmax, lexical, segments
from talusgrid.scratch import scratch_path, shared_folder
from talusgrid.streaming.corpus import ChunkStore

DELIVERED = "doc_id long, source string, text string, delivered long"


def store(spark, path, **gate):
    shared_folder(spark)
    words = lambda rows: rows.select("doc_id", "source", F.explode(F.split("text", " ")).alias("text"))
    return ChunkStore(spark, str(path), DELIVERED, words, F.concat(F.lit("<"), "text", F.lit(">")), **gate)


def deliveries(spark):
    """Four batches: new sources (one null); one changed, one the same; an outdated one and a second of the batch; repeated rows."""
    rows = [
        [(1, "a", "x y", 1), (2, "a", "y z", 1), (3, "b", "x", 1), (4, None, "n", 1), (5, "c", "q q", 1)],
        [(1, "a", "x y", 2), (2, "a", "new z", 2), (3, "b", "x", 2)],
        [(5, "c", "old", 0), (6, "d", "first", 3), (6, "d", "second", 4)],
        [(6, "d", "second", 5), (6, "d", "second", 5), (4, None, "n2", 5)],
    ]
    return [spark.createDataFrame(r, DELIVERED) for r in rows]


WHOLE = sorted([(1, "a", "x"), (1, "a", "y"), (2, "a", "new"), (2, "a", "z"), (3, "b", "x"), (4, "", "n2"), (5, "c", "q"), (5, "c", "q"), (6, "d", "second"), (6, "d", "second")])


def contents(s):
    rows = s.chunks().collect()
    assert all(r.output == f"<{r.text}>" for r in rows)
    return sorted((r.doc_id, "" if r.source is None else r.source, r.text) for r in rows)


def files(path):
    return {p.relative_to(path): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_whole_run(spark, tmp_path):
    s = store(spark, tmp_path / "s")
    written = []
    for n, batch in enumerate(deliveries(spark)):
        before = files(tmp_path / "s" / "chunks") if n else {}
        s.write_batch(batch, n)
        after = files(tmp_path / "s" / "chunks")
        written.append({str(p.parent) for p in after if after[p] != before.get(p)})
    assert contents(s) == WHOLE
    # a source that is the same or outdated keeps its files
    assert written[1] == {"source=a"} and written[2] == {"source=d"} and written[3] == {"source=d", "source=__HIVE_DEFAULT_PARTITION__"}
    assert {r.source: r.n for r in s.manifest().collect()} == {"a": 2, "b": 1, None: 1, "c": 1, "d": 2}
    # a text is worked out once, however often it comes
    assert s._memo().groupBy("digest").count().where("count > 1").count() == 0


@pytest.mark.parametrize("killed", [None, "memo", "chunks"])
def test_batches_again(spark, tmp_path, killed):
    """Every batch is killed between its writes, or was whole, and runs again."""
    s = store(spark, tmp_path / "s")
    for n, batch in enumerate(deliveries(spark)):
        s.write_batch(batch, n, stop_after=killed)
        s.write_batch(batch, n)
    assert contents(s) == WHOLE
    assert {r.source: r.n for r in s.manifest().collect()} == {"a": 2, "b": 1, None: 1, "c": 1, "d": 2}


def test_stream_and_next_stream(spark, tmp_path):
    s = store(spark, tmp_path / "s")
    batches = deliveries(spark)
    for n, batch in enumerate(batches[:2]):
        batch.coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        s.follow(str(tmp_path / "in/*"), str(tmp_path / "checkpoint")).awaitTermination()
    for n, batch in enumerate(batches[2:]):
        batch.coalesce(1).write.parquet(str(tmp_path / f"next/{n}"))
    s.follow(str(tmp_path / "next/*"), str(tmp_path / "second"), run=1).awaitTermination()
    assert contents(s) == WHOLE
    s.compact_memo(1)
    assert s._memo().where("run = 0").select("batch").distinct().collect()[0].batch == -1 or s._memo().where("run = 0 AND batch = -1").count() > 0
    s.write_batch(batches[3], 7, run=1)
    assert contents(s) == WHOLE


def test_gate_of_new_sources(spark, tmp_path):
    s = store(spark, tmp_path / "s", source_order=F.ascii("source"), recent=F.col("source") == "B")
    first, later = [(1, "m", "x", 1)], [(2, "c", "late", 2), (3, "z", "next", 2), (4, "B", "recent", 2), (1, "m", "y", 2)]
    for n, rows in enumerate((first, later)):
        s.write_batch(spark.createDataFrame(rows, DELIVERED), n)
    assert sorted(r.source for r in s.manifest().collect()) == ["B", "m", "z"]
    assert (1, "m", "y") in contents(s)


def documents(spark, texts):
    return spark.createDataFrame(sorted(texts.items()), "id long, text string")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_segments_equal_a_rebuilt_index(spark):
    rnd = random.Random(4)
    say = lambda: " ".join(rnd.choice(["aa", "bb", "cc", "dd", "ee", "ff gg", ""]) for _ in range(rnd.randint(0, 9)))
    now = {i: say() for i in range(40)}
    index = segments.SegmentedIndex.create(documents(spark, now), "id", "text", scratch_path(spark, "segments"))
    queries = spark.createDataFrame([(1, "aa bb"), (2, "ff dd dd"), (3, "none"), (4, "gg")], "query_id int, query string")
    for step in range(4):
        changed = {i: say() for i in rnd.sample(range(50), 8)}
        dead = rnd.sample(range(50), 6)
        index.apply(documents(spark, changed), spark.createDataFrame([(i,) for i in dead], "id long"), "id", "text")
        now = {i: t for i, t in now.items() if i not in dead} | changed
        if step == 2:
            index.compact()
            assert len(index.segments()) == 1
        whole, merged = lexical.build_index(documents(spark, now), "id", "text"), index.index()
        for name in ("postings", "docs", "terms", "stats"):
            want = getattr(whole, name)
            assert rows_of(getattr(merged, name).select(want.columns)) == rows_of(want), (step, name)
    assert rows_of(lexical.search_index(merged, queries, 5)) == rows_of(lexical.search(documents(spark, now), queries, 5, "id", "text"))


def test_block_bounds_give_the_full_search(spark):
    """Short documents with a rare word stand at the top; blocks of the frequent word alone stay unread."""
    rnd = random.Random(6)
    texts = {i: " ".join(["the"] * rnd.randint(1, 3) + [rnd.choice(["aa", "bb", "cc"])] * rnd.randint(0, 2) + ["pad"] * rnd.randint(0, 60)) for i in range(3000)}
    for i in range(100, 2900, 700):
        texts[i] = "the rare rare the"
    docs = documents(spark, texts)
    queries = spark.createDataFrame([(1, "the rare"), (2, "aa bb"), (3, "the"), (4, "nothing"), (5, "pad cc the rare aa")], "query_id int, query string")
    for shard_docs in (50_000, 800):
        index = blockmax.build(lexical.build_index(docs, "id", "text"), shard_docs)
        for k in (1, 4, 20):
            best, read = blockmax.search(index, queries, k)
            want = lexical.search(docs, queries, k, "id", "text")
            assert rows_of(best.select("query_id", "id", "score", "rank")) == rows_of(want.select("query_id", "id", "score", "rank"))
            counts = {r.query_id: (r.blocks, r.needed) for r in read.collect()}
        if shard_docs == 50_000:
            best, read = blockmax.search(index, queries, 4)
            blocks, needed = {r.query_id: (r.blocks, r.needed) for r in read.collect()}[1]
            assert needed < blocks / 2
    assert 4 not in counts


def test_packed_numbers():
    import numpy as np

    for top in (0, 200, 60_000, 3 << 30, 1 << 40):
        values = np.array([0, 1, top], np.int64)
        assert blockmax.unpack(blockmax.pack(values)).tolist() == values.tolist()
    assert len(blockmax.pack(np.arange(100))) == 101
