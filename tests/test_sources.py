"""Logs that are changed by month, and the paged data source as batch and stream."""

import json

import pytest
from pyspark.sql import functions as F

from talusgrid.sources import files, monthly, paged

LOG = "id long, at timestamp, tag string, note string"


@pytest.fixture
def log(spark, tmp_path):
    rows = spark.range(60).select("id", F.timestamp_micros(F.lit(1_700_000_000_123_457) + F.col("id") * 86_400_000_000).alias("at"), F.lit("old").alias("tag"), F.when(F.col("id") % 2 == 0, "x").alias("note"))
    files.write_monthly(rows, str(tmp_path / "log"), "at")
    return tmp_path / "log"


def stamps(path):
    return {p.relative_to(path): p.stat().st_mtime_ns for p in path.rglob("*.json")}


def changes(spark, rows):
    return spark.createDataFrame(rows, "month string, id long, tag string")


def test_only_changed_months_are_written(spark, log):
    before = stamps(log)
    todo = changes(spark, [("2023-12", 20, "new"), ("2023-12", 20, "newer"), ("2023-11", 1, "old"), ("2023-11", 999, "nobody"), ("2024-07", 1, "none")])
    assert monthly.update_months(spark, str(log), LOG, todo, "id", ["tag"]) == ["2023-12"]
    after = stamps(log)
    assert {p: t for p, t in before.items() if "2023-12" not in str(p)} == {p: t for p, t in after.items() if "2023-12" not in str(p)}
    rows = files.read_monthly(spark, str(log), LOG).collect()
    assert len(rows) == 60 and {r.id: r.tag for r in rows if r.tag != "old"} == {20: "newer"}
    assert {r.at.microsecond for r in rows} == {123457} and sum(r.note is None for r in rows) == 30
    assert monthly.update_months(spark, str(log), LOG, todo, "id", ["tag"]) == [] and stamps(log) == after


def test_another_writer_is_noticed(spark, log):
    def other():
        files.write_monthly(spark.createDataFrame([(777, "n", None)], "id long, tag string, note string").withColumn("at", F.timestamp_seconds(F.lit(1_702_000_000))), str(log), "at")

    with pytest.raises(monthly.LostUpdate):
        monthly.update_months(spark, str(log), LOG, changes(spark, [("2023-12", 20, "new")]), "id", ["tag"], other)
    rows = files.read_monthly(spark, str(log), LOG)
    assert rows.where("id = 777").count() == 1 and rows.where("tag = 'new'").count() == 0


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture
def folder(tmp_path):
    put(tmp_path / "a/p/1.json", json.dumps([{"k": 1}, {"k": "é"}]))
    put(tmp_path / "a/p/2.json", "{broken")
    put(tmp_path / "a/p/3.json", '{"k": 3}')
    put(tmp_path / "a/p/4.json", "")
    put(tmp_path / "a/p/note.txt", "x")
    put(tmp_path / "a/q/1.json", '{"k": 5}')
    put(tmp_path / "b/p/2.json", '{"k": 2}')
    put(tmp_path / "b/q/9.json", '{"k": 9}')
    return tmp_path


def source(reader, folder, **options):
    for key, value in {"path": f"{folder}/a", "prefixes": "p,q,none", "page": 2, "fallback": f"{folder}/b", **options}.items():
        reader = reader.option(key, value)
    return reader.load()


def test_pages_with_fallback_and_errors(spark, folder):
    paged.register(spark)
    df = source(spark.read.format("paged_json"), folder)
    rows = {(r.prefix, r.file, r.place): (json.loads(r.record)["k"] if r.record else None, r.error is not None, (r.origin or "")[-1:]) for r in df.collect()}
    assert rows == {
        ("p", "1.json", 0): (1, False, "a"), ("p", "1.json", 1): ("é", False, "a"), ("p", "2.json", 0): (2, False, "b"), ("p", "3.json", 0): (3, False, "a"),
        ("p", "4.json", None): (None, True, ""), ("q", "1.json", 0): (5, False, "a"), ("q", "9.json", 0): (9, False, "b"),
    }
    assert df.rdd.getNumPartitions() == 3
    assert {r.file for r in source(spark.read.format("paged_json"), folder, cursor="2.json").collect()} == {"3.json", "4.json", "9.json"}
    assert source(spark.read.format("paged_json"), folder, prefixes="none").count() == 0


def test_stream_goes_on_from_its_offset(spark, folder):
    paged.register(spark)
    stream = source(spark.readStream.format("paged_json"), folder)

    def take():
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        assert query.awaitTermination(60)
        return sorted((r.prefix, r.file) for r in spark.read.schema(paged.SCHEMA).parquet(f"{folder}/out").collect())

    first = take()
    assert len(first) == 7
    put(folder / "a/p/5.json", '{"k": 6}')
    assert take() == sorted([*first, ("p", "5.json")])


ENTRY = "entry string, n int, text string"


def test_transcripts_edited_restored_renamed(spark, tmp_path):
    from talusgrid.sources.transcripts import TranscriptStore

    store = TranscriptStore(spark, str(tmp_path / "t"), ENTRY, buckets=3)
    frame = lambda rows: spark.createDataFrame(rows, ENTRY)
    held = lambda: sorted(tuple(r) for r in store.load().select("entry", "n", "text").collect())
    first = [("a", 0, "x"), ("a", 1, None), ("b", 0, "y"), ("c", 0, "z"), ("c", 0, "z"), ("d", 0, "w")]
    store.save(frame(first))
    store.save(frame([("a", 0, "edited"), ("b", 0, "edited")]))
    assert held() == [("a", 0, "edited"), ("b", 0, "edited"), ("c", 0, "z"), ("c", 0, "z"), ("d", 0, "w")]
    store.restore(frame([("a", 0, ""), ("nobody", 0, "")]))
    assert [r for r in held() if r[0] == "a"] == sorted([("a", 0, "x"), ("a", 1, None)])
    pairs = [("a", "new"), ("b", "c"), ("c", "e"), ("d", "e"), ("q", "r"), ("a", "new")]
    told = {(r.old, r.new): r.outcome for r in store.rename(spark.createDataFrame(pairs, "old string, new string")).collect()}
    assert told == {("a", "new"): "renamed", ("b", "c"): "exists", ("c", "e"): "conflict", ("d", "e"): "conflict", ("q", "r"): "missing"}
    assert held() == sorted([("b", 0, "edited"), ("c", 0, "z"), ("c", 0, "z"), ("d", 0, "w"), ("new", 0, "x"), ("new", 1, None)])
    assert sorted(r.entry for r in store.raw().collect()) == ["a", "a", "b", "c", "c", "d"]
