"""Ingestion, incremental updates and serving rows, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import ids
from ..functions.text import clip, excerpt
from ..operators import ingest, providers, vector
from ..scratch import scratch_path
from ..sources import files, monthly, paged, transcripts
from ..streaming import corpus
from .base import Suite, Tables

suite = Suite()
query = suite.query


@query("""SELECT source, doc_id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'late', doc_id FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 <> 0""")
def union_precedence(t: Tables) -> DataFrame:
    first = t.documents.where("doc_id % 2 = 0").select("doc_id", "source")
    second = t.documents.where("doc_id % 3 = 0").select("doc_id", F.lit("late").alias("source"))
    return ingest.union_preferring(first, second, "doc_id").select("source", "doc_id")


@query("""WITH d AS (SELECT source, sha256(concat_ws(chr(31), doc_id::VARCHAR, text)) AS h FROM documents),
s AS (SELECT source, count(*) AS n, sum(('0x' || h[1:15])::UBIGINT) AS a, sum(('0x' || h[16:30])::UBIGINT) AS b, sum(('0x' || h[31:45])::UBIGINT) AS c, sum(('0x' || h[46:60])::UBIGINT) AS d FROM d GROUP BY source)
SELECT source, sha256(concat_ws('-', n, a, b, c, d)) AS fingerprint FROM s""")
def corpus_fingerprint(t: Tables) -> DataFrame:
    return ingest.fingerprint(t.documents, [F.col("doc_id").cast("string"), F.col("text")], ["source"])


@query("""SELECT doc_id, source, n_chars FROM documents WHERE source <> 'src3' UNION ALL SELECT doc_id + 1000000, source, length(text) FROM documents WHERE source = 'src3' AND doc_id % 3 = 0""")
def incremental_overwrite(t: Tables) -> DataFrame:
    old = t.documents.select("doc_id", "source", "n_chars")
    new = t.documents.where("source = 'src3' AND doc_id % 3 = 0").select((F.col("doc_id") + 1_000_000).alias("doc_id"), "source", F.length("text").cast("long").alias("n_chars"))
    return ingest.replace_group(old, new, "source").select("doc_id", "source", "n_chars")


DELIVERED = "doc_id long, source string, text string, delivered long"


@query("""SELECT doc_id, source, CASE WHEN source = 'src3' THEN 'again ' || text ELSE text END AS text, md5(CASE WHEN source = 'src3' THEN 'again ' || text ELSE text END) AS output, CASE WHEN source = 'src3' THEN 1 ELSE 0 END::BIGINT AS batch FROM documents""")
def incremental_stream(t: Tables) -> DataFrame:
    """Three deliveries through the stream: all sources; one changed, one the same and one outdated; all the same again."""
    work = scratch_path(t.spark, "deliveries")
    docs = t.documents.select("doc_id", "source", "text")
    late = docs.where("source = 'src3'").withColumn("text", F.concat(F.lit("again "), "text")).unionByName(docs.where("source = 'src4'")).withColumn("delivered", F.lit(2).cast("long"))
    old = docs.where("source = 'src5'").withColumn("text", F.lit("outdated")).withColumn("delivered", F.lit(0).cast("long"))
    same = docs.where("source <> 'src3'").withColumn("delivered", F.lit(3).cast("long"))
    store = corpus.ChunkStore(t.spark, f"{work}/store", DELIVERED, lambda rows: rows.select("doc_id", "source", "text"), F.md5("text"))
    for name, delivery in (("a", docs.withColumn("delivered", F.lit(1).cast("long"))), ("b", late.unionByName(old)), ("c", same)):
        delivery.select("doc_id", "source", "text", "delivered").write.parquet(f"{work}/in/{name}")
        store.follow(f"{work}/in/*", f"{work}/checkpoint").awaitTermination()
    last = store._manifest().groupBy(F.col("source").alias("_k")).agg(F.max("batch").alias("batch"))
    return store.chunks().join(last, F.col("source").eqNullSafe(F.col("_k"))).select("doc_id", "source", "text", "output", "batch")


@query("""SELECT doc_id, md5(text) AS output, true AS cached FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE lang = 'fr')
UNION ALL SELECT doc_id, NULL, false FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'fr')""")
def memo_cache(t: Tables) -> DataFrame:
    cache = t.documents.where("lang = 'fr'").select(F.sha2("text", 256).alias("digest"), F.md5("text").alias("output")).distinct()
    done, todo = ingest.memo_todo(t.documents.select("doc_id", "text"), cache, "text")
    return done.select("doc_id", "output", F.lit(True).alias("cached")).unionByName(todo.select("doc_id", F.lit(None).cast("string").alias("output"), F.lit(False).alias("cached")))


@query("""WITH s AS (SELECT max(o_orderkey) AS top FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderdate < TIMESTAMP '1999-01-01')
SELECT o_orderkey FROM orders, s WHERE NOT (o_orderkey % 10 <> 0 AND o_orderdate < TIMESTAMP '1999-01-01') AND (o_orderkey > top OR o_orderdate >= TIMESTAMP '2000-06-01')""")
def new_entry_gate(t: Tables) -> DataFrame:
    seen = t.orders.where("o_orderkey % 10 <> 0 AND o_orderdate < TIMESTAMP_NTZ '1999-01-01 00:00:00'")
    return ingest.new_entries(seen, t.orders, "o_orderkey", F.col("o_orderkey"), F.col("o_orderdate") >= F.lit("2000-06-01").cast("timestamp_ntz")).select("o_orderkey")


@query("""SELECT p_partkey, p_name AS title, CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size END AS size, CASE WHEN p_type IN ('SMALL') THEN 'UNKNOWN' ELSE p_type END AS kind, (1980 + p_size)::INT AS year FROM part""")
def typed_catalog(t: Tables) -> DataFrame:
    raw = t.part.select(
        F.col("p_partkey").cast("string").alias("Id"),
        F.concat("p_name", F.lit(" ("), F.col("p_size") + 1980, F.lit(")")).alias("Film Title"),
        F.when(F.col("p_size") % 5 == 0, "n/a").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" mm"))).alias("Size"),
        F.when(F.col("p_type") == "SMALL", "None").otherwise(F.col("p_type")).alias("Kind"),
    )
    aliases = {"p_partkey": ["id"], "title": ["film", "film title"], "size": ["size"], "kind": ["kind", "type"]}
    rows = files.typed_catalog(raw, aliases, ("p_partkey", "size"), {"kind": "UNKNOWN"})
    return rows.select(F.col("p_partkey").cast("long").alias("p_partkey"), F.regexp_replace("title", r"\s*\(\d{4}\)$", "").alias("title"), "size", "kind", files.title_year(F.col("title")).alias("year"))


@query("""SELECT event_id, strftime(ts, '%Y-%m') AS month FROM events""")
def log_month_from_id(t: Tables) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    log_id = F.concat(F.lit("ql_"), F.lower(F.conv(ms.cast("string"), 10, 36)), F.lit("_x1y2z3"))
    return t.events.select("event_id", ids.log_month(log_id).alias("month"))


@query("""WITH x AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS b FROM documents) SELECT doc_id, CASE WHEN length(b) > 240 THEN left(b, 239) || '…' ELSE b END AS quote FROM x""")
def quote_clip(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", clip(F.col("text")).alias("quote"))


@query()
def keyword_excerpt(t: Tables) -> DataFrame:
    terms = F.array(F.lit("nation"), F.lit("heed"), F.lit("ing"))
    return t.documents.select("doc_id", excerpt(F.col("text"), terms, 300).alias("excerpt"))


@query("""SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS embedding FROM embeddings""")
def vector_rounding(t: Tables) -> DataFrame:
    rows = t.embeddings.withColumn("embedding", F.col("embedding").cast("array<double>"))
    return files.rounded_vectors(rows, "embedding").select("vec_id", "embedding")


@query()
def hashed_embedding_neighbours(t: Tables) -> DataFrame:
    texts = t.documents.select("doc_id", "text")
    vectors = providers.embed(texts, "text", providers.hashed_embedder()).select("doc_id", "embedding")
    queries = providers.embed(t.benchmark, "text", providers.hashed_embedder()).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector.neighbours(vectors, queries, 3, "doc_id")


@query("""WITH l AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'event: progress' WHEN 1 THEN 'data: p' || turn WHEN 2 THEN 'event: complete' ELSE 'data: done ' || turn END AS line FROM conversations)
SELECT conv_id, 'done ' || max(turn) AS data FROM l WHERE turn % 4 = 3 GROUP BY conv_id""")
def stream_last_complete(t: Tables) -> DataFrame:
    kind = F.col("turn") % 4
    line = F.when(kind == 0, F.lit("event: progress")).when(kind == 1, F.concat(F.lit("data: p"), "turn")).when(kind == 2, F.lit("event: complete")).otherwise(F.concat(F.lit("data: done "), "turn"))
    return files.events_of_stream(t.conversations.select("conv_id", "turn", line.alias("line")), "conv_id", "turn", "line")


@query("""WITH t AS (SELECT source, doc_id, n_chars, lang, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents), r AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS pos FROM t WHERE k = 1)
SELECT source, doc_id, n_chars, pos FROM r WHERE pos <= 8""")
def external_sources(t: Tables) -> DataFrame:
    per = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    first = t.documents.select("source", "doc_id", "n_chars").withColumn("k", F.row_number().over(per)).where("k = 1")
    top = first.orderBy(F.desc("n_chars"), "doc_id").limit(8)
    return top.select("source", "doc_id", "n_chars", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).cast("long").alias("pos"))


LOG = "o_orderkey long, at timestamp, tag string"


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1995 THEN 'urgent' ELSE o_orderstatus END AS tag, strftime(o_orderdate, '%Y-%m') AS month,
strftime(o_orderdate, '%Y-%m') IN (SELECT strftime(o_orderdate, '%Y-%m') FROM orders WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1995) AS written FROM orders""")
def retag_months(t: Tables) -> DataFrame:
    """Logs by month of which one year's urgent rows are tagged anew, twice: the second time no month is written."""
    path = scratch_path(t.spark, "log")
    at = F.col("o_orderdate").cast("timestamp")
    files.write_monthly(t.orders.select("o_orderkey", at.alias("at"), F.col("o_orderstatus").alias("tag")), path, "at")
    urgent = t.orders.where((F.col("o_orderpriority") == "1-URGENT") & (F.year("o_orderdate") == 1995))
    changes = urgent.select("o_orderkey", F.date_format(at, "yyyy-MM").alias("month"), F.lit("urgent").alias("tag"))
    written = monthly.update_months(t.spark, path, LOG, changes, "o_orderkey", ["tag"])
    again = monthly.update_months(t.spark, path, LOG, changes, "o_orderkey", ["tag"])
    rows = files.read_monthly(t.spark, path, LOG)
    return rows.select("o_orderkey", "tag", "month", (F.col("month").isin(written) & ~F.col("month").isin(again)).alias("written"))


CASE = "item_id long, text string"


@query("""SELECT 'set' || (item_id % 3) AS prefix, item_id, text, 1 AS rows FROM benchmark""")
def paged_cases(t: Tables) -> DataFrame:
    """Evaluation cases written as small files by prefix, read back in pages by the data source."""
    folder = scratch_path(t.spark, "cases")
    for k in range(3):
        t.benchmark.where(f"item_id % 3 = {k}").select("item_id", "text").coalesce(4).write.option("maxRecordsPerFile", 1).json(f"{folder}/set{k}")
    paged.register(t.spark)
    rows = t.spark.read.format("paged_json").option("path", folder).option("prefixes", "set0,set1,set2").option("page", 5).load()
    return rows.where("error IS NULL").select("prefix", F.from_json("record", CASE).alias("c")).select("prefix", "c.*").groupBy("prefix", "item_id", "text").agg(F.count("*").cast("int").alias("rows"))


_RENAMED_SQL = """CASE WHEN conv_id % 7 = 0 THEN conv_id + 1000000 ELSE conv_id END"""


@query(f"""SELECT {_RENAMED_SQL} AS conv_id, turn, role, CASE WHEN conv_id % 5 = 0 AND conv_id % 10 <> 0 THEN 'edited ' || text ELSE text END AS text FROM conversations""")
def transcript_store(t: Tables) -> DataFrame:
    """Transcripts saved, some edited, some of these restored, some renamed; names that exist or that two want are refused."""
    rows = t.conversations.select("conv_id", "turn", "role", "text")
    store = transcripts.TranscriptStore(t.spark, scratch_path(t.spark, "transcripts"), "conv_id long, turn long, role string, text string", "conv_id")
    store.save(rows)
    store.save(rows.where("conv_id % 5 = 0").withColumn("text", F.concat(F.lit("edited "), "text")))
    store.restore(rows.where("conv_id % 10 = 0"))
    old = rows.select(F.col("conv_id").alias("old")).distinct()
    taken = old.where("old % 7 IN (1, 2)").withColumn("new", F.col("old") + 1 - F.col("old") % 7 * 2)
    same = old.where("old % 7 IN (3, 4)").withColumn("new", F.lit(5_000_000).cast("long"))
    store.rename(old.where("old % 7 = 0").withColumn("new", F.col("old") + 1_000_000).unionByName(taken.join(old.withColumnRenamed("old", "new"), "new", "left_semi").select("old", "new")).unionByName(same))
    return store.load()
