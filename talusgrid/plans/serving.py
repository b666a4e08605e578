"""Answer assembly, lookups, feedback and evaluation rows over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text
from ..operators import analytics, lexical, matching, providers, rules
from ..scratch import settle
from ..streaming import limits
from .base import Suite, Tables, tokens_sql
from .retrieval import bm25_sql

suite = Suite()
query = suite.query


@query("""WITH f AS (SELECT user_id, last(event_type ORDER BY ts, event_id) AS rating, count(*) AS n FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id)
SELECT c_custkey, coalesce(f.rating, 'unrated') AS rating, coalesce(n, 0) AS n FROM customer LEFT JOIN f ON f.user_id = c_custkey""")
def feedback_merge(t: Tables) -> DataFrame:
    rated = t.events.where(F.col("event_type").isin("purchase", "error"))
    last = rated.groupBy(F.col("user_id").alias("c_custkey")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("rating"), F.count("*").alias("n"))
    return t.customer.select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", F.coalesce("rating", F.lit("unrated")).alias("rating"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents)
SELECT source, string_agg('[' || k || '] doc ' || doc_id || ' (' || n_chars || ')', chr(10) ORDER BY k) AS context FROM r WHERE k <= 3 GROUP BY source""")
def context_blocks(t: Tables) -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    top = t.documents.select("source", "doc_id", "n_chars").withColumn("k", F.row_number().over(w)).where("k <= 3")
    line = F.concat(F.lit("["), "k", F.lit("] doc "), "doc_id", F.lit(" ("), "n_chars", F.lit(")"))
    lines = F.array_sort(F.collect_list(F.struct("k", line.alias("line"))))
    return top.groupBy("source").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"))


@query("""SELECT o_orderstatus, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_customers, CASE WHEN count(*) > 5000 THEN NULL ELSE count(*) || ' rows' END AS summary FROM orders GROUP BY o_orderstatus""")
def count_summary(t: Tables) -> DataFrame:
    n = F.count("*")
    return t.orders.groupBy("o_orderstatus").agg(n.alias("n_rows"), F.countDistinct("o_custkey").alias("n_customers"), F.when(n <= 5000, F.concat(n.cast("string"), F.lit(" rows"))).alias("summary"))


@query("""SELECT event_id, (props::JSON->>'k')::INT AS k FROM events""")
def json_from_text(t: Tables) -> DataFrame:
    noisy = F.concat(F.lit("Here it is: "), "props", F.lit(" as asked."))
    return t.events.select("event_id", F.get_json_object(text.json_block(noisy), "$.k").cast("int").alias("k"))


@query("""SELECT p_partkey, p_name AS title, p_brand || ' ' || p_size AS base FROM part""")
def title_cleanup(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("Bonus 3: "), "p_name", F.lit(" (1987)"))
    part = F.concat("p_brand", F.lit(" "), "p_size", F.lit(" Part "), F.col("p_partkey") % 4 + 1)
    return t.part.select("p_partkey", text.normal_title(raw).alias("title"), F.regexp_replace(part, r"\s+Part\s+\d+$", "").alias("base"))


@query("""SELECT conv_id, string_agg(CASE role WHEN 'assistant' THEN 'helper' ELSE role END, ', ' ORDER BY turn) AS speakers FROM conversations GROUP BY conv_id""")
def speaker_alias(t: Tables) -> DataFrame:
    named = F.array_sort(F.collect_list(F.struct("turn", "role")))
    alias = lambda x: F.when(x["role"] == "assistant", F.lit("helper")).otherwise(x["role"])
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(named, alias), ", ").alias("speakers"))


@query("""WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM benchmark), d(a, b) AS (VALUES ('the', 'THE'), ('in', 'IN'))
SELECT item_id, string_agg(coalesce(b, w), ' ' ORDER BY i) AS corrected FROM w LEFT JOIN d ON w = a GROUP BY item_id""")
def spelling_corrections(t: Tables) -> DataFrame:
    table = t.rows("w string, b string", [("the", "THE"), ("in", "IN")])
    words = t.benchmark.select("item_id", F.posexplode(F.split("text", " ")).alias("i", "w"))
    fixed = words.join(table, "w", "left").select("item_id", F.struct("i", F.coalesce("b", "w").alias("x")).alias("s"))
    return fixed.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]), " ").alias("corrected"))


@query("""WITH u AS (SELECT 0 AS o, p_partkey AS i, p_name AS term FROM part UNION ALL SELECT 1, p_partkey, p_brand FROM part UNION ALL SELECT 2, s_suppkey, s_name FROM supplier),
m AS (SELECT term, min(struct_pack(o := o, i := i)) AS head FROM u GROUP BY term)
SELECT term FROM m ORDER BY head, term LIMIT 80""")
def boost_terms(t: Tables) -> DataFrame:
    lists = [t.part.select(F.col("p_partkey").alias("i"), F.col("p_name").alias("term")), t.part.select(F.col("p_partkey").alias("i"), F.col("p_brand").alias("term")), t.supplier.select(F.col("s_suppkey").alias("i"), F.col("s_name").alias("term"))]
    rows = None
    for o, x in enumerate(lists):
        x = x.withColumn("o", F.lit(o))
        rows = x if rows is None else rows.unionByName(x)
    return rows.groupBy("term").agg(F.min(F.struct("o", "i")).alias("head")).orderBy("head", "term").limit(80).select("term")


NAMES = [("heed", "heed, heeded"), ("tion", "tion, nation"), ("ble", "ble")]


@query("""WITH n(name, variants) AS (VALUES ('heed', 'heed, heeded'), ('tion', 'tion, nation'), ('ble', 'ble'))
SELECT item_id, string_agg(variants, '; ' ORDER BY name) AS variants FROM benchmark JOIN n ON list_contains(regexp_split_to_array(lower(text), '[^a-z]+'), name) GROUP BY item_id""")
def target_speakers(t: Tables) -> DataFrame:
    table = t.rows("name string, variants string", NAMES)
    words = t.benchmark.select("item_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("name"))
    found = words.join(table, "name").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("name", "variants"))).alias("l"))
    return found.select("item_id", F.array_join(F.transform("l", lambda x: x["variants"]), "; ").alias("variants"))


@query("""WITH c AS (SELECT DISTINCT lower(p_type || ' ' || p_name) AS cited FROM part), n AS (SELECT DISTINCT p_name AS title FROM part)
SELECT cited, title FROM c, n WHERE length(title) >= 3 AND (contains(cited, title) OR contains(title, cited))""")
def citation_match(t: Tables) -> DataFrame:
    cited = t.part.select(F.lower(F.concat("p_type", F.lit(" "), "p_name")).alias("cited")).distinct()
    titles = t.part.select(F.col("p_name").alias("title")).distinct().where(F.length("title") >= 3)
    return matching.inside(cited, titles, "cited", "title")


@query("""WITH s AS (SELECT a.p_partkey AS a, b.p_partkey AS b, (b.p_type = 'SMALL')::INT * 3 + CASE WHEN starts_with(b.p_name, split_part(a.p_name, ' ', 1)) THEN 4 ELSE 0 END + CASE WHEN a.p_size = b.p_size THEN 3 WHEN abs(a.p_size - b.p_size) <= 1 THEN 1 ELSE 0 END AS score
  FROM part a JOIN part b ON a.p_brand = b.p_brand AND b.p_partkey <> a.p_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM s) SELECT a, b, score::INT AS score FROM r WHERE k = 1""")
def additive_match(t: Tables) -> DataFrame:
    a = t.part.select("p_brand", F.col("p_partkey").alias("a"), F.split("p_name", " ")[0].alias("lead"), "p_size")
    b = t.part.select("p_brand", F.col("p_partkey").alias("b"), "p_name", "p_type", "p_size")
    return matching.best_by_points(a, b, "p_brand", "a", "b", "lead", "p_name", "p_size", (F.col("p_type") == "SMALL").cast("int") * 3)


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders)
SELECT c_name, o_orderkey, day FROM customer JOIN r ON o_custkey = c_custkey AND k = 1""")
def debut_resolution(t: Tables) -> DataFrame:
    wanted = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    first = analytics.first_per_key(t.orders, [F.col("o_custkey")], F.asc("o_orderdate"), F.asc("o_orderkey"))
    return wanted.join(first, "o_custkey").select("c_name", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


@query("""WITH q(q) AS (VALUES ('small ring'), ('ring'), ('none such')), m AS (SELECT q, p_partkey, CASE WHEN p_name = q THEN 0 WHEN contains(p_name, q) THEN 1 END AS tier FROM q, part),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY tier, p_partkey) AS k FROM m WHERE tier IS NOT NULL) SELECT q, p_partkey FROM r WHERE k = 1""")
def first_lookup(t: Tables) -> DataFrame:
    return matching.first_named(t.part, "p_name", "p_partkey", ["small ring", "ring", "none such"])


@query("""WITH b AS (SELECT DISTINCT p_type AS title FROM part UNION SELECT DISTINCT p_type || ' ' || split_part(p_name, ' ', 1) FROM part UNION SELECT 'SMALL ri' UNION SELECT 'SMALL ring and more'),
n AS (SELECT DISTINCT p_type || ' ' || p_name AS name FROM part)
SELECT title, count(*) AS n, min(name) AS first_name FROM b, n WHERE starts_with(name, title) OR starts_with(title, name) GROUP BY title""")
def prefix_join(t: Tables) -> DataFrame:
    full = t.part.select(F.concat("p_type", F.lit(" "), "p_name").alias("name"))
    lead = F.concat("p_type", F.lit(" "), F.split("p_name", " ")[0])
    titles = t.part.select(F.explode(F.array("p_type", lead)).alias("title")).unionByName(t.rows("title string", [("SMALL ri",), ("SMALL ring and more",)]))
    pairs = matching.prefixes(titles, full, "title", "name")
    return pairs.groupBy("title").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


@query("""SELECT coalesce(doc_id, vec_id) AS id, CASE WHEN vec_id IS NULL THEN 'documents only' ELSE 'embeddings only' END AS side
FROM documents FULL JOIN embeddings ON doc_id = vec_id WHERE doc_id IS NULL OR vec_id IS NULL""")
def file_diff(t: Tables) -> DataFrame:
    a, b = t.documents.select(F.col("doc_id").alias("id")), t.embeddings.select(F.col("vec_id").alias("id"))
    only = lambda x, y, side: x.join(y, "id", "left_anti").select("id", F.lit(side).alias("side"))
    return only(a, b, "documents only").unionByName(only(b, a, "embeddings only"))


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS appearance FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'")
def guest_appearances(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.where("o_orderpriority <> '4-NOT SPECIFIED'").select("o_orderkey", "o_custkey", F.row_number().over(w).cast("long").alias("appearance"))


@query("""WITH c AS (SELECT d.doc_id, d.lang, l.doc_id IS NOT NULL AS labelled, coalesce(l.toxic, 0) = 1 AS review FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT lang, CASE WHEN NOT labelled THEN 'missing' WHEN review THEN 'review' ELSE 'complete' END AS state, count(*) AS n FROM c GROUP BY ALL""")
def coverage_modes(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "toxic", F.lit(True).alias("there")), "doc_id", "left")
    state = F.when(F.col("there").isNull(), "missing").when(F.col("toxic") == 1, "review").otherwise("complete")
    return rows.groupBy("lang", state.alias("state")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_id, value > 20 AS accepted, count(*) FILTER (value > 20) OVER (PARTITION BY user_id) AS n_accepted, count(*) FILTER (NOT value > 20) OVER (PARTITION BY user_id) AS n_rejected FROM events""")
def decision_split(t: Tables) -> DataFrame:
    ok = F.col("value") > 20
    counts = t.events.groupBy("user_id").agg(F.count_if(ok).alias("n_accepted"), F.count_if(~ok).alias("n_rejected"))
    return t.events.select("user_id", "event_id", ok.alias("accepted")).join(counts, "user_id")


@query("""WITH u AS (SELECT o_orderkey, 'status' AS who, o_orderstatus AS pick, o_orderdate FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority, o_orderdate FROM orders)
SELECT who, pick, count(*) AS n, arg_min(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS first_key FROM u WHERE lower(pick) NOT IN ('4-not specified') GROUP BY who, pick""")
def casting_picks(t: Tables) -> DataFrame:
    pairs = F.explode(F.array(F.struct(F.lit("status").alias("who"), F.col("o_orderstatus").alias("pick")), F.struct(F.lit("priority").alias("who"), F.col("o_orderpriority").alias("pick")))).alias("p")
    rows = t.orders.select("o_orderkey", "o_orderdate", pairs).select("o_orderkey", "o_orderdate", "p.*").where(F.lower("pick") != "4-not specified")
    return rows.groupBy("who", "pick").agg(F.count("*").alias("n"), F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_key"))


@query("""SELECT 'count' AS intent, count(*)::VARCHAR AS answer FROM orders UNION ALL SELECT 'latest', arg_max(o_orderkey, struct_pack(d := o_orderdate, k := -o_orderkey))::VARCHAR FROM orders
UNION ALL SELECT 'season', max(year(o_orderdate))::VARCHAR FROM orders UNION ALL SELECT 'top_customer', (SELECT o_custkey::VARCHAR FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 1)""")
def intent_answers(t: Tables) -> DataFrame:
    orders = t.orders
    facts = orders.agg(F.count("*").cast("string").alias("count"), F.max_by("o_orderkey", F.struct(F.col("o_orderdate"), -F.col("o_orderkey"))).cast("string").alias("latest"), F.max(F.year("o_orderdate")).cast("string").alias("season"))
    rows = facts.select(F.explode(F.map_from_arrays(F.array(F.lit("count"), F.lit("latest"), F.lit("season")), F.array("count", "latest", "season"))).alias("intent", "answer"))
    top = orders.groupBy("o_custkey").count().orderBy(F.desc("count"), "o_custkey").limit(1)
    return rows.unionByName(top.select(F.lit("top_customer").alias("intent"), F.col("o_custkey").cast("string").alias("answer")))


@query("""SELECT 'both' AS part, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'documents only', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT 'either', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)""")
def set_operations(t: Tables) -> DataFrame:
    a, b = t.documents.select("doc_id"), t.labels.select("doc_id")
    named = {"both": a.intersect(b), "documents only": a.subtract(b), "either": a.union(b).distinct()}
    out = None
    for name, rows in named.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT doc_id, source FROM documents ORDER BY md5('11:' || doc_id), doc_id LIMIT 20")
def seeded_sample(t: Tables) -> DataFrame:
    # by a hash of seed and key, so the sample depends on neither files nor partitions
    return t.documents.select("doc_id", "source").orderBy(F.md5(F.concat(F.lit("11:"), F.col("doc_id"))), "doc_id").limit(20)


@query("""WITH q AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') / count(*) AS bad FROM events GROUP BY user_id)
SELECT user_id, n > 60 AND bad < 0.25 AS skip_aggregate, bad >= 0.25 AND n <= 70 AS force_hybrid, n <= 60 AS quick FROM q""")
def routing_predicates(t: Tables) -> DataFrame:
    rows = t.events.groupBy("user_id").agg(F.count("*").alias("n"), (F.count_if(F.col("event_type") == "error") / F.count("*")).alias("bad"))
    return rows.select("user_id", ((F.col("n") > 60) & (F.col("bad") < 0.25)).alias("skip_aggregate"), ((F.col("bad") >= 0.25) & (F.col("n") <= 70)).alias("force_hybrid"), (F.col("n") <= 60).alias("quick"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN 'number ' || c_nationkey END AS found FROM customer""")
def guest_name_extraction(t: Tables) -> DataFrame:
    kind = F.col("c_custkey") % 3
    asked = F.when(kind == 0, F.concat(F.lit("which shows had "), "c_name", F.lit(" as a guest"))).when(kind == 1, F.concat(F.lit("play episode number "), "c_nationkey")).otherwise("nothing here")
    found = rules.captured(asked, (r"had (\S+) as a guest", r"episode (number \d+)"))
    return t.customer.select("c_custkey", found.alias("found"))


@query("""WITH bad AS (SELECT item_id, regexp_replace(left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40), '-+$', '') AS slug, lower(text) AS q FROM benchmark WHERE item_id % 3 <> 0)
SELECT item_id, slug FROM bad WHERE q NOT IN (SELECT lower(text) FROM benchmark WHERE item_id % 6 = 1)""")
def eval_skeletons(t: Tables) -> DataFrame:
    bad = t.benchmark.where("item_id % 3 <> 0").select("item_id", text.slug(F.col("text")).alias("slug"), F.lower("text").alias("q"))
    known = t.benchmark.where("item_id % 6 = 1").select(F.lower("text").alias("q"))
    return bad.join(known, "q", "left_anti").select("item_id", "slug")


@query()
def synthetic_cases(t: Tables) -> DataFrame:
    phrase = F.explode(text.phrases(F.col("text"))).alias("phrase")
    rows = t.documents.select("doc_id", "source", phrase)
    named = rows.withColumn("name", text.slug(F.concat(F.lit("quote "), "phrase")))
    return analytics.first_per_key(named, [F.col("name")], F.asc("doc_id"), F.asc("phrase")).orderBy(F.xxhash64("name"), "name").limit(50).select("name", "doc_id", F.concat(F.lit("Who said: "), "phrase").alias("question"))


@query("""WITH w AS (SELECT DISTINCT source, doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS topic FROM documents), c AS (SELECT topic, source, min(doc_id) AS doc_id FROM w WHERE length(topic) >= 9 GROUP BY topic, source)
SELECT topic, count(*) AS n_sources, min(doc_id) AS first_doc FROM c GROUP BY topic HAVING count(*) >= 4""")
def hard_negatives(t: Tables) -> DataFrame:
    words = t.documents.select("source", "doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("topic")).where(F.length("topic") >= 9)
    one = words.groupBy("topic", "source").agg(F.min("doc_id").alias("doc_id"))
    return one.groupBy("topic").agg(F.count("*").alias("n_sources"), F.min("doc_id").alias("first_doc")).where("n_sources >= 4")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_event_counts(t: Tables) -> DataFrame:
    return limits.windowed_counts(t.events, "ts", "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(f"""WITH {bm25_sql('SELECT item_id AS query_id, unnest(' + tokens_sql('text') + ') AS term FROM benchmark', 15)}, a AS (SELECT query_id, rank, rank || '. ' || source || '/' || id AS line FROM lx JOIN documents ON doc_id = id)
SELECT query_id AS item_id, string_agg(line, chr(10) ORDER BY rank) FILTER (rank <= 4) AS quick, string_agg(line, chr(10) ORDER BY rank) AS deep FROM a GROUP BY query_id""")
def answers_by_depth(t: Tables) -> DataFrame:
    """What stands in for written answers: the first 4 sources of a quick one, the first 15 of a deep one."""
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = lexical.search(t.documents, queries, 15, "doc_id", "text").join(t.documents.select(F.col("doc_id").alias("id"), "source"), "id")
    titled = settle(found.select("query_id", "rank", F.concat_ws("/", "source", "id").alias("title")))
    answer = lambda most, name: providers.templated_answer(titled, most).withColumnRenamed("answer", name)
    return answer(4, "quick").join(answer(15, "deep"), "query_id").withColumnRenamed("query_id", "item_id")
