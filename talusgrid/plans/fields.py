"""Projections, extractors, gates and question dispatch over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import ids
from ..operators import catalog, dialogue, ingest, matching, rules
from .base import Suite, Tables

suite = Suite()
query = suite.query


@query("""WITH c AS (SELECT l_orderkey, list(struct_pack(n := l_linenumber, job := l_returnflag, name := l_partkey::VARCHAR) ORDER BY l_linenumber, l_returnflag, l_partkey::VARCHAR) AS crew FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, list_transform(list_filter(crew, lambda x: x.job = 'R'), lambda x: x.name) AS directors,
       list_transform(list_filter(crew, lambda x: x.job IN ('A', 'N')), lambda x: x.name) AS cinematographers, list_transform(crew[1:4], lambda x: x.name) AS top FROM c""")
def credits_projection(t: Tables) -> DataFrame:
    person = F.struct(F.col("l_linenumber").alias("order"), F.col("l_returnflag").alias("job"), F.col("l_partkey").cast("string").alias("name"))
    crew = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(person)).alias("crew"))  # a few lines an order
    return crew.select("l_orderkey", catalog.with_jobs(F.col("crew"), "R").alias("directors"), catalog.with_jobs(F.col("crew"), "A", "N").alias("cinematographers"), catalog.billed(F.col("crew"), 4).alias("top"))


@query(r"""SELECT conv_id, turn FROM conversations WHERE role = 'user' AND turn * 40 BETWEEN 40 AND 200 AND len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')) > 2""")
def visible_turns(t: Tables) -> DataFrame:
    return dialogue.visible(t.conversations, "role", "text", F.col("turn") * 40, "user", 40, 200).select("conv_id", "turn")


@query("""WITH g AS (SELECT event_type, date_trunc('day', ts) AS day, avg((value > 40)::INT) AS share FROM events GROUP BY ALL)
SELECT event_id FROM events e JOIN g ON g.event_type = e.event_type AND g.day = date_trunc('day', e.ts) WHERE share <= 0.45e0""")
def failure_gate(t: Tables) -> DataFrame:
    rows = t.events.withColumn("day", F.date_trunc("day", "ts"))
    return ingest.failure_gate(rows, F.col("value") > 40, ["event_type", "day"], 0.45).select("event_id")


@query("""SELECT lang, array_to_string(list_sort(list(DISTINCT source)), ', ') AS sources, arg_max(source, struct_pack(n := n_chars, k := -doc_id)) AS main_source FROM documents GROUP BY lang""")
def source_rollup(t: Tables) -> DataFrame:
    main = F.max_by("source", F.struct(F.col("n_chars"), -F.col("doc_id"))).alias("main_source")
    return t.documents.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"), main)


@query(r"""WITH q AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'from 1998 to ' || year(o_orderdate) WHEN 1 THEN 'best of ' || year(o_orderdate) WHEN 2 THEN 'the ' || year(o_orderdate) || 's' ELSE 'in 1850' END AS q, year(o_orderdate)::INT AS y FROM orders)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 1998 WHEN 1 THEN y END AS lo, CASE o_orderkey % 4 WHEN 0 THEN y WHEN 1 THEN y END AS hi FROM q""")
def year_range_as_written(t: Tables) -> DataFrame:
    y, kind = F.year("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(kind == 0, F.concat(F.lit("from 1998 to "), y)).when(kind == 1, F.concat(F.lit("best of "), y)).when(kind == 2, F.concat(F.lit("the "), y, F.lit("s"))).otherwise("in 1850")
    lo, hi = rules.year_range_as_written(text)
    return t.orders.select("o_orderkey", lo.alias("lo"), hi.alias("hi"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 1) THEN c_nationkey END AS number, CASE c_custkey % 4 WHEN 2 THEN 'nation' || c_nationkey END AS picker FROM customer""")
def number_and_picker(t: Tables) -> DataFrame:
    kind = F.col("c_custkey") % 4
    asked = F.when(kind == 0, F.concat(F.lit("What happens in Episode #"), "c_nationkey", F.lit("?"))).when(kind == 1, F.concat(F.lit("tell me about ep. "), "c_nationkey")).when(
        kind == 2, F.concat(F.lit("who did nation"), "c_nationkey", F.lit(" pick for the lead")))
    asked = asked.otherwise("nothing of that kind")
    return t.customer.select("c_custkey", rules.item_number(asked).alias("number"), rules.picker(asked).alias("picker"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn <> 3 AND length(text) > 50 THEN 'host' ELSE role END AS role, CASE WHEN role = 'assistant' AND turn <> 3 AND length(text) > 50 THEN role END AS was FROM conversations""")
def relabel_everywhere(t: Tables) -> DataFrame:
    excluded = t.conversations.where("turn = 3").select("conv_id", "turn")
    return dialogue.relabel_label(t.conversations, ["conv_id", "turn"], "role", "assistant", " host ", excluded, F.length("text") > 50).select("conv_id", "turn", "role", "was")


@query("""SELECT p_partkey, list_filter(['brand', CASE WHEN p_size > 25 THEN 'size' END, CASE WHEN p_type <> 'SMALL' THEN 'type' END], lambda x: x IS NOT NULL) AS names,
list_filter([p_brand, CASE WHEN p_size > 25 THEN p_size::VARCHAR END, nullif(p_type, 'SMALL')], lambda x: x IS NOT NULL) AS filled FROM part""")
def filled_fields_map(t: Tables) -> DataFrame:
    size = F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise("")
    found = ids.filled_fields({"brand": F.col("p_brand"), "size": size, "type": F.when(F.col("p_type") != "SMALL", F.col("p_type"))})
    return t.part.select("p_partkey", F.map_keys(found).alias("names"), F.map_values(found).alias("filled"))


@query("""WITH o AS (SELECT source, count(*) AS n FROM documents WHERE source <> 'src4' AND NOT (source = 'src5' AND doc_id % 2 = 0) GROUP BY source), c AS (SELECT source, count(*) AS n FROM documents WHERE source <> 'src6' GROUP BY source)
SELECT coalesce(c.source, o.source) AS source, CASE WHEN o.n IS NULL THEN 'new' WHEN c.n IS NULL THEN 'gone' WHEN o.n = c.n THEN 'same' ELSE 'changed' END AS state FROM c FULL JOIN o ON c.source = o.source""")
def manifest_changes(t: Tables) -> DataFrame:
    parts = [F.col("doc_id").cast("string"), F.col("text")]
    known = ingest.fingerprint(t.documents.where("source <> 'src4' AND NOT (source = 'src5' AND doc_id % 2 = 0)"), parts, ["source"])
    return ingest.manifest_changes(known, ingest.fingerprint(t.documents.where("source <> 'src6'"), parts, ["source"]), "source")


@query("""SELECT CASE WHEN doc_id % 3 = 0 THEN source || '_part' ELSE source END AS prefix, count(*) AS n FROM documents GROUP BY prefix""")
def segment_prefixes(t: Tables) -> DataFrame:
    stem = F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit("_part"))).otherwise(F.col("source"))
    chunk = F.concat(stem, F.lit("_"), "doc_id")
    return t.documents.select(ids.chunk_parts(chunk)[0].alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))


QUESTIONS = [(1, "what did small ring make"), (2, "films by gizmo please"), (3, "is blue bolt better than bolt"), (4, "nothing here"), (5, "red widgets")]
_QUESTIONS_SQL = "q(qid, q) AS (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in QUESTIONS) + ")"


@query(rf"""WITH {_QUESTIONS_SQL}, n AS (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', -1) AS family FROM part),
m AS (SELECT qid, name, CASE WHEN contains(q, name) THEN length(name) WHEN length(family) >= 4 AND list_contains(regexp_split_to_array(q, '[^a-z]+'), family) THEN length(family) END AS size FROM q, n)
SELECT qid, name, size::INT AS size FROM m WHERE size IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid ORDER BY size DESC, name) = 1""")
def person_match(t: Tables) -> DataFrame:
    return matching.people_in(t.rows("qid int, q string", QUESTIONS), t.part.select(F.col("p_name").alias("name")), "qid", "q", "name")


ASKED = [(1, "how many orders are there"), (2, "what is the latest order"), (3, "who is the top customer"), (4, "which years"), (5, "tell me a story")]
INTENTS = (("count", r"\bhow many\b"), ("latest", r"\blatest\b|\bnewest\b"), ("top", r"\btop\b|\bmost\b"), ("years", r"\byears?\b"))


@query("""WITH a(id, intent) AS (VALUES (1, 'count'), (2, 'latest'), (3, 'top'), (4, 'years'), (5, 'none')),
f AS (SELECT 'count' AS intent, count(*)::VARCHAR AS answer FROM orders UNION ALL SELECT 'latest', arg_max(o_orderkey, struct_pack(d := o_orderdate, k := -o_orderkey))::VARCHAR FROM orders
UNION ALL SELECT 'top', (SELECT o_custkey::VARCHAR FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 1) UNION ALL SELECT 'years', min(year(o_orderdate)) || ' to ' || max(year(o_orderdate)) FROM orders)
SELECT id, a.intent, answer FROM a LEFT JOIN f ON a.intent = f.intent""")
def intent_dispatch(t: Tables) -> DataFrame:
    asked = t.rows("id int, question string", ASKED).select("id", rules.first_rule(F.col("question"), INTENTS).alias("intent"))
    year = F.year("o_orderdate")
    facts = t.orders.agg(
        F.count("*").cast("string").alias("count"), F.max_by("o_orderkey", F.struct(F.col("o_orderdate"), -F.col("o_orderkey"))).cast("string").alias("latest"),
        F.concat(F.min(year), F.lit(" to "), F.max(year)).alias("years"),
    )
    top = t.orders.groupBy("o_custkey").count().orderBy(F.desc("count"), "o_custkey").limit(1).select(F.lit("top").alias("intent"), F.col("o_custkey").cast("string").alias("answer"))
    answers = facts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("intent"), F.col(c).alias("answer")) for c in facts.columns]))).unionByName(top)
    return asked.join(answers, "intent", "left").select("id", "intent", "answer")
