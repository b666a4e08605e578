"""Fuzzy, scored, interval and as-of joins over parts, orders, labels and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import alnum_title
from ..operators import assignment, automaton, matching
from .base import Suite, Tables

suite = Suite()
query = suite.query

#: Questions that name parts well or badly; they meet the whole part table.
QUESTIONS = [(1, "price of a small ring today"), (2, "is the red widget or the blue bolt better"), (3, "nothing of that kind"), (4, "hot gear"), (5, "the small ring and small bolt")]
TITLES = [("small ring",), ("Red  Widget (1999)",), ("blu bolt",), ("gear",), ("zzz",), ("",)]


def _norm_sql(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({c}), '\\(\\d{{4}}\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


_TITLES_SQL = "q(q) AS (VALUES " + ", ".join(f"('{x}')" for (x,) in TITLES) + ")"


@query(f"""WITH {_TITLES_SQL}, a AS (SELECT q, {_norm_sql('q')} AS nq FROM q WHERE {_norm_sql('q')} <> ''), n AS (SELECT DISTINCT p_name, {_norm_sql('p_name')} AS nn FROM part),
m AS (SELECT q, p_name, CASE WHEN lower(q) = lower(p_name) THEN 1 WHEN nq = nn THEN 2 WHEN contains(nn, nq) THEN 3 WHEN levenshtein(nq, nn) <= greatest(1, length(nq) // 8) THEN 4 END AS tier FROM a, n),
b AS (SELECT *, min(tier) OVER (PARTITION BY q) AS best FROM m WHERE tier IS NOT NULL)
SELECT q, p_partkey, tier FROM b JOIN part USING (p_name) WHERE tier = best""")
def fuzzy_cascade(t: Tables) -> DataFrame:
    queries = t.rows("q string", TITLES).withColumn("norm_q", alnum_title(F.col("q")))
    rows = t.part.select("p_partkey", "p_name", alnum_title(F.col("p_name")).alias("norm"))
    return matching.cascade(queries, rows, "q", "p_name", "p_partkey").select("q", "p_partkey", "tier")


_QUESTIONS_SQL = "q(qid, q) AS (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in QUESTIONS) + ")"


@query(f"""WITH {_QUESTIONS_SQL}, n AS (SELECT DISTINCT p_name FROM part),
h AS (SELECT qid, p_name, row_number() OVER (PARTITION BY qid ORDER BY length(p_name) DESC, p_name) AS k FROM q, n WHERE contains(' ' || q || ' ', ' ' || p_name || ' '))
SELECT qid, p_name FROM h WHERE k = 1""")
def containment_longest(t: Tables) -> DataFrame:
    return matching.contained_titles(t.rows("qid int, q string", QUESTIONS), t.part, "qid", "q", "p_name")


_WORDS = "list_filter(string_split({}, ' '), lambda w: length(w) > 2)"


@query(f"""WITH a AS (SELECT DISTINCT p_name AS x FROM part), b AS (SELECT DISTINCT replace(p_name, 'ring', 'rings') AS y FROM part)
SELECT x, y FROM a, b WHERE x = y OR ((contains(x, y) OR contains(y, x)) AND least(length(x), length(y)) >= greatest(length(x), length(y)) * 0.7e0)
OR (greatest(len({_WORDS.format('x')}), len({_WORDS.format('y')})) > 0 AND len(list_filter({_WORDS.format('x')}, lambda w: list_contains({_WORDS.format('y')}, w))) / greatest(len({_WORDS.format('x')}), len({_WORDS.format('y')})) >= 0.6e0)""")
def fuzzy_name_join(t: Tables) -> DataFrame:
    right = t.part.select(F.regexp_replace("p_name", "ring", "rings").alias("y"))
    return matching.fuzzy_names(t.part.select(F.col("p_name").alias("x")), right, "x", "y")


@query(f"""WITH a AS (SELECT DISTINCT p_name AS x FROM part), b AS (SELECT DISTINCT p_type || ' ' || p_name AS y FROM part),
w AS (SELECT x, y, list_distinct({_WORDS.format('x')}) AS wx, list_distinct({_WORDS.format('y')}) AS wy FROM a, b),
s AS (SELECT x, y, CASE WHEN x = y THEN 100e0 WHEN contains(x, y) OR contains(y, x) THEN 80e0 WHEN len(list_intersect(wx, wy)) > 0 THEN 50 + 30e0 * len(list_intersect(wx, wy)) / greatest(len(wx), len(wy)) END AS score FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY score DESC, y) AS k FROM s WHERE score IS NOT NULL)
SELECT x, y, round(score, 6) AS score FROM r WHERE k = 1""")
def scored_best_match(t: Tables) -> DataFrame:
    left = t.part.select(F.col("p_name").alias("x")).distinct()
    right = t.part.select(F.concat("p_type", F.lit(" "), "p_name").alias("y")).distinct()
    best = assignment.best_titles(left, right, "x", "y", 80, lambda share: 50 + 30 * share, equal=100)
    return best.select("x", "y", F.round("score", 6).alias("score"))


_FILMS_SQL = f"""q AS (SELECT DISTINCT {_norm_sql("p_brand || ' (1999) ' || p_name")} AS q FROM part WHERE p_partkey % 2 = 0 UNION SELECT * FROM (VALUES ('bolt the of ring'), ('unheard of'), ('x'))),
c AS (SELECT DISTINCT {_norm_sql("p_name || ' ' || p_brand || ', ' || p_type")} AS c FROM part WHERE NOT contains(upper(p_name), 'GEAR'))"""


@query(f"""WITH {_FILMS_SQL}, w AS (SELECT q, c, list_distinct(string_split(q, ' ')) AS wq, list_distinct(string_split(c, ' ')) AS wc FROM q, c),
s AS (SELECT q, c, CASE WHEN q = c THEN 1e0 ELSE greatest(CASE WHEN contains(q, c) OR contains(c, q) THEN 0.8e0 ELSE 0 END, len(list_intersect(wq, wc)) / len(wq)) END AS score FROM w)
SELECT q AS wanted, c AS title, round(score, 6) AS score FROM s WHERE score > 0.5 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, c) = 1""")
def title_match(t: Tables) -> DataFrame:
    """Titles normalised, some of them skipped, matched by the share of the wanted one's words where that is over a half."""
    wanted = t.part.where("p_partkey % 2 = 0").select(alnum_title(F.concat("p_brand", F.lit(" (1999) "), "p_name")).alias("wanted"))
    wanted = wanted.unionByName(t.rows("wanted string", [("bolt the of ring",), ("unheard of",), ("x",)]))
    titles = t.part.where(~F.contains(F.upper("p_name"), F.lit("GEAR"))).select(alnum_title(F.concat("p_name", F.lit(" "), "p_brand", F.lit(", "), "p_type")).alias("title"))
    best = assignment.best_titles(wanted, titles, "wanted", "title", 0.8, lambda share: share, equal=1, above=0.5, longer=False, words=lambda c: F.split(c, " "))
    return best.select("wanted", "title", F.round("score", 6).alias("score"))


@query("""WITH d AS (SELECT source, doc_id FROM documents)
SELECT source, count(*) AS n_docs, count(l.doc_id) AS n_labelled, count(*) FILTER (l.toxic = 1) AS n_toxic, round(100e0 * count(l.doc_id) / count(*), 0)::INT AS pct FROM d LEFT JOIN labels l USING (doc_id) GROUP BY source""")
def coverage_outer(t: Tables) -> DataFrame:
    rows = t.documents.select("source", "doc_id").join(t.labels.select("doc_id", "toxic", F.lit(1).alias("there")), "doc_id", "left")
    n, k = F.count("*"), F.count("there")
    return rows.groupBy("source").agg(n.alias("n_docs"), k.alias("n_labelled"), F.count_if(F.col("toxic") == 1).alias("n_toxic"), F.round(F.lit(100.0) * k / n, 0).cast("int").alias("pct"))


_RECONCILED_SQL = """l AS (SELECT DISTINCT p_name AS a FROM part), r AS (SELECT DISTINCT upper(p_name) || CASE WHEN length(p_name) % 2 = 0 THEN '' ELSE ' deluxe edition' END AS b FROM part UNION SELECT 'zzz none'),
e AS (SELECT a, b FROM l JOIN r ON lower(trim(a)) = lower(trim(b)))"""


@query(f"""WITH RECURSIVE {_RECONCILED_SQL},
c AS (SELECT a, b, len(list_filter({_WORDS.format('lower(a)')}, lambda w: list_contains({_WORDS.format('lower(b)')}, w))) / greatest(len({_WORDS.format('lower(a)')}), len({_WORDS.format('lower(b)')})) AS share
      FROM (SELECT a FROM l WHERE a NOT IN (SELECT a FROM e)), (SELECT b FROM r WHERE b NOT IN (SELECT b FROM e))
      WHERE len(list_filter({_WORDS.format('lower(a)')}, lambda w: list_contains({_WORDS.format('lower(b)')}, w))) / greatest(len({_WORDS.format('lower(a)')}), len({_WORDS.format('lower(b)')})) >= 0.5),
o AS (SELECT a, b, row_number() OVER (ORDER BY share DESC, a, b) AS k FROM c),
g AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS ua, []::VARCHAR[] AS ub UNION ALL
      SELECT o.k, CASE WHEN list_contains(ua, a) OR list_contains(ub, b) THEN ua ELSE list_append(ua, a) END, CASE WHEN list_contains(ua, a) OR list_contains(ub, b) THEN ub ELSE list_append(ub, b) END FROM g JOIN o ON o.k = g.k + 1),
f AS (SELECT unnest(ua) AS a, unnest(ub) AS b FROM (SELECT * FROM g ORDER BY k DESC LIMIT 1))
SELECT a, b, 'equal' AS state FROM e UNION ALL SELECT a, b, 'alike' FROM f UNION ALL SELECT a, NULL, 'left only' FROM l WHERE a NOT IN (SELECT a FROM e) AND a NOT IN (SELECT a FROM f)
UNION ALL SELECT NULL, b, 'right only' FROM r WHERE b NOT IN (SELECT b FROM e) AND b NOT IN (SELECT b FROM f)""")
def coverage_reconciliation(t: Tables) -> DataFrame:
    left = t.part.select(F.col("p_name").alias("a"))
    suffix = F.when(F.length("p_name") % 2 == 0, F.lit("")).otherwise(" deluxe edition")
    right = t.part.select(F.concat(F.upper("p_name"), suffix).alias("b")).unionByName(t.rows("b string", [("zzz none",)]))
    return matching.reconcile(left, right, "a", "b")


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def missing_anti(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left_anti")


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'view'),
j AS (SELECT p.event_id, p.user_id, p.ts, v.ts AS value_at, v.value, row_number() OVER (PARTITION BY p.event_id ORDER BY v.ts DESC, v.event_id DESC) AS k FROM p LEFT JOIN v ON p.user_id = v.user_id AND v.ts <= p.ts)
SELECT event_id, user_id, ts, value_at, value FROM j WHERE k = 1""")
def asof_latest_le(t: Tables) -> DataFrame:
    events = t.events
    return matching.as_of(events.where("event_type = 'purchase'"), events.where("event_type = 'view'"), "user_id", "ts", "value", "event_id").select("event_id", "user_id", "ts", "value_at", "value")


@query("""WITH s AS (SELECT conv_id, turn, turn * 40 AS start FROM conversations), p(t0) AS (VALUES (-5), (0), (39), (120), (100000))
SELECT conv_id, t0, coalesce(max(turn) FILTER (start <= t0), 0) AS active FROM s, p GROUP BY ALL""")
def asof_point(t: Tables) -> DataFrame:
    start = F.col("turn") * 40
    points = (-5, 0, 39, 120, 100000)
    rows = t.conversations.groupBy("conv_id").agg(F.array(*[F.struct(F.lit(p).alias("t0"), F.coalesce(F.max(F.when(start <= p, F.col("turn"))), F.lit(0).cast("long")).alias("active")) for p in points]).alias("a"))
    return rows.select("conv_id", F.inline("a"))


@query("""WITH f AS (SELECT event_id AS fk, user_id, ts AS ft FROM events WHERE event_type = 'purchase'), l AS (SELECT event_id AS lk, user_id, ts AS lt FROM events WHERE event_type IN ('click', 'view')),
p AS (SELECT fk, lk, user_id, epoch_us(ft) - epoch_us(lt) AS gap FROM f JOIN l USING (user_id) WHERE epoch_us(ft) - epoch_us(lt) >= 0 AND epoch_us(ft) - epoch_us(lt) < 1800000000),
c AS (SELECT *, CASE WHEN gap < 300000000 THEN 0 ELSE 1 END AS tier, row_number() OVER (PARTITION BY fk ORDER BY CASE WHEN gap < 300000000 THEN 0 ELSE 1 END, gap, lk) AS k FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY lk ORDER BY gap, fk) AS n FROM c WHERE k = 1)
SELECT fk AS f_key, lk AS l_key, user_id, tier, gap AS gap_us FROM o WHERE n = 1""")
def feedback_interval_nearest(t: Tables) -> DataFrame:
    events = t.events
    return matching.nearest_before(events.where("event_type = 'purchase'"), events.where(F.col("event_type").isin("click", "view")), "user_id", "ts", "event_id")


@query("""WITH o AS (SELECT o_orderkey, year(o_orderdate)::INT AS y FROM orders), s AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) AS k FROM supplier)
SELECT n_nationkey, n_name, s_suppkey FROM nation LEFT JOIN s ON s_nationkey = n_nationkey AND k = 1""")
def last_wins_lookup(t: Tables) -> DataFrame:
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_suppkey"))
    last = t.supplier.withColumn("k", F.row_number().over(w)).where("k = 1").select("s_nationkey", "s_suppkey")
    return t.nation.join(last, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_nationkey", "n_name", "s_suppkey")


@query("SELECT c_custkey FROM customer SEMI JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def semi_join_members(t: Tables) -> DataFrame:
    return t.customer.where("c_mktsegment = 'BUILDING'").join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


_HEADS_SQL = "list_aggregate(string_split(lower(text), ' ')[1:3], 'string_agg', ' ')"


@query(f"""WITH n AS (SELECT DISTINCT {_HEADS_SQL} AS name FROM benchmark), d AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT doc_id, name, len(string_split(t, name)) - 1 AS places, strpos(t, name) - 1 AS first FROM d, n WHERE contains(t, name)""")
def names_in_documents(t: Tables) -> DataFrame:
    """Where the items' first three words stand in whole documents."""
    heads = t.benchmark.select(F.array_join(F.slice(F.split(F.lower("text"), " "), 1, 3), " ").alias("name"))
    found = automaton.places(t.documents, heads, "doc_id", "text", "name", whole_words=False)
    return found.groupBy("doc_id", "name").agg(F.count("*").alias("places"), F.min("start").alias("first"))
