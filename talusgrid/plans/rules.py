"""Rule-based classification of texts taken as questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import ids
from ..functions.text import alnum_title, normal_title, phrases, query_terms, search_tokens, slug
from ..operators import rules
from .base import Suite, Tables, tokens_sql

suite = Suite()
query = suite.query

INTENTS = (
    ("listing", r"\b(list|all)\b.*\bof\b"),
    ("count", r"\bhow many\b|\bnumber of\b"),
    ("latest", r"\b(latest|newest|last)\b"),
    ("who", r"\bwho\b|\bher\b"),
    ("place", r"\b(at|in) (the|a)\b"),
    ("definition", r"\bis\b|\bwas\b"),
)
USE_CASES = (("UC-01", r"\bwith\b.*\bfor\b"), ("UC-02", r"\bfrom\b"), ("UC-03", r"\bwhich\b|\bthis\b"), ("UC-04", r"(^|[ ,.])on([ ,.]|$)"))
GATES = (r"\bcompare\b", r"\bthat\b.*\bthat\b", r"\bare\b.*\bthe\b.*\bof\b")
TRIGGERS = {"factual": ("the ", "was ", "in "), "interpretive": ("with", "for", "that")}

_PLAIN = "trim(regexp_replace(translate({}, '‘’“”–—', '''''\"\"--'), '\\s+', ' ', 'g'))"
_LOW = f"lower({_PLAIN.format('text')})"


def _case(rules_: rules.Rules, other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(low, '{p}') THEN '{label}'" for label, p in rules_) + f" ELSE '{other}' END"


@query(f"WITH q AS (SELECT item_id, {_LOW} AS low FROM benchmark) SELECT item_id, {_case(INTENTS, 'none')} AS intent FROM q")
def intent_rules(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", rules.first_rule(F.col("text"), INTENTS).alias("intent"))


@query(f"WITH q AS (SELECT doc_id, {_LOW} AS low FROM documents) SELECT doc_id, {_case(USE_CASES, 'unclassified')} AS use_case FROM q")
def use_case_rules(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", rules.first_rule(F.col("text"), USE_CASES, "unclassified").alias("use_case"))


_N = {k: " + ".join(f"contains(lower(text), '{w}')::INT" for w in v) for k, v in TRIGGERS.items()}


@query(f"""WITH c AS (SELECT item_id, ({_N['factual']}) * 1e0 AS a, ({_N['interpretive']}) * 1e0 AS b FROM benchmark)
SELECT item_id, CASE WHEN a > b THEN 'factual' WHEN b > a THEN 'interpretive' ELSE 'hybrid' END AS kind,
round(CASE WHEN a <> b THEN least(0.8e0, 0.5e0 + 0.1e0 * greatest(a, b)) WHEN a > 0 THEN 0.6e0 ELSE 0.4e0 END, 6) AS confidence FROM c""")
def keyword_classifier(t: Tables) -> DataFrame:
    kind, confidence = rules.keyword_class(F.col("text"), TRIGGERS)
    return t.benchmark.select("item_id", kind.alias("kind"), confidence.alias("confidence"))


@query(f"WITH q AS (SELECT doc_id, {_LOW} AS low FROM documents) SELECT doc_id, " + " OR ".join(f"regexp_matches(low, '{p}')" for p in GATES) + " AS gated FROM q")
def agent_gate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", rules.any_rule(F.col("text"), GATES).alias("gated"))


@query(r"""WITH q AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'from ' || year(o_orderdate) || ' to 1996' WHEN 1 THEN 'in ' || year(o_orderdate) || ', best' WHEN 2 THEN 'the ' || year(o_orderdate) // 10 * 10 || 's hits' ELSE 'no year' END AS q, year(o_orderdate)::INT AS y FROM orders)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN least(y, 1996) WHEN 1 THEN y END AS lo, CASE o_orderkey % 4 WHEN 0 THEN greatest(y, 1996) WHEN 1 THEN y END AS hi, CASE WHEN o_orderkey % 4 = 2 THEN (y // 10 * 10)::INT END AS decade FROM q""")
def year_extraction(t: Tables) -> DataFrame:
    y = F.year("o_orderdate")
    kind = F.col("o_orderkey") % 4
    text = F.when(kind == 0, F.concat(F.lit("from "), y, F.lit(" to 1996"))).when(kind == 1, F.concat(F.lit("in "), y, F.lit(", best"))).when(kind == 2, F.concat(F.lit("the "), (F.floor(y / 10) * 10), F.lit("s hits"))).otherwise("no year")
    rows = t.orders.select("o_orderkey", text.alias("q"))
    lo, hi = rules.year_range(F.col("q"))
    return rows.select("o_orderkey", lo.alias("lo"), hi.alias("hi"), rules.decade_of(F.col("q")).alias("decade"))


@query("""WITH e AS (SELECT event_id, (event_id % 3600)::BIGINT AS s, (event_id * 7 % 9000)::BIGINT AS u FROM events)
SELECT event_id, s AS short, u AS long, 0::BIGINT AS bad, CASE WHEN u >= 3600 THEN (u // 3600)::VARCHAR || ':' || lpad((u % 3600 // 60)::VARCHAR, 2, '0') ELSE (u // 60)::VARCHAR END || ':' || lpad((u % 60)::VARCHAR, 2, '0') AS stamp FROM e""")
def ts_to_seconds(t: Tables) -> DataFrame:
    s, u = F.col("event_id") % 3600, F.col("event_id") * 7 % 9000
    short = F.concat(F.floor(s / 60), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
    rows = t.events.select("event_id", short.alias("a"), ids.stamp(u).alias("b"))
    return rows.select("event_id", ids.seconds(F.col("a")).alias("short"), ids.seconds(F.col("b")).alias("long"), ids.seconds(F.lit("x")).alias("bad"), F.col("b").alias("stamp"))


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size || 'b' || p_partkey % 7 ELSE 'x' END AS e, p_size FROM part)
SELECT p_partkey, round(CASE p_partkey % 3 WHEN 0 THEN p_size * 1e0 WHEN 1 THEN p_size + (p_partkey % 7) * 0.01e0 ELSE 0e0 END, 6) AS key,
CASE WHEN p_partkey % 3 = 0 AND p_size > 0 THEN 'S2E' || p_size ELSE 'S2 Bonus' END AS label FROM p""")
def sort_key(t: Tables) -> DataFrame:
    kind = F.col("p_partkey") % 3
    entry = F.when(kind == 0, F.col("p_size").cast("string")).when(kind == 1, F.concat("p_size", F.lit("b"), F.col("p_partkey") % 7)).otherwise("x")
    rows = t.part.select("p_partkey", entry.alias("e"))
    return rows.select("p_partkey", F.round(ids.sort_key(F.col("e")), 6).alias("key"), ids.entry_label(F.lit(2), F.col("e")).alias("label"))


@query("""WITH c AS (SELECT p_partkey, regexp_replace(p_name || ' (' || p_brand || ')', '[^a-zA-Z0-9]', '_', 'g') AS prefix FROM part)
SELECT p_partkey, prefix || '_' || p_partkey AS chunk, prefix, p_partkey AS number FROM c""")
def chunk_id_parse(t: Tables) -> DataFrame:
    title = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    rows = t.part.select("p_partkey", ids.chunk_id(title, F.col("p_partkey")).alias("chunk"))
    prefix, number = ids.chunk_parts(F.col("chunk"))
    return rows.select("p_partkey", "chunk", prefix.alias("prefix"), number.alias("number"))


@query("""SELECT p_partkey, p_name AS a, regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g') || ' ' || lower(p_type) AS b, left(replace(p_name, ' ', '-') || '-' || lower(p_type), 40) AS slug FROM part""")
def title_normalise(t: Tables) -> DataFrame:
    a = F.concat(F.lit("Episode 7: "), "p_name", F.lit(" (1994) "))
    b = F.concat("p_name", F.lit("!"), F.lit(" (2001) "), "p_type")
    return t.part.select("p_partkey", normal_title(a).alias("a"), alnum_title(b).alias("b"), slug(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"))


@query(f"SELECT item_id, array_to_string({tokens_sql('text')}, ' ') AS tokens FROM benchmark")
def search_token_lists(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.array_join(search_tokens(F.col("text")), " ").alias("tokens"))


@query()
def query_term_lists(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", query_terms(F.col("text")).alias("terms"), phrases(F.col("text")).alias("phrases"))


@query("SELECT user_id, n, least(4096, CASE WHEN user_id % 3 = 0 THEN 400 WHEN user_id % 3 = 1 THEN 1200 ELSE 800 END + n * 60)::BIGINT AS budget FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def token_budgets(t: Tables) -> DataFrame:
    kind = F.when(F.col("user_id") % 3 == 0, "factual").when(F.col("user_id") % 3 == 1, "interpretive").otherwise("hybrid")
    rows = t.events.groupBy("user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", "n", rules.token_budget(kind, F.col("n")).alias("budget"))
