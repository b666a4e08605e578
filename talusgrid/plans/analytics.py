"""Reports over events, labels, line items and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import analytics, quantiles
from ..streaming import cache, limits
from .base import Suite, Tables

suite = Suite()
query = suite.query


@query("""WITH e AS (SELECT date_trunc('week', ts)::DATE AS week, nullif(event_type, 'error') AS kind, CASE WHEN value > 60 THEN 'good' WHEN value < 5 THEN 'bad' END AS rating FROM events),
g AS (SELECT week, coalesce(kind, 'unclassified') AS label, count(*) AS n, count(rating) AS rated, count(*) FILTER (rating = 'good') AS good, count(*) FILTER (rating = 'bad') AS bad FROM e GROUP BY ALL)
SELECT *, round(n / sum(n) OVER (PARTITION BY week) * 1000) / 10 AS pct FROM g""")
def use_case_distribution_week(t: Tables) -> DataFrame:
    rating = F.when(F.col("value") > 60, "good").when(F.col("value") < 5, "bad")
    rows = t.events.withColumn("week", analytics.week_of(F.col("ts")))
    return analytics.distribution(rows, ["week"], F.nullif(F.col("event_type"), F.lit("error")), rating)


@query("""SELECT event_id, date_trunc('week', ts)::DATE::VARCHAR || '/' || (date_trunc('week', ts)::DATE + 6)::DATE::VARCHAR AS week FROM events
WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'""")
def use_case_drilldown(t: Tables) -> DataFrame:
    rows = t.events.where((F.col("event_type") == "purchase") & (F.col("ts") >= F.lit("2024-01-08").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")))
    return rows.select("event_id", analytics.week_label(F.col("ts")).alias("week"))


@query("SELECT event_type, round(median(value), 6) AS median, quantile_disc(value, 0.95) AS p95, round(avg(value::DECIMAL(18, 4)), 6) AS mean, count(value) AS n FROM events GROUP BY event_type")
def latency_summary(t: Tables) -> DataFrame:
    return quantiles.latency(t.events, "event_type", "value")


@query("""SELECT l_returnflag, quantile_disc(l_extendedprice, 0.01) AS p01, quantile_disc(l_extendedprice, 0.25) AS p25, quantile_disc(l_extendedprice, 0.999) AS p999, count(*) AS n FROM lineitem GROUP BY l_returnflag""")
def price_quantiles(t: Tables) -> DataFrame:
    """Ranks of three groups that hold a third of the rows each, found by brackets of at most 500 rows."""
    wanted = {"p01": quantiles.disc(0.01), "p25": quantiles.disc(0.25), "p999": quantiles.disc(0.999)}
    return quantiles.order_statistics(t.lineitem, "l_returnflag", "l_extendedprice", wanted, most=500).select("l_returnflag", *wanted, "n")


@query("""WITH p AS (SELECT doc_id, doc_id % 97 / 100e0 AS conf, quality FROM labels), b(bucket) AS (VALUES (0e0), (0.2e0), (0.4e0), (0.6e0), (0.8e0)),
g AS (SELECT CASE WHEN conf >= 0.8e0 THEN 0.8e0 WHEN conf >= 0.6e0 THEN 0.6e0 WHEN conf >= 0.4e0 THEN 0.4e0 WHEN conf >= 0.2e0 THEN 0.2e0 ELSE 0e0 END AS bucket, count(*) AS n, round(avg(quality), 6) AS accuracy FROM p GROUP BY 1)
SELECT bucket, coalesce(n, 0) AS n, accuracy FROM b LEFT JOIN g USING (bucket)""")
def calibration_buckets(t: Tables) -> DataFrame:
    return analytics.calibration(t.labels.withColumn("conf", F.col("doc_id") % 97 / F.lit(100.0)), "conf", "quality")


@query("""SELECT change, count(*) AS n FROM (SELECT CASE WHEN toxic = 0 AND quality = 0 THEN 'improved' WHEN quality = 1 AND toxic = 1 THEN 'regressed' ELSE 'unchanged' END AS change FROM labels) GROUP BY change""")
def eval_compare(t: Tables) -> DataFrame:
    a = t.labels.select("doc_id", (F.col("quality") == 1).alias("passed"))
    b = t.labels.select("doc_id", (F.col("toxic") == 0).alias("passed"))
    return analytics.compare_runs(a, b, "doc_id", "passed").groupBy("change").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT doc_id, concat_ws(',', CASE WHEN NOT n_chars >= 200 THEN 'long' END, CASE WHEN NOT lang = 'en' THEN 'english' END, CASE WHEN NOT contains(lower(text), 'the') THEN 'word' END) AS failures FROM documents)
SELECT doc_id, failures, failures = '' AS passed FROM c""")
def eval_assertions(t: Tables) -> DataFrame:
    checks = {"long": F.col("n_chars") >= 200, "english": F.col("lang") == "en", "word": F.contains(F.lower("text"), F.lit("the"))}
    return analytics.check_cases(t.documents, checks).select("doc_id", F.concat_ws(",", "failures").alias("failures"), "passed")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_suppkey, l_partkey % 10 ORDER BY l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM l WHERE k = 1""")
def song_dedup(t: Tables) -> DataFrame:
    found = analytics.first_per_key(t.lineitem, [F.col("l_suppkey"), F.col("l_partkey") % 10], F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey"))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""SELECT DISTINCT trim(unnest(string_split(p_name || ' / ' || p_type, '/'))) AS name FROM part""")
def guest_split_distinct(t: Tables) -> DataFrame:
    parts = F.split(F.concat("p_name", F.lit(" / "), "p_type"), r"\s*/\s*")
    return t.part.select(F.explode(parts).alias("name")).select(F.trim("name").alias("name")).distinct()


@query("""SELECT event_type AS kind, count(*) AS proposed, count(*) FILTER ((props::JSON->>'k')::INT >= 50) AS accepted, count(*) FILTER (NOT (props::JSON->>'k')::INT >= 50) AS rejected FROM events GROUP BY event_type""")
def decision_stats(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return analytics.decisions(t.events, F.col("event_type"), k >= 50)


@query("""WITH e AS (SELECT *, count(*) OVER w AS n, sum((event_type = 'error')::INT) OVER w AS bad FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 300 SECONDS PRECEDING AND CURRENT ROW)),
f AS (SELECT event_id, user_id, ts, n, bad::BIGINT AS bad, n >= 2 AND bad / n > 0.4 AS over FROM e)
SELECT event_id, user_id, n, bad, bool_or(over) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS disabled FROM f""")
def error_rate_sliding(t: Tables) -> DataFrame:
    out = limits.error_latch(t.events, "user_id", "ts", F.col("event_type") == "error", seconds=300, least=2, most=0.4)
    return out.select("event_id", "user_id", "n", "bad", "disabled")


@query()
def rate_limit_fold(t: Tables) -> DataFrame:
    return limits.rate_limit(t.events, "user_id", "ts", "event_id", ((600, 1), (86_400, 20)))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
m AS (SELECT user_id, k, ts, value FROM e WHERE k = 1 UNION ALL
      SELECT e.user_id, e.k, e.ts, e.value FROM (SELECT m.user_id, min(e.k) AS k FROM m JOIN e ON e.user_id = m.user_id AND e.k > m.k AND e.ts >= m.ts + INTERVAL 6 HOUR GROUP BY m.user_id) n JOIN e USING (user_id, k))
SELECT event_id, CASE WHEN e.k = s.k THEN 'miss' ELSE 'hit' END AS outcome, s.value AS value FROM e ASOF JOIN m s ON e.user_id = s.user_id AND e.k >= s.k""")
def ttl_cache(t: Tables) -> DataFrame:
    """An answer for each user that is good for six hours from the event that stored it."""
    return cache.ttl_cache(t.events, "user_id", "ts", "event_id", "value", 6 * 3600).select(F.col("tie").alias("event_id"), "outcome", "value")


@query("""WITH j AS (SELECT user_id, event_type AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, status FROM j WHERE k = 1""")
def job_status(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))
