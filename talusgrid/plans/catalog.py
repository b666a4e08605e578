"""Filters, pages, aggregates and lookups over orders, parts and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import ids
from ..operators import catalog
from .base import Suite, Tables

suite = Suite()
query = suite.query

COLUMNS = {"decade": ["year"], "years": ["year"], "group": ["o_orderstatus"], "text": ["o_orderpriority", "o_orderstatus"], "member": ["parts"]}


def _orders(t: Tables) -> DataFrame:
    return t.orders.withColumn("year", F.year("o_orderdate"))


@query("""SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1997) AS total,
(SELECT count(*) FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1997) > 70 AS has_more
FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1997 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 20""")
def filter_page(t: Tables) -> DataFrame:
    where, _ = catalog.Filters(years=(1995, 1997)).condition(COLUMNS)
    return catalog.page(_orders(t).where(where).select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 0, 20)


@query("""SELECT o_orderkey, year(o_orderdate)::INT AS year, 'decade,group,text' AS matched FROM orders
WHERE year(o_orderdate) BETWEEN 1990 AND 1999 AND o_orderstatus = 'F' AND (contains(lower(o_orderpriority), 'high') OR contains(lower(o_orderstatus), 'high'))""")
def filter_conjunction(t: Tables) -> DataFrame:
    where, applied = catalog.Filters(decade=1990, group="F", text="High").condition(COLUMNS)
    return _orders(t).where(where).select("o_orderkey", "year", F.lit(",".join(applied)).alias("matched"))


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'small')")
def film_or_moments(t: Tables) -> DataFrame:
    where, _ = catalog.Filters(text="small").condition({"text": ["p_type"]})
    return t.part.where(where | catalog.contains_ci(F.col("p_name"), "ring")).select("p_partkey")


def _crew(t: Tables) -> DataFrame:
    """Suppliers and parts of each order, in the order of its lines."""
    line = t.lineitem.join(t.supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey")).join(t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    entries = F.array_sort(F.collect_list(F.struct("l_linenumber", "s_name", "p_name")))
    rows = line.groupBy("l_orderkey").agg(entries.alias("e"))
    return rows.select("l_orderkey", F.transform("e", lambda x: x["s_name"]).alias("suppliers"), F.transform("e", lambda x: x["p_name"]).alias("parts"))


_CREW_SQL = """c AS (SELECT l_orderkey, list(s_name ORDER BY l_linenumber, s_name, p_name) AS suppliers, list(p_name ORDER BY l_linenumber, s_name, p_name) AS parts
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)"""


@query(f"WITH {_CREW_SQL} SELECT l_orderkey, len(parts)::INT AS n_parts FROM c WHERE len(list_filter(parts, lambda x: contains(lower(x), 'widget'))) > 0")
def array_contains_filter(t: Tables) -> DataFrame:
    where, _ = catalog.Filters(member="Widget").condition(COLUMNS)
    return _crew(t).where(where).select("l_orderkey", F.size("parts").alias("n_parts"))


@query(f"""WITH {_CREW_SQL}, m AS (SELECT *, list_filter(suppliers, lambda x: contains(lower(x), '00007')) AS a, list_filter(parts, lambda x: contains(lower(x), '00007')) AS b FROM c)
SELECT l_orderkey, concat_ws(',', CASE WHEN len(a) > 0 THEN 'supplier' END, CASE WHEN len(b) > 0 THEN 'part' END) AS roles, coalesce(a[1], b[1]) AS matched FROM m WHERE len(a) > 0 OR len(b) > 0""")
def crew_lookup(t: Tables) -> DataFrame:
    found = catalog.crew_lookup(_crew(t), {"supplier": "suppliers", "part": "parts"}, "00007")
    return found.select("l_orderkey", F.concat_ws(",", "roles").alias("roles"), "matched")


@query(r"""WITH h AS (SELECT doc_id, regexp_matches(lower(text), '\bthe\b')::INT + regexp_matches(lower(text), '\bnation\b')::INT + regexp_matches(lower(text), '\btion\b')::INT + regexp_matches(lower(text), '\bher\b')::INT AS hits FROM documents)
SELECT doc_id, hits FROM h WHERE hits >= 2 ORDER BY hits DESC, doc_id LIMIT 3""")
def whole_word_rank(t: Tables) -> DataFrame:
    return catalog.whole_word_rank(t.documents, "text", "doc_id", ["the", "nation", "tion", "her"]).select("doc_id", "hits")


@query("""SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_customers, count(*) FILTER (o_orderpriority NOT IN ('5-LOW')) AS n_named,
round(coalesce(avg(o_totalprice), 0), 6) AS mean_price, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day FROM orders""")
def catalog_stats(t: Tables) -> DataFrame:
    return t.orders.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("o_custkey").alias("n_customers"),
        F.count_if(F.col("o_orderpriority") != "5-LOW").alias("n_named"),
        F.round(F.coalesce(F.avg(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), F.lit(0.0)), 6).alias("mean_price"),
        F.min("o_orderdate").cast("date").alias("first_day"),
        F.max("o_orderdate").cast("date").alias("last_day"),
    )


@query("SELECT (year(o_orderdate) // 10 * 10)::VARCHAR || 's' AS decade, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def decade_histogram(t: Tables) -> DataFrame:
    return t.orders.groupBy(ids.decade(F.year("o_orderdate")).alias("decade"), "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1")
def latest_row(t: Tables) -> DataFrame:
    return catalog.first_by(t.orders, F.desc("o_orderdate"), F.asc("o_orderkey")).select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


@query("SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 1")
def argmax_first(t: Tables) -> DataFrame:
    return catalog.first_by(t.part, F.desc("p_size"), F.asc("p_partkey")).select("p_partkey", "p_size")


@query("""WITH o AS (SELECT year(o_orderdate)::INT AS year, o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) <> 1996),
r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY o_totalprice DESC, o_orderkey) AS k FROM o),
s AS (SELECT unnest(generate_series(min(year), max(year)))::INT AS year FROM o)
SELECT s.year, o_orderkey, o_totalprice FROM s LEFT JOIN r ON s.year = r.year AND k = 1""")
def one_per_year_spine(t: Tables) -> DataFrame:
    rows = t.orders.where(F.year("o_orderdate") != 1996)
    return catalog.one_per_year(rows, F.year("o_orderdate"), F.desc("o_totalprice"), F.asc("o_orderkey")).select("year", "o_orderkey", "o_totalprice")


@query("""SELECT field, value, count(*) AS n FROM (SELECT 'o_orderstatus' AS field, o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders)
WHERE value IS NOT NULL AND lower(value) NOT IN ('4-not specified') GROUP BY ALL""")
def unpivot_counts(t: Tables) -> DataFrame:
    return catalog.unpivot_counts(t.orders, ["o_orderstatus", "o_orderpriority"], ("4-not specified",))


@query("SELECT CASE WHEN r_regionkey = 0 THEN (SELECT max(r_regionkey) FROM region) ELSE r_regionkey END AS season, r_name FROM region")
def season_normalisation(t: Tables) -> DataFrame:
    return catalog.normal_groups(t.region, "r_regionkey").select(F.col("r_regionkey").alias("season"), "r_name")


@query("""WITH u AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE 'MOVED' END AS c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT -c_custkey - 1, 'NEW', 0e0 FROM customer WHERE c_custkey % 50 = 0)
SELECT coalesce(o.c_custkey, u.c_custkey) AS c_custkey, coalesce(nullif(u.c_mktsegment, ''), o.c_mktsegment) AS c_mktsegment, coalesce(u.c_acctbal, o.c_acctbal) AS c_acctbal,
CASE WHEN o.c_custkey IS NULL THEN 'added' WHEN u.c_custkey IS NULL THEN 'kept' WHEN coalesce(nullif(u.c_mktsegment, ''), o.c_mktsegment) <> o.c_mktsegment THEN 'updated' ELSE 'no_change' END AS change
FROM customer o FULL JOIN u ON o.c_custkey = u.c_custkey""")
def upsert_merge(t: Tables) -> DataFrame:
    rest = F.col("c_custkey") % 3
    segment = F.when(rest == 0, "").when(rest == 1, F.col("c_mktsegment")).otherwise("MOVED")
    changed = t.customer.where("c_custkey % 2 = 0").select("c_custkey", segment.alias("c_mktsegment"), "c_acctbal")
    new = t.customer.where("c_custkey % 50 = 0").select((-F.col("c_custkey") - 1).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"), F.lit(0.0).alias("c_acctbal"))
    return catalog.upsert(t.customer, changed.unionByName(new), "c_custkey", ["c_mktsegment", "c_acctbal"])


@query("""SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def stable_sort_page(t: Tables) -> DataFrame:
    top = t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)
    place = F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long")
    return top.select("o_orderkey", "o_orderstatus", place.alias("place"))


@query("""SELECT p_partkey, map_entries(map_from_entries(list_filter([('brand', p_brand), ('size', CASE WHEN p_size > 25 THEN p_size::VARCHAR ELSE '' END), ('type', nullif(p_type, 'SMALL'))], lambda x: x[2] IS NOT NULL AND x[2] <> '')))::VARCHAR IS NOT NULL AS ok,
1 + (p_size > 25)::INT + (p_type <> 'SMALL')::INT AS n_fields FROM part""")
def relevant_fields(t: Tables) -> DataFrame:
    size = F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise("")
    fields = ids.filled_fields({"brand": F.col("p_brand"), "size": size, "type": F.when(F.col("p_type") != "SMALL", F.col("p_type"))})
    return t.part.select("p_partkey", fields.isNotNull().alias("ok"), F.size(fields).alias("n_fields"))
