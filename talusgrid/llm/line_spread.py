"""Line de-duplication by distinct-site spread.

A line's key is a 128-bit hash of the line without white space at its ends.
Lines on one site alone go no further.  For the others a HyperLogLog sketch of
the sites is aggregated per key; sketches merge in the partial aggregation, so
a line that a third of all rows share costs one sketch a task.  Keys whose
estimate is near the threshold get an exact distinct count.  Lines on
``min_sites`` sites or more are boilerplate: all occurrences go but the first,
which is that in the row with the smallest id (null before all), so no text is
lost altogether.
All of it is DataFrame aggregations and joins on the keys.

Defined results: null texts stay null and have no lines.  Blank lines are never
counted or removed.  A null site is a site of its own.  Rows equal in id and
text are treated alike: each keeps the first.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, clear_scratch, discard, materialize, scratch_mark

#: Copies of a whole text lie on fewer sites than this, lines of a template on more.
MIN_SITES = 8
#: Relative standard error of a sketch with 2^12 registers is 1.6 %; this is ten times as much.
NEAR = 0.16
LG_REGISTERS = 12


def _row_key(id_col: str, text_col: str) -> list[Column]:
    return [F.xxhash64(id_col, text_col).alias("_k1"), F.xxhash64(text_col, id_col, F.lit(1)).alias("_k2")]


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    site = F.xxhash64(F.coalesce(F.col(site_col).cast("string"), F.lit("")), F.col(site_col).isNull())
    rows = docs.select(*_row_key(id_col, text_col), F.col(id_col).alias("_id"), site.alias("_site"), F.posexplode(F.split(text_col, "\n")).alias("_at", "_line"))
    rows = rows.withColumn("_line", F.btrim("_line", F.lit(SPACES))).where("_line <> ''")
    return rows.select("_k1", "_k2", "_id", "_site", "_at", F.xxhash64("_line").alias("_h1"), F.xxhash64(F.lit(7), "_line").alias("_h2"))


def boilerplate(shared: DataFrame, min_sites: int) -> DataFrame:
    """Keys of lines on at least ``min_sites`` sites, from the lines on more than one, with their first occurrence.

    The first occurrence is a minimum that is combined beside the sketch, so the
    rows of a line never have to meet.
    """
    first = F.min(F.struct("_id", "_at", "_k1", "_k2")).alias("_first")
    sketches = shared.groupBy("_h1", "_h2").agg(F.hll_sketch_agg("_site", LG_REGISTERS).alias("sketch"), first)
    sketches = materialize(sketches.select("_h1", "_h2", F.hll_sketch_estimate("sketch").alias("sites"), "_first"), "line-sites")
    sure = sketches.where(F.col("sites") > min_sites * (1 + NEAR)).select("_h1", "_h2", "_first")
    near = sketches.where(F.col("sites").between(min_sites * (1 - NEAR) - 1, min_sites * (1 + NEAR)))
    exact = shared.join(near.select("_h1", "_h2"), ["_h1", "_h2"], "left_semi").groupBy("_h1", "_h2").agg(F.countDistinct("_site").alias("n"), first)
    return sure.unionByName(exact.where(F.col("n") >= min_sites).select("_h1", "_h2", "_first"))


def removals(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """For rows that lose lines: their key and ``_drop``, the places of the lines to remove."""
    lines = _lines(docs, id_col, text_col, site_col)
    spread = lines.groupBy("_h1", "_h2").agg(F.min("_site").alias("lo"), F.max("_site").alias("hi")).where("lo <> hi").select("_h1", "_h2")
    # written first: a join of two tables, unlike one with an aggregate, is split where one line has very many rows
    spread = materialize(spread, "spread-lines")
    shared = materialize(lines.join(spread, ["_h1", "_h2"], "left_semi"), "shared-lines")
    discard(spread)
    mark = scratch_mark()
    wide = materialize(boilerplate(shared, min_sites), "boilerplate")
    clear_scratch(mark, keep=(wide,))
    gone = shared.join(wide, ["_h1", "_h2"]).where(~F.struct("_id", "_at", "_k1", "_k2").eqNullSafe(F.col("_first")))
    return gone.groupBy("_k1", "_k2").agg(F.collect_set("_at").alias("_drop"))


def clean(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """The columns of ``docs`` with cleaned texts, then ``_n_lines`` (with a word) and ``_n_removed``."""
    drop = removals(docs, min_sites, id_col, text_col, site_col)
    keyed = docs.select(F.struct("*").alias("_row"), *_row_key(id_col, text_col)).join(drop, ["_k1", "_k2"], "left")
    source = F.col("_row")[text_col]
    lines = F.split(source, "\n")
    full = F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    left = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_drop")))
    both = F.array(F.struct(lines.alias("lines"), left.alias("left")))
    rest = F.element_at(F.transform(both, lambda x: F.array_join(F.transform(x["left"], lambda i: F.get(x["lines"], i)), "\n")), 1)
    text = F.when(F.col("_drop").isNull(), source).otherwise(rest)
    return keyed.select(
        *[(text if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns],
        F.coalesce(F.when(source.isNotNull(), full), F.lit(0)).cast("long").alias("_n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("_n_removed"),
    )


def oracle_sql(min_sites: int = MIN_SITES, table: str = "documents") -> str:
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, text, source FROM {table}),
l AS (SELECT rid, doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM t),
k AS (SELECT *, trim(raw, {spaces}) AS line FROM l),
b AS (SELECT line, count(DISTINCT coalesce(source, '')) AS sites, min(struct_pack(doc_id := doc_id, pos := pos)) AS head
      FROM k WHERE line <> '' GROUP BY line HAVING sites >= {min_sites}),
m AS (SELECT k.*, b.line IS NOT NULL AND struct_pack(doc_id := doc_id, pos := pos) <> b.head AS gone FROM k LEFT JOIN b ON k.line = b.line AND k.line <> ''),
g AS (SELECT rid, string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS cleaned,
             count(*) FILTER (WHERE line <> '')::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_removed FROM m GROUP BY rid)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       md5(CASE WHEN text IS NOT NULL THEN coalesce(cleaned, '') END) AS clean_md5
FROM t LEFT JOIN g USING (rid)"""
