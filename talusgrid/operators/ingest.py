"""Incremental ingestion: precedence unions, fingerprints, partition replacement and memoised work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def union_preferring(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All of ``first`` and the rows of ``second`` whose key it lacks."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"), allowMissingColumns=True)


def fingerprint(rows: DataFrame, parts: list[Column], by: list[str] | None = None, *more: Column) -> DataFrame:
    """One digest a group that does not depend on the order of rows, and ``more`` aggregates beside it.

    Row digests are added up in four 60-bit columns and hashed once, so nothing is
    collected however large the table is.
    """
    digest = F.sha2(F.concat_ws("\x1f", *parts), 256)
    sums = [F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    text = F.concat_ws("-", F.count("*").cast("string"), *[s.cast("string") for s in sums])
    return rows.groupBy(*(by or [])).agg(F.sha2(text, 256).alias("fingerprint"), *more)


def replace_group(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """``old`` without the groups that ``new`` has, and ``new``."""
    return old.join(new.select(column).distinct(), column, "left_anti").select(old.columns).unionByName(new)


def memo_todo(rows: DataFrame, cache: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their cached ``output``, rows still to do), matched by the text's digest."""
    keyed = rows.withColumn("digest", F.sha2(text, 256))
    return keyed.join(cache.select("digest", "output"), "digest"), keyed.join(cache, "digest", "left_anti")


def new_entries(seen: DataFrame, found: DataFrame, key: str, order: Column, recent: Column) -> DataFrame:
    """Rows not seen yet that come after everything seen or are recent."""
    top = seen.agg(F.max(order).alias("_top"))
    fresh = found.join(seen.select(key), key, "left_anti").crossJoin(F.broadcast(top))  # one row
    return fresh.where((order > F.coalesce("_top", F.lit(float("-inf")))) | recent).drop("_top")


def failure_gate(rows: DataFrame, failed: Column, by: list[str], most: float = 0.05) -> DataFrame:
    """The rows of those groups of which at most a share of ``most`` failed; all others emit nothing."""
    share = rows.groupBy(*by).agg(F.avg(failed.cast("int")).alias("_share"))
    return rows.join(share.where(F.col("_share") <= most).select(*by), by, "left_semi")


def manifest_changes(known: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``state`` of each source by its fingerprint: new, gone, same (to be skipped) or changed."""
    both = found.withColumnRenamed("fingerprint", "_now").join(known.withColumnRenamed("fingerprint", "_then"), key, "full_outer")
    now, then = F.col("_now"), F.col("_then")
    return both.select(key, F.when(then.isNull(), "new").when(now.isNull(), "gone").when(now == then, "same").otherwise("changed").alias("state"))
