"""Changing rows of month-partitioned logs: only the months that change are written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ingest import fingerprint
from ..scratch import discard, settle
from .files import TIMES, read_monthly


class LostUpdate(RuntimeError):
    """Another writer changed a month between its reading and its writing, or it is not what was written."""


def _state(rows: DataFrame) -> dict[str, tuple[str, int]]:
    """Fingerprint and rows of each month; there are no more rows than months."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(rows.columns) if c != "month"]
    return {r["month"]: (r["fingerprint"], r["n"]) for r in fingerprint(rows, parts, ["month"], F.count("*").alias("n")).collect()}


def update_months(spark: SparkSession, path: str, schema: str, changes: DataFrame, key: str, columns: list[str], before_write: Callable[[], None] | None = None) -> list[str]:
    """Give log rows the values of ``changes`` (``month``, the key, the columns) and return the months that were written.

    A month's rows are joined with its changes and written apart; if the month is
    still as it was read, its partition is overwritten, then read and compared with
    what was written.  Months whose rows stay the same keep their files, so the same
    changes made twice write once.  Of several changes of a key the one with the
    largest values counts; changes without a row, and rows of a null key, change nothing.
    """
    asked = [r["month"] for r in changes.select("month").distinct().collect()]
    of = lambda months: read_monthly(spark, path, schema).where(F.col("month").isin(months))
    seen = _state(of(asked))
    one = changes.groupBy("month", key).agg(F.max(F.struct(*columns)).alias("_new"))
    new = of(asked).join(one, ["month", key], "left")
    there = F.col("_new").isNotNull()
    made = settle(new.select(*[F.when(there, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in of(asked).columns]), "months")
    wanted = _state(made)
    changed = sorted(m for m in wanted if wanted[m] != seen[m])
    if changed:
        if before_write:
            before_write()
        if _state(of(changed)) != {m: seen[m] for m in changed}:
            raise LostUpdate(f"{path}: a month of {changed} was changed by another writer")
        rows = made.where(F.col("month").isin(changed)).hint("rebalance", "month")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("timestampFormat", TIMES).partitionBy("month").json(path)
        if _state(of(changed)) != {m: wanted[m] for m in changed}:
            raise LostUpdate(f"{path}: a month of {changed} is not what was written")
    discard(made)
    return changed
