"""A store of transcripts that are edited, restored and renamed.

Entries are dealt into buckets by their hash; a change rewrites the buckets of
its entries and no others.  The first rows that are saved of an entry are also
kept as its raw copy, to which a deletion goes back.  A rename is guarded: its
new name must not exist and be wanted once, and the old rows go only after the
new ones have been read back and compared.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ingest import fingerprint
from ..scratch import discard, settle


class NotWritten(RuntimeError):
    """What was read back is not what was to be written."""


@dataclass(frozen=True)
class TranscriptStore:
    """Rows of ``schema`` under ``path``; ``key`` names the entry, a whole number or text, which is never null."""

    spark: SparkSession
    path: str
    schema: str
    key: str = "entry"
    buckets: int = 32

    def _table(self, name: str) -> DataFrame:
        schema = f"{self.schema}, _gone boolean, _bucket int"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def load(self) -> DataFrame:
        return self._table("current").where("not _gone").drop("_gone", "_bucket")

    def raw(self) -> DataFrame:
        return self._table("raw").drop("_gone", "_bucket")

    def _dealt(self, rows: DataFrame, gone: bool = False) -> DataFrame:
        return rows.withColumn("_gone", F.lit(gone)).withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _put(self, rows: DataFrame, entries: DataFrame) -> None:
        """Put ``rows`` in the place of all that the entries have; an entry without rows keeps a mark that it is gone."""
        rows = settle(rows)
        missing = entries.join(rows.select(self.key), self.key, "left_anti")
        # no more numbers than there are buckets
        touched = [r[0] for r in self._dealt(entries).select("_bucket").distinct().collect()]
        old = self._table("current").where(F.col("_bucket").isin(touched)).join(entries, self.key, "left_anti")
        new = settle(old.unionByName(self._dealt(rows)).unionByName(self._dealt(missing, True), allowMissingColumns=True))
        new.hint("rebalance", "_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{self.path}/current")
        if self._state(self.load().join(entries, self.key, "left_semi")) != self._state(rows):
            raise NotWritten(self.path)
        discard(rows, new)

    def _state(self, rows: DataFrame) -> list:
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(rows.columns)]
        return fingerprint(rows, parts).collect()

    def save(self, rows: DataFrame) -> None:
        """New entries, or all rows of entries that are there."""
        entries = settle(rows.select(self.key).distinct())
        first = rows.join(self._table("raw").select(self.key), self.key, "left_anti")
        self._dealt(first).hint("rebalance", "_bucket").write.mode("append").partitionBy("_bucket").parquet(f"{self.path}/raw")
        self._put(rows, entries)
        discard(entries)

    def restore(self, entries: DataFrame) -> None:
        """Back to the raw copies; an entry that has none is gone."""
        wanted = settle(entries.select(self.key).distinct())
        self._put(self.raw().join(wanted, self.key, "left_semi"), wanted)
        discard(wanted)

    def rename(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` of ``old`` and ``new`` with their ``outcome``: renamed, missing (old), exists (new) or conflict (new wanted, or old renamed, more than once)."""
        there = settle(self.load().select(F.col(self.key).alias("_e")).distinct())
        asked = pairs.select("old", "new").distinct()
        more = lambda c: asked.groupBy(c).agg(F.count("*").alias(f"_n_{c}"))
        known = asked.join(there.select(F.col("_e").alias("old"), F.lit(True).alias("_old")), "old", "left").join(there.select(F.col("_e").alias("new"), F.lit(True).alias("_new")), "new", "left").join(more("old"), "old").join(more("new"), "new")
        outcome = F.when(F.col("_old").isNull(), "missing").when(F.col("_new").isNotNull(), "exists").when((F.col("_n_old") > 1) | (F.col("_n_new") > 1), "conflict").otherwise("renamed")
        told = settle(known.select("old", "new", outcome.alias("outcome")))
        done = told.where("outcome = 'renamed'")
        moved = self.load().join(done.select(F.col("old").alias(self.key), "new"), self.key).drop(self.key).withColumnRenamed("new", self.key)
        self._put(moved.select(self.load().columns), done.select(F.col("new").alias(self.key)))
        # the new rows have been read back
        self._put(self.load().limit(0), done.select(F.col("old").alias(self.key)))
        return told
