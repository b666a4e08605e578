"""A chunk store that follows a stream of deliveries.

A delivery holds whole sources: its rows replace all that the store has of them.
Every micro-batch goes through the same steps, each of which can be repeated:

1. of each source the newest delivery counts, and one that is older than what the
   store has is passed over;
2. a fingerprint of the source's rows is compared with the manifest of earlier
   batches; a source that has not changed is skipped, whatever it would cost;
3. outputs are looked up by the digest of a chunk's text; only chunks never seen
   are worked out, and remembered under the batch's number;
4. the partitions of changed sources are overwritten, and only those;
5. the manifest gets the batch's sources, under the batch's number.

The steps look at nothing that the batch itself has written before (manifest and
memory of *earlier* batches), so a batch that is replayed, or killed between any
two of the writes and run again, leaves what one whole run leaves.  ``run``
numbers the streams that fill a store one after the other: a stream that begins
with a new checkpoint, and so with batch 0 again, takes the next number.

Sizes: fingerprints combine before they are shuffled; a text is shuffled once if it is
new, once to meet its output and once to its partition, through a rebalancing shuffle
that splits large ones; nothing is collected.
Defined results: a null source is a source of its own; rows of a source that are
repeated in a delivery stay repeated; an empty batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import fingerprint, new_entries
from ..scratch import discard, settle

#: A batch's number in the order of all batches: its stream's number, then its own.
ORDER = "run int, batch long"


@dataclass(frozen=True)
class ChunkStore:
    """Chunks under ``path``; deliveries have the columns of ``schema``, among them ``source`` and ``delivered``.

    ``chunked`` makes chunk rows (with ``text``) of delivered rows, ``output`` is
    worked out once for each distinct chunk text.  ``newest_only`` is the gate of
    sources by a number in ``source_order``: those after all that is known, or recent ones.
    """

    spark: SparkSession
    path: str
    schema: str
    chunked: Callable[[DataFrame], DataFrame]
    output: Column
    source: str = "source"
    delivered: str = "delivered"
    source_order: Column | None = None
    recent: Column | None = None

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _key(self) -> str:
        kinds = {c.name: c.dataType.simpleString() for c in self.spark.createDataFrame([], self.schema).schema}
        return f"`{self.source}` {kinds[self.source]}"

    def _manifest(self) -> DataFrame:
        return self._table("manifest", f"{self._key()}, delivered long, fingerprint string, n long, {ORDER}")

    def _memo(self) -> DataFrame:
        return self._table("memo", f"digest string, output {self._output_type()}, {ORDER}")

    def _output_type(self) -> str:
        return self.spark.createDataFrame([], "text string").select(self.output.alias("o")).schema["o"].dataType.simpleString()

    def manifest(self) -> DataFrame:
        """Of each source what the last batch that wrote it recorded."""
        last = F.max_by(F.struct("delivered", "fingerprint", "n"), F.struct("run", "batch")).alias("_m")
        return self._manifest().groupBy(self.source).agg(last).select(self.source, "_m.*")

    def chunks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/chunks")

    @staticmethod
    def _before(table: DataFrame, run: int, batch: int) -> DataFrame:
        return table.where((F.col("run") < run) | ((F.col("run") == run) & (F.col("batch") < batch)))

    def changed(self, delivery: DataFrame, run: int, batch: int) -> DataFrame:
        """(source, delivered, fingerprint, n) of what the batch has to write."""
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in delivery.columns if c not in (self.source, self.delivered)]
        # of all deliveries, so that no text is joined to find a source's newest
        found = fingerprint(delivery.where(F.col(self.delivered).isNotNull()), parts, [self.source, self.delivered], F.count("*").alias("n"))
        newest = Window.partitionBy(self.source).orderBy(F.desc(self.delivered))
        found = found.withColumn("_place", F.row_number().over(newest)).where("_place = 1").drop("_place").withColumnRenamed(self.delivered, "delivered")
        known = self._before(self._manifest(), run, batch).groupBy(F.col(self.source).alias("_k")).agg(F.max_by(F.struct("delivered", "fingerprint"), F.struct("run", "batch")).alias("_m"))
        if self.source_order is not None:
            entered = new_entries(known.select(F.col("_k").alias(self.source)), found, self.source, self.source_order, F.lit(False) if self.recent is None else self.recent)
            again = found.join(known, found[self.source].eqNullSafe(known["_k"]), "left_semi")
            found = entered.unionByName(again)
        both = found.join(known, found[self.source].eqNullSafe(known["_k"]), "left")
        fresh = F.col("_m").isNull() | ((F.col("_m.fingerprint") != F.col("fingerprint")) & (F.col("_m.delivered") <= F.col("delivered")))
        return both.where(fresh).select(self.source, "delivered", "fingerprint", "n")

    def write_batch(self, delivery: DataFrame, batch: int, run: int = 0, stop_after: str | None = None) -> None:
        """One micro-batch; ``stop_after`` ("memo" or "chunks") ends it early, as a lost driver would."""
        numbered = lambda df: df.withColumn("run", F.lit(run)).withColumn("batch", F.lit(batch).cast("long"))
        # with its size known, so that it can be sent to the texts
        todo = settle(self.changed(delivery, run, batch), "changed")
        wanted = todo.select(F.col(self.source).alias("_k"), F.col("delivered").alias("_d"))
        rows = delivery.join(wanted, F.col(self.source).eqNullSafe(F.col("_k")) & (F.col(self.delivered) == F.col("_d")), "left_semi")
        chunks = self.chunked(rows)
        keyed = chunks.withColumn("digest", F.coalesce(F.sha2("text", 256), F.lit("")))  # a null text is one like any other
        known = self._before(self._memo(), run, batch).select("digest", "output")
        new = keyed.select("digest", "text").join(known.select("digest"), "digest", "left_anti")
        made = new.dropDuplicates(["digest"]).select("digest", self.output.alias("output"))
        self._replace(numbered(made), "memo", ["run", "batch"])
        if stop_after == "memo":
            return
        own = self._memo().where((F.col("run") == run) & (F.col("batch") == batch)).select("digest", "output")
        # one row a digest; held by digest in each task, so that texts are not sorted for it
        outputs = known.unionByName(own).dropDuplicates(["digest"])
        filled = keyed.join(outputs.hint("shuffle_hash"), "digest")
        self._replace(filled.hint("rebalance", self.source), "chunks", [self.source])
        if stop_after == "chunks":
            return
        self._replace(numbered(todo), "manifest", ["run", "batch"])
        discard(todo)

    def _replace(self, rows: DataFrame, name: str, by: list[str]) -> None:
        """Overwrite the partitions that the rows have; all others keep their files."""
        rows.write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/{name}")

    def follow(self, folder: str, checkpoint: str, run: int = 0, files_a_batch: int = 1000) -> StreamingQuery:
        """Start a stream over delivery files in a folder that takes what is there and ends."""
        files = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
        return files.writeStream.foreachBatch(lambda df, n: self.write_batch(df, n, run)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def compact_memo(self, run: int) -> None:
        """One file set for the memory of all runs before ``run``, which must be over."""
        old = self._memo().where(F.col("run") < run).dropDuplicates(["digest"]).withColumn("run", F.lit(run - 1)).withColumn("batch", F.lit(-1).cast("long")).checkpoint()
        self._replace(old, "memo", ["run", "batch"])
