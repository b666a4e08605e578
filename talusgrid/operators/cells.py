"""Nearest vectors through cells, exact by bounds.

Centres are fitted by spherical k-means on a sample of bounded size; every vector
then lies in the cell of its nearest centre, and a cell has the largest angle
between its centre and any of its vectors.  No vector of a cell is nearer to a
query than the angle to the centre less that angle.  A search looks into the
nearest cells first; the k-th score found there leaves only those other cells
whose bound reaches it, and they are looked into as well.  The result is that of
a full search; how many cells it took is told.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..scratch import settle
from .lexical import top_per

#: Scores are rounded to six places; a bound must be lower by more than that, and by what angles lose in doubles.
SLACK = 2e-6


@dataclass(frozen=True)
class Cells:
    """``vectors`` (cell, id, v: unit vectors) partitioned by cell under ``path``; ``centres`` and the cells' ``reach`` as angles."""

    vectors: DataFrame
    centres: np.ndarray
    reach: np.ndarray


def fit_centres(vectors: DataFrame, n_cells: int, vector_col: str, id_col: str, sample: int = 20_000, rounds: int = 12) -> np.ndarray:
    """Unit centres from at most ``sample`` vectors, those with the smallest hashes of their ids."""
    rows = vectors.select(F.xxhash64(id_col).alias("h"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null").orderBy("h").limit(sample)

    def fit(batches):
        parts = [b.column(0).flatten().to_numpy().reshape(b.num_rows, -1) for b in batches if b.num_rows]
        centres = _centres(np.concatenate(parts), n_cells, rounds) if parts else []
        yield pa.RecordBatch.from_arrays([pa.array(range(len(centres)), pa.int32()), pa.array(list(centres), pa.list_(pa.float64()))], ["cell", "v"])

    # the sample goes to one task, and only the centres to the driver
    found = rows.select("v").coalesce(1).mapInArrow(fit, "cell int, v array<double>").collect()
    return np.array([r.v for r in sorted(found)], np.float64) if found else np.zeros((0, 1))


def _centres(v: np.ndarray, n_cells: int, rounds: int) -> np.ndarray:
    v = v[np.linalg.norm(v, axis=1) > 0]
    v = v / np.linalg.norm(v, axis=1)[:, None]
    centres = v[:: max(1, len(v) // n_cells)][:n_cells].copy()
    for _ in range(rounds):
        home = np.argmax(v @ centres.T, axis=1) if len(centres) else np.zeros(0, int)
        for c in range(len(centres)):
            total = v[home == c].sum(axis=0) if (home == c).any() else centres[c]
            if (size := np.linalg.norm(total)) > 0:
                centres[c] = total / size
    return centres


def build(vectors: DataFrame, path: str, n_cells: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 20_000) -> Cells:
    """All vectors by cell, written under ``path``; null and zero vectors are in none.  All vectors have one length."""
    spark = vectors.sparkSession
    centres = fit_centres(vectors, n_cells, vector_col, id_col, sample)
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)
            size = np.linalg.norm(v, axis=1)
            keep = np.flatnonzero(size > 0)
            v = v[keep] / size[keep, None]
            near = v @ shared.value.T
            home = np.argmax(near, axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(v)), home], -1, 1))
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(angle)], ["cell", "id", "v", "angle"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") == centres.shape[1]))
    placed = rows.mapInArrow(assign, "cell int, id long, v array<double>, angle double")
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
    written = spark.read.schema("id long, v array<double>, angle double, cell int").parquet(path)
    reach = np.full(len(centres), -1.0)
    for r in written.groupBy("cell").agg(F.max("angle").alias("a")).collect():  # a row a cell
        reach[r.cell] = r.a
    return Cells(written.select("cell", "id", "v"), centres, reach)


def search(index: Cells, queries: DataFrame, k: int, probes: int = 4, exact: bool = True, query_block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(query_id, id, score, rank) and (query_id, ``probed``, ``cells``); without ``exact`` only the ``probes`` nearest cells are looked into.

    Queries go ``query_block`` at a time; only the cells that a block needs are read.
    """
    spark = queries.sparkSession
    wanted = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("v")).where("v is not null")
    blocks = max(1, -(-wanted.count() // query_block))
    out, told = None, []
    for block in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()
        rows = [r for r in rows if any(r.v)]
        if not rows:
            continue
        q = np.array([r.v for r in rows], np.float64)
        q /= np.linalg.norm(q, axis=1)[:, None]
        names = np.array([r.query_id for r in rows])
        there = index.reach >= 0
        least = np.arccos(np.clip(q @ index.centres.T, -1, 1)) - index.reach
        bound = np.where(there, np.cos(np.clip(least, 0, np.pi)), -np.inf)
        order = np.argsort(-bound, axis=1, kind="stable")[:, :probes]
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, order, True, axis=1)
        first &= there
        found = _look(index, q, names, first, k)
        if exact:
            found = settle(top_per(found, k).drop("rank"), "nearest")
            floor = {r.query_id: r.s for r in found.groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("n")).where(F.col("n") >= k).collect()}
            more = ~first & there & (bound >= np.array([floor.get(n, -2.0) for n in names.tolist()])[:, None] - SLACK)
            found = found.unionByName(_look(index, q, names, more, k))
            first |= more
        out = found if out is None else out.unionByName(found)
        told += [(int(n), int(p), int(there.sum())) for n, p in zip(names, first.sum(axis=1))]
    if out is None:
        out = spark.createDataFrame([], "query_id long, id long, score double")
    return top_per(out, k), spark.createDataFrame(told, "query_id long, probed int, cells int")


def _look(index: Cells, q: np.ndarray, names: np.ndarray, ask: np.ndarray, k: int) -> DataFrame:
    """The best ``k`` rows of each batch for the queries that ask for its cells."""
    shared = index.vectors.sparkSession.sparkContext.broadcast((q, names, ask))

    def run(batches):
        q, names, ask = shared.value
        for batch in batches:
            cells = np.asarray(batch.column(0))
            ids = np.asarray(batch.column(1))
            v = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            size = np.linalg.norm(v, axis=1)
            for c in np.unique(cells):
                mine, here = np.flatnonzero(ask[:, c]), np.flatnonzero(cells == c)
                if not len(mine):
                    continue
                score = np.round(q[mine] @ v[here].T / size[here], 6) + 0.0
                if len(here) > k:
                    least = np.partition(score, len(here) - k, axis=1)[:, len(here) - k]
                    row, at = np.nonzero(score >= least[:, None])
                else:
                    row, at = np.nonzero(np.ones(score.shape, bool))
                yield pa.RecordBatch.from_arrays([pa.array(names[mine][row]), pa.array(ids[here][at]), pa.array(score[row, at])], ["query_id", "id", "score"])

    wanted = np.flatnonzero(ask.any(axis=0)).tolist()
    return index.vectors.where(F.col("cell").isin(wanted)).mapInArrow(run, "query_id long, id long, score double")
