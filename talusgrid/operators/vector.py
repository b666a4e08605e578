"""Exact nearest neighbours by cosine, and work on score lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window, functions as F

from .lexical import top_per


#: So many scores are held at a time, in a few arrays.
SCORES = 2_000_000


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays; null where either has norm 0.  For many vectors use :func:`neighbours`."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = 4096) -> DataFrame:
    """Top ``k`` rows of ``vectors`` for each of ``queries`` (query_id, vector): query_id, id, score, rank.

    Queries are broadcast ``query_block`` at a time.  A task multiplies pieces of its
    Arrow batches, of ``SCORES`` scores, with the block's matrix and passes on ``k`` rows a query
    and piece, ties more, so little is shuffled whatever the number of vectors.  Zero and
    null vectors have no neighbours and are none.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where("id is not null and v is not null")
    wanted = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<float>").alias("v")).where("v is not null")
    total = wanted.count()
    parts = max(1, -(-total // query_block))
    out = None
    for part in range(parts):
        mine = wanted if parts == 1 else wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        by_size: dict[int, list] = {}
        for r in mine.collect():
            by_size.setdefault(len(r["v"]), []).append((r["query_id"], r["v"]))
        shared = spark.sparkContext.broadcast([sorted(x, key=lambda r: r[0]) for x in by_size.values()])

        def run(batches, shared=shared):
            for batch in batches:
                for held in shared.value:
                    step = max(1, SCORES // len(held))
                    for start in range(0, batch.num_rows, step):
                        yield from _best(batch.slice(start, step), held, k)

        found = rows.mapInArrow(run, "query_id long, id long, score double")
        out = found if out is None else out.unionByName(found)
    return top_per(out, k)


def _best(batch: pa.RecordBatch, held: list, k: int):
    """The ``k`` best rows of a batch for each of the queries ``held``, which have vectors of one length."""
    q = np.array([v for _, v in held], np.float64)
    norm = np.linalg.norm(q, axis=1)
    names = np.array([i for i, _ in held])
    column = batch.column(1)
    sizes = np.asarray(pa.compute.list_value_length(column))
    fits = np.flatnonzero(sizes == q.shape[1])
    if not len(fits):
        return
    part = batch.take(pa.array(fits))
    v = part.column(1).flatten().to_numpy().astype(np.float64).reshape(-1, q.shape[1])
    ids = part.column(0).to_numpy()
    size = np.linalg.norm(v, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.round((q @ v.T) / (norm[:, None] * size[None, :]), 6)
    score[~np.isfinite(score)] = -np.inf
    if len(ids) > k:
        # ties at the k-th place all go on, the window decides by id
        least = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
        row, at = np.nonzero((score >= least[:, None]) & (score > -np.inf))
    else:
        row, at = np.nonzero(score > -np.inf)
    yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(ids[at]), pa.array(score[row, at] + 0.0)], names=["query_id", "id", "score"])


def nearest_only(vectors: DataFrame, queries: DataFrame, k: int, final: int, **options) -> DataFrame:
    """Where there is no lexical index: the nearest ``max(k, final)`` rows, of which ``final`` are kept."""
    return neighbours(vectors, queries, max(k, final), **options).where(F.col("rank") <= final)


def min_max(scored: DataFrame, by: str = "query_id", score: str = "score") -> DataFrame:
    """Scores moved to 0..1 within each group; a group of equal scores becomes 0."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return scored.withColumn(score, (F.col(score) - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low))


def merge_topics(full: DataFrame, topics: DataFrame, discount: float) -> DataFrame:
    """Full-text scores (id, score) with discounted topic scores (id of the parent, score): the larger counts."""
    best = topics.groupBy("id").agg((F.max("score") * discount).alias("topic"))
    both = full.withColumnRenamed("score", "full").join(best, "id", "full_outer")
    via = F.when(F.col("topic").isNull(), "fulltext").when(F.col("full").isNull(), "topic").otherwise("both")
    return both.select("id", F.greatest("full", "topic").alias("score"), via.alias("matched_via"))
