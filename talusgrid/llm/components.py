"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and a join with it.  The minimum is written
first: a join of two tables, unlike one with an aggregate, is split by adaptive
execution where a node has very many neighbours.  Every round is written to the
shared folder, which bounds the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import clear_scratch, discard, materialize, scratch_mark


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialize(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    joined = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of every node with an edge.

    Edges with a null end and loops are ignored; no edges give an empty table.
    """
    now = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct()
    now = materialize(now, "edges")
    seen = None
    for _ in range(max_rounds):
        mark = scratch_mark()
        large = materialize(_large_star(now), "edges")
        after = materialize(_small_star(large).where("a <> b").distinct(), "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        discard(now)
        clear_scratch(mark - 1, keep=(after,))
        now = after
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    out._scratch_path = now._scratch_path
    return out
