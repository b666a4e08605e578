"""Rank fusion, boosts and the shaping of result lists.

Result lists have the columns query_id, id, score and whatever else an operator
names.  Every order ends in an ordinal, so results do not depend on
partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import FUSION, Fusion
from ..functions.text import boilerplate_hits, jaccard


def fuse_ranks(vector: DataFrame, lexical: DataFrame, p: Fusion = FUSION) -> DataFrame:
    """Reciprocal rank fusion of two lists with ``rank`` from 1: query_id, id, score, source, ``ord``.

    Ties keep the vector list's order, then the lexical list's.
    """
    a = vector.select("query_id", "id", F.col("rank").alias("vr"))
    b = lexical.select("query_id", "id", F.col("rank").alias("lr"))
    both = a.join(b, ["query_id", "id"], "full_outer")
    part = lambda r: F.coalesce(1 / (F.lit(p.rank_constant) + F.col(r)), F.lit(0.0))
    source = F.when(F.col("lr").isNull(), "embedding").when(F.col("vr").isNull(), "bm25").otherwise("both")
    order = F.coalesce(F.col("vr"), F.lit(1_000_000) + F.col("lr"))
    return both.select("query_id", "id", F.round(part("vr") + part("lr"), 6).alias("score"), source.alias("source"), order.alias("ord"))


def add_supplemental(main: DataFrame, extra: DataFrame, p: Fusion = FUSION) -> DataFrame:
    """Add the best discounted score of the supplemental lists (query_id, id, score) to the main list."""
    best = extra.groupBy("query_id", "id").agg((F.max("score") * p.supplemental_discount).alias("more"))
    both = main.join(best, ["query_id", "id"], "full_outer")
    score = F.round(F.coalesce("score", F.lit(0.0)) + F.coalesce("more", F.lit(0.0)), 6)
    return both.select("query_id", "id", score.alias("score"), F.coalesce("source", F.lit("bm25")).alias("source"))


def keyword_factor(text: Column, terms: Column, p: Fusion = FUSION) -> Column:
    hits = F.size(F.filter(terms, lambda t: F.contains(F.lower(text), t)))
    return 1 + hits * p.keyword_step


def keyword_hits(text: Column, terms: Column) -> Column:
    return F.size(F.filter(terms, lambda t: F.contains(F.lower(text), t)))


def member_factor(value: Column, wanted: list[str], factor: float) -> Column:
    """``factor`` where the value contains any of ``wanted`` regardless of case, else 1."""
    hit = F.lit(False)
    for w in wanted:
        hit = hit | F.contains(F.lower(value), F.lit(w.lower()))
    return F.when(hit, F.lit(factor)).otherwise(F.lit(1.0))


def boilerplate_factor(text: Column, patterns: tuple[str, ...], p: Fusion = FUSION) -> Column:
    hits = boilerplate_hits(text, patterns)
    return F.when(hits >= 2, F.lit(p.boilerplate_two)).when(hits == 1, F.lit(p.boilerplate_one)).otherwise(F.lit(1.0))


def inject(main: DataFrame, pool: DataFrame, targets: list, group_of: DataFrame, p: Fusion = FUSION) -> DataFrame:
    """Add well matching rows of the target groups that the main list lacks.

    ``main``: query_id, id, score, source; ``group_of``: id, group of all rows;
    ``pool``: query_id, id, score (a similarity), group, the nearest rows of the
    targets.  Of its best ``inject_pool`` rows a target, those not in ``main``
    that are similar enough enter, at most ``inject_cap`` a group, with the main
    list's upper median.  Without targets, with more than ``inject_targets``, or
    where each target has ``inject_enough`` rows in the main list already, the
    list stays as it is.
    """
    if not 0 < len(targets) <= p.inject_targets:
        return main.select("query_id", "id", "score", "source")
    of_targets = main.select("query_id", "id").join(group_of.where(F.col("group").isin(targets)), "id").groupBy("query_id", "group").count()
    served = of_targets.where(F.col("count") >= p.inject_enough).groupBy("query_id").count().where(F.col("count") == len(set(targets)))
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = pool.withColumn("r", F.row_number().over(top)).where(F.col("r") <= p.inject_pool * len(targets)).join(served.select("query_id"), "query_id", "left_anti")
    new = best.join(main.select("query_id", "id"), ["query_id", "id"], "left_anti").where(F.col("score") >= p.inject_min_similarity)
    per = Window.partitionBy("query_id", "group").orderBy(F.desc("score"), "id")
    new = new.withColumn("g", F.row_number().over(per)).where(F.col("g") <= p.inject_cap)
    scores = F.array_sort(F.collect_list("score"))
    middle = main.groupBy("query_id").agg(F.element_at(scores, (F.floor(F.count("*") / 2) + 1).cast("int")).alias("median"))
    added = new.join(middle, "query_id").select("query_id", "id", F.col("median").alias("score"), F.lit("injected").alias("source"))
    return main.select("query_id", "id", "score", "source").unionByName(added)


def drop_near_copies(ranked: DataFrame, p: Fusion = FUSION) -> DataFrame:
    """In score order drop rows whose token set (column ``tokens``) is close to one already kept.

    A fold over each query's candidates, of which a list has some dozens.
    """
    item = F.struct((-F.col("score")).alias("s"), F.col("id").alias("id"), F.array_distinct("tokens").alias("t"))
    lists = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    none = F.slice(F.col("all"), 1, 0)
    kept = F.aggregate("all", none, lambda acc, x: F.when(F.exists(acc, lambda k: jaccard(k["t"], x["t"]) >= p.jaccard), acc).otherwise(F.concat(acc, F.array(x))))
    return lists.select("query_id", F.posexplode(kept).alias("pos", "x")).select("query_id", F.col("x.id").alias("id"), (-F.col("x.s")).alias("score"), (F.col("pos") + 1).cast("long").alias("rank"))


def group_cap(targets: list[str], n_terms: int, multi: Column, share: Column, p: Fusion = FUSION) -> Column:
    """How many rows a group may keep.

    Targets (three at most) get a multiple.  With two or more terms, a group with
    several rows that match two terms (``multi``), and a large share of all such
    rows, gets more too.
    """
    dense = F.lit(n_terms >= 2) & (multi >= p.dense_hits) & (share >= p.dense_share)
    target = F.col("group").isin(targets) if 0 < len(targets) <= 3 else F.lit(False)
    return F.greatest(F.when(target, F.lit(p.target_cap_factor * p.group_cap)).otherwise(p.group_cap), F.when(dense, F.lit(p.dense_cap_factor * p.group_cap)).otherwise(p.group_cap))


def with_caps(ranked: DataFrame, targets: list[str], n_terms: int, p: Fusion = FUSION) -> DataFrame:
    """``ranked`` (query_id, group and ``hits``, the matching terms, among others) with the ``cap`` of each row's group, in one pass."""
    strong = (F.col("hits") >= 2).cast("int")
    multi = F.sum(strong).over(Window.partitionBy("query_id", "group"))
    every = F.sum(strong).over(Window.partitionBy("query_id"))
    return ranked.withColumn("cap", group_cap(targets, n_terms, multi, multi / F.nullif(every, F.lit(0)), p))


def caps(ranked: DataFrame, targets: list[str], n_terms: int, p: Fusion = FUSION) -> DataFrame:
    """The caps of all groups: query_id, group, cap."""
    return with_caps(ranked, targets, n_terms, p).select("query_id", "group", "cap").distinct()


def diversify(ranked: DataFrame, final: int, cap: DataFrame | None = None) -> DataFrame:
    """Rows with a keyword first, at most ``cap`` a group, then others up to what the cap leaves; ``final`` rows in all.

    ``ranked``: query_id, id, group, score, rank, ``hits``, and ``cap`` unless a
    table of caps is given.  The order is that of the two passes.
    """
    rows = (ranked.join(cap, ["query_id", "group"], "left") if cap is not None else ranked).withColumn("keyed", F.col("hits") > 0)
    per = Window.partitionBy("query_id", "group", "keyed").orderBy("rank")
    group = Window.partitionBy("query_id", "group")
    rows = rows.withColumn("n", F.row_number().over(per))
    first = F.least(F.sum(F.col("keyed").cast("int")).over(group), F.col("cap"))
    rows = rows.withColumn("left", F.col("cap") - first)
    stage = F.when(F.col("keyed") & (F.col("n") <= F.col("cap")), 1).when(~F.col("keyed") & (F.col("n") <= F.col("left")), 2)
    rows = rows.withColumn("stage", stage).where(F.col("stage").isNotNull())
    order = Window.partitionBy("query_id").orderBy("stage", "rank")
    return rows.withColumn("pos", F.row_number().over(order).cast("long")).where(F.col("pos") <= final).select("query_id", "id", "group", "score", "stage", "pos", "hits")


def group_factor(group: Column, targets: list, p: Fusion = FUSION) -> Column:
    """The boost of the rows of target groups."""
    return F.when(group.isin(targets), F.lit(p.group_boost)).otherwise(F.lit(1.0)) if targets else F.lit(1.0)


def expand_neighbours(results: DataFrame, chunks: DataFrame, n_terms: int, p: Fusion = FUSION) -> DataFrame:
    """Append the chunks before and after results that match enough terms, at a fraction of their score.

    ``results``: query_id, prefix, number, score, pos, hits; ``chunks``: prefix,
    number.  A chunk already there is not added again; of two parents the first
    counts.
    """
    strong = results.where(F.col("hits") >= min(2, n_terms))
    beside = strong.select("query_id", "prefix", "pos", F.col("score").alias("parent"), F.posexplode(F.array(F.col("number") - 1, F.col("number") + 1)).alias("side", "number"))
    there = beside.join(chunks.select("prefix", "number"), ["prefix", "number"], "left_semi")
    new = there.join(results.select("query_id", "prefix", "number"), ["query_id", "prefix", "number"], "left_anti")
    first = Window.partitionBy("query_id", "prefix", "number").orderBy("pos", "side")
    new = new.withColumn("r", F.row_number().over(first)).where("r = 1")
    added = new.select("query_id", "prefix", "number", (F.col("parent") * p.neighbour_factor).alias("score"), F.lit(True).alias("added"))
    return results.select("query_id", "prefix", "number", "score", F.lit(False).alias("added")).unionByName(added)


def apply_order(results: DataFrame, order: DataFrame, least: int = 6) -> DataFrame:
    """Results (query_id, id, rank) in a reranker's order (query_id, rank, pos).

    Unknown and repeated indices are passed over, omitted results follow in their
    old order, and lists shorter than ``least`` stay as they are.
    """
    once = order.groupBy("query_id", "rank").agg(F.min("pos").alias("pos"))
    size = F.count("*").over(Window.partitionBy("query_id"))
    rows = results.withColumn("n", size).join(once, ["query_id", "rank"], "left")
    key = F.when(F.col("n") < least, F.col("rank")).otherwise(F.coalesce("pos", F.col("n") + 1_000_000 + F.col("rank")))
    new = F.row_number().over(Window.partitionBy("query_id").orderBy(key, "rank")).cast("long")
    return rows.withColumn("new_rank", new).select("query_id", "id", "rank", "new_rank", (F.col("n") - F.col("new_rank") + 1).alias("score"))
