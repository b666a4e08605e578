"""Order statistics of groups of any size.

The value at a rank is bracketed by the cuts of a sketch (Spark's mergeable
percentile sketch), whose two cuts around the rank leave a small part of the
group; what lies below and inside the bracket is counted exactly.  While a bracket
holds more than ``most`` rows and more than one value, its rows are sketched again.
The last brackets' values are counted and summed up in order.  A sketch that is
wrong about a bracket shows in the counts, and the bracket then stays as it was,
so the result is exact whatever the sketch says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..scratch import settle

#: A sketch's cuts; a bracket spans up to four of its parts.
CUTS = 64
#: Up to so many brackets are sent to all tasks.
FEW = 50_000


def disc(p: float):
    """The smallest value that at least a share ``p`` of the rows do not exceed."""
    return lambda n: F.greatest(F.lit(1), F.ceil(n * F.lit(p) - 1e-9)).cast("long")


def halves() -> dict:
    """The two middle ranks, which are the same for an odd number of rows."""
    return {"low": lambda n: F.floor((n + 1) / 2).cast("long"), "high": lambda n: F.floor(n / 2 + 1).cast("long")}


def order_statistics(rows: DataFrame, by: str, value: str, wanted: dict, most: int = 1_000_000, rounds: int = 20) -> DataFrame:
    """``by``, ``n`` (rows with a value) and the value at each wanted rank, a function of ``n``; a group without values has none.

    A null group is a group; values are compared as doubles, NaN as the largest.
    """
    rows = rows.select(F.col(by).alias("_g"), F.col(value).cast("double").alias("_v"))
    sizes = settle(rows.groupBy("_g").agg(F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    rows = rows.where(F.col("_v").isNotNull())
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).alias("rank")) for name, rank in wanted.items()]))
    now = settle(sizes.where("n > 0").select("_g", "n", "lo", "hi", each.alias("w")).select("_g", "w.name", "w.rank", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")))
    for _ in range(rounds):
        wide = now.where((F.col("inside") > most) & (F.col("lo") < F.col("hi")))
        if wide.isEmpty():
            break
        now = settle(_narrowed(rows, now, most))
    values = _within(rows, now).groupBy("_g", "name", "rank", "below", "_v").agg(F.count("*").alias("k"))
    so_far = F.col("below") + F.sum("k").over(Window.partitionBy("_g", "name").orderBy("_v"))
    at = values.withColumn("_to", so_far).where(F.col("_to") >= F.col("rank")).groupBy("_g", "name").agg(F.min("_v").alias("_v"))
    wide = at.groupBy("_g").agg(*[F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in wanted])
    found = sizes.join(wide.withColumnRenamed("_g", "_k"), F.col("_g").eqNullSafe(F.col("_k")), "left")
    return found.select(F.col("_g").alias(by), "n", *wanted)


def _within(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    b = brackets.withColumnRenamed("_g", "_k")
    b = F.broadcast(b) if brackets.limit(FEW + 1).count() <= FEW else b
    return rows.join(b, F.col("_g").eqNullSafe(F.col("_k")) & F.col("_v").between(F.col("lo"), F.col("hi"))).drop("_k")


def _narrowed(rows: DataFrame, now: DataFrame, most: int) -> DataFrame:
    """Brackets that were too wide, cut at the sketch's values on either side of the rank and counted again."""
    todo = (F.col("inside") > most) & (F.col("lo") < F.col("hi"))
    ids = ["_g", "name"]
    cuts = F.percentile_approx("_v", [i / CUTS for i in range(CUTS + 1)], 50 * CUTS).alias("cuts")
    sketched = _within(rows, now.where(todo)).groupBy(*ids).agg(cuts)
    place = F.floor((F.col("rank") - F.col("below")) / F.col("inside") * CUTS).cast("int")
    pick = lambda shift: F.element_at("cuts", F.greatest(F.lit(1), F.least(F.lit(CUTS + 1), place + 1 + shift)))
    same = (F.col("name") == F.col("sname")) & F.col("_g").eqNullSafe(F.col("s_g"))
    tried = sketched.select(F.col("_g").alias("s_g"), F.col("name").alias("sname"), "cuts")
    closer = settle(now.where(todo).join(tried, same).select("_g", "name", "rank", "lo", "hi", "below", "inside", pick(-1).alias("lo2"), pick(2).alias("hi2")))
    v = F.col("_v")
    counted = _within(rows, closer).groupBy(*ids).agg(F.count_if(v < F.col("lo2")).alias("more_below"), F.count_if(v.between(F.col("lo2"), F.col("hi2"))).alias("now_inside"))
    both = closer.join(counted.select(F.col("_g").alias("s_g"), F.col("name").alias("sname"), "more_below", "now_inside"), same)
    new_below = F.col("below") + F.col("more_below")
    good = (F.col("rank") > new_below) & (F.col("rank") <= new_below + F.col("now_inside")) & (F.col("now_inside") < F.col("inside"))
    keep = lambda new, old: F.when(good, new).otherwise(F.col(old)).alias(old)
    narrowed = both.select("_g", "name", "rank", keep(F.col("lo2"), "lo"), keep(F.col("hi2"), "hi"), keep(new_below, "below"), keep(F.col("now_inside"), "inside"))
    return now.where(~todo).unionByName(narrowed)


def latency(rows: DataFrame, by: str, value: str, most: int = 1_000_000) -> DataFrame:
    """Median, nearest-rank 95th percentile, mean and count, for groups of any size."""
    found = order_statistics(rows, by, value, {**halves(), "p95": disc(0.95)}, most)
    means = rows.groupBy(F.col(by).alias("_k")).agg(F.round(F.avg(F.col(value).cast("decimal(18,4)")).cast("double"), 6).alias("mean"))
    both = found.join(means, F.col(by).eqNullSafe(F.col("_k")))
    return both.select(by, F.round((F.col("low") + F.col("high")) / 2, 6).alias("median"), "p95", "mean", "n")
