"""Usage, feedback, latency and evaluation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def week_of(at: Column) -> Column:
    """The Monday of the week in UTC."""
    return F.date_trunc("week", at).cast("date")


def week_label(at: Column) -> Column:
    monday = week_of(at)
    return F.concat(monday.cast("string"), F.lit("/"), F.date_add(monday, 6).cast("string"))


def distribution(rows: DataFrame, by: list[str], label: Column, rating: Column) -> DataFrame:
    """Counts per label within ``by``, with one-decimal percentages and rated, good and bad counts."""
    n = F.count("*")
    out = rows.withColumn("label", F.coalesce(label, F.lit("unclassified"))).withColumn("_rating", rating).groupBy(*by, "label").agg(
        n.alias("n"), F.count("_rating").alias("rated"), F.count_if(F.col("_rating") == "good").alias("good"), F.count_if(F.col("_rating") == "bad").alias("bad")
    )
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    return out.withColumn("pct", F.round(share * 1000) / 10)


def compare_runs(a: DataFrame, b: DataFrame, key: str, passed: str) -> DataFrame:
    """improved, regressed or unchanged for every case that both runs have."""
    both = a.select(key, F.col(passed).alias("_a")).join(b.select(key, F.col(passed).alias("_b")), key)
    change = F.when(F.col("_b") & ~F.col("_a"), "improved").when(F.col("_a") & ~F.col("_b"), "regressed").otherwise("unchanged")
    return both.select(key, change.alias("change"))


def calibration(rows: DataFrame, confidence: str, correct: str, edges: tuple[float, ...] = (0.0, 0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """Accuracy in half-open buckets from each edge to the next; empty buckets stay, with null accuracy."""
    spark = rows.sparkSession
    bucket = F.lit(None).cast("double")
    for e in edges:
        bucket = F.when(F.col(confidence) >= e, F.lit(e)).otherwise(bucket)
    got = rows.select(bucket.alias("bucket"), F.col(correct).cast("double").alias("_ok")).groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("_ok"), 6).alias("accuracy"))
    every = spark.createDataFrame([(e,) for e in edges], "bucket double")
    return every.join(got, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), "accuracy")


def check_cases(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``failures`` (names of the conditions that are false) and ``passed``; null conditions are not asked for."""
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(name)) for name, c in checks.items()]))
    return rows.withColumn("failures", failed).withColumn("passed", F.size("failures") == 0)


def first_per_key(rows: DataFrame, keys: list[Column], *order: Column) -> DataFrame:
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = rows.select("*", *named)
    w = Window.partitionBy(*names).orderBy(*order)
    return keyed.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", *names)


def decisions(rows: DataFrame, kind: Column, accepted: Column) -> DataFrame:
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("proposed"), F.count_if(accepted).alias("accepted"), F.count_if(~accepted).alias("rejected"))
