"""Filters, pages, aggregates and lookups over a catalog table with an explicit row order."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F


def contains_ci(value: Column, part: str) -> Column:
    return F.contains(F.lower(value), F.lit(part.lower()))


def any_contains_ci(values: Column, part: str) -> Column:
    return F.exists(values, lambda x: F.contains(F.lower(x), F.lit(part.lower())))


@dataclass(frozen=True)
class Filters:
    """Optional predicates; those that are set are joined by AND.

    ``decade`` is its first year, ``years`` is inclusive, ``text`` matches any of
    the columns it is given for, ``member`` any element of an array column.
    """

    decade: int | None = None
    years: tuple[int, int] | None = None
    group: int | str | None = None
    text: str | None = None
    member: str | None = None

    def condition(self, columns: dict[str, list[str]]) -> tuple[Column, list[str]]:
        """(the conjunction, names of the filters applied); ``columns`` names the columns of each filter."""
        parts: list[Column] = []
        applied = [f.name for f in fields(self) if getattr(self, f.name) is not None]
        if self.decade is not None:
            parts.append(F.col(columns["decade"][0]).between(self.decade, self.decade + 9))
        if self.years is not None:
            parts.append(F.col(columns["years"][0]).between(*self.years))
        if self.group is not None:
            parts.append(F.col(columns["group"][0]) == self.group)
        if self.text is not None:
            parts.append(reduce(lambda a, b: a | b, [contains_ci(F.col(c), self.text) for c in columns["text"]]))
        if self.member is not None:
            parts.append(reduce(lambda a, b: a | b, [any_contains_ci(F.col(c), self.member) for c in columns["member"]]))
        return reduce(and_, parts, F.lit(True)), applied


def page(rows: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0, usual: int = 50, most: int = 200) -> DataFrame:
    """One page with ``total`` (rows before paging) and ``has_more``; a limit of 0 or none is the usual one.

    The count is one aggregate beside a top-k of ``offset + limit`` rows: the table
    is neither sorted nor gathered as a whole.
    """
    size = min(limit or usual, most)
    total = rows.agg(F.count("*").alias("total"))
    part = rows.orderBy(*order).offset(offset).limit(size)
    return part.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + size)  # one row


def whole_word_rank(rows: DataFrame, text_col: str, key: str, words: list[str], least: int = 2, k: int = 3) -> DataFrame:
    """Rows that contain at least ``least`` of the words as whole words, most matches first."""
    hits = reduce(lambda a, b: a + b, [F.rlike(F.lower(text_col), F.lit(rf"\b{w}\b")).cast("int") for w in words])
    return rows.withColumn("hits", hits).where(F.col("hits") >= least).orderBy(F.desc("hits"), key).limit(k)


def first_by(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(1)


def one_per_year(rows: DataFrame, year: Column, *order: Column) -> DataFrame:
    """The first row of each year in the given order, for every year from the least to the greatest; null where there is none."""
    keyed = rows.withColumn("year", year)
    top = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("year").orderBy(*order))).where("_r = 1").drop("_r")
    span = keyed.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    spine = span.select(F.explode(F.sequence("lo", "hi")).alias("year"))
    return spine.join(top, "year", "left")


def normal_groups(rows: DataFrame, column: str) -> DataFrame:
    """Group 0 becomes the greatest positive group."""
    most = rows.where(F.col(column) > 0).agg(F.max(column).alias("_most"))
    return rows.crossJoin(F.broadcast(most)).withColumn(column, F.when(F.col(column) == 0, F.coalesce("_most", F.col(column))).otherwise(F.col(column))).drop("_most")


def unpivot_counts(rows: DataFrame, columns: list[str], skip: tuple[str, ...] = ()) -> DataFrame:
    """How often each value stands in each of the columns: ``field``, ``value``, ``n``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    return rows.select(pairs).select("p.*").where(F.col("value").isNotNull() & ~F.lower("value").isin(*skip)).groupBy("field", "value").agg(F.count("*").alias("n"))


def crew_lookup(rows: DataFrame, roles: dict[str, str], name: str) -> DataFrame:
    """Rows where a name matches in any role array, with the roles and the first matching spelling."""
    match = {role: F.get(F.filter(F.col(c), lambda x: contains_ci(x, name)), F.lit(0)) for role, c in roles.items()}
    held = F.array_compact(F.array(*[F.when(v.isNotNull(), F.lit(role)) for role, v in match.items()]))
    return rows.withColumn("roles", held).withColumn("matched", F.coalesce(*match.values())).where(F.size("roles") > 0)


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New non-blank values replace old ones, unmatched new rows are added; ``change`` tells which happened."""
    fresh = new.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_in_new"))
    both = old.select(key, *columns, F.lit(True).alias("_in_old")).join(fresh, key, "full_outer")
    value = {c: F.coalesce(F.when(F.col(f"_new_{c}").cast("string") != "", F.col(f"_new_{c}")), F.col(c)) for c in columns}
    differs = reduce(lambda a, b: a | b, [~value[c].eqNullSafe(F.col(c)) for c in columns])
    change = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "kept").when(differs, "updated").otherwise("no_change")
    return both.select(key, *[v.alias(c) for c, v in value.items()], change.alias("change"))


def with_jobs(crew: Column, *jobs: str) -> Column:
    """Names of the people in ``crew`` (structs of order, job and name) who have one of the jobs, in order."""
    return F.transform(F.filter(crew, lambda x: x["job"].isin(*jobs)), lambda x: x["name"])


def billed(crew: Column, most: int = 8) -> Column:
    """Names of the first ``most`` people by order."""
    return F.transform(F.slice(F.array_sort(crew), 1, most), lambda x: x["name"])
