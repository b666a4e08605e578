"""Greedy one-to-one assignment, and best matches that are found without making pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import long_words
from ..scratch import discard, settle

#: Names of up to so many words meet by sets of words, names of up to so many characters by parts.
SET_WORDS, PART_CHARS = 8, 64


def greedy(pairs: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """The pairs that a pass over all pairs by falling weight, then ``a``, then ``b`` would take: those of which neither end is taken yet.

    Each round takes the pairs that are the first of both their ends, all at once,
    and drops what they block; a pair that is the first of both ends is taken by the
    pass as well, whatever happens elsewhere.  Every round takes the heaviest pair at
    least; only a chain of falling weights needs as many rounds as it has links.
    Rounds are written, so the lineage stays short.  Null ends or weights are no pairs; repeated pairs are one.
    """
    left = settle(pairs.select(a, b, weight).dropna().groupBy(a, b).agg(F.max(weight).alias(weight)), "pairs")
    taken: list[DataFrame] = []
    order = F.struct((-F.col(weight)).alias("w"), F.col(a).alias("a"), F.col(b).alias("b"))
    while not left.isEmpty():
        first_a = left.groupBy(F.col(a).alias("_k")).agg(F.min(order).alias("_first")).select("_first")
        first_b = left.groupBy(F.col(b).alias("_k")).agg(F.min(order).alias("_first")).select("_first")
        both = first_a.join(first_b, "_first", "left_semi")
        round_ = settle(both.select(F.col("_first.a").alias(a), F.col("_first.b").alias(b), (-F.col("_first.w")).alias(weight)), "taken")
        taken.append(round_)
        rest = settle(left.join(round_.select(a), a, "left_anti").join(round_.select(b), b, "left_anti").select(a, b, weight), "pairs")
        discard(left)
        left = rest
    discard(left)
    out = pairs.select(a, b, weight).limit(0)
    for t in taken:
        out = out.unionByName(t)
    return out


def _word_sets(words: Column, least: float) -> Column:
    """Every set of the words, as text, that holds at least that share of them."""
    n = F.size(words)
    chosen = lambda mask: F.filter(words, lambda w, i: F.getbit(mask, i.cast("int")) == 1)
    masks = F.sequence(F.lit(1).cast("long"), F.pow(F.lit(2), n).cast("long") - 1)
    sets = F.transform(F.when(n > 0, masks).otherwise(F.array().cast("array<bigint>")), lambda m: F.struct(F.bit_count(m).alias("n"), F.array_join(chosen(m), " ").alias("key")))
    return F.filter(sets, lambda s: s["n"] >= F.greatest(F.lit(1), F.ceil(n * least - 1e-9)))


def best_by_words(left: DataFrame, right: DataFrame, a: str, b: str, least: float = 0.0, longer: bool = True, words: Callable[[Column], Column] = long_words) -> DataFrame:
    """Of each ``a`` the ``b`` that has the largest share of words in common, at least ``least``; ties go to the smaller.

    The share is of the longer name's distinct words, or else of ``a``'s.  Of all
    ``b`` with some set of words only the smallest of each size is kept, so a
    word that all names share makes no more candidates than names have sizes.  The
    set that two names have in common gives their share, smaller sets give less, so
    the best is among these.  Names of over ``SET_WORDS`` words meet by each word they share.
    """
    listed = lambda rows, c: rows.select(c).where(F.col(c).isNotNull()).distinct().withColumn("_w", F.array_sort(F.array_distinct(words(F.col(c))))).withColumn("_n", F.size("_w")).where("_n > 0")
    x, y = listed(left, a), listed(right, b)
    sets = lambda rows, c, part: rows.where(F.col("_n") <= SET_WORDS).select(c, "_n", F.explode(_word_sets(F.col("_w"), part)).alias("s")).select(c, "_n", "s.key", F.col("s.n").alias("_m"))
    size = (lambda own, other: F.greatest(own, other)) if longer else (lambda own, other: F.col(own))
    kept = sets(y, b, least if longer else 0.0).groupBy("key", (F.col("_n") if longer else F.lit(0)).alias("_size")).agg(F.min(b).alias(b))
    short = sets(x, a, least).join(kept, "key").select(a, b, (F.col("_m") / size("_n", "_size")).alias("share"))
    word = lambda rows, c, p: rows.select(F.col(c), F.col("_w").alias(f"{p}w"), F.col("_n").alias(f"{p}n"), F.explode("_w").alias("key"))
    many = F.col("_n") > SET_WORDS
    met = word(x.where(many), a, "_x").join(word(y, b, "_y"), "key").unionByName(word(x.where(~many), a, "_x").join(word(y.where(many), b, "_y"), "key")).dropDuplicates([a, b])
    rest = met.select(a, b, (F.size(F.array_intersect("_xw", "_yw")) / size("_xn", "_yn")).alias("share"))
    best = short.unionByName(rest).where(F.col("share") >= least).groupBy(a).agg(F.min(F.struct((-F.col("share")).alias("s"), F.col(b).alias("b"))).alias("_best"))
    return best.select(a, F.col("_best.b").alias(b), (-F.col("_best.s")).alias("share"))


def smallest_inside(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Of each ``a`` the smallest ``b`` that contains it or that it contains; null and empty names contain nothing.

    Names meet by equality with parts of each other, of lengths that the other side
    has; of all names with a part only the smallest is kept.  Two names of over
    ``PART_CHARS`` characters are compared where one has the other's first ``PART_CHARS``.
    """
    x, y = (rows.select(c).where(F.col(c) != "").distinct() for rows, c in ((left, a), (right, b)))
    # at most PART_CHARS numbers
    sizes = lambda rows, c: sorted(r[0] for r in rows.select(F.length(c)).where(F.length(c) <= PART_CHARS).distinct().collect())

    def parts(rows: DataFrame, c: str, lengths: list[int]) -> DataFrame:
        if not lengths:
            return rows.limit(0).select(c, F.lit("").alias("part"))
        starts = lambda n: F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - n + 1)).otherwise(F.array().cast("array<int>"))
        cut = F.flatten(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.transform(starts(n), lambda i: F.substr(F.col(c), i, n))))
        return rows.select(c, F.explode(F.array_distinct(cut)).alias("part"))

    inner = parts(x, a, sizes(y, b)).join(y.withColumn("part", F.col(b)), "part").groupBy(a).agg(F.min(b).alias(b))
    outer = x.withColumn("part", F.col(a)).join(parts(y, b, sizes(x, a)).groupBy("part").agg(F.min(b).alias(b)), "part").select(a, b)
    # a name of over PART_CHARS characters is inside another only if that is as long
    long_x, long_y = x.where(F.length(a) > PART_CHARS), y.where(F.length(b) > PART_CHARS)
    grams = lambda rows, c: rows.select(c, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - PART_CHARS + 1), lambda i: F.substr(F.col(c), i, F.lit(PART_CHARS))))).alias("part"))
    head = lambda rows, c: rows.select(c, F.substring(c, 1, PART_CHARS).alias("part"))
    far = grams(long_x, a).join(head(long_y, b), "part").where(F.contains(a, F.col(b))).select(a, b).unionByName(head(long_x, a).join(grams(long_y, b), "part").where(F.contains(b, F.col(a))).select(a, b))
    return inner.unionByName(outer).unionByName(far).groupBy(a).agg(F.min(b).alias(b))


def best_titles(left: DataFrame, right: DataFrame, a: str, b: str, inside: float, by_share: Callable[[Column], Column], equal: float, above: float | None = None, **words) -> DataFrame:
    """Of each ``a`` its best ``b`` and the ``score``: ``equal`` for equal names, else the greater of ``inside``, where one contains the other, and ``by_share`` of the words in common.

    Ties go to the smaller ``b``.  ``above`` leaves out scores that are not above it;
    ``words`` goes to :func:`best_by_words`.
    """
    x, y = left.select(a).distinct(), right.select(b).distinct()
    same = x.join(y, F.col(a) == F.col(b)).select(a, b, F.lit(float(equal)).alias("score"))
    rest = x.join(same, a, "left_anti")
    held = smallest_inside(rest, y, a, b).withColumn("score", F.lit(float(inside)))
    shared = best_by_words(rest, y, a, b, **words).select(a, b, by_share(F.col("share")).alias("score"))
    best = held.unionByName(shared).groupBy(a).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(b).alias("b"))).alias("_best"))
    out = same.unionByName(best.select(a, F.col("_best.b").alias(b), (-F.col("_best.s")).alias("score")))
    return out if above is None else out.where(F.col("score") > above)
