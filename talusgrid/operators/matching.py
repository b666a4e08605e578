"""Fuzzy, scored and as-of joins.

Fuzzy conditions have no equality of their own, so candidates come from joins on
words or trigrams that any match must share; only candidates are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import long_words, squeeze
from .assignment import greedy


def trigrams(text: Column) -> Column:
    starts = F.when(F.length(text) >= 3, F.sequence(F.lit(1), F.length(text) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(3))))


def names_alike(a: Column, b: Column) -> Column:
    """Equal, or one contains the other and is not much shorter, or most of their longer words are shared."""
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    inside = (F.contains(a, b) | F.contains(b, a)) & (shorter >= longer * 0.7)
    wa, wb = long_words(a), long_words(b)
    most = F.greatest(F.size(wa), F.size(wb))
    shared = F.size(F.filter(wa, lambda w: F.array_contains(wb, w)))
    return (a == b) | inside | ((most > 0) & (shared / most >= 0.6))


def _rarest(keyed: DataFrame, item: str, frequency: DataFrame, keep: Column) -> DataFrame:
    """Of each item's keys the ``keep`` rarest; ties go to the smaller key."""
    w = Window.partitionBy(item).orderBy("_f", "key")
    ranked = keyed.join(frequency, "key").withColumn("_r", F.row_number().over(w)).withColumn("_k", F.count("*").over(Window.partitionBy(item)))
    return ranked.where(F.col("_r") <= keep).select(item, "key")


def fuzzy_names(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of distinct non-empty names ``a`` of left and ``b`` of right that are alike.

    Candidates come from rare keys only.  If ``a`` shares three fifths of the
    longer list of words with ``b``, it shares one of its rarest words but for
    that many less one (prefix filtering); if one contains the other, the
    shorter's rarest trigram is in the longer, which is no longer than ten
    sevenths of it.
    """
    x, y = left.select(a).where(F.col(a) != "").distinct(), right.select(b).where(F.col(b) != "").distinct()
    grams = lambda c: F.explode(trigrams(F.col(c))).alias("key")
    gram_f = x.select(grams(a)).unionByName(y.select(grams(b))).groupBy("key").agg(F.count("*").alias("_f"))
    by_word = _sharing_most(x, y, a, b, 0.6)
    rare = lambda rows, c: _rarest(rows.select(c, grams(c)), c, gram_f, F.lit(1))
    size = lambda c: F.length(c)
    close = F.least(size(a), size(b)) >= F.greatest(size(a), size(b)) * 0.7
    by_gram = rare(x, a).join(y.select(b, grams(b)), "key").where(close).select(a, b).unionByName(x.select(a, grams(a)).join(rare(y, b), "key").where(close).select(a, b))
    short = x.where(F.length(a) < 3).join(y, F.contains(b, F.col(a)) & (F.length(b) <= 4)).select(a, b).unionByName(y.where(F.length(b) < 3).join(x, F.contains(a, F.col(b)) & (F.length(a) <= 4)).select(a, b))
    equal = x.join(y, F.col(a) == F.col(b)).select(a, b)
    pairs = by_word.unionByName(by_gram).unionByName(short).unionByName(equal).distinct()
    return pairs.where(names_alike(F.col(a), F.col(b)))


def _sharing_most(x: DataFrame, y: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """Pairs of distinct names, some more than once, that may share ``least`` of the longer one's words: those that share one of their rarest."""
    words = lambda c: F.explode(F.array_distinct(long_words(F.col(c)))).alias("key")
    frequency = x.select(words(a)).unionByName(y.select(words(b))).groupBy("key").agg(F.count("*").alias("_f"))
    prefix = lambda rows, c: _rarest(rows.select(c, words(c)), c, frequency, F.col("_k") - F.ceil(F.col("_k") * least - 1e-9) + 1)
    return _repeats(x, a).join(y.select(b, words(b)), "key").select(a, b).unionByName(prefix(x, a).join(prefix(y, b), "key").select(a, b))


def _repeats(rows: DataFrame, c: str) -> DataFrame:
    """Names that repeat a word, with all their words: the repeats count as shared, so their rarest words are not enough."""
    listed = rows.where(F.size(long_words(F.col(c))) > F.size(F.array_distinct(long_words(F.col(c)))))
    return listed.select(c, F.explode(F.array_distinct(long_words(F.col(c)))).alias("key"))


def prefixes(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs of names of which one begins with the other.

    Each name meets the other side by equality with its beginnings, of up to the
    longest name there, so pairs are only made where they are results.
    """
    x, y = left.select(a).where(F.col(a) != "").distinct(), right.select(b).where(F.col(b) != "").distinct()
    longest = lambda rows, c: rows.agg(F.coalesce(F.max(F.length(c)), F.lit(1))).first()[0]
    begun = lambda rows, c, most: rows.select(c, F.explode(F.sequence(F.lit(1), F.least(F.length(c), F.lit(most)))).alias("_n")).select(c, F.substr(F.col(c), F.lit(1), F.col("_n")).alias("key"))
    longer_y = x.withColumn("key", F.col(a)).join(begun(y, b, longest(x, a)), "key").select(a, b)
    longer_x = begun(x, a, longest(y, b)).join(y.withColumn("key", F.col(b)), "key").select(a, b)
    return longer_y.unionByName(longer_x).distinct()


def inside(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs of names, of three characters at least, of which one contains the other: they meet by the shorter one's rarest trigram."""
    x, y = left.select(a).where(F.length(a) >= 3).distinct(), right.select(b).where(F.length(b) >= 3).distinct()
    grams = lambda c: F.explode(trigrams(F.col(c))).alias("key")
    frequency = x.select(grams(a)).unionByName(y.select(grams(b))).groupBy("key").agg(F.count("*").alias("_f"))
    rare = lambda rows, c: _rarest(rows.select(c, grams(c)), c, frequency, F.lit(1))
    inner = rare(x, a).join(y.select(b, grams(b)), "key").where(F.contains(b, F.col(a))).select(a, b)
    outer = x.select(a, grams(a)).join(rare(y, b), "key").where(F.contains(a, F.col(b))).select(a, b)
    return inner.unionByName(outer).distinct()


def first_named(rows: DataFrame, name: str, key: str, wanted: list[str]) -> DataFrame:
    """For each of the names the smallest key of the rows so named, else of those whose name contains it; one scan for all."""
    tier = lambda q: F.when(F.col(name) == q, 0).when(F.contains(name, F.lit(q)), 1)
    hit = F.inline(F.array(*[F.struct(F.lit(q).alias("q"), tier(q).alias("tier")) for q in wanted]))
    found = rows.select(key, hit).where("tier IS NOT NULL").groupBy("q").agg(F.min(F.struct("tier", key)).alias("best"))
    return found.select("q", F.col(f"best.{key}").alias(key))


def reconcile(left: DataFrame, right: DataFrame, a: str, b: str, least: float = 0.5) -> DataFrame:
    """Names of both sides in three passes: equal but for case and blanks, then alike, then what is left of either.

    Alike are pairs that share at least ``least`` of the longer one's words, assigned
    one to one by falling share; ties go to the smaller names.  Columns: ``a``, ``b``, ``state``.
    """
    x, y = left.select(a).distinct(), right.select(b).distinct()
    plain = lambda c: F.lower(F.trim(c))
    equal = x.join(y, plain(a) == plain(b)).select(a, b, F.lit("equal").alias("state"))
    rest_x, rest_y = x.join(equal, a, "left_anti"), y.join(equal, b, "left_anti")
    low_x, low_y = rest_x.select(a, F.lower(a).alias("_x")), rest_y.select(b, F.lower(b).alias("_y"))
    near = _sharing_most(low_x.select("_x").distinct(), low_y.select("_y").distinct(), "_x", "_y", least).distinct()
    wx, wy = long_words(F.col("_x")), long_words(F.col("_y"))
    share = F.size(F.filter(wx, lambda w: F.array_contains(wy, w))) / F.greatest(F.size(wx), F.size(wy))
    near = near.withColumn("_share", share).where(F.col("_share") >= least).join(low_x, "_x").join(low_y, "_y")
    alike = greedy(near, a, b, "_share").select(a, b, F.lit("alike").alias("state"))
    paired = equal.unionByName(alike)
    alone_x = rest_x.join(alike, a, "left_anti").select(a, F.lit(None).cast("string").alias(b), F.lit("left only").alias("state"))
    alone_y = rest_y.join(alike, b, "left_anti").select(F.lit(None).cast("string").alias(a), b, F.lit("right only").alias("state"))
    return paired.unionByName(alone_x).unionByName(alone_y)


def best_match(pairs: DataFrame, left: str, score: str, right: str) -> DataFrame:
    """The best right row of each left row; ties go to the smaller right key."""
    w = Window.partitionBy(left).orderBy(F.desc(score), right)
    return pairs.where(F.col(score).isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_keys(rows: DataFrame, by: list[str], key: str, most: int) -> DataFrame:
    """Of each group the ``most`` smallest different keys; Spark prunes before the shuffle."""
    w = Window.partitionBy(*by).orderBy(key)
    return rows.select(*by, key).where(F.col(key).isNotNull()).withColumn("_r", F.dense_rank().over(w)).where(F.col("_r") <= most).drop("_r").distinct()


def best_by_points(left: DataFrame, right: DataFrame, by: str, a: str, b: str, lead: str, name: str, size: str, bonus: Column) -> DataFrame:
    """The best of the pairs with equal ``by`` and different keys ``a`` and ``b`` of each a, without making the pairs: a, b, score.

    Ties go to the smaller b; a null score is the worst.
    Four points if the right name begins with ``lead``, three for the same whole-number
    ``size`` on both sides and one for a neighbouring size, and the right row's own ``bonus``.  Rows that
    would get the same points differ in their key only, so of each class of right rows
    two keys are enough, the second for where the first is the left row itself.  A
    left row is of two kinds, with and without the lead, and many rows share a kind.  A kind
    meets its four classes, any, same or neighbouring sizes, once, and passes its best two keys
    to its rows.  A class or kind that asks for less than a row has gives that row too few
    points, never too many, and the row stands in the fuller one as well.
    ``lead`` is one word without blanks.
    """
    word = F.split(name, " ")[0]
    classes = first_keys(right.where(F.col(by).isNotNull()).select(by, word.alias("_word"), bonus.alias("_bonus"), F.col(size).cast("long").alias("_size"), b), [by, "_word", "_bonus", "_size"], b, 2)
    # a class or kind without a lead or a size has null there
    either = F.explode(F.array_distinct(F.array(F.lit(None).cast("string"), F.col(lead)))).alias("_lead")
    rows = left.where(F.col(by).isNotNull() & F.col(a).isNotNull()).select(by, a, either, F.col(size).cast("long").alias("_own"))
    kind = [by, "_lead", "_own"]
    kinds = rows.select(*kind).distinct()
    leads = kinds.select(by, "_lead").where("_lead is not null").distinct()
    begun = classes.where("_word is not null").withColumn("_lead", F.explode(F.transform(F.sequence(F.lit(0), F.length("_word")), lambda n: F.substr("_word", F.lit(1), n))))
    kept = begun.join(leads, [by, "_lead"], "left_semi").drop("_word").unionByName(classes.drop("_word").withColumn("_lead", F.lit(None).cast("string")))
    sized = kept.withColumn("_size", F.explode(F.array_distinct(F.array(F.col("_size"), F.lit(None).cast("long")))))
    offered = first_keys(sized, [by, "_lead", "_bonus", "_size"], b, 2)
    none, own = F.lit(None), F.col("_own")
    # a null lead or size of a left row asks for the class without one, for which it gets no points
    points = lambda x, n: F.when(x.isNull(), 0).otherwise(n)
    asked = [F.struct(s.cast("long").alias("_size"), (points(F.col("_lead"), 4) + points(s, n)).alias("_points")) for s, n in ((none, 0), (own, 3), (own - 1, 1), (own + 1, 1))]
    wanted = kinds.select(*kind, F.explode(F.array_distinct(F.array(*asked))).alias("_c")).select(*kind, "_c.*")
    same = lambda c: (F.col(f"x.{by}") == F.col(f"y.{by}")) & F.expr(f"x._lead <=> y._lead AND x.{c} <=> y.{c}")
    met = wanted.alias("x").join(offered.alias("y"), same("_size")).groupBy(*(f"x.{c}" for c in kind), b).agg(F.max(F.col("_points") + F.col("_bonus")).alias("score"))
    best = F.desc_nulls_last("score"), b
    two = met.withColumn("_r", F.row_number().over(Window.partitionBy(*kind).orderBy(*best))).where("_r <= 2").drop("_r")
    pairs = rows.alias("x").join(two.alias("y"), same("_own")).where(F.col(a) != F.col(b)).select(a, b, "score")
    return pairs.withColumn("_r", F.row_number().over(Window.partitionBy(a).orderBy(*best))).where("_r = 1").drop("_r")


def contained_titles(queries: DataFrame, titles: DataFrame, query_key: str, query: str, title: str) -> DataFrame:
    """The longest title that each query contains as whole words; ties go to the smaller title.

    Titles join on their first word, which the query must have.
    """
    words = queries.select(query_key, F.concat(F.lit(" "), squeeze(F.col(query)), F.lit(" ")).alias("_q"), F.explode(F.array_distinct(F.split(squeeze(F.col(query)), " "))).alias("_w"))
    named = titles.select(title).where(F.col(title) != "").distinct().withColumn("_w", F.split(title, " ")[0])
    hits = words.join(named, "_w").where(F.contains("_q", F.concat(F.lit(" "), F.col(title), F.lit(" "))))
    w = Window.partitionBy(query_key).orderBy(F.desc(F.length(title)), title)
    return hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(query_key, title)


def edits(size: Column) -> Column:
    """The edits that a query of ``size`` characters allows: one in eight, at least one."""
    return F.greatest(F.lit(1), F.floor(size / 8).cast("int"))


def _piece_size(size: Column) -> Column:
    return F.floor(size / (edits(size) + 1)).cast("int")


def _pieces(query: Column) -> Column:
    """One piece more than there may be edits, so that one is whole in every match, no further off its place than the edits."""
    size, most = _piece_size(F.length(query)), edits(F.length(query))
    shifted = lambda i: F.transform(F.sequence(-most, most), lambda d: F.struct((i * size + d).alias("at"), F.substr(query, i * size + 1, size).alias("piece")))
    return F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), most), shifted)))).alias("_p")


def _piece_places(name: Column) -> Column:
    """The pieces of a name, with their places, in the sizes that queries within the allowed edits of it have."""
    n = F.length(name)
    lengths = F.sequence(F.greatest(F.lit(1), F.floor(n * 8 / 9).cast("int") - 1), F.floor(n * 8 / 7).cast("int") + 1)
    of_size = lambda size: F.transform(F.sequence(F.lit(0), n - size), lambda i: F.struct(i.alias("at"), F.substr(name, i + 1, size).alias("piece")))
    return F.explode(F.flatten(F.transform(F.array_distinct(F.transform(lengths, _piece_size)), of_size))).alias("_p")


def cascade(queries: DataFrame, rows: DataFrame, query: str, name: str, key: str) -> DataFrame:
    """Per query the rows of the first tier with a match: exact, normalised, part, then edit distance.

    Both sides must have the normalised forms in columns ``norm_q`` and ``norm``.
    A query whose normal form is empty matches nothing.  Names are compared once
    each, whatever their number of rows; those for the distance tier share a piece
    of the query.
    """
    names = rows.select(name, "norm").distinct()
    q = queries.where(F.col("norm_q") != "")
    exact = q.join(names, F.lower(F.col(query)) == F.lower(F.col(name))).select(query, name, F.lit(1).alias("tier"))
    normal = q.join(names, F.col("norm_q") == F.col("norm")).select(query, name, F.lit(2).alias("tier"))
    gram = F.explode(F.when(F.length("norm_q") >= 3, F.slice(trigrams(F.col("norm_q")), 1, 1)).otherwise(F.array("norm_q"))).alias("g")
    grams = names.select(name, "norm", F.explode(F.array_union(trigrams(F.col("norm")), F.array("norm"))).alias("g"))
    part = q.select(query, "norm_q", gram).join(grams, "g").where(F.contains("norm", F.col("norm_q"))).select(query, name, F.lit(3).alias("tier"))
    short = q.where(F.length("norm_q") < 3).join(names, F.contains("norm", F.col("norm_q"))).select(query, name, F.lit(3).alias("tier"))
    near = q.select(query, "norm_q", _pieces(F.col("norm_q"))).select(query, "norm_q", "_p.*").join(names.select(name, "norm", _piece_places(F.col("norm"))).select(name, "norm", "_p.*"), ["at", "piece"])
    near = near.where(F.levenshtein("norm_q", "norm") <= edits(F.length("norm_q"))).select(query, name, F.lit(4).alias("tier"))
    found = exact.unionByName(normal).unionByName(part).unionByName(short).unionByName(near).groupBy(query, name).agg(F.min("tier").alias("tier"))
    best = found.withColumn("_t", F.min("tier").over(Window.partitionBy(query))).where("tier = _t").drop("_t")
    return best.join(rows.select(name, key), name)


def _carried(rows: DataFrame, by: str, at: str, unit: str) -> DataFrame:
    """Rows with ``_seen``, the last ``_last`` that is not null in their group so far, by ``at``, ``_side`` and ``_tie``.

    Each group is cut into slices of time, so that many tasks share a group with
    very many rows.  A slice begins with a row (``_side`` -1) that holds what the
    slices before it left.
    """
    cut = rows.withColumn("_slice", F.date_trunc(unit, at))
    rank = F.when(F.col("_last").isNotNull(), F.struct(at, "_side", "_tie"))
    left = cut.groupBy(by, "_slice").agg(F.max_by("_last", rank).alias("_left"))
    before = Window.partitionBy(by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    first = left.select(by, "_slice", F.last("_left", ignorenulls=True).over(before).alias("_last"), F.lit(-1).alias("_side"))
    w = Window.partitionBy(by, "_slice").orderBy(at, "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    return cut.unionByName(first, allowMissingColumns=True).withColumn("_seen", F.last("_last", ignorenulls=True).over(w)).drop("_slice")


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str, tie: str, unit: str = "day") -> DataFrame:
    """Each left row with the latest right row of its group that is not later (``<value>_at`` and ``<value>``).

    Both sides go into one sorted pass over slices of ``unit``, so nothing is
    multiplied; ``at`` is a date or time.  At equal times the right row with the
    largest ``tie`` counts.  Rows whose group is null form a group; a row without a
    time matches nothing on either side.
    """
    right = right.where(F.col(at).isNotNull())
    side = F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), F.col(value).alias("v"))
    r = right.select(by, at, F.lit(0).alias("_side"), F.col(tie).alias("_tie"), side.alias("_last"), F.lit(None).cast(left.schema[tie].dataType).alias("_key"))
    x = left.select(by, at, F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.lit(None).cast(r.schema["_last"].dataType).alias("_last"), F.col(tie).alias("_key"))
    both = _carried(r.unionByName(x), by, at, unit).where("_side = 1")
    seen = F.when(F.col(at).isNotNull(), F.col("_seen"))
    return both.select(F.col("_key").alias(tie), by, at, seen["at"].alias(f"{value}_at"), seen["v"].alias(value))


def nearest_before(feedback: DataFrame, log: DataFrame, by: str, at: str, key: str, tiers: tuple[int, ...] = (300, 1800), unit: str = "day") -> DataFrame:
    """Pair feedback with the nearest earlier log row of the same group within the first tier of seconds that has one.

    A log row takes one feedback, the nearest (then the smallest key); of log rows
    at the same time that with the smallest key is paired.  Both sides go into one
    sorted pass over slices of ``unit``.  Null groups and times pair with nothing.
    """
    time = F.col(at).cast("timestamp").alias("_at")
    there = F.col(by).isNotNull() & F.col(at).isNotNull()
    f = feedback.where(there).select(by, time, F.lit(1).alias("_side"), F.col(key).alias("f_key"))
    g = log.where(there).groupBy(F.col(by), time).agg(F.min(key).alias("l_key"))
    g = g.select(by, "_at", F.lit(0).alias("_side"), F.struct("_at", "l_key").alias("_last"))
    both = g.unionByName(f, allowMissingColumns=True).withColumn("_tie", F.lit(0))
    gap = F.unix_micros("_at") - F.unix_micros("_seen._at")
    pairs = _carried(both, by, "_at", unit).where("_side = 1").select(by, "f_key", "_seen.l_key", gap.alias("gap")).where(F.col("gap") < tiers[-1] * 1_000_000)
    tier = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(tiers))):
        tier = F.when(F.col("gap") < s * 1_000_000, i).otherwise(tier)
    once = Window.partitionBy("l_key").orderBy("gap", "f_key")
    chosen = pairs.withColumn("tier", tier).withColumn("_o", F.row_number().over(once)).where("_o = 1")
    return chosen.select("f_key", "l_key", by, "tier", F.col("gap").alias("gap_us"))


def people_in(queries: DataFrame, people: DataFrame, query_key: str, query: str, name: str, least: int = 4) -> DataFrame:
    """The person each query names: by the full name, else by a last name of at least ``least`` letters as a whole word.

    The longest match wins, then the smaller name.  A full name has its last
    word's beginning in the query, so candidates meet on parts of words.
    """
    q = queries.select(query_key, F.lower(F.col(query)).alias("_q"))
    asked = q.select("*", F.explode(F.array_union(trigrams(F.col("_q")), F.array("_q"))).alias("_g"))
    named = people.select(name).where(F.col(name) != "").distinct().withColumn("_low", F.lower(name)).withColumn("_last", F.element_at(F.split("_low", " "), -1))
    # each name is looked up by the beginning of its last word, which both kinds of match contain
    keyed = named.withColumn("_g", F.when(F.length("_last") >= 3, F.substring("_last", 1, 3)))
    short = q.join(named.where(F.length("_last") < 3), F.contains("_q", F.col("_low"))).select(query_key, "_q", name, "_low", "_last")
    pairs = asked.join(keyed, "_g").select(query_key, "_q", name, "_low", "_last").unionByName(short).distinct()
    last = (F.length("_last") >= least) & F.array_contains(F.split("_q", r"[^a-z]+"), F.col("_last"))
    size = F.when(F.contains("_q", F.col("_low")), F.length("_low")).when(last, F.length("_last"))
    found = pairs.withColumn("size", size)
    return best_match(found.select(query_key, name, "size"), query_key, "size", name)
