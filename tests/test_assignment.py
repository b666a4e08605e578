"""Greedy assignment against one pass over sorted pairs, best titles against all pairs, joins on odd rows."""

import random

from pyspark.sql import functions as F

from talusgrid.operators import assignment, matching


def one_pass(pairs):
    used_a, used_b, out = set(), set(), []
    for a, b, w in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            out.append((a, b, w))
    return sorted(out)


def test_greedy_equals_one_pass(spark):
    rnd = random.Random(3)
    tied = [(a, b, rnd.choice([0.5, 0.6, 0.9])) for a in range(25) for b in range(25) if rnd.random() < 0.4]
    # each pair blocks the next lighter one, so that they fall one round after the other
    chain = [(i // 2 + i % 2, i // 2, 20.0 - i) for i in range(14)]
    for pairs in (tied, chain, []):
        df = spark.createDataFrame([*pairs, (None, 1, 1.0), (1, None, 1.0), (2, 2, None)], "a int, b int, w double")
        assert sorted(map(tuple, assignment.greedy(df.unionByName(df), "a", "b", "w").collect())) == one_pass(pairs)


def names(n, seed):
    """Every name has the word ``the``; some are inside others, some only share it."""
    rnd = random.Random(seed)
    return ["the " + " ".join(rnd.choice(["red", "blue", "ring", "rings", "bolt", "gear", "of", "nut", "axle"]) for _ in range(rnd.randint(0, 4))) + str(rnd.choice(["", "", i])) for i in range(n)]


def title_scores(x, y, longer):
    size = lambda s: {w for w in s.split(" ") if len(w) > 2}
    wx, wy = size(x), size(y)
    if x == y:
        return 100.0
    share = len(wx & wy) / max(len(wx), len(wy) if longer else 0, 1)
    return max(80.0 if x in y or y in x else 0.0, 50 + 30 * share if share else 0.0)


def test_best_titles_equal_all_pairs(spark):
    left = [*names(60, 1), "zz", "a long name " + " ".join(f"word{i}" for i in range(10)), "q" * 70, "the"]
    right = [*names(80, 2), "name long " + " ".join(f"word{i}" for i in range(3, 12)), "p" + "q" * 75, "zz top", "x" * 80, "word3"]
    x, y = spark.createDataFrame([(n,) for n in [*left, None, ""]], "x string"), spark.createDataFrame([(n,) for n in [*right, None, right[0]]], "y string")
    for longer in (True, False):
        got = {r.x: (r.y, round(r.score, 6)) for r in assignment.best_titles(x, y, "x", "y", 80, lambda share: 50 + 30 * share, equal=100, longer=longer).collect()}
        want = {}
        for n in set(left):
            score, other = min((-title_scores(n, m, longer), m) for m in right)
            if score:
                want[n] = (other, round(-score, 6))
        assert got == want


def test_candidates_stay_flat(spark):
    """Ten times the names, all of which share a word: the rows that meet grow as the names, not as their square."""
    met = []
    for n in (200, 2000):
        rows = spark.range(n).select(F.concat(F.lit("the part w"), F.col("id").cast("string")).alias("x"))
        other = spark.range(n).select(F.concat(F.lit("the piece v"), F.col("id").cast("string")).alias("y"))
        best = assignment.best_by_words(rows, other, "x", "y")
        best.collect()
        joined = [int(m) for m in join_rows(best)]
        met.append(max(joined) / n)
        assert best.count() == n
    assert met[1] <= 1.5 * met[0]


def join_rows(df):
    """Output rows of the joins of a plan that has run."""
    plan = df._jdf.queryExecution().executedPlan()
    todo, out = [plan], []
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
        if "Join" in node.nodeName():
            out.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_as_of_without_times(spark):
    """A right row without a time is never the latest; a left row without one matches nothing."""
    make = lambda rows: spark.createDataFrame(rows, "g string, s double, k long, v double").select("g", F.timestamp_seconds("s").alias("at"), "k", "v")
    left, right = make([("a", 100.0, 1, None), ("a", None, 2, None), ("b", 100.0, 3, None), (None, 100.0, 4, None)]), make([("a", None, 5, 5.0), ("b", None, 6, 6.0), ("b", 90.0, 7, 7.0), (None, 80.0, 8, 8.0)])
    got = {r.k: (r.v_at is not None, r.v) for r in matching.as_of(left, right, "g", "at", "v", "k").collect()}
    assert got == {1: (False, None), 2: (False, None), 3: (True, 7.0), 4: (True, 8.0)}


def test_names_inside_and_in_front(spark):
    """Every pair of one name inside, or in front of, another; frequent beginnings do not matter."""
    left = ["the ring", "the", "thering of", "ab", "", "xyz", "the ring of the bolt", "é ring"]
    right = ["the ring of", "ring", "the bolt", "zz", "the ring", "xyzw", "a", "é", None]
    x, y = spark.createDataFrame([(n,) for n in [*left, "the"]], "x string"), spark.createDataFrame([(n,) for n in right], "y string")
    named = [(m, n) for m in set(left) if m for n in right if n]
    pairs = lambda df: sorted((r.x, r.y) for r in df.collect())
    assert pairs(matching.prefixes(x, y, "x", "y")) == sorted((m, n) for m, n in named if m.startswith(n) or n.startswith(m))
    assert pairs(matching.inside(x, y, "x", "y")) == sorted((m, n) for m, n in named if min(len(m), len(n)) >= 3 and (m in n or n in m))
