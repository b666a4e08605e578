"""Places of names in texts against a plain search."""

from talusgrid.operators import automaton


def plain(texts, names, whole):
    spelled = {}
    for n in sorted({n for n in names if n}):
        spelled.setdefault(automaton.folded(n), n)
    out = []
    for i, t in texts:
        low = automaton.folded(t or "")
        for f, n in spelled.items():
            at = low.find(f)
            while at >= 0:
                if not whole or not ((at and low[at - 1].isalnum()) or low[at + len(f) : at + len(f) + 1].isalnum()):
                    out.append((str(i), n, at, at + len(f)))
                at = low.find(f, at + 1)
    return sorted(out)


def test_places(spark):
    texts = [(1, "Anna and ANNA BELL met Bell; annabell did not."), (2, None), (3, ""), (None, "İstanbul bell aaaa"), (1, "bell"), (4, "x " * 50_000 + "anna bell"), (5, "Ab ab-bell, É bell1")]
    names = ["Anna", "anna bell", "BELL", "bell", "aa", None, "", "é", "stanbul", "x x", "ab", *[f"name {i}" for i in range(300)]]
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts], "id long, text string, name string").repartition(3)
    known = spark.createDataFrame([(n,) for n in names], "who string")
    for whole in (True, False):
        want = plain(texts, names, whole)
        for block_bytes in (1 << 20, 200):
            got = automaton.places(df, known, "id", "text", "who", whole, block_bytes).collect()
            assert sorted((str(r.id), r.name, r.start, r.stop) for r in got) == want
    assert automaton.places(df, known.limit(0), "id", "text", "who").count() == 0
