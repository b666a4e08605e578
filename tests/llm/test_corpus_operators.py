"""Corpus operators against brute force, and on null, empty, long, repeated and clashing rows."""

import base64
import hashlib
import math
import random
import time
import zlib
from collections import Counter
from decimal import Decimal

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from talusgrid.llm import bpe, bradley_terry, common, components, contamination, html_main, lang_zstd, line_spread, ppm, quality_cascade, registry, simhash_anchor, warc_index
from talusgrid.llm.common import crc_mod

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for name in ("documents", "labels", "benchmark", "pages"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and blank texts, a very long one, repeated rows, and columns named like inner ones."""
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [
        (1, "the same words stand here in this text twice", "en", "s1"), (1, "the same words stand here in this text twice", "en", "s1"),
        (2, "the same words stand here in this text twice", None, None), (None, "the same words stand here in this text twice", "en", "s2"),
        (3, None, "en", "s1"), (4, "", None, "s2"), (5, " \n\t ", "fr", None), (None, None, None, None), (6, long, "en", "s3"), (7, "one", "fr", "s3"),
        (8, "ça va très bien à l'école\nÀ bientôt 😀 naïve", "fr", "s1"), (9, "\x00 odd   <b>&amp;</b> \x1c end", "en", "s2"),
    ]
    df = spark.createDataFrame([(a, b, c, d, len(b) if b else None) for a, b, c, d in rows], DOCUMENTS)
    for name in ("fp", "block", "words", "label", "rank", "score", "held_out", "_k1", "_drop", "member", "h", "id", "train", "bucket", "component_id"):
        df = df.withColumn(name, F.lit("x"))
    return df


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def words_of(text):
    return (text or "").encode().lower().split()


# --- 1 quality ranking


def test_ranking_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [r for r in registry.op1_quality_ranking(spark, d).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in got]) > 0.95


def test_pairs_separate_and_degenerate_labels():
    x = np.random.default_rng(0).normal(size=(200, 3))
    good = x[:, 1] > 0.3
    model = bradley_terry.fit_pairs(x, good)
    assert np.mean((model.score(x) >= 0.5) == good) > 0.98
    assert set(bradley_terry.fit_pairs(x, np.ones(200, bool)).score(x)) == {0.5}
    assert bradley_terry.features(b"").shape == (len(bradley_terry.FEATURES),)


def test_ranking_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (6, 0), (6, 1), (None, 1), (7, None), (99, 0), (8, 0)], "doc_id long, quality int")
    model = bradley_terry.fit(odd, labels, F.lit(True))
    got = rows_of(bradley_terry.score(odd, model))
    assert len(got) == odd.count() and all(0 <= s <= 1 for _, s in got)
    assert len({s for i, s in got if i == 1}) == 1
    nothing = bradley_terry.fit(odd.limit(0), labels.limit(0), F.lit(True))
    assert bradley_terry.score(odd.limit(0), nothing).count() == 0


# --- 2 language


def test_language_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in registry.op2_language_id(spark, d).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got]) > 0.97


def test_language_odd_rows(spark, odd):
    model = lang_zstd.fit(odd, F.lit(True))
    got = rows_of(lang_zstd.identify(odd, model))
    assert len(got) == odd.count()
    assert {x[1] for x in got if x[0] in (3, 4, 5)} == {"und"} and {x[2] for x in got if x[0] == 3} == {0.0}
    kept = lang_zstd.keep_identified(odd, model)
    assert kept.columns == odd.columns and {3, 4, 5}.isdisjoint({r["doc_id"] for r in kept.collect()})
    nothing = lang_zstd.fit(odd.limit(0), F.lit(True))
    assert {x[1] for x in rows_of(lang_zstd.identify(odd, nothing))} == {"und"}


def test_language_of_long_texts_only(spark):
    draw = random.Random(5)
    made = lambda letters: ["".join(draw.choices(letters, k=draw.randint(2, 7))) for _ in range(300)]
    words = {"x1": made("कखगघचजटडतदनपबमयरलवसह"), "x2": made("कखगघचजटडतदनपबमयरलवसह"), "x3": made("etaoinshrdlu")}
    size = {"x1": 900, "x2": 30, "x3": 30}
    rows = [(i, " ".join(draw.choices(words[lang], k=size[lang])), lang) for i, lang in enumerate(["x1", "x2", "x3"] * 20)]
    assert min(len(t.encode()) for _, t, lang in rows if lang == "x1") > 8192
    model = lang_zstd.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert len(dict(model.dictionaries)["x1"]) > 30_000
    assert set(dict(model.dictionaries)["x1"].decode().split()[1:-1]) & set(words["x1"])
    new = [(i, " ".join(draw.choices(words[lang], k=k)), lang) for i, (lang, k) in enumerate([(x, k) for x in words for k in (30, 900)])]
    found = rows_of(lang_zstd.identify(spark.createDataFrame(new, "doc_id long, text string, lang string"), model))
    assert {(x[0], x[1], x[4]) for x in found} == {(i, lang, False) for i, _, lang in new}
    # a short text is taken whole, a long one in part, from where its hash says
    some = spark.createDataFrame([("abc",), ("",), ("abcdefgh" * 9,)], "text string")
    assert [bytes(r[0]) for r in some.select(lang_zstd.excerpt("text", 8)).collect()][:2] == [b"abc", b""]
    assert {len(r[0]) for r in some.select(lang_zstd.excerpt("text", 8)).collect()} == {3, 0, 8}


# --- 3 partial matching


def contexts_of(s, at):
    """The contexts of a place, longest first."""
    return ([s[:at]] if 3 <= at <= ppm.DEPTH else []) + [s[at - n : at] for n in (2, 1, 0) if n <= at]


def reference_trie(words):
    out = {}
    for w, n in words.items():
        s = ppm.padded(w)
        for at in range(1, len(s)):
            for c in contexts_of(s, at):
                out.setdefault(c, Counter())[s[at]] += n
    return out


def symbol_chance(trie, contexts, symbol):
    above, p = None, 1.0
    for c in contexts:
        seen = trie.get(c)
        if seen is None:
            continue
        total = sum(seen.values()) - sum(seen[x] for x in above or ())
        kinds = len(seen) - len(above or ())
        if total:
            if symbol in seen and symbol not in (above or ()):
                return p * (2 * seen[symbol] - 1) / (2 * total)
            p *= kinds / (2 * total)
        above = seen
    return p / (256 - len(trie.get(b"", ())))


def reference_log10(trie, word):
    s = ppm.padded(word)
    return sum(math.log10(symbol_chance(trie, contexts_of(s, at), s[at])) for at in range(1, len(s)))


def short_of(*counters):
    every = sorted({k for c in counters for k in ppm.short_counts([ppm.padded(w) for w in c], np.array(list(c.values())))[0].tolist()})
    counts = np.zeros((len(every), len(counters)))
    for z, c in enumerate(counters):
        keys, n = ppm.short_counts([ppm.padded(w) for w in c], np.array(list(c.values())))
        counts[np.searchsorted(every, keys), z] = n
    return ppm.ShortContexts(np.array(every), counts)


def test_trie_equals_a_dictionary_of_contexts():
    draw = random.Random(1)
    words = [bytes(draw.choice(b"abcd") for _ in range(draw.randint(1, 9))) for _ in range(300)] + [b"ab" * 40, b"ab" * 40 + b"c"] + [ppm.END] * 9
    first, second = Counter(words), Counter(words[:25])
    short = short_of(first, second)
    asked = sorted({*first, b"zz", b"abcdz", b"aabz", "é".encode(), b"a" * 300, b"ab" * 40 + b"d"})
    counts = np.array([[c[w] for c in (first, second)] for w in asked], float)
    got = ppm.log_probs(asked, counts, short)
    # the words of a range cost the same beside the beginnings of the others
    bounds = [b" abc", b" bb", b" bbbd", b" c"]
    for bucket in range(len(bounds) + 1):
        lo, hi = (b"", *bounds)[bucket], (*bounds, b"\xff")[bucket]
        mine = [i for i, w in enumerate(asked) if lo <= ppm.padded(w) < hi]
        rest = [i for i in range(len(asked)) if i not in mine]
        nodes = ppm._edges(bounds, bucket)
        others = [(s, v) for s, v in ppm._children([ppm.padded(asked[i]) for i in rest], counts[rest], nodes) if s not in nodes]
        part = ppm.log_probs([asked[i] for i in mine], counts[mine], short, others)
        assert np.allclose(part, got[mine])
    for z, c in enumerate((first, second)):
        trie = reference_trie(c)
        assert np.allclose(got[:, z], [reference_log10(trie, w) for w in asked])


def test_trie_symbols_sum_to_one():
    trie = reference_trie(Counter([b"ab", b"abc", b"abcde", b"b", ppm.END]))
    for s in (b" ", b" a", b" ab", b" abc", b"zz", b" abd"):
        assert sum(symbol_chance(trie, contexts_of(s, len(s)), x) for x in range(256)) == pytest.approx(1.0)


def reference_score(train, text):
    """``train``: (label, text) rows; the mixture worked out token by token in plain Python."""
    by = {}
    for label, t in train:
        by.setdefault(label, Counter()).update(words_of(t) + [ppm.END])
    whole = sum(by.values(), Counter())
    labels = [x for x in by if x]
    tries = [reference_trie(c) for c in (whole, *(by[x] for x in labels))]
    mass = [sum(n * (len(ppm.padded(w)) - 1) for w, n in by[x].items()) for x in labels]
    prior = [0.2] + [0.8 * m / sum(mass) for m in mass] if labels else [1.0]
    costs, total, own = [], 0.0, words_of(text) + [ppm.END]
    for i, w in enumerate(own):
        recent = [math.log10(p) + sum(c[z] for c in costs[max(0, i - ppm.WINDOW) : i]) for z, p in enumerate(prior)]
        share = [10 ** (r - max(recent)) for r in recent]
        now = [-math.ceil(reference_log10(t, w) * -ppm.UNITS) / ppm.UNITS for t in tries]
        p = sum(s * 10**c for s, c in zip(share, now)) / sum(share)
        a = 0.2 * i / (i + 20)
        total += math.log10(a * own[:i].count(w) / max(i, 1) + (1 - a) * p)
        costs.append(now)
    return total


def test_ppm_score_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 1500").limit(60)
    kept = [(r["doc_id"], r["lang"], r["text"]) for r in docs.collect()]
    kept += [(5000, None, "a label that is null counts for all alone"), (5001, "en", "https://a.example/one https://a.example/two"), (5002, "de", "https://a.example/three")]
    docs = spark.createDataFrame(kept, "doc_id long, lang string, text string")
    train = [(lang or "", t) for i, lang, t in kept if zlib.crc32(str(i).encode()) % 10]
    # blocks of a few documents, so that words meet from many blocks and contexts run over bounds
    got = {x[0]: x[5] for x in rows_of(ppm.score(docs, crc_mod("doc_id", 10) != 0, block_bytes=3000))}
    for i, _, text in kept[:12] + kept[-3:]:
        assert got[i] == pytest.approx(reference_score(train, text), abs=1e-3)


def test_ppm_rare_classes_share_a_trie(spark):
    docs = spark.createDataFrame([(i, ("a", "b", "c", "d", None)[i % 5], f"word{i % 5} word{i % 7} more") for i in range(60)], "doc_id long, lang string, text string")
    got = rows_of(ppm.score(docs, F.lit(True), components=2))
    assert len(got) == 60 and all(math.isfinite(x[5]) for x in got)


def test_ppm_counts_and_gain(spark):
    d = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    train = Counter()
    for i, t in docs.items():
        if zlib.crc32(str(i).encode()) % 10:
            train.update(words_of(t) + [b"\n"])
    total, kinds = sum(train.values()), len(train)
    held = [0.0, 0.0]
    for r in registry.op3_ppm(spark, d).collect():
        own = words_of(docs[r["doc_id"]]) + [b"\n"]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in train for w in own), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in own))
        if r["held_out"]:
            held[0] += r["base_score"]
            held[1] += r["score"]
    assert held[1] > held[0]


def test_ppm_odd_rows(spark, odd):
    got = rows_of(ppm.score(odd, crc_mod("doc_id", 10) != 0))
    assert len(got) == odd.count() and all(math.isfinite(x[5]) and x[5] <= 0 for x in got)
    assert {x[1] for x in got if x[0] in (3, 4, 5)} == {1}
    assert len({x[4:] for x in got if x[0] == 1}) == 1
    small = rows_of(ppm.score(odd, F.lit(True), block_bytes=10_000, class_col=None))
    assert {(x[0], x[1]) for x in small} == {(x[0], x[1]) for x in got} and all(math.isfinite(x[5]) for x in small)
    assert ppm.score(odd.limit(0), F.lit(True)).count() == 0
    untrained = rows_of(ppm.score(odd.where("doc_id = 7"), F.lit(False)))
    assert untrained[0][3] == 0 and untrained[0][5] == pytest.approx(-5 * math.log10(256), abs=0.02)


def test_ppm_long_tokens_cost_all_their_bytes(spark):
    draw = random.Random(3)
    word = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz0123456789+/=") for _ in range(10_000))
    docs = spark.createDataFrame([(1, "some plain words in some text"), (2, word), (3, f"some {word} {word} text")], "doc_id long, text string")
    trie = reference_trie(Counter([*words_of("some plain words in some text"), ppm.END]))
    once, some, text, end = (reference_log10(trie, w) for w in (word.encode(), b"some", b"text", ppm.END))
    assert once < -10_000
    got = {x[0]: x[5] for x in rows_of(ppm.score(docs, F.col("doc_id") == 1, class_col=None))}
    own = [0.2 * i / (i + 20) for i in range(5)]
    assert got[2] == pytest.approx(once + math.log10(1 - own[1]) + end, abs=0.01)
    # the second time the document's own counts know the word
    assert got[3] == pytest.approx(some + math.log10(1 - own[1]) + once + math.log10(own[2] / 2) + math.log10(1 - own[3]) + text + math.log10(1 - own[4]) + end, abs=0.02)


def test_ppm_mixture_in_logarithms():
    model = ppm.PpmModel(["", "a"], np.log10([0.2, 0.8]), np.empty(0, np.int64), np.empty((0, 2)))
    costs = ppm.unpacked_costs(ppm.packed_costs(np.array([[-24_000.1239, -24_001.5], [-1.0, -900.0], [-3e7, -1.0]])).tobytes(), 2)
    assert costs[0, 0] == -24_000.124 and costs[2, 0] <= -3e7
    ids, total, run = np.array([0, 1, 2, 0]), Decimal(1), np.log10([0.2, 0.8])
    for i, t in enumerate(ids.tolist()):
        weight = [Decimal(10) ** Decimal(float(x)) for x in run]
        p = sum(w * Decimal(10) ** Decimal(float(c)) for w, c in zip(weight, costs[t])) / sum(weight)
        own = Decimal(0.2) * i / (i + 20)
        total *= own * ids[:i].tolist().count(t) / max(i, 1) + (1 - own) * p
        run = run + costs[t]
    assert model.text_log_prob(costs, 10.0**costs, ids) == pytest.approx(float(total.log10()), abs=1e-6)


# --- 4 quality rules


def brute_measures(text):
    words = words_of_case(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def words_of_case(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_measures_equal_brute_force(spark, odd):
    draw = random.Random(4)
    made = [(i, " ".join(draw.choice("ab") for _ in range(draw.randint(0, 60)))) for i in range(40)]
    for df in (odd, spark.createDataFrame(made, "doc_id long, text string")):
        texts = sorted((r["text"] or "" for r in df.select("text").collect()))
        got = sorted(map(tuple, quality_cascade.judge(df).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()))
        assert got == sorted(brute_measures(t) for t in texts)
    assert quality_cascade.judge(odd.limit(0)).count() == 0


def test_verdict_does_not_depend_on_order(spark, small):
    rows = quality_cascade.measures(spark.read.parquet(f"{small}/documents.parquet"))
    a, b = (rows.select("doc_id", quality_cascade.first_rejection(r).isNull().alias("k")) for r in (quality_cascade.RULES, quality_cascade.RULES[::-1]))
    assert sorted(rows_of(a)) == sorted(rows_of(b))
    found = [quality_cascade.Estimate("a", 1.0, 0.1), quality_cascade.Estimate("b", 0.1, 0.1), quality_cascade.Estimate("c", 0.5, 0.0)]
    rules = [quality_cascade.Rule(n, lambda n: F.lit(False)) for n in "cab"]
    assert [r.name for r in quality_cascade.ordered(rules, found)] == ["b", "a", "c"]


def test_cascade_works_counts_out_where_they_are_needed(spark, odd, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for df in (odd, docs):
        verdict = Counter(tuple(r) for r in quality_cascade.judge(df).where("kept").select("doc_id").collect())
        kept = quality_cascade.keep(df)
        assert kept.columns == df.columns and Counter(tuple(r) for r in kept.select("doc_id").collect()) == verdict
        for order in (list(quality_cascade.BASE + quality_cascade.RULES), list(quality_cascade.BASE + quality_cascade.RULES)[::-1]):
            assert Counter(tuple(r) for r in quality_cascade.keep(df, order=order).select("doc_id").collect()) == verdict
    assert quality_cascade.keep(odd.limit(0)).count() == 0
    cost = {e.name: e.seconds for e in quality_cascade.estimate(docs, quality_cascade.BASE, quality_cascade.worked_out)}
    assert cost["repeated_words"] > cost["few_words"]
    plan = quality_cascade.keep(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, small, tmp_path, name):
    path = str(tmp_path / "out")
    registry.queries()[name](spark, small).write.parquet(path)
    ours, theirs = f"SELECT * FROM '{path}/*.parquet'", registry.oracle_sql()[name]
    columns = ", ".join(r[0] for r in duck.sql(f"DESCRIBE {ours}").fetchall())
    for a, b in ((ours, theirs), (theirs, ours)):
        assert duck.sql(f"SELECT {columns} FROM ({a}) EXCEPT ALL SELECT {columns} FROM ({b})").fetchall() == []


# --- 5 decontamination


def shingle_set(text, n=5):
    w = words_of(text)
    return {b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_containment_equals_brute_force(spark):
    draw = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(draw.choices(vocab, k=draw.choice([3, 5, 9, 20, 40, 90, 200])))) for i in range(60)] + [(60, None), (61, ""), (None, "only null id here now"), (62, "w1")]
    items.append((63, items[5][1]))
    docs = []
    for i in range(150):
        body = draw.choices(vocab, k=draw.choice([0, 2, 30, 300, 5000]))
        if i % 2:
            item = draw.choice(items[:60])[1].split()
            keep = [w for w in item if draw.random() < draw.choice([1.0, 0.97])]
            at = draw.randint(0, len(body))
            body[at:at] = keep
        docs.append((i, " ".join(body)))
    docs += [(150, items[0][1].upper()), (151, None), (152, "w1")]
    sets = {}
    for i, t in items:
        s = frozenset(shingle_set(t))
        if s:
            sets[s] = min((x for x in (sets.get(s), i) if x is not None), default=None)
    want = {i: sorted((k for s, k in sets.items() if len(s & shingle_set(t)) / len(s) >= 0.8), key=str) for i, t in docs}
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for per in (50_000, 20):
        got = {r["doc_id"]: sorted(r["item_ids"], key=str) for r in contamination.contaminated(df, bench, items_per_part=per).collect()}
        assert got == {i: k for i, k in want.items() if k}
    clean = {r["doc_id"] for r in contamination.keep_clean(df, bench).collect()}
    assert clean == {i for i, k in want.items() if not k}


def test_containment_of_item_parts(spark):
    draw = random.Random(4)
    vocab = [f"w{i}" for i in range(900)]
    items = [(100 - i, " ".join(draw.choices(vocab, k=20))) for i in range(40)]
    # equal shingles: other white space, capitals, a word more of a repeated one
    items += [(200 + i, t.upper().replace(" ", " \n\t", 9) + " ") for i, t in items[:15]] + [(300, "a a a a a a a"), (301, "a a a a a a"), (None, "b b b b b b"), (None, "short one"), (302, "Short  One")]
    docs = []
    for i in range(50):
        passages = [t if draw.random() < 0.6 else t.rsplit(" ", 2)[0] for _, t in draw.sample(items[:40], 4)]
        docs.append((draw.choice([i, i, 7, None]), " ".join(passages + draw.choices(vocab, k=9))))
    docs += [docs[0], docs[0], docs[1], (None, "x b b b b b b"), (None, "short one"), (None, None), (7, "a a a a a a y")]
    sets = {}
    for i, t in items:
        s = frozenset(shingle_set(t))
        sets[s] = min((x for x in (sets.get(s), i) if x is not None), default=None)
    want = []
    for i, t in docs:
        own = shingle_set(t)
        hits = sorted(((-len(s & own) / len(s), k is None, k or 0, k) for s, k in sets.items() if len(s & own) / len(s) >= 0.8))
        if hits:
            want.append((i, [h[3] for h in hits], hits[0][3], -hits[0][0]))
    assert len({len(w[1]) for w in want}) > 1 and len({w[3] for w in want}) > 1
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for per in (50_000, 7):
        assert sorted(rows_of(contamination.contaminated(df, bench, items_per_part=per)), key=str) == sorted(want, key=str)


def test_containment_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "same words stand here in this text"), (2, None)], "item_id long, text string")
    assert sorted(r["doc_id"] or 0 for r in contamination.contaminated(odd, bench).collect()) == [0, 1, 1, 2]
    assert contamination.contaminated(odd, bench.limit(0)).count() == 0
    assert contamination.contaminated(odd.limit(0), bench).count() == 0
    assert contamination.keep_clean(odd, bench).columns == odd.columns


# --- 6 line spread


def test_line_spread(spark):
    rows = [(i, f"shared notice\nown line {i}\n shared notice ", f"s{i % 12}") for i in range(24)] + [(50, "few sites", "s1"), (51, "few sites", "s2"), (52, None, "s3"), (53, "shared notice", None)]
    df = spark.createDataFrame([(a, b, c, "x") for a, b, c in rows], "doc_id long, text string, source string, _k1 string")
    got = {r["doc_id"]: (r["text"], r["_n_removed"]) for r in line_spread.clean(df, 10).collect()}
    assert got[0] == ("shared notice\nown line 0", 1) and got[7] == ("own line 7", 2) and got[53] == ("", 1)
    assert got[50] == ("few sites", 0) and got[52] == (None, 0)
    assert line_spread.clean(df.limit(0), 10).count() == 0


def brute_line_spread(rows, min_sites):
    """(id, text, cleaned, lines, removed) of (id, text, site) rows."""
    spaces, found = " \t\n\x0b\f\r", {}
    for i, text, site in rows:
        for at, line in enumerate(text.split("\n") if text is not None else ()):
            if line.strip(spaces):
                found.setdefault(line.strip(spaces), []).append((site, (i is not None, i or 0, at)))
    wide = {line: min(place for _, place in x) for line, x in found.items() if len({site for site, _ in x}) >= min_sites}
    out = []
    for i, text, _ in rows:
        lines = text.split("\n") if text is not None else []
        gone = [wide.get(x.strip(spaces), (i is not None, i or 0, at)) != (i is not None, i or 0, at) for at, x in enumerate(lines)]
        out.append((i, text, None if text is None else "\n".join(x for x, g in zip(lines, gone) if not g), sum(bool(x.strip(spaces)) for x in lines), sum(gone)))
    return out


def test_line_spread_odd_rows(spark, odd):
    more = [(20 + i, f"  shared by many \r\nown {i}\n\nshared by many\nshared by few", f"s{i % 5}") for i in range(9)] + [(None, "shared by many", None), (60, "shared by few", "s1"), (60, "shared by few", "s1"), (None, "a line of null ids", "s1"), (None, "a line of null ids", "s2")]
    extra = [F.lit("x").alias(c) for c in odd.columns[5:]]
    df = odd.unionByName(spark.createDataFrame([(a, b, "en", c, 1) for a, b, c in more], DOCUMENTS).select("*", *extra))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    for least in (2, 4, 6, 7):
        cleaned = line_spread.clean(df, least)
        assert cleaned.columns[: len(df.columns)] == df.columns
        got = [(r["doc_id"], r["text"], r["_n_lines"], r["_n_removed"]) for r in cleaned.collect()]
        assert sorted(map(repr, got)) == sorted(repr((i, clean, n, gone)) for i, _, clean, n, gone in brute_line_spread(rows, least))


# --- 7 html


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><header>Site head</header><nav><ul><li><a href=x>Home</a><li><a>News</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div><article><h1>Head  line</h1><p>First &eacute; paragraph with <b>bold</b> words, that goes on for a while.<p>Short.
<div class="advert">Buy more</div><blockquote>Quoted text of some length stands here &lt;b&gt;.</blockquote><ul><li>item one<li>item two</ul><section class="comments"><p>A reader's comment that is quite long too.</section></article>
<aside>Related things to read</aside><form><label>Mail</label><input></form><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert html_main.main_lines(PAGE) == ["Head line", "First é paragraph with bold words, that goes on for a while.", "Short.", "Quoted text of some length stands here <b>.", "item one", "item two"]
    bare = "<div id=nav-menu><a>a</a><a>b</a></div><div><div><p>" + "Long text. " * 30 + "</p><p>" + "More text. " * 30 + "</p></div></div><div class=footer>end</div>"
    assert [x[:10] for x in html_main.main_lines(bare)] == ["Long text.", "More text."]
    wrapped = "<div class='page with-sidebar'><div class=sidebar>Links and more links</div><article><p>Body of it.</p><div class=comments><article>Nice!</article></div></article></div>"
    assert html_main.main_lines(wrapped) == ["Body of it."]
    assert html_main.main_lines("just words\n here") == ["just words here"]
    assert html_main.main_lines(None) == html_main.main_lines("") == html_main.main_lines("<p></p>") == []
    assert html_main.main_lines("<article><p>cut <b>off") == ["cut off"]


ARTICLE = "<h1>A head</h1><p>Some long article text that goes on and on for a while here.</p><p>More of the text, with many words in it.</p><p>Short.</p>"
ARTICLE_LINES = ["A head", "Some long article text that goes on and on for a while here.", "More of the text, with many words in it.", "Short."]


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><meta charset=u><title>t</title><script>var a='<p>';</script><p>{}",
        "<html><body><form action=x><div class=nav><a>m</a></div><div id=content>{}</div><input></form></body>",
        "<body><ul><li class=ad>buy<li>{}</ul>",
        "<body><table><tr><td class=sidebar>side<td>{}</table>",
        "<body><select><option>a<option>b</select><dl><dt class=ad>x<dd>{}</dl>",
        "<body><div id='social-policy'>{}</div>",
        "<body><article>{}</article><!-- unclosed",
        "<body><article>{}</article><div class='x",
        "<body><div class='cookie-policy'>We use</div><div>{}</div><form><label>Mail</label><p>Sign up now please</p></form>",
        "<article>{}<article class=comment><p>nice post this is my comment</p></article></article>",
        "<body><div><a>one</a></div><div><a>two</a></div><div>{}</div><div><a>foot</a></div>",
    ],
)
def test_main_text_of_loose_markup(page):
    assert html_main.main_lines(page.format(ARTICLE)) == ARTICLE_LINES


def test_main_text_of_several_articles():
    for tag in ("article", "main"):
        assert html_main.main_lines(f"<body><{tag}>{ARTICLE}</{tag}><nav>x</nav><{tag}>{ARTICLE}</{tag}>") == ARTICLE_LINES * 2


def test_main_text_takes_time_in_proportion():
    for tag in ("<div>", "<font>", "<p>", "<li>", "<td>", "<article>", "</x><i>", "<form>"):
        seconds = []
        for n in (10_000, 80_000):
            began = time.process_time()
            assert html_main.main_lines(tag * n + "text") == ["text"]
            seconds.append(time.process_time() - began)
        assert seconds[1] < 24 * max(seconds[0], 0.02)
    long = "<article>" + "<p>some words of a long page</p>" * 60_000 + "</article>"
    assert len(html_main.main_lines(long)) == 60_000


def test_ratios_equal_brute_force():
    lines = html_main.Lines().finish(f"<nav><a>a</a><a>b</a><a>c</a></nav><ul><li><a>d</a><li><a>e</a></ul>{ARTICLE * 3}<footer><a>f</a> g</footer>").lines
    ratio = [math.log(1 + len(x.text) / max(1, x.tags)) for x in lines]
    weight = {d: math.exp(-0.5 * d * d) for d in range(-3, 4)}
    smooth = [sum(w * ratio[min(max(i + d, 0), len(ratio) - 1)] for d, w in weight.items()) / sum(weight.values()) for i in range(len(ratio))]
    low, high = min(smooth), max(smooth)
    for _ in range(30):
        upper = [x for x in smooth if x >= (low + high) / 2]
        lower = [x for x in smooth if x < (low + high) / 2]
        low, high = sum(lower) / len(lower), sum(upper) / len(upper)
    assert html_main.is_content(lines).tolist() == [x >= (low + high) / 2 for x in smooth]
    assert 0 < sum(html_main.is_content(lines)) < len(lines)


def test_extract_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "<article><p>a  b</article>", "y"), (2, "", None)], "page_id long, html string, text string")
    assert sorted(rows_of(html_main.extract(df)), key=str) == sorted([(1, "", 0), (1, "", 0), (None, "a b", 3), (2, "", 0)], key=str)
    assert html_main.extract(df.limit(0)).count() == 0


# --- 8 simhash


def brute_fingerprint(text):
    w = words_of(text)
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(pairs):
    ids, fps = [p[0] for p in pairs], np.array([p[1] for p in pairs], np.uint64)
    label = dict(zip(range(len(ids)), range(len(ids))))
    near = [set(np.flatnonzero(np.bitwise_count(fps ^ f) <= 4)) | {j for j, x in enumerate(ids) if x == ids[i]} for i, f in enumerate(fps)]
    changed = True
    while changed:
        changed = False
        for i, ns in enumerate(near):
            low = min(label[j] for j in ns)
            if low < label[i]:
                label[i], changed = low, True
    groups = {}
    for i, r in label.items():
        groups.setdefault(r, []).append(ids[i])
    return {ids[i]: min(groups[r]) for i, r in label.items()}


def test_simhash_equals_brute_force(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    prints = {i: brute_fingerprint(t) for i, t in docs}
    want = brute_components(list(prints.items()))
    for r in registry.op8_simhash(spark, small).collect():
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]]


def test_anchors_meet_and_large_groups_are_cut(spark):
    draw = np.random.default_rng(2)
    base = draw.integers(0, 1 << 63, 150, dtype=np.uint64) * np.uint64(2)
    values = set(base.tolist())
    for b in base[:60]:
        v = int(b)
        for _ in range(6):
            for bit in draw.choice(64, draw.integers(1, 6), replace=False):
                v ^= 1 << int(bit)
            values.add(v)
    values = sorted(values)
    fps = np.array(values, np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    want = brute_components([(i, int(f)) for i, f in enumerate(fps)])
    for most, split in ((8192, 32768), (3, 2)):
        roots = components.connected_components(simhash_anchor.links(df, most, split))
        found = {r["node"]: r["root"] for r in roots.collect()}
        mine = [found.get(int(x), int(x)) for x in fps.view(np.int64)]
        assert [mine.index(x) for x in mine] == [[want[j] for j in range(len(fps))].index(want[i]) for i in range(len(fps))]


def test_golay_code_covers():
    table, unit = simhash_anchor.golay_cosets()
    weights = np.bitwise_count(table)
    assert table.shape == (2048, 6) and weights[:, 0].max() == 3
    assert all(len(set(r)) == (6 if w == 3 else 1) for r, w in zip(table.tolist(), weights[:, 0]))


def test_split_anchors_hold_every_pair():
    draw = np.random.default_rng(7)
    wider = simhash_anchor.golay_cosets(simhash_anchor.RADIUS + 2)
    for _ in range(300):
        a = int(draw.integers(0, 1 << 63)) * 2 + 1
        b = a
        for bit in draw.choice(64, 4, replace=False):
            b ^= 1 << int(bit)
        fp = np.array([a, b], np.uint64).view(np.int64)
        index, bucket, home = simhash_anchor.anchor_rows(fp)
        deep, below, first = simhash_anchor.split_rows(fp[index], bucket, home, wider)
        rows = set(zip(index[deep].tolist(), below.tolist()))
        assert any((1, x) in rows for i, x, h in zip(index[deep].tolist(), below.tolist(), first.tolist()) if h and i == 0)
    # a row goes to 22 anchors on average in each of two chunks
    assert len(deep) < 2 * 40 * len(index)


def test_simhash_odd_rows(spark, odd):
    got = rows_of(simhash_anchor.components(odd))
    assert len(got) == odd.count()
    by = {}
    for i, fp, c in got:
        by.setdefault(i, set()).add((fp, c))
    assert {c for _, c in by[None]} == {None} and by[1] == by[2] and {c for _, c in by[5]} == {3} and by[4] == {(0, 3)}
    kept = simhash_anchor.keep_first(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == [1, 3, 6, 7, 8, 9] and ids.count(None) == 2
    assert simhash_anchor.components(odd.limit(0)).count() == 0


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (None, 3), (200, 201), (201, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(df).collect()}
    assert got == {i: 0 for i in range(41)} | {200: 200, 201: 200}
    assert components.connected_components(df.limit(0)).count() == 0


def test_hub_of_a_star(spark):
    edges = [(i, 0) for i in range(1, 3000)] + [(5000 + i, 2999 - i) for i in range(300)] + [(9001, 9000)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(df).collect()}
    assert got == {i: 0 for i in [*range(3000), *range(5000, 5300)]} | {9000: 9000, 9001: 9000}


def test_hub_of_a_star_is_split(spark):
    """The hub's rows of a round's join are dealt to several tasks by adaptive execution."""
    settings = {f"spark.sql.{k}": v for k, v in {"autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "-1", "adaptive.skewJoin.skewedPartitionFactor": "1.5", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "adaptive.advisoryPartitionSizeInBytes": "64k"}.items()}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        edges = spark.range(1, 600_000, 1, 8).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
        step = components._large_star(edges)
        assert step.count() == 599_999
        step.collect()
        assert "skew=true" in step._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_scratch_is_removed_and_must_be_shared(spark, tmp_path):
    from pathlib import Path

    mark = common.scratch_mark()
    made, kept = common.materialize(spark.range(3), "a"), common.materialize(spark.range(4), "b")
    common.clear_scratch(mark, keep=(kept,))
    assert not Path(made._scratch_path.removeprefix("file:")).exists() and kept.count() == 4
    common.discard(kept)
    assert common.scratch_mark() == mark

    class Cluster:
        conf = {}
        sparkContext = type("Context", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="share"):
        common.shared_folder(Cluster)


# --- 9 WARC


def test_url_keys():
    assert warc_index.url_key("HTTP://WWW.Example.com:80/A?q=1#top") == "com,example)/a?q=1"
    assert warc_index.url_key("https://blog.example.org:8443") == "org,example,blog:8443)/"
    assert warc_index.url_key(None) == "" and warc_index.url_key("no url") == "no url" and warc_index.url_key("http://[bad") == "http://[bad"


def test_warc_round_trip_and_lookup(spark, small, tmp_path):
    big = "é" * 800
    rows = [(1, "http://a.example.com/x", big), (5, "http://b.example.com/\r\ny", big), (3, "http://a.example.com/x", "small"), (4, None, None), (6, "http://c.example.com", "small"), (None, "http://d.example.com", big), (7, 'http://q.example.com/"', "t\r\n\r\nWARC/1.1")]
    df = spark.createDataFrame([(a, b, c, "x") for a, b, c in rows], "page_id long, url string, html string, key string")
    got = {r["page_id"]: r for r in warc_index.round_trip(df, with_block=True).collect()}
    assert len(got) == 7 and (got[1]["record_type"], got[1]["refers_to"], got[1]["payload_bytes"]) == ("revisit", 5, 1600)
    assert got[5]["record_type"] == "response" and bytes(got[5]["block"]) == big.encode() and got[5]["url"] == "http://b.example.com/\r\ny"
    assert got[3]["record_type"] == got[6]["record_type"] == "response" and got[4]["payload_bytes"] == 0
    assert bytes(got[7]["block"]) == b"t\r\n\r\nWARC/1.1" and got[1]["payload_digest"] == hashlib.sha1(big.encode()).hexdigest()
    base = str(tmp_path / "w")
    warc_index.write_archives(df, f"{base}/a", records_per_file=2)
    warc_index.build_index(spark, f"{base}/a", f"{base}/i", lines_per_block=2)
    hits = warc_index.lookup(spark, ["http://A.example.com/x", "http://c.example.com/"], f"{base}/a", f"{base}/i")
    assert sorted(r["page_id"] for r in hits.collect()) == [1, 3, 6]
    assert warc_index.lookup(spark, ["http://zzz.example.com"], f"{base}/a", f"{base}/i").count() == 0
    places = warc_index.locate(spark, warc_index.with_key(df), f"{base}/i")
    whole = warc_index._cut_whole(spark, places, f"{base}/a", True)
    assert sorted(map(repr, rows_of(whole))) == sorted(map(repr, rows_of(warc_index.read_ranges(spark, places, f"{base}/a"))))
    import gzip
    from pathlib import Path

    raw = b"".join(gzip.decompress(p.read_bytes()) for p in Path(f"{base}/a").glob("part-*"))
    assert raw.count(b"WARC-Record-ID") == 7
    assert warc_index.round_trip(df.limit(0)).count() == 0


def test_warc_hot_url_and_repeated_rows(spark, tmp_path):
    # one URL with 20,000 captures, one null URL with as many, and rows repeated whole
    n = 20_000
    rows = [(i, "http://hot.example.com/", f"page {i}") for i in range(n)] + [(n + i, None, "x") for i in range(n)] + [(-1, "http://b.example.com", "again")] * 50 + [(None, None, "none")] * 40
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    base = str(tmp_path / "w")
    warc_index.write_archives(df, f"{base}/a")
    warc_index.build_index(spark, f"{base}/a", f"{base}/i", lines_per_block=500)
    wanted = warc_index.with_key(df)
    assert warc_index.locate(spark, wanted, f"{base}/i").count() == len(rows)
    entries = sorted((warc_index._goal(r["first_key"], r["first_id"]), warc_index._goal(r["last_key"], r["last_id"]), r["block"]) for r in spark.read.parquet(f"{base}/i/directory").collect())
    goals = {warc_index._goal(r["key"], r["page_id"]) for r in wanted.collect()}
    assert len(entries) > 70 and sum(len(x) for x in warc_index.find_blocks(sorted(goals), *map(list, zip(*entries)))) <= len(goals) + 4
    got = warc_index.round_trip(df)
    assert got.count() == len(rows) and got.where("page_id = -1").count() == 50 and got.where("page_id is null").count() == 40


def test_spans_of_ranges():
    assert warc_index.spans([(0, 10), (20, 5), (200_000, 7), (200_007, 5 << 20)]) == [[(0, 10), (20, 5)], [(200_000, 7)], [(200_007, 5 << 20)]]
    assert warc_index.spans([]) == []


# --- 10 BPE


@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBpe(*registry.byte_bpe_files())


def test_encoding_equals_tiktoken(spark, small, coder):
    import tiktoken

    path, pattern = registry.byte_bpe_files()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(3)
    texts = ["", " ", "\n\n  x", "it's we'll 12345 ½ <|endoftext|>", "naïve 😀👍🏽 日本語  \x1c\x85   end", "a" * 5000, "\x00�"]
    texts += ["".join(chr(draw.choice([*range(32, 127), *range(160, 900), 0x4E00, 0x1F600, 10, 9])) for _ in range(200)) for _ in range(60)]
    texts += [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    for text, packed in zip(texts, coder.encode_packed(texts)):
        ids = np.frombuffer(packed, "<u4").tolist()
        assert ids == other.encode_ordinary(text)
        assert coder.decode(ids) == text


def test_offsets_of_split_characters(coder):
    text = "a 👍🏽é"
    ids = np.frombuffer(coder.encode_packed([text])[0], "<u4").tolist()
    spans = coder.offsets(text, ids)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a < b for a, b in spans)
    emoji = np.frombuffer(coder.encode_packed(["\U0001F44D"])[0], "<u4").tolist()
    assert coder.decode(emoji) == "\U0001F44D" and (len(emoji) == 1 or "\ufffd" in coder.decode(emoji[:-1]))


def test_bpe_odd_rows(spark, odd):
    files = registry.byte_bpe_files()
    coded = bpe.encode(odd, *files, with_offsets=True)
    got = coded.collect()
    assert len(got) == odd.count() and {r["n_tokens"] for r in got if r["doc_id"] in (3, 4)} == {0}
    back = sorted(rows_of(bpe.decode(coded, *files)), key=str)
    assert back == sorted([(r["doc_id"], r["text"] or "") for r in odd.collect()], key=str)
    assert bpe.encode(odd.limit(0), *files).count() == 0


# --- pipeline


def test_pipeline_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    identified = stage["language_id"](spark, docs, small)
    model = registry.fit_language_model(docs)
    score = model.scorer()
    kept = [r for r in docs.collect() if not score(r["text"])[3]]
    assert sorted(rows_of(identified)) == sorted(map(tuple, kept))
    spread, heads = {}, {}
    lines = [(r["doc_id"], i, x.strip(" \t\n\x0b\x0c\r"), r["source"]) for r in kept for i, x in enumerate(r["text"].split("\n"))]
    for doc, i, line, site in lines:
        if line:
            spread.setdefault(line, set()).add(site)
            heads[line] = min(heads.get(line, (doc, i)), (doc, i))
    gone = {(d, i) for d, i, line, _ in lines if line and len(spread[line]) >= line_spread.MIN_SITES and heads[line] != (d, i)}
    cleaned = {r["doc_id"]: "\n".join(x for i, x in enumerate(r["text"].split("\n")) if (r["doc_id"], i) not in gone) for r in kept}
    groups = brute_components([(i, brute_fingerprint(t)) for i, t in cleaned.items()])
    firsts = {i: t for i, t in cleaned.items() if groups[i] == i}
    items = [shingle_set(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = {i: t for i, t in firsts.items() if not any(len(s & shingle_set(t)) >= 0.8 * len(s) for s in items)}
    got = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, small).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in clean.items()}


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, docs, small).columns == docs.columns, name
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), small).count() == 0


def test_a_costlier_rule_is_found_and_moves_behind(spark, small):
    """Two rules of the same verdict, one of which works much more, in whatever order they are timed."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    cheap = quality_cascade.Rule("z_cheap", lambda n: F.length("text") > 3000)
    slow = quality_cascade.Rule("a_slow", lambda n: (F.length(F.regexp_replace("text", "[aeiou]+[^aeiou]", "")) >= 0) & (F.length("text") > 3000))
    for rules in ((cheap, slow), (slow, cheap)):
        found = {e.name: e for e in quality_cascade.estimate(docs, rules)}
        assert found["a_slow"].rejected == found["z_cheap"].rejected > 0
        assert found["a_slow"].seconds > 3 * found["z_cheap"].seconds
        assert [r.name for r in quality_cascade.ordered(rules, list(found.values()))] == ["z_cheap", "a_slow"]
