"""Queries that SQL does not express, against plain Python over the same rows."""

import re
from collections import Counter

import numpy as np
import pytest

from talusgrid.operators import providers
from talusgrid.plans import registry


@pytest.fixture(scope="module")
def run(spark, small):
    return lambda name: [r.asDict() for r in registry.queries()[name](spark, small).collect()]


@pytest.fixture(scope="module")
def table(spark, small):
    return lambda name: [r.asDict() for r in spark.read.parquet(f"{small}/{name}.parquet").collect()]


def dialogues(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        out.setdefault(r["conv_id"], []).append(r)
    return out


def test_chunk_pack(run, table):
    want = []
    for key, turns in dialogues(table("conversations")).items():
        chunks, now = [], []
        for r in turns:
            size = -(-len(f"{r['role']}: {r['text']}") // 4)
            if now and sum(n for _, n in now) + size > 300:
                chunks.append(now)
                # the next chunk begins with as many of the last turns, but the first, as reach 40
                carried = []
                while len(carried) < len(now) - 1 and sum(n for _, n in carried) < 40:
                    carried.insert(0, now[-1 - len(carried)])
                now = carried
            now = [*now, (r["turn"], size)]
        want += [(key, i, c[0][0], c[-1][0], sum(n for _, n in c)) for i, c in enumerate([*chunks, now])]
    assert sorted((r["conv_id"], r["chunk"], r["first"], r["last"], r["tokens"]) for r in run("chunk_pack")) == sorted(want)


def test_marked_passages(run, table):
    want = []
    for key, turns in dialogues(table("conversations")).items():
        marks = [bool(re.search(r"\b(nation|tion)\b", r["text"])) for r in turns]
        nouns = [sum(w in r["text"].lower() for w in ("heed", "ing", "ble")) for r in turns]
        start = 0
        while start < len(turns):
            window = range(start, min(start + 4, len(turns)))
            if any(marks[i] for i in window) and sum(nouns[i] for i in window) >= 2:
                scoring = [i for i in window if marks[i] or nouns[i]]
                first, last = max(scoring[0] - 1, 0), min(scoring[-1] + 1, len(turns) - 1)
                if last > first:
                    want.append((key, turns[first]["turn"], turns[last]["turn"]))
                start = scoring[-1] + 2
            else:
                start += 1
    assert sorted((r["conv_id"], r["first"], r["last"]) for r in run("marked_passages")) == sorted(want)


def test_rate_limit_fold(run, table):
    by = {}
    for r in sorted(table("events"), key=lambda r: (r["user_id"], r["ts"], r["event_id"])):
        by.setdefault(r["user_id"], []).append(r)
    want = {}
    for events in by.values():
        passed = []
        for e in events:
            at = e["ts"].timestamp()
            want[e["event_id"]] = all(sum(at - t < w for t in passed) < n for w, n in ((600, 1), (86_400, 20)))
            if want[e["event_id"]]:
                passed.append(at)
    assert {r["event_id"]: r["allowed"] for r in run("rate_limit_fold")} == want


def test_keyword_excerpt(run, table):
    texts = {r["doc_id"]: r["text"] for r in table("documents")}
    for r in run("keyword_excerpt"):
        text = texts[r["doc_id"]]
        if len(text) <= 300:
            assert r["excerpt"] == text
            continue
        spots = sorted({m.start() + 1 for w in ("nation", "heed", "ing") for m in re.finditer(w, text.lower())})
        room = len(text) - 300 + 1
        starts = [min(room, max(1, p - 100)) for p in spots]
        best = min(starts, key=lambda s: (-sum(s <= p < s + 300 for p in spots), s), default=1)
        body = text[best - 1 : best + 299]
        assert r["excerpt"] == ("…" if best > 1 else "") + body + ("…" if best + 299 < len(text) else "")


def test_query_terms_and_phrases(run, table):
    stop = set("the and of to in is it that for was with are this from what which who how".split())
    texts = {r["item_id"]: r["text"] for r in table("benchmark")}
    for r in run("query_term_lists"):
        kept = re.sub(r"[^a-z0-9\s'-]", "", texts[r["item_id"]].lower())
        assert r["terms"] == list(dict.fromkeys(w for w in kept.split() if len(w) >= 3 and w not in stop))
        words = texts[r["item_id"]].split()
        runs = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
        assert r["phrases"] == list(dict.fromkeys(p for p in runs if re.search(r"\s\S*[A-Z0-9]", p)))[:5]


def test_synthetic_cases(run, table):
    texts = {r["doc_id"]: r["text"] for r in table("documents")}
    got = run("synthetic_cases")
    assert len(got) == 50 == len({r["name"] for r in got})
    for r in got:
        phrase = r["question"].removeprefix("Who said: ")
        assert phrase in " ".join(texts[r["doc_id"]].split()) and re.search(r"\s\S*[A-Z0-9]", phrase) and len(phrase.split()) == 4


def test_hashed_embedding_neighbours(run, table):
    embed = providers.hashed_embedder()
    docs, items = table("documents"), table("benchmark")
    a, b = embed([r["text"] for r in docs]).astype(np.float64), embed([r["text"] for r in items]).astype(np.float64)
    norm = np.linalg.norm(b, axis=1)[:, None] * np.linalg.norm(a, axis=1)[None, :]
    score = np.round(np.divide(b @ a.T, norm, out=np.full(norm.shape, -2.0), where=norm > 0), 6)
    want = Counter()
    for i, item in enumerate(items):
        for j in sorted(range(len(docs)), key=lambda j: (-score[i, j], docs[j]["doc_id"]))[:3]:
            want[item["item_id"], docs[j]["doc_id"]] += 1
    assert Counter((r["query_id"], r["id"]) for r in run("hashed_embedding_neighbours")) == want
