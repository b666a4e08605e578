"""Operators on conversations and on two tokenizers against brute-force versions."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from talusgrid.llm import chat_tree, token_align, turn_repair
from talusgrid.llm.common import table

CONVS = "conv_id long, turn long, role string, text string"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WRITES = {0: "user", 1: "user", 2: "assistant", 3: "user"}


def damaged(conv, rows):
    out = []
    spell = lambda x: " " if x is None else str(x)
    for r in rows:
        fault = zlib.crc32(f"{spell(conv)}:{spell(r.turn)}".encode()) % 20
        role, text = spell(r.role), spell(r.text)
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(r.turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


def mended(conv, rows):
    """One search from the start over (cost, audit), which keeps the repaired rows."""
    out = damaged(conv, rows)
    seen, faults = set(), []
    for _, role, text in out:
        words = text.rstrip(" \t\n\x0b\f\r")
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, 0, ())], {}
    while heap:
        cost, audit, i, q, kept = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done[i, q] = (cost, audit, kept)
        role = WRITES[q]
        to = NEXT[q, role[0]]
        heapq.heappush(heap, (cost + 3, audit + "I", i, to, (*kept, (role, ""))))
        if i == len(out):
            continue
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q, kept))
        if faults[i] in ("", "truncated"):
            more = 3 if faults[i] else 0
            heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, to, (*kept, (role, out[i][2]))))
            if (q, out[i][1][:1]) in NEXT:
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, NEXT[q, out[i][1][0]], (*kept, out[i][1:])))
    cost, audit, kept = min(done[len(out), q] for q in (0, 3))
    turns = [t for t, _, _ in out if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def by_conversation(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r.conv_id].append(r)
    return out


def odd_conversations(spark, seed=5, extra=True):
    rnd = random.Random(seed)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "tool", "", None, "assistant"]), rnd.choice(["Yes.", "No", "", " \t", None, "What?", "Same."])) for c in range(60) for t in range(rnd.randint(1, 11))]
    if extra:
        rows += [(None, None, "user", "Hi."), (None, 0, "assistant", "Hello."), (99, None, "user", "Hi."), (99, 0, "user", "Hi."), (99, 0, "user", "Hi."), (98, 5, "user", "x" * 200_000), (98, 9, "assistant", "y.")]
    return spark.createDataFrame(rows, CONVS)


def test_both_searches_find_the_least_audit():
    rnd = random.Random(1)
    for _ in range(3000):
        codes = bytes(rnd.choice([0, 1, 2, 1, 2, 3]) + rnd.choice([0, 0, 0, 4, 8, 16]) for _ in range(rnd.randint(0, 10)))
        heap, done = [(0, "", 0, 0)], {}
        while heap:
            cost, audit, i, q = heapq.heappop(heap)
            if (i, q) not in done:
                done[i, q] = (cost, audit)
                for letter, more, j, r in turn_repair._steps(codes, i, q):
                    heapq.heappush(heap, (cost + more, audit + letter, j, r))
        assert turn_repair.cheapest(codes) == min(done[len(codes), 0], done[len(codes), 3])


def test_repair_equals_one_search_that_keeps_all(spark, small):
    for convs in (table(spark, small, "conversations"), odd_conversations(spark)):
        got = {r.conv_id: tuple(r) for r in turn_repair.repair(convs).collect()}
        assert got == {k: mended(k, v) for k, v in by_conversation(convs.collect()).items()}


def test_repair_of_nothing_and_of_extra_columns(spark):
    convs = spark.createDataFrame([(3, 1, "user", "Hi.", "x", 1)], CONVS + ", audit string, gone int")
    assert turn_repair.repair(convs).count() == 1
    assert turn_repair.repair(convs.limit(0)).collect() == []


def test_a_long_conversation_streams(spark):
    """Texts of several batches in one conversation; its decision is one row."""
    convs = spark.range(12_000).selectExpr("7L conv_id", "id turn", "IF(id % 2 = 0, 'user', 'assistant') role", "concat('Turn ', id, ' says so.') text")
    (row,) = turn_repair.repair(convs).collect()
    assert tuple(row) == mended(7, convs.collect())


def chat_digests(conv, rows):
    rows = sorted(rows, key=lambda r: (r.turn is not None, r.turn or 0))
    text = [(r.role or "", r.text or "") for r in rows]
    said = "".join(t for r, t in text if r == "assistant")
    form = sum(len(f"<|im_start|>{chat_tree.escape_role(r)}\n{chat_tree.escape(t)}<|im_end|>\n") for r, t in text)
    return (conv, len(text), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in text).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), form)


def shared_conversations(spark):
    """Few first turns, control strings, copies, prefixes of each other."""
    rnd = random.Random(3)
    rows = [(c, t, ["user", "assistant"][t % 2], ["same", "\\ <| x", "b <\\| \n\\n"][rnd.randint(0, 2) if t > 1 else 0]) for c in range(300) for t in range(rnd.randint(1, 7))]
    rows += [(None, None, None, None), (None, 1, None, None), (900, 0, "as\nsist<|", "t"), (900, 1, "assistant", "é<|im_end|>\\"), (901, 0, "assistant", "z" * 100_000)]
    return spark.createDataFrame(rows, CONVS)


@pytest.mark.parametrize("pack_tokens", [300, 4 << 20])
def test_chat_stream_reads_back(spark, pack_tokens):
    convs = chat_tree.with_probe(shared_conversations(spark))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        packed = chat_tree.pack(convs)
        got = {r.conv_id: tuple(r) for r in chat_tree.read_back(packed, pack_tokens).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {k: chat_digests(k, v) for k, v in by_conversation(convs.collect()).items()}
    turns = packed.turns.orderBy("at").collect()
    at = 0
    for t in turns:
        assert t.at == at and len(t.form) == t.n and sum(i["to"] - i["from"] for i in t.attends) == t.pos
        at += t.n
    prefixes = {tuple((r.role, r.text) for r in sorted(v, key=lambda r: (r.turn is not None, r.turn or 0))[: k + 1]) for v in by_conversation(convs.collect()).values() for k in range(len(v))}
    assert len(turns) == len(prefixes)


def test_ancestors_are_what_a_turn_attends_to(spark):
    convs = shared_conversations(spark)
    stream = "".join(t.form for t in chat_tree.pack(convs).turns.orderBy("at").collect())
    packed = chat_tree.pack(convs)
    paths = {}
    for t in packed.turns.collect():
        paths[t.at + t.n] = "".join(stream[i["from"] : i["to"]] for i in t.attends) + t.form
    for r in packed.ends.join(convs.groupBy("conv_id").agg({"turn": "count"}), "conv_id").collect():
        rows = sorted((x for x in convs.where(f"conv_id = {r.conv_id}").collect()), key=lambda x: x.turn) if r.conv_id in (0, 7, 900) else None
        if rows:
            assert paths[r.end] == "".join(f"<|im_start|>{chat_tree.escape_role(x.role)}\n{chat_tree.escape(x.text)}<|im_end|>\n" for x in rows)


def test_chat_of_nothing(spark):
    convs = spark.createDataFrame([], CONVS + ", end int")
    assert [r.n_turns for r in chat_tree.read_back(chat_tree.pack(chat_tree.with_probe(convs))).collect()] == [2]


def files():
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_library():
    """The file as its own library reads it."""
    library = Tokenizer.from_file(files()[0])
    library.encode_special_tokens = True
    return library


def aligned_whole(rows):
    """Whole texts by the libraries, sets of ends, counts in one dictionary."""
    tool = token_align.Aligner(*files())
    library = byte_library()
    counts, per = collections.Counter(), []
    for key, text in rows:
        a = library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tool.b.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if b"".join(tool.a_bytes[i] for i in a) != raw or b"".join(tool.b_bytes[i] for i in b) != raw:
            per.append((key, [], [], [], ""))
            continue
        a_ends, b_ends = (np.cumsum([len(t[i]) for i in ids]).tolist() for ids, t in ((a, tool.a_bytes), (b, tool.b_bytes)))
        groups, links, p, q = [], [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            x, y = a_ends.index(end), b_ends.index(end)
            groups.append(",".join(map(str, a[p : x + 1])) + "|" + ",".join(map(str, b[q : y + 1])))
            links.append((a[x], b[y]))
            p, q = x + 1, y + 1
        counts.update(links)
        per.append((key, a, b, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = collections.Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return sorted((k, len(a), len(b), len(links), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), d) for k, a, b, links, d in per)


ODD_TEXTS = [None, "", "a  b", "a ", "  ", "a\n b\t c ", "x▁y", "<|endoftext|> <s> <0x0A>", "日本語 テキスト", " lead", "tail \n", "a  b", "\x00", "é" * 50, "a\x1c b", "a b" * 3000, "don't I'll ’s 12 3456  \r\n x", "　 a  b", "w" * 30_000]


def test_alignment_equals_whole_texts(spark, small):
    texts = [(r.doc_id, r.text) for r in table(spark, small, "documents").limit(60).collect()] + [(10**6 + i, t) for i, t in enumerate(ODD_TEXTS)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in texts], "doc_id long, text string, n_a int").repartition(3)
    for batch_bytes in (20_000, 16 << 20):
        got = sorted(map(tuple, token_align.align(docs, *files(), batch_bytes=batch_bytes).collect()))
        assert got == aligned_whole(texts)
    assert token_align.align(docs.limit(0), *files()).collect() == []


def test_words_are_safe_cuts():
    """Words that are encoded together and cut apart give the tokens of the whole text."""
    tool, library = token_align.Aligner(*files()), byte_library()
    rnd = random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "é", "1", "23", "<|", "。", "\u3000", "\x1d", "_", "!?", "<|endoftext|>"]
    for _ in range(400):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14)))
        cut = token_align.words(text)
        assert " ".join(cut) == text
        assert library.encode(" " + text, add_special_tokens=False).ids == [int(i) for ids in tool.encode_a(cut) for i in ids]
        assert tool.b.encode(text) == [i for w in cut for i in tool.b.encode(w)], repr(text)


def test_pieces_of_the_merge_path_are_stitched():
    rnd = np.random.default_rng(4)
    for piece in (1, 2, 3, 7, 64):
        for n, m in ((0, 5), (5, 0), (40, 40), (200, 30)):
            a, b = (np.sort(rnd.choice(300, k, replace=False)).astype(np.int64) for k in (n, m))
            x, y = token_align.overlaps(a, b, piece)
            assert a[x].tolist() == b[y].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
            i, j = token_align.merge_path(a, b, np.arange(0, n + m + 1, piece))
            assert (np.diff(i + j) == piece).all()
