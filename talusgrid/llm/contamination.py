"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of five-word shingles: class U holds the
items with more than U/2 and at most U shingles, U a power of two.  Documents of
any length are cut into runs of U shingles; every two neighbouring runs are one
window of the class, so that a passage with an item's shingles lies in one
window whose size is near the item's.  Items and windows have MinHash
signatures of ``HASHES`` values (a longer class's run is the minimum of two
shorter ones), and one equal value makes a pair a candidate: an item of which
80 % stands in a window is missed with a chance of about one in a million.  Items of
up to half of the least class have all their shingles as their signature, and
are looked up with every shingle of a document.  A candidate counts if the document holds at least ``min_containment`` of the
item's distinct shingles, compared as text.  Documents are only scanned:
nothing of their texts is shuffled.

The index of items is broadcast in parts of at most ``items_per_part`` items,
so its size is bounded whatever the benchmark's; each part scans the documents,
and the hits of several parts meet by id and a 128-bit hash of the text.

Defined results: words are runs of anything but ASCII white space, with A-Z in
lower case.  A text with one to four words is one shingle, equal only to the
same short text; items without words (null, empty, blank) match nothing, and
such documents hold nothing.  Items with equal shingle sets are one item, named
by the smallest id; a null id counts as the largest.  Repeated rows are judged
alike; other columns are never read.
"""

from __future__ import annotations

import string
from dataclasses import dataclass, field
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import SPACE_RUN, pieces, text_bytes

SHINGLE = 5
HASHES = 64
LEAST_CLASS = 16
#: The class of items too short for windows of ``LEAST_CLASS`` runs.
SMALL = 0
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _multipliers(count: int) -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_A = _multipliers(HASHES)
_PLACE = _multipliers(SHINGLE)


def shingle_texts(text: bytes) -> list[bytes]:
    """The text's shingles as words joined by a space."""
    words = text.lower().split()
    n = len(words)
    return [b" ".join(words[i : i + SHINGLE]) for i in range(max(1, n - SHINGLE + 1))] if n else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit shingle hashes of all texts in order, number of shingles of each)."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    b = _LOWER[raw]
    space = _SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    n_words = np.diff(np.concatenate([[0], np.searchsorted(starts, text_ends)]))
    # a word's hash is its polynomial, taken from running sums and moved to exponent 0
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(b), _R)]))
    run = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[:-1])])
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(b), _R_INVERSE)]))
    word = _mix((run[ends] - run[starts]) * back[starts])
    count = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, np.minimum(n_words, 1))
    first = np.cumsum(n_words) - n_words
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    left = np.repeat(np.minimum(n_words, SHINGLE), count)
    out = left.astype(np.uint64)
    padded = np.concatenate([word, np.zeros(SHINGLE, np.uint64)])
    for k in range(SHINGLE):
        out += np.where(left > k, padded[at + k] * _PLACE[k], np.uint64(0))
    return _mix(out), count


@dataclass
class ItemIndex:
    """Signatures of one part of the items, by size class."""

    ids: list
    shingles: list[frozenset]
    classes: dict[int, list[int]] = field(default_factory=dict)
    signatures: dict[int, np.ndarray] = field(default_factory=dict)

    @classmethod
    def build(cls, items: list[tuple[object, bytes]]) -> ItemIndex:
        by: dict[frozenset, object] = {}
        for key, text in items:
            s = frozenset(shingle_texts(text))
            if s and (s not in by or (key is not None and (by[s] is None or key < by[s]))):
                by[s] = key
        index = cls(list(by.values()), list(by))
        for i, s in enumerate(index.shingles):
            size = SMALL if len(s) <= LEAST_CLASS // 2 else LEAST_CLASS
            while size and size < len(s):
                size *= 2
            index.classes.setdefault(size, []).append(i)
        for size, members in index.classes.items():
            if size == SMALL:
                continue
            rows = []
            for i in members:
                h, _ = shingle_hashes([x for x in index.shingles[i]])
                rows.append((h[:, None] * _A[None, :]).min(0))
            index.signatures[size] = np.array(rows)
        return index

    def lookup(self):
        """Per class: a bit map for each hash over mixed values, the sorted values, and their items."""
        tables = {}
        if SMALL in self.classes:
            pairs = [(h, i) for i in self.classes[SMALL] for h in shingle_hashes(sorted(self.shingles[i]))[0].tolist()]
            values, items = np.array([h for h, _ in pairs], np.uint64), np.array([i for _, i in pairs])
            bits = min(24, max(12, len(pairs).bit_length() + 8))
            seen = np.zeros(1 << bits, bool)
            seen[values >> np.uint64(64 - bits)] = True
            order = np.argsort(values)
            tables[SMALL] = (bits, seen, values[order], items[order])
        for size, rows in self.signatures.items():
            bits = min(24, max(12, int(len(rows)).bit_length() + 8))
            maps = np.zeros((HASHES, 1 << bits), bool)
            # minima are small numbers, so their own upper bits would hardly differ
            maps[np.arange(HASHES)[None, :], (rows * _MIX) >> np.uint64(64 - bits)] = True
            order = np.argsort(rows, axis=0)
            tables[size] = (bits, maps, np.ascontiguousarray(np.take_along_axis(rows, order, 0).T), np.asarray(self.classes[size])[order].T)
        return tables

    def candidates(self, h: np.ndarray, count: np.ndarray, tables) -> set[tuple[int, int]]:
        """(text, item) pairs with an equal MinHash value in a window of the item's class."""
        found: set[tuple[int, int]] = set()
        if not len(h) or not tables:
            return found
        if SMALL in tables:
            bits, seen, values, items = tables[SMALL]
            w = np.flatnonzero(seen[h >> np.uint64(64 - bits)])
            near, after = (np.searchsorted(values, h[w], side) for side in ("left", "right"))
            owners = np.searchsorted(np.cumsum(count), w, "right")
            for i in np.flatnonzero(after > near):
                found.update((int(owners[i]), int(x)) for x in items[near[i] : after[i]])
            if len(tables) == 1:
                return found
        texts = np.flatnonzero(count)
        count = count[texts]
        first = np.cumsum(count) - count
        runs = -(-count // LEAST_CLASS)
        owner = np.repeat(np.arange(len(texts)), runs)
        begin = first[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)) * LEAST_CLASS
        # one row for each place in a run, a run that is cut short repeats its text's last shingle
        final = (first + count - 1)[owner]
        placed = np.stack([h[np.minimum(begin + j, final)] for j in range(LEAST_CLASS)])
        low = []
        for a in _A:
            least = placed[0] * a
            for row in placed[1:]:
                np.minimum(least, row * a, out=least)
            low.append(least)
        size = LEAST_CLASS
        while True:
            if size in tables:
                bits, maps, values, items = tables[size]
                pair = np.flatnonzero(owner[:-1] == owner[1:])
                alone = np.flatnonzero(np.bincount(owner, minlength=len(texts))[owner] == 1)
                for k in range(HASHES):
                    both = np.minimum(low[k][pair], low[k][pair + 1])
                    for window, who in ((both, owner[pair]), (low[k][alone], owner[alone])):
                        w = np.flatnonzero(maps[k][(window * _MIX) >> np.uint64(64 - bits)])
                        if not len(w):
                            continue
                        near, after = (np.searchsorted(values[k], window[w], side) for side in ("left", "right"))
                        for i in np.flatnonzero(after > near):
                            text = int(texts[who[w[i]]])
                            found.update((text, int(x)) for x in items[k, near[i] : after[i]])
            if size >= max(tables):
                return found
            size *= 2
            # two neighbouring runs of a text become one
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            lead = np.flatnonzero(place % 2 == 0)
            mate = np.minimum(lead + 1, len(owner) - 1)
            has = owner[mate] == owner[lead]
            low = [np.where(has, np.minimum(x[lead], x[mate]), x[lead]) for x in low]
            owner = owner[lead]

    def matches(self, texts: list[bytes], min_containment: float, tables) -> list[list[tuple[object, float]]]:
        """For each text the (item id, containment) of the items it holds, best first, then by id."""
        h, count = shingle_hashes(texts) if texts else (np.empty(0, np.uint64), np.empty(0, np.int64))
        by: dict[int, list[int]] = {}
        for t, i in self.candidates(h, count, tables):
            by.setdefault(t, []).append(i)
        out: list[list[tuple[object, float]]] = [[] for _ in texts]
        for t, items in by.items():
            own = set(shingle_texts(texts[t]))
            for i in items:
                share = len(self.shingles[i] & own) / len(self.shingles[i])
                if share >= min_containment:
                    out[t].append((self.ids[i], share))
            out[t].sort(key=lambda x: (-x[1], x[0] is None, x[0]))
        return out


def _shingle_set(text_col: str) -> Column:
    """The sorted set of :func:`shingle_texts`."""
    lower = F.translate(text_col, string.ascii_uppercase, string.ascii_lowercase)
    words = F.filter(F.split(lower, SPACE_RUN), lambda x: x != "")
    # bound once, or each shingle would split the text again
    at = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - SHINGLE + 1, F.lit(1)))
    sets = F.transform(F.array(words), lambda w: F.array_sort(F.array_distinct(F.transform(at(w), lambda i: F.array_join(F.slice(w, i, SHINGLE), " ")))))
    return F.element_at(sets, 1)


def item_parts(items: DataFrame, id_col: str = "item_id", text_col: str = "text", items_per_part: int = 50_000):
    """Indexes over hash parts of the items, each small enough to broadcast."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    parts = max(1, -(-rows.count() // items_per_part))
    for part in range(parts):
        # items of equal shingles share a part, so that they become one item
        mine = rows.where(F.pmod(F.xxhash64(_shingle_set("text")), F.lit(parts)) == part).collect() if parts > 1 else rows.collect()
        yield ItemIndex.build([(r["id"], r["text"].encode()) for r in mine])


def _judged(index: ItemIndex, batches, at: int, min_containment: float):
    tables = index.lookup()
    for batch in batches:
        for part in pieces(batch, at, 2 << 20):
            yield part, index.matches(text_bytes(part.column(at)), min_containment, tables)


def contaminated(docs: DataFrame, items: DataFrame, min_containment: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", items_per_part: int = 50_000) -> DataFrame:
    """One row for each document that holds an item: id, ``item_ids``, the best item and its ``containment``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    item_kind = items.select(item_id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, _text binary, _hits array<struct<share: double, id: {item_kind}>>"
    hits_type = pa.list_(pa.struct([("share", pa.float64()), ("id", to_arrow_type(items.schema[item_id_col].dataType))]))
    found = []
    for index in item_parts(items, item_id_col, item_text_col, items_per_part):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for part, hits in _judged(shared.value, batches, 1, min_containment):
                keep = [i for i, x in enumerate(hits) if x]
                if keep:
                    mine = part.take(pa.array(keep))
                    yield pa.RecordBatch.from_arrays(
                        [
                            mine.column(0),
                            pa.array([blake2b(x, digest_size=16).digest() for x in text_bytes(mine.column(1))], pa.binary()),
                            pa.array([[{"share": share, "id": k} for k, share in hits[i]] for i in keep], hits_type),
                        ],
                        names=[id_col, "_text", "_hits"],
                    )

        found.append(rows.mapInArrow(run, schema))
    merged = found[0]
    if len(found) > 1:
        # rows equal in id and text have equal hits in each part: they meet as one, and become as many as they were
        key = [id_col, "_text"]
        each = [x.groupBy(*key).agg(F.count("*").alias("_n"), F.first("_hits").alias("_hits")) for x in found]
        merged = reduce(DataFrame.unionByName, each).groupBy(*key).agg(F.max("_n").alias("_n"), F.flatten(F.collect_list("_hits")).alias("_hits"))
        order = F.transform("_hits", lambda x: F.struct((-x["share"]).alias("less"), x["id"].isNull().alias("none"), x["share"].alias("share"), x["id"].alias("id")))
        merged = merged.select(id_col, F.array_sort(order).alias("_hits"), F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
    best = F.get("_hits", F.lit(0))
    return merged.select(id_col, F.transform("_hits", lambda x: x["id"]).alias("item_ids"), best["id"].alias("best_item_id"), best["share"].alias("containment"))


def keep_clean(docs: DataFrame, items: DataFrame, min_containment: float = 0.8, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", items_per_part: int = 50_000) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns unchanged."""
    at = docs.columns.index(text_col)
    spark, schema = docs.sparkSession, docs.schema
    for index in item_parts(items, item_id_col, item_text_col, items_per_part):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for part, hits in _judged(shared.value, batches, at, min_containment):
                yield part.filter(pa.array([not x for x in hits], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
