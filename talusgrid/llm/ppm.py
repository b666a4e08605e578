"""Document scoring by prediction by partial matching over byte contexts.

A token is a word and the space that ends it, or the end of the text.  The
probability of a token is the product over its bytes of a byte-context trie.
Its contexts are the bytes since the space before the word (from three bytes up
to ``DEPTH``), then the last two bytes, the last one, and none; what no context
knows is uniform over the symbols left.  The escape estimate is method D, and
an escape excludes the symbols of the longer context.  Equal words cost the
same everywhere, so each distinct word is coded once.  One trie is trained on
all training texts and one on each of the most frequent values of a class
column (rarer values share one more); their predictions are mixed by their shares
of the training bytes (a fifth goes to the first trie) and how well they coded the document's last ``WINDOW`` tokens, and the token counts of the
document so far are one more, adaptive, context of the mixture.  Every weight
depends on earlier tokens only, so the product over a text is its probability.

The counts cover all training texts, and no node of the trie is left out.
Words are counted per block of documents (about ``block_bytes`` of text) and
meet their corpus counts in buckets, each a range of words in byte order.  The
long contexts of a bucket's words lie in the bucket but for those that its
bounds run through; for these few the other buckets' counts are joined to it.
A word that many blocks share has one row a block, a prefix that many words
share is spread over buckets.  What is broadcast are the counts of strings of
up to three bytes, of which the alphabet allows no more however large the
corpus, and the buckets' bounds.

Defined results: null is the empty text, whose only token is the end.  A null
id is in the training part.  Repeated rows are scored one by one; in an empty
table, or with nothing to learn from, all tokens have the uniform probability
and ``train_tokens`` is 0.  Other columns are never read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize, text_bytes

#: Bytes of the contexts that lie anywhere in a word; longer ones begin with the word.
SHORT = 2
#: Bytes of the longest context.
DEPTH = 24
#: Bytes of a bucket's bound, with the space before the word.
BOUND = 8
WINDOW = 16
#: Weight of the document's own counts once it is long.
OWN_WEIGHT = 0.2
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
END = b"\n"
#: The trie over all classes, and that of the classes without one of their own.
ALL, REST = "", "\x00rest"
#: Costs travel as whole numbers of this part of a decimal digit, as 32-bit floats, which have room for a token of any length.
UNITS = 500
#: Probabilities under this are worked out in logarithms.
TINY = 1e-280


def packed_costs(log_probs: np.ndarray) -> np.ndarray:
    """Costs in units, rounded up, so that probabilities never add up to more than one."""
    exact = np.ceil(log_probs * -UNITS)
    units = exact.astype("<f4")
    return np.where(units < exact, np.nextafter(units, np.float32(np.inf)), units).astype("<f4")


def unpacked_costs(packed: bytes, width: int) -> np.ndarray:
    """The log10 probabilities of :func:`packed_costs`, a row for each token."""
    return np.frombuffer(packed, "<f4").reshape(-1, width).astype(np.float64) / -UNITS


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words, then one end."""
    words = text.translate(_LOWER).split()
    words.append(END)
    return words


def padded(word: bytes) -> bytes:
    """The word's symbols: a space before and, but for the end, after it."""
    return b" \n" if word == END else b" " + word + b" "


def _flat(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all strings, their starts, their lengths)."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    return np.frombuffer(b"".join(strings), np.uint8), np.cumsum(lengths) - lengths, lengths


def _grams(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key of the up to three bytes of one word that end at each place, number of symbols before the place).

    A key packs the bytes and above them their number, so keys of different sizes differ.
    """
    into = np.arange(len(symbols)) - np.repeat(starts, lengths)
    key = symbols.astype(np.int64)
    for back in range(1, SHORT + 1):
        key[back:] |= np.where(into[back:] >= back, symbols[: len(symbols) - back].astype(np.int64) << (8 * back), 0)
    return key | (np.minimum(into, SHORT) + 1) << 24, into


def short_counts(strings: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and weighted counts of the strings of one to three bytes whose last byte is predicted (all but a word's first)."""
    symbols, starts, lengths = _flat(strings)
    key, into = _grams(symbols, starts, lengths)
    weight = np.repeat(counts, lengths)
    keys, sums = [], []
    for size in range(1, SHORT + 2):
        use = (into > 0) & (into >= size - 1)
        names, inverse = np.unique(key[use] & ((1 << 8 * size) - 1), return_inverse=True)
        keys.append(names | size << 24)
        sums.append(np.bincount(inverse, weights=weight[use], minlength=len(names)))
    return np.concatenate(keys), np.concatenate(sums)


def index_of(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the keys in a sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _logs(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """log10 of ``part`` out of twice ``whole``."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.log10(part / (2 * whole))


class ShortContexts:
    """Counts of all classes after contexts of two bytes, one and none, with escape and exclusion worked out.

    ``counts`` has a row for each key of :func:`short_counts` (sorted) and a column for each class.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.tables, self.counts, self.names, self.total, self.kinds = [], [], [], [], []
        self.rest_total, self.rest_kinds = [], []
        for size in range(1, SHORT + 2):
            mine = keys >> 24 == size
            k, c = keys[mine] & 0xFFFFFF, counts[mine].astype(np.float64)
            names, first = np.unique(k >> 8, return_index=True)
            add = lambda x: np.add.reduceat(x, first, axis=0) if len(first) else np.zeros((0, counts.shape[1]))  # noqa: B023, E731
            self.tables.append(k)
            self.counts.append(c)
            self.names.append(names)
            self.total.append(add(c))
            self.kinds.append(add((c > 0).astype(np.float64)))
            if size == 1:
                continue
            # after an escape: what the context of one byte less has besides this context's own symbols
            low = index_of(self.tables[-2], k & ((1 << 8 * (size - 1)) - 1))
            own = add(np.where(c > 0, self.counts[-2][low], 0))
            up = index_of(self.names[-2], names & ((1 << 8 * (size - 2)) - 1))
            self.rest_total.append(self.total[-2][up] - own)
            self.rest_kinds.append(self.kinds[-2][up] - self.kinds[-1])

    def _row(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), values.shape[1]))
        out[at >= 0] = values[at[at >= 0]]
        return out

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For places (keys of up to three bytes), a row each, by class: the log10 probability; the same after an escape
        from the two bytes before; and the symbol's count, the total and the kinds after these two bytes."""
        size, body = keys >> 24, keys & 0xFFFFFF
        known = self.kinds[0][0] if len(self.kinds[0]) else np.zeros(self.counts[0].shape[1])
        fresh = after = np.tile(-np.log10(np.maximum(256 - known, 1)), (len(keys), 1))
        low = after
        for n in range(SHORT + 1):
            ctx = np.where(size > n, index_of(self.names[n], body >> 8 & ((1 << 8 * n) - 1)), -1)
            sym = np.where(size > n, index_of(self.tables[n], body & ((1 << 8 * (n + 1)) - 1)), -1)
            count, total, kinds = self._row(self.counts[n], sym), self._row(self.total[n], ctx), self._row(self.kinds[n], ctx)
            got = count > 0
            fresh = np.where(total > 0, np.where(got, _logs(2 * count - 1, total), _logs(kinds, total) + after), fresh)
            low = after
            if n < SHORT:
                up = np.where(size > n + 1, index_of(self.names[n + 1], body >> 8 & ((1 << 8 * (n + 1)) - 1)), -1)
                left, others = self._row(self.rest_total[n], up), self._row(self.rest_kinds[n], up)
                after = np.where(got, _logs(2 * count - 1, left), np.where(others > 0, _logs(others, left), 0) + after)
        return fresh, low, count, total, kinds


def _cut(strings: list[bytes], width: int) -> np.ndarray:
    """The first ``width`` bytes of each string as a row, filled with zeros."""
    return np.array(strings, dtype=f"S{width}").view(np.uint8).reshape(-1, width) if strings else np.zeros((0, width), np.uint8)


def log_probs(words: list[bytes], counts: np.ndarray, short: ShortContexts, outside: list[tuple[bytes, np.ndarray]] = ()) -> np.ndarray:
    """log10 probability of each word and the space after it (of the end alone for ``END``), a column a class.

    ``words`` are distinct and ``counts`` has their training counts by class;
    ``outside`` are beginnings of other training words, with these words' counts.
    """
    real = len(words)
    strings = [padded(w) for w in words] + [s for s, _ in outside]
    order = sorted(range(len(strings)), key=strings.__getitem__)
    strings = [strings[i] for i in order]
    weight = np.concatenate([counts, *[v[None, :] for _, v in outside]])[order].astype(np.float64)
    symbols, starts, lengths = _flat(strings)
    key, into = _grams(symbols, starts, lengths)
    names, place = np.unique(key, return_inverse=True)
    fresh, low, count, total, kinds = short.look_up(names)
    # first as if there were no long contexts, then these change the places they reach
    out = np.add.reduceat(np.where((into > 0)[:, None], fresh[place], 0), starts, axis=0) if len(strings) else np.zeros((0, counts.shape[1]))
    first = _cut(strings, DEPTH + 1)
    rows = np.arange(len(strings))
    node = np.cumsum(np.concatenate([[0], (first[1:, : SHORT + 1] != first[:-1, : SHORT + 1]).any(1)])) if len(strings) else rows
    for depth in range(SHORT + 1, DEPTH + 1):
        on = lengths[rows] > depth
        rows, node = rows[on], node[on]
        if not len(rows):
            break
        sym = first[rows, depth]
        new = np.concatenate([[True], node[1:] != node[:-1]])
        new_child = new | np.concatenate([[True], sym[1:] != sym[:-1]])
        child = np.cumsum(new_child) - 1
        child_at, node_at = np.flatnonzero(new_child), child[new]
        owner = (np.cumsum(new) - 1)[child_at]
        c = np.add.reduceat(weight[rows], child_at, axis=0)
        t = np.add.reduceat(c, node_at, axis=0)[owner]
        k = np.add.reduceat((c > 0).astype(np.float64), node_at, axis=0)[owner]
        u = place[starts[rows[child_at]] + depth]
        own = np.add.reduceat(np.where(c > 0, count[u], 0), node_at, axis=0)[owner]
        left, others = total[u] - own, kinds[u] - k
        lower = np.where(count[u] > 0, _logs(2 * count[u] - 1, left), np.where(others > 0, _logs(others, left), 0) + low[u])
        value = np.where(c > 0, _logs(2 * c - 1, t), _logs(k, t) + lower)
        out[rows] += np.where(t > 0, value - fresh[u], 0)[child]
        node = child
    back = np.empty_like(out)
    back[order] = out
    return back[:real]


@dataclass
class PpmModel:
    """The classes' names and priors, the counts of the short contexts, and the shape of the mixture."""

    names: list[str]
    prior: np.ndarray
    keys: np.ndarray
    counts: np.ndarray
    window: int = WINDOW
    own_weight: float = OWN_WEIGHT

    def short(self) -> ShortContexts:
        made = getattr(self, "_short", None)
        if made is None:
            made = self._short = ShortContexts(self.keys, self.counts)
        return made

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_short"}

    def matrix(self, by_label: dict[str, np.ndarray], rows: int) -> np.ndarray:
        """Counts by label as a column a class."""
        out = np.zeros((rows, len(self.names)))
        for label, n in by_label.items():
            out[:, 0] += n
            if label != ALL:
                out[:, self.names.index(label if label in self.names else REST)] += n
        return out

    def text_log_prob(self, costs: np.ndarray, chances: np.ndarray, word_ids: np.ndarray) -> float:
        """log10 probability of a text, given its tokens' rows in ``costs`` and in ``chances`` (10 to their power)."""
        n = len(word_ids)
        i = np.arange(n)
        run = np.zeros((n + 1, costs.shape[1]))
        np.cumsum(costs[word_ids], axis=0, out=run[1:])
        weight = run[:-1] + self.prior
        weight[self.window :] -= run[: max(0, n - self.window)]
        weight -= weight.max(1, keepdims=True)
        share = np.exp(weight * np.log(10))
        p = (share * chances[word_ids]).sum(1) / share.sum(1)
        order = np.argsort(word_ids, kind="stable")
        ranked = word_ids[order]
        first = np.zeros(n, np.int64)
        fresh = np.flatnonzero(ranked[1:] != ranked[:-1]) + 1
        first[fresh] = fresh
        before = np.empty(n)
        before[order] = i - np.maximum.accumulate(first)
        own = self.own_weight * i / (i + 20.0)
        seen = own * before / np.maximum(i, 1)
        tiny = np.flatnonzero(p < TINY)
        if not len(tiny):
            return float(np.log10(seen + (1 - own) * p).sum())
        p[tiny] = 1  # long tokens, whose chances are too small for a float, follow
        out = np.log10(seen + (1 - own) * p)
        terms = weight[tiny] + costs[word_ids[tiny]]
        most = terms.max(1)
        rest = most + np.log10((10.0 ** (terms - most[:, None])).sum(1) / share[tiny].sum(1)) + np.log10(1 - own[tiny])
        with np.errstate(divide="ignore"):
            out[tiny] = np.logaddexp(np.log(seen[tiny]), rest * np.log(10)) / np.log(10)
        return float(out.sum())


def _blocks(docs: DataFrame, blocks: int, train: Column, id_col: str, text_col: str, class_col: str | None) -> DataFrame:
    label = F.coalesce(F.col(class_col).cast("string"), F.lit(ALL)) if class_col else F.lit(ALL)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(True)).alias("train"), label.alias("label"))
    return rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))


def _bounds(rows: DataFrame, buckets: int) -> list[bytes]:
    """Beginnings of words that cut the words into about ``buckets`` parts of like size, from a sample of documents.

    They only decide which task works on which word.
    """
    share = min(1.0, (50 + buckets / 4) / max(1, rows.count()))
    sample = rows.where(F.pmod(F.xxhash64("text", "id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("text")

    def beginnings(batches):
        for batch in batches:
            found = {(b" " + w)[:BOUND] for text in text_bytes(batch.column(0)) for w in tokens(text)[:-1]}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary())], names=["word"])

    found = sorted(r for r in sample.mapInArrow(beginnings, "word binary").distinct().toArrow().column("word").to_pylist())
    return sorted({found[len(found) * i // buckets] for i in range(1, buckets)}) if found else []


def _edges(bounds: list[bytes], bucket: int) -> list[bytes]:
    """The long contexts that a bucket may share with others: beginnings of its two bounds."""
    mine = bounds[max(0, bucket - 1) : bucket + 1] if bucket else bounds[:1]
    return sorted({b[:n] for b in mine for n in range(SHORT + 1, len(b))})


COUNTED = "block int, bucket int, words binary, labels array<string>, sizes array<int>, at binary, n binary"


def _count_block(group: pa.Table, bounds: list[bytes]) -> pa.Table:
    """A row for each bucket of a block's words: ``words`` joined by spaces and, label after label, which of them are
    training words of the label (``sizes``, ``at``) and how often (``n``)."""
    by: dict[str, Counter] = {}
    held: set[bytes] = set()
    columns = (group.column(c) for c in ("text", "train", "label"))
    for batch in pa.table(list(columns), names=["text", "train", "label"]).to_batches(max_chunksize=500):
        for text, train, label in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if train:
                by.setdefault(label, Counter()).update(tokens(text))
            else:
                held.update(tokens(text))
    for counts in by.values():
        held.update(counts)
    words = sorted(held, key=padded)
    strings = [padded(w) for w in words]
    place = {w: i for i, w in enumerate(words)}
    labels = sorted(by)
    sparse = []
    for label in labels:
        counts = by.pop(label)
        at = np.fromiter(map(place.__getitem__, counts), np.int64, len(counts))
        order = np.argsort(at)
        sparse.append((at[order], np.fromiter(counts.values(), np.uint32, len(counts))[order]))
    cuts = np.array([0, *np.searchsorted(np.array(strings, object), np.array(bounds, object)), len(words)]) if words else np.zeros(len(bounds) + 2, int)
    spans = [np.searchsorted(at, cuts) for at, _ in sparse]
    rows = []
    for bucket in np.flatnonzero(np.diff(cuts)).tolist():
        lo, hi = cuts[bucket], cuts[bucket + 1]
        names, sizes, at, n = [], [], [], []
        for label, (where, counts), span in zip(labels, sparse, spans):
            a, b = span[bucket], span[bucket + 1]
            if b > a:
                names.append(label)
                sizes.append(int(b - a))
                at.append((where[a:b] - lo).astype("<u4"))
                n.append(counts[a:b].astype("<u4"))
        rows.append((bucket, b" ".join(words[lo:hi]), names, sizes, b"".join(x.tobytes() for x in at), b"".join(x.tobytes() for x in n)))
    bucket, joined, names, sizes, at, n = zip(*rows) if rows else ((),) * 6
    return pa.table(
        {
            "block": pa.array(np.full(len(rows), group.column("block")[0].as_py(), np.int32)),
            "bucket": pa.array(bucket, pa.int32()),
            "words": pa.array(joined, pa.binary()),
            "labels": pa.array(names, pa.list_(pa.string())),
            "sizes": pa.array(sizes, pa.list_(pa.int32())),
            "at": pa.array(at, pa.binary()),
            "n": pa.array(n, pa.binary()),
        }
    )


def _bucket_words(group: pa.Table) -> tuple[list[bytes], dict[str, np.ndarray], np.ndarray, list[int]]:
    """(distinct words of a bucket in byte order, their counts by label, places of all rows' words, words a row)."""
    rows = [x.split(b" ") for x in group.column("words").to_pylist()]
    coded = pa.array([w for row in rows for w in row], pa.binary()).dictionary_encode()
    names = coded.dictionary.to_pylist()
    order = sorted(range(len(names)), key=lambda i: padded(names[i]))
    moved = np.empty(len(names), np.int64)
    moved[order] = np.arange(len(names))
    place = moved[coded.indices.to_numpy()]
    found: dict[str, list] = {}
    first = 0
    for row, labels, sizes, at, n in zip(rows, *(group.column(c).to_pylist() for c in ("labels", "sizes", "at", "n"))):
        at, n, done = np.frombuffer(at, "<u4"), np.frombuffer(n, "<u4"), 0
        for label, size in zip(labels, sizes):
            found.setdefault(label, []).append((place[first + at[done : done + size]], n[done : done + size]))
            done += size
        first += len(row)
    by = {}
    for label, parts in found.items():
        at, n = (np.concatenate(x) for x in zip(*parts))
        by[label] = np.bincount(at, weights=n, minlength=len(names))
    return [names[i] for i in order], by, place, [len(row) for row in rows]


def _children(strings: list[bytes], counts: np.ndarray, nodes: list[bytes]) -> Iterable[tuple[bytes, np.ndarray]]:
    """(a node and the next byte, counts) for the nodes' children among sorted strings."""
    first = _cut(strings, BOUND)
    for q in nodes:
        a, b = bisect_left(strings, q), bisect_left(strings, q[:-1] + bytes([q[-1] + 1]))
        if b > a:
            sym = first[a:b, len(q)]
            at = np.flatnonzero(np.concatenate([[True], sym[1:] != sym[:-1]]))
            for s, row in zip(sym[at].tolist(), np.add.reduceat(counts[a:b], at, axis=0)):
                yield q + bytes([s]), row


SUMS = "kind string, label string, child binary, gram int, n long"


def _bucket_sums(group: pa.Table, bounds: list[bytes]) -> pa.Table:
    """What a bucket adds to the corpus counts: its training words (``kinds``) and tokens, strings of up to three bytes
    by label, and the contexts that it may share with other buckets."""
    words, by, _, _ = _bucket_words(group)
    strings = [padded(w) for w in words]
    known = np.zeros(len(words), bool)
    out = []
    for label, counts in by.items():
        known |= counts > 0
        use = np.flatnonzero(counts)
        keys, sums = short_counts([strings[i] for i in use.tolist()], counts[use])
        size = len(keys)
        out.append(pa.table({"kind": pa.array(["gram"] * size), "label": pa.array([label] * size), "child": pa.nulls(size, pa.binary()), "gram": pa.array(keys, pa.int32()), "n": pa.array(sums.astype(np.int64))}))
        edges = [(child, int(row[0])) for child, row in _children(strings, counts[:, None], _edges(bounds, group.column("bucket")[0].as_py())) if row[0] > 0]
        size = len(edges)
        out.append(pa.table({"kind": pa.array(["edge"] * size, pa.string()), "label": pa.array([label] * size, pa.string()), "child": pa.array([x for x, _ in edges], pa.binary()), "gram": pa.nulls(size, pa.int32()), "n": pa.array([n for _, n in edges], pa.int64())}))
    totals = {"kinds": int(known.sum()), "tokens": int(sum(x.sum() for x in by.values()))}
    out.append(pa.table({"kind": pa.array(list(totals)), "label": pa.nulls(2, pa.string()), "child": pa.nulls(2, pa.binary()), "gram": pa.nulls(2, pa.int32()), "n": pa.array(list(totals.values()), pa.int64())}))
    return pa.concat_tables(out)


def _load_model(grams: DataFrame, components: int, **options) -> PpmModel:
    """The short contexts' counts in the ``components`` most frequent classes and the rest."""
    ones = grams.where(F.shiftright("gram", 24) == 1)
    masses = ones.groupBy("label").agg(F.sum("n").alias("mass"))
    all_mass = masses.agg(F.sum("mass")).first()[0]
    if not all_mass:
        return PpmModel([ALL], np.zeros(1), np.empty(0, np.int64), np.empty((0, 1)), **options)
    top = masses.where(F.col("label") != ALL).orderBy(F.desc("mass"), "label").limit(components + 1).collect()
    names = [r["label"] for r in top[:components]]
    mass = [r["mass"] for r in top[:components]]
    if len(top) > components:
        names.append(REST)
        mass.append((masses.where(F.col("label") != ALL).agg(F.sum("mass")).first()[0]) - sum(mass))
    own = F.when(F.col("label").isin(names), F.col("label")).otherwise(REST)
    each = grams.where(F.col("label") != ALL).groupBy(own.alias("label"), "gram").agg(F.sum("n").alias("n"))
    table = grams.groupBy(F.lit(ALL).alias("label"), "gram").agg(F.sum("n").alias("n")).unionByName(each).toArrow()
    gram, n = table.column("gram").to_numpy().astype(np.int64), table.column("n").to_numpy()
    keys = np.unique(gram)
    counts = np.zeros((len(keys), 1 + len(names)))
    column = {x: i for i, x in enumerate([ALL, *names])}
    counts[np.searchsorted(keys, gram), [column[x] for x in table.column("label").to_pylist()]] = n
    share = np.concatenate([[0.2], 0.8 * np.array(mass) / sum(mass)]) if names else np.ones(1)
    return PpmModel([ALL, *names], np.log10(share), keys, counts, **options)


def score(
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    class_col: str | None = "lang",
    block_bytes: int = 10 << 20,
    components: int = 31,
) -> DataFrame:
    """Per row: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10).

    The ``components`` most frequent values of ``class_col`` have a trie of their
    own beside that of all classes; all others share one.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = _blocks(docs, blocks, train, id_col, text_col, class_col)
    bounds = _bounds(rows, 4 * blocks)
    counted = rows.groupBy("block").applyInArrow(lambda group: _count_block(group, bounds), COUNTED)
    counted = materialize(counted, "ppm-words")
    sums = counted.drop("block").groupBy("bucket").applyInArrow(lambda group: _bucket_sums(group, bounds), SUMS)
    sums = materialize(sums.groupBy("kind", "label", "child", "gram").agg(F.sum("n").alias("n")), "ppm-sums")
    totals = {r["kind"]: int(r["n"]) for r in sums.where(F.col("kind").isin("kinds", "tokens")).select("kind", "n").collect()}
    total, distinct = totals.get("tokens", 0), totals.get("kinds", 0)
    model = _load_model(sums.where("kind = 'gram'").select("label", "gram", "n"), components)
    shared = spark.sparkContext.broadcast(model)
    width = len(model.names)
    wanted = [(i, q) for i in range(len(bounds) + 1) for q in _edges(bounds, i)]
    wanted = spark.createDataFrame(pa.table({"bucket": pa.array([i for i, _ in wanted], pa.int32()), "node": pa.array([q for _, q in wanted], pa.binary())}))
    edges = sums.where("kind = 'edge'").withColumn("node", F.expr("substring(child, 1, length(child) - 1)")).join(wanted, "node").select("bucket", "child", "label", "n")

    def code(group: pa.Table, edges: pa.Table) -> pa.Table:
        """Corpus counts and costs of the words of one bucket, for each block that has them."""
        if not group.num_rows:
            return pa.table({"block": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in ("words", "counts", "costs")}})
        model = shared.value
        names, by, place, sizes = _bucket_words(group)
        counts = model.matrix(by, len(names))
        outside: dict[bytes, np.ndarray] = {}
        for child, label, n in zip(*(edges.column(c).to_pylist() for c in ("child", "label", "n"))):
            outside[child] = outside.get(child, 0) + model.matrix({label: np.array([n])}, 1)[0]
        nodes = _edges(bounds, group.column("bucket")[0].as_py())
        for child, row in _children([padded(w) for w in names], counts, nodes):
            if child in outside:
                outside[child] = outside[child] - row
        others = [(s, v) for s, v in outside.items() if v[0] > 0 and s not in set(nodes)]
        units = packed_costs(log_probs(names, counts, model.short(), others))
        totals = counts[:, 0].astype("<i8")
        parts = np.split(place, np.cumsum(sizes)[:-1])
        return pa.table(
            {
                "block": group.column("block"),
                "words": group.column("words"),
                "counts": pa.array([totals[p].tobytes() for p in parts], pa.binary()),
                "costs": pa.array([units[p].tobytes() for p in parts], pa.binary()),
            }
        )

    coded = counted.groupBy("bucket").cogroup(edges.groupBy("bucket")).applyInArrow(code, "block int, words binary, counts binary, costs binary")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        names: dict[bytes, int] = {}
        for row in right.column("words").to_pylist():
            for w in row.split(b" "):
                names[w] = len(names)
        counts = np.frombuffer(b"".join(right.column("counts").to_pylist()), "<i8")
        costs = unpacked_costs(b"".join(right.column("costs").to_pylist()), width)
        chances = 10.0**costs
        base = np.log10((counts + 0.1) / (total + 0.1 * (distinct + 1)))
        out = []
        for batch in left.select(["text"]).to_batches(max_chunksize=500):
            for text in text_bytes(batch.column(0)):
                ids = np.fromiter(map(names.__getitem__, tokens(text)), np.int64)
                out.append((len(ids), int((counts[ids] > 0).sum()), float(base[ids].sum()), shared.value.text_log_prob(costs, chances, ids)))
        n, hit, b, s = zip(*out) if out else ((), (), (), ())
        return pa.table(
            {
                id_col: left.column("id"),
                "n_tokens": pa.array(n, pa.int64()),
                "n_known": pa.array(hit, pa.int64()),
                "train_tokens": pa.array([total] * len(n), pa.int64()),
                "base_score": pa.array(b, pa.float64()),
                "score": pa.array(s, pa.float64()),
            }
        )

    schema = f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.select("block", "id", "text").groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(finish, schema)
