"""Top-k search over postings in compressed blocks, with bounds that let blocks go unread.

Documents are dealt into shards of bounded size.  Within a shard each term's
postings, in order of ids, are cut into blocks of ``BLOCK`` rows: ids as steps and
counts and lengths in the narrowest width that holds them, beside the first and last id
and the largest weight that any posting of the block has before its idf.

A shard is searched in one pass over its blocks of the asked words.  The block
borders of a query's words cut the shard's ids into ranges in which the sum of the
covering blocks' largest weights bounds every score.  Ranges are taken by falling
bound; as soon as ``k`` documents are found and the next bound is below the
``k``-th score, all other ranges, and the blocks that only they need, stay unread.
Within a range, words that together cannot reach the ``k``-th score are read only
where another word has a document.  The bounds hold for every document, so the result is that of a full search.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..config import Bm25
from ..scratch import settle
from .lexical import FEW_WORDS, Index, _wanted, top_per

BLOCK = 128
BLOCKS = "shard int, term string, first long, last long, n int, most double, ids binary, tf binary, len binary"
#: Scores are rounded to six places, so a bound must be lower by more than that to be passed over.
ROUNDING = 1e-6
#: So many places of words in ranges are looked at together.
AT_ONCE = 200_000


def pack(values: np.ndarray) -> bytes:
    """Whole numbers of at least 0 in the narrowest width, which leads them."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(values.max(initial=0)) < 1 << (8 * w))
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def pack_one(value: int) -> bytes:
    width = next(w for w in (1, 2, 4, 8) if w == 8 or value < 1 << (8 * w))
    return bytes([width]) + value.to_bytes(width, "little")


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


@dataclass(frozen=True)
class BlockIndex:
    """``blocks``, ``terms`` (term, df) and ``stats`` as in :class:`lexical.Index`."""

    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame
    params: Bm25 = Bm25()

    def write(self, path: str) -> None:
        self.blocks.write.mode("overwrite").parquet(f"{path}/blocks")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def read(cls, spark: SparkSession, path: str, params: Bm25 = Bm25()) -> BlockIndex:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("blocks", "terms", "stats")), params)


def build(index: Index, shard_docs: int = 50_000, params: Bm25 = Bm25()) -> BlockIndex:
    """Blocks of an index; ids must be whole numbers.  A shard holds about ``shard_docs`` documents."""
    n_docs, avgdl = index.stats.select("n_docs", F.col("avgdl").cast("double")).first()
    shards = max(1, -(-n_docs // shard_docs))
    rows = index.postings.join(index.docs, "id").select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "term", F.col("id").cast("long").alias("id"), F.col("tf").cast("long").alias("tf"), F.col("len").cast("long").alias("len"))
    # a term's rows of one shard are together, those of a frequent term are spread by shard
    dealt = rows.repartitionByRange("term", "shard").sortWithinPartitions("term", "shard", "id")
    k1, b = params.k1, params.b

    def run(batches):
        from ..functions.runs import grouped

        held, key = [], None

        def close(last: bool):
            """Whole blocks of the term so far; the rest waits for more rows of it."""
            nonlocal held
            ids, tf, size, weight = held[0] if len(held) == 1 else (np.concatenate([h[i] for h in held]) for i in range(4))
            stop = len(ids) if last else len(ids) // BLOCK * BLOCK
            out = []
            for x in range(0, stop, BLOCK):
                i, t, n, w = (c[x : min(x + BLOCK, stop)] for c in (ids, tf, size, weight))
                # most words have one document, for which arrays take long
                first, last_id, packed = int(i[0]), int(i[-1]), (b"\x01\x00", pack_one(int(t[0])), pack_one(int(n[0]))) if len(i) == 1 else (pack(np.diff(i, prepend=i[0])), pack(t), pack(n))
                out.append((key[1], key[0], first, last_id, len(i), float(w.max() if len(i) > 1 else w[0]), *packed))
            held = [(ids[stop:], tf[stop:], size[stop:], weight[stop:])]
            return out

        done: list[tuple] = []

        def flush():
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), *[pa.binary()] * 3]
            rows = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], [c.split()[0] for c in BLOCKS.split(", ")])
            done.clear()
            return rows

        now, columns = None, ()
        for batch, x, y, same in grouped(batches, 0, 1):
            if batch is not now:
                ids, tf, size = (np.asarray(batch.column(c)) for c in (2, 3, 4))
                now, columns = batch, (ids, tf, size, tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / avgdl)))
            if not same:
                if held:
                    done += close(True)
                held, key = [], (batch.column(0)[x].as_py(), batch.column(1)[x].as_py())
            held.append(tuple(c[x:y] for c in columns))
            if sum(len(h[0]) for h in held) > 64 * BLOCK:
                done += close(False)
            if len(done) >= 4096:
                yield flush()
        if held:
            done += close(True)
        if done:
            yield flush()

    blocks = dealt.select("term", "shard", "id", "tf", "len").mapInArrow(run, BLOCKS)
    return BlockIndex(blocks, index.terms, index.stats, params)


class _Words:
    """A shard's blocks of one term; a block is decoded once, when it is first needed."""

    def __init__(self):
        self.first: list[int] = []
        self.last: list[int] = []
        self.most: list[float] = []
        self.raw: list[tuple] = []
        self.read: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def weights(self, k: int, avgdl: float, p: Bm25) -> tuple[np.ndarray, np.ndarray]:
        """Ids and weights (before idf) of a block."""
        if k not in self.read:
            ids, tf, n = (unpack(x) for x in self.raw[k])
            self.read[k] = np.cumsum(ids) + self.first[k], tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * n / avgdl))
        return self.read[k]


def _best(asked: list[tuple[_Words, float]], k: int, avgdl: float, p: Bm25) -> tuple[list[tuple[float, int]], int]:
    """The best ``k`` (score, id) of a shard for a query's words with their idf, and how many of the blocks were needed."""
    # a range begins where some block begins and where some block is over
    borders = np.unique(np.concatenate([np.array([w.first, [x + 1 for x in w.last]]).ravel() for w, _ in asked]))
    bound = np.zeros(len(borders))
    for w, idf in asked:
        change = np.zeros(len(borders) + 1)
        np.add.at(change, np.searchsorted(borders, w.first), w.most)
        np.add.at(change, np.searchsorted(borders, np.array(w.last) + 1), np.negative(w.most))
        bound += idf * np.cumsum(change)[:-1]
    best: list[tuple[float, int]] = []
    offset = np.cumsum([0, *(len(w.first) for w, _ in asked)])
    needed = np.zeros(offset[-1], bool)
    stops = np.append(borders[1:], borders[-1])
    order = np.argsort(-bound, kind="stable")
    floor = lambda: best[0][0] - ROUNDING if len(best) == k else -1.0
    over = lambda r: bound[r] <= 1e-9 or (len(best) == k and bound[r] < floor())
    # ranges are scored many at a time and then taken one by one, as if each had been read when its turn came
    start, size, most = 0, 8, max(8, AT_ONCE // len(asked))
    while start < len(order) and not over(order[start]):
        ranges = np.array([r for r in order[start : start + size] if not over(r)])
        start, size = start + size, min(size * 2, most)
        run = _Ranges(asked, borders, stops, ranges, floor(), avgdl, p)
        low = best[0][0] if len(best) == k else -np.inf
        found = run.scored(low)
        for j, r in enumerate(ranges):
            if over(r):
                return [(s, -i) for s, i in best], int(needed.sum())
            # words that cannot reach the k-th score together only add to documents that another word brings
            few = np.count_nonzero(run.together[:, j] < floor())
            words = run.rank[few : run.covering[j], j]
            some = run.counts[words, j].any()
            words = run.rank[: run.covering[j], j] if some else words
            needed[offset[words] + run.at[words, j]] = True
            for score, i in found.get(j, ()) if some else ():
                if len(best) < k:
                    heapq.heappush(best, (score, -i))
                elif (score, -i) > best[0]:
                    heapq.heapreplace(best, (score, -i))
    return [(s, -i) for s, i in best], int(needed.sum())


class _Ranges:
    """Some ranges of ids: each word's block ``at`` each range, the words' ``rank`` by falling need, and what these blocks hold.

    Words are ranked by the most they can bring, smallest first; ``together`` is what
    the words up to a rank can bring, ``covering`` how many words have a block there.
    Blocks are read of words that can reach ``floor``, of the others where such a word
    has a document.
    """

    def __init__(self, asked: list[tuple[_Words, float]], borders: np.ndarray, stops: np.ndarray, ranges: np.ndarray, floor: float, avgdl: float, p: Bm25):
        self.asked, self.borders, self.avgdl, self.p = asked, borders, avgdl, p
        low, high, n = borders[ranges], stops[ranges], len(ranges)
        self.local = np.full(len(borders), -1)
        self.local[ranges] = np.arange(n)
        self.at = np.empty((len(asked), n), np.int64)
        share = np.full((len(asked), n), np.inf)
        for w, (word, idf) in enumerate(asked):
            at = np.searchsorted(word.last, low)
            self.at[w] = np.minimum(at, len(word.first) - 1)
            there = (at < len(word.first)) & (np.array(word.first)[self.at[w]] < high)
            share[w, there] = idf * np.array(word.most)[self.at[w, there]]
        self.covering = np.isfinite(share).sum(axis=0)
        self.rank = np.argsort(share, axis=0, kind="stable")
        self.together = np.cumsum(np.take_along_axis(share, self.rank, axis=0), axis=0)
        able = np.argsort(self.rank, axis=0) >= (self.together < floor).sum(axis=0)
        self.counts = np.zeros(share.shape, np.int64)
        self.ids, self.weights = [], []
        self._read(np.isfinite(share) & able)
        self._read(np.isfinite(share) & ~able & self.counts.any(axis=0))

    def _read(self, wanted: np.ndarray) -> None:
        for w in np.flatnonzero(wanted.any(axis=1)):
            word, idf = self.asked[w]
            blocks = [word.weights(int(x), self.avgdl, self.p) for x in np.unique(self.at[w, wanted[w]])]
            ids, weights = (np.concatenate([x[i] for x in blocks]) for i in range(2))
            j = self._range(ids)
            keep = (j >= 0) & wanted[w, j]
            self.counts[w] += np.bincount(j[keep], minlength=wanted.shape[1])
            self.ids.append(ids[keep])
            self.weights.append(idf * weights[keep])

    def _range(self, ids: np.ndarray) -> np.ndarray:
        return self.local[np.searchsorted(self.borders, ids, "right") - 1]

    def scored(self, low: float) -> dict[int, list[tuple[float, int]]]:
        """(score, id) of the documents with at least the score ``low``, by range."""
        docs, place = np.unique(np.concatenate([*self.ids, np.zeros(0, np.int64)]), return_inverse=True)
        scores = np.round(np.bincount(place, weights=np.concatenate([*self.weights, np.zeros(0)]), minlength=len(docs)), 6)
        keep = scores >= low
        out: dict[int, list[tuple[float, int]]] = {}
        for j, score, i in zip(self._range(docs[keep]).tolist(), scores[keep].tolist(), docs[keep].tolist()):
            out.setdefault(j, []).append((score, i))
        return out


def search(index: BlockIndex, queries: DataFrame, k: int, synonyms: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, id, score, rank) as :func:`lexical.search` gives it, and per query how many ``blocks`` there were and how many were ``needed``.

    Queries go in parts of at most ``FEW_WORDS`` words each, whose words are sent
    to the tasks; only blocks of these words leave the scan.
    """
    spark = queries.sparkSession
    terms = settle(_wanted(queries, synonyms), "asked")
    parts = max(1, -(-terms.count() // FEW_WORDS))
    n_docs, avgdl = index.stats.select("n_docs", F.col("avgdl").cast("double")).first()
    kind = queries.schema["query_id"].dataType.simpleString()
    p = index.params
    out = None
    for part in range(parts):
        mine = terms.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        weighed = mine.join(index.terms, "term").withColumn("idf", F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)).select("query_id", "term", "idf").collect()
        asked: dict = {}
        for r in weighed:
            asked.setdefault(r.query_id, []).append((r.term, r.idf))
        words = spark.createDataFrame(sorted({(r.term,) for r in weighed}), "term string")
        # at most FEW_WORDS short rows; shards are small but take long, so they are not put together
        blocks = index.blocks.join(F.broadcast(words), "term", "left_semi").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard").sortWithinPartitions("shard", "term", "first")
        found = blocks.select("shard", "term", "first", "last", "most", "ids", "tf", "len").mapInArrow(_search_shards(asked, k, avgdl, p, to_arrow_type(queries.schema["query_id"].dataType)), f"query_id {kind}, id long, score double, blocks long, needed long")
        out = found if out is None else out.unionByName(found)
    out = settle(out, "found")
    best = top_per(out.where("id is not null").select("query_id", "id", "score"), k)
    return best, out.where("id is null").groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.sum("needed").alias("needed"))


def _search_shards(asked: dict, k: int, avgdl: float, p: Bm25, kind: pa.DataType):
    def run(batches):
        from ..functions.runs import grouped

        words: dict[str, _Words] = {}

        def answer():
            rows = []
            for query, terms in asked.items():
                here = [(words[t], idf) for t, idf in terms if t in words]
                if here:
                    best, needed = _best(here, k, avgdl, p)
                    rows += [(query, i, s, None, None) for s, i in best]
                    rows.append((query, None, None, sum(len(w.first) for w, _ in here), needed))
            if rows:
                q, i, s, n, m = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(q, kind), pa.array(i, pa.int64()), pa.array(s, pa.float64()), pa.array(n, pa.int64()), pa.array(m, pa.int64())], ["query_id", "id", "score", "blocks", "needed"])

        for batch, a, b, same in grouped(batches, 0):
            if not same:
                yield from answer()
                words = {}
            rows = batch.slice(a, b - a).to_pydict()
            for term, first, last, most, *raw in zip(*(rows[c] for c in ("term", "first", "last", "most", "ids", "tf", "len"))):
                w = words.setdefault(term, _Words())
                w.first.append(first)
                w.last.append(last)
                w.most.append(most)
                w.raw.append(tuple(raw))
        yield from answer()

    return run
