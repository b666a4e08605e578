"""Near-duplicates by SimHash with anchor-point covering.

A fingerprint has 64 bits: the majority, over all four-word shingles, of each
bit of the shingle's XXH64.  Two fingerprints link at ``THRESHOLD`` or fewer
differing bits.  The 64 bits are cut into three chunks, so a linked pair
differs in at most one bit of some chunk.  The anchors of a chunk are the 4,096
words of the binary Golay code, which covers 23 bits with radius 3: every
distinct fingerprint goes to all anchors within radius 3 + 1 of its chunk (at
most six), once as a home row at the anchor that covers it.  Per anchor, home
rows are compared with all rows; of the links found there only a spanning
forest is kept.  Components over distinct fingerprints come from
:mod:`.components`.

The anchors grow with the input: one with more than ``split_group`` rows is
split by the anchors of the other two chunks.  Its pairs differ in at most four
bits of those together, so in at most two of one of them, and a row goes to all
anchors within radius 3 + 2 there (22 on average).  So a fingerprint meets a
bounded number of others up to some billions of fingerprints.

Exact copies meet as one distinct fingerprint before any comparison.  An anchor
that still has more than ``max_group`` rows is cut into a grid of home parts by
row parts, so that no task gets all of it and no link is lost.

Defined results: null, empty and blank texts have fingerprint zero and link
like any other.  Rows whose id is null never link: their component is null.
Rows with the same id are one document for its component.  Fewer than four
words make one shingle.  Other columns are never read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import xor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import clear_scratch, materialize, pieces, scratch_mark, text_bytes
from .components import connected_components

THRESHOLD = 4
SHINGLE = 4
SEED = 42
RADIUS = 3
#: First bit and width of the three chunks.
CHUNKS = ((0, 22), (22, 21), (43, 21))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole UTF-8 text as an unsigned integer."""
    words = text.translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    body = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    wide = min(shingle, n)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(body[a:b], SEED) for a, b in zip(starts[: n - wide + 1].tolist(), ends[wide - 1 :].tolist())], dtype=np.uint64)
    total = len(h)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, 8192):
        part = np.ascontiguousarray(h[at : at + 8192]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = ones * 2 > total
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and ``fp``, the fingerprint as a signed 64-bit integer."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                h = np.array([fingerprint(t) for t in text_bytes(part.column(1))], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(h.view(np.int64))], names=[id_col, "fp"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, fp long")


def golay_cosets(most: int = RADIUS + 1) -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2,048 syndromes the error patterns of weight up to ``most``, nearest first.

    The generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1 makes the perfect code
    of length 23; a syndrome has one pattern of weight 3 or less.  Unused places
    repeat the first.
    """
    poly = 0b110001110101
    unit = []
    for i in range(23):
        v = 1 << i
        for k in range(22, 10, -1):
            if v >> k & 1:
                v ^= poly << (k - 11)
        unit.append(v)
    table: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(most + 1):
        for places in combinations(range(23), weight):
            table[reduce(xor, (unit[i] for i in places), 0)].append(sum(1 << i for i in places))
    width = max(map(len, table))
    return np.array([t + t[:1] * (width - len(t)) for t in table], np.int64), np.array(unit, np.int64)


def chunk_anchors(fp: np.ndarray, chunk: int, cosets: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into ``fp``, anchor, home) for every anchor of a chunk that the cosets' patterns lead to."""
    patterns, unit = cosets
    first, width = CHUNKS[chunk]
    word = (fp.view(np.uint64) >> np.uint64(first)).astype(np.int64) & ((1 << width) - 1)
    syndrome = np.zeros(len(fp), np.int64)
    for i in range(width):
        syndrome ^= np.where(word >> i & 1, unit[i], 0)
    errors = patterns[syndrome]
    codes = (word[:, None] ^ errors) >> 11  # the code is systematic: its upper twelve bits name the anchor
    used = errors != errors[:, :1]
    used[:, 0] = True
    r, k = np.nonzero(used)
    return r, codes[r, k], k == 0


def anchor_rows(fp: np.ndarray, cosets=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into ``fp``, bucket, home) for every anchor within ``RADIUS`` + 1 of each chunk."""
    cosets = cosets or golay_cosets()
    found = [chunk_anchors(fp, c, cosets) for c in range(len(CHUNKS))]
    return tuple(np.concatenate(x) for x in zip(*((r, code + (c << 12), home) for c, (r, code, home) in enumerate(found))))


def split_rows(fp: np.ndarray, bucket: np.ndarray, home: np.ndarray, cosets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into the rows, bucket, home) at the anchors, within ``RADIUS`` + 2, of the chunks that the bucket is not of."""
    index, buckets, homes = [], [], []
    for chunk in range(len(CHUNKS)):
        mine = np.flatnonzero(bucket >> 12 != chunk)
        r, code, first = chunk_anchors(fp[mine], chunk, cosets)
        index.append(mine[r])
        # above all buckets of one level, and apart for each pair of anchors
        buckets.append((1 + bucket[mine[r]] << 16) + (chunk << 12) + code)
        homes.append(first & home[mine[r]])
    return np.concatenate(index), np.concatenate(buckets), np.concatenate(homes)


def forest(home: np.ndarray, rows: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Edges that connect what the links between ``home`` and ``rows`` connect, fewer than rows."""
    values = np.unique(np.concatenate([home, rows]))
    label = np.arange(len(values))
    at = np.searchsorted(values, rows)
    edges = []
    step = max(1, (1 << 21) // max(1, len(rows)))
    for lo in range(0, len(home), step):
        block = home[lo : lo + step]
        apart = block[:, None] ^ rows[None, :]
        near = (np.bitwise_count(apart) <= threshold) & (apart != 0)
        own = np.searchsorted(values, block)
        for i in np.flatnonzero(near.any(1)):
            mine = label[own[i]]
            reached = at[near[i]]
            others = reached[label[reached] != mine]
            if len(others):
                groups, where = np.unique(label[others], return_index=True)
                edges += [(int(own[i]), int(others[w])) for w in where]
                label[np.isin(label, groups)] = mine
    signed = values.view(np.int64)
    return [(int(signed[a]), int(signed[b])) for a, b in edges]


def links(distinct: DataFrame, max_group: int = 8192, split_group: int = 32768) -> DataFrame:
    """Edges ``a``, ``b`` between distinct fingerprints (column ``fp``) that span all links."""
    cosets = golay_cosets()

    def batch_of(bucket, fp, home):
        return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), pa.array(fp), pa.array(home)], names=["bucket", "fp", "home"])

    def spread(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            index, bucket, home = anchor_rows(fp, cosets)
            yield batch_of(bucket, fp[index], home)

    def split(batches):
        wider = golay_cosets(RADIUS + 2)
        for batch in batches:
            bucket, fp, home = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for lo in range(0, len(fp), 2000):
                part = slice(lo, lo + 2000)
                index, deep, first = split_rows(fp[part], bucket[part], home[part], wider)
                yield batch_of(deep, fp[part][index], first)

    schema = "bucket long, fp long, home boolean"
    rows = materialize(distinct.select("fp").mapInArrow(spread, schema), "anchors")
    # at most 3 x 4,096 buckets, so this table is small whatever the input
    large = rows.groupBy("bucket").count().where(F.col("count") > split_group).select("bucket")
    deep = [r["bucket"] for r in large.collect()]
    if deep:
        large = F.broadcast(distinct.sparkSession.createDataFrame([(x,) for x in deep], "bucket long"))
        below = rows.join(large, "bucket", "left_semi").select("bucket", "fp", "home").mapInArrow(split, schema)
        rows = materialize(rows.join(large, "bucket", "left_anti").select("bucket", "fp", "home").unionByName(below), "anchors")
    sizes = rows.groupBy("bucket").count().where(F.col("count") > max_group).select("bucket", F.ceil(F.col("count") / max_group).cast("int").alias("cuts"))
    part = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    every = F.sequence(F.lit(0), F.col("cuts") - 1)
    cut = rows.join(sizes, "bucket", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1))).withColumn("part", part)
    as_rows = cut.select("bucket", F.explode(every).alias("i"), F.col("part").alias("j"), "fp", F.lit(False).alias("home"))
    as_home = cut.where("home").select("bucket", F.col("part").alias("i"), F.explode(every).alias("j"), "fp", F.lit(True).alias("home"))

    def compare(group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().view(np.uint64)
        home = group.column("home").to_numpy(zero_copy_only=False)
        found = forest(fp[home], fp[~home])
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return as_rows.unionByName(as_home).groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``fp`` and ``component_id``, the smallest id reachable over links."""
    prints = materialize(fingerprints(docs, id_col, text_col).withColumnRenamed(id_col, "id"), "fingerprints")
    nodes = prints.where(F.col("id").isNotNull()).groupBy("fp").agg(F.min("id").alias("least"))
    nodes = materialize(nodes, "distinct-fingerprints")
    mark = scratch_mark()
    edges = links(nodes)
    # rows with one id are one document: its fingerprints belong together
    repeated = prints.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z")
    same = prints.join(repeated, "id").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    roots = connected_components(edges.unionByName(same), "a", "b")
    clear_scratch(mark, keep=(roots,))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # written, so that the join is split where one root has very many fingerprints
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = rooted.join(least, "root").select("fp", "component_id")
    out = prints.join(named, "fp", "left").select(
        F.col("id").alias(id_col), "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id")
    )
    return out


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id.

    Rows with a null id never link and stay; of rows with the same id one stays.
    """
    mark = scratch_mark()
    found = components(docs, id_col, text_col).where(F.col(id_col).isNotNull())
    firsts = materialize(found.where(F.col(id_col) == F.col("component_id")).groupBy(id_col).count(), "firsts")
    clear_scratch(mark, keep=(firsts,))
    # nearly all ids are kept, so this side is no broadcast but at the smallest inputs; the plan is the same at every size
    kept = docs.join(firsts.select(id_col).hint("merge"), id_col, "left_semi").select(docs.columns)
    if firsts.where("count > 1").limit(1).count():
        kept = kept.dropDuplicates([id_col])
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
