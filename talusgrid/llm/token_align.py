"""Alignment of two tokenizers' tokens by the byte offsets where both end one.

The ends of a text's A tokens and of its B tokens are two rising lists, and
their merge is cut along the merge path: a binary search on each diagonal finds
where it crosses the path, so that every piece between two diagonals holds the
same number of ends and is merged by itself.  A piece tells the overlaps (ends
that both lists have) inside it; where a diagonal parts an A end from the equal
B end, the two pieces are stitched, and the overlaps in order cut the tokens
into groups.

A space after a character that is not white space begins a new token in both
vocabularies, so a text is the sequence of its words, each led by a space.
Equal words are encoded and merged once in a bounded memory, all new words of a
batch in one merge.  Counts of id pairs over the corpus are summed for batches of
texts first; they come back to a batch, not to a text, and are added up there.
No step holds more than a batch of texts, or one text if that is longer.

Defined results: texts that are null, empty, or not spelt exactly by the tokens
(a text with U+2581, which B reads as a space) have no tokens: zeros and an empty
``groups_sha256``; strings of special tokens are ordinary text; repeated rows
give equal rows and count as often as they stand there; an empty table gives no
rows; other columns of the input are never read.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bpe import byte_alphabet
from .common import materialize, pieces

#: White space before a space, or a space at the end: such texts are cut by the careful pattern.
LOOSE = re.compile(r"\s | $")
#: Spaces between words, but for those that white space precedes and those that end the text.
CUT = re.compile(r"(?<=\S) (?= *[^ ])")
#: How the byte-level vocabulary cuts texts, a fixed value.
A_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ids of B are below this, so that a pair of ids is one long.
SHIFT = 20


def merge_path(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each diagonal crosses the merge path of two rising lists, equal ends of A first."""
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        before = np.zeros(len(diagonals), bool)
        at = middle[open_]
        before[open_] = a[at] <= b[diagonals[open_] - 1 - at]
        low, high = np.where(open_ & before, middle + 1, low), np.where(open_ & ~before, middle, high)
    return low, diagonals - low


def piece_overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ends that both lists of a piece have."""
    at = np.searchsorted(b, a)
    same = np.flatnonzero(b[np.minimum(at, max(len(b) - 1, 0))] == a) if len(b) else np.empty(0, np.int64)
    return same, at[same]


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Places of all common ends: the pieces' own ones and those that a diagonal parts, in order."""
    total = len(a) + len(b)
    diagonals = np.append(np.arange(0, total, piece), total)
    i, j = merge_path(a, b, diagonals)
    in_a, in_b = [], []
    for k in range(len(diagonals) - 1):
        if 0 < i[k] and j[k] < len(b) and a[i[k] - 1] == b[j[k]]:
            in_a.append(i[k : k + 1] - 1)
            in_b.append(j[k : k + 1])
        x, y = piece_overlaps(a[i[k] : i[k + 1]], b[j[k] : j[k + 1]])
        in_a.append(x + i[k])
        in_b.append(y + j[k])
    return np.concatenate([np.empty(0, np.int64), *in_a]), np.concatenate([np.empty(0, np.int64), *in_b])


def words(text: str) -> list[str]:
    """The text in pieces that neither tokenizer's tokens cross, without the space that leads each."""
    return CUT.split(text) if LOOSE.search(text) or text[:1] == " " else text.split(" ")


class Aligner:
    """Both tokenizers and the words met so far: counts, groups as text, linked id pairs."""

    def __init__(self, a_path: str, b_path: str, most_bytes: int = 64 << 20):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = {c: i for i, c in enumerate(byte_alphabet())}
        ranks = {bytes(back[c] for c in token): i for token, i in model["vocab"].items()}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if sorted(merged, key=model["vocab"].__getitem__) != merged:
            raise ValueError("merges must be in the order of the ids that they make")
        # a vocabulary whose merges are in the order of ids is one of ranks, which tiktoken encodes several times faster
        self.a = tiktoken.Encoding("a", pat_str=A_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.a_bytes[i] = raw
        self.b_bytes = [self._b_token(i) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # an id as text with what follows it: more ids of its side, the other side, the next group
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.spelt = {mark: np.array([f"{i}{mark}" for i in range(most)], object) for mark in ",|;"}
        self.digits = np.array([len(str(i)) + 1 for i in range(most)], np.int64)
        self.most_bytes = most_bytes
        self.forget()

    def _b_token(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str | None] = []
        self._counts: list[np.ndarray] = []
        self._codes: list[np.ndarray] = []
        self.held, self.all_spelt = 0, True

    @property
    def full(self) -> bool:
        return self.held > self.most_bytes

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all known words: (A tokens, B tokens, groups), where the word's pairs start, and the pairs."""
        counts = np.concatenate([np.empty((0, 3), np.int64), *self._counts])
        self._counts, codes = [counts], np.concatenate([np.empty(0, np.int64), *self._codes])
        self._codes = [codes]
        return counts, np.concatenate([[0], np.cumsum(counts[:, 2])]), codes

    def encode_a(self, new: list[str]) -> list[np.ndarray]:
        """Tokens of each word with its space; words that end in no white space are encoded as one text."""
        safe = [k for k, w in enumerate(new) if w and not w[-1].isspace()]
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(new)
        if safe:
            ids = np.array(self.a.encode_ordinary(" " + " ".join([new[k] for k in safe])), np.int64)
            stops = np.cumsum([1 + len(new[k].encode()) for k in safe])
            cuts = np.searchsorted(np.cumsum(self.a_size[ids]), stops) + 1
            for k, x, y in zip(safe, np.concatenate([[0], cuts[:-1]]).tolist(), cuts.tolist()):
                out[k] = ids[x:y]
        for k in set(range(len(new))) - set(safe):
            out[k] = np.array(self.a.encode_ordinary(" " + new[k]), np.int64)
        return out

    def learn(self, new: list[str]) -> None:
        """Encode and align words in one merge of all their ends."""
        a_ids, b_ids = self.encode_a(new), self.b.encode(new, num_threads=1)
        a_all, b_all = np.concatenate(a_ids), np.fromiter(chain.from_iterable(b_ids), np.int64)
        raw = (" " + " ".join(new)).encode()
        if not (b"".join(map(self.a_bytes.__getitem__, a_all.tolist())) == raw == b"".join(map(self.b_bytes.__getitem__, b_all.tolist()))):
            spelt = [b"".join(map(self.a_bytes.__getitem__, x.tolist())) == (" " + w).encode() == b"".join(map(self.b_bytes.__getitem__, y)) for w, x, y in zip(new, a_ids, b_ids)]
            odd = [w for w, ok in zip(new, spelt) if not ok]
            self.all_spelt = False
            self._remember(odd, np.zeros((len(odd), 3), np.int64), [None] * len(odd), np.empty(0, np.int64))
            kept = [k for k, ok in enumerate(spelt) if ok]
            if not kept:
                return
            new, a_ids, b_ids = ([x[k] for k in kept] for x in (new, a_ids, b_ids))
            a_all, b_all = np.concatenate(a_ids), np.fromiter(chain.from_iterable(b_ids), np.int64)
        in_a, in_b = overlaps(np.cumsum(self.a_size[a_all]), np.cumsum(self.b_size[b_all]))
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a_ids, b_ids))
        # a word ends where both lists have an end, so its groups are those up to its last token's
        n_groups = np.diff(np.concatenate([[0], np.searchsorted(in_a, np.cumsum(n_a) - 1) + 1]))
        groups = self._spell(a_all, b_all, in_a, in_b, n_groups)
        self._remember(new, np.stack([n_a, n_b, n_groups], 1), groups, (a_all[in_a] << SHIFT) | b_all[in_b])

    def _spell(self, a_all, b_all, in_a, in_b, n_groups) -> list[str]:
        """Each word's groups as text, cut from one text of all."""
        ids = np.concatenate([a_all, b_all])
        last = np.zeros(len(ids), bool)
        last[in_a] = last[len(a_all) + in_b] = True
        of_a = np.arange(len(ids)) < len(a_all)
        # groups in order, in each A's tokens before B's
        place = np.concatenate([2 * np.searchsorted(in_a, np.arange(len(a_all))), 2 * np.searchsorted(in_b, np.arange(len(b_all))) + 1])
        order = np.argsort(place, kind="stable")
        words = np.where(last, np.where(of_a, self.spelt["|"][ids], self.spelt[";"][ids]), self.spelt[","][ids])
        text = "".join(words[order].tolist())
        ends = np.cumsum(self.digits[ids[order]])
        group_ends = ends[np.flatnonzero((last & ~of_a)[order])]
        stops = group_ends[np.cumsum(n_groups) - 1].tolist()
        return [text[x : y - 1] for x, y in zip([0, *stops[:-1]], stops)]

    def _remember(self, words: list[str], counts: np.ndarray, groups: list, codes: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.groups), len(self.groups) + len(words))))
        self.groups += groups
        self._counts.append(counts)
        self._codes.append(codes)
        self.held += 270 * len(words) + 2 * sum(map(len, words)) + sum(len(g) for g in groups if g) + 8 * len(codes)

    def places(self, cut: list[list[str]]) -> list[np.ndarray]:
        """The known words' numbers of each text."""
        new = {w for ws in cut for w in ws if w not in self.known}
        if new:
            self.learn(list(new))
        return [np.fromiter(map(self.known.__getitem__, ws), np.int32, len(ws)) for ws in cut]


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """One instance per worker process."""
    return Aligner(a_path, b_path)


def _ragged(arrays: list[np.ndarray], kind) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum([0] + [len(x) for x in arrays]), np.concatenate([np.empty(0, kind), *arrays])


PARTS = "batch long, doc struct<id:{},n_a:long,n_b:long,n_groups:long,groups_sha256:string>, words binary, codes array<long>, counts array<long>, starts binary, links binary"


def _encode(a_path: str, b_path: str, batch_bytes: int):
    """Rows of texts (their words by number) and of batches (id pairs with counts, and each word's pairs)."""

    def run(batches):
        tool = aligner(a_path, b_path)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        waiting: list[tuple] = []
        size = 0

        def flush():
            nonlocal number
            ids = pa.concat_arrays([x[0] for x in waiting])
            starts, flat = _ragged([w for x in waiting for w in x[1]], np.int32)
            table, pair_starts, all_codes = tool.table()
            used = np.flatnonzero(np.bincount(flat, minlength=len(table)))
            local = np.zeros(len(table), np.int32)
            local[used] = np.arange(len(used))
            flat_local = local[flat]
            sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(table[flat], axis=0)])
            sums = sums[starts[1:]] - sums[starts[:-1]]
            texts = flat.tolist()
            digests = [hashlib.sha256(";".join(map(tool.groups.__getitem__, texts[a:b])).encode()).hexdigest() if b > a else "" for a, b in zip(starts, starts[1:])]
            sizes = table[used, 2]
            link_starts = np.concatenate([[0], np.cumsum(sizes)])
            codes = all_codes[np.repeat(pair_starts[used] - link_starts[:-1], sizes) + np.arange(link_starts[-1])]
            pairs, place = np.unique(codes, return_inverse=True)
            weight = np.repeat(np.bincount(flat_local, minlength=len(used)), np.diff(link_starts))
            counts = np.bincount(place, weights=weight, minlength=len(pairs)).astype(np.int64)
            n = len(ids)
            doc = pa.StructArray.from_arrays([ids, *(pa.array(sums[:, k]) for k in range(3)), pa.array(digests, pa.string())], ["id", "n_a", "n_b", "n_groups", "groups_sha256"])
            for k in range(0, n, 2000):
                part = doc.slice(k, 2000)
                m = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * m, pa.int64()), part, pa.array([flat_local[a:b].tobytes() for a, b in zip(starts[k : k + m], starts[k + 1 : k + m + 1])], pa.binary()), pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())],
                    NAMES,
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.nulls(1, doc.type), pa.nulls(1, pa.binary()), pa.array([pairs], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([link_starts.astype(np.int32).tobytes()], pa.binary()), pa.array([place.astype(np.int32).tobytes()], pa.binary())],
                NAMES,
            )
            number += 1
            waiting.clear()

        for batch in batches:
            for part in pieces(batch, 1, 2 << 20):
                if tool.full:
                    if waiting:
                        yield from flush()
                        size = 0
                    tool.forget()
                texts = part.column(1).to_pylist()
                found = tool.places([words(t) if t else [] for t in texts])
                whole = [x if tool.all_spelt or all(tool.groups[k] is not None for k in set(x.tolist())) else x[:0] for x in found]
                waiting.append((part.column(0), whole))
                size += sum(len(t) for t in texts if t)
                if size > batch_bytes:
                    yield from flush()
                    size = 0
        if waiting:
            yield from flush()

    return run


NAMES = ["batch", "doc", "words", "codes", "counts", "starts", "links"]


def _add_up(batches):
    """Sums of a batch's texts from the counts of its pairs, which come first, and its words' pairs."""
    from .streams import grouped

    n_list, best_list, sums, best = [], [], None, None
    for batch, a, b, same in grouped(batches):
        if not same:
            n_list, best_list, sums = [], [], None
        rows = batch.slice(a, b - a)
        kind = np.asarray(rows.column("kind"))
        pairs = rows.slice(0, int((kind == 0).sum()))
        if len(pairs):
            n_list.append(np.asarray(pairs.column("n")))
            best_list.append(np.asarray(pairs.column("best")))
        if (kind == 1).any():
            own = int(np.flatnonzero(kind == 1)[0])
            starts, links = (np.frombuffer(rows.column(c)[own].as_py(), np.int32) for c in ("starts", "links"))
            total = lambda lists, kind: np.diff(np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, kind), *lists])[links])])[starts])
            sums, best = total(n_list, np.int64), total(best_list, np.int64)
            n_list, best_list = [], []
        docs = rows.slice(int((kind < 2).sum()))
        for k in range(0, len(docs), 2000):
            part = docs.slice(k, 2000)
            found = [np.frombuffer(w, np.int32) for w in part.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), pa.array([int(best[w].sum()) for w in found], pa.int64()), pa.array([int(sums[w].sum()) for w in found], pa.int64())],
                ["doc", "n_best", "count_sum"],
            )


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 16 << 20) -> DataFrame:
    """Per row: the id, token, group and link numbers, what the corpus-wide pair counts say of its links, the groups' digest.

    ``batch_bytes`` of text share one list of id pairs; more makes fewer rows to shuffle and larger batches to hold.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    parts = materialize(rows.mapInArrow(_encode(a_path, b_path, batch_bytes), PARTS.format(kind)), "aligned")
    of_batch = parts.where("doc is null")
    pairs = of_batch.select("batch", F.posexplode(F.arrays_zip("codes", "counts")).alias("place", "pair")).select("batch", "place", F.col("pair.codes").alias("code"), F.col("pair.counts").alias("n"))
    counted = materialize(pairs.groupBy("code").agg(F.sum("n").alias("n")), "pairs")
    b_id = F.col("code").bitwiseAND(F.lit((1 << SHIFT) - 1))
    # at most one row for each id of B's vocabulary
    most = counted.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("most"))
    ranked = counted.withColumn("b_id", b_id).join(F.broadcast(most), "b_id").select("code", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    back = pairs.drop("n").join(ranked, "code").select("batch", F.lit(0).alias("kind"), "place", "n", "best")
    texts = parts.where("doc is not null").select("batch", F.lit(2).alias("kind"), "doc", "words")
    both = back.unionByName(of_batch.select("batch", F.lit(1).alias("kind"), "starts", "links"), allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    sent = both.repartition("batch").sortWithinPartitions("batch", "kind", "place")
    schema = f"doc struct<id:{kind},n_a:long,n_b:long,n_groups:long,groups_sha256:string>, n_best long, count_sum long"
    found = sent.mapInArrow(_add_up, schema)
    return found.select(
        F.col("doc.id").alias(id_col), "doc.n_a", "doc.n_b", "doc.n_groups", F.col("doc.n_groups").alias("n_links"), "n_best", "count_sum", "doc.groups_sha256",
    )
