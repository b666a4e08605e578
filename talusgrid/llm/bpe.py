"""Byte-level BPE encoding and decoding with the ``tokenizers`` library.

The rank file becomes a BPE model over the printable byte alphabet: each byte
has one character, each rank is a vocabulary entry, and every way to split an
entry into two earlier ones is a merge at the entry's rank.  Texts are cut by
the pre-tokenizer pattern; the library encodes each distinct cut once per
bounded cache, over Arrow batches.  Decoding maps characters back to bytes, so
a character that several tokens share comes together again.

Defined results: a null text is encoded as the empty text (no tokens, empty
offsets); strings of special tokens are ordinary text; repeated rows give equal
rows; other columns of the input are never read.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pieces


def byte_alphabet() -> list[str]:
    """The character of each byte: itself where printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    table, spare = [], 256
    for b in range(256):
        if b in printable:
            table.append(chr(b))
        else:
            table.append(chr(spare))
            spare += 1
    return table


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class ByteBpe:
    """Encoder and decoder of one rank file; ``cache_pieces`` bounds the remembered cuts."""

    def __init__(self, rank_path: str, pattern: str, cache_pieces: int = 200_000):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(rank_path)
        chars = byte_alphabet()
        spell = lambda raw: "".join(chars[b] for b in raw)
        merges = []
        for raw, rank in sorted(ranks.items(), key=lambda x: x[1]):
            for i in range(1, len(raw)):
                left, right = ranks.get(raw[:i]), ranks.get(raw[i:])
                if left is not None and right is not None and max(left, right) < rank:
                    merges.append((spell(raw[:i]), spell(raw[i:])))
        self.tokenizer = Tokenizer(models.BPE(vocab={spell(k): v for k, v in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.find = regex.compile(pattern).findall
        back = {c: b for b, c in enumerate(chars)}
        size = max(ranks.values()) + 1
        self.bytes_of: list[bytes | None] = [None] * size
        for i in range(size):
            token = self.tokenizer.id_to_token(i)
            if token is not None:
                self.bytes_of[i] = bytes(back[c] for c in token)
        self.cache_pieces = cache_pieces
        self.known: dict[str, bytes] = {}

    def _learn(self, cuts: set[str]) -> None:
        if len(self.known) + len(cuts) > self.cache_pieces:
            self.known.clear()
        order = list(cuts)
        for cut, coded in zip(order, self.tokenizer.encode_batch_fast(order, add_special_tokens=False)):
            self.known[cut] = np.asarray(coded.ids, dtype="<u4").tobytes()

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut = [self.find(t) if t else [] for t in texts]
        missing = {p for ps in cut for p in ps if p not in self.known}
        if missing:
            used = {p for ps in cut for p in ps} if len(self.known) + len(missing) > self.cache_pieces else missing
            self._learn(used)
        known = self.known.__getitem__
        return [b"".join(map(known, ps)) for ps in cut]

    def offsets(self, text: str, ids) -> list[tuple[int, int]]:
        """Character spans of the tokens; tokens inside one character all span it."""
        ends = np.cumsum([0] + [len(c.encode()) for c in text])
        spans, at = [], 0
        for i in ids:
            stop = at + len(self.bytes_of[i])
            spans.append((int(np.searchsorted(ends, at, "right") - 1), int(np.searchsorted(ends, stop, "left"))))
            at = stop
        return spans

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids) -> str:
        """The text; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@cache
def tokenizer(rank_path: str, pattern: str) -> ByteBpe:
    """One instance per worker process."""
    return ByteBpe(rank_path, pattern)


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_offsets: bool = False) -> DataFrame:
    """Per row: the id, ``n_tokens``, ``ids``, digests of ids and decoded bytes, optionally ``offsets``."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        coder = tokenizer(rank_path, pattern)
        for batch in batches:
            for part in pieces(batch, 1, 2 << 20):
                texts = part.column(1).to_pylist()
                packed = coder.encode_packed(texts)
                ids = [np.frombuffer(x, "<u4") for x in packed]
                counts = [len(x) for x in ids]
                columns = {
                    id_col: part.column(0),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(np.concatenate([np.empty(0, "<u4"), *ids]).astype(np.int32))),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in packed]),
                    "decoded_sha256": pa.array([hashlib.sha256(coder.decode_bytes(x.tolist())).hexdigest() for x in ids]),
                }
                if with_offsets:
                    columns["offsets"] = pa.array([[{"start": a, "end": b} for a, b in coder.offsets(t, i)] for t, i in zip(texts, ids)], spans)
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"`{id_col}` {kind}, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema + (", offsets array<struct<start:int,end:int>>" if with_offsets else ""))


def decode(coded: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row of ids: the id column and the decoded ``text``; a null list is the empty text."""
    rows = coded.select(F.col(id_col), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches):
        coder = tokenizer(rank_path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "text": pa.array([coder.decode(x) for x in batch.column(1).to_pylist()], pa.string())})

    return rows.mapInArrow(run, f"`{id_col}` {kind}, text string")
