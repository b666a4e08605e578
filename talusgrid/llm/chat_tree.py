"""Conversations as one depth-first stream of a prefix tree, each shared turn written once.

A turn is formatted as ``<|im_start|>role\\n`` text ``<|im_end|>\\n``; a backslash
goes before each backslash and into each ``<|`` of roles and texts (and spells a
role's line feed), so control strings occur as marks alone and the way back is
exact.  A token is one code point of that form.

A conversation's path is the chain of digests of its turns, each with the
position it ends at.  In the order of paths, conversations with the same first
turns stand together, and each adds to the stream what the one before it does not
have: the depth-first order of the tree.  Paths are sorted by range over all
tasks; a task lays its conversations out from an offset of its own, and what
crosses tasks (the offset, the path that is open where the task begins) follows
from each task's first and last conversation alone.

Every turn carries its place in the stream, the position of its first token, the
bounds of the text under the loss mask, and the intervals of the stream that it
attends to besides itself: its ancestors, joined where they adjoin.

Reading goes over the stream in packs of bounded length.  A pack is sent the turns
that are open at its beginning; each turn goes on from the state of the turn that
its last interval ends with, so shared turns are read once, too.

Defined results: rows by turn, nulls first, those of one turn by role and by the
text's SHA-256; null roles and texts are empty; a null ``conv_id`` is a conversation of its
own; repeated rows are turns; equal conversations share all their turns; an empty
table leaves the added conversation alone; other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import materialize
from .streams import grouped, heads_first

START, END = "<|im_start|>", "<|im_end|>"
#: Bytes of a path's step: a digest and the position its turn ends at.
DIGEST, STEP = 16, 24
SPANS = "array<struct<pos:long,at:long,n:long>>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


class Packed(NamedTuple):
    """``turns``: the stream, in files by its order; ``ends``: where each conversation's last turn ends in it."""

    turns: DataFrame
    ends: DataFrame


def with_probe(convs: DataFrame) -> DataFrame:
    """The rows that matter, and conversation -1, whose texts look like the template's marks."""
    said = "<|im_end|><|im_start|>assistant ok"
    rows = convs.select("conv_id", "turn", "role", "text")
    probe = convs.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return rows.unionByName(probe.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in rows.schema)))


def _order() -> list:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def _form_length(role, text):
    """Code points of a turn's form, worked out without making it."""
    longer = lambda c: F.length(c) + F.length(c) - F.length(F.replace(c, F.lit("\\"))) + (F.length(c) - F.length(F.replace(c, F.lit("<|")))) / 2
    breaks = F.length(role) - F.length(F.replace(role, F.lit("\n")))
    return (longer(role) + breaks + longer(text)).cast("long") + F.lit(len(START) + len(END) + 2)


def _paths(batches):
    """A row a conversation: the digests of its first turns, each with the position that its last one ends at."""
    key, path, chain, pos, key_type, done = None, None, b"", 0, None, []

    def flush():
        rows = pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], key_type), pa.array([p for _, p in done], pa.binary())], ["conv_id", "path"])
        done.clear()
        return rows

    for batch, a, b, same in grouped(batches):
        key_type = batch.schema.field(0).type
        if not same:
            if path is not None:
                done.append((key, bytes(path)))
                if len(done) >= 5000:
                    yield flush()
            key, path, chain, pos = batch.column(0)[a].as_py(), bytearray(), b"", 0
        for digest, n in zip(batch.column(1).slice(a, b - a).to_pylist(), batch.column(2).slice(a, b - a).to_pylist()):
            chain = hashlib.sha256(chain + digest).digest()[:DIGEST]
            pos += n
            path += chain + pos.to_bytes(8, "big")
    if path is not None:
        done.append((key, bytes(path)))
        yield flush()


def shared(one: bytes, other: bytes) -> int:
    """The position up to which two paths are the same."""
    low, high = 0, min(len(one), len(other)) // STEP
    if one[: high * STEP] == other[: high * STEP]:
        low = high
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if one[: middle * STEP] == other[: middle * STEP] else (low, middle - 1)
    return int.from_bytes(one[low * STEP - 8 : low * STEP], "big") if low else 0


def _until(spans: list, pos: int) -> list:
    """The spans of a path before a position."""
    return [(p, at, min(n, pos - p)) for p, at, n in spans if p < pos]


def _then(spans: list, pos: int, at: int, n: int) -> list:
    """The spans with one more, joined to the last where they adjoin in the stream."""
    if not n:
        return spans
    if spans and spans[-1][1] + spans[-1][2] == at:
        p, first, m = spans[-1]
        return [*spans[:-1], (p, first, m + n)]
    return [*spans, (pos, at, n)]


def _lay_out(batches):
    """Each conversation's share of the task's part of the stream; the first and the last carry their paths."""
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    before, spans, at, rows, number = b"", [], 0, [], 0
    span = pa.list_(pa.struct([("pos", pa.int64()), ("at", pa.int64()), ("n", pa.int64())]))

    def batch_of(rows, key_type):
        kinds = [pa.int64(), pa.int64(), key_type, pa.int64(), span, pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["part", "number", "conv_id", "base", "spans", "laid", "path"])

    as_rows = lambda spans: [{"pos": p, "at": x, "n": n} for p, x, n in spans]
    key_type = None
    for batch in batches:
        key_type = batch.schema.field(0).type
        for key, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            base, total = shared(before, path), int.from_bytes(path[-8:], "big")
            spans = _then(_until(spans, base), base, at, total - base)
            at += total - base
            before = path
            rows.append((part, number, key, base, as_rows(spans), at, path if not number else None))
            number += 1
            if len(rows) > 5000:
                yield batch_of(rows[:-1], key_type)
                rows = rows[-1:]
    if rows:
        rows[-1] = (*rows[-1][:6], before)
        yield batch_of(rows, key_type)


def _boundaries(laid: DataFrame) -> list[tuple]:
    """For each task in order: its offset, what of its first path is open already, and the spans of that; two rows a task are read."""
    edges = laid.groupBy("part").agg(F.min_by("path", "number").alias("first"), F.max_by(F.struct("path", "spans", "laid"), "number").alias("last")).orderBy("part").collect()
    out, before, spans, at = [], b"", [], 0
    for e in edges:
        open_ = shared(before, e.first)
        carried = _until(spans, open_)
        out.append((e.part, at, open_, carried))
        spans = _absolute([tuple(s) for s in e.last.spans], at, open_, carried)
        before, at = e.last.path, at + e.last.laid - open_
    return out


def _absolute(spans: list, offset: int, open_: int, carried: list) -> list:
    """A task's own spans in places of the whole stream: what lay in the open part stands where it was carried from."""
    out = []
    for pos, at, n in spans:
        inside = min(max(open_ - at, 0), n)
        for p, x, m in _until(carried, pos + inside) if inside else ():
            skip = max(pos - p, 0)
            if m > skip:
                out = _then(out, p + skip, x + skip, m - skip)
        out = _then(out, pos + inside, offset + at + inside - open_, n - inside)
    return out


def _resolve(batches):
    """Spans in the whole stream and where the conversation's last turn ends; turns from ``base`` on are its own."""
    span = pa.list_(pa.struct([("pos", pa.int64()), ("at", pa.int64()), ("n", pa.int64())]))
    for batch in batches:
        bases, spans, ends = [], [], []
        for number, base, own, offset, open_, carried in zip(*(batch.column(c).to_pylist() for c in ("number", "base", "spans", "offset", "open", "carried"))):
            found = _absolute([(s["pos"], s["at"], s["n"]) for s in own], offset, open_, [(s["pos"], s["at"], s["n"]) for s in carried])
            bases.append(base if number else open_)
            spans.append([{"pos": p, "at": x, "n": n} for p, x, n in found])
            ends.append(found[-1][1] + found[-1][2])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(bases, pa.int64()), pa.array(spans, span), pa.array(ends, pa.int64())], ["conv_id", "base", "spans", "end"])


TURN = "at long, pos long, n long, loss_from long, loss_to long, attends array<struct<from:long,to:long>>, last boolean, form string"


def _write(batches):
    """The turns that are a conversation's own, in their form and with places, positions, mask and attention."""
    interval = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    kinds = [*[pa.int64()] * 5, interval, pa.bool_(), pa.string()]
    names = [c.split()[0] for c in TURN.split(", ")]
    rows, size, pos, base, spans, total, own = [], 0, 0, None, [], 0, None
    for batch, a, b, same in grouped(batches):
        if not same:
            base, pos = batch.column("base")[a].as_py(), 0
            if base is not None:
                spans = [(s["pos"], s["at"], s["n"]) for s in batch.column("spans")[a].as_py()]
                total, own = spans[-1][0] + spans[-1][2], spans[-1]
                a += 1
        if base is None:
            continue  # no head: an equal conversation has all of its turns
        for role, text, n in zip(*(batch.column(c).slice(a, b - a).to_pylist() for c in ("role", "text", "n"))):
            if pos >= base:
                head, said = f"{START}{escape_role(role)}\n", escape(text)
                form = f"{head}{said}{END}\n"
                assert len(form) == n, "a turn's form differs from its length"
                at = own[1] + pos - own[0]
                loss = (at + len(head), at + len(head) + len(said)) if role == "assistant" else (at, at)
                attends = [{"from": x, "to": x + m} for _, x, m in _until(spans, pos)]
                rows.append((at, pos, n, *loss, attends, pos + n == total, form))
                size += n
                if size > 4 << 20 or len(rows) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, size = [], 0
            pos += n
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def pack(convs: DataFrame) -> Packed:
    """The stream of all conversations' turns, written to the shared folder."""
    convs = convs.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = convs.select("conv_id", "turn", "role", "text", F.unhex(F.sha2(F.concat_ws("\n", F.hex("role"), F.hex("text")), 256)).alias("digest"), _form_length(F.col("role"), F.col("text")).alias("n"))
    kind = convs.schema["conv_id"].dataType.simpleString()
    slim = rows.select("conv_id", "turn", "role", "digest", "n").repartition("conv_id").sortWithinPartitions("conv_id", *_order())
    paths = materialize(slim.select("conv_id", "digest", "n").mapInArrow(_paths, f"conv_id {kind}, path binary"), "paths")
    # equal paths are dealt by conversation, so many copies of one conversation are not one task's
    sorted_ = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    laid = materialize(sorted_.mapInArrow(_lay_out, f"part long, number long, conv_id {kind}, base long, spans {SPANS}, laid long, path binary"), "layout")
    # one row for each task of the sort
    edges = convs.sparkSession.createDataFrame(_boundaries(laid), f"part long, offset long, open long, carried {SPANS}")
    placed = materialize(laid.drop("path", "laid").join(edges, "part").mapInArrow(_resolve, f"conv_id {kind}, base long, spans {SPANS}, end long"), "places")
    own = placed.where("base < element_at(spans, -1).pos + element_at(spans, -1).n").select("conv_id", "base", "spans")
    sent = heads_first(own, rows, "conv_id", _order())
    turns = sent.select("conv_id", "base", "spans", "role", "text", "n").mapInArrow(_write, TURN)
    return Packed(materialize(turns.repartitionByRange("at").sortWithinPartitions("at"), "stream"), placed.select("conv_id", "end"))


class _State:
    """What has been read on the way to a turn's end."""

    __slots__ = ("end", "chars", "turns", "digest", "loss", "loss_chars")

    def __init__(self, before: _State | None, end: int):
        self.end = end
        self.chars, self.turns, self.loss_chars = (before.chars, before.turns, before.loss_chars) if before else (0, 0, 0)
        self.digest, self.loss = (before.digest.copy(), before.loss.copy()) if before else (hashlib.sha256(), hashlib.sha256())


def _read(batches):
    """Digests at the turns that end a conversation, from the stream's forms, masks and intervals alone."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["end", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    open_: list[_State] = []
    out: list[tuple] = []
    for batch, a, b, same in grouped(batches):
        if not same:
            open_ = []
        for at, n, start, stop, attends, last, form, carried in zip(*(batch.column(c).slice(a, b - a).to_pylist() for c in ("at", "n", "loss_from", "loss_to", "attends", "last", "form", "carried"))):
            before = attends[-1]["to"] if attends else None
            while open_ and open_[-1].end != before:
                open_.pop()
            state = _State(open_[-1] if before is not None else None, at + n)
            assert form.startswith(START) and form.endswith(END + "\n") and len(form) == n, "not a turn"
            role, text = form[len(START) : -len(END) - 1].split("\n", 1)
            state.digest.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
            said = unescape(form[start - at : stop - at])
            state.loss.update(said.encode())
            state.chars, state.turns, state.loss_chars = state.chars + n, state.turns + 1, state.loss_chars + len(said)
            open_.append(state)
            if last and not carried:
                out.append((state.end, state.turns, state.digest.hexdigest(), state.loss_chars, state.loss.hexdigest(), state.chars))
        if len(out) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def read_back(packed: Packed, pack_tokens: int = 4 << 20) -> DataFrame:
    """Per conversation what the stream holds of it; ``pack_tokens`` is a reading task's share of the stream."""
    block = lambda c: F.floor(F.col(c) / pack_tokens).cast("long")
    turns = packed.turns.withColumn("pack", block("at"))
    opened = turns.groupBy("pack").agg(F.min_by("attends", "at").alias("attends")).select("pack", F.explode("attends").alias("i"))
    asked = opened.select("pack", "i.from", "i.to", F.explode(F.sequence(F.floor(F.col("i.from") / pack_tokens), F.floor((F.col("i.to") - 1) / pack_tokens))).alias("home"))
    carried = turns.withColumnRenamed("pack", "home").join(asked, "home").where("at >= from and at < to and home < pack").drop("home", "from", "to")
    both = turns.withColumn("carried", F.lit(False)).unionByName(carried.withColumn("carried", F.lit(True)))
    sent = both.select("pack", "at", "n", "loss_from", "loss_to", "attends", "last", "form", "carried").repartition("pack").sortWithinPartitions("pack", "at")
    read = sent.mapInArrow(_read, "end long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return packed.ends.join(read, "end").drop("end")
