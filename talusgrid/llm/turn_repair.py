"""Repair of a conversation's structure by a cheapest list of edits.

The edit lattice of a conversation has a node for each number of rows read and
each state of the role grammar ``(s?(ua)+)?``.  Two searches of Dijkstra's run
towards each other, one from the start, one from both ends, until no path
through unsettled nodes can be as cheap as the best meeting; by then every node
of every cheapest path is settled by one of them.  Of all cheapest paths the one
with the least audit text is walked: of equal costs neither audit is a prefix of
the other, so the least letter at each node that is still on a cheapest path
gives the least concatenation.

Two passes keep texts out of the search: the first sees a byte a row (the role's
initial and the row's fault) and decides, the second sends the decision ahead of
the rows and hashes the texts as they stream past.  A conversation costs memory
for its codes and its audit, never for its texts.

Defined results: null roles and texts are one space, a null ``turn`` comes first
and a null ``conv_id`` is a conversation of its own; rows of one turn are in
order of role, then of their text's SHA-256; an empty role has an initial
outside the grammar; an empty table gives no rows; columns other than the four
are never read.
"""

from __future__ import annotations

import hashlib
from array import array
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize
from .streams import grouped, heads_first

KEEP, REROLE, DELETE, INSERT, MEND = 0, 3, 4, 3, 3
#: A row's code: the initial's place in ``sua`` or 3, then one bit for each fault.
BLANK, DUPLICATE, TRUNCATED, GONE = 4, 8, 16, 32
#: Grammar: the state after reading s, u or a in a state; states are start, after s, after u, after a.
NEXT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
#: The symbol that may be written in a state: user, or assistant after user.
WRITES = (1, 1, 2, 1)
ROLES = ("", "user", "assistant")
FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
DECIDED = ["conv_id", *(f.split()[0] for f in FACTS.split(", "))]


def _steps(codes: bytes, i: int, q: int):
    """Edges out of a node: letter, cost, rows read, next state."""
    w = WRITES[q]
    after = NEXT[q, w]
    if i < len(codes):
        code = codes[i]
        yield "D", DELETE, i + 1, q
        if not code & (BLANK | DUPLICATE):
            more = MEND if code & TRUNCATED else 0
            kept = NEXT.get((q, code & 3))
            if kept is not None:
                yield "K", KEEP + more, i + 1, kept
            yield "R", REROLE + more, i + 1, after
    yield "I", INSERT, i, after


def _steps_back(codes: bytes, j: int, r: int):
    """Edges into a node: cost, rows read before, state before."""
    before = [q for q in range(4) if NEXT[q, WRITES[q]] == r]
    if j:
        code = codes[j - 1]
        yield DELETE, j - 1, r
        if not code & (BLANK | DUPLICATE):
            more = MEND if code & TRUNCATED else 0
            for (q, symbol), to in NEXT.items():
                if to == r and symbol == code & 3:
                    yield KEEP + more, j - 1, q
            for q in before:
                yield REROLE + more, j - 1, q
    for q in before:
        yield INSERT, j, q


class _Search:
    """One direction: distances, the settled nodes and a heap of (distance, node) packed into integers."""

    def __init__(self, size: int, sources: list[int]):
        self.size, self.far = size, array("q", [-1]) * size
        self.done = bytearray(size)
        self.heap: list[int] = []
        for node in sources:
            self.reach(0, node)

    def reach(self, cost: int, node: int) -> bool:
        if self.done[node] or 0 <= self.far[node] <= cost:
            return False
        self.far[node] = cost
        heappush(self.heap, cost * self.size + node)
        return True

    def top(self) -> int | None:
        while self.heap and self.done[self.heap[0] % self.size]:
            heappop(self.heap)
        return self.heap[0] // self.size if self.heap else None

    def settle(self) -> int:
        node = heappop(self.heap) % self.size
        self.done[node] = 1
        return node


def cheapest(codes: bytes) -> tuple[int, str]:
    """Least cost of the edits that mend the rows of these codes, and the least audit of that cost."""
    n = len(codes)
    size = 4 * (n + 1)
    ahead, back = _Search(size, [0]), _Search(size, [4 * n, 4 * n + 3])
    best = None
    while (f := ahead.top()) is not None and (b := back.top()) is not None and (best is None or f + b <= best):
        one, other = (ahead, back) if f <= b else (back, ahead)
        node = one.settle()
        i, q = divmod(node, 4)
        here = one.far[node]
        edges = ((c, 4 * j + r) for _, c, j, r in _steps(codes, i, q)) if one is ahead else ((c, 4 * j + r) for c, j, r in _steps_back(codes, i, q))
        if other.far[node] >= 0 and (best is None or here + other.far[node] < best):
            best = here + other.far[node]
        for cost, to in edges:
            one.reach(here + cost, to)
            if other.far[to] >= 0 and (best is None or here + cost + other.far[to] < best):
                best = here + cost + other.far[to]
    return best, _least_audit(codes, ahead, back, best)


def _least_audit(codes: bytes, ahead: _Search, back: _Search, best: int) -> str:
    """Mark the settled nodes that lead to a crossing of the best cost, then walk the least letters."""
    good = bytearray(ahead.size)
    todo = []
    for node in range(ahead.size):
        if not ahead.done[node]:
            continue
        i, q = divmod(node, 4)
        here = ahead.far[node]
        if (back.far[node] == 0 and here == best) or (back.done[node] and here + back.far[node] == best) or any(back.done[4 * j + r] and here + c + back.far[4 * j + r] == best for _, c, j, r in _steps(codes, i, q)):
            good[node] = 1
            todo.append(node)
    while todo:
        node = todo.pop()
        for cost, i, q in _steps_back(codes, *divmod(node, 4)):
            before = 4 * i + q
            if ahead.done[before] and not good[before] and ahead.far[before] + cost == ahead.far[node]:
                good[before] = 1
                todo.append(before)
    letters, i, q, spent, n = [], 0, 0, 0, len(codes)
    while not (i == n and q in (0, 3) and spent == best):
        for letter, cost, j, r in sorted(_steps(codes, i, q)):
            to, total = 4 * j + r, spent + cost
            if (back.done[to] and total + back.far[to] == best) or (good[to] and total == ahead.far[to]):
                letters.append(letter)
                i, q, spent = j, r, total
                break
        else:
            raise AssertionError("no cheapest path goes on from here")
    return "".join(letters)


def facts(codes: bytes) -> tuple[int, int, int, int, int, str]:
    """blank, duplicate, truncated, illegal, cost and audit of a conversation's codes."""
    fault = [sum(1 for c in codes if c & bit) for bit in (BLANK, DUPLICATE, TRUNCATED)]
    legal = {(0, 1), (1, 2), (2, 1)}
    illegal = sum(1 for a, b in zip(codes, codes[1:]) if (a & 3, b & 3) not in legal)
    return (*fault, illegal, *cheapest(codes))


def damage(convs: DataFrame) -> DataFrame:
    """The dealt faults; a dropped row stays as ``gone``, so that its conversation is known."""
    space = F.lit(" ")
    rows = convs.select(F.col("conv_id"), F.col("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    fault = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), (fault == 0).alias("gone"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _coded(rows: DataFrame) -> DataFrame:
    """Each row's code beside its conversation, turn, role and text digest; conversations stand whole and in order."""
    first = F.substring("role", 1, 1)
    words = F.regexp_replace("text", "[ \\t\\n\\x0B\\f\\r]+$", "")
    slim = rows.select(
        "conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "gone",
        F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3).alias("initial"),
        (words == "").alias("blank"), (~F.substring(words, -1, 1).isin(".", "!", "?")).alias("cut"),
    ).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "digest").orderBy(F.col("turn").asc_nulls_first())) > 1
    code = F.col("initial") + F.when(F.col("gone"), GONE).when(F.col("blank"), BLANK).when(again, DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(0)
    return slim.select("conv_id", "turn", "role", "digest", code.alias("code")).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest").select("conv_id", "turn", "code")


def _decide(batches):
    """One row a conversation from the codes that stream past; equal codes are searched once in a bounded memory."""
    known: dict[bytes, tuple] = {}
    held = 0
    out: dict[str, list] = {}

    def close(key, codes, least, most, kinds):
        nonlocal held
        codes = bytes(codes)
        if codes not in known:
            if held > 8 << 20:
                known.clear()
                held = 0
            known[codes] = facts(codes)
            held += 2 * len(codes) + 300
        gaps = most - least + 1 - kinds if kinds else 0
        for name, value in zip(DECIDED, (key, gaps, *known[codes])):
            out.setdefault(name, []).append(value)

    def flush():
        table = {name: pa.array(values, pa.string() if name == "audit" else key_type if name == "conv_id" else pa.int64()) for name, values in out.items()}
        out.clear()
        return pa.RecordBatch.from_pydict(table)

    state, key_type = None, None
    for batch, a, b, same in grouped(batches):
        key_type = batch.schema.field(0).type
        if not same:
            if state:
                close(*state)
                if len(out["audit"]) >= 5000 or sum(map(len, out["audit"])) > 4 << 20:
                    yield flush()
            state = [batch.column(0)[a].as_py(), bytearray(), None, None, 0]
        for turn, code in zip(batch.column(1)[a:b].to_pylist(), batch.column(2)[a:b].to_pylist()):
            if code & GONE:
                continue
            state[1].append(code)
            if turn is not None and turn != state[3]:
                state[2] = turn if state[2] is None else state[2]
                state[3] = turn
                state[4] += 1
    if state:
        close(*state)
        yield flush()


class _Repaired:
    """The digest of a repaired conversation, fed with its rows in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0
        self.digest, self.first = hashlib.sha256(), True

    def _write(self, role: str, text: str) -> None:
        self.digest.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self._write(ROLES[WRITES[self.state]], "")
            self.state = NEXT[self.state, WRITES[self.state]]

    def row(self, role: str, text: str) -> None:
        self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self._write(role, text)
            self.state = NEXT[self.state, "sua".index(role[0])]
        elif letter == "R":
            self._write(ROLES[WRITES[self.state]], text)
            self.state = NEXT[self.state, WRITES[self.state]]

    def end(self) -> str:
        self.inserts()
        assert self.at == len(self.audit), "rows and audit differ"
        return self.digest.hexdigest()


def _apply(batches):
    """Each conversation's decision, which leads its rows, with the digest of what the edits leave."""
    now, head, done = None, None, []

    def flush():
        rows = pa.Table.from_batches([h for h, _ in done]).combine_chunks().append_column("repaired_sha256", pa.array([d for _, d in done], pa.string()))
        done.clear()
        return rows.to_batches()

    for batch, a, b, same in grouped(batches):
        if not same:
            if now:
                done.append((head, now.end()))
            head = batch.slice(a, 1).select(DECIDED)
            now = _Repaired(head.column("audit")[0].as_py())
            a += 1
        for role, text in zip(batch.column("role").slice(a, b - a).to_pylist(), batch.column("text").slice(a, b - a).to_pylist()):
            now.row(role, text)
        if len(done) >= 2000:
            yield from flush()
    if now:
        done.append((head, now.end()))
        yield from flush()


def repair(convs: DataFrame) -> DataFrame:
    """Damage, then mend: a row a conversation with its faults, the cost, the audit and the repaired text's digest."""
    rows = damage(convs)
    schema = f"conv_id {convs.schema['conv_id'].dataType.simpleString()}, {FACTS}"
    decided = materialize(_coded(rows).mapInArrow(_decide, schema), "repairs")
    texts = rows.where("not gone").select("conv_id", "turn", "role", "text")
    sent = heads_first(decided, texts, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.sha2("text", 256)])
    return sent.select(*DECIDED, "role", "text").mapInArrow(_apply, f"{schema}, repaired_sha256 string")
