"""Turns of dialogues: neighbours, blocks, windows, chunks and relabelling.

Turn tables have a dialogue key, an index, a speaker and a text.  Everything is
partitioned by the dialogue; only the packing fold needs Python, per dialogue.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def by_turn(key: str, index: str):
    return Window.partitionBy(key).orderBy(index)


def segment_times(turns: DataFrame, key: str, index: str, start: Column, last_seconds: int = 5) -> DataFrame:
    """``start``, ``end`` (the next turn's start, for the last a few seconds on) and ``duration``, never negative."""
    rows = turns.withColumn("start", start)
    end = F.coalesce(F.lead("start").over(by_turn(key, index)), F.col("start") + last_seconds)
    rows = rows.withColumn("end", F.greatest("start", end))
    return rows.withColumn("duration", F.col("end") - F.col("start"))


def grep(turns: DataFrame, key: str, index: str, speaker: str, text: str, pattern: str, who: str | None = None, most: int = 50) -> DataFrame:
    """Turns that match, with the turns beside them; context is taken before filtering, order is key and index."""
    shown = F.concat(F.lit("["), F.col(speaker), F.lit("]: "), F.col(text))
    w = by_turn(key, index)
    rows = turns.withColumn("before", F.lag(shown).over(w)).withColumn("after", F.lead(shown).over(w))
    hit = F.rlike(text, F.lit(f"(?i){pattern}"))
    if who:
        hit = hit & F.contains(F.lower(speaker), F.lit(who.lower()))
    return rows.where(hit).orderBy(key, index).limit(min(most, 200))


def islands(rows: DataFrame, key: str, index: str, starts_new: Column) -> DataFrame:
    """``island``: a number within the key that grows where ``starts_new`` holds."""
    flag = F.when(F.coalesce(starts_new, F.lit(True)), 1).otherwise(0)
    rows = rows.withColumn("_new", flag)
    return rows.withColumn("island", F.sum("_new").over(by_turn(key, index))).drop("_new")


def speaker_blocks(turns: DataFrame, key: str, index: str, speaker: str, start: str, end: str, most_gap: float = 4) -> DataFrame:
    """Runs of turns of one speaker with adjacent indices and small gaps: first, last, speaker, start, end, n."""
    w = by_turn(key, index)
    before = lambda c: F.lag(c).over(w)
    new = (before(speaker) != F.col(speaker)) | (before(index) != F.col(index) - 1) | (F.col(start) - before(end) > most_gap) | before(index).isNull()
    marked = turns.withColumn("_starts", new)
    found = islands(marked, key, index, F.col("_starts"))
    return found.groupBy(key, "island", speaker).agg(F.min(index).alias("first"), F.max(index).alias("last"), F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n"))


def segments(turns: DataFrame, key: str, index: str, inside: Column, most_gap: int = 6, least: int = 2) -> DataFrame:
    """Stretches around rows where ``inside`` holds, split where their indices are more than ``most_gap`` apart.

    ``first`` to ``last`` (inclusive, one turn more than the last such row, as far
    as the dialogue goes) and the number of turns, at least ``least``.
    """
    top = turns.groupBy(key).agg(F.max(index).alias("_top"))
    rows = turns.where(inside)
    gap = F.col(index) - F.lag(index).over(by_turn(key, index))
    marked = rows.withColumn("_gap", gap)
    found = islands(marked, key, index, F.col("_gap") > most_gap)
    out = found.groupBy(key, "island").agg(F.min(index).alias("first"), F.max(index).alias("last")).join(top, key)
    out = out.withColumn("last", F.least(F.col("last") + 1, F.col("_top"))).withColumn("n", F.col("last") - F.col("first") + 1)
    return out.where(F.col("n") >= least).select(key, "island", "first", "last", "n")


def hit_windows(turns: DataFrame, key: str, index: str, text: str, pattern: str, offset: int = 2000) -> DataFrame:
    """For each matching turn the texts from the turn before to the turn after, numbered from ``offset``."""
    w = by_turn(key, index)
    joined = F.concat_ws("\n", F.lag(text).over(w), F.col(text), F.lead(text).over(w))
    rows = turns.withColumn("window", joined).where(F.rlike(text, F.lit(pattern)))
    return rows.withColumn("number", F.row_number().over(w) - 1 + offset)


def batches(turns: DataFrame, key: str, index: str, size: int, overlap: int) -> DataFrame:
    """Batches of ``size`` turns, each starting ``overlap`` turns before the end of the last: key, batch, first, last."""
    stride = size - overlap
    n = turns.groupBy(key).agg(F.count("*").alias("n"), F.min(index).alias("_low"))
    count = F.when(F.col("n") <= size, 1).otherwise(F.ceil((F.col("n") - size) / stride) + 1).cast("int")
    rows = n.select(key, "n", "_low", F.explode(F.sequence(F.lit(0), count - 1)).alias("batch"))
    first = F.col("_low") + F.col("batch") * stride
    return rows.select(key, "batch", first.alias("first"), (F.least(first + size, F.col("_low") + F.col("n")) - 1).alias("last"))


def next_unassigned(turns: DataFrame, key: str, index: str, open_turn: Column, current: int) -> DataFrame:
    """Per dialogue the first open turn after ``current``, else the first at all, else null."""
    after = F.min(F.when(open_turn & (F.col(index) > current), F.col(index)))
    return turns.groupBy(key).agg(F.coalesce(after, F.min(F.when(open_turn, F.col(index)))).alias("next"))


def relabel(turns: DataFrame, speaker: str, where: Column, name: str) -> DataFrame:
    return turns.withColumn(speaker, F.when(where, F.lit(name.strip())).otherwise(F.col(speaker)))


def packed(turns: Iterable[tuple[int, int]], most: int = 2000, carry: int = 200) -> Iterator[tuple[int, int, int]]:
    """(first, last, total size) of chunks of (index, size), packed in order while they fit ``most``.

    When the next turn does not fit, the chunk ends, and the next chunk begins
    with as many of its last turns as reach ``carry``.  A turn that is too large
    alone is a chunk with what is carried.
    """
    held, total = [], 0
    for turn in turns:
        if held and total + turn[1] > most:
            yield held[0][0], held[-1][0], total
            back, total = len(held), 0
            while back > 1 and total < carry:
                back -= 1
                total += held[back][1]
            held = held[back:]
        held.append(turn)
        total += turn[1]
    if held:
        yield held[0][0], held[-1][0], total


def pack_turns(sizes: list[int], most: int = 2000, carry: int = 200) -> list[tuple[int, int]]:
    """Ranges [first, last] of turns packed in order."""
    return [(first, last) for first, last, _ in packed(enumerate(sizes), most, carry)]


def _fold(rows: DataFrame, key: str, index: str, fold: Callable[[Iterator[tuple]], Iterable[tuple]], columns: str) -> DataFrame:
    """The key and ``columns`` that ``fold`` makes of each dialogue's other columns, in the order of ``index``.

    Dialogues arrive sorted and are folded as they come, so none is held as a whole.
    """
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, {columns}"
    spread = rows.repartition(F.col(key)).sortWithinPartitions(key, index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = []

        def turns():
            for batch in batches:
                types[:] = [batch.schema.field(0).type]
                yield from zip(*(c.to_pylist() for c in batch.columns))

        def made():
            for k, group in groupby(turns(), itemgetter(0)):
                for row in fold(x[1:] for x in group):
                    yield (k, *row)

        out = made()
        while found := list(islice(out, 10_000)):
            first, *rest = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(first, types[0]), *map(pa.array, rest)], names=[key, *(c.split()[0] for c in columns.split(", "))])

    return spread.mapInArrow(run, schema)


def pack(turns: DataFrame, key: str, index: str, size: Column, most: int = 2000, carry: int = 200) -> DataFrame:
    """Chunks of whole turns per dialogue: key, chunk, first, last, tokens.  A null size counts as none."""
    rows = turns.select(key, F.col(index).cast("long").alias("_i"), F.coalesce(size, F.lit(0)).alias("_size"))
    return _fold(rows, key, "_i", lambda x: ((n, *chunk) for n, chunk in enumerate(packed(x, most, carry))), "chunk long, first long, last long, tokens long").withColumn("chunk", F.col("chunk").cast("int"))


def passages(turns: DataFrame, key: str, index: str, text: str, markers: str, nouns: tuple[str, ...], width: int = 15, least_nouns: int = 2) -> DataFrame:
    """Windows of ``width`` turns with a marker and at least ``least_nouns`` of the nouns, tightened to the turns that have one.

    Windows of a dialogue that overlap an earlier accepted one are passed over;
    one turn is added at both ends.
    """
    hit = F.rlike(text, F.lit(markers))
    noun = F.lit(0)
    for x in nouns:
        noun = noun + F.contains(F.lower(text), F.lit(x)).cast("int")
    rows = turns.select(key, F.col(index).cast("long").alias("_i"), F.coalesce(hit, F.lit(False)).alias("_m"), F.coalesce(noun, F.lit(0)).alias("_n"))

    def found(group: Iterator[tuple[int, bool, int]]) -> Iterator[tuple[int, int]]:
        before, held = [], []  # the turn before the window, the window and the turn after it
        while True:
            held += islice(group, width + 1 - len(held))
            if not held:
                return
            window, step = held[:width], 1
            if any(m for _, m, _ in window) and sum(n for *_, n in window) >= least_nouns:
                scoring = [i for i, (_, m, n) in enumerate(window) if m or n]
                reach = [*before, *held]
                first, last = max(scoring[0] - 1 + len(before), 0), min(scoring[-1] + 1, len(held) - 1) + len(before)
                if last > first:
                    yield reach[first][0], reach[last][0]
                step = scoring[-1] + 2
            before, held = held[step - 1 : step], held[step:]

    return _fold(rows, key, "_i", found, "first long, last long")


def synopsis(turns: DataFrame, key: str, index: str, speaker: str, text: str, host: str, least: int = 150, follow: int = 5, stop: str = "or will") -> DataFrame:
    """The host's first long turn with up to ``follow`` host turns after it, until one contains ``stop``; cut at a question mark."""
    host_turns = turns.where(F.col(speaker) == host)
    n = F.row_number().over(by_turn(key, index))
    rows = host_turns.withColumn("_n", n)
    first = rows.where(F.length(text) > least).groupBy(key).agg(F.min("_n").alias("_first"))
    rows = rows.join(first, key).where((F.col("_n") >= F.col("_first")) & (F.col("_n") <= F.col("_first") + follow))
    ended = F.coalesce(F.max(F.contains(F.lower(text), F.lit(stop)).cast("int")).over(by_turn(key, index).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = rows.withColumn("_ended", ended).where("_ended = 0")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(text).alias("t")))), lambda x: x["t"]), " ")
    return kept.groupBy(key).agg(F.substring_index(joined, "?", 1).alias("synopsis"))


def visible(turns: DataFrame, speaker: str, text: str, start: Column, who: str, first: float, last: float, short: int = 2) -> DataFrame:
    """One speaker's turns that start within [first, last] and are longer than an interjection of ``short`` words."""
    words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    return turns.where((F.col(speaker) == who) & (words > short) & start.between(first, last))


def relabel_label(turns: DataFrame, keys: list[str], speaker: str, old: str, new: str, excluded: DataFrame, shown: Column) -> DataFrame:
    """Every turn labelled ``old`` gets the label ``new``, but for excluded turns and those not shown; ``was`` keeps the old one for undoing."""
    marked = turns.join(excluded.select(*keys, F.lit(True).alias("_out")), keys, "left")
    hit = (F.col(speaker) == old) & F.col("_out").isNull() & shown
    return marked.withColumn("was", F.when(hit, F.col(speaker))).withColumn(speaker, F.when(hit, F.lit(new.strip())).otherwise(F.col(speaker))).drop("_out")
