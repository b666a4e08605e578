"""All places of many names in long texts, by a multi-pattern automaton over Arrow batches.

Names are dealt into blocks of bounded bytes.  A block is collected, sent to the
tasks and made into an automaton once a worker; the texts pass each block's
automaton once, whatever the number of names in it.  Nothing is shuffled.
"""

from __future__ import annotations

import uuid
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: The automaton that this worker made last, by the key of its block.
_BUILT: dict[str, object] = {}


def folded(text: str) -> str:
    """Lower case with the same number of characters, so that places hold in the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(y := x.lower()) != 1 else y for x in text)


def _automaton(shared, key: str):
    import ahocorasick

    if key not in _BUILT:
        found = ahocorasick.Automaton()
        for name in shared.value:
            found.add_word(folded(name), name) if folded(name) not in found else found.add_word(folded(name), min(name, found.get(folded(name))))
        found.make_automaton()
        _BUILT.clear()  # the one before is of another block
        _BUILT[key] = found
    return _BUILT[key]


def places(texts: DataFrame, names: DataFrame, id_col: str, text_col: str, name_col: str, whole_words: bool = True, block_bytes: int = 1 << 20) -> DataFrame:
    """Every place of every name: the id, ``name``, ``start`` and ``stop`` in code points; case does not matter.

    Names of the same letters in other case are one, in the smallest spelling.
    With ``whole_words`` no letter or digit may stand beside the place.  Places may
    overlap.  Null and empty texts and names have none; repeated rows of texts have
    theirs each; ``block_bytes`` of names are searched for at a time.
    """
    listed = names.select(F.col(name_col).cast("string").alias("name")).where("name <> ''").distinct()
    total = listed.agg(F.coalesce(F.sum(F.octet_length("name")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    rows = texts.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    out = None
    for block in range(blocks):
        # the names of one spelling in small letters are in one block; a block has its share of the bytes, as hashes spread
        mine = listed if blocks == 1 else listed.where(F.pmod(F.xxhash64(F.lower("name")), F.lit(blocks)) == block)
        shared = texts.sparkSession.sparkContext.broadcast(sorted(r["name"] for r in mine.collect()))

        def run(batches, shared=shared, key=uuid.uuid4().hex):
            if not shared.value:
                return
            find = _automaton(shared, key)
            for batch in batches:
                for part in _parts(batch):
                    ids, hits = [], []
                    for k, text in enumerate(part.column(1).to_pylist()):
                        if text:
                            low = folded(text)
                            for last, name in find.iter(low):
                                start = last + 1 - len(name)
                                if whole_words and ((start and low[start - 1].isalnum()) or low[last + 1 : last + 2].isalnum()):
                                    continue
                                ids.append(k)
                                hits.append((name, start, last + 1))
                    if hits:
                        name, start, stop = zip(*hits)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(ids)), pa.array(name, pa.string()), pa.array(start, pa.int64()), pa.array(stop, pa.int64())], [id_col, "name", "start", "stop"])

        found = rows.mapInArrow(run, f"`{id_col}` {kind}, name string, start long, stop long")
        out = found if out is None else out.unionByName(found)
    return out


def _parts(batch: pa.RecordBatch, rows: int = 200):
    """A few rows at a time, so that the places of long texts do not pile up."""
    for a, b in pairwise([*range(0, batch.num_rows, rows), batch.num_rows]):
        yield batch.slice(a, b - a)
