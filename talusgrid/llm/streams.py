"""Groups of rows that stream past in sorted order, across Arrow batches.

A group is never held: operators on conversations see their rows run by run and
keep what they need of them.  What a first pass finds about a group can be sent
ahead of its rows in a second one (``heads_first``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F


def runs(batch: pa.RecordBatch, column: int = 0) -> Iterator[tuple[int, int]]:
    """Start and stop of each run of equal values; nulls are equal to each other."""
    n = batch.num_rows
    if not n:
        return
    left, right = batch.column(column).slice(0, n - 1), batch.column(column).slice(1)
    same = pc.or_(pc.fill_null(pc.equal(left, right), False), pc.and_(pc.is_null(left), pc.is_null(right)))
    cuts = [0, *(np.flatnonzero(~np.asarray(same, dtype=bool)) + 1).tolist(), n]
    yield from zip(cuts, cuts[1:])


def grouped(batches, column: int = 0) -> Iterator[tuple[pa.RecordBatch, int, int, bool]]:
    """Runs of all batches; the flag tells that the run goes on with the previous one's group."""
    last = None
    for batch in batches:
        for a, b in runs(batch, column):
            key = batch.column(column)[a].as_py()
            yield batch, a, b, last is not None and last[0] == key
            last = (key,)


def heads_first(heads: DataFrame, rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows of both tables by key in one task each, every group led by its heads; ``order`` sorts the rows.

    Columns that one of the tables lacks are null; ``_head`` tells heads from rows.
    """
    both = heads.withColumn("_head", F.lit(True)).unionByName(rows.withColumn("_head", F.lit(False)), allowMissingColumns=True)
    return both.repartition(F.col(key)).sortWithinPartitions(F.col(key), F.col("_head").desc(), *order)
