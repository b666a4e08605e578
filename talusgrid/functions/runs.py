"""Runs of equal keys in sorted Arrow batches that stream past."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _cuts(column: pa.Array) -> np.ndarray:
    left, right = column.slice(0, len(column) - 1), column.slice(1)
    same = pc.or_(pc.fill_null(pc.equal(left, right), False), pc.and_(pc.is_null(left), pc.is_null(right)))
    return ~np.asarray(same, dtype=bool)


def grouped(batches, *columns: int) -> Iterator[tuple[pa.RecordBatch, int, int, bool]]:
    """Batch, start and stop of each run of equal values in the columns; the flag tells that the run goes on with the last batch's group."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = np.flatnonzero(np.logical_or.reduce([_cuts(batch.column(c)) for c in columns])) + 1
        stops = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(stops, stops[1:]):
            key = tuple(batch.column(c)[a].as_py() for c in columns)
            yield batch, a, b, last == key
            last = key
