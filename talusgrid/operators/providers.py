"""Seams for outside services, with deterministic offline stand-ins.

A provider is a callable over a list of texts; it runs once per Arrow batch.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

Embedder = Callable[[list[str]], np.ndarray]


def hashed_embedder(width: int = 64) -> Embedder:
    """Unit vectors of signed, hashed word counts; a text without words is the zero vector."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % width] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return embed


def with_retries(call: Embedder, tries: int = 3, wait: float = 1.0) -> Embedder:
    """Waits longer after each failure; a batch that keeps failing is halved, a single text that does raises."""

    def run(texts: list[str]) -> np.ndarray:
        for attempt in range(tries):
            try:
                return call(texts)
            except Exception:
                if attempt + 1 < tries:
                    time.sleep(wait * 2**attempt)
                elif len(texts) <= 1:
                    raise
        half = len(texts) // 2
        return np.concatenate([run(texts[:half]), run(texts[half:])])

    return run


def embed(rows: DataFrame, text: str, embedder: Embedder, batch: int = 100) -> DataFrame:
    """``rows`` with ``embedding``; nulls are embedded as empty texts."""
    at = rows.columns.index(text)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                vectors = embedder([x or "" for x in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors.astype(np.float32).tolist(), pa.list_(pa.float32()))], names=[*part.schema.names, "embedding"])

    return rows.mapInArrow(run, rows.withColumn("embedding", F.array().cast("array<float>")).schema)


def templated_answer(results: DataFrame, most: int = 15) -> DataFrame:
    """An answer per query that lists its first sources; stands in for a written answer."""
    top = results.where(F.col("rank") <= most)
    lines = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("title")).alias("line"))))
    return top.groupBy("query_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("answer"))
