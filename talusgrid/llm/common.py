"""Helpers shared by the corpus operators: reading, hold-out keys, scratch tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The white space that separates words: space, tab, \n, \v, \f, \r.
SPACES = " \t\n\x0b\f\r"
#: Java pattern of the same set, for split().
SPACE_RUN = "[ \\t\\n\\x0B\\f\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``; null stays null."""
    return F.crc32(F.col(column).cast("string")) % F.lit(modulus)


def held_out(column: str, modulus: int, remainder: int) -> Column:
    """True where the key's crc32 leaves ``remainder``; a null key is not held out."""
    return F.coalesce(crc_mod(column, modulus) == remainder, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only a local master may do without, with a folder of this run."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_folder()
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_LOCAL: list[str] = []
#: Scratch paths that are still there; what lazy results read is removed when the driver ends.
_MADE: list[str] = []


def _local_folder() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="spark-scratch-"))
    return _LOCAL[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    This cuts the lineage in a way that outlives lost executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`materialize` made and nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path in _MADE:
        _remove(path)


def scratch_mark() -> int:
    """A place in the order in which scratch paths are made, for :func:`clear_scratch`."""
    return len(_MADE)


def clear_scratch(since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete what was made since a mark but for the tables to keep; results that still read the rest become unreadable."""
    kept = {getattr(df, "_scratch_path", None) for df in keep}
    for path in _MADE[since:]:
        if path not in kept:
            _remove(path)


def _remove(path: str) -> None:
    jvm = SparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(jvm.org.apache.spark.deploy.SparkHadoopUtil.get().conf()).delete(target, True)
    _MADE.remove(path)


def _at_exit() -> None:
    try:
        clear_scratch()
    except (Py4JError, OSError, AttributeError):
        pass  # the JVM is gone; nothing can be removed from here


atexit.register(_at_exit)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list:
    """A text column's values as UTF-8 bytes; null is empty."""
    values = column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column.cast(pa.binary())
    return [x or b"" for x in values.to_pylist()]


def pieces(batch: pa.RecordBatch, column: int, most_bytes: int = 8 << 20):
    """Slices of a batch with about ``most_bytes`` of text each, so that Python lists stay small."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    if not len(lengths):
        return
    part = (np.cumsum(lengths) - lengths) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def default_parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
