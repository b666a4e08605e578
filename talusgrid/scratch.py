"""Scratch tables in the folder that all executors share; they are removed when nothing reads them any more, at the latest when the driver ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; only a local master may do without, with a folder of this run."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="spark-scratch-"))
        base = _LOCAL[0]
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base.rstrip("/")


_LOCAL: list[str] = []
_MADE: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """``df``, worked out once and kept in the shared folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove settled tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path in _MADE:
            remove(path)


def remove(path: str) -> None:
    jvm = SparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(jvm.org.apache.spark.deploy.SparkHadoopUtil.get().conf()).delete(target, True)
    _MADE.remove(path)


def _at_exit() -> None:
    for path in list(_MADE):
        try:
            remove(path)
        except (Py4JError, OSError, AttributeError):
            return  # the JVM is gone; nothing can be removed from here


atexit.register(_at_exit)
