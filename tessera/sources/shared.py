"""The folder that driver and executors share, for tables written on the way."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only on one machine, where it is unset, a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Lists of folders handed out while a ``scratch`` is open, the innermost last.
_open: list[list[str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that ``shared_path`` hands out meanwhile are removed at the end.

    Whatever is to outlive them must be written by then, under a path taken before.
    """
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove(spark, path)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write once to the shared folder and read back: lineage ends, executors may be lost."""
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(df: DataFrame) -> None:
    """Remove a table of ``materialize`` that nothing reads any more."""
    remove(df.sparkSession, df._written_to)
