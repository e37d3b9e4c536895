"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths written inside each open ``scratch`` block, the innermost block last. Threads have blocks of their own.
_open: ContextVar[tuple[list[tuple[SparkSession, str]], ...]] = ContextVar("open", default=())
#: The temporary folder of local sessions without the setting.
_own: list[str] = []


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path under ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary
    folder; on a cluster executors would each write to their own disks, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="tidepool-"))
        root = _own[0]
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder; its lineage ends there. Inside a ``scratch``
    block the table goes when the block ends."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    if blocks := _open.get():
        blocks[-1].append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, tag: str) -> DataFrame:
    """``written``, but the table stays until the next outer block ends."""
    outer = _open.set(_open.get()[:-1])
    try:
        return written(df, tag)
    finally:
        _open.reset(outer)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are ``written`` inside are deleted at the end. What is to be read later has to
    be computed by then, so the last table of a block is ``kept``."""
    paths: list[tuple[SparkSession, str]] = []
    outer = _open.set((*_open.get(), paths))
    try:
        yield
    finally:
        _open.reset(outer)
        for spark, path in paths:
            delete(spark, path)
