"""Shared-folder tables: intermediate results that survive the loss of an executor."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is what ``spark.checkpoint.dir`` names. Where that is unset, a cluster is an error: executors
    would each write to a disk of their own. Only a local session (tests) gets a temporary folder,
    which is removed when Python ends.
    """
    named = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError(f"{_KEY} must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="folio-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = "file://" + own
        spark.conf.set(_KEY, named)
    return named.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back, cutting its lineage.

    The table stays until ``clear``, as plans built on it may run at any time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within are removed at the end; what is built on them has to be written before."""
    before = len(_written)
    try:
        yield
    finally:
        _remove(spark, before)


def clear(spark: SparkSession) -> None:
    """Remove the tables written so far; results not yet run or written are lost with them."""
    _remove(spark, 0)


def _remove(spark: SparkSession, keep: int) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while len(_written) > keep:
        where = jvm.org.apache.hadoop.fs.Path(_written.pop())
        where.getFileSystem(conf).delete(where, True)


def _clear_at_exit() -> None:
    try:
        spark = SparkSession.getActiveSession()
        if spark is not None:
            clear(spark)
    except Exception:  # noqa: BLE001 - the session may be gone; the folder then belongs to its owner
        pass


atexit.register(_clear_at_exit)
