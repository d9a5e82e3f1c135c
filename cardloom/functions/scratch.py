"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The application's folder below the one in spark.checkpoint.dir.

    Where that setting is missing, a temporary folder is made and set, but on one machine only (local mode): on a
    cluster every executor would write into a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^,]*(,\s*\d+)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-cardloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/cardloom-{spark.sparkContext.applicationId}"


_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What operators write inside the block goes to a folder that is deleted when it ends: results that still read it must
    have been written elsewhere or used by then. Scopes may be nested."""
    path = f"{scratch_dir(spark)}/scope-{uuid.uuid4().hex}"
    before = _scope.set(path)
    try:
        yield
    finally:
        _scope.reset(before)
        delete(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing has been written to, in the innermost open scope."""
    return f"{_scope.get() or scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """The table written as Parquet and read back: cuts lineage and survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
