"""Cutting lineage between rounds, in the folder that executors share, and settings for a while."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in spark.checkpoint.dir; without it in a temporary folder, if the session runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or _own.setdefault("dir", _own.get("dir") or tempfile.mkdtemp(prefix="crossbook-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def freed_shuffles(spark: SparkSession):
    """While it lasts, Spark removes the shuffle files of each query that has ended, not only those that the driver's garbage collector
    comes upon. For jobs that write each DataFrame once; one that is read again makes its shuffle again."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df written as Parquet in a shared folder and read back: computed once, whichever executors are lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in spark.checkpoint.dir; without it in a temporary folder, if the session runs on one machine."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="crossbook-"))
    return df.checkpoint()
