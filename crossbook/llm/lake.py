"""Written tables that cut lineage, in the folder which all executors share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an Arrow batch sent to Python.
BATCH_BYTES = 8 << 20
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where the session has none and runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        base = _own.setdefault("dir", "") or tempfile.mkdtemp(prefix="crossbook-")
        _own["dir"] = base
    return f"{base.rstrip('/')}/crossbook"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df written as Parquet and read back: survives lost executors and is computed once."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _release() -> None:
    """Gives unused memory of the Arrow pool and of the C library back, as workers outlive their tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow for texts: batches of bounded bytes, and memory given back after each task."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return df.mapInArrow(tidy, schema)


def row_id(docs: DataFrame) -> Column | None:
    """A 64-bit name of each row by its file and its place there, if docs is files as read and nothing else; else None."""
    plain = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    return F.xxhash64("_metadata.file_path", "_metadata.row_index") if plain else None


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and the text as binary (null: empty), ready for an Arrow pass."""
    return docs.select(*keep, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def packed(docs: DataFrame, *keep: str) -> DataFrame:
    """docs' rows as one struct column, with the columns named: names that docs has besides can't clash with those made."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *keep)


def unpacked(df: DataFrame, docs: DataFrame, text: Column, changed: Column) -> DataFrame:
    """The rows packed from docs, with their new text and, where it changed, its length in n_chars."""
    new = {"text": text, "n_chars": F.when(changed, F.length(text)).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return df.select(*[(new[c] if new.get(c) is not None else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def schema(df: DataFrame, carry: list[str], made: str) -> T.StructType:
    """The types of carried columns, then the columns of a DDL text."""
    return T.StructType([df.schema[c] for c in carry] + T.StructType.fromDDL(made).fields)
