"""Helpers the operators share: tables written to cut lineage, and broadcasts behind a size check."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset (tests), one of our own, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own_dir.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="treespark-"))
    return base.rstrip("/")


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/treespark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of at most `size` bytes from now on, so that Python workers' memory doesn't follow the texts' length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def release_memory() -> None:
    """Gives freed memory back to the system, at a task's end: Python workers live on and serve other stages."""
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it keeps what it has


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """df (a written table) with a broadcast hint if it has at most max_rows rows; otherwise df, and
    Spark shuffles both sides and splits hot keys."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def clear_of(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have yet."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = "_" + name
    return name


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))
