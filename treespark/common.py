"""Helpers: namespaces, tables written to cut lineage, broadcasts behind a size check."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}


def keys(df: DataFrame, *names: str) -> list[str]:
    """names, after `ck` where df has that namespace column."""
    return [*(["ck"] if "ck" in df.columns else []), *names]


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, one of our own, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own_dir.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="treespark-"))
    return base.rstrip("/")


def written(df: DataFrame, name: str = "table", by: tuple[str, ...] = ()) -> DataFrame:
    """df as a Parquet table in the shared folder, in a folder for each value of by: computed once, and its lineage ends there."""
    return Scratch(df.sparkSession).written(df, name, by)


class Scratch:
    """Written tables that are steps on the way only: dropped as soon as no later step reads them, and packed tightly if asked for.
    Within `with`, Spark also deletes the shuffle files of each write or action at its end, not when the driver next collects garbage."""

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, codec: str | None = None):
        self.spark, self.codec, self.paths = spark, codec, {}

    def __enter__(self) -> Scratch:
        self.before = self.spark.conf.get(self.CLEANUP, None)
        self.spark.conf.set(self.CLEANUP, "true")
        return self

    def __exit__(self, *_) -> None:
        self.spark.conf.set(self.CLEANUP, self.before) if self.before is not None else self.spark.conf.unset(self.CLEANUP)

    def written(self, df: DataFrame, name: str = "table", by: tuple[str, ...] = ()) -> DataFrame:
        path = f"{shared_dir(self.spark)}/treespark/{name}-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(*by)
        (writer.option("compression", self.codec) if self.codec else writer).parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = table, path
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables written here; what is still to be computed must not read them."""
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(table))[1])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows; otherwise df, for a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def decide(*cases: tuple[Column | bool, str], otherwise: str | None = None) -> Column:
    """The text of the first case that holds."""
    chain = reduce(lambda c, x: c.when(x[0], F.lit(x[1])) if c is not None else F.when(x[0], F.lit(x[1])), cases, None)
    return chain.otherwise(F.lit(otherwise))


def null_safe(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join where every name is equal or null on both sides; the names come once, from the left (either, if full)."""
    r = right.select(*[F.col(n).alias(f"__{n}") if n in names else F.col(n) for n in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names])
    out = left.join(r, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__{n}" for n in names])
