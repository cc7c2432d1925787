"""Versioned snapshots of an index (S2): Parquet files named by manifests, written by whole bases and by deltas.

A version is a manifest: one base, the deltas since, the schema, and how far each stream has come. The manifest is written last, so
readers see a version whole or not at all; files are never changed, so older versions stay readable. A base is clustered by the place of
an entry in the tree (namespace, depth, parent), in files of equal size whatever the directory: a hot one is written by many tasks. Beside it
lies a table of its files with the first and last place of each, so the children of some directories are read from the files
that can hold them and no others. A delta holds the changed rows only, a deleted one with `_gone`; the youngest row of a path counts.
Deltas are folded into a new base when there are many (`compact`), so what readers have to put together stays small.
"""

from __future__ import annotations

import json
import os
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..common import small_side, written
from ..functions.paths import covers, depth_of, parent_of, top_of
from ..schema import SCHEMA_VERSION

#: Rows of a base file, about.
FILE_ROWS = 1_000_000
#: A version with more deltas than this is compacted by merges.
MAX_DELTAS = 16
#: Up to so many directories are pushed down to the files' own statistics as a list.
PUSHED = 1000


class VersionExists(RuntimeError):
    """Another writer has committed the version meanwhile."""


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _manifests(spark: SparkSession, root: str) -> list[int]:
    fs, path = _fs(spark, root)
    if not fs.exists(path(f"{root}/manifests")):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path(f"{root}/manifests"))]
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))


def _read_manifest(spark: SparkSession, root: str, version: int) -> dict:
    manifest = json.loads(spark.read.text(f"{root}/manifests/v{version}.json", wholetext=True).first()[0])
    if manifest["schema_version"] > SCHEMA_VERSION:
        raise ValueError(f"snapshot has schema version {manifest['schema_version']}, this library reads {SCHEMA_VERSION} at most")
    return manifest


def latest_manifest(spark: SparkSession, root: str) -> dict | None:
    versions = _manifests(spark, root)
    return _read_manifest(spark, root, versions[-1]) if versions else None


def _commit(spark: SparkSession, root: str, manifest: dict) -> int:
    """Makes the manifest's version current; VersionExists if someone else has made it."""
    fs, path = _fs(spark, root)
    fs.mkdirs(path(f"{root}/manifests"))
    temporary, final = path(f"{root}/manifests/_{uuid.uuid4().hex}.tmp"), path(f"{root}/manifests/v{manifest['version']}.json")
    out = fs.create(temporary, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(temporary, final):
        fs.delete(temporary, False)
        raise VersionExists(f"version {manifest['version']} is there already")
    return manifest["version"]


def place_of(ck: Column, path: Column) -> Column:
    """Where a directory's children lie: sorts by namespace, then depth, then path."""
    return F.concat(ck, F.lit("\t"), F.lpad(depth_of(path).cast("string"), 5, "0"), F.lit("\t"), path)


def _placed(df: DataFrame) -> DataFrame:
    """df with its rows' places; `/` lies before all."""
    up = F.coalesce(parent_of(F.col("path")), F.lit(""))
    return df.withColumns({"top": F.coalesce(top_of(F.col("path")), F.lit("")), "_at": F.when(F.col("path") == "/", F.concat("ck", F.lit("\t"))).otherwise(place_of(F.col("ck"), up))})


def _write_base(df: DataFrame, root: str) -> tuple[str, int]:
    """Writes df clustered by place, and its table of files: the folder and the number of rows."""
    spark, name = df.sparkSession, f"base-{uuid.uuid4().hex}"
    rows = written(_placed(df), "placed")
    n = rows.count()
    files = max(1, -(-n // FILE_ROWS), min(spark.sparkContext.defaultParallelism, n // 64))
    rows.repartitionByRange(files, "_at", "path").sortWithinPartitions("_at", "path").write.parquet(f"{root}/{name}/rows")
    stats = spark.read.schema(rows.schema).parquet(f"{root}/{name}/rows").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("_at").alias("first"), F.max("_at").alias("last"), F.count("*").alias("n"))
    stats.coalesce(1).write.parquet(f"{root}/{name}/files")  # a row a file
    return name, n


def write_snapshot(df: DataFrame, root: str, streams: dict[str, int] | None = None) -> int:
    """Writes df (ck, path, ...) as the next version, a base of its own, and returns its number. streams: the last batch of each
    stream that df holds; those of the version before stay."""
    spark = df.sparkSession
    before = latest_manifest(spark, root)
    data = df.drop("top")
    base, n = _write_base(data, root)
    manifest = {
        "version": (before or {"version": 0})["version"] + 1, "schema_version": SCHEMA_VERSION, "schema": json.loads(data.schema.json()), "base": base, "rows": n, "deltas": [],
        "streams": (before or {}).get("streams", {}) | (streams or {}),
    }
    return _commit(spark, root, manifest)


def _schema(manifest: dict) -> StructType:
    kind = StructType.fromJson(manifest["schema"])
    for name, of in (("top", "string"), ("_at", "string")):
        kind = kind.add(name, of)
    return kind


def _parts(spark: SparkSession, root: str, manifest: dict) -> tuple[DataFrame, DataFrame | None]:
    """The base's rows; and of the deltas the youngest row of each path, with _gone."""
    kind = _schema(manifest)
    base = spark.read.schema(kind).parquet(f"{root}/{manifest['base']}/rows")
    marked = kind if "_gone" in kind.fieldNames() else StructType([*kind.fields]).add("_gone", "boolean")
    young = None
    for i, name in enumerate(manifest["deltas"]):
        rows = spark.read.schema(marked).parquet(f"{root}/{name}").withColumn("_age", F.lit(i))
        young = rows if young is None else young.unionByName(rows)
    if young is not None:
        latest = Window.partitionBy("ck", "path").orderBy(F.desc("_age"))
        young = young.withColumn("_nth", F.row_number().over(latest)).where("_nth = 1").drop("_nth", "_age")
    return base, young


def _whole(base: DataFrame, young: DataFrame | None, gone: bool) -> DataFrame:
    """Base rows that no delta touches, and the deltas' rows; deleted ones only where gone is true, with _gone."""
    if young is None:
        return base.withColumn("_gone", F.coalesce("_gone", F.lit(False)) if "_gone" in base.columns else F.lit(False)) if gone else _living(base)
    old = base.join(small_side(young.select("ck", "path")), ["ck", "path"], "left_anti")
    old = old if "_gone" in old.columns else old.withColumn("_gone", F.lit(False))
    both = old.unionByName(young)
    return both if gone else _living(both)


def _living(rows: DataFrame) -> DataFrame:
    return rows.where(~F.coalesce("_gone", F.lit(False))).drop("_gone") if "_gone" in rows.columns else rows


def read_snapshot(spark: SparkSession, root: str, version: int | None = None, ck: str | None = None, prefix: str | None = None) -> DataFrame:
    """The index of a version (the latest, if not given), of one namespace, at or below prefix: both are pushed down to the files."""
    versions = _manifests(spark, root)
    if not versions:
        raise FileNotFoundError(f"no snapshot at {root}")
    manifest = _read_manifest(spark, root, version or versions[-1])

    def cut(rows: DataFrame | None) -> DataFrame | None:
        if rows is None:
            return None
        rows = rows if ck is None else rows.where(F.col("ck") == ck)
        if prefix is not None:
            rows = rows.where(covers(prefix, F.col("path")))
            rows = rows.where(F.col("top") == prefix.split("/")[1]) if prefix != "/" else rows
        return rows

    return _whole(*map(cut, _parts(spark, root, manifest)), gone=False).drop("_at")


def files_of(spark: SparkSession, root: str, manifest: dict) -> DataFrame:
    """(file, first, last, n) of the base."""
    return spark.read.parquet(f"{root}/{manifest['base']}/files")


def _file_table(spark: SparkSession, root: str, manifest: dict) -> list:
    """files_of in order of places, read once for each base: bases never change."""
    name = f"{root}/{manifest['base']}"
    if name not in _tables:
        _tables[name] = files_of(spark, root, manifest).orderBy("first", "last").collect()  # a row a file: one in a million rows
    return _tables[name]


_tables: dict[str, list] = {}


def _hit(first: list[str], last: list[str], places: Iterable[str]) -> set[int]:
    """The files that can hold rows of these places. Files lie side by side in order of places, so bisection in their bounds finds them."""
    return {i for at in places for i in range(bisect_left(last, at), bisect_right(first, at))}


def children_of(spark: SparkSession, root: str, dirs: DataFrame, manifest: dict | None = None, gone: bool = False) -> tuple[DataFrame, int]:
    """The entries whose parent is in dirs (ck, path), `/` itself too, and how many rows the base's files read for them have. Only files that can hold such
    entries are opened, and of few directories the list goes down to the files' statistics. gone: deleted rows too, with _gone."""
    manifest = manifest or latest_manifest(spark, root)
    if manifest is None:
        raise FileNotFoundError(f"no snapshot at {root}")
    places = dirs.select(F.explode(F.array(place_of(F.col("ck"), F.col("path")), F.concat("ck", F.lit("\t")))).alias("_at")).distinct()
    table = _file_table(spark, root, manifest)
    first, last = [r["first"] for r in table], [r["last"] for r in table]
    some = [r[0] for r in places.limit(PUSHED + 1).collect()]
    if len(some) <= PUSHED:
        told = _hit(first, last, some)
        cut = lambda rows: rows.where(F.col("_at").isin(some))
    else:
        places = written(places, "places")

        def hit(batches):
            yield pd.DataFrame({"i": sorted({i for batch in batches for i in _hit(first, last, batch["_at"])})}, dtype="int64")

        told = {r["i"] for r in places.mapInPandas(hit, "i long").distinct().collect()}
        side = small_side(places)
        cut = lambda rows: rows.join(side, "_at", "left_semi")
    base, young = _parts(spark, root, manifest)
    base = spark.read.schema(base.schema).parquet(*[f"{root}/{manifest['base']}/rows/{table[i]['file']}" for i in sorted(told)]) if told else base.limit(0)
    whole = _whole(cut(base), None if young is None else cut(young), gone)
    return whole.drop("_at"), sum(table[i]["n"] for i in told)


def add_delta(spark: SparkSession, root: str, manifest: dict, rows: DataFrame | None, streams: dict[str, int] | None = None) -> int:
    """Commits rows (the index's columns, and _gone) on top of manifest as the next version."""
    known = StructType.fromJson(manifest["schema"]).fieldNames()
    now = manifest | {"version": manifest["version"] + 1, "streams": manifest["streams"] | (streams or {})}
    if rows is not None:
        name = f"delta-{uuid.uuid4().hex}"
        _placed(rows.select(*[c for c in known if c != "_gone"], "_gone")).write.parquet(f"{root}/{name}")
        now["deltas"] = [*manifest["deltas"], name]
    return _commit(spark, root, now)


def compact(spark: SparkSession, root: str) -> int:
    """Folds the latest version's deltas into a new base. Deleted rows stay as `_gone` ones, so that late changes are still known as late."""
    manifest = latest_manifest(spark, root)
    rows = _whole(*_parts(spark, root, manifest), gone=True).drop("_at", "top")
    base, n = _write_base(rows, root)
    return _commit(spark, root, manifest | {"version": manifest["version"] + 1, "base": base, "rows": n, "deltas": [], "schema": json.loads(rows.schema.json())})


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The name of the stream that keeps its progress in this checkpoint folder; made once."""
    fs, path = _fs(spark, checkpoint)
    kept = path(os.path.join(checkpoint, "stream-id.txt"))
    if not fs.exists(kept):
        fs.mkdirs(path(checkpoint))
        out = fs.create(kept, False)
        out.write(bytearray(uuid.uuid4().hex.encode()))
        out.close()
    return spark.read.text(os.path.join(checkpoint, "stream-id.txt")).first()[0]
