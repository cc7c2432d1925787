"""Work on a stored index that reads and writes what changes touch: merges (H5, S9) and the pruned walk."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..common import written
from ..functions.paths import ancestors_of, parent_of
from ..operators.tree import _child, tree_hash_incremental
from ..schema import DIR
from .snapshots import MAX_DELTAS, VersionExists, add_delta, children_of, compact, latest_manifest

META = ["kind", "size", "mtime_ns", "mode", "content_hash"]
#: How often a merge starts again when another writer commits first.
TRIES = 10


def _delta(spark: SparkSession, root: str, manifest: dict, last: DataFrame) -> DataFrame | None:
    """The rows of the next delta, or None if no change is newer than what the index has."""
    above = last.select("ck", F.coalesce(parent_of(F.col("path")), F.lit("/")).alias("path")).distinct()
    known, _ = children_of(spark, root, above, manifest, gone=True)
    fresh = last.join(known.select("ck", "path", F.col("seq").alias("_seq")), ["ck", "path"], "left")
    fresh = written(fresh.where(F.col("_seq").isNull() | (F.col("seq") > F.col("_seq"))).drop("_seq"), "fresh")
    if fresh.isEmpty():
        return None
    own = fresh.where((F.col("kind") == DIR) | F.col("kind").isNull()).select("ck", "path")
    dirty = written(fresh.select("ck", F.explode(ancestors_of(F.col("path"))).alias("path")).unionByName(own).distinct(), "dirty")
    near, _ = children_of(spark, root, dirty, manifest)
    near = written(near.drop("top"), "near")
    columns = [c for c in StructType.fromJson(manifest["schema"]).fieldNames() if c != "_gone"]
    after = tree_hash_incremental(near, fresh).select(*columns)
    rest = [c for c in columns if c not in ("ck", "path")]
    before = near.select("ck", "path", F.struct(*rest).alias("_old"))
    moved = after.join(before, ["ck", "path"], "left").where(F.col("_old").isNull() | ~F.struct(*rest).eqNullSafe(F.col("_old"))).drop("_old")
    gone = fresh.where("kind is null").select("ck", "path", "seq")
    return moved.withColumn("_gone", F.lit(False)).unionByName(gone.withColumn("_gone", F.lit(True)), allowMissingColumns=True)


def update_index(spark: SparkSession, root: str, changes: DataFrame, streams: dict[str, int] | None = None, max_deltas: int = MAX_DELTAS) -> int:
    """H5 on a stored index: its version after changes (ck, path, seq, meta fields, or kind null for a deleted path; other columns of the index, if
    given, are set too). The greatest seq of a path counts, and one that isn't greater than what the index has for the path, deleted or not, changes
    nothing. Read are the files that can hold children of changed paths' ancestors; written is a delta of the rows that differ. If
    another writer commits meanwhile, the merge starts again on that version."""
    for _ in range(TRIES):
        manifest = latest_manifest(spark, root)
        kind = StructType.fromJson(manifest["schema"])
        if "seq" not in kind.fieldNames():
            manifest = manifest | {"schema": json.loads(kind.add("seq", "long").json())}
        more = [c for c in changes.columns if c in kind.fieldNames() and c not in ("ck", "path", "seq", *META)]
        last = changes.groupBy("ck", "path").agg(F.max("seq").alias("seq"), F.max_by(F.struct(*META, *more), "seq").alias("m"))
        rows = _delta(spark, root, manifest, written(last.select("ck", "path", "seq", "m.*"), "changes"))
        if rows is None:
            return manifest["version"]
        try:
            version = add_delta(spark, root, manifest, rows, streams)
        except VersionExists:
            continue
        if len(manifest["deltas"]) + 1 > max_deltas:
            try:
                version = compact(spark, root)
            except VersionExists:
                pass  # the other writer's merge compacts
        return version
    raise VersionExists(f"{TRIES} other versions came first")


def prune_walk(spark: SparkSession, left: str, right: str, ck: str = "", root: str = "/") -> tuple[DataFrame, DataFrame]:
    """D4 on two stored indexes: (path, left_kind, left_node, right_kind, right_node) below root that differ, and the walk's levels (level,
    opened, visited, rows_read): directories opened, names compared, rows of the files read. A directory is opened only if it differs or is on
    one side only; what is read follows the open directories, not the indexes."""
    sides = {"left": (left, latest_manifest(spark, left)), "right": (right, latest_manifest(spark, right))}
    frontier, found, levels = written(spark.createDataFrame([(ck, root)], "ck string, path string"), "frontier"), [], []
    kinds, nodes = ("left_kind", "right_kind"), ("left_node", "right_node")
    while True:
        seen, rows_read = [], 0
        for name, (at, manifest) in sides.items():
            below, n = children_of(spark, at, frontier, manifest)
            seen.append(below.where("path <> '/'").select("path", F.col("kind").alias(f"{name}_kind"), _child().alias(f"{name}_node")))
            rows_read += n
        same = F.col(kinds[0]).eqNullSafe(F.col(kinds[1])) & F.col(nodes[0]).eqNullSafe(F.col(nodes[1]))
        level = written(seen[0].join(seen[1], "path", "full").select("path", *kinds, *nodes, (~same).alias("differs")), "level")
        levels.append((len(levels), frontier.count(), level.count(), rows_read))
        found.append(level.where("differs").drop("differs"))
        frontier = written(found[-1].where((F.col("left_kind") == DIR) | (F.col("right_kind") == DIR)).select(F.lit(ck).alias("ck"), "path"), "frontier")
        if frontier.isEmpty():
            told = spark.createDataFrame(levels, "level int, opened long, visited long, rows_read long")
            return reduce(DataFrame.unionByName, found), told
