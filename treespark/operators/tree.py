"""Hash trees over tables of paths."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import keys, null_safe, small_side, written
from ..functions.hashing import HashFn, child_entry, list_hash, sha256_hex, with_file_node
from ..functions.paths import ancestors_of, covers, with_path_parts
from ..schema import DIR, FILE, ZERO_HASH

#: A directory of more entries is hashed as a stream of sorted rows, not from one row that holds its list.
WIDE = 100_000
#: The streaming form of a hash function: an object with update() and hexdigest().
Digest = Callable[[], object]

def fill_ancestors(meta: DataFrame, mode: int = 0o40755) -> DataFrame:
    """C13. meta with a directory row for each missing ancestor."""
    ks = keys(meta)
    above = meta.select(*ks, F.explode(ancestors_of(F.col("path"))).alias("path")).distinct()
    new = above.join(meta.select(*ks, "path"), [*ks, "path"], "left_anti")
    row = {"kind": F.lit(DIR), "size": F.lit(0).cast("bigint"), "mtime_ns": F.lit(0).cast("bigint"), "mode": F.lit(mode).cast("bigint"), "content_hash": F.lit(ZERO_HASH)}
    return meta.unionByName(new.withColumns(row), allowMissingColumns=True)


def plan_rehash(listing: DataFrame, prior: DataFrame) -> DataFrame:
    """H2. listing with content_hash and rehash (`reuse` or `hash`): a file keeps its hash if size and mtime agree."""
    ks = keys(listing, "path")
    old = prior.where(F.col("kind") == FILE).select(*ks, F.col("size").alias("_size"), F.col("mtime_ns").alias("_mtime"), F.col("content_hash").alias("_hash"))
    same = (F.col("kind") == FILE) & (F.col("size") == F.col("_size")) & (F.col("mtime_ns") == F.col("_mtime"))
    kept = F.when(F.coalesce(same, F.lit(False)), F.col("_hash"))
    rows = listing.drop("content_hash").join(old, ks, "left")
    return rows.withColumn("content_hash", kept).withColumn("rehash", F.when(kept.isNotNull(), "reuse").otherwise("hash")).drop("_size", "_mtime", "_hash")


def _child() -> Column:
    return F.coalesce(F.when(F.col("kind") == DIR, F.col("dir_node")), F.col("node"))


def _wide(nodes: DataFrame, ks: list[str], digest: Digest | None) -> DataFrame | None:
    """(ck, path) of the directories with more than WIDE entries, or None if there are none."""
    if digest is None:
        return None
    wide = written(nodes.where("parent is not null").groupBy(*ks, F.col("parent").alias("path")).count().where(F.col("count") > WIDE).drop("count"), "wide")
    return None if wide.isEmpty() else wide


def _streamed(children: DataFrame, ks: list[str], digest: Digest) -> DataFrame:
    """(ck, path, dir_node) of the directories of these children: entries come sorted by name and go through the digest one by one."""
    rows = children.select(*ks, F.col("parent").alias("path"), "name", F.unhex(child_entry(F.col("name"), F.col("kind"), F.col("child"))).alias("entry"))
    in_order = rows.repartition(*ks, "path").sortWithinPartitions(*ks, "path", "name")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            done = []
            for *own, entry in zip(*[batch[c].tolist() for c in (*ks, "path", "entry")]):
                if own != key:
                    done += [] if key is None else [(*key, state.hexdigest())]
                    key, state = own, digest()
                state.update(entry)
            yield pd.DataFrame(done, columns=[*ks, "path", "dir_node"])
        yield pd.DataFrame([] if key is None else [(*key, state.hexdigest())], columns=[*ks, "path", "dir_node"])

    return in_order.mapInPandas(run, ", ".join(f"{c} string" for c in (*ks, "path", "dir_node")))


def _roll_up(nodes: DataFrame, hash_fn: HashFn, digest: Digest | None = None) -> DataFrame:
    """(ck, path, dir_node) of the directories of nodes (with path parts); one with a dir_node already keeps it."""
    ks = keys(nodes)
    spark = nodes.sparkSession
    depths = sorted((r[0] for r in nodes.where(F.col("kind") == DIR).select("depth").distinct().collect()), reverse=True)
    wide = _wide(nodes, ks, digest)
    done: list[DataFrame] = []
    below = None  # the directories one level down, with their hashes
    for depth in depths:
        leaves = nodes.where((F.col("depth") == depth + 1) & ((F.col("kind") != DIR) | F.col("dir_node").isNotNull())).select(*ks, "parent", "name", "kind", _child().alias("child"))
        children = leaves if below is None else leaves.unionByName(below.select(*ks, "parent", "name", F.lit(DIR).alias("kind"), F.col("dir_node").alias("child")))
        own = nodes.where((F.col("depth") == depth) & (F.col("kind") == DIR) & F.col("dir_node").isNull()).select(*ks, "path", "parent", "name", F.lit(True).alias("own"))
        large = None
        if wide is not None:
            among = small_side(wide.withColumnRenamed("path", "parent"))
            large = _streamed(children.join(among, [*ks, "parent"], "left_semi"), ks, digest).join(own, [*ks, "path"])
            children, own = children.join(among, [*ks, "parent"], "left_anti"), own.join(small_side(wide), [*ks, "path"], "left_anti")
        entry = F.struct("name", child_entry(F.col("name"), F.col("kind"), F.col("child")).alias("entry"))
        listed = children.select(*ks, F.col("parent").alias("path"), entry.alias("e"))
        # a directory's own row and its children's meet in one shuffle; without children its list is empty
        level = listed.unionByName(own, allowMissingColumns=True).groupBy(*ks, "path")
        hashed = level.agg(list_hash(F.collect_list("e"), hash_fn).alias("dir_node"), F.max("parent").alias("parent"), F.max("name").alias("name"), F.max("own").alias("own"))
        hashed = hashed if large is None else hashed.unionByName(large)
        below = hashed.where("own").drop("own")
        below = written(below, "level")
        done.append(below.select(*ks, "path", "dir_node"))
    out = done[0] if done else spark.createDataFrame([], nodes.select(*ks, "path", "dir_node").schema)
    for level in done[1:]:
        out = out.unionByName(level)
    return out


def _digest_of(hash_fn: HashFn, digest: Digest | None) -> Digest | None:
    return digest or (hashlib.sha256 if hash_fn is sha256_hex else None)


def tree_hash(meta: DataFrame, hash_fn: HashFn = sha256_hex, digest: Digest | None = None) -> DataFrame:
    """H4. meta, missing ancestors included, with node, dir_node and path parts, hashed level by level up to `/`. Directories of more than WIDE
    entries are hashed in bounded memory by digest, the streaming form of hash_fn (known for SHA-256); without one, from one row as others."""
    nodes = with_path_parts(with_file_node(fill_ancestors(meta), hash_fn=hash_fn)).withColumn("dir_node", F.lit(None).cast("string"))
    nodes = written(nodes, "nodes")
    rolled = _roll_up(nodes, hash_fn, _digest_of(hash_fn, digest))
    return nodes.drop("dir_node").join(rolled, keys(meta, "path"), "left")


def tree_hash_incremental(index: DataFrame, changes: DataFrame, hash_fn: HashFn = sha256_hex) -> DataFrame:
    """H5. index (a tree_hash table) after changes (path, meta fields; deleted where kind is null): only the changed
    directories and the ancestors of changes are hashed again; equals a full tree_hash of the changed table. Other columns of
    index stay with their paths, but for those that changes has itself, whose values changed paths take."""
    ks = keys(index)
    path_keys = [*ks, "path"]
    gone = changes.where(F.col("kind").isNull()).select(*path_keys)
    kept = index.join(changes.select(*path_keys), path_keys, "left_anti")
    fresh = changes.where(F.col("kind").isNotNull()).select(*path_keys, "kind", "size", "mtime_ns", "mode", "content_hash")
    table = fill_ancestors(kept.select(*path_keys, "kind", "size", "mtime_ns", "mode", "content_hash").unionByName(fresh))
    dirty = written(
        changes.select(*ks, F.explode(ancestors_of(F.col("path"), include_self=True)).alias("path"))
        .unionByName(gone).distinct().withColumn("_dirty", F.lit(True)), "dirty"
    )
    old = kept.select(*path_keys, F.col("dir_node").alias("_old"))
    nodes = with_path_parts(with_file_node(table, hash_fn=hash_fn)).join(dirty, path_keys, "left").join(old, path_keys, "left")
    nodes = nodes.withColumn("dir_node", F.when(F.col("_dirty").isNull(), F.col("_old"))).drop("_old")
    nodes, touched = written(nodes, "nodes"), dirty.drop("_dirty")
    # children of dirty directories are all that the roll-up reads
    read = nodes.join(touched.withColumnRenamed("path", "parent").withColumn("_p", F.lit(True)), [*ks, "parent"], "left").where("_p or _dirty").drop("_p", "_dirty")
    rolled = _roll_up(read, hash_fn, _digest_of(hash_fn, None)).withColumnRenamed("dir_node", "_new")
    out = nodes.join(rolled, path_keys, "left").withColumn("dir_node", F.coalesce("_new", "dir_node")).drop("_new", "_dirty")
    more = [c for c in index.columns if c not in out.columns]
    if not more:
        return out
    told = [c for c in more if c in changes.columns]
    both = index.select(*path_keys, *more)
    if told:
        new = changes.where(F.col("kind").isNotNull()).select(*path_keys, F.struct(*told).alias("_told"))
        value = lambda c: F.when(F.col("_told").isNotNull(), F.col(f"_told.{c}")).otherwise(F.col(c)).alias(c)
        both = both.join(new, path_keys, "full").select(*path_keys, *[value(c) if c in told else F.col(c) for c in more])
    return out.join(both, path_keys, "left")


def subtree_roots(index: DataFrame, centrals: DataFrame, hash_fn: HashFn = sha256_hex) -> DataFrame:
    """H6. centrals (central) with root: the directory's hash, a leaf's node, or the empty directory's hash."""
    own = index.select(F.col("path").alias("central"), _child().alias("root"))
    return centrals.join(own, "central", "left").withColumn("root", F.coalesce("root", hash_fn(F.lit(b"").cast("binary"))))


def children_hash(index: DataFrame, hash_fn: HashFn = sha256_hex) -> DataFrame:
    """(ck, path, listed): of each directory, the hash over its children's stored hashes."""
    ks = keys(index)
    entry = F.struct("name", child_entry(F.col("name"), F.col("kind"), _child()).alias("entry"))
    below = index.where("path <> '/'").groupBy(*ks, F.col("parent").alias("path")).agg(list_hash(F.collect_list(entry), hash_fn).alias("listed"))
    dirs = index.where(F.col("kind") == DIR).select(*ks, "path")
    return dirs.join(below, [*ks, "path"], "left").withColumn("listed", F.coalesce("listed", hash_fn(F.lit(b"").cast("binary"))))


def verify_tree(index: DataFrame, hash_fn: HashFn = sha256_hex) -> DataFrame:
    """H7. Directories whose stored hash isn't that of their children: path, dir_node, listed."""
    ks = keys(index, "path")
    both = index.where(F.col("kind") == DIR).select(*ks, "dir_node").join(children_hash(index, hash_fn), ks)
    return both.where(~F.col("dir_node").eqNullSafe(F.col("listed")))


def repair_tree(index: DataFrame, hash_fn: HashFn = sha256_hex) -> DataFrame:
    """H8. index with right dir_nodes and `changed`. Where a directory's own list is wrong (its stored hash differs from
    that of its stored children, not just of a change below), its file and link children lose last_node."""
    ks = keys(index)
    path_keys = [*ks, "path"]
    fields = [*path_keys, "kind", "size", "mtime_ns", "mode", "content_hash"]
    right = tree_hash(index.select(*fields), hash_fn).select(*path_keys, F.col("dir_node").alias("_right"))
    wrong = (
        verify_tree(index, hash_fn).select(*path_keys).join(right, path_keys)
        .join(index.select(*path_keys, "dir_node"), path_keys).where(~F.col("dir_node").eqNullSafe(F.col("_right")))
        .select(*ks, F.col("path").alias("parent"), F.lit(True).alias("_own"))
    )
    rows = null_safe(index.join(right, path_keys, "left"), wrong, [*ks, "parent"], "left")
    clear = (F.col("_own") & (F.col("kind") != DIR)) & F.col("last_node").isNotNull()
    changed = ~F.col("dir_node").eqNullSafe(F.col("_right")) | F.coalesce(clear, F.lit(False))
    return (
        rows.withColumn("changed", changed)
        .withColumn("last_node", F.when(F.coalesce(F.col("_own") & (F.col("kind") != DIR), F.lit(False)), None).otherwise(F.col("last_node")))
        .withColumn("dir_node", F.col("_right")).drop("_right", "_own")
    )


def under(prefix: str) -> Column:
    return covers(prefix, F.col("path"))
