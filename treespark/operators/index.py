"""Queries over an index: a tree_hash table with last_node and last_content."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import decide, keys, small_side
from ..functions.paths import ancestors_of, filter_prefix
from ..schema import DIR, META_FIELDS
from .tree import _child


def range_meta(index: DataFrame, ck: str, prefix: str) -> DataFrame:
    """I1. prefix and all below it, in path order, of one namespace."""
    return filter_prefix(index.where(F.col("ck") == ck), prefix).select("path", *META_FIELDS).orderBy("path")


def range_dir_nodes(index: DataFrame, ck: str, prefix: str) -> DataFrame:
    """I1, of directories: path and dir_node."""
    return filter_prefix(index.where((F.col("ck") == ck) & (F.col("kind") == DIR)), prefix).select("path", "dir_node").orderBy("path")


def list_children(index: DataFrame, dirs: DataFrame) -> DataFrame:
    """I2. The direct children (dir, name, kind, node) of each directory in dirs (dir)."""
    rows = index.where("path <> '/'").select(F.col("parent").alias("dir"), "name", "kind", _child().alias("node"))
    return rows.join(small_side(dirs.select("dir").distinct()), "dir")


def lookup(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """I3. wanted (path) with the index's facts, null where there is no row."""
    facts = [c for c in ("kind", "size", "mtime_ns", "mode", "content_hash", "node", "dir_node", "last_node", "last_content") if c in index.columns]
    ks = [k for k in keys(index, "path") if k in wanted.columns]
    return wanted.select(*ks).join(index.select(*ks, *facts), ks, "left")


def page_listing(entries: DataFrame, after: str | None = None, budget: int = 262_144) -> DataFrame:
    """I4. One page of each directory's listing (dir, name, kind, node): names past `after` in byte order, as many as
    fit into budget bytes (37 and the name's length each) and one at least, with `more` if names remain."""
    rest = entries if after is None else entries.where(F.col("name") > after)
    order = Window.partitionBy("dir").orderBy("name")
    used = F.sum(F.octet_length("name") + 37).over(order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = rest.withColumns({"used": used, "n": F.row_number().over(order), "all": F.count("*").over(Window.partitionBy("dir"))})
    page = numbered.where((F.col("used") <= budget) | (F.col("n") == 1))
    return page.withColumn("more", F.col("all") > F.count("*").over(Window.partitionBy("dir"))).select(*entries.columns, "used", "more")


def merge_pages(local: DataFrame, page: DataFrame, after: str | None = None) -> DataFrame:
    """I5. Local children against one page (dir, name, kind, node, more) of each directory: names up to `after` are left
    out, and where more follow, local names past the page's end are unknown and left out too."""
    ends = page.groupBy("dir").agg(F.max("name").alias("end"), F.max("more").alias("more"))
    mine = local.select("dir", "name", F.col("kind").alias("local_kind"), F.col("node").alias("local_node"))
    theirs = page.select("dir", "name", F.col("kind").alias("right_kind"), F.col("node").alias("right_node"))
    rows = mine.join(theirs, ["dir", "name"], "full").join(ends, "dir", "left")
    known = ~F.coalesce(F.col("more"), F.lit(False)) | (F.col("name") <= F.col("end"))
    return rows.where(known & (F.lit(True) if after is None else F.col("name") > after)).drop("end", "more")


def drift_report(disk: DataFrame, index: DataFrame) -> DataFrame:
    """I6. disk (path, node) against index (path, node, last_node)."""
    rows = disk.select("path", F.col("node").alias("disk_node")).join(index.select("path", "node", "last_node"), "path", "full")
    mine, held = F.col("disk_node"), F.col("node")
    return rows.select(
        "path",
        decide((mine.isNull(), "index_only"), (held.isNull(), "disk_only"), (mine == held, "match"), otherwise="differ").alias("disk_index"),
        decide((held.isNull(), "no_index"), (F.col("last_node").isNull(), "unset"), (held == F.col("last_node"), "match"), otherwise="differ").alias("index_last_synced"),
    )


def _under_any(df: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(ck, path) of the rows of df at or below one of prefixes (prefix)."""
    ks = keys(df, "path")
    walk = df.select(*ks, F.explode(ancestors_of(F.col("path"), include_self=True)).alias("prefix"))
    return walk.join(small_side(prefixes.select("prefix").distinct()), "prefix", "left_semi").select(*ks).distinct()


def delete_prefix(index: DataFrame, prefixes: DataFrame) -> DataFrame:
    """I7. index without the subtrees at prefixes (prefix)."""
    return index.join(_under_any(index, prefixes), keys(index, "path"), "left_anti")


def delete_entries(index: DataFrame, paths: DataFrame) -> DataFrame:
    """I7. index without single rows."""
    ks = [k for k in keys(index, "path") if k in paths.columns]
    return index.join(paths.select(*ks).distinct(), ks, "left_anti")


def delete_checkout(index: DataFrame, ck: str) -> DataFrame:
    """I7. index without a namespace."""
    return index.where(F.col("ck") != ck)


def overlaps_prefixes(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """I8. paths that must wait for a pending delete of prefixes: covered (skip) or covering (wait)."""
    under = _under_any(paths, prefixes).withColumn("overlap", F.lit("covered"))
    above = prefixes.select(F.explode(ancestors_of(F.col("prefix"))).alias("path")).distinct()
    over = paths.join(above, "path", "left_semi").select("path").distinct().join(under, "path", "left_anti").withColumn("overlap", F.lit("covering"))
    return under.select("path", "overlap").unionByName(over)
