"""Differences of inventories and plans made from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import decide, keys, small_side, written
from ..functions.hashing import HashFn, sha256_hex
from ..functions.paths import ancestors_of, covers, depth_of, filter_prefix, top_of
from ..schema import DIR, META_FIELDS, RESERVED
from .ordered import numbered
from .tree import _child, subtree_roots, tree_hash, tree_hash_incremental


def _struct(df: DataFrame, fields: list[str], name: str) -> DataFrame:
    return df.select("path", F.struct(*fields).alias(name))


def diff_trees(source: DataFrame, target: DataFrame, prefix: str = "/") -> DataFrame:
    """D1. path and action (Copy, Replace, Delete) that turn target into source, in path order."""
    s, t = (_struct(filter_prefix(x, prefix), META_FIELDS, n) for x, n in ((source, "s"), (target, "t")))
    action = decide((F.col("t").isNull(), "Copy"), (F.col("s").isNull(), "Delete"), (~F.col("s").eqNullSafe(F.col("t")), "Replace"))
    return s.join(t, "path", "full").select("path", action.alias("action")).where("action is not null").orderBy("path")


def preview_pulls(source: DataFrame, target: DataFrame) -> DataFrame:
    """D2. What a pull would do to target: delete, or replace where hashes differ and not both are directories."""
    s, t = (x.select("path", F.col("kind").alias(f"{n}_kind"), _child().alias(n)) for x, n in ((source, "s"), (target, "t")))
    both_dirs = (F.col("s_kind") == DIR) & (F.col("t_kind") == DIR)
    rows = s.join(t, "path", "full")
    action = decide((F.col("s_kind").isNull(), "delete"), (F.col("t_kind").isNull(), None), (~F.col("s").eqNullSafe(F.col("t")) & ~both_dirs, "replace"))
    return rows.select("path", action.alias("action")).where("action is not null").orderBy("path")


def compare_roots(left: DataFrame, right: DataFrame, checkouts: DataFrame, hash_fn: HashFn = sha256_hex) -> DataFrame:
    """D3. checkouts (checkout, central) with left_root, right_root and matched. With a column path, the reported path's roots are compared, and
    path_error is `EscapesRoot` (roots and matched null) for a path that isn't at or below its checkout's central."""
    at = "path" if "path" in checkouts.columns else "central"
    wanted = checkouts.select(F.col(at).alias("central")).distinct()
    l, r = (subtree_roots(x, wanted, hash_fn).select(F.col("central").alias(at), F.col("root").alias(n)) for x, n in ((left, "left_root"), (right, "right_root")))
    rows = checkouts.join(l, at).join(r, at)
    rows = rows.withColumn("matched", F.col("left_root").eqNullSafe(F.col("right_root")))
    if at == "central":
        return rows
    inside = covers(F.col("central"), F.col("path"))
    rows = rows.withColumns({c: F.when(inside, F.col(c)) for c in ("left_root", "right_root", "matched")})
    return rows.withColumn("path_error", F.when(~inside, F.lit("EscapesRoot")))


def prune_diff(left: DataFrame, right: DataFrame, root: str = "/") -> DataFrame:
    """D4. (path, left_kind, left_node, right_kind, right_node) below root that differ, found from the top: only
    directories that differ, or are on one side, are opened. A round costs one look at the open directories' children."""
    sides = [x.select(F.col("parent"), "path", F.col("kind").alias(f"{n}_kind"), _child().alias(f"{n}_node")) for x, n in ((left, "left"), (right, "right"))]
    frontier, found = left.sparkSession.createDataFrame([(root,)], "parent string"), []
    while True:
        seen = [s.where("path <> '/'").join(small_side(frontier), "parent") for s in sides]
        level = seen[0].join(seen[1].drop("parent"), "path", "full")
        kinds, nodes = ("left_kind", "right_kind"), ("left_node", "right_node")
        same = F.col(kinds[0]).eqNullSafe(F.col(kinds[1])) & F.col(nodes[0]).eqNullSafe(F.col(nodes[1]))
        level = written(level.where(~same).select("path", *kinds, *nodes), "level")
        found.append(level)
        frontier = level.where((F.col("left_kind") == DIR) | (F.col("right_kind") == DIR)).select(F.col("path").alias("parent"))
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, found)


def _sides(left: DataFrame, right: DataFrame, synced: DataFrame) -> DataFrame:
    ks = keys(left, "path")
    l = left.select(*ks, F.col("kind").alias("l_kind"), _child().alias("l_child"), F.col("node").alias("l_node"))
    r = right.select(*ks, F.col("kind").alias("r_kind"), _child().alias("r_child"))
    return l.join(r, ks, "full").join(synced.select(*ks, "last_node"), ks, "left")


def _three_way() -> Column:
    left, right = F.col("l_kind").isNotNull(), F.col("r_kind").isNotNull()
    both, last, mine = left & right, F.col("last_node"), F.col("l_node")
    kinds = F.col("l_kind").eqNullSafe(F.col("r_kind"))
    return decide(
        (both & kinds & F.col("l_child").eqNullSafe(F.col("r_child")), "Matched"),
        (both & kinds & (F.col("l_kind") == DIR), "Recurse"),
        (both & ~kinds, "kinds"),
        (~left, "Pull"),
        (~right & last.isNotNull() & ~mine.eqNullSafe(last), "AnnounceCas"),
        (~right, "AnnounceCreate"),
        (last.isNotNull() & mine.eqNullSafe(last), "Pull"),
        otherwise="AnnounceCas",
    )


def _settled(action: Column) -> Column:
    free = F.col("last_node").isNull() | F.col("l_node").eqNullSafe(F.col("last_node"))
    return F.when(action == "kinds", F.when(free, "Pull").otherwise("AnnounceCas")).otherwise(action)


def reconcile(left: DataFrame, right: DataFrame, synced: DataFrame) -> DataFrame:
    """D5. path and action of a three-way comparison with the last agreed state (path, last_node)."""
    rows = _sides(left, right, synced)
    return rows.select(*keys(rows, "path"), _settled(_three_way()).alias("action"))


def reconcile_under(left: DataFrame, right: DataFrame, synced: DataFrame, epochs: DataFrame) -> DataFrame:
    """D6. D5, but at and below a restored prefix in epochs (prefix) the right side has authority."""
    rows = _sides(left, right, synced)
    hits = rows.select("path", F.explode(ancestors_of(F.col("path"), include_self=True)).alias("prefix"))
    owned = hits.join(small_side(epochs.select("prefix").distinct()), "prefix", "left_semi").select("path").distinct().withColumn("owned", F.lit(True))
    same = F.col("l_kind").eqNullSafe(F.col("r_kind")) & F.col("l_child").eqNullSafe(F.col("r_child"))
    restored = decide((same, "Matched"), (F.col("r_kind").isNull(), "DropLocal"), ((F.col("l_kind") == DIR) & (F.col("r_kind") == DIR), "Recurse"), otherwise="Pull")
    return rows.join(owned, "path", "left").select("path", F.when(F.col("owned"), restored).otherwise(_settled(_three_way())).alias("action"))


def survey(index: DataFrame, listing: DataFrame, unreadable: DataFrame, changed_since: DataFrame | None = None) -> DataFrame:
    """D7. path and verdict (create, update, delete, keep) of a rescan: unreadable paths keep their row, equal rows say
    nothing, rows changed since the survey began are left alone."""
    i, l = _struct(index, META_FIELDS, "i"), _struct(listing, META_FIELDS, "l")
    rows = i.join(l, "path", "full").join(unreadable.select("path", F.lit(True).alias("blind")).distinct(), "path", "left")
    if changed_since is not None:
        rows = rows.join(changed_since.select("path").distinct(), "path", "left_anti")
    verdict = decide((F.col("i").isNull(), "create"), (F.col("l").isNull() & F.col("blind"), "keep"), (F.col("l").isNull(), "delete"), (~F.col("i").eqNullSafe(F.col("l")), "update"))
    return rows.select("path", verdict.alias("verdict")).where("verdict is not null")


def plan_summary(actions: DataFrame, prefix: Column | None = None) -> DataFrame:
    """D8. Counts of each action by prefix (the first component, if not given), and a line of text."""
    by = F.concat(F.lit("/"), F.coalesce(top_of(F.col("path")), F.lit(""))) if prefix is None else prefix
    n = {out: F.count_if(F.col("action") == action).alias(out) for out, action in (("copied", "Copy"), ("replaced", "Replace"), ("deleted", "Delete"))}
    return actions.groupBy(by.alias("prefix")).agg(*n.values()).withColumn("line", F.format_string("%s: copied %d, replaced %d, deleted %d", "prefix", *n))


def restore_summary(actions: DataFrame, prefix: str, generation: int, already_matched: bool) -> DataFrame:
    """D8. The one line that tells what a restore of prefix did."""
    inside = actions.where(covers(prefix, F.col("path")))
    n = [F.count_if(F.col("action") == x) for x in ("Copy", "Replace", "Delete")]
    form = "%s already matches at generation %d, copied %d, replaced %d, deleted %d" if already_matched else "restored %s at generation %d, copied %d, replaced %d, deleted %d"
    return inside.agg(F.format_string(form, F.lit(prefix), F.lit(generation), *n).alias("line"))


def order_plan(plan: DataFrame) -> DataFrame:
    """D9. Deletes, the deepest first; then writes, the shallowest first; by path among equals."""
    gone, depth = F.col("action") == "Delete", depth_of(F.col("path"))
    return plan.orderBy(~gone, F.when(gone, -depth).otherwise(depth), "path")


def number_plan(plan: DataFrame) -> DataFrame:
    """D9 with step, the row's number in that order from 1: counted by ranges of the order, so no task sees all rows."""
    gone, depth = F.col("action") == "Delete", depth_of(F.col("path"))
    rows = plan.withColumns({"_writes": ~gone, "_depth": F.when(gone, -depth).otherwise(depth)})
    return numbered(rows, ["_writes", "_depth", "path"], "step").drop("_writes", "_depth")


def patch_index(index: DataFrame, manifest: DataFrame, prefix: str = "/", hash_fn: HashFn = sha256_hex) -> DataFrame:
    """D10. index with everything at and below prefix replaced by manifest's rows; their last_node is their node. Reserved
    rows stay when prefix is `/`. Directories are hashed again where they changed."""
    path = F.col("path")
    inside = index.where(covers(prefix, path) & (~F.coalesce(top_of(path).isin(*RESERVED), F.lit(False)) | (F.lit(prefix) != "/")))
    new = filter_prefix(manifest, prefix).select("path", *META_FIELDS)
    gone = inside.join(new, "path", "left_anti").select("path", *[F.lit(None).cast(t).alias(n) for n, t in index.select(*META_FIELDS).dtypes])
    hashed = tree_hash_incremental(index.drop("last_node"), new.unionByName(gone), hash_fn)
    last = index.select("path", F.col("last_node").alias("_last")).join(new.select("path", F.lit(True).alias("_new")), "path", "full")
    return hashed.join(last, "path", "left").withColumn("last_node", F.when(F.col("_new"), F.col("node")).otherwise(F.col("_last"))).drop("_new", "_last")


def seal_epochs(marks: DataFrame, manifests: DataFrame) -> DataFrame:
    """D11. marks (prefix, state, generation, dir_node) and manifests (prefix, root, changes): the next marks."""
    rows = manifests.join(marks, "prefix", "left")
    same = (F.col("state") == "Sealed") & (F.col("dir_node") == F.col("root"))
    generation = F.when(F.coalesce(same, F.lit(False)) | (F.col("state") == "Replacing"), F.col("generation")).otherwise(F.coalesce(F.col("generation") + 1, F.lit(1)))
    return rows.select("prefix", F.lit("Sealed").alias("state"), generation.cast("bigint").alias("generation"), F.col("root").alias("dir_node"), (F.coalesce(same, F.lit(False)) & (F.col("changes") == 0)).alias("already_matched"))


def unapplied_epochs(epochs: DataFrame, applied: DataFrame) -> DataFrame:
    """D12. Epochs (prefix, generation) newer than what was applied."""
    rows = epochs.join(applied.select("prefix", F.col("generation").alias("_done")), "prefix", "left")
    return rows.where(F.col("_done").isNull() | (F.col("generation") > F.col("_done"))).drop("_done")


def ack_epochs(applied: DataFrame, acks: DataFrame) -> DataFrame:
    """D12. applied after acks (prefix, generation, matched): a matched root stores its generation."""
    both = applied.select("prefix", "generation").unionByName(acks.where("matched").select("prefix", "generation"))
    return both.groupBy("prefix").agg(F.max("generation").alias("generation"))


def judge_trees(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """D13. The first finding of each path that isn't as expected. Directories' mode and mtime count only where
    expected.authoritative is set."""
    fields = ["kind", "size", "mtime_ns", "mode", "content_hash"]
    e = _struct(expected, [*fields, "authoritative"], "e")
    o = _struct(observed, fields, "o")
    differ = lambda f: ~F.col(f"e.{f}").eqNullSafe(F.col(f"o.{f}"))
    is_dir, is_link = F.col("e.kind") == DIR, F.col("e.kind") == 3
    finding = decide(
        (F.col("o").isNull(), "missing"), (F.col("e").isNull(), "unexpected"), (differ("kind"), "kind"),
        (is_dir & F.col("e.authoritative") & (differ("mode") | differ("mtime_ns")), "meta"), (is_dir, None),
        (is_link & differ("content_hash"), "target"), (differ("content_hash") | differ("size"), "bytes"),
        (~is_link & differ("mode"), "mode"), (~is_link & differ("mtime_ns"), "mtime"),
    )
    return e.join(o, "path", "full").select("path", finding.alias("finding")).where("finding is not null")


def guard_stale_deletes(deletes: DataFrame, listings: DataFrame, accepts: DataFrame) -> DataFrame:
    """D14. deletes (ck, path, listing_id) with suppressed: an accept of that checkout came after the listing was
    requested, or a rescan was still running. listings (listing_id, ck, requested, scanning); accepts (ck, at)."""
    last = accepts.groupBy("ck").agg(F.max("at").alias("_last"))
    rows = deletes.join(listings.select("listing_id", "requested", "scanning"), "listing_id", "left").join(last, "ck", "left")
    return rows.withColumn("suppressed", F.coalesce(F.col("_last") > F.col("requested"), F.lit(False)) | F.coalesce("scanning", F.lit(False))).drop("_last", "requested", "scanning")


def full_tree_diff(left_meta: DataFrame, right_meta: DataFrame) -> DataFrame:
    """D4 over two inventories that aren't hashed yet."""
    return prune_diff(tree_hash(left_meta), tree_hash(right_meta))


