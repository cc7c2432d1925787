import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from treespark.functions import paths as P
from treespark.functions.hashing import with_file_node
from treespark.operators import diff as D
from treespark.operators import tree as H
from treespark.schema import META_FIELDS, ZERO_HASH

SCHEMA = "path string, kind int, size bigint, mtime_ns bigint, mode bigint, content_hash string"


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def node(kind, size, mtime, mode, content):
    return sha(struct.pack(">B", kind) + bytes.fromhex(content) + struct.pack(">QqI", size, mtime, mode))


def tree_hashes(rows):
    """Independent roll-up: path -> directory hash."""
    kinds = {r[0]: r for r in rows}
    kids = {p: [] for p in kinds if kinds[p][1] == 2}
    for p in kinds:
        if p != "/":
            kids[p.rsplit("/", 1)[0] or "/"].append(p)

    def dir_hash(p):
        out = b""
        for c in sorted(kids[p], key=lambda x: x.rsplit("/", 1)[1].encode()):
            name, r = c.rsplit("/", 1)[1].encode(), kinds[c]
            child = dir_hash(c) if r[1] == 2 else node(*r[1:])
            out += bytes([r[1]]) + struct.pack(">I", len(name)) + name + bytes.fromhex(child)
        return sha(out)

    return {p: dir_hash(p) for p in kids}


def d(path):
    return (path, 2, 0, 0, 0o40755, ZERO_HASH)


def f(path, body="x", mtime=-5, mode=0o100644):
    return (path, 1, len(body), mtime, mode, sha(body.encode()))


ROWS = [d("/"), d("/src"), d("/src/pages"), d("/src/empty"), d("/src2"), f("/src/a"), f("/src/ζed"), f("/src/pages/index.md"), f("/src/pages-v2"), f("/src2/a", "y", 2**62)]


@pytest.mark.parametrize(
    ("raw", "error"),
    [("/src", None), ("/", None), ("src", "NotAbsolute"), ("", "NotAbsolute"), (None, "NotAbsolute"), ("//src", "NonCanonical"), ("/src/", "NonCanonical"), ("/a/./b", "DotComponent"), ("/a/..", "DotComponent"), ("/a..b", None)],
)
def test_canonical_paths(spark, raw, error):
    row = P.canonicalize_paths(spark.createDataFrame([(raw,)], "raw string"), "raw").first()
    assert (row.path_error, row.path) == (error, raw if error is None else None)


def test_prefixes_go_by_component(spark):
    df = spark.createDataFrame([("/src",), ("/src2",), ("/src/a",), ("/",)], "path string")
    assert {r.path for r in P.filter_prefix(df, "/src").collect()} == {"/src", "/src/a"}
    assert P.filter_prefix(df, "/").count() == 4
    got = {r.path: (r.parent, r.name, r.depth) for r in P.with_path_parts(df).collect()}
    assert got == {"/src": ("/", "src", 1), "/src2": ("/", "src2", 1), "/src/a": ("/src", "a", 2), "/": (None, "/", 0)}
    assert [r.ancestor for r in P.explode_ancestors(spark.createDataFrame([("/a/b/c",)], "path string")).collect()] == ["/a/b", "/a", "/"]


def test_file_node_layout(spark):
    row = with_file_node(spark.createDataFrame([f("/src/a", "body", -1)], SCHEMA)).first()
    assert row.node == node(1, 4, -1, 0o100644, sha(b"body"))


def test_tree_hash_is_the_independent_roll_up(spark):
    got = {r.path: r.dir_node for r in H.tree_hash(spark.createDataFrame(ROWS, SCHEMA)).collect() if r.kind == 2}
    assert got == tree_hashes(ROWS)
    assert got["/src/empty"] == sha(b"")


def test_missing_ancestors_are_made_and_location_is_not_hashed(spark):
    got = {r.path: r for r in H.tree_hash(spark.createDataFrame([f("/a/b/c"), f("/z/y/b/c")], SCHEMA)).collect()}
    assert set(got) == {"/", "/a", "/a/b", "/a/b/c", "/z", "/z/y", "/z/y/b", "/z/y/b/c"}
    assert got["/a/b"].dir_node == got["/z/y/b"].dir_node


def test_incremental_hash_equals_full(spark):
    index = H.tree_hash(spark.createDataFrame(ROWS, SCHEMA))
    changed = [f("/src/pages/index.md", "new"), f("/new/deep/file"), ("/src2/a", None, None, None, None, None)]
    after = [r for r in ROWS if r[0] not in ("/src/pages/index.md", "/src2/a")] + [f("/src/pages/index.md", "new"), f("/new/deep/file")]
    want = {r.path: (r.node, r.dir_node) for r in H.tree_hash(spark.createDataFrame(after, SCHEMA)).collect()}
    got = H.tree_hash_incremental(index, spark.createDataFrame(changed, SCHEMA))
    assert {r.path: (r.node, r.dir_node) for r in got.collect()} == want


def test_empty_inventory(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert H.tree_hash(none).count() == 0
    assert D.diff_trees(none, none).count() == 0


def test_plan_order(spark):
    plan = spark.createDataFrame([("/a", "Delete"), ("/a/b", "Delete"), ("/c/d", "Copy"), ("/c", "Copy"), ("/b", "Replace")], "path string, action string")
    assert [r.path for r in D.order_plan(plan).collect()] == ["/a/b", "/a", "/b", "/c", "/c/d"]


@pytest.mark.parametrize(
    ("left", "right", "last", "action"),
    [("x", "x", None, "Matched"), (None, "x", None, "Pull"), ("x", None, None, "AnnounceCreate"), ("x", None, "x", "AnnounceCreate"), ("x", None, "y", "AnnounceCas"),
     ("x", "y", "x", "Pull"), ("x", "y", "y", "AnnounceCas"), ("x", "y", None, "AnnounceCas")],
)
def test_three_way_table(spark, left, right, last, action):
    side = lambda body: with_file_node(spark.createDataFrame([f("/p", body)] if body else [], SCHEMA)).withColumn("dir_node", F.lit(None).cast("string"))
    last_node = node(1, 1, -5, 0o100644, sha(last.encode())) if last else None
    synced = spark.createDataFrame([("/p", last_node)], "path string, last_node string")
    assert [r.action for r in D.reconcile(side(left), side(right), synced).collect()] == [action]


def test_repair_clears_only_own_wrong_lists(spark):
    index = H.tree_hash(spark.createDataFrame(ROWS, SCHEMA)).withColumn("last_node", F.col("node"))
    broken = index.withColumn("dir_node", F.when(F.col("path") == "/src/pages", "00" * 32).otherwise(F.col("dir_node")))
    rows = {r.path: r for r in H.repair_tree(broken).collect()}
    assert rows["/src/pages"].dir_node == tree_hashes(ROWS)["/src/pages"]
    assert [p for p, r in rows.items() if r.last_node is None] == ["/src/pages/index.md"]
    again = H.repair_tree(spark.createDataFrame(list(rows.values())).drop("changed"))
    assert again.where("changed").count() == 0


def test_meta_fields():
    assert META_FIELDS == ["kind", "size", "mtime_ns", "mode", "content_hash"]
