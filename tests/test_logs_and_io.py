import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from treespark.operators import cas as C
from treespark.operators import events as E
from treespark.operators import status as M
from treespark.operators import transfer as T
from treespark.operators.diff import diff_trees
from treespark.operators.tree import tree_hash
from treespark.sources import files, sinks, snapshots
from treespark.streaming import jobs

LOG = "seq bigint, ck string, path string, op string, kind int, basis string, new_node string"


def random_log(seed, paths, n=200):
    rng, nodes, rows = random.Random(seed), [None], []
    for seq in range(n):
        path = rng.choice(paths)
        op = rng.choice(["announce", "announce", "delete"])
        new = None if op == "delete" else f"n{seq}"
        rows.append((seq, "", path, op, 1, rng.choice(nodes[-4:]), new))
        nodes.append(new)
    return rows


def model(rows):
    state, out = {}, {}
    for seq, _, path, op, _, basis, new in rows:
        now = state.get(path)
        ok = now is None if op != "delete" and basis is None else now is not None and now == basis
        out[seq] = ("accept" if ok else "reject", now)
        if ok:
            state[path] = new
    return out, {p: n for p, n in state.items() if n}


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_a_dict(spark, seed):
    rows = random_log(seed, ["/a", "/b", "/c/d"])
    want, final = model(rows)
    log = spark.createDataFrame(random.Random(0).sample(rows, len(rows)), LOG)
    assert {r.seq: (r.verdict, r.current) for r in C.fold_changes(log).collect()} == want
    assert {r.path: r.node for r in C.final_state(log).collect()} == final


def test_fold_stream_equals_batch(spark, tmp_path):
    rows = random_log(3, ["/a", "/b"])
    df = spark.createDataFrame(rows, LOG)
    for part in range(2):  # two micro-batches; the second repeats some changes
        df.where(F.col("seq") < 120 if part == 0 else F.col("seq") >= 100).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKS)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = jobs.run_available(jobs.fold_changes_stream(stream), "folded")
    assert {r.seq: (r.verdict, r.current) for r in got.collect()} == model(rows)[0]


def test_tree_log_drops_descendants(spark):
    index = spark.createDataFrame([("/t", 2, "d"), ("/t/a", 1, "a"), ("/t/b", 1, "b"), ("/u/x", 1, "x")], "path string, kind int, node string")
    log = spark.createDataFrame([(1, "", "/t/a", "announce", 1, "a", "a2"), (2, "", "/t", "delete", 2, "d", None), (3, "", "/t/b", "delete", 1, "b", None), (4, "", "/t/n/m", "announce", 1, None, "m")], LOG)
    judged, final = C.fold_tree_changes(log, index)
    assert {r.seq: r.verdict for r in judged.collect()} == {1: "accept", 2: "accept", 3: "reject", 4: "accept"}
    assert {r.path for r in final.collect()} == {"/t", "/t/n", "/t/n/m", "/u/x"}


def test_echoes_on_a_stream(spark, tmp_path):
    at = lambda ms: dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)
    rows = [(1, at(0), "Applied", "h"), (2, at(50), "Removed", None), (3, at(100), "Changed", "h"), (4, at(150), "Changed", "h"), (5, at(900), "Applied", "k"), (6, at(2000), "Changed", "k")]
    df = spark.createDataFrame([("", "/p", *r) for r in rows], "ck string, path string, id long, ts timestamp, event string, content_hash string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKS)
    got = jobs.run_available(jobs.suppress_echo_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "echoes")
    assert sorted(r.id for r in got.collect()) == [4, 6]


def test_echoes_of_paths_that_share_keys_of_state(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("", f"/p{i % 60}", i, start + dt.timedelta(milliseconds=37 * i), ["Applied", "Changed", "Removed", "Changed"][i * 7 % 11 % 4], str(i % 3)) for i in range(1200)]
    df = spark.createDataFrame(rows, "ck string, path string, id long, ts timestamp, event string, content_hash string")
    for i in range(3):
        df.where(f"id div 400 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKS)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = jobs.run_available(jobs.suppress_echo_stream(stream, 2000, buckets=4), "shared_echoes")
    arms, want = {}, []
    for _, path, id_, ts, event, content in rows:
        if event == "Applied":
            arms[path] = (content, ts + dt.timedelta(milliseconds=4000))
        elif path in arms and ts <= arms[path][1] and (event == "Removed" or content == arms[path][0]):
            if event != "Removed":
                del arms[path]
        else:
            want.append((id_, path, ts, event, content))
    assert sorted((r.id, r.path, r.ts, r.event, r.content_hash) for r in got.collect()) == want and len(want) < 900


def test_asks_that_share_keys_of_state(spark, tmp_path):
    rows = [(i, "", f"/p{i % 30}", str(i % 2), "done" if i * 5 % 7 < 3 else "ask") for i in range(900)]
    df = spark.createDataFrame(rows, "seq long, ck string, path string, want_hash string, op string")
    for i in range(3):
        df.where(f"seq div 300 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKS)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = jobs.run_available(jobs.dedupe_asks_stream(stream, buckets=4), "shared_asks")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in E.dedupe_asks(df).select(df.columns).collect()}


def test_rolling_delta_makes_no_python_group_a_file(spark):
    rng = random.Random(5)
    old = {f"/f{i}": bytes(rng.randrange(3) for _ in range(rng.randrange(0, 90))) for i in range(40)}
    new = {p: b[: len(b) // 3] + b"zz" + b[len(b) // 3 :] for p, b in old.items() if p != "/f7"} | {"/only": b"abc" * 9}
    table = lambda d: spark.createDataFrame([(p, bytearray(b)) for p, b in d.items()], "path string, body binary")
    ops = T.rolling_delta(table(new), table(old), 8)
    assert "FlatMapCoGroups" not in ops._jdf.queryExecution().optimizedPlan().toString()
    found = {}
    for r in sorted(ops.collect(), key=lambda r: (r.path, r.op_no)):
        piece = bytes(r.literal) if r.basis_at is None else old[r.path][r.basis_at : r.basis_at + r.length]
        assert len(piece) == r.length and (r.basis_at is None or r.basis_at % 8 == 0)
        found[r.path] = found.get(r.path, b"") + piece
    assert found == {p: b for p, b in new.items() if b}


def test_scan_write_and_verify_a_tree(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    (src / "d/empty").mkdir(parents=True)
    out.mkdir()
    (src / "d/a.txt").write_bytes(b"alpha")
    (src / "b.bin").write_bytes(bytes(range(256)))
    os.symlink("a.txt", src / "d/link")
    os.mkfifo(src / "pipe")
    (src / ".tree-state").mkdir()
    (out / "old").mkdir()
    (out / "old/x").write_text("x")
    meta, skipped = files.scan_files(spark, str(src))
    assert {r.path: r.reason for r in skipped.collect()} == {"/pipe": "special", "/.tree-state": "reserved"}
    assert {r.path for r in meta.collect()} == {"/d", "/d/empty", "/d/a.txt", "/b.bin", "/d/link"}
    again, _ = files.scan_files(spark, str(src), prior=meta)
    assert {r.path for r in again.where("rehash = 'reuse'").collect()} == {"/d/a.txt", "/b.bin"}
    there, _ = files.scan_files(spark, str(out))
    plan = diff_trees(meta, there).join(meta, "path", "left")
    bodies = spark.createDataFrame([(b"alpha",), (bytes(range(256)),), (b"a.txt",)], "body binary").withColumn("content_hash", F.sha2("body", 256))
    done = sinks.write_tree(plan, bodies, str(out))
    assert {r.outcome for r in done.collect()} == {"done"} and not (out / "old").exists()
    copy, _ = files.scan_files(spark, str(out))
    differ = {r.path: r.action for r in diff_trees(meta.drop("rehash"), copy.drop("rehash")).collect()}
    assert all(os.path.isdir(src / p[1:]) or os.path.islink(src / p[1:]) for p in differ)  # only directories' and links' own times


def test_snapshots_keep_versions(spark, tmp_path):
    root = f"file://{tmp_path}/snap"
    row = lambda p: ("", p, 1, 1, 1, 1, "00" * 32)
    schema = "ck string, path string, kind int, size bigint, mtime_ns bigint, mode bigint, content_hash string"
    assert snapshots.write_snapshot(spark.createDataFrame([row("/src/a"), row("/src2/b")], schema), root) == 1
    assert snapshots.write_snapshot(spark.createDataFrame([row("/src/c")], schema), root) == 2
    assert [r.path for r in snapshots.read_snapshot(spark, root).collect()] == ["/src/c"]
    assert [r.path for r in snapshots.read_snapshot(spark, root, version=1, prefix="/src").collect()] == ["/src/a"]
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, f"file://{tmp_path}/none")


def test_a_streamed_batch_is_merged_once(spark, tmp_path):
    schema = "path string, kind int, size bigint, mtime_ns bigint, mode bigint, content_hash string"
    one = lambda p, n: (p, 1, n, 0, 420, "00" * 32)
    root = f"file://{tmp_path}/index"
    snapshots.write_snapshot(tree_hash(spark.createDataFrame([one("/a/x", 1), one("/b/y", 1)], schema)).withColumn("ck", F.lit("")), root)
    changes = spark.createDataFrame([(*one("/a/x", 2), 1), (*one("/a/x", 3), 2), ("/b/y", None, None, None, None, None, 3)], schema + ", seq bigint")
    changes.coalesce(1).write.parquet(str(tmp_path / "in"))
    for mark in ("m1", "m2"):  # another checkpoint replays batch 0: it is known and changes nothing
        jobs.merge_stream_into_index(spark.readStream.schema(changes.schema).parquet(str(tmp_path / "in")), root, str(tmp_path / mark)).awaitTermination()
    got = {r.path: (r.size, r.dir_node) for r in snapshots.read_snapshot(spark, root).collect()}
    want = tree_hash(spark.createDataFrame([one("/a/x", 3), ("/b", 2, 0, 0, 0o40755, "00" * 32)], schema))
    assert got == {r.path: (r.size, r.dir_node) for r in want.collect()}
    assert snapshots.latest_manifest(spark, root)["version"] == 2


@pytest.mark.parametrize(
    ("waits", "stage"),
    [([("p", "reconcile", 1), ("p", "fulfill_read", 5)], "fulfill_read"), ([("p", "origin_bytes", 1), ("p", "uplink", 5), ("q", "hashing", 2)], "uplink"),
     ([("q", "fanout", 1), (None, "fanout", 1)], "fanout"), ([("p", "reconcile", 1), ("q", "fulfill_read", 5)], "reconcile")],
)
def test_bottleneck(spark, waits, stage):
    rows = [(p, s, dt.datetime(2024, 1, 1, 0, 0, n), 1, "own") for p, s, n in waits]
    df = spark.createDataFrame(rows, "peer string, stage string, since timestamp, depth long, source string")
    assert M.bottleneck(df, F.expr("timestamp '2024-01-01 00:01:00'")).first().stage == stage


def test_rolling_delta_rebuilds_shifted_bodies(spark):
    rng = random.Random(7)
    old = bytes(rng.randrange(256) for _ in range(5000))
    bodies = {"/shifted": b"++" + old, "/cut": old[:1000] + old[1500:], "/new": b"nothing", "/empty": b""}
    new = spark.createDataFrame([(p, bytearray(b)) for p, b in bodies.items()], "path string, body binary")
    ops = T.rolling_delta(new, spark.createDataFrame([(p, bytearray(old)) for p in bodies], "path string, body binary"), 256).collect()
    for path, body in bodies.items():
        mine = sorted((r for r in ops if r.path == path), key=lambda r: r.op_no)
        assert b"".join(bytes(r.literal) if r.basis_at is None else old[r.basis_at : r.basis_at + r.length] for r in mine) == body
    assert sum(r.length for r in ops if r.path == "/shifted" and r.basis_at is None) < 512


def test_rate_limit_counts_only_allowed(spark):
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), s) for s in (0, 10, 20, 59, 61, 71)]
    df = spark.createDataFrame(rows, "ip string, ts timestamp, id long")
    assert [r.allowed for r in M.rate_limit(df, 2).orderBy("id").collect()] == [True, True, False, False, True, True]
    assert not any(r.allowed for r in M.rate_limit(df, 0).collect())


def test_s9_streams_changes_from_many_tasks(spark, monkeypatch):
    from treespark.plans import fixtures, status_queries

    plans, streamed = [], status_queries.streamed

    def seen(f, changes):
        plans.append(changes._jdf.queryExecution().optimizedPlan().toString())
        return streamed(f, changes)

    monkeypatch.setattr(status_queries, "streamed", seen)
    f = fixtures.Fixtures(spark, "/root/testdata/sf0.001")
    got = sorted(map(tuple, status_queries.s9(f).where("ck = 'a'").select("path", "kind", "node", "dir_node").collect()), key=str)
    assert got == sorted(map(tuple, f("index_local").select("path", "kind", "node", "dir_node").collect()), key=str)
    assert plans and "Repartition 1," not in plans[0]


def test_streamed_changes_keep_namespaces_and_other_columns(spark, tmp_path):
    schema = "ck string, path string, kind int, size bigint, mtime_ns bigint, mode bigint, content_hash string"
    one = lambda ck, p, n: (ck, p, 1, n, 0, 420, "00" * 32)
    root = f"file://{tmp_path}/index"
    first = tree_hash(spark.createDataFrame([one(ck, p, 1) for ck in "AB" for p in ("/a/x", "/a/y", "/b/z")], schema))
    snapshots.write_snapshot(first.withColumn("last_node", F.concat("ck", "path")), root)
    changes = spark.createDataFrame([(*one("A", "/a/x", 2), 1), ("A", "/b/z", None, None, None, None, None, 2), (*one("A", "/c/n", 3), 3)], schema + ", seq bigint")
    changes.coalesce(1).write.parquet(str(tmp_path / "in"))
    jobs.merge_stream_into_index(spark.readStream.schema(changes.schema).parquet(str(tmp_path / "in")), root, str(tmp_path / "mark")).awaitTermination()
    got = sorted((r.ck, r.path, r.size, r.dir_node, r.last_node) for r in snapshots.read_snapshot(spark, root).collect())
    rows = [one("A", "/a/x", 2), one("A", "/a/y", 1), one("A", "/c/n", 3), ("A", "/b", 2, 0, 0, 0o40755, "00" * 32), *[one("B", p, 1) for p in ("/a/x", "/a/y", "/b/z")]]
    want = tree_hash(spark.createDataFrame(rows, schema)).collect()
    fresh = {("A", "/c"), ("A", "/c/n")}
    assert got == sorted((r.ck, r.path, r.size, r.dir_node, None if (r.ck, r.path) in fresh else r.ck + r.path) for r in want)


def test_late_changes_are_told_from_repeated_ones(spark, tmp_path):
    rows = [(5, "", "/a", "announce", 1, None, "n5"), (7, "", "/a", "announce", 1, "n5", "n7"), (6, "", "/a", "announce", 1, "n5", "n6"), (5, "", "/a", "announce", 1, None, "n5"), (8, "", "/a", "delete", 1, "n7", None)]
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKS)
    stream = spark.readStream.schema(spark.createDataFrame(rows, LOG).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted((r.seq, r.verdict, r.current) for r in jobs.run_available(jobs.fold_changes_stream(stream), "late").collect())
    assert got == [(5, "accept", None), (6, "late", "n7"), (7, "accept", "n5"), (8, "accept", "n7")]


def test_a_finish_without_row_and_wanted_hash_is_unknown(spark):
    index = spark.createDataFrame([("/a", "n", "h")], "path string, node string, content_hash string")
    pending = spark.createDataFrame([], "seq long, path string, op string, basis string, new_node string, want_hash string")
    finishes = spark.createDataFrame([(1, "/none", None, True), (2, "/a", "h", True), (3, "/a", "other", True), (4, "/a", None, True)], "finish_seq long, path string, want_hash string, body_ok boolean")
    got = {r.finish_seq: r.verdict for r in C.two_phase_cas(pending, finishes, index).collect()}
    assert got == {1: "unknown_transfer", 2: "accept", 3: "unknown_transfer", 4: "unknown_transfer"}
