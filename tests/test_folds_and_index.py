"""Folds of hot keys in parts, tree logs, and the stored index: against plain recomputation."""

import datetime as dt
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from treespark.operators import cas as C
from treespark.operators import status as M
from treespark.operators.ordered import Ways, last_before
from treespark.operators.tree import tree_hash
from treespark.sources import snapshots, tree_index
from treespark.streaming import jobs

LOG = "seq bigint, ck string, path string, op string, kind int, basis string, new_node string"
META = "ck string, path string, kind int, size bigint, mtime_ns bigint, mode bigint, content_hash string"


def hot_log(seed, n=400):
    """A third or more of all changes on one path; bases are right, stale, or missing."""
    rng, rows, last = random.Random(seed), [], {}
    for seq in range(n):
        path = rng.choice(["/hot", "/hot", "/a", "/b", "/c"])
        op = rng.choice(["announce"] * 4 + ["delete"])
        basis = rng.choice([last.get(path), last.get(path), f"n{rng.randrange(max(1, seq))}", None])
        new = None if op == "delete" else rng.choice([f"n{seq}", f"n{seq % 7}"])
        rows.append((seq, "", path, op, 1, basis, new))
        last[path] = new
    return rows


def plain_fold(rows, start=None):
    state, out = dict(start or {}), {}
    for seq, _, path, op, _, basis, new in rows:
        now = state.get(path)
        ok = now is None if op != "delete" and basis is None else now is not None and now == basis
        out[seq] = ("accept" if ok else "reject", now)
        if ok:
            state[path] = new
    return out, {p: v for p, v in state.items() if v is not None}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_hot_path_is_folded_in_many_parts(spark, seed):
    rows = hot_log(seed)
    index = spark.createDataFrame([("", "/hot", 1, "n0"), ("", "/z", 1, "n1")], "ck string, path string, kind int, node string")
    log = spark.createDataFrame(random.Random(0).sample(rows, len(rows)), LOG)
    want, final = plain_fold(rows, {"/hot": "n0"})
    got = C.fold_changes(log, index, part_rows=25).collect()
    assert {r.seq: (r.verdict, r.current) for r in got} == want and len(got) == len(rows)
    assert {r.path: r.final for r in got if r.final is not None} == final


def test_ways_lead_where_single_steps_lead():
    rng = random.Random(4)
    for _ in range(300):
        steps = [rng.choice([("step", rng.choice([None, "a", "b", "c"]), rng.choice([None, "1a", "1b", "2c"])), ("step", None, "2"), ("reset", None, rng.choice([None, "2"]))] if rng.random() < 0.3 else [("step", rng.choice([None, "a", "b"]), rng.choice(["1a", "1b", "1c", None]))]) for _ in range(rng.randrange(8))]
        ways = Ways()
        for what, basis, state in steps:
            ways.step(basis, state) if what == "step" else ways.reset(state)
        told = ways.rows()
        for start in (None, "1a", "1b", "1c", "1z", "2"):
            now = start
            for what, basis, state in steps:
                if what == "reset" or (None if now is None else now[1:]) == basis:
                    now = state
            node = None if start is None else start[1:]
            named = [end for s, other, end in told if not other and s == node] or [end for _, other, end in told if other] or [start]
            assert named == [now]


def test_the_last_event_before(spark):
    rng = random.Random(5)
    asks = [(rng.choice("hhhab"), s, f"i{s}") for s in rng.sample(range(1000), 200)]
    events = [(rng.choice("hhhac"), s) for s in rng.sample(range(1000), 60)]
    got = last_before(spark.createDataFrame(asks, "k string, seq long, id string"), spark.createDataFrame(events, "k string, seq long"), ["k"], "last", part_rows=20)
    want = {i: max((e for x, e in events if x == k and e < s), default=None) for k, s, i in asks}
    assert {r.id: r.last for r in got.collect()} == want


def plain_tree(rows, index):
    state, out = dict(index), {}
    for seq, _, path, op, kind, basis, new in sorted(rows):
        was, node = state.get(path, (None, None))
        ok = node is None if op != "delete" and basis is None else node is not None and node == basis
        out[seq] = ("accept" if ok else "reject", node)
        if not ok:
            continue
        if op == "delete" or (kind != 2 and was == 2):
            state = {p: v for p, v in state.items() if not p.startswith(path + "/")}
        if op == "delete":
            state.pop(path)
        else:
            up = path.rsplit("/", 1)[0]
            while up:
                state.setdefault(up, (2, ""))
                up = up.rsplit("/", 1)[0]
            state[path] = (kind, new)
    return out, state


@pytest.mark.parametrize(("seed", "part_rows"), [(1, None), (2, 15), (3, 15), (4, 40)])
def test_tree_logs_equal_a_plain_replay(spark, seed, part_rows):
    rng = random.Random(seed)
    paths = ["/t", "/t/a", "/t/a/x", "/t/a/y", "/t/b", "/u/d/e/f", "/u/d", "/v"]
    index = {"/t": (2, "d"), "/t/a": (2, "e"), "/t/a/x": (1, "n1"), "/t/q": (1, "q"), "/t/a/deep": (3, "l"), "/v": (1, "n3")}
    rows, replay = [], dict(index)
    for seq in range(150):
        path, op = rng.choice(paths), rng.choice(["announce", "announce", "announce", "delete"])
        _, replay = plain_tree(rows, index)
        basis = rng.choice([replay.get(path, (0, None))[1]] * 3 + [f"n{rng.randrange(5)}", None, ""])
        rows.append((seq, "", path, op, rng.choice([1, 1, 2, 3]), basis, None if op == "delete" else f"n{seq % 40}"))
    log = spark.createDataFrame(random.Random(9).sample(rows, len(rows)), LOG)
    df = spark.createDataFrame([("", p, k, n) for p, (k, n) in index.items()], "ck string, path string, kind int, node string")
    judged, final = C.fold_tree_changes(log, df, part_rows=part_rows)
    want, rest = plain_tree(rows, index)
    assert {r.seq: (r.verdict, r.current) for r in judged.collect()} == want
    assert {r.path: (r.kind, r.node) for r in final.collect()} == rest


def test_a_tree_log_is_sorted_once_and_folded_no_more_when_its_effects_stay(spark, monkeypatch):
    sorts, folds = [], []
    steps_in_parts, fold_parts = C.steps_in_parts, C.fold_parts
    monkeypatch.setattr(C, "steps_in_parts", lambda *a: sorts.append(1) or steps_in_parts(*a))
    monkeypatch.setattr(C, "fold_parts", lambda *a: folds.append(1) or fold_parts(*a))
    rows = [(1, "", "/t/a", "announce", 1, None, "a"), (2, "", "/t", "delete", 2, "", None), (3, "", "/t/a", "delete", 1, "a", None)]
    index = spark.createDataFrame([], "ck string, path string, kind int, node string")
    judged, final = C.fold_tree_changes(spark.createDataFrame(rows, LOG), index)
    assert {r.seq: r.verdict for r in judged.collect()} == {1: "accept", 2: "accept", 3: "reject"} and final.count() == 0
    # /t is told it was made, /t/a that it fell, and then nothing new: three folds, the third one's effects are the second one's
    assert len(sorts) == 1 and len(folds) == 3


def test_rounds_of_a_tree_log_leave_no_tables(spark, monkeypatch, tmp_path):
    from treespark import common

    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    # /t/a/x makes /t and /t/a, whose deletes hang on that: more rounds than one
    rows = [(1, "", "/t/a/x", "announce", 1, None, "b" * 64), (2, "", "/t/a", "delete", 2, "", None), (3, "", "/t/a/x", "announce", 1, None, "c" * 64), (4, "", "/t", "delete", 2, "", None), (5, "", "/t/a/x", "delete", 1, "c" * 64, None)]
    index = spark.createDataFrame([], "ck string, path string, kind int, node string")
    judged, final = C.fold_tree_changes(spark.createDataFrame(rows, LOG), index)
    assert {r.seq: (r.verdict, r.current) for r in judged.collect()} == plain_tree(rows, {})[0] and final.count() == 0
    left = sorted(p.name.split("-")[0] for p in (tmp_path / "treespark").iterdir())
    assert left == ["ends", "falls", "judged", "nodes"]
    assert spark.conf.get(common.Scratch.CLEANUP) == "false"


@pytest.mark.parametrize("part_rows", [None, 12])
def test_long_nodes_of_tree_logs_come_back_whole(spark, part_rows):
    rng = random.Random(7)
    node = lambda i: ["", "s", "q" * 23, "r" * 24, "\u00e4" * 24, "0" * 63 + "1", "0" * 63 + "2"][i % 7]
    paths = ["/t", "/t/a", "/t/a/x", "/t/b"]
    index = {"/t": (2, node(5)), "/t/a": (2, node(3)), "/t/a/x": (1, node(4)), "/t/q": (1, "q" * 64), "/w": (3, "w" * 24)}
    rows, replay = [], dict(index)
    for seq in range(90):
        path, op = rng.choice(paths), rng.choice(["announce", "announce", "announce", "delete"])
        _, replay = plain_tree(rows, index)
        basis = rng.choice([replay.get(path, (0, None))[1]] * 3 + [node(rng.randrange(7)), None])
        rows.append((seq, "", path, op, rng.choice([1, 2, 3]), basis, None if op == "delete" else node(rng.randrange(7))))
    df = spark.createDataFrame([("", p, k, n) for p, (k, n) in index.items()], "ck string, path string, kind int, node string")
    judged, final = C.fold_tree_changes(spark.createDataFrame(random.Random(9).sample(rows, len(rows)), LOG), df, part_rows)
    want, rest = plain_tree(rows, index)
    assert {r.seq: (r.verdict, r.current) for r in judged.collect()} == want
    assert {r.path: (r.kind, r.node) for r in final.collect()} == rest


def test_tree_queries_equal_a_plain_replay(spark):
    from treespark.plans import fixtures, log_queries

    f = fixtures.Fixtures(spark, "/root/testdata/sf0.001")
    log = [tuple(r) for r in f("changes").selectExpr("seq*2 seq", "ck", "path", "op", "kind", "basis", "new_node").collect()]
    log += [
        (r.event_id * 2 + 1, "", f"/u{r.user_id % 10}", "delete" if r.event_id % 3 == 0 else "announce", 1 if r.event_id % 3 == 1 else 2, "" if r.event_id % 3 == 0 else None, None if r.event_id % 3 == 0 else r.n)
        for r in f.sql("select event_id, user_id, sha2(cast(event_id as string),256) n from {events}").collect()
    ]
    index = {f"/u{r.u}": (2, "") for r in f.sql("select distinct user_id%10 u from {events}").collect()}
    want, rest = plain_tree(log, index)
    assert len({v for v, _ in want.values()}) == 2
    assert {r.seq: (r.verdict, r.current) for r in log_queries.c3(f).collect()} == want
    assert {r.path: (r.kind, r.node) for r in log_queries.c3b(f).collect()} == rest


def plain_limit(rows, most, window_ms):
    hits, out = {}, {}
    for at, i, ip in sorted((at, i, ip) for ip, at, i in rows):
        own = hits.setdefault(ip, deque())
        while own and at - own[0] >= window_ms:
            own.popleft()
        out[i] = len(own) < most
        if out[i]:
            own.append(at)
    return out


@pytest.mark.parametrize(("most", "pace"), [(1, 300), (3, 300), (3, 40_000), (50, 300), (0, 300)])
def test_a_hot_address_is_limited_in_many_parts(spark, most, pace):
    rng, at, rows = random.Random(most + pace), 0, []
    for i in range(600):
        at += rng.randrange(1, pace)
        rows.append((rng.choice(["hot", "hot", "hot", "b", "c"]), at, i))
    df = spark.createDataFrame(rows, "ip string, at long, id long").select("ip", F.timestamp_millis("at").alias("ts"), "id")
    got = M.rate_limit(df, most, 60, part_rows=30)
    assert {r.id: r.allowed for r in got.collect()} == plain_limit(rows, most, 60_000)


def leaf(path, n, ck=""):
    return (ck, path, 1, n, 0, 420, "00" * 32)


def hashed(spark, rows):
    return {(r.ck, r.path): (r.size, r.dir_node) for r in tree_hash(spark.createDataFrame(rows, META)).collect()}


def stored(spark, root):
    return {(r.ck, r.path): (r.size, r.dir_node) for r in snapshots.read_snapshot(spark, root).collect()}


CHANGE = META + ", seq bigint"


def feed(spark, tmp_path, root, name, batches, per_trigger=1):
    folder = tmp_path / name
    for rows in batches:
        spark.createDataFrame(rows, CHANGE).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(spark.createDataFrame([], CHANGE).schema).option("maxFilesPerTrigger", per_trigger).parquet(str(folder))
    jobs.merge_stream_into_index(stream, root, str(tmp_path / f"mark-{name}")).awaitTermination()


def test_two_streams_feed_one_index_and_late_changes_are_known(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    snapshots.write_snapshot(tree_hash(spark.createDataFrame([leaf("/a/x", 1), leaf("/b/y", 1), leaf("/c/z", 1, "other")], META)), root)
    feed(spark, tmp_path, root, "one", [[(*leaf("/a/n", 1), 3), (*leaf("/a/x", 10), 9)], [(*leaf("/a/x", 5), 4), (*leaf("/b/w", 7), 5)]])
    feed(spark, tmp_path, root, "two", [[(*leaf("/d/e/f", 2), 1), ("", "/b/y", None, None, None, None, None, 8)], [(*leaf("/b/y", 3), 7)]])
    want = [leaf("/a/x", 10), leaf("/a/n", 1), leaf("/b/w", 7), leaf("/d/e/f", 2), leaf("/c/z", 1, "other")]
    assert stored(spark, root) == hashed(spark, want)
    manifest = snapshots.latest_manifest(spark, root)
    assert len(manifest["streams"]) == 2 and len(manifest["deltas"]) == 3  # the last batch of stream two was late
    snapshots.compact(spark, root)
    assert stored(spark, root) == hashed(spark, want) and snapshots.latest_manifest(spark, root)["deltas"] == []
    assert snapshots.read_snapshot(spark, root, version=2).where("path = '/a/x'").first().size == 10
    feed(spark, tmp_path, root, "two", [[(*leaf("/b/y", 4), 6), (*leaf("/a/n", 8), 2), (*leaf("/d/e/f", 3), 2)]])  # two of three are late
    assert stored(spark, root) == hashed(spark, [leaf("/a/x", 10), leaf("/a/n", 1), leaf("/b/w", 7), leaf("/d/e/f", 3), leaf("/c/z", 1, "other")])


def wide(n, edit=()):
    return [leaf(f"/s{i % 10}/d{i % 50}/f{i}", 2 if i in edit else 1) for i in range(n)]


def test_merges_write_what_changes_and_walks_read_what_differs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "FILE_ROWS", 60)
    n, roots = 600, {}
    hashed_once = tree_hash(spark.createDataFrame(wide(n), META)).cache()
    left = f"file://{tmp_path}/left"
    snapshots.write_snapshot(hashed_once, left)
    files = snapshots.files_of(spark, left, snapshots.latest_manifest(spark, left))
    assert files.count() >= 10 and files.agg(F.max("n")).first()[0] < n / 4
    reads = []
    for share in (2, 300):
        edited = random.Random(share).sample(range(n), share)
        root = roots[share] = f"file://{tmp_path}/right{share}"
        snapshots.write_snapshot(hashed_once, root)
        changes = spark.createDataFrame([(*wide(n, set(edited))[i], 1) for i in edited], CHANGE)
        tree_index.update_index(spark, root, changes)
        assert stored(spark, root) == hashed(spark, wide(n, set(edited)))
        manifest = snapshots.latest_manifest(spark, root)
        dirs = {p for i in edited for p in ("/", f"/s{i % 10}", f"/s{i % 10}/d{i % 50}")}
        assert spark.read.parquet(f"{root}/{manifest['deltas'][0]}").count() == share + len(dirs)
        found, levels = tree_index.prune_walk(spark, left, root)
        assert {r.path for r in found.collect()} == {f"/s{i % 10}/d{i % 50}/f{i}" for i in edited} | (dirs - {"/"})
        told = levels.agg(F.sum("opened"), F.sum("visited"), F.sum("rows_read")).first()
        assert told[0] == len(dirs)
        reads.append(told[2])
    assert reads[0] < reads[1] / 2


def test_another_writers_commit_is_not_lost(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/index"
    snapshots.write_snapshot(tree_hash(spark.createDataFrame([leaf("/a/x", 1)], META)), root)
    real, other = tree_index.add_delta, [spark.createDataFrame([(*leaf("/b/y", 1), 1)], CHANGE)]

    def late(*args):
        if other:
            tree_index.update_index(spark, root, other.pop())
        return real(*args)

    monkeypatch.setattr(tree_index, "add_delta", late)
    tree_index.update_index(spark, root, spark.createDataFrame([(*leaf("/c/z", 1), 1)], CHANGE))
    assert stored(spark, root) == hashed(spark, [leaf("/a/x", 1), leaf("/b/y", 1), leaf("/c/z", 1)])
