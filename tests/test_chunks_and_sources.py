"""Chunked deltas, wide directories, the tree source and sink, and echoes and gauges by event time."""

import bz2
import datetime as dt
import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from treespark.operators import chunks as CH
from treespark.operators import diff as D
from treespark.operators import tree
from treespark.sources import files, posix
from treespark.streaming import jobs

META = "path string, kind int, size bigint, mtime_ns bigint, mode bigint, content_hash string"


def plain_ops(new, old, block):
    blocks, out, at, start = {}, [], 0, 0
    for i in range(0, len(old) - block + 1, block):
        blocks.setdefault(old[i : i + block], i)
    while at < len(new):
        hit = blocks.get(new[at : at + block]) if at + block <= len(new) else None
        if hit is None:
            at += 1
            continue
        out += [(start, at - start, None)] * (at > start) + [(at, block, hit)]
        at = start = at + block
    return out + [(start, at - start, None)] * (at > start)


def test_chunk_delta_is_the_scan_from_the_start(spark, monkeypatch):
    monkeypatch.setattr(CH, "BITS_A_SUM", 1)  # the bitmap lets wrong offsets pass
    rng = random.Random(3)
    some = lambda n, of=256: bytes(rng.randrange(of) for _ in range(n))
    old = some(5000)
    pairs = {"/same": (old, old), "/shift": (b"++" + old, old), "/cut": (old[:900] + old[1300:], old), "/new": (some(700), b""), "/gone": (b"", old), "/low": (some(3000, 2), some(2000, 2)), "/zeros": (bytes(1500), bytes(640)), "/swap": (old[2500:] + some(30) + old[:2500], old), "/short": (b"abc", b"abc")}
    table = lambda i: CH.chunked(spark.createDataFrame([(p, bytearray(x[i])) for p, x in pairs.items()], "path string, body binary"), 256).repartition(3)
    new, before = table(0), table(1)
    assert new.agg(F.max(F.octet_length("data"))).first()[0] == 256
    ops = CH.chunk_delta(new, before, 64).cache()
    got = {}
    for r in ops.orderBy("path", "op_no").collect():
        got.setdefault(r.path, []).append((r.at, r.length, r.basis_at))
    assert got == {p: want for p, (n, o) in pairs.items() if (want := plain_ops(n, o, 64))}
    assert {r.path: r.body_hash for r in CH.rebuilt(ops, new, before, 256).collect()} == {p: hashlib.sha256(n).hexdigest() for p, (n, _) in pairs.items() if n}


def test_wide_directories_are_hashed_as_streams(spark, monkeypatch):
    rows = [(f"/w/{rng}ζ{i}", 1, i, i, 420, "ab" * 32) for i, rng in enumerate("zyxabc" * 30)] + [("/w/d/x", 1, 1, 1, 420, "cd" * 32), ("/v/x", 1, 1, 1, 420, "cd" * 32), ("/w/e", 2, 0, 0, 420, "00" * 32)]
    df = spark.createDataFrame(rows, META)
    want = {r.path: r.dir_node for r in tree.tree_hash(df).collect()}
    monkeypatch.setattr(tree, "WIDE", 50)
    seen = []
    streamed = tree._streamed
    monkeypatch.setattr(tree, "_streamed", lambda children, ks, digest: seen.append(1) or streamed(children, ks, digest))
    assert {r.path: r.dir_node for r in tree.tree_hash(df).collect()} == want and seen
    both = df.withColumn("ck", F.lit("a")).unionByName(df.where("path <> '/w/d/x'").withColumn("ck", F.lit("b")))
    assert {r.path: r.dir_node for r in tree.tree_hash(both).where("ck = 'a'").collect()} == want


def test_the_tree_source_and_sink(spark, tmp_path):
    posix.register(spark)
    out = tmp_path / "out"
    body = lambda b: (b, hashlib.sha256(b).hexdigest())
    rows = [("/d", 2, 0, 0o40755, "00" * 32, None), ("/d/empty", 2, 0, 0o40700, "00" * 32, None)]
    rows += [(f"/d/f{i}", 1, 10**18 + i, 0o100640, body(b"x" * i)[1], b"x" * i) for i in range(40)] + [("/d/l", 3, 0, 0o120777, body(b"f1")[1], b"f1")]
    kind = "path string, kind int, mtime_ns bigint, mode bigint, content_hash string, body binary"
    df = spark.createDataFrame(rows, kind).repartition(4)
    df.write.format("tree_files").mode("append").option("path", str(out)).save()
    os.mkfifo(out / "pipe")
    os.makedirs(out / ".tree-conflicts")
    (out / "top").mkdir()
    (out / "top/t").write_text("t")
    got = spark.read.format("tree").option("path", str(out)).option("tasks", "3").load()
    told = {r.path: r for r in got.collect()}
    assert {p: r.problem for p, r in told.items() if r.problem} == {"/pipe": "special", "/.tree-conflicts": "reserved", "/.tree-state": "reserved"}
    assert {p for p, r in told.items() if not r.problem} == {r[0] for r in rows} | {"/top", "/top/t"}
    assert all((told[p].kind, told[p].content_hash) == (k, h) for p, k, _, _, h, _ in rows) and told["/d/f7"].mtime_ns == 10**18 + 7 and told["/d/f7"].mode & 0o7777 == 0o640
    assert {r.path for r in got.where("path like '/top/%'").collect()} == {"/top/t"} and {r.path for r in got.where("path = '/d/l'").collect()} == {"/d/l"}
    reader = posix.TreeReader(str(out), 3)
    list(reader.pushFilters([posix.StringStartsWith(("path",), "/top/")]))
    assert {r[0] for p in reader.partitions() for r in reader.read(p)} == {"/top/t"} | {r for r in told if r.count("/") == 1}
    before = {p for p, _, _ in os.walk(out)}
    wrong = spark.createDataFrame([("/bad/a", 1, 0, 420, body(b"a")[1], b"a"), ("/bad/b", 1, 0, 420, body(b"b")[1], b"not b")], kind)
    with pytest.raises(Exception, match="hash names"):
        wrong.write.format("tree_files").mode("append").option("path", str(out)).save()
    assert {p for p, _, _ in os.walk(out)} == before and not (out / "bad").exists()


def test_plan_steps_count_over_parts(spark, monkeypatch):
    from treespark.operators import ordered

    monkeypatch.setattr(ordered, "PART_ROWS", 3)
    rows = [(f"/{'/'.join('abc'[: 1 + i % 3])}{i}", ["Delete", "Copy", "Replace"][i % 3]) for i in range(20)]
    plan = spark.createDataFrame(rows, "path string, action string")
    want = [r.path for r in D.order_plan(plan).collect()]
    assert [r.path for r in D.number_plan(plan).orderBy("step").collect()] == want
    assert sorted(r.step for r in D.number_plan(plan).collect()) == list(range(1, 21)) and D.number_plan(plan.limit(0)).count() == 0


def test_gauges_go_stale_by_event_time(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    kind = "peer string, generation long, seq long, received timestamp"
    for rows in ([("p", 1, 1, at(0)), ("p", 1, 5, at(10)), ("q", 1, 1, at(2))], [("p", 1, 4, at(20)), ("p", 1, 6, at(60)), ("r", 1, 1, at(61))], [("r", 1, 2, at(300))], [("r", 1, 3, at(5000)), ("q", 1, 2, at(5001))], [("q", 1, 1, at(9900))], [("q", 1, 1, at(9999))]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKS)
    stream = spark.readStream.schema(spark.createDataFrame([], kind).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = jobs.run_available(jobs.gauge_states_stream(stream, 5, "10 seconds", 3600), "gauges").collect()
    told = sorted((r.peer, (r.at - at(0)).total_seconds(), r.seq, r.state) for r in got)
    stale = lambda p, s, n: [(p, float(s), n, "fresh"), (p, float(s + 15), n, "stale")]
    want = [("p", 0.0, 1, "fresh"), *stale("p", 10, 5), *stale("p", 60, 6), *stale("q", 2, 1), *stale("q", 5001, 2), *stale("r", 61, 1), *stale("r", 300, 2), *stale("r", 5000, 3)]
    assert set(want) <= set(told) and not any(t[0] == "p" and t[2] == 4 for t in told)


def test_windows_of_a_batch_pass_in_one_frame():
    import numpy as np
    import pandas as pd

    from treespark.operators import chunks

    rng, rows, want = np.random.default_rng(8), [], []
    for i in range(30):
        data, bits = rng.integers(0, 4, rng.integers(0, 60), np.uint8).tobytes(), int(rng.choice([256, 1024]))
        sums = chunks.weak_sums(data, 4)
        held, own = np.zeros(bits, bool), max(0, len(data) - 5)
        held[chunks._spot(sums[::3], bits)] = True
        rows.append((f"/p{i}", 100 * i, data, own, bits, np.packbits(held).tobytes()))
        want += [(f"/p{i}", 100 * i, int(w), at) for at, w in enumerate(sums[:own]) if held[chunks._spot(w, bits)]]
    got = chunks.passing(pd.DataFrame(rows, columns=["path", "at", "data", "own", "bits", "bitmap"]), 4)
    assert list(got.itertuples(index=False, name=None)) == want and len(want) > 200


def test_a_commit_makes_each_directory_once(tmp_path, monkeypatch):
    import os

    from treespark.schema import FILE
    from treespark.sources import files, posix

    writer, made, real = posix.TreeWriter(str(tmp_path)), [], os.makedirs
    rows = [{"path": f"/a/d{i % 3}/f{i}", "kind": FILE, "mtime_ns": 10**18, "mode": 0o644, "body": b"x%d" % i, "content_hash": posix.hashlib.sha256(b"x%d" % i).hexdigest()} for i in range(60)]
    staged = [writer.write(iter(rows[i::2])) for i in range(2)]
    monkeypatch.setattr(posix.os, "makedirs", lambda at, **more: made.append(at) or real(at, **more))
    writer.commit(staged)
    assert {r["path"]: r["body"] for r in rows} == {"/" + str(f.relative_to(tmp_path)): f.read_bytes() for f in tmp_path.glob("a/*/*")}
    assert len([m for m in made if "/a/d" in m]) <= 6  # with what makedirs calls itself


def test_large_objects_are_hashed_in_segments(spark, tmp_path, monkeypatch):
    for name, value in {"WHOLE": 1000, "SEGMENT": 3000, "PIECE": 70}.items():
        monkeypatch.setattr(files, name, value, raising=False)
    some = random.Random(5).randbytes
    mark, lines = b"\xef\xbb\xbf", b"a line\r\n" * 900
    bodies = {
        "/short": some(1000), "/at": some(1001), "/long": some(20_000), "/d/e/deep": some(9000), "/a b%20c+\u00e4.x": some(4000), "/ended": lines, "/not ended": lines + b"z", "/cr": b"\r" * 5000,
        "/marked": mark + some(5000) + b"\n", "/marked, not ended": mark + lines + b"z", "/mark only": mark * 2000, "/feeds": b"\n" * 4000, "/one line": b"z" * 7000, "/segment": some(2999) + b"\n", "/segments": (some(2999) + b"\n") * 2,
        "/d/x.gz": gzip.compress(some(8000)), "/not.gz": some(4000), "/lines.bz2": lines, "/x.bz2": bz2.compress(some(8000)), "/x.zst": some(3000), "/x.snappy": some(3000), "/x.lz4": some(3000), "/x.deflate": some(3000), "/x.passthrough": some(3000), "/\x01.gz": some(3000),
    }
    for path, body in bodies.items():
        (tmp_path / path[1:]).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path[1:]).write_bytes(body)
    limits = {"spark.sql.files.maxPartitionBytes": "1100", "spark.sql.sources.binaryFile.maxLength": "1000"}  # no larger body fits a row
    try:
        for key, value in limits.items():
            spark.conf.set(key, value)
        got = {r.path: (r.size, r.content_hash) for r in files.scan_objects(spark, str(tmp_path)).collect()}
    finally:
        for key in limits:
            spark.conf.unset(key)
    assert got == {p: (len(b), hashlib.sha256(b).hexdigest()) for p, b in bodies.items()}
