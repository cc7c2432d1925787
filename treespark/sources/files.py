"""Reading trees, change logs, status lines and gauge frames."""

from __future__ import annotations

import codecs
import ctypes
import hashlib
import os
import stat
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..common import small_side, written
from ..functions.hashing import Sha256, sha256_hex
from ..operators.status import COUNTERS
from ..schema import CHANGE, DIR, FILE, GAUGE_MAGIC, LINK, RESERVED, STAGES, ZERO_HASH

LINE_NAMES = {"in": "in_msgs", "out": "out_msgs", "cas_ok": "cas_accept", "cas_rej": "cas_reject"}
#: Objects of more than WHOLE bytes are hashed in segments: the blocks of Spark's reader that begin within SEGMENT bytes, in pieces of at most PIECE.
WHOLE, SEGMENT, PIECE = 64 << 20, 64 << 20, 64 << 10
#: Names by which Hadoop's readers unpack.
CODECS = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst", ".passthrough")
#: The suffix of Hadoop's pass-through codec, by its name and by that in Spark's shaded Hadoop.
SUFFIX = ("io.compress.passthrough.extension", "org.apache.hadoop.shaded.io.compress.passthrough.extension")
QUEUE_NAMES = ["pending", "outbox", "writable", "pending_pulls", "pending_renames", "parked", "sending", "work"]


def _hash_file(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as body:
        while part := body.read(1 << 20):
            digest.update(part)
    return digest.hexdigest()


def scan_files(spark: SparkSession, root: str, prior: DataFrame | None = None, prefix: str = "/") -> tuple[DataFrame, DataFrame]:
    """S1. (meta, skipped) of a POSIX tree that every executor mounts at root. Directories are listed level by level,
    each level's in parallel; bodies are hashed in streams on executors. Links are not followed; devices, sockets, unreadable
    entries, names that aren't UTF-8 and reserved names at the root are skipped, with the reason. Files that prior has
    with the same size and mtime keep its hash."""
    kind = "path string, kind int, size long, mtime_ns long, mode long, target string, problem string"

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for at in batch["path"]:
                try:
                    names = sorted(os.listdir(os.fsencode(root.rstrip("/") + at)))
                except OSError:
                    rows.append((at, None, None, None, None, None, "unreadable"))
                    continue
                for raw in names:
                    try:
                        name = raw.decode()
                    except UnicodeDecodeError:
                        rows.append((at + "/" + raw.decode("utf-8", "replace"), None, None, None, None, None, "not_utf8"))
                        continue
                    path = ("" if at == "/" else at) + "/" + name
                    if at == "/" and name in RESERVED:
                        rows.append((path, None, None, None, None, None, "reserved"))
                        continue
                    try:
                        s = os.lstat(root.rstrip("/") + path)
                        k = FILE if stat.S_ISREG(s.st_mode) else DIR if stat.S_ISDIR(s.st_mode) else LINK if stat.S_ISLNK(s.st_mode) else None
                        target = os.readlink(root.rstrip("/") + path) if k == LINK else None
                    except OSError:  # gone since it was listed
                        rows.append((path, None, None, None, None, None, "unreadable"))
                        continue
                    size = 0 if k == DIR else len(target.encode()) if k == LINK else s.st_size
                    rows.append((path, k, size, s.st_mtime_ns, s.st_mode, target, None if k else "special"))
            yield pd.DataFrame(rows, columns=["path", "kind", "size", "mtime_ns", "mode", "target", "problem"]).astype({"kind": "Int32", "size": "Int64", "mtime_ns": "Int64", "mode": "Int64"})

    from ..operators.tree import plan_rehash

    level, found = spark.createDataFrame([(prefix,)], "path string"), []
    while True:
        level = written(level.repartition("path").mapInPandas(listed, kind), "listing")
        found.append(level)
        level = level.where(F.col("kind") == DIR).select("path")
        if level.isEmpty():
            break
    rows = found[0]
    for x in found[1:]:
        rows = rows.unionByName(x)
    good = rows.where("problem is null").drop("problem")
    if prior is None:
        prior = spark.createDataFrame([], "path string, kind int, size long, mtime_ns long, content_hash string")
    planned = plan_rehash(good, prior)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch["path"]:
                try:
                    out.append((path, _hash_file(root.rstrip("/") + path), None))
                except OSError:
                    out.append((path, None, "unreadable"))
            yield pd.DataFrame(out, columns=["path", "read_hash", "problem"])

    todo = planned.where((F.col("kind") == FILE) & (F.col("rehash") == "hash")).select("path")
    bodies = written(todo.repartition("path").mapInPandas(hashed, "path string, read_hash string, problem string"), "hashes")
    whole = planned.join(bodies, "path", "left")
    own = F.when(F.col("kind") == DIR, ZERO_HASH).when(F.col("kind") == LINK, sha256_hex(F.col("target").cast("binary"))).otherwise(F.coalesce("content_hash", "read_hash"))
    meta = whole.where("problem is null").select("path", "kind", "size", "mtime_ns", "mode", own.alias("content_hash"), "rehash")
    skipped = rows.where("problem is not null").select("path", F.col("problem").alias("reason")).unionByName(bodies.where("problem is not null").select("path", F.col("problem").alias("reason")))
    return meta, skipped


def _hash_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state of one object's hash, then its next bytes in order, to the state after them, with the hash once no bytes are left."""
    digest = None
    for batch in batches:
        body = batch.column("body")
        if digest is None and len(body):
            number, left, digest = batch.column("object")[0].as_py(), batch.column("left")[0].as_py(), Sha256(body[0].as_py())
            body = body.slice(1)
        if not len(body):
            continue
        _, ends, data = body.buffers()
        ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(body.type) else np.int32)
        first, size = int(ends[body.offset]), int(ends[body.offset + len(body)] - ends[body.offset])
        size = min(size, left)  # a last line without an end got one
        if size:
            digest.update(data.address + first, size)
        left -= size
    if digest is not None:
        yield pa.RecordBatch.from_pydict({"object": pa.array([number], pa.int32()), "body": pa.array([digest.state()], pa.binary()), "left": [left], "content_hash": pa.array([None if left else digest.hexdigest()], pa.string())})


def _lines(spark: SparkSession, root: str) -> DataFrame:
    """(url, at, n, body) of the objects of over WHOLE bytes: the bytes of the block at `at` in order of n, by lines, cut at PIECE bytes.
    Spark's text reader is the one that splits a file; it must not unpack what a name says is packed, so Hadoop's codec for
    such names is hidden behind another one whose suffix sorts between it and each name, and which no name has."""
    meta = lambda c: F.col("_metadata." + c)
    packed = lambda suffix: F.endswith(meta("file_name"), F.lit(suffix))

    def read(names: Column, **options: str) -> DataFrame:
        text = spark.read.options(recursiveFileLookup="true", lineSep="\n", **options).text(root)
        return text.where((meta("file_size") > WHOLE) & names).select(meta("file_path").alias("url"), meta("file_block_start").alias("at"), "value")

    plain = read(~reduce(lambda a, b: a | b, map(packed, CODECS)))
    hidden = [read(packed(x), **{"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec", **dict.fromkeys(SUFFIX, ".\0" + x)}) for x in CODECS]
    rows, size = reduce(DataFrame.unionByName, hidden, plain), F.octet_length("value") + 1
    body = F.array(F.concat(F.col("value").cast("binary"), F.lit(b"\n")))
    cut = F.flatten(F.transform(body, lambda x: F.transform(F.sequence(F.lit(0), ((size - 1) / PIECE).cast("int")), lambda i: F.substring(x, i * PIECE + 1, F.lit(PIECE)))))  # x is made once
    return rows.select("url", "at", F.explode(F.when(size <= PIECE, body).otherwise(cut)).alias("body")).withColumn("n", F.monotonically_increasing_id())


def _hash_large(spark: SparkSession, root: str, large: DataFrame) -> DataFrame:
    """large (url, path, size) with content_hash. SHA-256 is one chain an object, so it goes from task to task: a round hashes the
    next segment of all objects that have one, a task a segment, from the state that the round before left."""
    ranked = large.orderBy(F.desc("size"), "path").rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    objects = written(spark.createDataFrame(ranked, StructType([*large.schema, StructField("object", IntegerType())])), "objects")
    rows = _lines(spark, root).join(small_side(objects.select("url", "object")), "url")
    parts = written(rows.select("object", "at", "n", "body", F.octet_length("body").alias("bytes"), F.floor(F.col("at") / SEGMENT).cast("int").alias("segment")), "segments", by=("segment",))
    # The reader drops a byte order mark at the start, and ends the last line, if it isn't ended.
    over = F.coalesce("bytes", F.lit(0)) - F.col("size")
    marked, mark = Sha256(), ctypes.create_string_buffer(codecs.BOM_UTF8, 3)
    marked.update(ctypes.addressof(mark), 3)
    changed = F.raise_error(F.concat(F.lit("changed while it was read: "), "path"))
    start = F.when(over.isin(0, 1), F.lit(Sha256().state())).when(over.isin(-3, -2), F.lit(marked.state())).otherwise(changed.cast("binary"))
    states = objects.join(parts.groupBy("object").agg(F.sum("bytes").alias("bytes")), "object", "left")
    states = written(states.select("object", start.alias("body"), (F.col("size") - F.when(over < 0, 3).otherwise(0)).alias("left"), F.lit(None).cast("string").alias("content_hash")), "states")
    last = {r.last: r.n for r in objects.groupBy(F.floor((F.col("size") - 1) / SEGMENT).alias("last")).agg(F.count("*").alias("n")).collect()}
    for k in sorted(r.segment for r in parts.select("segment").distinct().collect()):
        n = sum(v for x, v in last.items() if x >= k)  # the largest objects have the smallest numbers
        before = states.where(F.col("object") < n).select("object", F.lit(-1).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("n"), "body", "left")
        todo = before.unionByName(parts.where(F.col("segment") == k).select("object", "at", "n", "body", F.lit(None).cast("bigint").alias("left")))
        after = todo.repartitionById(n, "object").sortWithinPartitions("at", "n").mapInArrow(_hash_on, states.schema)
        states = written(after.unionByName(states.where(F.col("object") >= n)), "states")
    return objects.join(states.select("object", F.col("content_hash").alias("found")), "object").withColumn("content_hash", F.coalesce("found", changed.cast("string"))).select(*large.columns, "content_hash")


def scan_objects(spark: SparkSession, root: str) -> DataFrame:
    """S1 for object stores: meta of every object below root, bodies hashed by Spark: up to WHOLE bytes from one row, larger ones in segments."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    large = F.col("_metadata.file_size") > WHOLE  # known from the listing, so the others' bodies aren't read
    own = [F.col("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns")]
    found, rest = rows.where(~large).select(*own, sha256_hex(F.col("content")).alias("content_hash")), rows.where(large).select(F.col("_metadata.file_path").alias("url"), *own)
    if not rest.isEmpty():
        found = found.unionByName(_hash_large(spark, root, rest).drop("url"))
    at = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/")
    return found.select(F.substr(at, F.lit(len(base) + 1)).alias("path"), F.lit(FILE).alias("kind"), "size", "mtime_ns", F.lit(0o100644).cast("bigint").alias("mode"), "content_hash")


def read_changes(spark: SparkSession, path: str, stream: bool = False, form: str = "parquet") -> DataFrame:
    """S3. The change log as a table or a stream, with its fixed schema."""
    reader = spark.readStream if stream else spark.read
    return reader.format(form).schema(CHANGE).load(path)


def parse_status_lines(df: DataFrame, col: str = "value") -> DataFrame:
    """S4. Lines `status 5s key=value ...` (fleet) or `status slave=... ...` as columns; others have parsed = false."""
    line = F.col(col)
    good = F.coalesce(line.rlike(r"^status (\d+s|slave=\S+) health=\S+ bottleneck=\S+ "), F.lit(False))
    fields = F.str_to_map(F.when(good, F.regexp_replace(line, r"^status ", "")), F.lit(" "), F.lit("="))
    value = lambda k: F.element_at(fields, F.lit(k))
    number = lambda k: value(k).try_cast("bigint")
    names = {out: key for key, out in LINE_NAMES.items()}
    error = value("last_error")
    return df.select(
        *df.columns,
        F.when(good, F.regexp_extract(line, r"^status (\d+)s ", 1)).try_cast("bigint").alias("period_s"),
        value("slave").alias("slave"), value("health").alias("health"), value("bottleneck").alias("bottleneck"),
        *[number(names.get(c, c)).alias(c) for c in COUNTERS],
        *[number(q).alias(q) for q in QUEUE_NAMES],
        F.when(error != "-", F.regexp_replace(error, r"\*\d+$", "")).alias("last_error"),
        F.when(error == "-", 0).otherwise(F.coalesce(F.regexp_extract(error, r"\*(\d+)$", 1).try_cast("bigint"), F.when(error.isNotNull(), 1))).cast("bigint").alias("error_count"),
        good.alias("parsed"),
    )


def little_endian(frame: Column, at: int, size: int) -> Column:
    """An unsigned little-endian number of size bytes at byte `at` of a binary column."""
    digits = [F.hex(F.substring(frame, at + 1 + i, 1)) for i in reversed(range(size))]
    return F.conv(F.concat(*digits), 16, 10).cast("bigint")


def decode_gauges(df: DataFrame, col: str = "frame") -> DataFrame:
    """S6. df with valid and the fields of 25-byte gauge frames; malformed ones have valid = false and null fields."""
    frame = F.col(col)
    code = little_endian(frame, 8, 1)
    valid = F.coalesce((F.octet_length(frame) == 25) & (F.lower(F.hex(F.substring(frame, 1, 4))) == GAUGE_MAGIC) & (code <= len(STAGES)), F.lit(False))
    stage = F.get(F.array(F.lit(None).cast("string"), *map(F.lit, STAGES)), code.cast("int"))
    spans = {"seq": (4, 4), "age_ms": (9, 4), "depth": (13, 4), "parked": (17, 2), "sending": (19, 2), "pending": (21, 4)}
    rows = df.withColumn("valid", valid)
    return rows.withColumns({"stage": F.when(F.col("valid"), stage), **{n: F.when(F.col("valid"), little_endian(frame, *s)) for n, s in spans.items()}})
