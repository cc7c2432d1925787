"""Transfer plans, block tables, deltas and chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import decide, null_safe
from ..functions.hashing import HashFn, sha256_hex
from ..schema import FILE, LINK

BASIS_BYTES, LARGE_BYTES, BLOCK = 4096, 16 << 20, 2048


def transfer_plan(pulls: DataFrame, basis: DataFrame) -> DataFrame:
    """T1. pulls (path, kind, size) with mode, transfer_bytes and large; basis (path, kind, size) is what the receiver holds."""
    have = basis.select("path", F.col("kind").alias("_kind"), F.col("size").alias("_size"))
    delta = (F.col("kind") == FILE) & (F.col("_kind") == FILE) & (F.col("_size") >= BASIS_BYTES)
    moved = decide((F.coalesce(delta, F.lit(False)), "Delta"), (F.col("kind").isin(FILE, LINK), "Whole"), otherwise="None")
    rows = pulls.join(have, "path", "left").withColumn("mode", moved)
    return rows.withColumn("transfer_bytes", F.when(F.col("mode") == "None", 0).otherwise(F.col("size"))).withColumn("large", F.col("size") >= LARGE_BYTES).drop("_kind", "_size")


def _blocks(body: Column, size: int) -> Column:
    raw = body.cast("binary")
    n = F.ceil(F.octet_length(raw) / size).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(raw, i * size + 1, F.lit(size)))


def block_signatures(bodies: DataFrame, block: int = BLOCK, hash_fn: HashFn = sha256_hex) -> DataFrame:
    """T2. (path, block, length, strong) of each fixed-size block of bodies (path, body)."""
    rows = bodies.select("path", F.posexplode(_blocks(F.col("body"), block)).alias("block", "part"))
    return rows.select("path", "block", F.octet_length("part").alias("length"), hash_fn(F.col("part")).alias("strong"))


def block_delta(sources: DataFrame, signatures: DataFrame, block: int = BLOCK, hash_fn: HashFn = sha256_hex) -> DataFrame:
    """T3, aligned. For each block of sources (path, body): from (the basis block that equals it, the first such) or its
    literal bytes in hex; reused says which."""
    rows = sources.select("path", F.posexplode(_blocks(F.col("body"), block)).alias("block", "part")).withColumn("strong", hash_fn(F.col("part")))
    have = signatures.groupBy("path", "strong").agg(F.min("block").alias("from"))
    found = rows.join(have, ["path", "strong"], "left")
    return found.select("path", "block", "from", F.when(F.col("from").isNull(), F.hex("part")).alias("literal"), F.col("from").isNotNull().alias("reused"))


def _rolling(body: bytes, block: int) -> np.ndarray:
    """Weak sums of every window of body: two 16-bit sums, as in the published rsync algorithm."""
    raw = np.frombuffer(body, np.uint8).astype(np.int64)
    plain = np.concatenate([[0], np.cumsum(raw)])
    weighted = np.concatenate([[0], np.cumsum(raw * np.arange(len(raw)))])
    at = np.arange(len(raw) - block + 1)
    a = plain[at + block] - plain[at]
    b = (at + block) * a - (weighted[at + block] - weighted[at])
    return (a & 0xFFFF) | (b & 0xFFFF) << 16


def _delta(body: bytes, have: bytes, block: int) -> list[tuple]:
    """Ops (basis_at, length, literal) that rebuild body from have."""
    ops: list[tuple] = []
    blocks: dict[int, list[int]] = {}
    if len(have) >= block and len(body) >= block:
        for i, weak in enumerate(_rolling(have, block)[::block].tolist()):
            blocks.setdefault(weak, []).append(i * block)
    at = literal = 0
    if blocks:
        weak = _rolling(body, block)
        for hit in np.nonzero(np.isin(weak, list(blocks)))[0].tolist():
            if hit < at:
                continue
            part = body[hit : hit + block]
            same = next((b for b in blocks[int(weak[hit])] if have[b : b + block] == part), None)
            if same is not None:
                if hit > literal:
                    ops.append((None, hit - literal, body[literal:hit]))
                ops.append((same, block, None))
                at = literal = hit + block
    if literal < len(body):
        ops.append((None, len(body) - literal, body[literal:]))
    return ops


def rolling_delta(sources: DataFrame, basis: DataFrame, block: int = BLOCK) -> DataFrame:
    """T3, at any offset. Ops (path, op_no, basis_at, length, literal) that rebuild each source (path, body) from its basis
    (path, body): copies of basis blocks found by weak sum and byte comparison, literals between. A path has one body on each side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, n, *op) for path, body, have in zip(*[batch[c].tolist() for c in ("path", "body", "have")]) for n, op in enumerate(_delta(body or b"", have or b"", block))]
            out = pd.DataFrame(rows, columns=["path", "op_no", "basis_at", "length", "literal"])
            yield out.astype({"basis_at": "Int64"})

    one = lambda df, name: df.groupBy("path").agg(F.any_value(F.col("body").cast("binary")).alias(name))
    pairs = null_safe(one(sources, "body"), one(basis, "have"), ["path"], "left")
    return pairs.select("path", "body", "have").mapInPandas(run, "path string, op_no int, basis_at long, length long, literal binary")


def apply_delta(ops: DataFrame, basis: DataFrame, block: int = BLOCK) -> DataFrame:
    """T4. (path, body) rebuilt from aligned ops (path, block, from, literal) and the basis's blocks."""
    parts = basis.select("path", F.posexplode(_blocks(F.col("body"), block)).alias("from", "part"))
    rows = ops.join(parts, ["path", "from"], "left").select("path", "block", F.coalesce(F.hex("part"), F.col("literal")).alias("hex"))
    whole = rows.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("block", "hex"))).alias("parts"))
    return whole.select("path", F.unhex(F.array_join(F.transform("parts", lambda p: p["hex"]), "")).alias("body"))


def verify_bodies(bodies: DataFrame, hash_fn: HashFn = sha256_hex) -> DataFrame:
    """T4. bodies (path, body, want_hash) with verdict: accept where the hash agrees, else retry_whole."""
    ok = hash_fn(F.col("body").cast("binary")) == F.col("want_hash")
    return bodies.withColumn("verdict", F.when(ok, "accept").otherwise("retry_whole"))


def chunk_bodies(bodies: DataFrame, most: int = LARGE_BYTES) -> DataFrame:
    """T5. (path, chunk, total, data): bodies in chunks of `most` bytes at most; an empty body is one empty chunk."""
    raw = F.col("body").cast("binary")
    chunks = F.when(F.octet_length(raw) == 0, F.array(raw)).otherwise(_blocks(F.col("body"), most))
    return bodies.select("path", F.octet_length(raw).cast("bigint").alias("total"), F.posexplode(chunks).alias("chunk", "data"))


def reassemble(chunks: DataFrame, most: int = LARGE_BYTES) -> DataFrame:
    """T5. (path, body, problem): whole bodies; problem names an oversize chunk, a gap, or a total that doesn't fit."""
    rows = chunks.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("chunk", F.hex("data").alias("hex")))).alias("parts"), F.max("total").alias("total"))
    digits = F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + F.length(p["hex"]))
    problem = decide(
        (F.exists("parts", lambda p: F.length(p["hex"]) > 2 * most), "oversize"),
        (F.exists(F.transform("parts", lambda p, i: p["chunk"] != i), lambda x: x), "gap"),
        (digits != 2 * F.col("total"), "total"),
    )
    body = F.unhex(F.array_join(F.transform("parts", lambda p: p["hex"]), ""))
    return rows.withColumn("problem", problem).select("path", F.when(F.col("problem").isNull(), body).alias("body"), "problem")
