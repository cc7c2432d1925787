"""T3 at any offset, over bodies kept as ordered chunks: no body lies in one row, and a large one is worked off by many tasks.

A body is rows (path, at, data): chunks of `size` bytes (the last may be shorter), a multiple of the block length. The basis is cut into blocks at multiples
of the block length, each with a weak sum and a strong hash. A chunk of the new body, with the beginning of the next one, gives the weak sums of all its
offsets by prefix sums; those that a small bitmap of the path's sums lets through are shuffled by (path, weak sum) to the blocks' sums, and only where these
meet is the strong hash of that window made and joined. Hits come sorted by offset to a stream that takes each one that begins where the last one
has ended or later, as a scan of the body from its start would.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import written

#: Bits of a path's bitmap for each of its sums, and at most: beyond, more offsets pass it, and the join by weak sums does the work.
BITS_A_SUM, MOST_BITS = 16, 1 << 24


def chunked(bodies: DataFrame, size: int, col: str = "body") -> DataFrame:
    """(path, at, data) of bodies that are small enough for a row; larger ones are read in chunks from the start."""
    body = F.col(col).cast("binary")
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.octet_length(body) - 1, F.lit(0)).cast("bigint"), F.lit(size).cast("bigint"))
    rows = bodies.select("path", body.alias("_body"), F.explode(starts).alias("at"))
    return rows.select("path", "at", F.substring("_body", F.col("at").cast("int") + 1, F.lit(size)).alias("data"))


def weak_sums(data: bytes, block: int) -> np.ndarray:
    """The weak sum of each window of block bytes: their sum, and their sum weighted by the distance from the window's end."""
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    if len(raw) < block:
        return np.zeros(0, np.int64)
    plain, weighted = (np.concatenate([np.zeros(1, np.int64), np.cumsum(x)]) for x in (raw, raw * np.arange(len(raw))))
    low = plain[block:] - plain[:-block]
    high = (block + np.arange(len(low))) * low - (weighted[block:] - weighted[:-block])
    return (high & 0xFFFFFFFF) << 16 & 0xFFFF0000 | low & 0xFFFF


def signatures(chunks: DataFrame, block: int) -> DataFrame:
    """(path, weak, strong, basis_at) of each distinct whole block; basis_at is its first place."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, at, data in zip(batch["path"].tolist(), batch["at"].tolist(), batch["data"].tolist()):
                for i, weak in enumerate(weak_sums(data, block)[::block].tolist()):
                    rows.append((path, weak, hashlib.sha256(data[i * block : (i + 1) * block]).digest(), at + i * block))
            yield pd.DataFrame(rows, columns=["path", "weak", "strong", "basis_at"])

    found = chunks.select("path", "at", "data").mapInPandas(sign, "path string, weak long, strong binary, basis_at long")
    return found.groupBy("path", "weak", "strong").agg(F.min("basis_at").alias("basis_at"))


def _bitmaps(sums: DataFrame) -> DataFrame:
    """(path, bits, bitmap) of the weak sums of each path."""
    counted = sums.groupBy("path").count()
    bits = F.least(F.lit(MOST_BITS), F.greatest(F.lit(256), F.pow(F.lit(2), F.ceil(F.log2(F.col("count") * BITS_A_SUM))).cast("int")))
    rows = sums.select("path", "weak").join(counted.select("path", bits.alias("bits")), "path").repartition("path").sortWithinPartitions("path")

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, None
        for batch in batches:
            done = []
            paths, sizes, sums = batch["path"].tolist(), batch["bits"].tolist(), batch["weak"].to_numpy()
            starts = [i for i in range(len(paths)) if i == 0 or paths[i] != paths[i - 1]]
            for i, end in zip(starts, [*starts[1:], len(paths)]):
                if paths[i] != now:
                    done += [] if now is None else [(now, len(held), np.packbits(held).tobytes())]
                    now, held = paths[i], np.zeros(sizes[i], bool)
                held[_spot(sums[i:end], sizes[i])] = True
            yield pd.DataFrame(done, columns=["path", "bits", "bitmap"])
        yield pd.DataFrame([] if now is None else [(now, len(held), np.packbits(held).tobytes())], columns=["path", "bits", "bitmap"])

    return rows.mapInPandas(mark, "path string, bits int, bitmap binary")


def _spot(weak: np.ndarray, bits: int) -> np.ndarray:
    return (weak * 2654435761 >> 7) % bits


def passing(batch: pd.DataFrame, block: int) -> pd.DataFrame:
    """(path, at, weak, offset) of the offsets of all the windows of a batch that their path's bitmap lets through."""
    found = []
    for path, at, data, own, bits, bitmap in zip(*[batch[c].tolist() for c in ("path", "at", "data", "own", "bits", "bitmap")]):
        weak = weak_sums(data, block)[:own]  # windows that begin in the chunk itself
        spot = _spot(weak, bits)
        good = np.nonzero(np.frombuffer(bitmap, np.uint8)[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8) & 1)[0]
        found += [(path, at, *x) for x in zip(weak[good].tolist(), good.tolist())]
    return pd.DataFrame(found, columns=["path", "at", "weak", "offset"])


def _windows(chunks: DataFrame, block: int) -> DataFrame:
    """chunks whose data goes on for the block - 1 bytes after them."""
    ahead = chunks.select("path", F.col("at").alias("_end"), F.substring("data", F.lit(1), F.lit(block - 1)).alias("_more"))
    rows = chunks.select("path", "at", "data", (F.col("at") + F.octet_length("data")).alias("_end")).join(ahead, ["path", "_end"], "left")
    return rows.select("path", "at", F.concat("data", F.coalesce("_more", F.lit(b"").cast("binary"))).alias("data"), F.octet_length("data").alias("own"))


def chunk_delta(new: DataFrame, old: DataFrame, block: int) -> DataFrame:
    """(path, op_no, at, length, basis_at): in order of op_no, what makes the new body: a block of the basis, or (basis_at null) bytes of its own."""
    sums = written(signatures(old, block), "signatures")
    windows = written(_windows(new, block), "windows")

    def strong(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, at, data, offsets in zip(*[batch[c].tolist() for c in ("path", "at", "data", "offsets")]):
                rows += [(path, at + int(i), hashlib.sha256(data[i : i + block]).digest()) for i in offsets]
            yield pd.DataFrame(rows, columns=["path", "offset", "strong"])

    weak = windows.join(_bitmaps(sums), "path").mapInPandas(lambda batches: (passing(batch, block) for batch in batches), "path string, at long, weak long, offset long")
    asks = weak.join(sums.select("path", "weak").distinct(), ["path", "weak"], "left_semi").groupBy("path", "at").agg(F.collect_list("offset").alias("offsets"))
    hashed = windows.join(asks, ["path", "at"]).mapInPandas(strong, "path string, offset long, strong binary")
    first = sums.groupBy("path", "strong").agg(F.min("basis_at").alias("basis_at"))
    hits = hashed.join(first, ["path", "strong"]).select("path", "offset", "basis_at")
    ends = new.groupBy("path").agg(F.max(F.col("at") + F.octet_length("data")).alias("offset")).withColumn("basis_at", F.lit(-1).cast("bigint"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, free, n = None, 0, 0
        for batch in batches:
            ops = []
            for own, offset, basis_at in zip(*[batch[c].tolist() for c in ("path", "offset", "basis_at")]):
                if own != path:
                    path, free, n = own, 0, 0
                if offset < free:
                    continue
                if offset > free:
                    ops.append((path, n, free, offset - free, -1))
                    n += 1
                if basis_at >= 0:
                    ops.append((path, n, offset, block, basis_at))
                    free, n = offset + block, n + 1
            yield pd.DataFrame(ops, columns=["path", "op_no", "at", "length", "basis_at"])

    in_order = hits.unionByName(ends).repartition("path").sortWithinPartitions("path", "offset", F.desc("basis_at"))
    ops = in_order.mapInPandas(choose, "path string, op_no long, at long, length long, basis_at long")
    return ops.withColumn("basis_at", F.when(F.col("basis_at") >= 0, F.col("basis_at")))


def rebuilt(ops: DataFrame, new: DataFrame, old: DataFrame, size: int) -> DataFrame:
    """(path, body_hash): SHA-256 of what the ops make of the basis' chunks and the new body's own bytes, as a stream of pieces in order."""
    source = F.coalesce("basis_at", "at")
    spans = ops.select("path", "op_no", source.alias("from"), "length", F.col("basis_at").isNotNull().alias("copied"))
    spans = spans.withColumn("chunk", F.explode(F.expr(f"sequence(`from` div {size}, (`from` + length - 1) div {size})")))
    held = old.withColumn("copied", F.lit(True)).unionByName(new.withColumn("copied", F.lit(False))).withColumn("chunk", F.col("at").cast("bigint")).withColumn("chunk", F.expr(f"chunk div {size}"))
    rows = spans.join(held.select("path", "copied", "chunk", "at", "data"), ["path", "copied", "chunk"])
    low = F.greatest(F.col("from"), F.col("at"))
    high = F.least(F.col("from") + F.col("length"), F.col("at") + F.octet_length("data"))
    pieces = rows.select("path", "op_no", "chunk", F.substring("data", (low - F.col("at") + 1).cast("int"), (high - low).cast("int")).alias("piece"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, state = None, None
        for batch in batches:
            done = []
            for own, piece in zip(batch["path"].tolist(), batch["piece"].tolist()):
                if own != path:
                    done += [] if path is None else [(path, state.hexdigest())]
                    path, state = own, hashlib.sha256()
                state.update(piece)
            yield pd.DataFrame(done, columns=["path", "body_hash"])
        yield pd.DataFrame([] if path is None else [(path, state.hexdigest())], columns=["path", "body_hash"])

    return pieces.repartition("path").sortWithinPartitions("path", "op_no", "chunk").mapInPandas(digest, "path string, body_hash string")
