"""SimHash near-duplicates by multi-index hashing.

Method: every text gets a 64-bit SimHash. Two fingerprints at 2 or fewer differing bits link. A pair at
distance 2 or less has, in its high and low halves, the distances (0, <=2), (<=2, 0) or (1, 1). Equal halves
are found by an exact look-up of the half; halves at distance 1 by enumerating the Hamming ball of radius 1
around the half. The other half may then differ in at most 2 (or 1) bits, so one of its thirds (or of its own
halves) is equal, and joins the key: tables stay fine however many fingerprints share a half. Each match is
verified over all 64 bits inside the join.

Only distinct fingerprints are searched, so copies never make pairs; distinct fingerprints within 2 bits of one
fingerprint number 2,080 at most, so links grow in proportion. Components are found by alternating large and small
star steps made of joins and partial aggregates; no group is ever collected.

Defined results: null text counts as empty; empty text (no words) has fingerprint zero and links like any
other; a null doc_id keeps its row and never names a component unless no other id is there; repeated rows are
kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, release_memory, text_or_empty, written

BLOCK = 1 << 15


def simhash(text: str, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text, as a signed integer: XXH64 over word shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only \x20 and \x09-\x0D
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - width]]
    digest, counts, n = xxhash.xxh64_digest, np.zeros(64, np.int64), len(starts)
    for at in range(0, n, BLOCK):
        spans = zip(starts[at : at + BLOCK], ends[at + width - 1 :])
        raw = b"".join([digest(joined[a : b - 1], seed) for a, b in spans])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n).view(">i8")[0])


@F.pandas_udf(T.LongType())
def _simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([simhash(t) for t in batch], dtype="int64")
    release_memory()


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs.doc_id with fp, the SimHash as a signed BIGINT."""
    return docs.select("doc_id", _simhash(text_or_empty(text)).alias("fp"))


def _keys(fp: Column) -> tuple[Column, list[Column], list[Column], list[Column]]:
    """The high half, the halves of the low half, and (kind, key) structs: of equal halves, and of the balls' targets."""
    high, low = F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))

    def entry(kind: int, half: Column, part: Column) -> Column:
        return F.struct(F.lit(kind).cast("tinyint").alias("kind"), F.shiftleft(half, 32).bitwiseOR(part).alias("key"))

    def third(half: Column, i: int) -> Column:
        return half.bitwiseAND(F.lit([0x7FF, 0x3FF800, 0xFFC00000][i]))

    exact = [entry(i, high, third(low, i)) for i in range(3)] + [entry(3 + i, low, third(high, i)) for i in range(3)]
    halves = [low.bitwiseAND(F.lit(m)) for m in (0xFFFF, 0xFFFF0000)]
    ball = [entry(6 + j, high, halves[j]) for j in range(2)]
    return high, halves, exact, ball


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints at 1 to max_bits (2 at most) differing bits, each once or more."""
    if max_bits > 2:
        raise ValueError("the tables cover 2 differing bits at most")
    fp = F.col("fp")
    high, halves, exact, targets = _keys(fp)
    flips = F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)), lambda bit: high.bitwiseAND(bit) == 0)
    # only 0 bits are set: of two halves at distance 1, one reaches the other
    def ball(kind: int, part: Column) -> Column:
        return F.transform(flips, lambda bit: F.struct(F.lit(kind).cast("tinyint").alias("kind"), F.shiftleft(high.bitwiseOR(bit), 32).bitwiseOR(part).alias("key")))

    held = fps.select(fp.alias("b"), F.explode(F.array(*exact, *targets)).alias("e")).select("b", "e.kind", "e.key")
    sought = fps.select(fp.alias("a"), F.explode(F.concat(F.array(*exact), ball(6, halves[0]), ball(7, halves[1]))).alias("e")).select("a", "e.kind", "e.key")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    once = (F.col("kind") >= 6) | (F.col("a") < F.col("b"))
    return sought.join(held, ["kind", "key"]).where(near & once & (F.col("a") != F.col("b"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node reachable."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        # the same edges again, but for a chance of one in 2^64 and less
        state = now.agg(F.count("*"), *[F.sum(F.xxhash64(F.lit(seed), "u", "v").cast("decimal(38,0)")) for seed in (1, 2)]).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        before = state
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = written(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")


def simhash_components(docs: DataFrame, text: str = "text", max_bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every row of docs."""
    bounded_batches(docs.sparkSession)
    own = written(fingerprints(docs, text), "fingerprints")
    fps = own.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(fps.select("fp"), max_bits))
    named = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = written(named.join(ids, "root").select("fp", "component_id"), "components")
    return own.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
