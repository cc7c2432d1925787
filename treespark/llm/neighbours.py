"""Nearest neighbours by inner product, as a block matrix join.

Method: rows of equal vectors are one class, with its k + 1 smallest ids; classes are what is compared. Each is
quantised once to int8, with its scale, its power of two and the norms of what was kept and of what was
left. Queries and candidates are dealt to blocks by a hash; each pair of a query block and a candidate block is a tile,
computed in one task from int8 codes only. The product of the codes gives every score but for an error that the norms
bound. In its tile, and then over all tiles of its query, a pair survives if its upper bound reaches the k-th largest lower bound of
its query; bounds stream by in order, so memory holds one row. Survivors fetch their original vectors by joins
and are computed again in double precision, dimension by dimension; heaps of rows a query merge them, and each query of a class leaves out its own id.

Blocks are of bounded size, so is a task's memory. Copies cost nothing: a million copies of a vector are one class, of which no
more ids are kept than a result has rows (the group limit of a window keeps them so few before the shuffle too).
The product is exact: int8 values are multiplied as float32, where sums of up to 1,000 products of 127 * 127 fit.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; nor do rows with a
null id. Rows equal in id and vector count once; an id with several vectors gives a candidate for each, none of which
meets a query of its own id, and as a query a result for each. Vectors meet only vectors of the same length. Ties go to the smaller vec_id. Bounds are of vectors
scaled by powers of two, and pairs whose powers add up to more than 900 either way always survive, so very small and very large
vectors lose no pair; a score that leaves the range of doubles is infinite, and one that isn't a number counts as the least. Extra columns are ignored; an empty table gives an empty result.
Vectors are named by two 64-bit hashes together.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, id, v, dim): the rows that take part, each once; equal vectors have one key."""
    v = F.col("v")
    finite = F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    rows = rows.select("id", F.transform(v, lambda x: x + F.lit(0.0)).alias("v"))  # no negative zeros
    key = F.concat(F.hex(F.xxhash64("v")), F.lit("-"), F.hex(F.xxhash64(F.lit("again"), "v")))
    return rows.select(key.alias("key"), "id", "v", F.size("v").alias("dim"))


def classes(rows: DataFrame, ids: int) -> DataFrame:
    """(key, v, dim, ids): the distinct vectors, each with its smallest ids, `ids` at most."""
    once = rows.withColumn("_nth", F.dense_rank().over(Window.partitionBy("key").orderBy("id"))).where(F.col("_nth") <= ids)
    return once.groupBy("key").agg(F.any_value("v").alias("v"), F.any_value("dim").alias("dim"), F.array_sort(F.collect_set("id")).alias("ids"))


def quantised(m: np.ndarray) -> pd.DataFrame:
    """Of rows: int8 codes, the scale, the power of two taken out before, and the norms of codes times scale and of the rest."""
    power = np.frexp(np.abs(m).max(axis=1))[1]
    m = np.ldexp(m, -power[:, None] // 2)  # in two steps: the whole power may not be a double
    m = np.ldexp(m, -power[:, None] - -power[:, None] // 2)
    scale = np.abs(m).max(axis=1) / 127
    codes = np.rint(m / scale[:, None])
    back = codes * scale[:, None]
    return pd.DataFrame({"code": [c.tobytes() for c in codes.astype(np.int8)], "scale": scale, "power": power, "norm": np.linalg.norm(back, axis=1), "rest": np.linalg.norm(m - back, axis=1)})


def coded(rows: DataFrame) -> DataFrame:
    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, own in batch.groupby("dim"):
                found = quantised(np.stack(own["v"]))
                yield pd.concat([own[["no", "dim"]].reset_index(drop=True), found], axis=1)

    return rows.select("no", "v", "dim").mapInPandas(code, "no long, dim int, code binary, scale double, power int, norm double, rest double")


def tile_pairs(q: pd.DataFrame, c: pd.DataFrame, k: int, rows: int = 64) -> pd.DataFrame:
    """(q_no, c_no, low, high): bounds of the pairs of a tile that may be among their query's k best, but for the query's power of two."""
    out: list[tuple[np.ndarray, ...]] = []
    q8, c8 = (np.frombuffer(b"".join(x["code"]), np.int8).reshape(len(x), -1).astype(np.float32) for x in (q, c))
    (qkey, qs, qn, qe), (ckey, cs, cn, ce) = ([x[n].to_numpy() for n in ("no", "scale", "norm", "rest")] for x in (q, c))
    power = c["power"].to_numpy()
    step = 1024  # dimensions at a time, so that float32 sums stay exact
    for at in range(0, len(q), rows):
        own = slice(at, at + rows)
        product = sum((q8[own, d : d + step] @ c8[:, d : d + step].T).astype(np.float64) for d in range(0, q8.shape[1], step))
        near = product * qs[own, None] * cs
        error = (qn[own, None] + qe[own, None]) * ce + qe[own, None] * cn
        error += 1e-12 * ((qn + qe)[own, None] * (cn + ce) + np.abs(near))
        with np.errstate(over="ignore", under="ignore"):
            low, high = (np.ldexp(x, power) for x in (near - error, near + error))
        edge = (np.abs(q["power"].to_numpy()[own, None] + power) > 900) | (np.abs(power) > 900)  # sums may leave the range of doubles: no bound holds
        low, high = np.where(edge, -np.inf, low), np.where(edge, np.inf, high)
        floor = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
        i, j = np.nonzero(high >= floor[:, None])
        out.append((qkey[at + i], ckey[j], low[i, j], high[i, j]))
    return pd.DataFrame(dict(zip(("q_no", "c_no", "low", "high"), map(np.concatenate, zip(*out)))))


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 20, query_block: int = 2048, candidate_block: int = 8192, least_tiles: int = 24) -> DataFrame:
    """(q_no, vec_id, score): for each query class the k candidate rows of largest inner product, by (score, id) of each class's ids.

    queries and candidates are written tables of classes()'s columns, with a number `no` for each class.
    """
    n, m = queries.count(), candidates.count()
    q_blocks = max(1, math.ceil(n / query_block))
    c_blocks = max(1, math.ceil(m / candidate_block), min(math.ceil(m / 256), math.ceil(least_tiles / q_blocks)))

    def dealt(rows: DataFrame, blocks: int, others: int, own: str, other: str) -> DataFrame:
        block: Column = F.pmod(F.xxhash64("no"), F.lit(blocks)).cast("int")
        return coded(rows).select("*", block.alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    tile = ["dim", "qb", "cb"]
    left = dealt(queries, q_blocks, c_blocks, "qb", "cb").groupBy(*tile)
    right = dealt(candidates, c_blocks, q_blocks, "cb", "qb").groupBy(*tile)

    def bounds(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"q_no": [], "c_no": [], "low": [], "high": []}) if q.empty or c.empty else tile_pairs(q, c, k)

    def surviving(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, seen, floor = None, 0, -math.inf
        for batch in batches:  # by query, the largest lower bounds first
            keep = []
            for query, low, high in zip(batch["q_no"].tolist(), batch["low"].tolist(), batch["high"].tolist()):
                if query != last:
                    last, seen, floor = query, 0, -math.inf
                seen += 1
                floor = low if seen == k else floor
                keep.append(high >= floor)
            yield batch.loc[keep, ["q_no", "c_no"]]

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            scores = batch["score"].fillna(-math.inf)
            for key, ids, score in zip(batch["q_no"].tolist(), batch["ids"].tolist(), scores.tolist()):
                heap = heaps.setdefault(key, [])
                for vec in map(int, ids):
                    if len(heap) < k:
                        heapq.heappush(heap, (score, -vec))
                    elif (score, -vec) > heap[0]:
                        heapq.heapreplace(heap, (score, -vec))
                    else:
                        break  # the class's other ids are larger
        rows = [(key, -vec, score) for key, heap in heaps.items() for score, vec in heap]
        for at in range(0, len(rows), 50_000):
            yield pd.DataFrame(rows[at : at + 50_000], columns=["q_no", "vec_id", "score"])

    tiles = left.cogroup(right).applyInPandas(bounds, "q_no long, c_no long, low double, high double")
    in_order = tiles.repartition("q_no").sortWithinPartitions("q_no", F.desc("low"))
    pairs = in_order.mapInPandas(surviving, "q_no long, c_no long")
    both = pairs.join(candidates.select(F.col("no").alias("c_no"), F.col("v").alias("c"), "ids"), "c_no").join(queries.select(F.col("no").alias("q_no"), F.col("v").alias("q")), "q_no")
    score = F.aggregate(F.zip_with("q", "c", lambda a, b: a * b), F.lit(0.0), lambda total, x: total + x)
    exact = both.select("q_no", "ids", score.alias("score")).repartition("q_no")
    return exact.mapInPandas(merge, "q_no long, vec_id long, score double")


def search(vectors: DataFrame, is_query: Column, k: int = 20, **blocks) -> DataFrame:
    """(query_id, rank, vec_id, score): of the rows of vectors (vec_id, embedding) where is_query holds (an expression over id), each
    one's k nearest rows of other ids, nearest first."""
    rows = written(usable(vectors), "vectors")
    asking = written(rows.where(is_query).select("id", "key").distinct(), "asking")
    own = asking.groupBy("id").count().agg(F.max("count")).first()[0] or 1  # so many rows can be a query's own
    found = written(classes(rows, k + own).withColumn("no", F.monotonically_increasing_id()), "classes")
    asked = written(found.join(asking.select("key").distinct(), "key", "left_semi"), "asked")
    best = nearest(asked, found, k + own, **blocks)
    met = asking.withColumnRenamed("id", "query_id").join(asked.select("key", F.col("no").alias("q_no")), "key").join(best, "q_no").where(F.col("vec_id") != F.col("query_id"))
    order = Window.partitionBy("q_no", "query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
