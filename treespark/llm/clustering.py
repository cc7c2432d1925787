"""Centroid clustering of vectors in whole numbers, with Orchard's search for the nearest centroid.

Method: every centroid has a list of the others by their distance from it. A vector starts at centroid 0 and walks its current
centroid's list: each centroid not yet visited is measured and marked; one that is nearer (or as near with a smaller number)
becomes the current one, and its own list is walked from its start. The walk ends at the list's end, or at a centroid strictly
farther from the current one than twice the vector's distance: by the triangle inequality what follows is strictly
farther from the vector. A batch of vectors walks in step, so each step is a few array operations.

A round keeps at the driver only the centroids (k of them): tasks add up counts and component sums per centroid, and Spark adds up
those. Vectors are written once in the shared folder; a lost executor costs its tasks' part of one round. Nothing is shuffled but
one row a task and centroid.

Defined results: a vector takes part if it has `dim` components, none null or not finite, and floor(scale * x) of each lies
within 2^26 either way, so that sums of squares and four times them fit 64 bits. Rows count as often as they come; rows of
one id are ordered by their components where the start asks for an order; rows without an id take part, but are no start. With fewer rows
than k there are fewer centroids; an empty table gives an empty result. An empty centroid stays where it is. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release_memory, written

LIMIT = 1 << 26


def usable(vectors: DataFrame, dim: int, scale: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): the vectors that take part, as whole numbers floor(scale * x)."""
    raw = F.col(vector).cast("array<double>")
    near = F.forall("x", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), raw.alias("x")).where((F.size("x") == dim) & near)
    rows = rows.where(F.forall("x", lambda x: F.abs(x * F.lit(float(scale))) < float(LIMIT)))
    return rows.select("id", F.transform("x", lambda x: F.floor(x * F.lit(float(scale))).cast("int")).alias("v"))


def start(rows: DataFrame, k: int, rank: Column) -> np.ndarray:
    """The k rows that come first by rank, then by id and components."""
    first = rows.where(F.col("id").isNotNull()).select(rank.alias("_rank"), "id", "v").orderBy("_rank", "id", "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64)


class Centroids:
    """Centroids with each one's list of the others, nearest first, and their distances (squared)."""

    def __init__(self, points: np.ndarray):
        self.points = points
        between = np.stack([self._squares(points, p) for p in points])
        order = np.argsort(between, axis=1, kind="stable")
        k = len(points)
        self.lists = np.stack([row[row != i] for i, row in enumerate(order)]) if k > 1 else np.zeros((k, 0), np.int64)
        self.far = np.take_along_axis(between, self.lists, axis=1)

    @staticmethod
    def _squares(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
        apart = rows - to
        return np.einsum("ij,ij->i", apart, apart)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Of each row the nearest centroid and the squared distance; and how many distances were measured."""
        n, k = len(rows), len(self.points)
        now, measured = np.zeros(n, np.int64), n
        near = self._squares(rows, self.points[0])
        visited = np.zeros((n, k), bool)
        visited[:, 0] = True
        place = np.zeros(n, np.int64)
        walking = np.arange(n) if k > 1 else np.arange(0)
        while len(walking):
            c, p = now[walking], place[walking]
            walking = walking[self.far[c, p] <= 4 * near[walking]]  # what is strictly beyond twice the distance ends the walk
            c, p = now[walking], place[walking]
            other = self.lists[c, p]
            fresh = ~visited[walking, other]
            place[walking] += 1
            ask, j = walking[fresh], other[fresh]
            measured += len(ask)
            visited[ask, j] = True
            there = self._squares(rows[ask], self.points[j])
            jump = (there < near[ask]) | (there == near[ask]) & (j < now[ask])
            moved = ask[jump]
            now[moved], near[moved], place[moved] = j[jump], there[jump], 0
            walking = walking[place[walking] < k - 1]
        return now, near, measured


def _stacked(batch: pd.DataFrame) -> np.ndarray:
    return np.stack(batch["v"].to_numpy()).astype(np.int64)


def moved(rows: DataFrame, points: np.ndarray) -> np.ndarray:
    """The centroids after a round: each the floor of its rows' mean, by components; one without rows stays."""
    centroids, dim = Centroids(points), points.shape[1]

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, sums = np.zeros(len(points), np.int64), np.zeros(points.shape, np.int64)
        for batch in batches:
            v = _stacked(batch)
            own, _, _ = centroids.nearest(v)
            counts += np.bincount(own, minlength=len(points))
            np.add.at(sums, own, v)
        held = np.nonzero(counts)[0]
        yield pd.DataFrame({"cluster": held, "n": counts[held], "sums": list(sums[held])})
        release_memory()

    parts = rows.select("v").mapInPandas(add_up, "cluster long, n long, sums array<long>")
    whole = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim)])
    out = points.copy()
    for r in whole.collect():  # k rows at most
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
    return out


def assigned(rows: DataFrame, points: np.ndarray) -> DataFrame:
    """(id, cluster, distance): the nearest centroid of each row (id, named, v), and its squared distance; id is null where named is false."""
    centroids = Centroids(points)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own, near, _ = centroids.nearest(_stacked(batch))
            yield pd.DataFrame({"id": batch["id"], "named": batch["named"], "cluster": own.astype(np.int32), "distance": near})
        release_memory()

    found = rows.mapInPandas(assign, "id long, named boolean, cluster int, distance long")
    return found.select(F.when(F.col("named"), F.col("id")).alias("id"), "cluster", "distance")


def cluster(vectors: DataFrame, rank: Column, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid): Lloyd's rounds from the k vectors that come first by
    rank (an expression over id, the vector's id), then one last assignment. centroid holds the cluster's final components."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = written(usable(vectors, dim, scale), "vectors")
    points = start(rows, k, rank)
    kind = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not len(points):
        return spark.createDataFrame([], kind)
    for _ in range(rounds):
        points = moved(rows, points)
    named = rows.select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNotNull().alias("named"), "v")
    own = written(assigned(named, points), "assigned")
    sums = own.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    held = {r["cluster"]: r["cluster_inertia"] for r in sums.collect()}  # k rows at most
    told = [(c, n, sum(held.values()), points[c].tolist()) for c, n in held.items()]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return own.withColumnRenamed("id", "vec_id").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def seeded_hash(seed: int) -> Column:
    """A start order: lower-case hex SHA-256 of `seed:id`."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)


def digest(components: Column) -> Column:
    return F.sha2(F.array_join(F.transform(components, lambda x: x.cast("string")), ","), 256)
