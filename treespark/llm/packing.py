"""Packing token pieces into sequences by a grouping genetic algorithm.

Pieces of one length are interchangeable, so a packing is fixed by how many sequences hold which lengths. The search
works on the histogram of lengths: at most `capacity` counts, whatever the size of the corpus. A chromosome is a
list of bin kinds (runs of equal lengths) with the number of bins of each kind. Crossover injects whole well-filled
bins of one parent into the other, takes out the bins whose pieces are then used twice, and best-fits the displaced
pieces, longest first; then a replacement search tries to empty the least filled bins (see squeeze). Islands evolve in parallel Spark tasks; after each epoch every island gets its neighbour's
elite. The best packing becomes a table of rank ranges by length. Pieces get their rank among those of their
length by counts of (length, bucket) and a window inside each bucket, and look up sequence and offset.

Nothing that grows with the corpus reaches the driver: the histogram has `capacity` rows at most, and the packing is
a few thousand bin kinds, since each step of best-fit opens two kinds at most.

Defined results: null text counts as empty (its only token is the end id); repeated rows are packed as separate
documents; very long texts are cut whole; a null doc_id is kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import random
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, release_memory, text_or_empty, written
from .tokens import MemoEncoder

BUCKETS = 4096
Bins = list[tuple[tuple[tuple[int, int], ...], int]]  # ((length, how many), ...) of a bin, and the number of such bins


@lru_cache(maxsize=2)
def _encoder(tokenizer_file: str, rank_file: str) -> MemoEncoder:
    return MemoEncoder(tokenizer_file, rank_file)


def token_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer_file: str | None = None, rank_file: str | None = None, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, bucket[, ids]) of every text of docs.

    A document's tokens are its ids, then end_id. Longer ones than capacity are cut into pieces of capacity tokens, the
    first of which may be shorter.
    """
    files = (tokenizer_file or public_tokenizers.path("byte_bpe_50k.json"), rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(*files)
        for batch in batches:
            rows = []
            for doc_id, text, bucket in zip(batch["doc_id"], batch["text"], batch["bucket"]):
                ids = encode(text) + end
                n = len(ids) // 4
                bounds = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    own = ids[4 * a : 4 * b]
                    rows.append((doc_id, k, a, b - a, crc32(own), bucket, *([np.frombuffer(own, "<u4").astype("int64")] if with_ids else [])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "bucket", *["ids"] * with_ids])
            yield out.astype({"doc_id": "Int64"})
        encode.forget()
        release_memory()

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, bucket int" + ", ids array<long>" * with_ids
    bucket = (F.spark_partition_id() % BUCKETS).alias("bucket")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), bucket).mapInPandas(cut, kind)


def best_fit(counts: dict[int, int], capacity: int, bins: Bins = (), order: list[int] | None = None) -> Bins:
    """bins and the pieces in counts, each piece in the fullest bin that has room; longest first or in the order given."""
    room: dict[int, Bins] = {}
    free, done = 0, []  # free: bit r is set if some bins have room for r

    def keep(runs, n, left):
        nonlocal free
        if not left:
            done.append((runs, n))
        else:
            room.setdefault(left, []).append((runs, n))
            free |= 1 << left

    for runs, n in bins:
        keep(runs, n, capacity - sum(a * k for a, k in runs))
    for length in order or sorted(counts, reverse=True):
        n = counts.get(length, 0)
        while n > 0:
            fits = free >> length
            left = (fits & -fits).bit_length() - 1 + length if fits else capacity
            each = left // length
            if fits:
                runs, there = room[left].pop()
                if not room[left]:
                    free &= ~(1 << left)
            else:
                runs, there = (), -(-n // each)
            whole = min(there, n // each)
            if whole:
                keep((*runs, (length, each)), whole, left - each * length)
            n -= whole * each
            if n and whole < there:
                keep((*runs, (length, n)), 1, left - n * length)
                whole, n = whole + 1, 0
            if fits and whole < there:
                keep(runs, there - whole, left)
    return done + [x for group in room.values() for x in group]


def _cost(bins: Bins, capacity: int) -> tuple[int, float]:
    """Bins; then, smaller for the same number, the more unevenly they are filled."""
    return sum(n for _, n in bins), -sum(n * (sum(a * k for a, k in runs) / capacity) ** 2 for runs, n in bins)


def _cross(one: Bins, other: Bins, counts: dict[int, int], capacity: int, rng: random.Random) -> Bins:
    fill = lambda runs: sum(a * k for a, k in runs)
    limit = capacity - rng.choice([0, 0, 1, 2, 4, 8])
    left, child = dict(counts), []
    injected = [(runs, n) for runs, n in other if fill(runs) >= limit and rng.random() < 0.5]
    for runs, n in injected + sorted(one, key=lambda x: -fill(x[0])):
        need: dict[int, int] = {}
        for a, k in runs:
            need[a] = need.get(a, 0) + k
        n = min(n, *(left[a] // k for a, k in need.items()))
        if n and (fill(runs) >= limit or rng.random() < 0.7):  # poorly filled bins may dissolve
            child.append((runs, n))
            for a, k in need.items():
                left[a] -= n * k
    order = sorted((a for a, n in left.items() if n), key=lambda a: -a * rng.uniform(0.97, 1.0))
    return best_fit(left, capacity, child, order)


def squeeze(bins: Bins, capacity: int, rng: random.Random, most: int = 1500, rounds: int = 4) -> Bins:
    """bins after a replacement search: the pieces of the emptiest bin go to others, if need be in the place of smaller ones.

    A displaced piece goes where it fits best, or takes the place of the piece whose exchange uses up most of some bin's room; that one is
    displaced in turn and is smaller. Ends when a bin's pieces can't all be placed, which leaves the bins as they were. At most
    `most` bins with room take part, the emptiest ones and a random part of the others.
    """
    fill = lambda runs: sum(a * k for a, k in runs)
    kept = [(runs, n) for runs, n in bins if fill(runs) == capacity]
    loose = sorted((x for x in bins if fill(x[0]) < capacity), key=lambda x: (fill(x[0]), rng.random()))
    some: list[Counter] = []
    for runs, n in loose:
        own = min(n, most - len(some))
        some += [_counted(runs) for _ in range(own)]
        if n > own:
            kept.append((runs, n - own))
    for _ in range(rounds):
        if len(some) < 2:
            break
        work = [Counter(x) for x in some[1:]]
        room = [capacity - sum(a * k for a, k in x.items()) for x in work]
        displaced, steps = sorted(some[0].elements()), 0
        while displaced and steps < 20 * len(work):
            steps += 1
            piece = displaced.pop()
            fits = [(r, i) for i, r in enumerate(room) if r >= piece]
            if fits:
                r, i = min(fits)
                work[i][piece] += 1
                room[i] -= piece
                continue
            gain, _, i, other = max(((piece - a, rng.random(), i, a) for i, x in enumerate(work) if room[i] for a in x if a < piece <= a + room[i]), default=(0, 0, 0, 0))
            if not gain:
                displaced.append(piece)
                break
            work[i][piece] += 1
            work[i][other] -= 1
            work[i] += Counter()  # drops what isn't there any more
            room[i] -= gain
            insort(displaced, other)
        if displaced:
            break
        some = sorted(work, key=lambda x: sum(a * k for a, k in x.items()))
    return kept + [(tuple(sorted(x.items())), 1) for x in some]


def _counted(runs: tuple[tuple[int, int], ...]) -> Counter:
    out: Counter = Counter()
    for a, k in runs:
        out[a] += k
    return out


def evolve(counts: dict[int, int], capacity: int, elites: list[Bins], seed: int, population: int, generations: int) -> Bins:
    """The best chromosome of one island after some generations."""
    rng = random.Random(seed)
    floor = -(-sum(a * n for a, n in counts.items()) // capacity)
    pool = [*elites, best_fit(counts, capacity)]
    while len(pool) < population:
        pool.append(best_fit(counts, capacity, order=sorted(counts, key=lambda a: -a * rng.uniform(0.9, 1.0))))
    pool = sorted((squeeze(x, capacity, rng) for x in pool), key=lambda x: _cost(x, capacity))
    for _ in range(generations):
        if _cost(pool[0], capacity)[0] <= floor:
            break
        one, other = rng.sample(pool[: max(2, population // 2)], 2)
        pool[-1] = squeeze(_cross(one, other, counts, capacity, rng), capacity, rng)
        pool.sort(key=lambda x: _cost(x, capacity))
    return pool[0]


def pack_histogram(spark, counts: dict[int, int], capacity: int = 1024, islands: int = 6, epochs: int = 2, population: int = 5, generations: int = 10) -> Bins:
    """Bins for the pieces counted by length, evolved on islands (Spark tasks) with migration of elites."""
    best: list[Bins] = []
    for epoch in range(epochs):
        settled = list(best)

        def island(batches, epoch=epoch, settled=settled):
            for batch in batches:
                for i in batch["id"]:
                    own = [settled[(i + d) % len(settled)] for d in (0, 1)] if settled else []
                    yield pd.DataFrame({"bins": [json.dumps(evolve(counts, capacity, own, 1000 * epoch + int(i), population, generations))]})

        rows = spark.range(islands, numPartitions=islands).mapInPandas(island, "bins string").collect()
        best = [[(tuple(map(tuple, runs)), n) for runs, n in json.loads(r.bins)] for r in rows]
        best.sort(key=lambda x: _cost(x, capacity))
        if _cost(best[0], capacity)[0] <= -(-sum(a * n for a, n in counts.items()) // capacity):
            break
    return best[0]


def _ranges(bins: Bins, capacity: int) -> pd.DataFrame:
    """Of the pieces of a length in order of rank: from rank `start` on, `each` to a sequence from `sequence` on, at `offset`."""
    used, rows, sequence = {}, [], 0
    for runs, n in bins:
        offset = 0
        for length, each in runs:
            start = used.get(length, 0)
            rows.append((length, start, each, sequence, offset))
            used[length], offset = start + n * each, offset + length * each
        sequence += n
    return pd.DataFrame(rows, columns=["length", "start", "each", "sequence", "offset"]).sort_values(["length", "start"], ignore_index=True)


def pack_pieces(pieces: DataFrame, capacity: int = 1024, **search) -> DataFrame:
    """pieces (a written table with length and bucket) with sequence_id and offset instead of bucket."""
    spark = pieces.sparkSession
    by_bucket = pieces.groupBy("length", "bucket").count()
    counts = {r["length"]: r["n"] for r in by_bucket.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = _ranges(pack_histogram(spark, counts, capacity, **search) if counts else [], capacity)
    key = plan["length"].to_numpy("int64") << 42 | plan["start"].to_numpy("int64")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, rank = batch["length"].to_numpy("int64"), batch.pop("rank").to_numpy("int64")
            at = plan.iloc[np.searchsorted(key, length << 42 | rank, side="right") - 1]
            j, each = rank - at["start"].to_numpy(), at["each"].to_numpy()
            batch["sequence_id"] = at["sequence"].to_numpy() + j // each
            batch["offset"] = at["offset"].to_numpy() + j % each * length
            yield batch

    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = by_bucket.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("rank_from"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1
    ranked = pieces.withColumn("rank", inside).join(first, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("rank_from"))
    kept = [c for c in pieces.columns if c != "bucket"]
    kind = ", ".join(f"`{n}` {t}" for n, t in pieces.select(*kept).dtypes) + ", sequence_id long, offset long"
    return ranked.select(*kept, "rank").mapInPandas(place, kind)


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, **search) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset."""
    bounded_batches(docs.sparkSession)
    pieces = written(token_pieces(docs, capacity, end_id, with_ids=with_ids), "pieces")
    return pack_pieces(pieces, capacity, **search)
