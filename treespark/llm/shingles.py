"""Near-duplicates by SimHash and similarity of five-word shingles.

Method: a text is its set of word shingles (64-bit hashes); two sets link if their Jaccard similarity is 0.8 at
least, which is verified over the whole sets. First candidates come from SimHash (simhash.py): texts whose fingerprints lie within 2 bits, found by multi-index
hashing, and what hangs together by such links share a key. A similarity of 0.8 reaches well beyond 2 bits, so further candidates share a band: each set has BANDS keys, each a hash of ROWS
of its min-hashes. A pair with similarity 0.8 shares a band but for one chance in some ten thousands, a more similar one almost surely.

Only distinct sets are searched. Sets that have a key with many others are dealt to blocks (of about
BLOCK sets, by the key that most others share too), and two blocks that a key of any size joins are a tile; other pairs are verified one by one. For a tile one task multiplies the incidence matrices of
its shingles, which gives all intersections at once, and returns a spanning forest of the links it finds, fewer rows than it has sets. So no group
makes rows for its pairs, however large it is; its sets are sent once for each block it meets.

Defined results: null text counts as empty; texts without words are one set; texts of fewer words than five have one
shingle of all of them; only A-Z are folded; words are split at ASCII white space. Sets are named by a 64-bit hash, texts by two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, release_memory, small_side, text_or_empty, written
from .lm_scoring import BASE, INVERSE, SPACES, _powers
from .simhash import components, links, simhash

WIDTH = 5
#: Similarity of 4/5: |A n B| * 9 >= (|A| + |B|) * 4.
PARTS, WHOLE = 4, 5
#: A band is ROWS of HASHES min-hashes. Of pairs with similarity 0.8, 1 in 30,000 shares no band, of pairs with 0.85 1 in ten millions.
HASHES, BANDS, ROWS = 96, 64, 6
_RANDOM = np.random.default_rng(42)
_TURNS = _RANDOM.integers(1, 1 << 62, HASHES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_MEMBERS = np.stack([_RANDOM.choice(HASHES, ROWS, replace=False) for _ in range(BANDS)])
#: Up to so many linked sets are broadcast; beyond, Spark shuffles.
MAX_BROADCAST_ROWS = 200_000
#: A key of more sets than this is worked off in tiles of blocks of about BLOCK sets; SLICE shingles are multiplied at a time.
FEW, BLOCK, SLICE = 16, 512, 4096


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    raw = np.frombuffer(b"\n" + text.encode("utf-8", "surrogatepass").lower() + b"\n", np.uint8)
    space = SPACES[raw]
    starts, ends = np.nonzero(space[:-1] & ~space[1:])[0] + 1, np.nonzero(~space[:-1] & space[1:])[0] + 1
    if not len(starts):
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        sums = np.cumsum(np.concatenate([np.zeros(1, np.uint64), (raw.astype(np.uint64) + np.uint64(1)) * _powers(len(raw) - 1, BASE)]), dtype=np.uint64)
        words = _mixed((sums[ends] - sums[starts]) * _powers(len(raw), INVERSE)[starts])
        width = min(width, len(words))
        n = len(words) - width + 1
        out = np.zeros(n, np.uint64)
        for i in range(width):
            out = out * BASE + words[i : i + n]
    return np.unique(_mixed(out).view(np.int64))


def text_id(text: str = "text") -> Column:
    """Two 64-bit hashes of the text, by which rows of equal text are named."""
    return F.concat(F.hex(F.xxhash64(text_or_empty(text))), F.lit("-"), F.hex(F.xxhash64(F.lit("again"), text_or_empty(text)))).alias("text_id")


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ h >> np.uint64(33)) * np.uint64(by)
        return h ^ h >> np.uint64(33)


def bands(own: np.ndarray) -> np.ndarray:
    """BANDS hashes of ROWS min-hashes each of a set of shingles."""
    with np.errstate(over="ignore"):
        least = np.array([(own.view(np.uint64) * turn).min() for turn in _TURNS], np.uint64)[_MEMBERS]
        out = np.arange(BANDS, dtype=np.uint64)
        for i in range(ROWS):
            out = _mixed(out * BASE + least[:, i])
    return out.view(np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _sets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([shingles(t) for t in batch], dtype=object)
    release_memory()


def _banded(docs: DataFrame) -> DataFrame:
    """doc_id and text_id of docs, with set (the hash of the set), its size and its bands, and fp, the text's SimHash."""
    fields = {"set": T.LongType(), "size": T.LongType(), "bands": T.ArrayType(T.LongType()), "fp": T.LongType()}
    kind = T.StructType([T.StructField(n, t) for n, t in fields.items()])

    @F.pandas_udf(kind)
    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for text in batch:
                own = shingles(text)
                rows.append((xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63), len(own), bands(own) if len(own) else own, simhash(text)))
            yield pd.DataFrame(rows, columns=list(fields))
        release_memory()

    return docs.select("doc_id", text_id(), judged(text_or_empty()).alias("_j")).select("doc_id", "text_id", "_j.*")


def _full(live: DataFrame, own: DataFrame, docs: DataFrame) -> DataFrame:
    """(set, keys): all shingles of each set in live, made and written once."""
    named = written(live.select("set").distinct(), "named")
    ids = written(own.join(small_side(named, MAX_BROADCAST_ROWS), "set", "left_semi").groupBy("set").agg(F.min("text_id").alias("text_id")), "named_texts")
    texts = docs.select(text_id(), "text").join(small_side(ids, MAX_BROADCAST_ROWS), "text_id").groupBy("set").agg(F.any_value("text").alias("text"))
    return written(texts.select("set", _sets(text_or_empty()).alias("keys")), "sets")


def _alike(shared, size, other):
    return shared * (PARTS + WHOLE) >= (size + other) * PARTS


def _verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of sets, those that link."""
    pairs = written(pairs, "candidates")
    both = full.toDF("a", "x").join(small_side(pairs, MAX_BROADCAST_ROWS), "a").join(full.toDF("b", "y"), "b")
    return both.where(_alike(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("a", "b")


def forest(names: np.ndarray, sets: list[np.ndarray], sides: np.ndarray) -> list[tuple[int, int]]:
    """Links among the sets of a tile that join what all its links join: between its sides, or within it if it has one side only."""
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = often[column] > 1
    row, column = row[kept], np.unique(column[kept], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, SLICE):
        at = slice(*np.searchsorted(column, (low, low + SLICE)))
        part = np.zeros((len(sets), SLICE), np.float32)
        part[row[at], column[at] - low] = 1
        shared += part @ part.T
    linked = _alike(shared, sizes[:, None], sizes[None])
    if sides.any():
        linked &= sides[:, None] != sides[None]
    np.fill_diagonal(linked, False)
    seen, out = np.zeros(len(sets), bool), []
    for first in range(len(sets)):
        todo = [] if seen[first] else [first]
        seen[first] = True
        while todo:
            here = todo.pop()
            new = np.nonzero(linked[here] & ~seen)[0]
            seen[new] = True
            out += [(int(names[here]), int(names[x])) for x in new]
            todo += new.tolist()
    return out


def _homes(live: DataFrame) -> DataFrame:
    """(set, block) of the sets that share a key with many. Sets take the largest home that some set they share a key with has, so what hangs
    on a large group lies in its blocks, and no large block is sent to many small ones."""
    shared = F.max(F.when(F.col("n") > FEW, F.struct("n", "key"))).over(Window.partitionBy("set"))
    first = written(live.withColumn("home", shared).where("home is not null").select("set", "key", "home"), "first_homes")
    near = first.groupBy("key").agg(F.max("home").alias("home"))
    homes = written(first.select("set", "key").join(near, "key").groupBy("set").agg(F.max("home").alias("home")), "near_homes")
    sizes = homes.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
    chunk = F.pmod(F.xxhash64("set"), F.col("chunks"))
    return written(homes.join(sizes, "home").select("set", F.xxhash64("home.key", chunk).alias("block")), "homes")


def _tiled(live: DataFrame, homes: DataFrame, full: DataFrame) -> DataFrame:
    """Links (a, b) among the sets with a block that share a key."""
    reached = written(live.join(homes, "set").groupBy("key", "block").agg(F.count("*").alias("held")), "reached")
    several = reached.groupBy("key").agg(F.sum("held").alias("n")).where("n > 1").select("key")
    reached = written(reached.drop("held").join(several, "key"), "joined")
    pairs = reached.withColumnRenamed("block", "b1").join(reached.withColumnRenamed("block", "b2"), "key").where("b1 <= b2").select("b1", "b2").distinct()
    pairs = written(pairs, "tiles")
    blocks = written(homes.join(full, "set"), "blocks")
    left = pairs.join(blocks.withColumnRenamed("block", "b1"), "b1").select("b1", "b2", F.lit(False).alias("side"), "set", "keys")
    right = pairs.where("b1 < b2").join(blocks.withColumnRenamed("block", "b2"), "b2").select("b1", "b2", F.lit(True).alias("side"), "set", "keys")

    def tile(rows: pd.DataFrame) -> pd.DataFrame:
        found = forest(rows["set"].to_numpy(), [np.asarray(k, np.int64) for k in rows["keys"]], rows["side"].to_numpy(bool))
        release_memory()
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return left.unionByName(right).groupBy("b1", "b2").applyInPandas(tile, "a long, b long")


def _simhashed(own: DataFrame) -> DataFrame:
    """(set, size, key): sets that fingerprints within 2 bits join, directly or by others, share a key."""
    marks = written(own.where("size > 0").groupBy("set", "fp").agg(F.any_value("size").alias("size")), "marks")
    roots = written(components(links(marks.select("fp").distinct())).withColumnRenamed("node", "fp"), "fp_roots")
    named = marks.join(small_side(roots, MAX_BROADCAST_ROWS), "fp", "left")
    return named.select("set", "size", F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("key")).distinct()


def set_links(own: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets, at 0.8 or more, whose components are those of all such pairs. own: a table with _banded()'s columns."""
    nodes = own.where("size > 0").groupBy("set").agg(F.any_value("size").alias("size"), F.any_value("bands").alias("bands"))
    rows = nodes.select("set", "size", F.explode("bands").alias("key")).unionByName(_simhashed(own))
    met = rows.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    live = written(met, "live")
    full = _full(live, own, docs)
    fit = (F.col("size") * PARTS <= F.col("size_2") * WHOLE) & (F.col("size_2") * PARTS <= F.col("size") * WHOLE)
    homes = _homes(live)
    light = live.where(F.col("n") <= FEW).join(homes.select("set", F.lit(True).alias("homed")), "set", "left")
    others = light.select("key", F.col("set").alias("set_2"), F.col("size").alias("size_2"), F.col("homed").alias("homed_2"))
    alone = F.col("homed").isNull() | F.col("homed_2").isNull()  # pairs of sets with blocks are the tiles' work, under whatever key
    pairs = light.join(others, "key").where(fit & alone & (F.col("set") < F.col("set_2"))).select(F.col("set").alias("a"), F.col("set_2").alias("b")).distinct()
    return written(_verified(pairs, full).unionByName(_tiled(live, homes, full)), "links")


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, group) of every row of docs (doc_id, text): text_id is a hash of the text, group one number for all rows of a
    component of near copies. No text is written or shuffled but those of sets to verify."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    own = written(_banded(docs), "banded")
    roots = written(components(set_links(own, docs)).withColumnRenamed("node", "set"), "roots")
    return own.drop("size", "bands", "fp").join(small_side(roots, MAX_BROADCAST_ROWS), "set", "left").select("doc_id", "text_id", F.coalesce("root", "set").alias("group"))
