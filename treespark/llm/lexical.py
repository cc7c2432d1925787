"""Ranked lexical search with blocked posting lists and summary bounds.

Method: documents become vectors of impacts (a term's weight times its saturated, length-normalised frequency, all in whole numbers).
They are dealt to cells of similar documents: by the largest coordinate of a random projection, and cells of more than CELL documents
by a hash as well, so a cell is bounded whatever its group. In a cell, each term's posting list is clustered: representatives are
taken from the list, and each document joins the most similar one; the clusters are the list's blocks. A block stores its documents and the
coordinatewise maximum of their impacts. The index is a table in the shared folder, one row a cell.

A search reads it twice and shuffles only results. For an item, the bound of a block is the sum of its summary over the item's terms: no
document of the block scores more. First, each cell scores the documents of the block with the largest bound; the k-th best score of
all cells is a floor that the k-th best result can't lie below. Then each cell goes through its blocks, largest bound first, and
skips a block only when its bound is strictly below the floor, or below the k-th best score found in the cell. So no result is lost.

The index covers all documents, and of their terms those that an item asks for (the others can't add to a score); a block's summary has the
coordinates of items that ask for the block's term. Items are worked off in batches of at most MAX_ITEMS, whose terms (not documents) are
held by every task. Counts (documents, terms, holders of a term) are sums over the whole table.

Defined results: a text without terms, or null, is no document of the statistics and is never found. Rows count as often as they come; repeated rows are
found repeatedly. Rows without an id are ranked after all ids of the same score. Rows of items with one id are one item with the terms of all;
null ids of items are left out. Long texts are read in parts, cut between terms. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, release_memory, written

CELL, BLOCK, MAX_ITEMS = 2048, 256, 512
DIRECTIONS, PART = 16, 1 << 20
#: What parts terms: every ASCII character but digits and letters.
_APART = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_VECTOR = "doc_id long, named boolean, n long, terms array<int>, tfs array<long>"
_INDEX = "docs binary, named binary, starts binary, terms binary, impacts binary, block_terms binary, block_starts binary, block_docs binary, keys binary, most binary"


def parts(text: bytes, size: int = PART) -> Iterator[bytes]:
    """text in parts of about `size` bytes, cut where a term ends."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and _APART[text[end]] != 32:
            end += 1
        yield text[at:end]
        at = end


def terms_of(text: bytes) -> Counter:
    """How often each term comes in UTF-8 text; only A to Z are lower-cased."""
    found: Counter = Counter()
    for part in parts(text):
        found.update(part.lower().translate(_APART).split())
    return found


def item_terms(items: DataFrame, item_id: str, text: str) -> dict[int, list[bytes]]:
    """Each item's distinct terms. For a batch of items, which is bounded."""
    found: dict[int, set[bytes]] = {}
    for key, body in items.select(F.col(item_id).cast("long"), F.col(text).cast("binary")).collect():
        found.setdefault(key, set()).update(terms_of(bytes(body)) if body is not None else ())
    return {key: sorted(terms) for key, terms in found.items()}


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with a term: how many it has, and the asked ones with their frequencies."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, named, body in zip(batch["doc_id"].tolist(), batch["named"].tolist(), batch["text"].tolist()):
                found = terms_of(bytes(body))
                if found:
                    own = sorted((vocabulary[w], c) for w, c in found.items() if w in vocabulary)
                    rows.append((key, named, sum(found.values()), [t for t, _ in own], [c for _, c in own]))
            yield pd.DataFrame(rows, columns=["doc_id", "named", "n", "terms", "tfs"])
        release_memory()

    key = F.col(doc_id).cast("long")
    rows = docs.select(F.coalesce(key, F.lit(0)).alias("doc_id"), key.isNotNull().alias("named"), F.col(text).cast("binary").alias("text")).where("text is not null")
    return rows.mapInPandas(count, _VECTOR)


class Weights:
    """Term weights and the documents' length norm, from counts over the whole table."""

    def __init__(self, documents: int, terms: int, held: np.ndarray):
        self.documents, self.terms = documents, terms
        self.of = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in held], np.int64)
        self.directions = np.random.default_rng(7).normal(size=(len(held), DIRECTIONS))

    def norms(self, n: np.ndarray) -> np.ndarray:
        wide = n.astype(object) if len(n) and 90 * int(n.max()) * self.documents >= 1 << 63 else n.astype(np.int64)
        return (10 + (90 * wide * self.documents) // max(1, self.terms)).astype(np.int64)

    def impacts(self, norms: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        return self.of[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * norms))

    def projected(self, count: int, row: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> np.ndarray:
        """Unit vectors of each document's impacts in few random directions; near documents have a large product."""
        out = np.stack([np.bincount(row, impacts * self.directions[terms, d], count) for d in range(DIRECTIONS)], axis=1)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def _flat(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many entries each row has, and all terms and frequencies."""
    sizes = batch["terms"].map(len).to_numpy(np.int64)
    join = lambda c, kind: np.concatenate([np.asarray(x, kind) for x in batch[c]] or [np.zeros(0, kind)])
    return sizes, join("terms", np.int32), join("tfs", np.int64)


def _labelled(rows: DataFrame, weights: Weights) -> DataFrame:
    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, terms, tfs = _flat(batch)
            row = np.repeat(np.arange(len(batch)), sizes)
            near = weights.projected(len(batch), row, terms, weights.impacts(weights.norms(batch["n"].to_numpy())[row], terms, tfs))
            best = np.abs(near).argmax(axis=1)
            yield batch.assign(label=(best * 2 + (near[np.arange(len(batch)), best] < 0)).astype(np.int32))

    return rows.mapInPandas(label, f"{_VECTOR}, label int")


def _ranges(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all entries of these rows, one row after the other; and how many each has."""
    sizes = starts[rows + 1] - starts[rows]
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[rows] - ends + sizes, sizes), sizes


def build_cell(batch: pd.DataFrame, weights: Weights, asked: list[np.ndarray], by_term: list[np.ndarray]) -> dict[str, bytes]:
    """A cell's row of the index. asked: each item's terms; by_term: each term's items."""
    sizes, terms, tfs = _flat(batch)
    row = np.repeat(np.arange(len(batch)), sizes)
    starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    impacts = weights.impacts(weights.norms(batch["n"].to_numpy())[row], terms, tfs)
    near = weights.projected(len(batch), row, terms, impacts)
    order = np.argsort(terms, kind="stable")
    present, first = np.unique(terms[order], return_index=True)
    lists = np.split(row[order], first[1:]) if len(present) else []
    width = len(weights.of)
    wanted, block_terms, block_sizes, block_docs, keys, most = np.zeros(width, bool), [], [], [], [], []
    for term, docs in zip(present.tolist(), lists):
        blocks = -(-len(docs) // BLOCK)
        own = np.zeros(len(docs), np.int64)
        if blocks > 1:
            heads = docs[np.arange(blocks) * len(docs) // blocks]
            _, own = np.unique((near[docs] @ near[heads].T).argmax(axis=1), return_inverse=True)
            turn = np.argsort(own, kind="stable")
            docs, own = docs[turn], own[turn]
        told = np.bincount(own)
        coords = np.concatenate([asked[i] for i in by_term[term]])
        wanted[coords] = True
        at, each = _ranges(starts, docs)
        held = wanted[terms[at]]
        at, block = at[held], np.repeat(own, each)[held]
        wanted[coords] = False
        peak = np.zeros((len(told), width), np.int64)
        np.maximum.at(peak, (block, terms[at]), impacts[at])
        where = np.nonzero(peak)
        keys.append((where[0] + len(block_terms)) * width + where[1])
        most.append(peak[where])
        block_terms += [term] * len(told)
        block_sizes.append(told)
        block_docs.append(docs)
    join = lambda x, kind: np.concatenate(x or [np.zeros(0)]).astype(kind)
    out = {
        "docs": batch["doc_id"].to_numpy(np.int64), "named": batch["named"].to_numpy(bool), "starts": starts, "terms": terms, "impacts": impacts,
        "block_terms": np.array(block_terms, np.int32), "block_starts": np.concatenate([np.zeros(1, np.int64), np.cumsum(join(block_sizes, np.int64))]),
        "block_docs": join(block_docs, np.int32), "keys": join(keys, np.int64), "most": join(most, np.int64),
    }
    return {name: values.tobytes() for name, values in out.items()}


class Cell:
    """A row of the index, opened."""

    def __init__(self, row, width: int):
        kinds = {"named": bool, "terms": np.int32, "block_terms": np.int32, "block_docs": np.int32}
        for name in [x.split()[0] for x in _INDEX.split(", ")]:
            setattr(self, name, np.frombuffer(row[name], kinds.get(name, np.int64)))
        self.width, self.wanted = width, np.zeros(width, bool)

    def bounds(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The blocks of an item's terms and their bounds, the largest first."""
        blocks = np.nonzero(np.isin(self.block_terms, terms))[0]
        keys = blocks[:, None] * self.width + terms
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        found = np.where(self.keys[at] == keys, self.most[at], 0).sum(axis=1) if len(self.keys) else np.zeros(len(blocks), np.int64)
        order = np.argsort(-found, kind="stable")
        return blocks[order], found[order]

    def best(self, terms: np.ndarray, k: int, floor: int, first_only: bool) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best documents (their rows and scores) that reach the floor, and how many blocks were opened."""
        blocks, bound = self.bounds(terms)
        seen = np.zeros(len(self.docs), bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.wanted[terms] = True
        at, step, opened = 0, 1, 0
        while at < len(blocks) and bound[at] >= max(floor, 1):  # strictly below the floor is skipped
            own = blocks[at : at + step][bound[at : at + step] >= floor]
            opened += len(own)
            places, _ = _ranges(self.block_starts, own)
            docs = np.unique(self.block_docs[places])
            docs = docs[~seen[docs]]
            seen[docs] = True
            entries, each = _ranges(self.starts, docs)
            held = self.wanted[self.terms[entries]]
            score = np.bincount(np.repeat(np.arange(len(docs)), each)[held], self.impacts[entries][held], len(docs)).astype(np.int64)
            rows, scores = np.concatenate([rows, docs]), np.concatenate([scores, score])
            order = np.lexsort((self.docs[rows], ~self.named[rows], -scores))[:k]
            rows, scores = rows[order], scores[order]
            if len(scores) == k:
                floor = max(floor, int(scores[-1]))
            at, step = at + step, min(step * 2, 64)
            if first_only:
                break
        self.wanted[terms] = False
        good = (scores >= floor) & (scores > 0)
        return rows[good], scores[good], opened


def build(docs: DataFrame, asked: dict[int, list[bytes]], doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[int, np.ndarray], int]:
    """The index of docs for a batch of items, as a written table; the items' terms as numbers; and how many terms there are."""
    vocabulary = {w: i for i, w in enumerate(sorted({w for terms in asked.values() for w in terms}))}
    numbers = {key: np.array([vocabulary[w] for w in terms], np.int64) for key, terms in asked.items() if terms}
    rows = written(vectors(docs, vocabulary, doc_id, text), "vectors")
    documents, terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = np.zeros(len(vocabulary), np.int64)
    for term, n in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a batch's terms at most
        held[term] = n
    weights = Weights(documents, terms, held)
    labelled = written(_labelled(rows.where(F.size("terms") > 0), weights), "labelled")
    sizes = labelled.groupBy("label").count().collect()  # 2 * DIRECTIONS rows at most
    splits = F.create_map(*[F.lit(x) for label, n in sizes or [(0, 1)] for x in (label, -(-n // CELL))])
    split = F.pmod(F.xxhash64("doc_id", "n", "terms", "tfs"), F.element_at(splits, F.col("label"))).cast("int")
    lists = list(numbers.values())
    by_term: list[list[int]] = [[] for _ in vocabulary]
    for i, own in enumerate(lists):
        for term in own.tolist():
            by_term[term].append(i)

    def cell(batch: pd.DataFrame) -> pd.DataFrame:
        found = build_cell(batch, weights, lists, by_term)
        release_memory()
        return pd.DataFrame({name: [value] for name, value in found.items()})

    index = labelled.withColumn("split", split).groupBy("label", "split").applyInPandas(cell, _INDEX)
    return written(index, "lexical"), numbers, len(vocabulary)


def look_up(index: DataFrame, numbers: dict[int, np.ndarray], width: int, k: int, floors: dict[int, int], first_only: bool) -> DataFrame:
    """(item_id, doc_id, score): of each cell, an item's k best documents that reach its floor."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                cell, out = Cell(row, width), []
                for item, terms in numbers.items():
                    rows, scores, _ = cell.best(terms, k, floors.get(item, 0), first_only)
                    out += zip([item] * len(rows), cell.docs[rows].tolist(), cell.named[rows].tolist(), scores.tolist())
                yield pd.DataFrame(out, columns=["item_id", "doc_id", "named", "score"])
        release_memory()

    found = index.mapInPandas(search, "item_id long, doc_id long, named boolean, score long")
    return found.select("item_id", F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by_item = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", max_items: int = MAX_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0, ties to the smaller id."""
    spark = docs.sparkSession
    bounded_batches(spark)
    items = items.where(F.col(item_id).isNotNull())
    batches = max(1, -(-items.count() // max_items))
    kind = "item_id long, doc_id long, score long"
    out = None
    for own in range(batches):
        asked = item_terms(items.where(F.pmod(F.xxhash64(F.col(item_id).cast("long")), F.lit(batches)) == own), item_id, item_text)
        index, numbers, width = build(docs, asked, doc_id, text)
        first = _ranked(look_up(index, numbers, width, k, {}, True), k).where(F.col("rank") == k)
        floors = {r["item_id"]: r["score"] for r in first.collect()}  # a batch's items at most
        found = written(look_up(index, numbers, width, k, floors, False), "found")
        out = found if out is None else out.unionByName(found)
    return _ranked(out if out is not None else spark.createDataFrame([], kind), k).select("item_id", "rank", "doc_id", "score")
