"""Language-model scoring by cross-entropy difference.

Method (`score_by_words`, the query's): a target model (documents named as good) and a background model (all the others) are word bigrams
over one vocabulary, all words of all documents: P(w | v) = (c(v, w) + PRIOR P(w)) / (c(v) + PRIOR), and P(w) = (c(w) + FLOOR) / (N + FLOOR V)
with the V distinct words of both. A text's first word follows a start of its own; its end takes a share of its last word's mass and isn't scored. A document's
own counts are left out of the model that holds it. The background's counts are scaled to the target's total (matched), so smoothing weighs
alike in both. A document's score is the mean over its tokens of the target's loss less the background's: below zero, the document is
nearer to the target. No count is pruned; n-grams are named by 64-bit hashes.

How it runs: documents are dealt to chunks of about CHUNK bytes. A chunk counts its distinct words and bigrams by model; counts are shuffled by buckets of
n-grams, added up, and each chunk gets the totals of its own n-grams back, in their order. So a frequent n-gram is one entry a chunk, no table lies
whole anywhere, and a bucket and a chunk have bounded size at any size of the corpus.

`score_documents` is the same difference of a model of fixed size: words fall into 2^20 hash classes, P(w | v) = P(c(w) | c(v)) P(w | c(w)), where c()
is one of 1,024 coarser classes; words that meet in a class share counts, and a document's own counts stay in. Its counts come from all documents: each
task adds its counts to arrays and sends them in slices; slices are added up by slice in two levels, first in SALTS groups of tasks. The finished
tables (32 MB at any size of the corpus) are broadcast for scoring.

The ids of target documents are joined by broadcast up to max_broadcast_ids rows and by shuffle beyond.

Defined results: null or empty text has no tokens and null scores; a null doc_id is never a target document; repeated
rows count each; a target without tokens gives scores of 0, as does one of all documents; a text is worked off whole, however long; extra columns are kept, those named like added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, release_memory, small_side, text_or_empty, written

WORDS, CLASSES, SLICE = 1 << 20, 1 << 10, 1 << 15
SALTS = 64
BLOCK = 1 << 20
#: Bytes of text of a chunk, and of a bucket of n-grams, about.
CHUNK, BUCKET = 8 << 20, 16 << 20
#: Smoothing of the word model: a context's weight of P(w), and what each word is given.
PRIOR, FLOOR = 10.0, 0.1
ADDED = ["lm_tokens", "target_loss", "background_loss", "loss_difference"]
BASE = np.uint64(0x9E3779B97F4A7C15)
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _powers(n: int, base: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]), dtype=np.uint64)


INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def tokens(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, word class) of the words of blocks of texts, in order; a text lies in one block."""
    return ((number, (h >> np.uint64(44)).astype(np.int64)) for number, h in words_of(texts))


def words_of(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, 64-bit hash) of the words of blocks of texts, in order; a text lies in one block."""
    group, size = [], 0
    for i, text in enumerate(texts):
        group.append((i, text.encode("utf-8", "surrogatepass") + b"\n"))
        size += len(group[-1][1])
        if size >= BLOCK:
            yield _hashes(group)
            group, size = [], 0
    if group:
        yield _hashes(group)


def _hashes(group: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"\n" + b"".join(x for _, x in group), np.uint8)
    space = SPACES[raw]
    starts, ends = np.nonzero(space[:-1] & ~space[1:])[0] + 1, np.nonzero(~space[:-1] & space[1:])[0] + 1
    with np.errstate(over="ignore"):
        sums = np.cumsum(np.concatenate([np.zeros(1, np.uint64), (raw.astype(np.uint64) + np.uint64(1)) * _powers(len(raw) - 1, BASE)]), dtype=np.uint64)
        h = (sums[ends] - sums[starts]) * _powers(len(raw), INVERSE)[starts]
        h = (h ^ h >> np.uint64(32)) * BASE
    stops = np.cumsum([len(x) for _, x in group])
    numbers = np.array([i for i, _ in group])
    return numbers[np.searchsorted(stops, starts - 1, side="right")], h


def bigrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, class of the word, cell of coarse classes (before, now)); a text's first word follows class 0."""
    for number, word in tokens(texts):
        coarse = word % CLASSES
        before = np.zeros_like(coarse)
        if len(word) > 1:
            before[1:] = np.where(number[1:] == number[:-1], coarse[:-1], 0)
        yield number, word, before * CLASSES + coarse


def count(docs: DataFrame, is_target: str) -> np.ndarray:
    """(2, 2, WORDS): of background and target, the counts by word class and by cell of coarse classes."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros((2, 2, WORDS), np.int64)
        for batch in batches:
            for kind, texts in batch.groupby(is_target)["text"]:
                for _, word, cell in bigrams(texts.tolist()):
                    own[int(kind), 0] += np.bincount(word, minlength=WORDS)
                    own[int(kind), 1] += np.bincount(cell, minlength=WORDS)
        flat = own.reshape(-1, SLICE)
        rows = [(i, x.astype("<i8" if x.max() > 2**31 - 1 else "<i4").tobytes()) for i, x in enumerate(flat) if x.any()]
        yield pd.DataFrame(rows, columns=["slice", "counts"]).assign(salt=TaskContext.get().partitionId() % SALTS)

    def add(key: tuple[Any, ...], rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLICE, np.int64)
        for batch in rows:
            for x in batch["counts"]:
                total += np.frombuffer(x, "<i4" if len(x) == 4 * SLICE else "<i8")
        yield pd.DataFrame([(key[0], total.tobytes())], columns=["slice", "counts"])

    def once(key: tuple[Any, ...], rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return (x.assign(salt=key[1]) for x in add(key, rows))

    parts = docs.select(is_target, text_or_empty().alias("text")).mapInPandas(tally, "slice int, counts binary, salt int").groupBy("slice", "salt").applyInPandas(once, "slice int, counts binary, salt int")
    whole = np.zeros((2 * 2 * WORDS // SLICE, SLICE), np.int64)
    for r in parts.select("slice", "counts").groupBy("slice").applyInPandas(add, "slice int, counts binary").collect():  # as many slices at any size
        whole[r["slice"]] = np.frombuffer(r["counts"], "<i8")
    return whole.reshape(2, 2, WORDS)


def losses(words: np.ndarray, cells: np.ndarray, scale: float, smooth: float = 0.1, mass: float = 200.0) -> tuple[np.ndarray, np.ndarray]:
    """-log P(w | c(w)) by word class and -log P(c(w) | c(v)) by cell, of counts times scale."""
    words, cells = words * scale + smooth, cells.reshape(CLASSES, CLASSES) * scale
    by_class = words.reshape(-1, CLASSES).sum(axis=0)  # word % CLASSES is its coarse class
    alone = by_class / by_class.sum()
    emit = words / by_class[np.arange(WORDS) % CLASSES]
    step = (cells + mass * alone) / (cells.sum(axis=1, keepdims=True) + mass)
    return -np.log(emit).astype(np.float32), -np.log(step).astype(np.float32).ravel()


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ h >> np.uint64(33)) * np.uint64(by)
        return h ^ h >> np.uint64(33)


#: The key of texts' starts. Keys of words are odd, all others even.
START = np.uint64(0)


class Chunk:
    """The n-grams of some texts: keys, sorted and distinct, and the place among them of each word, of each word with the one before, and of the start."""

    def __init__(self, texts: list[str]) -> None:
        blocks = list(words_of(texts))
        self.number = np.concatenate([n for n, _ in blocks] or [np.zeros(0, np.int64)])
        h = np.concatenate([h for _, h in blocks] or [np.zeros(0, np.uint64)])
        self.first = np.ones(len(h), bool)
        self.first[1:] = self.number[1:] != self.number[:-1]
        with np.errstate(over="ignore"):
            before = np.where(self.first, START, np.roll(_mixed(h), 1))
            both = np.concatenate([_mixed(h) | np.uint64(1), _mixed(before * BASE + h) & ~np.uint64(1), np.full(self.first.sum(), START)])
        self.keys, self.place = np.unique(both, return_inverse=True)
        self.owner = np.concatenate([self.number, self.number, self.number[self.first]])

    def slices(self, buckets: int) -> Iterator[tuple[int, slice]]:
        """The buckets that hold keys, in order, and their keys' places."""
        of = (self.keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        ids, starts = np.unique(of, return_index=True)
        for b, low, high in zip(ids.tolist(), starts.tolist(), [*starts[1:].tolist(), len(of)]):
            yield b, slice(low, high)

    def losses(self, target: np.ndarray, totals: np.ndarray, mass: tuple[int, int], words: int, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """(words of each text, -log P of each text in (background, target)); target: by text, if it is a target document."""
        n, len_h = np.bincount(self.number, minlength=texts), len(self.number)
        # how often the text itself has each of its n-grams
        _, inverse, often = np.unique(self.owner * len(self.keys) + self.place, return_inverse=True, return_counts=True)
        own = often[inverse]
        word, pair = slice(0, len_h), slice(len_h, 2 * len_h)

        def context(x: np.ndarray) -> np.ndarray:
            """Of each word, the entry of the word before, or of the start."""
            out = np.roll(x[word], 1)
            out[self.first] = x[2 * len_h :]
            return out

        scale = mass[1] / mass[0] if all(mass) else 1.0
        sums = np.zeros((2, texts))
        for model, times in ((0, scale), (1, 1.0)):
            # of a model without words the other one takes the place
            held = model if all(mass) else int(mass[1] > 0)
            out = target[self.owner] == held
            counts = (totals[held][self.place] - np.where(out, own, 0)) * times
            all_words = ((mass[held] - np.where(target == held, n, 0)) * times)[self.number]
            alone = (counts[word] + FLOOR) / (all_words + FLOOR * words)
            sums[model] = np.bincount(self.number, -np.log((counts[pair] + PRIOR * alone) / (context(counts) + PRIOR)), minlength=texts)
        return n, sums


def _squeezed(x: np.ndarray) -> bytes:
    """Numbers as compressed bytes, sorted by their place in the number."""
    return pa.Codec("zstd").compress(np.ascontiguousarray(x.reshape(-1, 1).view(np.uint8).T).tobytes(), asbytes=True)


def _loose(raw: bytes, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(pa.Codec("zstd").decompress(raw, n * width), np.uint8).reshape(width, n).T).view(kind).ravel()


def _table(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def _texts(rows: pa.Table) -> tuple[list[str], np.ndarray]:
    return [t or "" for t in rows["text"].to_pylist()], rows["_target"].to_numpy().astype(bool)


def _in_chunks(docs: DataFrame) -> DataFrame:
    """(_chunk, bytes, rows): runs of rows of docs with about CHUNK bytes of text, as compressed Arrow streams; a table."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, size, now, runs = TaskContext.get().partitionId() << 33, 0, 0, []

        def told() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, runs[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for run in runs:
                    out.write_batch(run)
            n = sum(pc.sum(pc.binary_length(run["text"])).as_py() or 0 for run in runs)
            return pa.RecordBatch.from_pydict({"_chunk": [now + task], "bytes": [n], "rows": [sink.getvalue().to_pybytes()]})

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            chunks, starts = np.unique((size + np.cumsum(sizes) - sizes) // CHUNK, return_index=True)
            for chunk, low, high in zip(chunks.tolist(), starts.tolist(), [*starts[1:].tolist(), len(batch)]):
                if chunk != now and runs:
                    yield told()
                    runs.clear()
                now = chunk
                runs.append(batch.slice(low, high - low))
            size += int(sizes.sum())
        if runs:
            yield told()
        release_memory()

    return written(docs.mapInArrow(dealt, "_chunk long, bytes long, rows binary"), "chunks")


def _totals(chunked: DataFrame, buckets: int) -> DataFrame:
    """(_chunk, bucket, n, totals): of each chunk's n keys in a bucket, in order, the counts of background and target over all chunks; and as chunk -1
    of each bucket its words in background and target, and its distinct words."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["_chunk"].tolist(), batch["rows"]):
                texts, target = _texts(_table(raw))
                chunk = Chunk(texts)
                of = target[chunk.owner]
                counts = np.stack([np.bincount(chunk.place[of == kind], minlength=len(chunk.keys)) for kind in (False, True)]).astype("<u4")
                out = [(name, b, at.stop - at.start, _squeezed(np.diff(chunk.keys[at], prepend=np.uint64(0)).astype("<u8")), _squeezed(counts[:, at])) for b, at in chunk.slices(buckets)]
                yield pd.DataFrame(out, columns=["_chunk", "bucket", "n", "keys", "counts"])
        release_memory()

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows["n"].tolist()
        keys = np.concatenate([np.cumsum(_loose(x, n, "<u8"), dtype=np.uint64) for x, n in zip(rows["keys"], sizes)])
        counts = np.concatenate([_loose(x, 2 * n, "<u4").reshape(2, -1) for x, n in zip(rows["counts"], sizes)], axis=1)
        every, place = np.unique(keys, return_inverse=True)
        total = np.stack([np.bincount(place, c, len(every)) for c in counts]).astype("<i8")
        bucket, out, at = int(rows["bucket"].iloc[0]), [], 0
        for chunk, n in zip(rows["_chunk"].tolist(), sizes):
            out.append((chunk, bucket, n, _squeezed(total[:, place[at : at + n]])))
            at += n
        word = every & np.uint64(1) == 1
        out.append((-1, bucket, 0, np.array([*total[:, word].sum(axis=1), word.sum()], "<i8").tobytes()))
        release_memory()
        return pd.DataFrame(out, columns=["_chunk", "bucket", "n", "totals"])

    rows = chunked.mapInPandas(tally, "_chunk long, bucket long, n long, keys binary, counts binary")
    return written(rows.groupBy("bucket").applyInPandas(added, "_chunk long, bucket long, n long, totals binary"), "totals")


def score_by_words(docs: DataFrame, target_ids: DataFrame, max_broadcast_ids: int = 1_000_000) -> DataFrame:
    """docs with lm_tokens, target_loss, background_loss and loss_difference (nats a token), by the models of words and bigrams.

    target_ids: a table whose doc_id names the target documents.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(*[c for c in docs.columns if c not in ADDED])
    names = docs.columns
    chunked = _in_chunks(_flagged(docs, target_ids, max_broadcast_ids))
    buckets = max(1, -(-(chunked.agg(F.sum("bytes")).first()[0] or 0) // BUCKET))
    totals = _totals(chunked, buckets)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(np.array([np.frombuffer(x, "<i8") for x in batch["totals"]]).reshape(-1, 3), columns=["background", "target", "words"])

    whole = totals.where("_chunk = -1").select("totals").mapInPandas(sums, "background long, target long, words long")
    background, target, words = (x or 0 for x in whole.agg(F.sum("background"), F.sum("target"), F.sum("words")).first())

    def judged(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = _table(left["rows"][0].as_py())
        texts, is_target = _texts(rows)
        chunk = Chunk(texts)
        counts = np.zeros((2, len(chunk.keys)), np.int64)
        told = {b: (n, raw) for b, n, raw in zip(right["bucket"].to_pylist(), right["n"].to_pylist(), right["totals"].to_pylist())}
        for b, at in chunk.slices(buckets):
            counts[:, at] = _loose(told[b][1], 2 * told[b][0], "<i8").reshape(2, -1)
        n, found = chunk.losses(is_target, counts, (background, target), words, len(texts))
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = found / n
        none = n == 0
        added = [pa.array(n, pa.int64()), *[pa.array(x, pa.float64(), mask=none) for x in (mean[1], mean[0], mean[1] - mean[0])]]
        release_memory()
        return pa.Table.from_arrays([*[rows[c].combine_chunks() for c in names], *added], names=[*names, *ADDED])

    schema = T.StructType([*docs.schema.fields, T.StructField(ADDED[0], T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ADDED[1:]]])
    texts = chunked.select("_chunk", "rows").groupBy("_chunk")
    return texts.cogroup(totals.where("_chunk >= 0").groupBy("_chunk")).applyInArrow(judged, schema)


def _flagged(docs: DataFrame, target_ids: DataFrame, max_broadcast_ids: int) -> DataFrame:
    """docs with _target: if target_ids names their doc_id."""
    ids = target_ids.where("doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    ids = small_side(written(ids, "targets"), max_broadcast_ids)
    named = docs.join(ids.withColumn("_target", F.lit(True)), F.col("doc_id") == F.col("_id"), "left")
    return named.drop("_id").withColumn("_target", F.coalesce("_target", F.lit(False)))


def score_documents(docs: DataFrame, target_ids: DataFrame, max_broadcast_ids: int = 1_000_000) -> DataFrame:
    """docs with lm_tokens, target_loss, background_loss and loss_difference (nats a token), by the models of classes.

    target_ids: a table whose doc_id names the target documents.
    """
    bounded_batches(docs.sparkSession)
    counts = count(_flagged(docs.select("doc_id", "text"), target_ids, max_broadcast_ids).select("text", "_target"), "_target")
    mass = counts[:, 0].sum(axis=1)
    scale = mass[1] / mass[0] if mass.all() else 1.0
    background, target = losses(*counts[0], scale), losses(*counts[1], 1.0)
    if not mass.all():
        background = target
    shared = docs.sparkSession.sparkContext.broadcast((target, background))
    kind = T.StructType([T.StructField(n, t) for n, t in (("n", T.LongType()), ("target", T.DoubleType()), ("background", T.DoubleType()))])

    @F.pandas_udf(kind)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        models = shared.value
        for batch in batches:
            n, sums = np.zeros(len(batch), np.int64), np.zeros((2, len(batch)))
            for number, word, cell in bigrams(batch.tolist()):
                n += np.bincount(number, minlength=len(n))
                for k, (emit, step) in enumerate(models):
                    sums[k] += np.bincount(number, emit[word] + step[cell], minlength=len(n))
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = sums / n
            yield pd.DataFrame({"n": n, "target": mean[0], "background": mean[1]})

    kept = docs.select(*[c for c in docs.columns if c not in ADDED])
    own = lambda c: F.when(F.col("_s.n") > 0, c)
    full: dict[str, Column] = {
        "lm_tokens": F.col("_s.n"),
        "target_loss": own(F.col("_s.target")),
        "background_loss": own(F.col("_s.background")),
        "loss_difference": own(F.col("_s.target") - F.col("_s.background")),
    }
    return kept.withColumn("_s", scored(text_or_empty())).withColumns(full).drop("_s")
