"""Byte-level BPE encoding and decoding by folds in Spark's higher-order functions.

Method: Python tasks cut their texts into pre-tokens, chunk by chunk, and number a chunk's distinct ones. The words of all
chunks meet in one shuffle, where each distinct word of the corpus is folded once, in Spark: `aggregate` over the word's
byte array merges, step by step, the leftmost adjacent pair of lowest rank, looked up in a literal rank map, until
no pair has a rank. A second shuffle brings the ids to the chunks that hold the word and, beside them, each document as a list
of its words' numbers; there numbers become ids, and ids are decoded by concatenating their binary pieces. No text
or word reaches the driver, and no group is collected: a chunk's rows stream through, words first.

The chunks are cut twice, once for their words and once for their documents, by the same scan; so docs has to give the same rows in
the same partitions and order each time, as files and written tables do. That is checked: a document whose decoded bytes aren't those of its
text raises an error.

A fold copies its state at each merge, so it would be quadratic in a word's length. Words beyond LONG bytes are folded by
windows, whose borders are proven (see fold_long), so their cost grows with their length.

A byte is written as the character of that code (ISO 8859-1) while words are shuffled, and as a number in the fold.

Defined results: null text counts as empty (no ids; the digests of nothing); a null doc_id is kept; repeated rows are
encoded each; very long texts and words are encoded whole; extra columns are ignored; special tokens are ordinary
text; an empty table gives an empty result. Ties between pairs of one rank go to the leftmost.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import groupby
from operator import itemgetter
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import segments
from .common import bounded_batches, release_memory, text_or_empty
from .rules import let

LONG = 256
SPREAD = 1 << 18
NONE = 1 << 17  # this and above: no rank
TOKEN = 1 << 40  # a token stands in the fold's state as TOKEN + its rank, above all pairs
NO_PAIR = TOKEN - 1
REST = 1 << 30
#: A place is a chunk and, in its lower bits, a word's number; documents have the LAST number of their chunk.
NUMBER = 28
LAST = (1 << NUMBER) - 1
#: Words are shuffled by buckets, so many at least, or as many as there are shuffle partitions; BETWEEN stands between a row's words.
BUCKETS, BETWEEN = 2048, "\u0100"
#: Numbers of words in a row of documents; a longer document has a row of its own.
GROUP = 100_000
#: Bytes of text in a chunk, and segments that are numbered at a time: they bound a worker's memory.
CHUNK, BLOCK = 20 << 20, 1 << 19


@lru_cache(maxsize=4)
def read_ranks(file: str) -> dict[bytes, int]:
    with open(file, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


class Ranks:
    """The rank map as literals: ranks of single bytes, and the rank of the token that two adjacent ones (by rank) make.

    Spark searches a map, or an array for a value, entry by entry; so the pairs' map is one table in which each first token
    has a base, so chosen that no two pairs share the slot base[first] + second. An entry is (first + 1) * 2^17 + rank, a free one 0; its
    exclusive or with (first + 1) * 2^17 is the rank, or NONE at least if the slot isn't the first token's.
    """

    def __init__(self, ranks: dict[bytes, int]):
        rows: dict[int, list[tuple[int, int]]] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    rows.setdefault(a, []).append((b, rank))
        tokens = max(ranks.values()) + 1
        base, table = np.zeros(tokens, np.int64), np.zeros(SPREAD + tokens, np.int64)
        for a, pairs in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):  # the longest first, while there is room
            seconds, own = np.array(pairs).T
            at = a * 40_503 % SPREAD
            while table[at + seconds].any():
                at = (at + 40_503) % SPREAD
            base[a], table[at + seconds] = at, (a + 1 << 17) + own
        sizes = np.zeros(tokens, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        literal = {"single": [ranks[bytes([b])] for b in range(256)], "sizes": sizes.tolist(), "base": base.tolist(), "table": table.tolist()}
        self.tables = F.from_json(F.lit(json.dumps(literal)), "single array<int>, sizes array<int>, base array<int>, table array<bigint>")


def pair_rank(ranks: Column, a: Column, b: Column) -> Column:
    """Of adjacent tokens: the rank of the token they make, or a number from NONE on."""
    entry = F.get(ranks["table"], F.get(ranks["base"], a) + b)
    return F.coalesce(entry.bitwiseXOR(F.shiftleft(a.cast("bigint") + 1, 17)), F.lit(NO_PAIR))


def fold_words(words: Column, ranks: Ranks) -> Column:
    """The ids of each of an array of words; the literals are bound once, so the plan holds one copy of each."""

    def ids(word: Column, tables: Column) -> Column:
        tokens = F.transform(F.split(word, ""), lambda c: F.get(tables["single"], F.ascii(c)))
        return let(tokens, lambda t: F.when(F.size(t) <= LONG, fold_tokens(t, tables)).otherwise(fold_long(t, tables)))

    return let(ranks.tables, lambda tables: F.transform(words, lambda w: ids(w, tables)))


def _pairs(tokens: Column, ranks: Column) -> Column:
    """Of each token, the rank of the pair with the next one."""
    return F.zip_with(tokens, F.slice(tokens, F.lit(2), F.lit(REST)), lambda a, b: pair_rank(ranks, a, b))


def fold_tokens(tokens: Column, ranks: Column) -> Column:
    """The ids of a byte array, given as ranks of single bytes: a fold over ranked merges.

    The state holds, in turn, pairs (by rank) and tokens (TOKEN + rank), with a pair without rank at either end. A step merges the
    leftmost pair of lowest rank, whose rank is the new token's, and looks up the two pairs that this one makes.
    """

    def step(state: Column, _) -> Column:
        def merged(at: Column) -> Column:
            low = F.get(state, at - 1)
            token = low.cast("int")
            other = lambda i: (F.get(state, i) - TOKEN).cast("int")
            new = F.array(pair_rank(ranks, other(at - 4), token), low + TOKEN, pair_rank(ranks, token, other(at + 2)))
            return F.when(low < NONE, F.concat(F.slice(state, F.lit(1), at - 3), new, F.slice(state, at + 3, F.lit(REST)))).otherwise(state)

        return let(F.array_position(state, F.array_min(state)).cast("int"), merged)

    both = F.zip_with(tokens, _pairs(tokens, ranks), lambda t, p: F.array(t.cast("bigint") + TOKEN, p))
    start = F.concat(F.array(F.lit(NO_PAIR)), F.flatten(both))
    done = lambda state: F.transform(F.filter(state, lambda x: x >= TOKEN), lambda x: (x - TOKEN).cast("int"))
    return F.aggregate(F.slice(tokens, F.lit(2), F.lit(REST)), start, step, done)


def fold_long(tokens: Column, ranks: Column) -> Column:
    """fold_tokens of a long word, by windows of LONG bytes.

    A window is folded alone; of its tokens the first half stands, and the next window starts where they end. That is exact if the
    last token before the start and the first one after it, folded together, stay as they are: a merge over that
    border in the whole word would then come up between these two as well, as merges on either side of it run in the same order.
    Otherwise the last token is taken back, and the window starts before it. Should the steps not suffice, the word is folded whole.
    """
    length, window = F.size(tokens), F.lit(LONG)
    size = lambda token: F.get(ranks["sizes"], token)

    def step(state: Column, _) -> Column:
        at = state["at"]

        def placed(ids: Column) -> Column:
            last, first = F.get(state["done"], F.size(state["done"]) - 1), F.get(ids, F.lit(0))
            both = fold_tokens(F.slice(tokens, at - size(last), size(last) + size(first)), ranks)
            half = F.slice(ids, F.lit(1), F.ceil(F.size(ids) / 2).cast("int"))
            moved = lambda done, to: F.struct(done.alias("done"), to.alias("at"))
            return (
                F.when(F.coalesce(both != F.array(last, first), F.lit(False)), moved(F.slice(state["done"], F.lit(1), F.size(state["done"]) - 1), at - size(last)))
                .when(at + window > length, moved(F.concat(state["done"], ids), length + 1))
                .otherwise(moved(F.concat(state["done"], half), at + F.aggregate(half, F.lit(0), lambda n, x: n + size(x))))
            )

        return F.when(at > length, state).otherwise(let(fold_tokens(F.slice(tokens, at, window), ranks), placed))

    start = F.struct(F.array().cast("array<int>").alias("done"), F.lit(1).alias("at"))
    steps = F.sequence(F.lit(1), F.ceil(length / F.lit(LONG / 8)).cast("int") + 64)
    return F.aggregate(steps, start, step, lambda s: F.when(s["at"] > length, s["done"]).otherwise(fold_tokens(tokens, ranks)))


class Numbered:
    """A chunk's distinct pre-tokens, the frequent ones first, and its texts as their numbers."""

    def __init__(self, column: pa.Array, find):
        data, offsets = segments.utf8(column)
        bounds = segments.pattern_cuts(data, offsets)
        index, distinct = segments.distinct(data, bounds)
        numbers: dict[str, int] = {}
        flat, sizes = [], []
        for segment in distinct.to_pylist():
            found = find(segment.decode())
            sizes.append(len(found))
            flat += [numbers.setdefault(word, len(numbers)) for word in found]
        sizes = np.array(sizes, np.int64)
        own, starts = np.array(flat, np.uint32), np.cumsum(sizes) - sizes
        blocks = [own[segments.expanded(sizes, starts, index[at : at + BLOCK])] for at in range(0, len(index), BLOCK)]
        stream = np.concatenate([np.zeros(0, np.uint32), *blocks])
        seen = np.bincount(stream, minlength=len(numbers))
        order = np.argsort(-seen, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        names = list(numbers)
        self.words = [names[i] for i in order.tolist()]
        self.stream = place[stream]
        ends = np.concatenate([[0], np.cumsum(sizes[index])])
        self.bounds = ends[np.searchsorted(bounds, offsets)]
        self.sums = [crc32(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _packed(numbers: np.ndarray, compress) -> bytes:
    """Numbers, byte by byte of all: the high bytes of most are 0."""
    return compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(packed: bytes, decompress) -> np.ndarray:
    planes = np.frombuffer(decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def encode_documents(docs: DataFrame, rank_file: str | None = None, pattern: str = public_tokenizers.PATTERN, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded] of each row of docs (doc_id, text)."""
    file = rank_file or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, Numbered]]:
        find = regex.compile(pattern).findall
        for i, chunk in enumerate(segments.chunks(batches, size=CHUNK)):
            own, part = Numbered(chunk.column("text"), find), chunk.column("part")[0].as_py()
            if part >= 1 << 22 or i >= 1 << 13 or len(own.words) > LAST:
                raise ValueError("more tasks, chunks of a task or words of a chunk than places have bits for")
            yield (part << 13 | i) << NUMBER, chunk, own
        release_memory()

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for a chunk's words of one bucket, in order, as they share beginnings."""
        for place, _, own in cut(batches):
            raw = [w.encode("utf-8", "surrogatepass") for w in own.words]
            in_order = sorted(zip([crc32(w) % buckets for w in raw], [w.decode("latin-1") for w in raw], range(len(raw))))
            grouped = [(b, list(group)) for b, group in groupby(in_order, itemgetter(0))]
            for at in range(0, len(grouped), 500):
                some = grouped[at : at + 500]
                columns = [
                    pa.array([b for b, _ in some], pa.int32()), pa.array(np.full(len(some), place)),
                    pa.array([[n for _, _, n in group] for _, group in some], pa.list_(pa.int32())),
                    pa.array([BETWEEN.join([w for _, w, _ in group]) for _, group in some], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "chunk", "number", "words"])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of some documents each: their ids, the lengths and sums of their texts, and their numbers."""
        compress = zstandard.ZstdCompressor(level=3).compress
        for place, chunk, own in cut(batches):
            ids, at = chunk.column("doc_id"), 0
            while at < len(chunk):
                to = min(max(int(np.searchsorted(own.bounds, own.bounds[at] + GROUP, side="right")) - 1, at + 1), at + 2000, len(chunk))
                kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
                values = (ids.slice(at, to - at).to_pylist(), np.diff(own.bounds[at : to + 1]), own.sums[at:to], _packed(own.stream[own.bounds[at] : own.bounds[to]], compress))
                yield pa.RecordBatch.from_arrays([pa.array([place + LAST]), *[pa.array([v], kind) for v, kind in zip(values, kinds)]], names=["at", "doc_ids", "sizes", "sums", "numbers"])
                at = to

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words with their ids, packed by chunk: how many, their numbers as steps, their lengths, and all ids."""
        compress, held, rows = zstandard.ZstdCompressor(level=1).compress, [], 0

        def flushed() -> pa.RecordBatch:
            at, ids = (pa.chunked_array([b.column(c) for b in held]).combine_chunks() for c in ("at", "ids"))
            at, starts, flat = at.to_numpy(), ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy()
            order = np.argsort(at, kind="stable")
            at, lengths, starts = at[order], np.diff(starts)[order], starts[:-1][order]
            edges = [0, *(np.flatnonzero(np.diff(at >> NUMBER)) + 1).tolist(), len(at)]
            out = []
            for a, b in zip(edges, edges[1:]):
                own = flat[segments.expanded(lengths[a:b], starts[a:b], np.arange(b - a))]
                out.append(_packed(np.concatenate([[b - a], np.diff(at[a:b] & LAST, prepend=0), lengths[a:b], own]), compress))
            return pa.RecordBatch.from_arrays([pa.array(at[edges[:-1]] & ~LAST), pa.array(out, pa.binary())], names=["at", "packed"])

        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= 200_000:
                yield flushed()
                held, rows = [], 0
        if rows:
            yield flushed()
        release_memory()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {rank: word for word, rank in read_ranks(file).items()}
        decompress = zstandard.ZstdDecompressor().decompress
        key, held, table = None, [], None
        for batch in batches:
            chunk = batch.column("at").to_numpy() >> NUMBER
            edges = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist(), len(chunk)]
            for start, end in zip(edges, edges[1:]):
                if start == end:
                    continue
                if chunk[start] != key:
                    key, held, table = chunk[start], [], None
                part = batch.slice(start, end - start)
                n_words = part.column("numbers").null_count  # words come before documents
                held += [_unpacked(x, decompress) for x in part.column("packed").slice(0, n_words).to_pylist()]
                if n_words < len(part):
                    if table is None:
                        table = _table(held)
                    yield from _encoded(part.slice(n_words), table, pieces, decompress, with_ids)
        release_memory()

    bounded_batches(docs.sparkSession)
    buckets = max(BUCKETS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.spark_partition_id().alias("part"))
    # the same columns as for documents, so that batches end at the same rows
    listed = own.mapInArrow(words, "bucket int, chunk long, number array<int>, words string").repartition("bucket").withColumn("word", F.split("words", BETWEEN))
    listed = listed.select("bucket", "chunk", F.explode(F.arrays_zip("number", "word")).alias("w")).select("bucket", (F.col("chunk") + F.col("w.number")).alias("at"), "w.word")
    same_word = Window.partitionBy("bucket", "word").orderBy("at")
    fold = F.get(fold_words(F.array("word"), Ranks(read_ranks(file))), F.lit(0))
    folded = listed.withColumn("_n", F.row_number().over(same_word)).withColumn("ids", F.when(F.col("_n") == 1, fold))
    upto = same_word.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of_chunks = folded.select("at", F.first("ids", ignorenulls=True).over(upto).alias("ids")).mapInArrow(pack, "at long, packed binary")
    texts = own.mapInArrow(documents, "at long, doc_ids array<long>, sizes array<long>, sums array<long>, numbers binary")
    met = of_chunks.unionByName(texts, allowMissingColumns=True).repartition(F.shiftright("at", NUMBER)).sortWithinPartitions("at")
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids
    return met.mapInArrow(assemble, kind)


def _table(packs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By number: the words' lengths in ids and where these start among all, from packs of a chunk."""
    parts = [(np.cumsum(x[1 : x[0] + 1]), x[x[0] + 1 : 2 * x[0] + 1].astype(np.int64), x[2 * x[0] + 1 :]) for x in packs]
    numbers, sizes, flat = (np.concatenate([np.zeros(0, kind), *x]) for kind, x in zip((np.int64, np.int64, "<u4"), zip(*parts) if parts else ((), (), ())))
    lengths, starts = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
    numbers = numbers.astype(np.int64)
    lengths[numbers], starts[numbers] = sizes, np.cumsum(sizes) - sizes
    return lengths, starts, flat.astype("<u4")


def _encoded(groups: pa.RecordBatch, table, pieces: dict[int, bytes], decompress, with_ids: bool) -> Iterator[pa.RecordBatch]:
    lengths, starts, flat = table
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_ids]
    for doc_ids, sizes, sums, numbers in zip(*[groups.column(c).to_pylist() for c in ("doc_ids", "sizes", "sums", "numbers")]):
        stream, at, rows = _unpacked(numbers, decompress), 0, []
        for doc_id, size, crc in zip(doc_ids, sizes, sums):
            ids = flat[segments.expanded(lengths, starts, stream[at : at + size])]
            at += size
            decoded = b"".join(map(pieces.__getitem__, ids.tolist()))
            if crc32(decoded) != crc:
                raise ValueError("the documents were not the same rows in the same order when read again: give a written table")
            rows.append((doc_id, len(ids), sha256(ids.tobytes()).hexdigest(), sha256(decoded).hexdigest(), *([ids.astype(np.int32), decoded] if with_ids else [])))
        yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=names)
