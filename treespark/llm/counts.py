"""Token counts by dynamic programming over a trie of pre-tokens.

Method: the distinct pre-tokens of a chunk of texts go into a trie, which is built level by level: words in order, a node
begins where a prefix differs from the one before. The unigram forward score of a prefix (the best sum of
piece log probabilities over its segmentations, and how many pieces that takes) is computed once, with its node, from the
nodes of the prefixes above it; words with a common beginning share it. Pieces that end at a node are found by walking
back from it through a trie of reversed pieces. Each word's count is stored where it ends, and a text's token count is the
sum over its words. Pieces are those of a public vocabulary; the probability of the piece of rank r is Zipf's, 1 / (r H)
with H the sum of 1 / r over all ranks, so probabilities add up to one. A character that no piece ends at falls back
to its bytes, each as improbable as the last rank.

A pre-token is a blank with the characters after it up to the next blank or line end (the blank written as the
vocabulary's mark), or the characters from a line's beginning; a line end is a token of its own. All of a chunk's nodes
are computed together; chunks hold about segments.CHUNK bytes, and of a longer text so many bytes at a time, so memory is
bounded; only a single word is held whole. Words beyond LONG characters leave the trie and are scored alone, by the same
sums. Nothing is shuffled.

Ties between segmentations go to fewer pieces. Defined results: null text counts as empty, with 0 tokens; a null doc_id
is kept; repeated rows are counted each; very long texts are counted whole; extra columns are kept, those named like added
ones are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import segments
from .common import bounded_batches, clear_of, release_memory, text_or_empty

SPACE = "▁"
LONG = 128
BITS = 21  # of a code point
MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=2)
def piece_scores(model_file: str) -> tuple[dict[str, float], float]:
    """Log probabilities of the pieces by Zipf's law over their ranks, and that of a byte."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    whole = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
    scores = {piece: -math.log(r) - whole for r, piece in enumerate(pieces, 1)}
    return scores, -math.log(len(pieces)) - whole


class Pieces:
    """The reversed pieces as a trie: steps by (node, character) in an open hash table, and the score of the piece that ends at a node."""

    def __init__(self, scores: dict[str, float], byte_score: float):
        self.scores, self.byte_score = scores, byte_score
        self.longest = max(map(len, scores), default=1)
        child: dict[int, int] = {}
        node_score = [-math.inf]
        for piece, score in scores.items():
            node = 0
            for letter in reversed(piece):
                key = node << BITS | ord(letter)
                if key not in child:
                    child[key] = len(node_score)
                    node_score.append(-math.inf)
                node = child[key]
            node_score[node] = score
        self.node_score = np.array(node_score)
        self.shift = np.uint64(64 - max(4, (8 * len(child)).bit_length()))
        size = 1 << (64 - int(self.shift))
        keys, values = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        self.probes = 1
        for key, value in child.items():
            at, tries = (key * int(MIX) & (1 << 64) - 1) >> int(self.shift), 1
            while keys[at] >= 0:
                at, tries = (at + 1) % size, tries + 1
            keys[at], values[at] = key, value
            self.probes = max(self.probes, tries)
        self.keys, self.values, self.size = keys, values, size

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The node after each letter, or -1."""
        key = nodes.astype(np.int64) << BITS | letters
        with np.errstate(over="ignore"):
            at = (key.astype(np.uint64) * MIX >> self.shift).astype(np.int64)
        out = np.full(len(key), -1, np.int32)
        open_ = np.arange(len(key))
        for _ in range(self.probes):
            held = self.keys[at]
            same = held == key
            out[open_[same]] = self.values[at[same]]
            on = ~same & (held >= 0)
            open_, key, at = open_[on], key[on], (at[on] + 1) % self.size
            if not len(open_):
                break
        return out

    def alone(self, word: str) -> int:
        """The token count of one word."""
        best = [(0.0, 0)]
        for at in range(1, len(word) + 1):
            n = len(word[at - 1].encode("utf-8", "surrogatepass"))
            score, minus = best[-1]
            found = (score + n * self.byte_score, minus - n)
            for size in range(1, min(self.longest, at) + 1):
                own = self.scores.get(word[at - size : at])
                if own is not None:
                    score, minus = best[-size]
                    found = max(found, (score + own, minus - 1))
            best.append(found)
            if len(best) > self.longest:
                best.pop(0)
        return -best[-1][1]


@lru_cache(maxsize=2)
def _pieces(model_file: str) -> Pieces:
    return Pieces(*piece_scores(model_file))


def word_counts(words: pa.Array, pieces: Pieces) -> np.ndarray:
    """The token count of each of the distinct words, binary UTF-8 whose first blank stands for the mark."""
    order = pc.sort_indices(words).to_numpy()
    words = words.take(pa.array(order))
    raw = b"".join(words.to_pylist())
    letters = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    bytes_at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    begins = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])[bytes_at - bytes_at[0]]
    start, size = begins[:-1], np.diff(begins)
    marked = (size > 0) & (np.append(letters, 0)[start] == 32)
    letters = letters.copy()
    letters[start[marked]] = ord(SPACE)
    width = 1 + (letters > 0x7F) + (letters > 0x7FF) + (letters > 0xFFFF)
    counts = np.zeros(len(words), np.int64)
    for i in np.flatnonzero(size > LONG).tolist():
        counts[i] = pieces.alone("".join(map(chr, letters[start[i] : start[i] + size[i]].tolist())))
    inside = np.flatnonzero((size > 0) & (size <= LONG))
    start, size = start[inside], size[inside]
    node_of = np.zeros(len(inside), np.int64)  # of each word still open, its node at the level before
    open_ = np.arange(len(inside))
    # by level, the last `longest` ones: scores, minus the counts, and the parents in the level before
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int64))]
    for depth in range(1, int(size.max(initial=0)) + 1):
        longer = size[open_] >= depth
        open_, node_of = open_[longer], node_of[longer]
        letter = letters[start[open_] + depth - 1]
        new = np.ones(len(open_), bool)
        new[1:] = (node_of[1:] != node_of[:-1]) | (letter[1:] != letter[:-1])
        first = np.flatnonzero(new)
        parent, at, own = node_of[first], start[open_[first]] + depth - 1, letter[first]
        node_of = np.cumsum(new) - 1
        best = levels[-1][0][parent] + width[at] * pieces.byte_score
        minus = levels[-1][1][parent] - width[at]
        live, state, up = np.arange(len(first)), np.zeros(len(first), np.int32), parent
        for back in range(1, min(depth, pieces.longest) + 1):
            state = pieces.step(state, own if back == 1 else letters[at[live] - back + 1])
            on = state >= 0
            live, state, up = live[on], state[on], up[on]
            if not len(live):
                break
            score, count = levels[-back][0][up] + pieces.node_score[state], levels[-back][1][up] - 1
            better = (score > best[live]) | ((score == best[live]) & (count > minus[live]))
            best[live[better]], minus[live[better]] = score[better], count[better]
            up = levels[-back][2][up]
        levels.append((best, minus, parent))
        if len(levels) > pieces.longest:
            levels.pop(0)
        ended = size[open_] == depth
        counts[inside[open_[ended]]] = -minus[node_of[ended]]
    out = np.empty_like(counts)
    out[order] = counts
    return out


def counts_of(data: np.ndarray, offsets: np.ndarray, pieces: Pieces, block: int = segments.CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Of each text (the bytes of data between offsets): pre-tokens and tokens."""
    bounds = segments.blank_cuts(data, offsets)
    per = np.zeros((2, len(bounds)), np.int64)  # by segment; 0 at the end
    at = 0
    while at < len(bounds) - 1:
        to = min(max(int(np.searchsorted(bounds, bounds[at] + block, side="right")) - 1, at + 1), len(bounds) - 1)
        index, words = segments.distinct(data, bounds[at : to + 1])
        line = np.asarray(pc.equal(words, b"\n"))
        tokens = word_counts(words, pieces)
        tokens[line] = 1
        per[0, at:to], per[1, at:to] = ~line[index], tokens[index]
        at = to
    sums = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(per, axis=1)], axis=1)
    place = np.searchsorted(bounds, offsets)
    found = sums[:, place]
    return found[0, 1:] - found[0, :-1], found[1, 1:] - found[1, :-1]


def count_tokens(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """docs with n_pretokens and n_tokens."""
    bounded_batches(docs.sparkSession)
    file = model_file or public_tokenizers.path("piece_bpe_32k.model")
    kept = docs.select(*[c for c in docs.columns if c.lower() not in ("n_pretokens", "n_tokens")])
    own = clear_of(kept, "_text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(file)
        for batch in segments.chunks(batches, own):
            column = batch.column(own)
            found = counts_of(*segments.utf8(column), pieces)
            columns = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != own]
            names = [name for name in batch.schema.names if name != own]
            whole = pa.RecordBatch.from_arrays([*columns, *map(pa.array, found)], names=[*names, "n_pretokens", "n_tokens"])
            for at in range(0, len(whole), 10_000):
                yield whole.slice(at, 10_000)
        release_memory()

    kind = T.StructType([*kept.schema.fields, T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return kept.withColumn(own, text_or_empty()).mapInArrow(counted, kind)
