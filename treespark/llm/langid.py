"""Language identification by prediction by partial matching over bytes.

Method: one byte context tree of order 3 for each language, its counts frozen after training. The probability of a
byte in a context is its count over (total + distinct); a byte not yet seen there escapes with probability
distinct / (total + distinct) to the context without its first byte, and below order 0 all 256 bytes are alike. A
text's exact code length under a language is the sum of -log2 of these. The prediction is the language with the
shortest code; its score is the posterior probability under equal priors.

Every context seen in training is a node, whatever its order, and trees are sparse: what a node holds are the bytes seen after it.
Code lengths of these and of escapes are tabled once, so a byte costs one look-up if it was seen in its longest context. There is no
exclusion: a byte seen in the longer context keeps its share in the shorter one, so code lengths are those of a
sub-probability, alike for all languages. Training gathers (language, 4-gram) counts from documents chosen by a hash of doc_id so that
each language gives about max_train_chars characters; the bound holds for the model, every text is predicted whole.

Defined results: null text, or text without a letter, gives `und` and score 0; so does every text if nothing was
learned. Very long texts are predicted whole, block by block. Columns named like added ones are replaced. Null lang is not learned from. A null doc_id counts as held out. Repeated rows are predicted each; ties
go to the alphabetically first language; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, release_memory

ORDER = 3
PAD = b"\n" * ORDER
#: Bytes of text that are worked on at a time: what a step needs besides the model is about 100 times that.
BLOCK = 1 << 18


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def has_letter(text: str = "text") -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each 4 bytes (big-endian number) occur in the texts of a language."""

    def of_parts(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
        own = np.ones(len(raw), bool)  # the padding is context only
        own[(np.cumsum([0, *map(len, parts[:-1])])[:, None] + np.arange(ORDER)).ravel()] = False
        return np.unique((raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:])[own[ORDER:]], return_counts=True)

    def blocks(texts: pd.Series) -> Iterator[list[bytes]]:
        parts, size = [], 0
        for text in texts:
            raw = text.encode()
            for at in range(0, len(raw), BLOCK):  # a long text goes on from its last context
                parts.append((raw[at - ORDER : at] if at else PAD) + raw[at : at + BLOCK])
                size += len(parts[-1])
                if size >= BLOCK:
                    yield parts
                    parts, size = [], 0
        if parts:
            yield parts

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                found = [of_parts(parts) for parts in blocks(texts)]
                if found:
                    grams, own = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                    n = np.bincount(own, np.concatenate([n for _, n in found])).astype("int64")
                    yield pd.DataFrame({"lang": lang, "gram": grams.astype("int64"), "n": n})
        release_memory()

    return docs.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Places:
    """Of distinct numbers below 2^32, their places in the order given, by an open hash table of arrays."""

    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.places = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):  # all that still seek a slot try their next one; of those that meet, one gets it
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]
            got = free & (self.keys[at] == keys[left])
            self.places[at[got]] = left[got]
            left, at = left[~got], (at[~got] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * self.MIX >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        out, left, at = np.full(len(keys), -1, np.int32), np.arange(len(keys)), self._slot(keys)
        while len(left):
            held = self.keys[at]
            same = held == keys
            out[left[same]] = self.places[at[same]]
            on = ~same & (held >= 0)
            left, keys, at = left[on], keys[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out


class ContextTrees:
    """Code lengths in bits by language: of each sequence of 1 to ORDER + 1 bytes seen, that of its last byte after the others, and of
    each context seen, that of an escape. All other code lengths are sums of these, so size follows what was seen in training."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        gram, n = counts["gram"].to_numpy("int64"), counts["n"].to_numpy("float64")
        lang = counts["lang"].map({x: i for i, x in enumerate(self.langs)}).to_numpy("int64")
        size = len(self.langs)
        probability, below = np.full((1, size), 1 / 256), np.zeros(1, np.int64)
        self.seen, self.bits, self.contexts, self.escapes = [], [], [], []
        for k in range(ORDER + 1):
            keys, own = np.unique(gram & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            count = np.bincount(own * size + lang, n, minlength=len(keys) * size).reshape(-1, size)
            contexts, of = np.unique(keys >> 8, return_inverse=True)
            total, distinct = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
            np.add.at(total, of, count)
            np.add.at(distinct, of, count > 0)
            with np.errstate(invalid="ignore", divide="ignore"):
                escape = np.where(total > 0, distinct / (total + distinct), 1.0)
                direct = count / (total + distinct)[of]
            # what follows a context was seen after the shorter one as well
            under = probability[np.searchsorted(below, keys & ((1 << 8 * k) - 1))] if k else probability
            probability, below = np.where(count > 0, direct, escape[of] * under), keys
            self.seen.append(Places(keys))
            self.bits.append(-np.log2(probability))
            self.contexts.append(Places(contexts))
            self.escapes.append(-np.log2(escape))

    def _bits(self, gram: np.ndarray) -> np.ndarray:
        """(sequences, languages): the code length of the last of ORDER + 1 bytes after the others."""
        out, left = np.zeros((len(gram), len(self.langs))), np.arange(len(gram))
        for k in range(ORDER, -1, -1):
            key = gram[left] & ((1 << 8 * (k + 1)) - 1)
            at = self.seen[k].find(key)
            known = at >= 0
            out[left[known]] += self.bits[k][at[known]]
            left, key = left[~known], key[~known]
            if not len(left):
                return out
            context = self.contexts[k].find(key >> 8)
            met = context >= 0
            out[left[met]] += self.escapes[k][context[met]]
        out[left] += 8.0
        return out

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): bits of each whole text."""
        out, group, size = np.zeros((len(texts), len(self.langs))), [], 0
        for i, text in enumerate(texts):
            raw = text.encode()
            for at in range(0, len(raw), BLOCK):  # a long text goes on from its last context
                group.append((i, (raw[at - ORDER : at] if at else PAD) + raw[at : at + BLOCK]))
                size += len(group[-1][1])
                if size >= BLOCK:
                    self._add(group, out)
                    group, size = [], 0
        if group:
            self._add(group, out)
        return out

    def _add(self, group: list[tuple[int, bytes]], out: np.ndarray) -> None:
        raw = np.frombuffer(b"".join(raw for _, raw in group), np.uint8).astype(np.int64)
        gram = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        sizes = np.array([len(raw) for _, raw in group])
        ends = np.cumsum(sizes)
        bounds = np.stack([ends - sizes, ends - ORDER], axis=1).ravel()[:-1]
        np.add.at(out, [i for i, _ in group], np.add.reduceat(self._bits(gram), bounds, axis=0)[::2])


def train(docs: DataFrame, max_train_chars: int = 3_000_000) -> ContextTrees | None:
    """Context trees from the texts of docs that are not held out and whose lang is known; None if there are none.

    Of each language about max_train_chars characters are learned from: documents are chosen by a hash of doc_id, and the first one by that
    hash in any case.
    """
    bounded_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & has_letter() & ~held_out()).select(F.col("doc_id"), "lang", "text")
    place = F.xxhash64("doc_id")
    sizes = {r["lang"]: r for r in known.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.min(place).alias("first")).collect()}
    if not sizes:
        return None
    chosen = F.lit(False)
    for lang, r in sizes.items():
        share = max_train_chars / r["chars"] * 1_000_000
        chosen = F.when(F.col("lang") == lang, (F.pmod(place, F.lit(1_000_000)) < share) | (place == r["first"])).otherwise(chosen)
    counts = gram_counts(known.where(chosen)).toPandas()
    return ContextTrees(counts) if len(counts) else None


def predict(docs: DataFrame, model: ContextTrees | None) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and bits_per_byte of the shortest code."""
    added = ["lang_pred", "score", "bits_per_byte"]
    kept = docs.select(*[c for c in docs.columns if c not in added])
    if model is None:
        return kept.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "bits_per_byte": F.lit(None).cast("double")})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size follows the bounded sample

    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("p", T.DoubleType()), T.StructField("bits", T.DoubleType())])

    @F.pandas_udf(kind)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trees = shared.value
        for texts in batches:
            known = texts.notna().to_numpy()
            out = pd.DataFrame({"lang": ["und"] * len(texts), "p": 0.0, "bits": np.nan})
            if known.any():
                own = texts[known].tolist()
                bits = trees.code_lengths(own)
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(own)), best]
                out.loc[known, "lang"] = np.array(trees.langs, dtype=object)[best]
                out.loc[known, "p"] = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                out.loc[known, "bits"] = least / [len(t.encode()) for t in own]
            yield out
        release_memory()

    return (
        kept.withColumn("lang_pred", judged(F.when(has_letter(), F.col("text"))))
        .withColumns({"score": F.col("lang_pred.p"), "bits_per_byte": F.col("lang_pred.bits"), "lang_pred": F.col("lang_pred.lang")})
    )
