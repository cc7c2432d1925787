"""Document quality by hierarchical empirical Bayes.

Method: a document classifier (naive Bayes over binned shares of marks, bars, shouting, brackets and repeated words, fitted by
grouped counts over labelled documents) gives each document its evidence, a log likelihood ratio. The mean posteriors
of a path's documents, all of them, are shrunk towards its host's, and these towards the global one, by beta
priors whose strengths come from the variance between hosts and between the paths of a host. A document's score is
the probability from its path's shrunken prior, in which its own posterior is left out, and its own evidence.

Here the host is `source`, and a path is (`source`, `lang`). All statistics are sums over groups; what comes to the
driver is the bins' counts (fixed in number) and a few moments. The table of paths is joined by broadcast up to
max_broadcast_paths rows and by shuffle beyond.

Defined results: null text counts as empty; very long texts are read whole; a mean label of 0.5 counts as good; a null host or path is a group of its own; several labels of a
document count by their mean; null labels and labels of unknown documents count not at all; without labels of both
kinds the evidence is 0 and every score is near the prior 0.5 (kept). Extra columns are kept; columns named like added ones
are replaced; repeated rows are scored each.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, release_memory, small_side, text_or_empty, written

EDGES = (0.0, 0.03, 0.1, 0.3)
BINS = len(EDGES) + 1


def features(text: str) -> list[int]:
    """Bins (0 to BINS - 1) of a text's features, in fixed order: marks, bars, shouting, brackets, repeated words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = max(1, len(words))
    few = lambda marks: len(raw) - len(raw.translate(None, marks))
    shares = [
        few(b"#*$%&<>") / n,
        raw.count(b"|") / n,
        raw.count(b"!") / n,
        sum(w.isupper() and len(w) > 3 for w in words) / n,
        few(b"{}[]()=_\\/@+~^") / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
    ]
    return [bisect_left(EDGES, s) for s in shares]


N_FEATURES = 6


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([features(t) for t in batch])
    release_memory()


def fit(binned: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """(N_FEATURES, BINS) log likelihood ratios of good against bad, and the share of good labels."""
    said = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    rows = binned.select("doc_id", "bins").join(said, "doc_id").select("good", F.posexplode("bins").alias("feature", "bin"))
    counts = np.zeros((2, N_FEATURES, BINS))
    for r in rows.groupBy("good", "feature", "bin").count().collect():
        counts[int(r["good"]), r["feature"], r["bin"]] = r["count"]
    bad, good = counts[0, 0].sum(), counts[1, 0].sum()
    if not bad or not good:
        return np.zeros((N_FEATURES, BINS)), 0.5
    smooth = counts + 0.5
    rates = smooth / smooth.sum(axis=2, keepdims=True)
    return np.log(rates[1] / rates[0]), good / (bad + good)


def _strength(rows: DataFrame, mean: float) -> float:
    """Of the beta prior around mean, from the variance between the rates in rows (n, rate) beyond their own noise."""
    m = rows.agg(F.sum("n"), F.sum(F.col("n") * (F.col("rate") - mean) ** 2), F.count("*")).first()
    if not m[0] or m[2] < 2:
        return 10.0
    noise = mean * (1 - mean)
    between = max(m[1] / m[0] - noise * m[2] / m[0], 1e-4)
    return min(1000.0, max(1.0, noise / between - 1))


def _logit(p):
    return F.log(p / (1 - p))


def score_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.3, max_broadcast_paths: int = 50_000) -> DataFrame:
    """docs with evidence, path_prior, quality_score (0 to 1) and quality_keep (score at least threshold)."""
    bounded_batches(docs.sparkSession)
    keys = {"_host": F.col(host).cast("string"), "_path": F.col(path).cast("string")}
    binned = written(docs.select("doc_id", *[c.alias(n) for n, c in keys.items()], _features(text_or_empty()).alias("bins")), "features")
    ratios, share = fit(binned, labels)

    @F.pandas_udf(T.DoubleType())
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at = np.arange(N_FEATURES)
        for bins in batches:
            yield pd.Series([ratios[at, b].sum() for b in bins], dtype="float64")

    base = math.log(share / (1 - share))
    posterior = 1 / (1 + F.exp(-(weigh("bins") + base)))
    paths = written(binned.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum(posterior).alias("k")), "paths")
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("rate", F.col("k") / F.col("n"))
    whole = hosts.agg(F.sum("k") / F.sum("n")).first()[0]
    mean = min(max(whole if whole is not None else 0.5, 1e-3), 1 - 1e-3)
    s_host = _strength(hosts, mean)
    shrunk = hosts.select(F.col("_host").alias("_of"), ((F.col("k") + s_host * mean) / (F.col("n") + s_host)).alias("host_prior"), "rate")
    within = paths.join(shrunk, F.col("_host").eqNullSafe(F.col("_of")))
    s_path = _strength(within.select("n", (F.col("k") / F.col("n") - F.col("rate") + mean).alias("rate")), mean)
    sums = [F.col("n").alias("_n"), F.col("k").alias("_k"), F.col("host_prior").alias("_host_prior")]
    table = small_side(written(within.select(F.col("_host").alias("_h"), F.col("_path").alias("_p"), *sums), "priors"), max_broadcast_paths)
    own = 1 / (1 + F.exp(-(F.col("evidence") + base)))  # the document's own part of its path's sum is left out
    prior = (F.greatest(F.lit(0.0), F.col("_k") - own) + s_path * F.col("_host_prior")) / (F.col("_n") - 1 + s_path)
    prior = F.least(F.lit(1 - 1e-3), F.greatest(F.lit(1e-3), prior))

    @F.pandas_udf(T.DoubleType())
    def evidence(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at = np.arange(N_FEATURES)
        for batch in texts:
            yield pd.Series([ratios[at, features(t)].sum() for t in batch], dtype="float64")
        release_memory()

    added = ["evidence", "path_prior", "quality_score", "quality_keep"]
    kept = docs.select(*[c for c in docs.columns if c not in added])
    scored = kept.withColumn("evidence", evidence(text_or_empty()))
    same = scored[host].cast("string").eqNullSafe(table["_h"]) & scored[path].cast("string").eqNullSafe(table["_p"])
    return (
        scored.join(table, same, "left").withColumn("path_prior", prior).drop("_h", "_p", "_n", "_k", "_host_prior")
        .withColumn("quality_score", 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("path_prior"))))))
        .withColumn("quality_keep", F.col("quality_score") >= threshold)
    )
