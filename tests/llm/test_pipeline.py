"""The pipeline on the smallest tables: each stage against a plain version of its decision, on that stage's own input."""

import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from treespark.llm import langid, quality, shingles
from treespark.llm.common import written

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        result = written(stage(spark, docs, DATA), "stage")
        out.append((name, docs.toPandas(), result.toPandas()))
        docs = result
    return out


def test_names_and_columns(stages):
    assert [n for n, _, _ in stages] == ["quality classifier", "language ID", "SimHash near-dedup", "best-fit packing"]
    for _, _, result in stages[:-1]:
        assert list(result.columns) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_stage(spark, stages):
    _, docs, kept = stages[0]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    binned = spark.createDataFrame([(int(i), quality.features(t or "")) for i, t in zip(docs.doc_id, docs.text)], "doc_id long, bins array<int>")
    ratios, _ = quality.fit(binned, labels)
    evidence = np.array([ratios[np.arange(quality.N_FEATURES), quality.features(t or "")].sum() for t in docs.text])
    # priors move a document's log odds by a bounded amount: clear evidence decides
    assert set(docs.doc_id[evidence > 1]) <= set(kept.doc_id) and not set(docs.doc_id[evidence < -5]) & set(kept.doc_id)
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(good - set(kept.doc_id)) <= 0.01 * len(good)


def test_language_stage(spark, stages):
    _, docs, kept = stages[1]
    trees = langid.train(spark.createDataFrame(docs))
    for text, own in zip(docs.text, docs.doc_id.isin(kept.doc_id)):
        bits = trees.code_lengths([text or ""])[0]
        score = 1 / np.exp2(np.maximum(bits.min() - bits, -1000)).sum()
        assert own == (any(c.isalpha() for c in text or "") and score >= corpus_pipeline.MIN_LANGUAGE_SCORE)


def test_dedup_stage(stages):
    """The stage's contract: five-word shingles, similarity of 0.8 or more, the smallest doc_id of each group stays."""
    _, docs, kept = stages[2]
    rows = sorted(zip(docs.doc_id, docs.text))
    sets, group = five_word_sets(t for _, t in rows), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if group[a] != group[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    assert sorted(kept.doc_id) == [rows[i][0] for i, g in enumerate(group) if i == g]


def test_packing_stage(stages):
    _, docs, pieces = stages[3]
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc_id, text in zip(docs.doc_id, docs.text):
        ids = exact.encode(text or "", add_special_tokens=False).ids + [2]
        own = pieces[pieces.doc_id == doc_id].sort_values("piece")
        assert own.length.sum() == len(ids)
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[r.start : r.start + r.length], "<u4").tobytes())
    for _, rows in pieces.sort_values("offset").groupby("sequence_id"):
        assert rows.length.sum() <= 1024 and list(rows.offset) == list(np.cumsum([0, *rows.length])[:-1])


def test_rows_without_ids_and_repeats_survive_dedup(spark):
    rows = [(None, "alpha beta gamma delta", "en", "s", 1), (None, "alpha beta gamma delta", "en", "s", 1), (4, "one two three four", "en", "s", 1), (4, "one two three four", "en", "s", 1), (5, "one two three four", "en", "s", 1), (9, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, DATA)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 4), (False, 9), (True, 0), (True, 0)]
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), DATA).count() == 0


def five_word_sets(texts):
    out = []
    for t in texts:
        words = (t or "").encode().lower().split()
        out.append({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


@pytest.mark.parametrize("few", [1, 1000])  # in tiles, and pair by pair
def test_dedup_drops_near_copies_by_five_word_similarity(spark, monkeypatch, few):
    monkeypatch.setattr(shingles, "FEW", few)
    rng, rows = np.random.default_rng(3), []
    for family in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        for _ in range(8):  # 0 to 12 changed words: similarities from 1 down to about 0.5
            own = list(words)
            for at in rng.choice(200, rng.integers(0, 13), replace=False):
                own[at] = f"x{rng.integers(10**9)}"
            rows.append((len(rows), " ".join(own), "en", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sets, group = five_word_sets(r[1] for r in rows), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if group[a] != group[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, DATA).collect())
    assert kept == [i for i, g in enumerate(group) if i == g] and 12 < len(kept) < 96


def test_simhash_alone_links_similar_texts_within_two_bits(spark):
    from itertools import combinations

    from pyspark.sql import functions as F

    from treespark.llm.simhash import simhash

    rng, rows = np.random.default_rng(5), []
    for _ in range(10):
        words = [f"w{x}" for x in rng.integers(0, 5000, 400)]
        for changed in (0, 1, 1, 2, 40):
            own = list(words)
            for at in rng.choice(400, changed, replace=False):
                own[at] = f"x{rng.integers(10**9)}"
            rows.append((len(rows), " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = written(shingles._banded(docs).withColumn("bands", F.array().cast("array<bigint>")), "unbanded")
    at = {r["set"]: r.doc_id for r in own.collect()}
    got = {tuple(sorted((at[r.a], at[r.b]))) for r in shingles.set_links(own, docs).collect()}
    sets, prints = five_word_sets(t for _, t in rows), [simhash(t) for _, t in rows]
    alike = {(i, j) for i, j in combinations(range(len(rows)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    near = {(i, j) for i, j in alike if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= 2}
    assert near and near <= got <= alike


def test_dedup_keeps_one_row_of_each_group_where_an_id_has_two_texts(spark):
    texts = [(1, "one two three four five"), (7, "one two three four five"), (7, "six seven eight nine ten"), (8, "six seven eight nine ten"), (9, "a b c d e"), (9, "f g h i j")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, DATA).collect())
    assert kept == [(1, texts[0][1]), (7, texts[2][1]), (9, texts[4][1]), (9, texts[5][1])]


def test_tiles_join_what_all_pairs_join():
    from treespark.llm import shingles

    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 60, 120)
    sets = [np.unique(np.concatenate([base[rng.random(120) > rng.choice([0.02, 0.08, 0.3])], rng.integers(0, 1 << 60, rng.integers(0, 20))])) for _ in range(90)]
    sets += [np.unique(rng.integers(0, 1 << 60, 50)) for _ in range(10)] + [np.array([5], np.int64)] * 2
    names = rng.permutation(len(sets)).astype(np.int64)
    for sides in (np.zeros(len(sets), bool), rng.random(len(sets)) < 0.4):
        got = shingles.forest(names, sets, sides)
        alike = {(i, j): len(np.intersect1d(sets[i], sets[j])) * 9 >= (len(sets[i]) + len(sets[j])) * 4 for i in range(len(sets)) for j in range(i) if not sides.any() or sides[i] != sides[j]}
        at = {int(n): i for i, n in enumerate(names)}
        assert all(alike[max(at[a], at[b]), min(at[a], at[b])] for a, b in got) and len(got) < len(sets)

        def parts(pairs):
            root = list(range(len(sets)))
            for i, j in pairs:
                a, b = root[i], root[j]
                root = [a if x == b else x for x in root]
            return len(set(root))

        assert parts([p for p, linked in alike.items() if linked]) == parts([(at[a], at[b]) for a, b in got]) == len(sets) - len(got)


def test_sets_that_hang_on_a_large_group_lie_in_its_blocks(spark):
    keys = {1: list(range(600))} | {100 + k: [k, *range(1000 + 20 * k, 1020 + 20 * k)] for k in range(30)} | {7: list(range(9000, 9020)), 8: [5, 9999]}
    rows = [(s, 10, key, len(sets)) for key, sets in keys.items() for s in sets]
    homes = {r["set"]: r["block"] for r in shingles._homes(spark.createDataFrame(rows, "set long, size long, key long, n long")).collect()}
    assert set(homes) == {*range(600), *range(1000, 1600), *range(9000, 9020)}
    own = {homes[s] for s in range(9000, 9020)}
    assert len(own) == 1 and {b for s, b in homes.items() if s < 9000}.isdisjoint(own) and len(set(homes.values())) == 4  # of 1,200 and of 20 sets
