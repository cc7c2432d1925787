"""Each operator against brute force on small inputs, with nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from treespark.llm import bpe, chat, counts, langid, lm_scoring, neighbours, packing, quality, rules, simhash
from treespark.llm.tokens import rank_encoding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, length string, word string"
EN = "the cat and the dog went to the market with their friends while it was raining on the hill"
FR = "le chat et le chien sont allés au marché avec leurs amis pendant que la pluie tombait"
TEXTS = [None, "", " \n\t", "one", "one two", "Héllo, wörld! 日本語 don't  stop\n\n x", EN, EN, FR, "a b c d e f g " * 4000, "x" * 50_000, "<|endoftext|> </s> \\ <|im_start|>", "1234 $$$ a.b, c."]


def table(spark, texts=TEXTS, langs=None):
    rows = [(i if i != 3 else None, t, (langs or ["en"] * len(texts))[i], ["h1", None][i % 2], 1, 7, 0.5, "z", "w") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[5:6], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 8)).round(1)
    vectors[10:60] = vectors[10]  # a copied vector makes ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(5, rows[5][1]), (900, None), (901, [0.0] * 8), (902, [1.0, None] + [0.0] * 6), (903, [float("nan")] * 8), (904, [float("inf")] * 8), (None, [1.0] * 8), (920, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(0)).withColumn("v", F.lit(0))
    got = neighbours.search(df, F.col("id") % 20 == 0, k=20, query_block=4, candidate_block=50).toPandas()
    assert 920 not in set(got.query_id) and set(got.vec_id) <= set(range(300))
    for q in range(0, 300, 20):
        score = np.zeros(300)
        for k in range(8):
            score += vectors[q, k] * vectors[:, k]
        score[q] = -np.inf
        order = np.lexsort((np.arange(300), -score))[:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine.vec_id) == list(order) and list(mine.score) == list(score[order]) and list(mine["rank"]) == list(range(1, 21))
    assert neighbours.search(df.limit(0), F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("scales", [(5e-324, 1.0), (1e155, 1.0), (1e155, 1e155), (1e-200, 1e150), (1e-320, 1e-320)])
def test_neighbours_of_very_small_and_very_large_vectors(spark, scales):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(46, 6)).round(1) * np.where(np.arange(46) % 3 == 1, *scales)[:, None]
    vectors[7] = 5e-324  # a subnormal candidate
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors) if v.any()], "vec_id long, embedding array<double>")
    got = neighbours.search(df, F.col("id") < 6, k=5, query_block=4, candidate_block=10).toPandas()
    with np.errstate(over="ignore", invalid="ignore"):
        for q in range(6):
            if not vectors[q].any():
                continue
            score = np.zeros(46)
            for k in range(6):
                score += vectors[q, k] * vectors[:, k]
            score[np.isnan(score)] = -np.inf
            order = [i for i in np.lexsort((np.arange(46), -score)) if i != q and vectors[i].any()][:5]
            mine = got[got.query_id == q].sort_values("rank")
            assert list(mine.score) == list(score[order]) and list(mine.vec_id) == list(order)


def plain_unigram(word, scores, byte_score):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        found = (best[end - 1][0] + n * byte_score, best[end - 1][1] - n)
        for start in range(max(0, end - 16), end):
            own = scores.get(word[start:end])
            if own is not None:
                found = max(found, (best[start][0] + own, best[start][1] - 1))
        best.append(found)
    return -best[-1][1]


def test_token_counts(spark, docs, none):
    scores, byte_score = counts.piece_scores(public_tokenizers.path("piece_bpe_32k.model"))
    assert np.isclose(sum(np.exp(list(scores.values()))), 1) and max(map(len, scores)) <= 16
    more = table(spark, [" ", "  a  b", "a\n\n b\n", "漢字" * 20_000, "▁a ▁ a", "aé漢😀 " * 300, "word" * 40, "wordy words wording"])
    for rows in (counts.count_tokens(docs).collect(), counts.count_tokens(more.withColumn("N_Tokens", F.lit("clash"))).collect()):
        assert "word" in rows[0].asDict()
        for r in rows:
            text, total, n = r.text or "", (r.text or "").count("\n"), 0
            for line in text.split("\n"):
                head, *tail = line.split(" ")
                n += bool(head) + len(tail)
                total += sum(plain_unigram(w, scores, byte_score) for w in ([head] if head else []) + ["▁" + w for w in tail])
            assert (r.n_pretokens, r.n_tokens) == (n, total)
    assert counts.count_tokens(none).count() == 0


def test_token_counts_in_small_blocks_share_prefixes():
    pieces = counts.Pieces({"ab": -1.0, "abc": -1.5, "c": -1.0, "a": -3.0, "b": -3.0}, -9.0)
    words = ["abcab", "abc", "abcac", "b", "", "abz"]
    got = counts.word_counts(counts.segments.pa.array([w.encode() for w in words], counts.segments.pa.large_binary()), pieces)
    assert list(got) == [plain_unigram(w, pieces.scores, -9.0) for w in words] == [pieces.alone(w) for w in words]
    data, offsets = counts.segments.utf8(counts.segments.pa.array(["abc ab\nab", "", "c " * 500]))
    whole = counts.counts_of(data, offsets, pieces)
    assert all((x == y).all() for x, y in zip(whole, counts.counts_of(data, offsets, pieces, block=7)))


def plain_code_length(text, lang_texts):
    """Bits by the definition, from counts of all contexts of order 0 to 3."""
    seen = [Counter() for _ in range(4)]
    for t in lang_texts:
        raw = b"\n\n\n" + t.encode()
        for i in range(3, len(raw)):
            for k in range(4):
                seen[k][raw[i - k : i], raw[i]] += 1
    contexts = [{} for _ in range(4)]
    for k in range(4):
        for (c, b), n in seen[k].items():
            contexts[k].setdefault(c, {})[b] = n
    body, bits = b"\n\n\n" + text.encode(), 0.0
    for i in range(3, len(body)):
        def p(k):
            if k < 0:
                return 1 / 256
            own = contexts[k].get(body[i - k : i])
            if not own:
                return p(k - 1)
            total = sum(own.values()) + len(own)
            return own[body[i]] / total if body[i] in own else len(own) / total * p(k - 1)
        bits -= np.log2(p(3))
    return bits


def test_language_id(spark, none):
    rng = np.random.default_rng(0)
    make = lambda text: " ".join(rng.permutation(text.split()))
    texts = [None, "", "123 !?", *[make(EN) for _ in range(20)], *[make(FR) for _ in range(20)]]
    docs = table(spark, texts, [None, "en", "en", *["en"] * 20, *["fr"] * 20])
    trees = langid.train(docs)
    learned = {x: [r.text for r in docs.where((F.col("lang") == x) & langid.has_letter() & ~langid.held_out()).collect()] for x in ("en", "fr")}
    for text in (EN, FR, "zzz Ω", "the"):
        want = [plain_code_length(text, learned[x]) for x in trees.langs]
        assert np.allclose(trees.code_lengths([text])[0], want, rtol=1e-4)
    rows = langid.predict(docs, trees).toPandas()
    assert list(rows.lang_pred[rows.text.isin(["", "123 !?"]) | rows.text.isna()].unique()) == ["und"]
    known = rows[rows.lang_pred != "und"]
    assert (known.lang == known.lang_pred).mean() > 0.95 and known.score.between(0, 1).all()
    assert langid.train(none) is None and langid.predict(none, None).count() == 0
    assert len(trees.code_lengths(["a" * 3_000_000])) == 1


def test_language_id_of_many_bytes_and_languages():
    rng = np.random.default_rng(4)
    learned = {f"l{k:02d}": ["".join(map(chr, rng.integers(1, 0x250, 200))) for _ in range(3)] for k in range(12)}
    grams = Counter()
    for lang, texts in learned.items():
        for t in texts:
            raw = langid.PAD + t.encode()
            for i in range(3, len(raw)):
                grams[lang, int.from_bytes(raw[i - 3 : i + 1], "big")] += 1
    trees = langid.ContextTrees(pd.DataFrame([(a, b, n) for (a, b), n in grams.items()], columns=["lang", "gram", "n"]))
    for text in (learned["l03"][0][:60], "zzz Ω\u0101\u0102", "the", "\U0001F600"):
        assert np.allclose(trees.code_lengths([text])[0], [plain_code_length(text, learned[x]) for x in trees.langs], rtol=1e-9)


def test_lm_scoring(docs, spark, none):
    target = spark.createDataFrame([(6,), (6,), (None,), (99,)], "doc_id long")
    rows = lm_scoring.score_documents(docs, target).toPandas()
    assert (rows.lm_tokens == [len((t or "").encode().split()) for t in rows.text]).all()
    assert rows.loss_difference.isna().sum() == (rows.lm_tokens == 0).sum()
    by_id = rows.set_index("doc_id").loss_difference
    assert by_id[7] < by_id[8]  # the same words as the target, against another language
    # brute force of the definition, from word classes
    classes = {t: [list(w) for _, w in lm_scoring.tokens([t])] for t in (x or "" for x in rows.text)}
    flat = [[c for part in classes[t or ""] for c in part] for t in rows.text]
    is_target = (rows.doc_id == 6).to_numpy()
    tables = []
    for kind in (True, False):
        words, cells = np.zeros(lm_scoring.WORDS), np.zeros(lm_scoring.WORDS)
        for own, hit in zip(flat, is_target):
            if hit == kind:
                before = 0
                for w in own:
                    words[w] += 1
                    cells[before * lm_scoring.CLASSES + w % lm_scoring.CLASSES] += 1
                    before = w % lm_scoring.CLASSES
        tables.append((words, cells))
    scale = tables[0][0].sum() / tables[1][0].sum()
    models = [lm_scoring.losses(*tables[0], 1.0), lm_scoring.losses(*tables[1], scale)]
    for i in (5, 6, 8):
        sums, before = np.zeros(2), 0
        for w in flat[i]:
            for k, (emit, step) in enumerate(models):
                sums[k] += emit[w] + step[before * lm_scoring.CLASSES + w % lm_scoring.CLASSES]
            before = w % lm_scoring.CLASSES
        assert np.isclose((sums[0] - sums[1]) / len(flat[i]), rows.loss_difference[i], atol=1e-5)
    assert lm_scoring.score_documents(none, target).count() == 0


@pytest.mark.parametrize("size", [None, 2000])
def test_lm_scoring_by_words_equals_counts_of_words_and_bigrams(docs, spark, none, monkeypatch, size):
    if size:  # many chunks and buckets
        monkeypatch.setattr(lm_scoring, "CHUNK", size)
        monkeypatch.setattr(lm_scoring, "BUCKET", size)
    rng, rows = np.random.default_rng(8), [(1, "a b a b c", 1.5), (1, "a b a b c", 2.5), (2, None, 0.0), (3, " \t", 0.0), (None, "a c", 0.0)]
    rows += [(10 + k, " ".join(f"w{x}" for x in rng.zipf(1.3, 60) % 4000), 0.0) for k in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lm_tokens double")
    named = {1, 10, 11, 12, 13}
    got = lm_scoring.score_by_words(table.repartition(3), spark.createDataFrame([(x,) for x in [*named, 999, None]], "doc_id long"))
    assert got.columns == ["doc_id", "text", "lm_tokens", "target_loss", "background_loss", "loss_difference"]
    words = [(t or "").split() for _, t, _ in rows]
    counts = [Counter(), Counter()]
    grams = [Counter([(w,) for w in ws] + list(zip([None, *ws], ws)) + [(None,)] * bool(ws)) for ws in words]
    kinds = [int(i in named) for i, _, _ in rows]
    for kind, own in zip(kinds, grams):
        counts[kind] += own
    mass = [sum(n for g, n in c.items() if len(g) == 1 and g[0]) for c in counts]
    n_words = len({w for ws in words for w in ws})
    want = []
    for (doc_id, text, _), ws, kind, own in zip(rows, words, kinds, grams):
        loss = [0.0, 0.0]
        for k, scale in ((0, mass[1] / mass[0]), (1, 1.0)):
            c = lambda g: scale * (counts[k][g] - (own[g] if k == kind else 0))  # noqa: B023, E731
            total = scale * (mass[k] - (len(ws) if k == kind else 0))
            for v, w in zip([None, *ws], ws):
                alone = (c((w,)) + lm_scoring.FLOOR) / (total + lm_scoring.FLOOR * n_words)
                loss[k] -= np.log((c((v, w)) + lm_scoring.PRIOR * alone) / (c((v,)) + lm_scoring.PRIOR))
        want.append((doc_id, text, len(ws), *([round((x / len(ws)), 8) for x in (loss[1], loss[0], loss[1] - loss[0])] if ws else [None] * 3)))
    key = lambda r: str(r)
    found = [(*r[:3], *[x if x is None else round(x, 8) for x in r[3:]]) for r in got.collect()]
    for a, b in zip(sorted(found, key=key), sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and np.allclose([x or 0 for x in a[3:]], [x or 0 for x in b[3:]], atol=1e-7) and (a[3] is None) == (b[3] is None)
    assert lm_scoring.score_by_words(none, table).count() == 0
    for all_or_none in (table, table.limit(0)):
        assert {r.loss_difference for r in lm_scoring.score_by_words(table.where("doc_id is not null"), all_or_none).collect()} <= {0.0, None}


def test_chat_events(spark):
    events = [("c", 1, "message", 1, "user", "hi"), ("c", 2, "message", 2, "assistant", ""), ("c", 3, "delta", 2, None, "wro"), ("c", 5, "delta", 2, None, "right </s> <|im_end|> \\ \\<|"), ("c", 4, "regenerate", 2, None, None), ("c", 6, "edit", 1, None, "hello"), ("c", 6, "edit", 1, None, "hello"), (None, 1, "delta", 1, "assistant", "x")]
    df = spark.createDataFrame(events, "conv_id string, seq long, kind string, message long, role string, text string")
    out = chat.read_back(chat.render(chat.fold_events(df)))
    got = {r.conv_id: ([tuple(t) for t in r.turns], r.loss_texts) for r in out.collect()}
    said = "right </s> <|im_end|> \\ \\<|"
    assert got == {"c": ([("user", "hello"), ("assistant", said)], [said]), None: ([("assistant", "x")], ["x"])}
    assert all(r.formatted.count("<|im_end|>") == len(r.turns) for r in out.collect())


def test_chat_table(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "\\|<|im_start|>é"), (1, 0, "user", "\\|<|im_start|>é"), (2, 0, None, "[INST] <<SYS>>"), (2, None, "assistant", "z\n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit(1))
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got == {1: [("user", "\\|<|im_start|>é")] * 2 + [("assistant", "")], 2: [("assistant", "z\n"), ("", "[INST] <<SYS>>")]}
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_packing(docs, none):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs, capacity=64, with_ids=True).toPandas()
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    for doc_id, text in texts.items():
        want = exact.encode(text, add_special_tokens=False).ids + [2]
        own = got[got.doc_id == doc_id].sort_values("piece").iloc[: None if doc_id != 5 else len(got[got.doc_id == 5]) // 2 * 2]
        if doc_id == 5:
            own = own.drop_duplicates("piece")
        assert [i for ids in own.ids for i in ids] == want
        assert list(own.start) == list(np.cumsum([0, *own.length])[:-1])
        assert (own.length.iloc[1:] == 64).all()
        assert all(zlib.crc32(np.asarray(ids, "<u4").tobytes()) == c for ids, c in zip(own.ids, own.ids_crc32))
    for _, group in got.sort_values("offset").groupby("sequence_id"):
        assert list(group.offset) == list(np.cumsum([0, *group.length])[:-1]) and group.length.sum() <= 64
    assert len(got) == len(got[["sequence_id", "offset"]].drop_duplicates())
    assert packing.pack_documents(none).count() == 0


def test_genetic_packing_is_valid_and_close_to_the_bound(spark):
    rng = np.random.default_rng(3)
    counts_ = {int(a): int(n) for a, n in zip(*np.unique(rng.integers(1, 101, 3000), return_counts=True))}
    bins = packing.pack_histogram(spark, counts_, capacity=100, islands=2, generations=4)
    used = Counter()
    for runs, n in bins:
        assert sum(a * k for a, k in runs) <= 100
        for a, k in runs:
            used[a] += n * k
    assert used == Counter(counts_)
    bound = -(-sum(a * n for a, n in counts_.items()) // 100)
    assert sum(n for _, n in bins) <= 1.01 * bound + 1


def test_genetic_packing_beats_best_fit_decreasing():
    rng = random.Random(5)
    counts_ = Counter(rng.randint(20, 60) for _ in range(3000))
    plain = sum(n for _, n in packing.best_fit(counts_, 100))
    bins, used = packing.evolve(counts_, 100, [], seed=1, population=5, generations=10), Counter()
    for runs, n in bins:
        assert sum(a * k for a, k in runs) <= 100
        for a, k in runs:
            used[a] += n * k
    assert used == counts_ and sum(n for _, n in bins) < plain


def test_quality(spark, none):
    good, bad = [EN] * 30, ["buy### now&&& the*** best%%% deal$$$ today###"] * 30
    rows = [(i, t, None if i % 7 == 0 else "en", "h" + str(i % 3), 1, 7, 0.5, "z", "w") for i, t in enumerate(good + bad)] + [(None, None, None, None, 1, 7, 0.5, "z", "w"), (500, "", "en", "new", 1, 7, 0.5, "z", "w")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(60) if i % 2] + [(1, None), (None, 1), (999, 0)], "doc_id long, quality int")
    got = quality.score_quality(docs, labels).toPandas()
    assert len(got) == len(rows)
    known = got[got.doc_id < 60]
    assert (known.quality_keep == (known.doc_id < 30)).all()
    assert got.quality_score.notna().all()
    assert quality.score_quality(docs, labels.limit(0)).where("quality_keep").count() == len(rows)
    assert quality.score_quality(none, labels).count() == 0


def test_quality_priors_against_plain_sums(spark):
    """Priors and scores from the returned evidence: sums of the other documents' posteriors by path, host and all."""
    rng = np.random.default_rng(6)
    make = lambda i: " ".join(rng.permutation(EN.split())) + (" ### $$$ |" * int(rng.integers(0, 6)) if i % 3 else "")
    rows = [(i, make(i), ["en", "fr", None][i % 3 if i % 5 else 0], f"h{i % 4}") for i in range(200)] + [(500, "word " * 200_000, "en", "h0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 200, 2)] + [(0, 0)], "doc_id long, quality int")
    got = quality.score_quality(docs, labels).toPandas()
    share = np.mean([i % 3 == 0 for i in range(0, 200, 2)])  # 0 has labels 1 and 0: their mean counts as good
    own = 1 / (1 + np.exp(-(got.evidence + np.log(share / (1 - share)))))
    keys = [got.source, got.lang.fillna("-")]
    n, k = own.groupby(keys).transform("count"), own.groupby(keys).transform("sum")
    host_n, host_k = own.groupby(got.source).transform("count"), own.groupby(got.source).transform("sum")
    mean = own.mean()

    def strength(n, rate):
        between = max((n * (rate - mean) ** 2).sum() / n.sum() - mean * (1 - mean) * len(n) / n.sum(), 1e-4)
        return min(1000.0, max(1.0, mean * (1 - mean) / between - 1))

    hosts = own.groupby(got.source).agg(["count", "mean"])
    s_host = strength(hosts["count"], hosts["mean"])
    host_prior = (host_k + s_host * mean) / (host_n + s_host)
    paths = pd.DataFrame({"n": n, "rate": k / n - host_k / host_n + mean, "key": keys[0] + "/" + keys[1]}).drop_duplicates("key")
    s_path = strength(paths.n, paths.rate)
    prior = ((k - own).clip(lower=0) + s_path * host_prior) / (n - 1 + s_path)
    prior = prior.clip(1e-3, 1 - 1e-3)
    assert np.allclose(got.path_prior, prior)
    assert np.allclose(got.quality_score, 1 / (1 + np.exp(-(got.evidence + np.log(prior / (1 - prior))))))


def plain_simhash(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def test_simhash_fingerprints(docs):
    got = simhash.simhash_components(docs).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    for r in got:
        if r.doc_id is not None:
            assert r.fingerprint == f"{plain_simhash(texts[r.doc_id]):016x}"
    assert {r.component_id for r in got if r.doc_id in (0, 1, 2)} == {0}
    assert {r.component_id for r in got if r.doc_id in (6, 7)} == {6}
    assert len(got) == docs.count()


def test_simhash_links_and_components(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(-(2**63), 2**63, 12)]
    fps = set(base) | {0, -1}
    for b in base:
        x = b
        for _ in range(12):  # walks of one to three flips: chains of links, and near misses
            for bit in rng.choice(64, rng.integers(1, 4), replace=False):
                x ^= (1 << int(bit)) if bit < 63 else -(1 << 63)
            fps.add(x)
    fps = sorted(fps)
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    want = {(a, b) for a, b in itertools.combinations(fps, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    assert got == want
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(list(want), "a long, b long")).collect()}
    group = {x: {x} for pair in want for x in pair}
    for a, b in want:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    assert roots == {x: min(g) for x, g in group.items()}


def test_simhash_empty(none):
    assert simhash.simhash_components(none).count() == 0


def test_byte_bpe(docs, none):
    exact = rank_encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    got = bpe.encode_documents(docs, with_ids=True).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in got:
        ids = exact.encode_ordinary(texts[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == texts[r.doc_id].encode()
        assert r.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.encode_documents(none).count() == 0


def test_byte_bpe_of_long_words(spark):
    exact = rank_encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rng = np.random.default_rng(8)
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    texts = ["x" * 200_000, draw("abcdefghijklmnopqrstuvwxyz", 200_000), "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 200_000))), "=" * 5000, "é" * 900]
    texts += [draw("etaoin", int(n)) for n in rng.integers(200, 1200, 60)] + [draw("ab", int(n)) for n in rng.integers(250, 700, 20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode_documents(df, with_ids=True).collect():
        assert list(r.ids) == exact.encode_ordinary(texts[r.doc_id])


def test_pattern_cuts_keep_the_matches_of_whole_texts():
    from treespark.llm import segments

    rng, find = np.random.default_rng(5), regex.compile(public_tokenizers.PATTERN).findall
    letters = list(" \n\t'.,a sBé\u00a0\u3000\u2003\u0085\x1c1#漢\u2019-_ \n")
    for _ in range(20_000):
        texts = ["".join(rng.choice(letters, n)) for n in rng.integers(0, 14, 3)]
        data, offsets = segments.utf8(segments.pa.array(texts))
        cut = segments.as_binary(data, segments.pattern_cuts(data, offsets)).to_pylist()
        assert [x for part in cut for x in find(part.decode())] == [x for t in texts for x in find(t)]


def test_memo_encoder_splits_as_the_tokenizer():
    from treespark.llm.tokens import MemoEncoder

    encode = MemoEncoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for text in [t for t in TEXTS if t and len(t) < 40_000] + ["it's a dog's, don't", "a.  b", "x's.", "é,", "a b", "日本。", "a\r\nb", "a\n b", " lead", "trail ", "1. 2,", "á, b."]:
        assert list(np.frombuffer(encode(text), "<u4")) == encode.whole.encode(text, add_special_tokens=False).ids
    assert isinstance(encode.ranks, tiktoken.Encoding)


def plain_rules(text):
    words = text.encode().split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rules(docs, none):
    rows = rules.apply_rules(docs).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_rules(r.text or "")
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert rules.apply_rules(none).count() == 0


def test_rules_remove_lines_first(spark):
    body = "\n".join(" ".join(f"word{i}x{j}" for j in range(12)) + "." for i in range(6))
    nav = "Home | News | Contact | About\nAll rights reserved."
    rows = {r.doc_id: r for r in rules.apply_rules(table(spark, [body, body + "\n" + nav, "\n".join([nav.replace("o", "o" + c) for c in "abcdefghijklmnop"]) + "\n" + body[:400]])).collect()}
    assert rows[0].kept and rows[0].lost_share == 0 and rows[1].kept and rows[1].cleaned_text == body
    assert not rows[2].kept and not rows[2].base_failed
