"""Clustering, sharding and lexical search against brute force, with nulls, ties, repeats, long texts, empty tables and clashing columns."""

import hashlib
import itertools
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from treespark.llm import clustering, lexical, sharding

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_lloyd(rows, k, rounds, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), i, v) for i, v in kept if i is not None)[:k]
    points = [v for _, _, v in first]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, p)), c) for c, p in enumerate(points))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        points = [[sum(col) // len(col) for col in zip(*mine)] if (mine := [v for (_, v), o in zip(kept, own) if o == c]) else p for c, p in enumerate(points)]
    return [(i, *reversed(nearest(v))) for i, v in kept], points


def test_clusters_equal_plain_rounds(spark):
    rng = np.random.default_rng(5)
    vectors = np.concatenate([rng.normal(size=(150, 4)), rng.normal(size=(40, 4)) / 50, np.tile(rng.normal(size=(1, 4)), (80, 1))]).round(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(3, [0.0] * 4), (3, [1.0] * 4), (None, [0.5] * 4), (2**60 + 1, [0.25] * 4)]
    rows += [rows[0]]
    bad = [(900, None), (901, [1.0] * 3), (902, [1.0, None, 0.0, 0.0]), (903, [float("nan")] * 4), (904, [float("-inf")] * 4), (905, [1e9] * 4)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("cluster", F.lit("clash"))
    got = clustering.cluster(df, clustering.seeded_hash(1), k=7, rounds=3, dim=4, scale=8).collect()
    want, points = plain_lloyd(rows, 7, 3, 8)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=key) == sorted(want, key=key)
    assert all(r.centroid == points[r.cluster] and r.inertia == sum(w[2] for w in want) for r in got)
    assert all(r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster) for r in got)
    assert clustering.cluster(df.limit(0), clustering.seeded_hash(1)).count() == 0
    assert clustering.cluster(df.where("vec_id = 5"), clustering.seeded_hash(1), dim=4).collect()[0].distance == 0


def test_orchard_measures_less_and_breaks_ties_by_number():
    rng = np.random.default_rng(6)
    middles = rng.integers(-4000, 4000, (40, 3))
    rows = (middles[rng.integers(0, 40, 3000)] + rng.integers(-60, 60, (3000, 3))).astype(np.int64)
    points = np.concatenate([middles, middles[:5]]).astype(np.int64)  # five centroids lie on others
    own, near, measured = clustering.Centroids(points).nearest(rows)
    every = ((rows[:, None, :] - points[None]) ** 2).sum(axis=2)
    assert (own == every.argmin(axis=1)).all() and (near == every.min(axis=1)).all()
    assert measured < every.size / 2
    grid = np.array(list(itertools.product(range(-2, 3), repeat=2)), np.int64)  # many exact ties
    own, near, _ = clustering.Centroids(grid[::3] * 2).nearest(grid)
    assert (own == ((grid[:, None] - grid[None, ::3] * 2) ** 2).sum(axis=2).argmin(axis=1)).all()


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 2), (1, 4)])
def test_the_curve_visits_every_cell_by_single_steps(spark, n, bits):
    cells = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=n)), ", ".join(f"c{i} int" for i in range(n)))
    walk = cells.withColumn("at", sharding.curve_index([F.col(f"c{i}") for i in range(n)], bits)).orderBy("at").collect()
    assert [r["at"] for r in walk] == list(range(1 << bits * n))
    assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in itertools.pairwise(walk))


DOCS = "doc_id long, text string, source string, n_chars long, shard string, place long, curve int"


def test_shards_hold_every_row_once_and_prune(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 7), ["hot", "hot", "a", "b", None][i % 5], i * 37 % 501, "x", 5, 6) for i in range(500)]
    rows += [(None, None, None, None, None, None, None), rows[7], rows[7], (1000, "é" * 300_000, "b", 3, "x", 1, 1)]
    df = spark.createDataFrame(rows, DOCS)
    root = sharding.write_shards(df, ["source", "n_chars", "doc_id"], ["doc_id"], shards=6, root=f"file://{tmp_path}/out")
    got = sharding.read_shards(spark, root)
    assert set(got.columns) == {*df.columns, "_shard", "slot"}
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got.select(*df.columns).collect())) == sorted(map(key, df.collect()))
    places = got.select("_shard", "slot", "source", "n_chars").toPandas()
    counts = places.groupby("_shard")["slot"]
    assert sorted(counts.count()) == [84] * 6 and all(sorted(s) == list(range(len(s))) for _, s in counts)
    one = sharding.read_shards(spark, root, shard=2)
    assert one.count() == 84 and {r._shard for r in one.collect()} == {2}
    near = sharding.read_shards(spark, root, within={"n_chars": (100, 120), "source": ("a", "a")})
    assert near.count() == df.where("n_chars between 100 and 120 and source = 'a'").count()
    runs = spark.read.parquet(f"{root}/runs")
    met = runs.where("max_n_chars >= 100 and min_n_chars <= 120 and max_source >= 'a' and min_source <= 'a'").count()
    assert met < runs.count() / 2
    none = sharding.write_shards(df.limit(0), ["source", "n_chars"], ["doc_id"], shards=6)
    assert sharding.read_shards(spark, none).count() == 0
    few = sharding.write_shards(df.limit(2), ["source"], ["doc_id"], shards=6)
    assert sorted(r._shard for r in sharding.read_shards(spark, few).collect()) == [0, 1]


def plain_search(docs, items, k):
    fold = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    words = lambda t: TERM.findall((t or "").translate(fold))
    own = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    held = Counter(t for _, c in own for t in c)
    out = []
    for item in {i for i, _ in items if i is not None}:
        terms = {t for i, x in items if i == item for t in words(x)}
        found = []
        for doc, c in own:
            m = 10 + (90 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def test_search_equals_brute_force_over_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "日本", "A1", "a1"]
    weight = 1 / np.arange(1, 65)
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=weight / weight.sum()))
    docs = [(i * 3 % 1009 + 2**55, text(int(rng.integers(1, 40)))) for i in range(900)]
    docs += [(5000 + i, "w1 w2 w3 w40 copy") for i in range(300)] + [(None, "w3 w40"), (None, None), (7, ""), (8, "-- .,;"), (9, None), (10, "W1-w2_w3.W40"), docs[0], docs[0]]
    docs += [(11, "w5 " * 20_000 + "w59"), (12, "x" * 50_000)]
    items = [(1, "w40 w3 copy"), (2, text(12)), (2, "w59"), (3, None), (4, "nothing here"), (None, "w1"), (5, "日本 ünï A1 w1 w1"), (6, text(200)), (7, "copy")]
    monkeypatch.setattr(lexical, "CELL", 100)
    monkeypatch.setattr(lexical, "BLOCK", 8)
    monkeypatch.setattr(lexical, "PART", 1000)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("terms", F.lit(1)).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0))
    want = plain_search(docs, items, 10)
    for most in (512, 3):
        got = lexical.search(df, asked, k=10, max_items=most)
        assert sorted(map(tuple, got.collect())) == want
    assert lexical.search(df.limit(0), asked).count() == 0 and lexical.search(df, asked.limit(0)).count() == 0


def test_blocks_are_skipped_by_their_bounds():
    rng = np.random.default_rng(3)
    weights = lexical.Weights(2000, 20_000, np.array([1500, 1500, 60, 60, 60, 60]))
    rows = []
    for i in range(1200):
        topic = 2 + i % 4 if i % 20 == 0 else None
        terms = sorted({0, 1} | ({topic} if topic else set()))
        rows.append((i, True, 10, terms, [int(rng.integers(1, 3)) for _ in terms]))
    batch = pd.DataFrame(rows, columns=["doc_id", "named", "n", "terms", "tfs"])
    asked = [np.array([0, 1, t]) for t in range(2, 6)]
    by_term = [[i for i, own in enumerate(asked) if t in own] for t in range(6)]
    cell = lexical.Cell(lexical.build_cell(batch, weights, asked, by_term), 6)
    for terms in asked:
        found, scores, opened = cell.best(terms, 10, 0, False)
        blocks, _ = cell.bounds(terms)
        assert opened < len(blocks) and len(found) == 10
        every = [sum(int(weights.impacts(weights.norms(np.array([10])), np.array([t]), np.array([c]))[0]) for t, c in zip(r[3], r[4]) if t in terms) for r in rows]
        assert sorted(scores.tolist(), reverse=True) == sorted(every, reverse=True)[:10]


def test_parts_cut_between_terms():
    text = "ab Cd-éf 日本語 ".encode() * 50 + b"x" * 99
    assert b"".join(lexical.parts(text, 7)) == text
    assert lexical.terms_of(text) == Counter(w.encode() for w in TERM.findall(text.decode().lower()))


def test_copies_of_a_vector_are_one_class(spark):
    from treespark.llm import neighbours

    rng = np.random.default_rng(8)
    copied, near = rng.normal(size=8).round(2), rng.normal(size=(60, 8)).round(2)
    rows = [(i, [float(x) for x in copied]) for i in range(20_000)] + [(20_000 + i, [float(x) for x in v]) for i, v in enumerate(near)]
    rows += [(7, [float(x) for x in near[0]]), (40, [float(x) for x in -copied])]  # ids with two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    found = neighbours.classes(neighbours.usable(df), 21)
    assert found.count() == 62 and found.agg(F.max(F.size("ids"))).first()[0] == 21
    got = neighbours.search(df, F.col("id") % 1000 == 0, k=20).toPandas()
    score = float(sum(float(x) * float(x) for x in copied))
    for q in range(0, 20_000, 1000):
        mine = got[got.query_id == q].sort_values("rank")
        ahead = sorted((-float(sum(a * b for a, b in zip(copied, v))), 20_000 + i) for i, v in enumerate(near) if float(sum(a * b for a, b in zip(copied, v))) > score)
        want = [i for _, i in ahead] + [i for i in range(40) if i != q]
        assert len(mine) == 20 and list(mine.vec_id)[len(ahead):] == want[len(ahead):20]
    assert len(got[got.query_id == 20_000]) == 20
