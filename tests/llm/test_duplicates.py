import hashlib
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from lineside.llm import components, fm_index, minhash, substring, vectors
from tests.llm.conftest import prose


class Sets(dict):
    """Union-find for the brute-force versions."""

    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def union(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_components(spark):
    rng, sets = random.Random(2), Sets()
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)] + [(7, 7)]
    for a, b in links:
        sets.union(a, b)
    got = {r.v: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: sets.find(v) for a, b in links if a != b for v in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def expected_components(rows, percent=85):
    sets, of = Sets(), [(d, shingles(t)) for d, t in rows]
    for i, (a, x) in enumerate(of):
        for b, y in of[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                sets.union(a, b)
    return {d: sets.find(d) for d, _ in rows if d is not None}


def test_near_duplicates(documents, odd_rows):
    rng, rows = random.Random(3), list(odd_rows)
    for g in range(12):
        words = prose(rng, 150).split()
        for c in range(6):
            changed = list(words)
            for _ in range(rng.randint(0, 3)):
                changed[rng.randrange(150)] = "new"
            rows.append((100 + 10 * g + c, " ".join(changed)))
    got = minhash.near_duplicates(documents(rows)).collect()
    want = expected_components(rows)
    assert len(got) == len(rows)
    assert all(r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    sizes = Counter((d, len(shingles(t))) for d, t in rows)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == sizes
    assert minhash.near_duplicates(documents([])).count() == 0


def test_crowded_region_stays_linear(documents):
    rng = random.Random(4)
    words = prose(rng, 200).split()
    rows = [(i, " ".join("edit" + str(i) if j == i % 200 else w for j, w in enumerate(words))) for i in range(600)]
    assert {r.component_id for r in minhash.near_duplicates(documents(rows)).collect()} == {0}
    made = minhash.signatures(documents(rows).select("doc_id", "text", F.lit(1).cast("long").alias("k")))
    pairs = minhash.forest_candidates(made.select(F.col("h1").alias("cid"), "sig"))
    assert pairs.count() < 600 * minhash.TREES * (minhash.FULL_RUN + 1)


def test_pipeline_stage_takes_eighty_percent(spark, documents):
    rng, rows = random.Random(13), []
    for g in range(40):
        words = [f"g{g}w{rng.randrange(10**6)}" for _ in range(200)]
        changed = [f"x{j}" if j in (20 + g, 70 + g, 120 + g, 150 + g) else w for j, w in enumerate(words)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(changed))]
    want = {2 * g for g in range(40)}
    assert all(80 <= 100 * len(shingles(x) & shingles(y)) / len(shingles(x) | shingles(y)) < 85 for (_, x), (_, y) in zip(rows[::2], rows[1::2]))
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, documents(rows), "").collect()} == want


def test_star_of_copies_is_one_component(documents, monkeypatch):
    rng = random.Random(12)
    base = [f"b{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 1001):
        places = rng.sample(range(10, 190), 3)
        rows.append((i, " ".join(f"c{i}x{j}" if j in places else w for j, w in enumerate(base))))
    one = shingles(rows[0][1])
    linked = {0} | {i for i, t in rows[1:] if 100 * len(one & shingles(t)) >= 85 * len(one | shingles(t))}
    monkeypatch.setattr(minhash, "BLOCK", 100, raising=False)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(rows)).collect()}
    assert len(linked) > 900 and sum(got[i] != 0 for i in linked) <= 2


def test_fm_index_counts():
    rng = np.random.default_rng(1)
    pieces = [rng.integers(0, 4, rng.integers(1, 30)).astype(np.uint64) for _ in range(60)]
    index = fm_index.FmIndex(pieces)
    for n in (1, 2, 3, 5):
        for p in pieces[:20]:
            if len(p) >= n:
                want = sum((q[i:i + n] == p[:n]).all() for q in pieces for i in range(len(q) - n + 1))
                low, high = np.array([0]), np.array([index.size])
                for c in index.codes(p[:n])[::-1]:
                    low, high = index.extend(np.array([c]), low, high)
                assert high[0] - low[0] == want


def test_fm_index_repeated_windows():
    rng = np.random.default_rng(2)
    pieces = [rng.integers(0, 3, rng.integers(3, 40)).astype(np.uint64) for _ in range(40)]
    seen = Counter(tuple(p[i:i + 5]) for p in pieces for i in range(len(p) - 4))
    masks = fm_index.FmIndex(pieces).repeated(pieces, 5)
    for p, mask in zip(pieces, masks.tolist()):
        assert mask == sum((seen[tuple(p[i:i + 5])] > 1) << i for i in range(len(p) - 4))


def expected_removal(rows):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i:i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for (doc, _), w in zip(rows, words):
        cut = {j for i in range(len(w) - 34) if seen[tuple(w[i:i + 35])] > 1 for j in range(i, i + 35)}
        out.append((str(doc), len(w), len(cut), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in cut)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [1, 500])
def test_remove_repeats(documents, odd_rows, monkeypatch, hot):
    rng = random.Random(7)
    passage = prose(rng, 70)
    rows = odd_rows + [(200 + i, prose(rng, 40) + " " + passage[rng.randint(0, 60):] + " " + prose(rng, 30)) for i in range(40)]
    rows += [(300, "aa " * 500), (301, " ".join(passage.split()[:35])), (302, " ".join(passage.split()[:34])), (303, "bb cc " * 60)]
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "SHARD_WORDS", 200)
    got = substring.remove_repeats(documents(rows)).withColumn("s", F.sha2(F.encode("kept_text", "UTF-8"), 256)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.s) for r in got) == expected_removal(rows)


def test_remove_repeats_from_nothing(documents):
    assert substring.remove_repeats(documents([])).count() == 0


def test_near_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    vecs = [(i, (centres[i % 30] + rng.normal(size=16) * rng.choice([0, 0.1, 0.25, 3.0])).astype(np.float32).tolist(), i % 2) for i in range(500)]
    vecs += [(1000 + i, vecs[0][1], 0) for i in range(60)] + [(1000, vecs[0][1], 0), (2000, None, 0), (2001, [0.0] * 16, 0), (2002, [None] + [1.0] * 15, 0),
             (2003, [float("nan")] * 16, 0), (2004, [float("inf")] * 16, 1), (2005, vecs[0][1], None), (None, vecs[0][1], 0), (2006, [], 0), (2007, vecs[1][1][:8], 1)]
    monkeypatch.setattr(vectors, "SHARD", 60)
    frame = spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit("x")).withColumn("v", F.lit("y"))
    got = vectors.near_vectors(frame).collect()
    good = [(i, np.array(v, float), label) for i, v, label in vecs if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    sets, links = Sets(), Counter()
    for x in range(len(good)):
        for y in range(x):
            (a, u, p), (b, w, q) = good[x], good[y]
            if p == q and len(u) == len(w) and u @ w / (np.linalg.norm(u) * np.linalg.norm(w)) >= 0.93:
                sets.union(a, b)
                links[a, x] += 1
                links[b, y] += 1
    want = Counter((a, links[a, x], sets.find(a)) for x, (a, _, _) in enumerate(good))
    for i, v, label in vecs:
        if i is not None and not any(i == g[0] for g in good):
            want[i, 0, i] += 1
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None) == want
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]
    assert vectors.near_vectors(frame.limit(0)).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(6)
    unit = rng.normal(size=(1500, 24)) + np.repeat(rng.normal(size=(50, 24)) * 3, 30, axis=0)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    graph = vectors.Graph(unit)
    truth = graph.unit @ graph.unit.T >= 0.9
    found = graph.links(graph.unit, 0.9, vectors.FIRST_BEAM)
    assert (found & truth).sum() >= 0.99 * truth.sum()
