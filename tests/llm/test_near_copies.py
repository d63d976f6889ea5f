import numpy as np
import pytest

import gyrolake.llm.near_copies as m
from gyrolake.llm.near_copies import drop_near_copies, gone_of, minima
from gyrolake.llm.simhash import shingle_hashes

SF = "/root/testdata/sf0.01"


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def shingle_set(text):
    return frozenset(shingle_hashes(text, 5).tolist())


def edited(words, every, at, mark):
    return " ".join(f"{mark}{k}" if k % every == at else w for k, w in enumerate(words))


def test_minima_estimate_similarity():
    words = [f"w{i}" for i in range(3000)]
    a, b = (np.unique(shingle_hashes(t, 5)) for t in (" ".join(words), edited(words, 50, 7, "x")))
    exact = similarity(set(a.tolist()), set(b.tolist()))
    assert abs((minima(a) == minima(b)).mean() - exact) < 0.1 and 0.7 < exact < 0.9


def test_a_foreign_first_row_shields_no_copies(spark):
    foreign, copied, other = (" ".join(f"{x}{i}" for i in range(200)) for x in "abc")
    rows = [(0, foreign), *((i, copied) for i in range(1, 9)), (9, copied + " tail"), (10, other), (11, other), (12, foreign)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in drop_near_copies(docs, radius=20).collect()) == [0, 1, 10]


def test_the_exact_similarity_decides(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(words)), (1, edited(words, 35, 7, "x")), (2, edited(words, 100, 7, "y"))]
    a, b, c = (shingle_set(t) for _, t in rows)
    assert 0.7 < similarity(a, b) < 0.8 < similarity(a, c)
    kept = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1]


def test_links_are_settled_in_order(spark):
    chain = [(k, 0, k - 1, 0) for k in range(1, 7)] + [(20, 0, 4, 0), (21, 0, 5, 0), (21, 0, 20, 0)]
    gone = gone_of(spark.createDataFrame(chain, "a1 long, a2 long, b1 long, b2 long"))
    assert sorted(r.k1 for r in gone.collect()) == [1, 3, 5, 20]


@pytest.mark.parametrize("part", [4096, 4])
def test_a_large_group_of_near_copies(spark, monkeypatch, part):
    monkeypatch.setattr(m, "PART", part)
    words = [f"w{i}" for i in range(400)]
    rows = [(k, edited(words, 400, k, "x")) for k in range(60)] + [(100 + k, " ".join(f"v{k}_{i}" for i in range(80))) for k in range(5)]
    kept = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 100, 101, 102, 103, 104]


def test_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    sets = {r.doc_id: shingle_set(r.text) for r in rows}
    kept, gone = [], set()
    for r in rows:
        own = sets[r.doc_id]
        near = [k for k in kept if 0.8 <= len(own) / max(1, len(sets[k])) <= 1.25 or not own]
        (gone.add if any(similarity(own, sets[k]) >= 0.8 for k in near) else kept.append)(r.doc_id)
    left = {r.doc_id for r in drop_near_copies(docs).collect()}
    went = set(sets) - left
    assert gone and len(went & gone) >= 0.95 * len(gone)
    for i in went:
        assert any(similarity(sets[i], sets[k]) >= 0.8 for k in left if k < i)


def greedy(rows):
    """Those that stay, in order of id, by exact similarity."""
    kept = []
    for i, text in sorted(rows):
        own = shingle_set(text)
        if not any(similarity(own, k) >= 0.8 for _, k in kept):
            kept.append((i, own))
    return [i for i, _ in kept]


@pytest.mark.parametrize("part", [4096, 16])
def test_families_of_variants_with_twins(spark, monkeypatch, part):
    """Variants of a form letter are like each other at about 0.61, and each has a twin at about 0.87: only twins go."""
    monkeypatch.setattr(m, "PART", part)
    rng = np.random.default_rng(8)
    letter = [f"w{i}" for i in range(400)]
    rows = []
    for v in range(80):
        own = list(letter)
        for at in rng.choice(400, 20, replace=False):
            own[at] = f"v{v}_{at}"
        twin = list(own)
        for at in rng.choice(400, 6, replace=False):
            twin[at] = f"t{v}_{at}"
        rows += [(2 * v, " ".join(own)), (2 * v + 1, " ".join(twin))]
    stay = greedy(rows)
    assert 75 <= len(stay) <= 85
    got = sorted(r.doc_id for r in drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert len(set(range(160)) - set(stay) - set(got)) >= 0.98 * (160 - len(stay)) and set(stay) <= set(got)


def test_long_chains_of_versions(spark, monkeypatch):
    monkeypatch.setattr(m, "ROUNDS", 2)
    chain = [(k, 0, k - 1, 0) for k in range(1, 60)] + [(100 + k, 0, 99 + k, 0) for k in range(1, 8)] + [(107, 0, 100, 0)]
    want = {k for k in range(1, 60, 2)} | {101, 103, 105, 107}
    for local in (200_000, 10):
        monkeypatch.setattr(m, "LOCAL", local)
        assert {r.k1 for r in gone_of(spark.createDataFrame(chain[:20] + chain[59:] if local == 10 else chain, "a1 long, a2 long, b1 long, b2 long")).collect()} == ({k for k in want if k <= 20 or k > 100} if local == 10 else want)
