import math
import re

import numpy as np

from gyrolake.llm.weak_quality import classify, posteriors, shape, votes

SF = "/root/testdata/sf0.01"


def test_em_recovers_labeller_accuracies():
    import random

    rng = random.Random(1)
    counts = {}
    for _ in range(20_000):
        y = rng.random() < 0.7
        v = [0 if rng.random() < 0.2 else (1 if y else -1) * (1 if rng.random() < a else -1) for a in (0.9, 0.8, 0.75, 0.6)]
        k = ",".join(map(str, v))
        counts[k] = counts.get(k, 0) + 1
    p, accuracy = posteriors(counts)
    for (on_good, on_bad), a in zip(accuracy, (0.9, 0.8, 0.75, 0.6), strict=True):
        assert abs(on_good - a) < 0.05 and abs(on_bad - a) < 0.08
    assert p["1,1,1,1"] > 0.95 and p["-1,-1,-1,-1"] < 0.1
    assert posteriors({}) == ({}, [])


def test_votes_and_shapes():
    assert votes(None) == votes(" \n") == [-1, 0, 0, 0, 0, 0, 0]
    assert votes("A$$$ b### " * 40)[1] == -1
    assert shape(b"Don't,") == b"Aa'a," and shape(b"x12$$$$") == b"a9$$"


def test_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = {r.doc_id: r.good for r in classify(docs).collect()}
    assert len(got) == docs.count()
    good = [got[i] for i, q in labels.items() if q == 1]
    bad = [not got[i] for i, q in labels.items() if q == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) > 0.7


def test_nulls_ties_and_empty_tables(spark):
    text = "The word and the other of it. " * 30
    rows = [(1, None, 1), (None, text, 2), (2, text, 3), (2, text, 3), (3, "", 4), (4, "X$$$ Y### | " * 400, 5)]
    rows += [(i, f"A{i}$$$ B### | " * 300 if i % 3 == 0 else f"The word{i} and the rest of it. " * 30, 6) for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = [(r.doc_id, r.n_words, r.good) for r in classify(docs, train_rows=50).collect() if (r.doc_id or 0) < 100]
    assert sorted(got, key=str) == sorted([(1, 0, False), (None, 210, True), (2, 210, True), (2, 210, True), (3, 0, False), (4, 1200, False)], key=str)
    assert classify(docs.filter("false")).count() == 0


def test_function_words_are_counted_over_all_words():
    assert votes("Word the " * 400)[5] == votes("the Word " * 400)[5] == 1
    assert votes("the Word other thing " * 100 + "noun " * 8000)[5] == -1


def brute_scores(rows):
    """Labellers, EM, training and scores over all rows, one document at a time."""
    import xxhash

    from gyrolake.llm import weak_quality as m

    def vote(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if not w:
            return (-1, 0, 0, 0, 0, 0, 0)
        n, size = len(w), lambda x: len(x.encode())
        lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
        grade = lambda x, good, bad: 1 if x <= good else -1 if x >= bad else 0
        stop = sum(x.lower() in {s.decode() for s in m.STOP} for x in w) / n
        longer = (grade(1 - len(set(w)) / n, 0.6, 0.8), grade(-stop, -0.1, -0.02), grade(n / (1 + len(re.findall(r"[.!?][ \t\n\r\f\v]", text))), 30, 80)) if n >= 50 else (0, 0, 0)
        return (
            -1 if n < 20 else 1 if n >= 60 else 0,
            grade(sum(c in "#*$%&|<>" for c in text) / n, 0.02, 0.2),
            grade(sum("A" <= c <= "Z" for c in text) / sum(map(size, w)), 0.06, 0.3),
            grade(1 - len(set(lines)) / len(lines), 0, 0.3) if len(lines) > 3 else 0,
            *longer,
        )

    votes_ = [vote(t) for _, t in rows]
    p = [1 / (1 + math.exp(-4 * sum(v) / max(1, sum(x != 0 for x in v)))) for v in votes_]
    for _ in range(m.EM_ROUNDS):
        prior = (1 + sum(p)) / (2 + len(p))
        chance = {}
        for good in (0, 1):
            for j in range(7):
                seen = {x: 1 + sum((q if good else 1 - q) for q, v in zip(p, votes_, strict=True) if v[j] == x) for x in (-1, 0, 1)}
                chance |= {(good, j, x): n / sum(seen.values()) for x, n in seen.items()}
        like = lambda v, good: math.prod(chance[good, j, x] for j, x in enumerate(v))  # noqa: B023, E731
        p = [prior * like(v, 1) / (prior * like(v, 1) + (1 - prior) * like(v, 0)) for v in votes_]
    bag = lambda t: [b for w in (t or "").encode().split() for b in (xxhash.xxh32_intdigest(w.lower(), 1) % m.BUCKETS, xxhash.xxh32_intdigest(m.shape(w), 2) % m.BUCKETS)]
    sample = [(bag(t), q) for (_, t), q, v in zip(rows, p, votes_, strict=True) if v != (-1, 0, 0, 0, 0, 0, 0)]
    w, first, second = (np.zeros(m.BUCKETS + 1) for _ in range(3))
    for step in range(1, m.ROUNDS + 1):
        g = np.zeros(m.BUCKETS + 1)
        for b, q in sample:
            error = 1 / (1 + math.exp(-(w[b].sum() / (len(b) / 2) + w[-1]))) - q
            np.add.at(g, b, error / (len(b) / 2))
            g[-1] += error
        g = g / len(sample) + 1e-5 * w
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w = w - 0.5 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    return {i: 1 / (1 + math.exp(-(w[bag(t)].sum() / (len(bag(t)) / 2) + w[-1]))) if bag(t) else 0.0 for i, t in rows}


def test_scores_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 150")
    want = brute_scores([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: r.score for r in classify(docs).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_partitions_and_samples(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    few, many = ({r.doc_id: r.score for r in classify(docs.repartition(n), train_rows=300).collect()} for n in (4, 60))
    assert few.keys() == many.keys() and max(abs(few[i] - many[i]) for i in few) < 1e-6


def test_long_texts_and_rows_without_ids(spark):
    long = "the word of the day is here. " * 20_000
    docs = spark.createDataFrame([(None, long), (None, long), (None, None), (1, "")], "doc_id long, text string")
    got = [(r.doc_id, r.n_words) for r in classify(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, 140_000), (None, 140_000), (None, 0), (1, 0)], key=str)
    assert classify(docs.filter("false")).count() == 0
