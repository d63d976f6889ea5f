import re
from collections import Counter

import pytest

import gyrolake.llm.repeats as m
from gyrolake.llm.repeats import remove_repeats


def brute(texts, window):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(d[i : i + window]) for d in docs for i in range(len(d) - window + 1))
    out = []
    for d in docs:
        gone = set()
        for i in range(len(d) - window + 1):
            if seen[tuple(d[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(d), len(gone), " ".join(w for i, w in enumerate(d) if i not in gone)))
    return out


def check(spark, rows, window, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 string, seed int").repartition(parts)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeats(docs, window).collect()), key=str)
    want = sorted(((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], window), strict=True)), key=str)
    assert got == want


def corpus(seed=0):
    import random

    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}é"
    passages = [[word() for _ in range(rng.choice([11, 12, 13, 20, 60]))] for _ in range(6)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randrange(6)):
            text += [word() for _ in range(rng.randrange(30))]
            text += rng.choice(passages)[rng.randrange(3) :]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(text), "x", i))
    rows += [rows[5], (None, rows[6][1], None, None), (None, None, None, None), (200, "", "", 1), (201, "a " * 3000, "", 1), (202, "b c", "", 1), (5, "z " + rows[5][1], "", 2)]
    return rows


@pytest.mark.parametrize("contexts", [64, 1])
def test_against_brute_force(spark, monkeypatch, contexts):
    monkeypatch.setattr(m, "CONTEXTS", contexts)
    check(spark, corpus(contexts), 12)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_spans_are_maximal(spark):
    shared = " ".join(f"s{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"a b {shared} c"), (2, f"{shared} d")], "doc_id long, text string")
    got = {r.doc_id: (r.kept, [(s.start, s.end) for s in r.removed]) for r in remove_repeats(docs).collect()}
    assert got == {1: ("a b c", [(2, 42)]), 2: ("d", [(0, 40)])}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: b for r, b in zip(rows, brute([r.text for r in rows], 35), strict=True)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeats(docs).collect()}
    assert got == want
