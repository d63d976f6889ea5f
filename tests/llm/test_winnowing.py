import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from gyrolake.llm import queries
from gyrolake.llm.winnowing import edited_pairs, fingerprint, grams, in_chain, likeness


def brute_choice(g, window):
    out, wide = [], min(window, len(g))
    for i in range(len(g) - wide + 1 if g else 0):
        part = g[i : i + wide]
        pos = i + max(k for k in range(wide) if part[k] == min(part))
        if (g[pos], pos) not in out[-1:]:
            out.append((g[pos], pos))
    return out


def test_choice_and_guarantee(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 1, 4, 5, 6, 12, 13, 60, 200)] + [None, " \n"]
    shared = " ".join(f"s{i}" for i in range(12))
    texts += [f"x y {shared} z", f"{shared} q r"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = df.select("i", grams(F.col("text")).alias("g"), fingerprint(F.col("text")).alias("fp")).collect()
    for r in rows:
        assert [(x.hash, x.pos) for x in r.fp] == brute_choice(r.g, 8)
        n = len((texts[r.i] or "").split())
        assert len(r.g) == (max(1, n - 4) if n else 0)
    a, b = [{x.hash for x in r.fp} for r in rows[-2:]]
    assert a & b


def brute_edit(rows):
    signed = lambda t: (xxhash.xxh64_intdigest(t or "", 42) + (1 << 63)) % (1 << 64)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    out = []
    for k, (i, text) in enumerate(order):
        t, nxt = text or "", order[(k + 1) % len(order)][1] or ""
        h = len(t) // 2
        out.append((i, len(t), t[: len(t) - h] + nxt[:h]))
    return out


@pytest.mark.parametrize("n", [1, 2, 37])
def test_edited_texts(spark, n):
    rows = [(i * 3 % 101, "é" * (i % 9) + f" text {i}") for i in range(n)]
    if n > 2:
        rows += [(None, "null id"), (None, None), (5, None), (5, "again"), (5, "again"), (-7, "")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, bucket string, fp int").repartition(3)
    got = sorted(((r.doc_id, r.n_chars, r.edited) for r in edited_pairs(docs).collect()), key=str)
    assert got == sorted(brute_edit(rows), key=str)
    assert edited_pairs(docs.filter("false")).count() == 0


def test_likeness(spark):
    a = spark.sql("select array(1L,2L,3L) a, array(2L,3L,4L) b, cast(array() as array<bigint>) e")
    assert tuple(a.select(likeness(F.col("a"), F.col("b")), likeness(F.col("e"), F.col("e")), likeness(F.col("a"), F.col("e"))).first()) == (0.5, 1.0, 0.0)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {i: (n, hashlib.sha256(e.encode()).hexdigest()) for i, n, e in brute_edit(rows)}
    got = queries.op5_fingerprints(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want
    texts = dict(rows)
    prints = {}
    for r in got:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        own, other = ({re.match("[^@]*", x)[0] for x in f.split()} for f in (r.fingerprint, r.edited_fingerprint))
        assert r.near_edited == (len(own & other) / len(own | other) if own | other else 1.0)
    assert sum(r.near_edited > r.near_next for r in got) > 0.9 * len(got)


def test_rows_of_one_id_are_cut_too(spark):
    rows = [(None if i % 3 else i // 900, f"text {i}") for i in range(6000)] + [(7, None), (9, "x" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    dealt, _ = in_chain(docs, 16)
    sizes = [r["count"] for r in dealt.groupBy("bucket").count().collect()]
    assert max(sizes) < len(rows) / 8
    got = sorted(((r.doc_id, r.n_chars, r.edited) for r in edited_pairs(docs).select("doc_id", "n_chars", "edited").collect()), key=str)
    assert got == sorted(brute_edit(rows), key=str)
