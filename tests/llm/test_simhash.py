import numpy as np
import pytest
from pyspark.sql import functions as F

from gyrolake.llm.near_copies import drop_near_copies
from gyrolake.llm.simhash import BKTree, blocks_for, fingerprint, fingerprint_links, near_duplicates, shard_links, shingle_hashes
from gyrolake.operators.components import connected_components


def components(n, pairs):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def near_pairs(fps, radius):
    fps = np.array(fps, dtype=np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1:
            yield i, int(j)


def test_fingerprint_bits():
    import xxhash

    text = "The quick\tbrown fox  jumps\nOVER the Ärger"
    w = ["the", "quick", "brown", "fox", "jumps", "over", "the", "Ärger"]
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(5)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))
    assert fingerprint(text, 4) % (1 << 64) == want
    assert fingerprint("a b", 4) % (1 << 64) == xxhash.xxh64_intdigest("a b", 42)
    assert fingerprint(None, 4) == fingerprint(" \n", 4) == 0


def test_tree_and_shard_links():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 63, (40, 30, 3)).astype(np.uint64)
    fps = np.unique(np.bitwise_xor.reduce(flips, axis=2) ^ base[:, None])
    tree = BKTree(fps)
    assert tree.children and all((np.bitwise_count(fps[c.members] ^ tree.pivot) == d).all() for d, c in tree.children.items())
    a, b = shard_links(fps, 4)
    at = {int(f): i for i, f in enumerate(fps)}
    links = [(at[int(x)], at[int(y)]) for x, y in zip(a, b, strict=True)]
    assert components(len(fps), links) == components(len(fps), near_pairs(fps, 4))


def nodes(tree):
    yield tree
    for child in tree.children.values():
        yield from nodes(child)


def test_only_edges_within_the_radius_are_followed():
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    fps[0] ^= fps[0]  # the pivot, so that a fingerprint's edge is its number of bits
    tree = BKTree(fps)
    labels = np.full(len(fps), len(fps))
    held = np.arange(len(fps))
    query = np.array([int(np.argmax(np.bitwise_count(fps)))])
    labels[held != query[0]] = 0
    tree.lower_labels(labels, 4, query)
    bits = int(np.bitwise_count(fps[query[0]]))
    assert {d for d, c in tree.children.items() if c.visits} == {d for d in tree.children if abs(d - bits) <= 4}
    assert sum(n.visits for n in nodes(tree)) < 0.2 * sum(1 for _ in nodes(tree))
    settled = BKTree(fps)
    settled.lower_labels(np.zeros(len(fps), np.int64), 4)
    assert not any(n.visits for n in nodes(settled))  # nothing lesser to be found


def test_links_lose_nothing(spark, monkeypatch):
    import gyrolake.llm.simhash as m

    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (30, 40, 4)).astype(np.uint64)
    fps = np.unique(np.bitwise_xor.reduce(flips[:, :, :], axis=2) ^ base[:, None])
    want = components(len(fps), near_pairs(fps, 4))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    at = {int(f): i for i, f in enumerate(fps.view(np.int64))}
    for shard in (4096, 8):
        monkeypatch.setattr(m, "SHARD", shard)
        got = [(at[r.a], at[r.b]) for r in fingerprint_links(df, 4).collect()]
        assert components(len(fps), got) == want
    assert blocks_for(10, 4) == 5 and blocks_for(10**9, 4) > 5


@pytest.mark.parametrize("n", [2, 50])
def test_components_of_a_chain(spark, n):
    rows = [(i, i + 1) for i in range(n)] + [(1000, 1001)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert len({got[i] for i in range(n + 1)}) == 1 and got[1000] == got[1001] != got[0]
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_nulls_and_names(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text, "x", 1), (3, text, "y", 2), (3, text, "y", 2), (9, text + " tail", None, 3), (None, None, "z", 4), (7, "", "z", 5), (8, " ".join(f"v{i}" for i in range(50)), "q", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component long")
    got = sorted([(r.id, r.component) for r in near_duplicates(docs, 4, 4).collect()], key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (9, 3), (None, 7), (7, 7), (8, 8)], key=str)
    kept = drop_near_copies(docs, 4, 4)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 8]
    assert drop_near_copies(docs.filter("false")).count() == 0
    assert near_duplicates(docs.filter("false"), 4, 4).count() == 0


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    fps = [fingerprint(r.text, 4) % (1 << 64) for r in rows]
    want = components(len(rows), near_pairs(fps, 4))
    got = {r.id: (r.fp % (1 << 64), r.component) for r in near_duplicates(docs, 4, 4).collect()}
    assert got == {r.doc_id: (f, rows[c].doc_id) for r, f, c in zip(rows, fps, want, strict=True)}
    assert docs.select(F.count("*")).first()[0] == len(got)


def test_long_texts_and_rows_without_ids(spark):
    text = " ".join(f"w{i % 977}" for i in range(120_000))
    rows = [(None, text), (None, text + " tail"), (4, text + " end"), *((None, f"copy {i % 3}") for i in range(3000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = near_duplicates(docs, 4, 4).collect()
    assert len(got) == len(rows) and {r.component for r in got if r.id == 4} == {4}
    assert sorted(len(r.text.split()) for r in drop_near_copies(docs).collect()) == [2, 2, 2, 120_001]
