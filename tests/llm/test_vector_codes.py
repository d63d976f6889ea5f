import hashlib

import numpy as np
import pytest

from gyrolake.llm import queries as Q
from gyrolake.llm import vector_codes as V


def lloyd(v, parts, entries, rounds):
    """All distances in every round."""
    x = v.reshape(len(v), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def nearest():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        return d.argmin(-1), d.min(-1)

    for _ in range(rounds):
        a, _ = nearest()
        for p in range(parts):
            for e in range(books.shape[1]):
                mine = a[:, p] == e
                if mine.any():
                    books[p, e] = x[mine, p].sum(0) // mine.sum()
    a, d = nearest()
    return a, d.sum(1), books


@pytest.mark.parametrize("spread", [1.0, 0.02])
def test_against_full_scans(spark, spread):
    """The small spread makes ties of distances the rule."""
    rng = np.random.default_rng(5)
    v = rng.normal(0, spread, (900, 8)).astype(np.float32)
    v[300:600] = v[:300] + np.float32(0.01)
    df = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(5)
    codes, books = V.compress(df, parts=4, entries=32, rounds=4)
    got = codes.select("row.vec_id", "code", "error", "scanned").orderBy("vec_id").toPandas()
    a, error, want = lloyd(np.floor(v.astype(float) * 256).astype(np.int64), 4, 32, 4)
    assert np.array_equal(books.entries, want) and np.array_equal(np.stack(got.code), a) and np.array_equal(got.error, error)
    if spread == 1.0:
        assert got.scanned.mean() < 2.5  # of 4 parts: the bounds settle the others


def test_bounds_hold_for_any_move():
    rng = np.random.default_rng(6)
    x, book = rng.integers(-40, 40, (2000, 4)), rng.integers(-40, 40, (16, 4))
    near, _, upper, lower = V.scan(x, book)
    for step in range(6):
        now = book + rng.integers(-3, 4, book.shape) * (rng.random((16, 1)) < 0.4)
        near, error, upper, lower, left = V.reassign(x, near, upper.astype(np.float32).astype(float), lower.astype(np.float32).astype(float), now, book)
        want, exact, _, _ = V.scan(x, now)
        assert np.array_equal(near, want) and np.array_equal(error, exact) and left.sum() < 2000
        book = now


def test_what_is_left_out(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [float(k), -float(k), 0.5, 0.0], "x", "y") for k in (3, 1, 2)]
    bad = [(0, None, "", ""), (4, [1.0, None, 0.0, 0.0], "", ""), (5, [nan, 0.0, 0.0, 0.0], "", ""), (6, [inf, 0.0, 0.0, 0.0], "", ""), (7, [], "", ""), (8, [1.0, 2.0, 3.0], "", ""), (9, [1.0, 2.0], "", ""), (10, [1e30, 0.0, 0.0, 0.0], "", "")]
    rows = good + bad + good[:1] + [(None, [0.0, 0.0, 0.0, -0.001], "x", None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, row string, code string")
    codes, books = V.compress(df, parts=2)
    assert sorted((r.row.vec_id or -1, r.row.code) for r in codes.collect()) == [(-1, None), (1, "y"), (2, "y"), (3, "y"), (3, "y")]
    assert books.entries.shape == (2, 5, 2) and books.entries[1].tolist()[-1] == [0, -1]  # floors go down, null ids come last
    codes, books = V.compress(df.filter("vec_id < 0"))
    assert codes.count() == 0 and books.entries.size == 0


def test_group_error(spark):
    rows = [(k, [float(k % 7), 1.0], None if k % 3 == 0 else 1 if k % 3 == 1 else k) for k in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    told = V.with_group_error(V.compress(df, parts=2, entries=3)[0], "label").select("row.label", "error", "group_error").collect()
    sums = {}
    for r in told:
        sums[r.label] = sums.get(r.label, 0) + r.error
    assert len(told) == 90 and all(r.group_error == sums[r.label] for r in told)


def test_query_over_the_table(spark):
    sf = "/root/testdata/sf0.01"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    a, error, books = lloyd(np.floor(np.stack(e.embedding).astype(float) * 256).astype(np.int64), 16, 64, 2)
    got = Q.op13_vector_codes(spark, sf).orderBy("vec_id").toPandas()
    assert got.code.tolist() == ["".join(f"{c:02x}" for c in x) for x in a] and np.array_equal(got.error, error)
    assert set(got.codebooks_sha256) == {hashlib.sha256(",".join(map(str, books.reshape(-1))).encode()).hexdigest()}
    assert got.error.groupby(e.label).transform("sum").tolist() == got.label_error.tolist()
