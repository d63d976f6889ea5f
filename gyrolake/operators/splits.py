"""Train, validation and test assignment of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyrolake.functions.rotations import uniform

BUCKETS = 1024


def counts(n: int, train: float, val: float) -> tuple[int, int]:
    """How many of ``n`` sequences train and validate; rounding is half to even, and one is left for testing."""
    if n < 3:
        return (max(0, n - 1), 0) if n else (0, 0)
    n_train = max(1, round(n * train))
    n_val = max(1, round(n * val))
    if n_train + n_val >= n:
        n_train = max(1, n - n_val - 1)
    return n_train, min(n_val, n - n_train - 1)


def assign(sequences: DataFrame, seed: int, train: float = 0.7, val: float = 0.15, key: str = "seq") -> DataFrame:
    """(key, split): sequences in order of a number drawn from the seed and the key, cut at the fractions.

    No task or driver holds the list: numbers are dealt to ``BUCKETS`` ranges, ranked
    there, and shifted by the counts of the ranges before.
    """
    rows = sequences.select(key).distinct().withColumn("u", uniform(F.lit(seed), F.col(key))).withColumn("range", F.floor(F.col("u") * BUCKETS))
    sizes = rows.groupBy("range").agg(F.count(F.lit(1)).alias("m"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over at most BUCKETS rows
    ahead = sizes.select("range", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("ahead"))
    n = sizes.agg(F.sum("m")).first()[0] or 0
    n_train, n_val = counts(n, train, val)
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("range").orderBy("u", key))
    split = F.when(F.col("place") <= n_train, "train").when(F.col("place") <= n_train + n_val, "val").otherwise("test")
    return rows.join(F.broadcast(ahead), "range").withColumn("place", place).select(key, split.alias("split"))
