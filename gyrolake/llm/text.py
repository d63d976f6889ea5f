"""Small shared pieces of the text operators: words, row keys, row packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyrolake.plans.staging import staged

#: White space of the word rule ``[^\x20\x09-\x0D]+``; also what bytes.split() splits at.
SPACE = r"[\x20\x09-\x0D]"
SHARE = 4096  # rows of a key from which a join deals it to several tasks
HEAVY_BROADCAST = 100_000  # keys


def words(text: Column) -> Column:
    """The words of a text, in order; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, id, text): a key that is never null and tells apart all but equal rows.

    Rows equal in id and text share a key and get the same result, so a join on the
    key stays right for repeated rows once the keyed side is made unique.
    """
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("k1"),
        F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("k2"),
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).alias("text"),
    )


def packed(docs: DataFrame, *extra: Column) -> DataFrame:
    """The whole row as the struct ``row`` beside computed columns, so that no name of the input can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *extra)


def salted_rank(df: DataFrame, group: list[str], order: list[str], salts: int) -> DataFrame:
    """``df`` with ``rank``: a dense 0-based number of each row within its ``group``.

    A group may hold most rows: rows are dealt by (group, salt), numbered there, and
    shifted by the count of the group's lower salts, which is a table of at most
    groups x salts rows.
    """
    from pyspark.sql import Window as W

    dealt = df.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = dealt.groupBy(*group, "salt").agg(F.count(F.lit(1)).alias("n"))
    ahead = W.partitionBy(*group).orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    shift = counts.select(*group, "salt", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("shift"))
    within = F.row_number().over(W.partitionBy(*group, "salt").orderBy(*order)) - 1
    return (
        dealt.withColumn("within", within)
        .join(shift, [*group, "salt"])
        .withColumn("rank", F.col("within") + F.col("shift"))
        .drop("salt", "within", "shift")
    )


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], how: str = "inner", share: int = SHARE) -> DataFrame:
    """``left`` (staged, no null keys) joined to ``right``, one row a key, where one key may hold most rows of ``left``.

    A key of more than ``share`` rows is dealt by the hash of the columns ``spread`` to
    several tasks, and its row of ``right`` is copied to each. Such keys number at most
    rows / share; their table is broadcast up to ``HEAVY_BROADCAST`` of them, beyond
    which the plain join and adaptive execution's skew handling remain.
    """
    heavy = left.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > share)
    heavy = staged(heavy.select(*on, F.ceil(F.col("n") / share).alias("salts")), "heavy_keys")
    if not 0 < heavy.count() <= HEAVY_BROADCAST:
        return left.join(right, on, how)
    salts = F.coalesce(F.col("salts"), F.lit(1).cast("long"))
    dealt = left.join(F.broadcast(heavy), on, "left").withColumn("salt", F.pmod(F.xxhash64(*spread), salts)).drop("salts")
    copied = right.join(F.broadcast(heavy), on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts")
    return dealt.join(copied, [*on, "salt"], how).drop("salt")
