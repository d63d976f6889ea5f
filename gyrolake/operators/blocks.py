"""Blocks of joints: which joints of a product state share weights and ancestors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The 23 body joints by limb: trunk, left leg, right leg, left arm, right arm.
SMPL_BODY = ((2, 5, 8, 11, 14), (0, 3, 6, 9), (1, 4, 7, 10), (12, 15, 17, 19, 21), (13, 16, 18, 20, 22))
NAMED = ("global", "joint", "contiguous", "smpl_body", "auto")
CONTIGUOUS = 4  # joints

Blocks = str | Sequence[Sequence[int]]


def resolved(blocks: Blocks, joints: int) -> tuple[tuple[int, ...], ...]:
    """The joints of every block; ``auto`` is the body's limbs where there are 23 joints, else contiguous blocks."""
    if not isinstance(blocks, str):
        return tuple(tuple(int(j) for j in b) for b in blocks)
    name = blocks if blocks != "auto" else "smpl_body" if joints == 23 else "contiguous"
    if name == "smpl_body":
        if joints != 23:
            raise ValueError(f"smpl_body has 23 joints, not {joints}")
        return SMPL_BODY
    sizes = {"global": joints, "joint": 1, "contiguous": CONTIGUOUS}
    if name not in sizes:
        raise ValueError(f"unknown blocks {blocks!r}; known: {', '.join(NAMED)}, or lists of joints")
    return tuple(tuple(range(k, min(joints, k + sizes[name]))) for k in range(0, joints, sizes[name]))


def checked(blocks: Blocks, joints: int) -> tuple[tuple[int, ...], ...]:
    """``resolved`` blocks that have every joint once; else an error that names the first problem."""
    found = resolved(blocks, joints)
    flat = [j for b in found for j in b]
    wrong = [f"block {k} is empty" for k, b in enumerate(found) if not b]
    wrong += [f"joint {j} is none of {joints}" for j in flat if not 0 <= j < joints]
    wrong += [f"joint {j} is in two blocks" for k, j in enumerate(flat) if j in flat[:k]]
    wrong += [f"joint {j} is in no block" for j in range(joints) if j not in flat]
    if wrong:
        raise ValueError(wrong[0])
    return found


def block_table(spark: SparkSession, blocks: Blocks, joints: int) -> DataFrame:
    """(block, joint), unchecked; an empty block has a null joint."""
    rows = [(k, j) for k, b in enumerate(resolved(blocks, joints)) for j in (b or (None,))]
    return spark.createDataFrame(rows, "block int, joint int")


def problems(table: DataFrame, joints: int) -> DataFrame:
    """(problem, block, joint) of a table (block, joint): empty blocks, unknown, doubled and uncovered joints; none if it is a partition."""
    known = F.col("joint").between(0, joints - 1)
    counted = table.groupBy("joint").agg(F.count(F.lit(1)).alias("times"), F.max("block").alias("block"))
    empty = table.groupBy("block").agg(F.count("joint").alias("n")).filter("n = 0").select(F.lit("empty block").alias("problem"), "block", F.lit(None).cast("int").alias("joint"))
    unknown = table.filter("joint is not null").filter(~known).select(F.lit("unknown joint").alias("problem"), "block", "joint").distinct()
    doubled = counted.filter(known & (F.col("times") > 1)).select(F.lit("doubled joint").alias("problem"), F.lit(None).cast(dict(table.dtypes)["block"]).alias("block"), "joint")
    every = table.sparkSession.range(joints).select(F.col("id").cast("int").alias("joint"))
    uncovered = every.join(table, "joint", "left_anti").select(F.lit("uncovered joint").alias("problem"), F.lit(None).cast(dict(table.dtypes)["block"]).alias("block"), "joint")
    return empty.unionByName(unknown).unionByName(doubled).unionByName(uncovered)


def of_table(table: DataFrame, joints: int) -> tuple[tuple[int, ...], ...]:
    """The blocks of a table (block, joint), of as many rows as joints, for the filter's options; problems are an error."""
    rows = table.limit(2 * joints + 1).collect()
    blocks: dict = {}
    for r in sorted(rows, key=lambda r: (str(r.block), -1 if r.joint is None else r.joint)):
        blocks.setdefault(r.block, [])
        if r.joint is not None:
            blocks[r.block].append(r.joint)
    return checked(tuple(map(tuple, blocks.values())), joints)
