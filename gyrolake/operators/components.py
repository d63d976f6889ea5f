"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolake.plans.staging import staged


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a long, b long); root is one node of the component.

    Each round every node moves to the neighbour of least random priority, if that is
    less than its own, and links are redrawn between the targets. The priorities are
    new in each round, so a round leaves a fraction of the nodes, chains included, and
    the number of rounds follows the logarithm of the largest component. Rounds work
    on tables in the shared folder. Minima are aggregated before they are shuffled;
    the joins are between scanned tables, so that adaptive execution can split hubs.
    """
    moves: list[DataFrame] = []
    current = staged(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    while not current.isEmpty():
        priority = lambda c: F.xxhash64(F.col(c), F.lit(len(moves)))
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(priority("b").alias("p"), F.col("b").alias("n"))).alias("best"))
        own = F.struct(priority("node").alias("p"), F.col("node").alias("n"))
        move = staged(least.select("node", F.when(F.col("best") < own, F.col("best.n")).otherwise(F.col("node")).alias("target")), "moves")
        moves.append(move)
        to_a, to_b = move.toDF("a", "to_a"), move.toDF("b", "to_b")
        redrawn = current.join(to_a, "a").join(to_b, "b").filter("to_a <> to_b")
        current = staged(redrawn.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
    if not moves:
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = moves[-1].toDF("node", "root")
    for move in reversed(moves[:-1]):
        later = roots.toDF("target", "later")
        roots = staged(move.join(later, "target", "left").select("node", F.coalesce("later", "target").alias("root")), "roots")
    return roots
