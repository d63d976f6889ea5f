"""Steps of weighted particles as relations, and masks and noise of measurements as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyrolake.functions.rotations import uniform


def markov_rates(p: float, recovery: float | None = None, entry: float | None = None) -> tuple[float, float]:
    """(entry, recovery) of a two-state chain that is hidden a share ``p`` of the time."""
    if p <= 0:
        return 0.0, 1.0
    if p >= 1:
        return 1.0, 0.0
    recovery = min(0.25, (1 - p) / p) if recovery is None else recovery
    return (min(1.0, max(0.0, p * recovery / (1 - p))) if entry is None else entry), recovery


def markov_hidden(frames: DataFrame, key: list[str], p: float, seed: int, recovery: float | None = None) -> DataFrame:
    """(key, t, hidden): a chain per key along t, driven by the key's uniform numbers.

    Each number maps both states to the next: it hides (both to hidden), shows (both to
    shown), or keeps or swaps the state. So the state is that of the last number that
    hides or shows, swapped as often as numbers since then swap: window sums, no fold
    over a recording.
    """
    enter, leave = markov_rates(p, recovery)
    u, along = F.col("u"), Window.partitionBy(*key).orderBy("t")
    drawn = frames.select(*key, "t", uniform(F.lit(seed), *map(F.col, key), F.col("t")).alias("u"))
    first = F.row_number().over(along) == 1
    from_hidden, from_shown = u >= leave, u < enter
    told = drawn.withColumn("fixed", F.when(first, u < p).when(from_hidden == from_shown, from_hidden))
    swaps = F.sum(F.when(F.col("fixed").isNull() & ~from_hidden, 1).otherwise(0)).over(along)
    told = told.withColumn("swaps", swaps)
    last = F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "swaps")), ignorenulls=True).over(along)
    return told.withColumn("last", last).select(*key, "t", (F.col("last.fixed") != ((F.col("swaps") - F.col("last.swaps")) % 2 == 1)).alias("hidden"))


def normalised(weights: DataFrame, group: list[str], log_weight: str = "lw") -> DataFrame:
    """Adds w: exp of the log weights, shifted by the group's largest, over their sum."""
    w = Window.partitionBy(*group)
    shifted = weights.withColumn("e", F.exp(F.col(log_weight) - F.max(log_weight).over(w)))
    return shifted.withColumn("w", F.col("e") / F.sum("e").over(w)).drop("e")


def effective_size(weighted: DataFrame, group: list[str]) -> DataFrame:
    return weighted.groupBy(*group).agg((1.0 / F.sum(F.col("w") * F.col("w"))).alias("ess"), F.count(F.lit(1)).alias("n"))


def systematic(weighted: DataFrame, group: list[str], index: str, u: float) -> DataFrame:
    """(group, position, index): for the places (u + i) / n the first particle whose summed weight reaches it.

    A particle answers the places between its predecessor's sum and its own, so places
    are generated from it, not searched for; the last sum counts as 1.
    """
    w = Window.partitionBy(*group)
    upto = F.sum("w").over(w.orderBy(index).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    n = F.count(F.lit(1)).over(w)
    last = F.row_number().over(w.orderBy(F.desc(index))) == 1
    sums = weighted.withColumn("n", n).withColumn("high", F.when(last, F.lit(1.0)).otherwise(upto)).withColumn("low", F.coalesce(F.lag("high").over(w.orderBy(index)), F.lit(-1.0)))
    first = F.greatest(F.floor(F.col("low") * F.col("n") - u) + 1, F.lit(0))
    final = F.least(F.floor(F.col("high") * F.col("n") - u), F.col("n") - 1)
    spread = sums.withColumn("first", first).withColumn("final", final).filter("first <= final")
    return spread.select(*group, F.explode(F.sequence("first", "final")).alias("position"), index)


def log_likelihood(distance: Column, sigma: Column, confidence: Column, outlier: float = 0.0) -> Column:
    """conf x (-1/2 (d / sigma)^2), with a floor of ``outlier`` mixed in by a stable log-sum-exp."""
    clean = -0.5 * (distance / F.greatest(sigma, F.lit(1e-8))) ** 2
    if outlier <= 0:
        return confidence * clean
    a, b = F.log1p(F.lit(-outlier)) + clean, F.log(F.lit(outlier))
    return confidence * (F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b))))
