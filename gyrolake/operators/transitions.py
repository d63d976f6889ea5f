"""Models of motion from one frame to the next: fits are aggregates, predictions are columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyrolake.functions import rotations as R

FLOOR_DEG = 0.25


def capped(std: Column, cap_deg: float | None) -> Column:
    """A spread of at least FLOOR_DEG and at most ``cap_deg``."""
    floored = F.greatest(F.lit(math.radians(FLOOR_DEG)), std)
    return floored if cap_deg is None else F.least(F.lit(math.radians(cap_deg)), floored)


def fit_random_walk(deltas: DataFrame, cap_deg: float | None = None) -> DataFrame:
    """(joint, mean0..2, std0..2, n) of the left deltas d0..d2."""
    spread = [capped(F.stddev_pop(f"d{k}"), cap_deg).alias(f"std{k}") for k in range(3)]
    return deltas.groupBy("joint").agg(*[F.avg(f"d{k}").alias(f"mean{k}") for k in range(3)], *spread, F.count("d0").alias("n"))


def fit_constant_velocity(deltas: DataFrame, cap_deg: float | None = None) -> DataFrame:
    """(joint, std0..2) of second differences, or of first ones where a joint has no second."""
    w = Window.partitionBy("seq", "joint").orderBy("t")
    second = deltas.withColumns({f"c{k}": F.col(f"d{k}") - F.lag(f"d{k}").over(w) for k in range(3)})
    return second.groupBy("joint").agg(*[capped(F.coalesce(F.stddev_pop(f"c{k}"), F.stddev_pop(f"d{k}")), cap_deg).alias(f"std{k}") for k in range(3)])


def predicted(df: DataFrame) -> DataFrame:
    """Adds e0..e8: the previous rotation p turned by the step q."""
    return df.withColumns(dict(zip(R.names("e"), R.matmul(R.cols("q"), R.cols("p")), strict=True)))


def one_step(df: DataFrame, model: str) -> DataFrame:
    """(model, one_step_deg): mean error of the step q from p, over all frames and joints."""
    error = F.degrees(R.geodesic(R.cols("r"), R.cols("e")))
    mean = F.round(F.avg(error), 6) + 0.0
    return predicted(df).agg(mean.alias("one_step_deg")).select(F.lit(model).alias("model"), "one_step_deg")


def log_prob(deltas: DataFrame, fit: DataFrame) -> DataFrame:
    """``deltas`` with the log density of each step under a diagonal Gaussian in tangent space."""
    terms = [-0.5 * ((F.col(f"d{k}") - F.col(f"mean{k}")) / F.col(f"std{k}")) ** 2 - F.log(f"std{k}") - 0.5 * math.log(2 * math.pi) for k in range(3)]
    return deltas.join(F.broadcast(fit.drop("n")), "joint").withColumn("log_prob", terms[0] + terms[1] + terms[2])


def isotropic_log_prob(delta: list[Column], std: float) -> Column:
    """The log density of a step under the same spread in all directions."""
    return -0.5 * (sum((d * d for d in delta[1:]), delta[0] * delta[0]) / (std * std) + 3 * math.log(2 * math.pi * std * std))


def with_history(deltas: DataFrame, length: int) -> DataFrame:
    """Adds h1_0..h<length>_2: the steps one to ``length`` frames earlier, zero before the first."""
    w = Window.partitionBy("seq", "joint").orderBy("t")
    return deltas.withColumns({f"h{lag}_{k}": F.coalesce(F.lag(f"d{k}", lag).over(w), F.lit(0.0)) for lag in range(1, length + 1) for k in range(3)})


def random_quaternion(seed: int, key: list[Column]) -> list[Column]:
    """A uniformly distributed unit quaternion of the key."""
    u = [R.uniform(F.lit(seed), *key, F.lit(k)) for k in range(3)]
    turn = lambda x: 2.0 * math.pi * x
    a, b = F.sqrt(1.0 - u[0]), F.sqrt(u[0])
    return [a * F.sin(turn(u[1])), a * F.cos(turn(u[1])), b * F.sin(turn(u[2])), b * F.cos(turn(u[2]))]
