"""Queries of the sequential operators; random or by singular values, so without SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyrolake.functions import rotations as R
from gyrolake.operators import particle_filter as P
from gyrolake.operators import smoothing as S
from gyrolake.operators import transitions
from gyrolake.plans.bindings import poses
from gyrolake.plans.geometry import deltas
from gyrolake.plans.staging import staged
from gyrolake.plans.streams import measured

QUERIES: dict = {}


def register(f):
    QUERIES[f.__name__] = (f, None)
    return f


def scored(spark: SparkSession, sf_dir: str, estimate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Mean error of the estimates beside that of the observations, per sequence; the measurements are made once."""
    known = staged(measured(spark, sf_dir).select("seq", "t", "joint", "mask", "confidence", "err", *R.names("r"), *R.names("o")), "measured")
    truth, estimates = known.select("seq", "t", "joint", "mask", *R.names("r"), "err"), estimate(known)
    error = F.degrees(R.geodesic(R.cols("e"), R.cols("r")))
    both = estimates.join(truth, ["seq", "t", "joint"])
    return both.groupBy("seq").agg(F.avg(error).alias("error_deg"), F.avg(F.when(F.col("mask"), F.col("err"))).alias("observed_deg"), F.avg(F.when(~F.col("mask"), error)).alias("occluded_deg"))


@register
def particle_filter_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir, lambda m: P.run_filter(m, P.Options(blocks="global")))


@register
def particle_filter_factorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir, lambda m: P.run_filter(m, P.Options(shared_resampling=True)))


@register
def particle_filter_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir, lambda m: P.run_filter(m, P.Options()))


@register
def particle_filter_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir, lambda m: P.run_filter(m, P.Options(blocks="contiguous", outlier=0.05)))


@register
def particle_filter_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir, lambda m: P.run_filter(m, P.Options(velocity=True)))


@register
def particle_filter_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles that move as the random walk fitted to the poses does."""
    options = P.fitted(P.Options(), transitions.fit_random_walk(deltas(spark, sf_dir), cap_deg=10.0))
    return scored(spark, sf_dir, lambda m: P.run_filter(m, options))


@register
def particle_filter_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, standing still after a step of less than 1.5 degrees."""
    options = P.fitted(P.Options(), transitions.fit_random_walk(deltas(spark, sf_dir), cap_deg=10.0), math.radians(1.5))
    return scored(spark, sf_dir, lambda m: P.run_filter(m, options))


@register
def particle_filter_second_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles that repeat their last step under the spread of the poses' second differences."""
    options = P.fitted(P.Options(velocity=True), transitions.fit_constant_velocity(deltas(spark, sf_dir), cap_deg=10.0))
    return scored(spark, sf_dir, lambda m: P.run_filter(m, options))


@register
def filter_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.diagnostics(P.run_filter(measured(spark, sf_dir), P.Options()), P.Options().particles)


@register
def chordal_smoother(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir, S.chordal)


@register
def savgol_smoother(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir, S.savgol)


@register
def ema_smoother(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir, S.ema)


@register
def learned_delta_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge weights from a frame's tangent vectors to its next step's, as rows."""
    logs = R.with_log(poses(spark, sf_dir), "r", "v")
    frames = logs.groupBy("seq", "t").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("joint", F.array("v0", "v1", "v2").alias("v")))), lambda s: s["v"])).alias("x"))
    pairs = frames.withColumn("next", F.lead("x").over(Window.partitionBy("seq").orderBy("t"))).filter("next is not null")
    pairs = pairs.select("x", F.zip_with("next", "x", lambda a, b: a - b).alias("y"))
    weights = S.ridge(pairs, "x", "y")
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(weights)], "feature int, weights array<double>")
