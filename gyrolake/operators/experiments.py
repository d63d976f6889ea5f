"""Experiments: models are fitted to training sequences and scored on sequences that no fit saw.

All models of a sweep share one split, one draw of measurements and one pass of the filter; the
results are tables keyed by model. The split is joined to the poses, so neither sequences nor
their names pass through the driver; what does is the models' own arrays.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolake.functions import rotations as R
from gyrolake.operators import evaluation as E
from gyrolake.operators import motions as M
from gyrolake.operators import particle_filter as P
from gyrolake.operators import splits
from gyrolake.operators import training as T
from gyrolake.plans.staging import staged

Fit = Callable[[DataFrame], M.Motion]


@dataclass(frozen=True)
class Settings:
    """How models are fitted; ``cap_deg`` bounds the spread of every model, as far as it is given."""

    cap_deg: float | None = None
    still_deg: float | None = None
    slow_deg: float = 1.5
    low_deg: float = 0.25
    penalty: float = 1e-3
    history: int = 2
    training: T.Training = T.Training()
    step_scale: float = 1.0
    step_cap_deg: float = math.inf


def model_fits(s: Settings = Settings()) -> dict[str, Fit]:
    """The named models; a caller may add its own."""
    cap = s.step_cap_deg if math.isinf(s.step_cap_deg) else math.radians(s.step_cap_deg)
    return {
        "persistence": lambda poses: replace(M.fit_still(poses), spread=0.0 * M.fit_still(poses).spread),
        "noisy_persistence": lambda poses: M.fit_still(poses, s.still_deg, s.cap_deg),
        "gaussian_rw": lambda poses: M.fit_drift(poses, s.cap_deg),
        "adaptive_gaussian_rw": lambda poses: M.fit_gated(poses, s.cap_deg, s.slow_deg, s.low_deg),
        "constant_velocity": lambda poses: M.fit_repeat(poses, s.cap_deg),
        "learned_delta": lambda poses: M.fit_linear(poses, s.penalty, s.cap_deg),
        "mlp_delta": lambda poses: T.fit_net(poses, 0, s.training, s.cap_deg, s.step_scale, cap)[0],
        "history_mlp_delta": lambda poses: T.fit_net(poses, s.history, s.training, s.cap_deg, s.step_scale, cap)[0],
    }


def split_rows(known: DataFrame, seed: int = 0, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """``known`` (seq, ...) with ``split``: train, val or test."""
    return known.join(splits.assign(known.select("seq"), seed, train, val), "seq")


def fitted(poses: DataFrame, names: list[str], fits: Mapping[str, Fit] | None = None) -> dict[str, M.Motion]:
    fits = fits or model_fits()
    unknown = [n for n in names if n not in fits]
    if unknown:
        raise ValueError(f"unknown models {', '.join(unknown)}; known: {', '.join(fits)}")
    return {n: fits[n](poses) for n in names}


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def step_errors(poses: DataFrame, models: Mapping[str, M.Motion]) -> DataFrame:
    """(model, seq, steps, one_step_error_deg, log_density): means over each sequence's steps."""
    frames = M.frames_of(poses)
    told = [M.one_step(frames, m).withColumn("model", F.lit(n)) for n, m in models.items()]
    means = [F.count(F.lit(1)).alias("steps"), F.degrees(F.avg("error")).alias("one_step_error_deg"), F.sum(F.when(~F.isnan("log_density"), F.col("log_density"))).alias("log_density")]
    return _union(told).groupBy("model", "seq").agg(*means)


def rollout_errors(poses: DataFrame, models: Mapping[str, M.Motion], horizon: int = 10, warm: int = 0) -> DataFrame:
    """(model, seq, t, error) of predictions fed back for ``horizon`` frames."""
    frames = M.frames_of(poses)
    return _union([M.rollout(frames, m, horizon, warm).withColumn("model", F.lit(n)) for n, m in models.items()])


def transition_metrics(poses: DataFrame, models: Mapping[str, M.Motion], horizon: int = 10) -> DataFrame:
    """(model, metric, value): mean one-step and rollout errors in degrees over all steps of all sequences, which count by their length."""
    one = step_errors(poses, models).groupBy("model").agg((F.sum(F.col("steps") * F.col("one_step_error_deg")) / F.sum("steps")).alias("value")).withColumn("metric", F.lit("one_step_error_deg"))
    far = rollout_errors(poses, models, horizon).groupBy("model").agg(F.degrees(F.avg("error")).alias("value")).withColumn("metric", F.lit("rollout_error_deg"))
    return one.unionByName(far).select("model", "metric", "value")


def filter_metrics(known: DataFrame, models: Mapping[str, M.Motion], options: P.Options, noise_deg: float) -> DataFrame:
    """(model, seq, the columns of E.sequence_metrics): every model drives the filter over the same measurements, side by side."""
    names = list(models)
    estimates = staged(P.run_variants(known, [replace(options, model=m) for m in models.values()]), "estimates")
    told = E.sequence_metrics(known, estimates, F.lit(options.particles), noise_deg, ("variant", "seq"))
    return told.withColumn("model", F.get(F.array(*map(F.lit, names)), F.col("variant"))).drop("variant")


def means(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Means of all numbers over rows of the same ``keys``, those that are not finite left out."""
    numbers = [c for c, t in rows.dtypes if t in ("double", "bigint", "int", "float") and c not in (*keys, "seq")]
    return rows.groupBy(*keys).agg(*[F.avg(R.finite(F.col(c).cast("double"))).alias(c) for c in numbers])


def compared(transition: DataFrame, filtered: DataFrame) -> DataFrame:
    """One row a model: its transition metrics and mean filter metrics; ``best`` marks the least filter error, ties to the first name."""
    wide = transition.groupBy("model").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in ("one_step_error_deg", "rollout_error_deg")])
    columns = ["observed_error_deg", "filter_error_deg", "filter_occluded_joint_error_deg", "persistence_error_deg", "mean_ess"]
    both = wide.join(means(filtered, ["model"]).select("model", *columns), "model")
    best = both.agg(F.min(F.struct("filter_error_deg", "model"))["model"].alias("best_model"))
    return both.crossJoin(F.broadcast(best)).withColumn("best", F.col("model") == F.col("best_model")).drop("best_model")


@dataclass(frozen=True)
class Grid:
    """Conditions of a grid; every cell has its own draw of measurements, which all its models share."""

    noise_deg: tuple[float, ...] = (5.0, 20.0)
    occlusion: tuple[float, ...] = (0.0, 0.5)
    seeds: tuple[int, ...] = (0,)

    def cells(self) -> list[tuple[int, float, float, int]]:
        return [(k, n, o, s) for k, (n, o, s) in enumerate((n, o, s) for n in self.noise_deg for o in self.occlusion for s in self.seeds)]


def drawn(poses: DataFrame, grid: Grid) -> DataFrame:
    """``poses`` once for every cell, with mask, confidence and the noisy observation o0..o8; draws depend on (seed, row) alone, so
    cells of one seed differ in scale and rate, not in luck.

    Columns cell, noise_deg, occlusion_prob and seed tell the cell; ``key`` = seq x cells + cell is
    the sequence of a filter. First frames are seen.
    """
    cells = grid.cells()
    cell = F.explode(F.array(*[F.struct(F.lit(k).alias("cell"), F.lit(n).alias("noise_deg"), F.lit(o).alias("occlusion_prob"), F.lit(s).alias("seed")) for k, n, o, s in cells])).alias("of")
    rows = poses.select("seq", "t", "joint", *R.names("r"), cell).select("seq", "t", "joint", *R.names("r"), "of.*")
    at = [F.col("seed"), F.col("seq"), F.col("t"), F.col("joint")]
    rows = rows.withColumns({f"__n{k}": F.radians("noise_deg") * R.normal(F.lit("noise"), *at, F.lit(k)) for k in range(3)})
    rows = R.with_exp(rows, [f"__n{k}" for k in range(3)], "__q")
    rows = rows.withColumns(dict(zip(R.names("o"), R.matmul(R.cols("__q"), R.cols("r")), strict=True)))
    rows = rows.withColumns({"mask": (F.col("t") == 0) | (R.uniform(F.lit("seen"), *at) >= F.col("occlusion_prob")), "confidence": F.lit(1.0), "key": F.col("seq").cast("long") * len(cells) + F.col("cell")})
    rows = rows.withColumn("err", F.degrees(R.geodesic(R.cols("o"), R.cols("r"))))
    return rows.drop(*[c for c in rows.columns if c.startswith("__")])


def grid_metrics(poses: DataFrame, models: Mapping[str, M.Motion], options: P.Options, grid: Grid) -> DataFrame:
    """(cell, noise_deg, occlusion_prob, seed, model, seq, metrics): all cells and models in one plan, with each cell's noise told to the filter."""
    rows = staged(drawn(poses, grid).withColumn("sigma", F.radians("noise_deg")), "grid")
    cells = rows.select("key", F.col("seq").alias("of"), "cell", "noise_deg", "occlusion_prob", "seed").distinct()
    keyed = rows.drop("seq", "cell", "noise_deg", "occlusion_prob", "seed").withColumnRenamed("key", "seq")
    told = filter_metrics(keyed, models, options, 0.0).drop("mean_joint_noise_sigma_deg")
    return told.withColumnRenamed("seq", "key").join(cells, "key").withColumnRenamed("of", "seq").drop("key")


def aligned(truth: DataFrame, measured: DataFrame, min_frames: int = 2) -> tuple[DataFrame, DataFrame]:
    """Truth (seq, t, joint, r0..r8) and measurements (seq, t, joint, o0..o8, mask, confidence, sigma) over the frames that both have.

    The second table has a row for every sequence of ``truth``: frames, and why it is not used, if so.
    Sequences are numbered by ``id``, as names may be of any type.
    """
    lengths = truth.groupBy("seq").agg((F.max("t") + 1).alias("own"))
    seen = measured.groupBy("seq").agg((F.max("t") + 1).alias("theirs"))
    told = lengths.join(seen, "seq", "left").withColumn("frames", F.least("own", F.col("theirs")))
    reason = F.when(F.col("theirs").isNull(), "missing").when(F.col("frames") < min_frames, "too few frames")
    told = staged(told.select("seq", F.monotonically_increasing_id().alias("id"), F.when(F.col("theirs").isNotNull(), F.col("frames")).alias("frames"), reason.alias("problem")), "sequences")
    used = told.filter("problem is null").select("seq", "id")
    both = truth.select("seq", "t", "joint", *R.names("r")).join(measured.select("seq", "t", "joint", *R.names("o"), "mask", "confidence", "sigma"), ["seq", "t", "joint"]).join(used, "seq")
    return both.withColumn("err", F.degrees(R.geodesic(R.cols("o"), R.cols("r")))), told


def measured_columns() -> dict:
    """What an evaluation of a detector says of its measurements, beside the errors of E.split_errors."""
    mask, err, c = F.col("mask"), F.col("err"), F.col("confidence")
    return {
        "frames": F.count_distinct("t"),
        "observed_joint_fraction": F.avg(mask.cast("int")),
        "mean_confidence": F.avg(F.when(mask, c)),
        "mean_sigma_deg": F.degrees(F.avg("sigma")),
        "observed_error_deg": F.try_divide(F.sum(F.when(mask, c * err)), F.sum(F.when(mask, c))),
        "observed_joint_error_deg": F.avg(F.when(mask, err)),
    }


def detector_metrics(both: DataFrame, options: P.Options) -> DataFrame:
    """(seq, measured_columns, errors of the filter and of the first true pose held, state of the particles) of aligned sequences."""
    known = staged(both, "aligned")
    numbered = known.withColumn("name", F.col("seq")).withColumn("seq", F.col("id"))
    estimates = staged(P.run_filter(numbered, options), "estimates")
    rows = E.with_held(numbered.join(estimates.select("seq", "t", "joint", *R.names("e")), ["seq", "t", "joint"]))
    error = F.degrees(R.geodesic(R.cols("e"), R.cols("r")))
    columns = measured_columns() | E.split_errors("filter", error) | E.split_errors("persistence", F.col("held"))
    told = rows.groupBy("seq").agg(F.first("name").alias("name"), *[c.alias(n) for n, c in columns.items()])
    return told.join(E.health(estimates, F.lit(options.particles)), "seq").drop("seq").withColumnRenamed("name", "seq")


@dataclass
class Experiment:
    """The tables of a run; ``models`` are what was fitted to the training sequences."""

    models: dict[str, M.Motion]
    splits: DataFrame
    transition_metrics: DataFrame
    filter_metrics: DataFrame
    comparison: DataFrame
    per_joint: DataFrame | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)

    def tables(self) -> dict[str, DataFrame]:
        own = {"splits": self.splits, "transition_metrics": self.transition_metrics, "filter_metrics": self.filter_metrics, "comparison": self.comparison}
        return own | self.extra

    def write(self, folder: str) -> None:
        """Every table as Parquet in a folder of its name, and the models as a model table."""
        for name, rows in self.tables().items():
            rows.write.mode("overwrite").parquet(f"{folder}/{name}")
        for name, model in self.models.items():
            M.save(self.splits.sparkSession, model, f"{folder}/models", name)


def run(known: DataFrame, names: list[str], options: P.Options = P.Options(), noise_deg: float = 10.0, horizon: int = 10, seed: int = 0, train: float = 0.7, val: float = 0.15, fits: Mapping[str, Fit] | None = None) -> Experiment:
    """Splits the sequences of ``known`` (seq, t, joint, r0..r8, o0..o8, mask, confidence, err), fits the named models to the training ones and scores them on the test ones.

    With fewer than three sequences there may be none to train on, which is an error.
    """
    rows = staged(split_rows(known, seed, train, val), "known")
    parts = {s: rows.filter(F.col("split") == s).drop("split") for s in ("train", "val", "test")}
    models = fitted(parts["train"], names, fits)
    transition = staged(transition_metrics(parts["test"], models, horizon), "transition_metrics")
    filtered = staged(filter_metrics(parts["test"], models, options, noise_deg), "filter_metrics")
    counted = rows.groupBy("split").agg(F.count_distinct("seq").alias("sequences"), F.count_distinct("seq", "t").alias("frames"))
    return Experiment(models, counted, transition, filtered, compared(transition, filtered))
