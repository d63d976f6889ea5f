"""Models of motion: the mean of the next step of a pose, and how steps scatter around it.

A model is a few arrays whose size is set by joints and hidden units. Fits are aggregates over
training rows; the model then travels to the tasks, where it predicts many poses at once: every
row of a table for one-step errors, all sequences of a batch for rollouts, all particles of a
filter. A user's own model is a subclass of ``Motion``.

Frames are rows (seq, t, x): x holds the nine numbers of each joint's rotation, joint by joint.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyrolake.functions import kernels as K
from gyrolake.functions import rotations as R
from gyrolake.operators import transitions
from gyrolake.operators.smoothing import ridge

FLOOR = math.radians(transitions.FLOOR_DEG)
ROWS = 512  # of an Arrow batch that a task works on at a time


@dataclass(frozen=True, eq=False)
class Motion:
    """Poses that stand still; ``spread`` [joints, 3] is the standard deviation of a step.

    ``past`` is a list of poses [n, joints, 3, 3], the current one last, and before it as many
    as are known, at most ``history``.
    """

    spread: np.ndarray
    history: int = field(default=0, kw_only=True)

    def mean(self, past: list[np.ndarray]) -> np.ndarray:
        """Tangent vectors [n, joints, 3] from the current poses to the expected next ones."""
        return np.zeros((*past[-1].shape[:2], 3))

    def deviation(self, past: list[np.ndarray]) -> np.ndarray:
        """Standard deviations that broadcast to the mean's shape."""
        return self.spread

    def following(self, past: list[np.ndarray]) -> np.ndarray:
        """The expected next poses."""
        return K.exp(self.mean(past)) @ past[-1]

    def drawn(self, past: list[np.ndarray], rng: np.random.Generator) -> np.ndarray:
        mean = self.mean(past)
        return K.exp(mean + self.deviation(past) * rng.normal(size=mean.shape)) @ past[-1]

    def log_density(self, past: list[np.ndarray], following: np.ndarray) -> np.ndarray:
        """[n]: the log density of the steps to ``following``, a diagonal Gaussian in tangent space."""
        spread = np.broadcast_to(self.deviation(past), (*following.shape[:2], 3))
        z = (steps(past[-1], following) - self.mean(past)) / spread
        return -0.5 * (z * z + np.log(2 * np.pi * spread * spread)).sum(axis=(-1, -2))


def steps(current: np.ndarray, following: np.ndarray) -> np.ndarray:
    return K.log(following @ np.swapaxes(current, -1, -2))


@dataclass(frozen=True, eq=False)
class Drift(Motion):
    """The same mean step everywhere."""

    drift: np.ndarray

    def mean(self, past):
        return np.broadcast_to(self.drift, (*past[-1].shape[:2], 3))


@dataclass(frozen=True, eq=False)
class Gated(Drift):
    """Standing still under ``low_spread`` after a step whose mean angle is below ``slow``, or after none; else the drift."""

    low_spread: np.ndarray
    slow: float
    history: int = field(default=1, kw_only=True)

    def low(self, past):
        if len(past) < 2:
            return np.ones((len(past[-1]), 1, 1), bool)
        return (K.angle(past[-1], past[-2]).mean(axis=-1) < self.slow)[:, None, None]

    def mean(self, past):
        return np.where(self.low(past), 0.0, super().mean(past))

    def deviation(self, past):
        return np.where(self.low(past), self.low_spread, self.spread)


@dataclass(frozen=True, eq=False)
class Repeat(Motion):
    """The step before once more; the first is none."""

    history: int = field(default=1, kw_only=True)

    def mean(self, past):
        return steps(past[-2], past[-1]) if len(past) > 1 else super().mean(past)


def pose_features(past: list[np.ndarray], history: int) -> np.ndarray:
    """[n, (1 + history) joints 3]: the pose's tangent vectors, then the last steps, the latest first, zeros where there were none."""
    n = len(past[-1])
    parts = [K.log(past[-1]).reshape(n, -1)]
    parts += [steps(past[-k - 1], past[-k]).reshape(n, -1) if len(past) > k else np.zeros_like(parts[0]) for k in range(1, history + 1)]
    return np.concatenate(parts, axis=1)


@dataclass(frozen=True, eq=False)
class Linear(Motion):
    """A linear map from the pose's tangent vectors to the step; the weights' last row is the bias."""

    weights: np.ndarray

    def mean(self, past):
        x = pose_features(past, self.history)
        return (x @ self.weights[:-1] + self.weights[-1]).reshape(len(x), -1, 3)


@dataclass(frozen=True, eq=False)
class Net(Motion):
    """One hidden layer of hyperbolic tangents over standardised features; steps are scaled, then shortened to ``cap``."""

    moments: np.ndarray  # [2, features]: mean and standard deviation
    target_moments: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    scale: float = 1.0
    cap: float = math.inf

    def mean(self, past):
        x = (pose_features(past, self.history) - self.moments[0]) / self.moments[1]
        y = (np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2) * self.target_moments[1] + self.target_moments[0]
        return stabilised(y.reshape(len(x), -1, 3), self.scale, self.cap)


def stabilised(step: np.ndarray, scale: float = 1.0, cap: float = math.inf) -> np.ndarray:
    step = step * scale
    return step if not (0 < cap < math.inf) else step * np.minimum(1.0, cap / np.maximum(np.linalg.norm(step, axis=-1, keepdims=True), 1e-12))


# --- frames and pairs ---------------------------------------------------------------------------


def frames_of(poses: DataFrame) -> DataFrame:
    """(seq, t, x) of poses (seq, t, joint, r0..r8)."""
    joints = F.array_sort(F.collect_list(F.struct("joint", F.array(*R.cols("r")).alias("r"))))
    return poses.groupBy("seq", "t").agg(F.flatten(F.transform(joints, lambda j: j["r"])).alias("x"))


def with_past(frames: DataFrame, history: int) -> DataFrame:
    """``frames`` with x1, x2.. up to ``history`` frames earlier and the frame after as y; last frames, which have none, go."""
    w = Window.partitionBy("seq").orderBy("t")
    held = frames.withColumns({"y": F.lead("x").over(w), **{f"x{k}": F.lag("x", k).over(w) for k in range(1, history + 1)}})
    return held.filter("y is not null")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of ``batches``, at most ROWS at a time: what a task computes with takes many times the room of its rows. No slice is empty."""
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            yield b.slice(k, ROWS)


def lists(a: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()))


def poses_of(column: pa.Array) -> np.ndarray:
    """[n, joints, 3, 3] of a list column; rows without a list are NaN."""
    flat, n = column.flatten().to_numpy(zero_copy_only=False), len(column)
    known = ~np.asarray(column.is_null())
    width = len(flat) // max(1, known.sum())
    out = np.full((n, width), np.nan)
    out[known] = flat.reshape(-1, width) if width else 0.0
    return out.reshape(n, -1, 3, 3)


def pasts(batch: pa.RecordBatch, history: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Row numbers and their pasts, by how many frames of the past are known."""
    held = [batch.column(f"x{k}") for k in range(history, 0, -1)]
    depth = sum((~np.asarray(c.is_null())).astype(int) for c in held) if held else np.zeros(batch.num_rows, int)
    for d in np.unique(depth):
        rows = np.flatnonzero(depth == d)
        taken = batch.take(pa.array(rows))
        yield rows, [poses_of(taken.column(f"x{k}" if k else "x")) for k in range(int(d), -1, -1)]


def one_step(frames: DataFrame, model: Motion) -> DataFrame:
    """(seq, t, error, log_density) of every step to frame t: the mean angle in radians between its joints and the expected ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            error, density = np.zeros(b.num_rows), np.full(b.num_rows, np.nan)
            true = poses_of(b.column("y"))
            for rows, past in pasts(b, model.history):
                error[rows] = K.angle(model.following(past), true[rows]).mean(axis=1)
                if np.all(model.deviation(past) > 0):
                    density[rows] = model.log_density(past, true[rows])
            yield pa.RecordBatch.from_arrays([b.column("seq"), b.column("to"), pa.array(error), pa.array(density)], ["seq", "t", "error", "log_density"])

    held = with_past(frames, model.history).withColumn("to", F.col("t") + 1)
    return held.mapInArrow(run, f"seq {dict(frames.dtypes)['seq']}, t {dict(held.dtypes)['to']}, error double, log_density double")


def rollout(frames: DataFrame, model: Motion, horizon: int, warm: int = 0) -> DataFrame:
    """(seq, t, error) of the ``horizon`` frames after the first 1 + ``warm``, predicted from these alone: predictions are fed back.

    A row a sequence, of 1 + warm + horizon frames at most, however long the sequence is.
    """
    first = frames.withColumn("nth", F.row_number().over(Window.partitionBy("seq").orderBy("t")) - 1).filter(F.col("nth") <= warm + horizon)
    rows = first.groupBy("seq").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("nth", "x"))), lambda f: f["x"])).alias("x"), F.count(F.lit(1)).cast("int").alias("n"), F.first(F.size("x")).alias("width"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lengths = b.column("n").to_numpy()
            for n in np.unique(lengths[lengths > warm + 1]):
                taken = b.take(pa.array(np.flatnonzero(lengths == n)))
                true = taken.column("x").flatten().to_numpy(zero_copy_only=False).reshape(taken.num_rows, n, -1, 3, 3)
                past, errors = [true[:, k] for k in range(warm + 1)], []
                for t in range(warm + 1, n):
                    past = [*past, model.following(past[-1 - model.history :])]
                    errors.append(K.angle(past[-1], true[:, t]).mean(axis=1))
                    past = past[-1 - model.history :]
                count = n - warm - 1
                yield pa.RecordBatch.from_arrays([taken.column("seq").take(pa.array(np.repeat(np.arange(taken.num_rows), count))), pa.array(np.tile(np.arange(warm + 1, n, dtype=np.int32), taken.num_rows)), pa.array(np.stack(errors, 1).ravel())], ["seq", "t", "error"])

    return rows.mapInArrow(run, f"seq {dict(frames.dtypes)['seq']}, t int, error double")


# --- fits ---------------------------------------------------------------------------------------


def clamped(std: np.ndarray, cap_deg: float | None) -> np.ndarray:
    floored = np.maximum(std, FLOOR)
    return floored if cap_deg is None else np.minimum(floored, math.radians(cap_deg))


def _rows(fit: DataFrame, name: str) -> np.ndarray:
    return np.array([[r[f"{name}{k}"] for k in range(3)] for r in sorted(fit.collect(), key=lambda r: r.joint)], dtype=float)


def deltas_of(poses: DataFrame) -> DataFrame:
    """``poses`` with the step d0..d2 from the frame before; null in first frames."""
    w = Window.partitionBy("seq", "joint").orderBy("t")
    held = poses.withColumns({f"p{k}": F.lag(f"r{k}").over(w) for k in range(9)})
    return R.with_left_delta(held, "p", "r", "d")


def fit_still(poses: DataFrame, std_deg: float | None = None, cap_deg: float | None = None) -> Motion:
    """Standing still; without ``std_deg`` under the cap, or without that the least spread."""
    joints = poses.agg(F.max("joint")).first()[0] + 1
    std = math.radians(std_deg) if std_deg is not None else math.radians(cap_deg) if cap_deg is not None else FLOOR
    return Motion(clamped(np.full((joints, 3), std), cap_deg))


def fit_drift(poses: DataFrame, cap_deg: float | None = None) -> Drift:
    fit = transitions.fit_random_walk(deltas_of(poses), cap_deg).cache()
    try:
        return Drift(_rows(fit, "std"), _rows(fit, "mean"))
    finally:
        fit.unpersist()


def fit_gated(poses: DataFrame, cap_deg: float | None = None, slow_deg: float = 1.5, low_deg: float = transitions.FLOOR_DEG) -> Gated:
    drift = fit_drift(poses, cap_deg)
    low = clamped(np.full_like(drift.spread, math.radians(low_deg)), cap_deg)
    return Gated(drift.spread, drift.drift, low, math.radians(slow_deg))


def fit_repeat(poses: DataFrame, cap_deg: float | None = None) -> Repeat:
    return Repeat(_rows(transitions.fit_constant_velocity(deltas_of(poses), cap_deg), "std"))


def examples(frames: DataFrame, history: int) -> DataFrame:
    """(x, y): features of every frame that has a next one, and the step to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            true, made = poses_of(b.column("y")), []
            for rows, past in pasts(b, history):
                made.append((rows, pose_features(past, history), steps(past[-1], true[rows]).reshape(len(rows), -1)))
            order = np.argsort(np.concatenate([r for r, _, _ in made]))
            columns = [np.concatenate([m[k] for m in made])[order] for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([lists(c) for c in columns], ["x", "y"])

    return with_past(frames, history).mapInArrow(run, "x array<double>, y array<double>")


def left_spread(pairs: DataFrame, predict: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The standard deviation, target by target, of what ``predict`` leaves of y given x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x, y = (c.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in (b.column("x"), b.column("y")))
            left = y - predict(x)
            k = np.arange(left.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.full(len(k), len(left))), pa.array(left.sum(0)), pa.array((left * left).sum(0))], ["k", "n", "s", "ss"])

    sums = pairs.select("x", "y").mapInArrow(run, "k int, n bigint, s double, ss double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    rows = sorted(sums.collect(), key=lambda r: r.k)
    return np.array([math.sqrt(max(0.0, r.ss / r.n - (r.s / r.n) ** 2)) for r in rows])


def fit_linear(poses: DataFrame, penalty: float = 1e-3, cap_deg: float | None = None) -> Linear:
    pairs = examples(frames_of(poses), 0)
    weights = ridge(pairs, "x", "y", penalty)
    left = left_spread(pairs, lambda x: x @ weights[:-1] + weights[-1])
    return Linear(clamped(left.reshape(-1, 3), cap_deg), weights)


# --- model tables -------------------------------------------------------------------------------

KINDS = {c.__name__: c for c in (Motion, Drift, Gated, Repeat, Linear, Net)}
TABLE = "name string, version string, published bigint, kind string, parameter string, shape array<int>, values array<double>"


def save(spark: SparkSession, model: Motion, path: str, name: str) -> str:
    """Publishes ``model`` in the table at ``path`` and returns its version.

    A version is one file, which appears under its name in one step, so readers see all of it
    or nothing; versions are never changed.
    """
    version, now = uuid.uuid4().hex, time.time_ns()
    rows = []
    for f in fields(model):
        value = np.asarray(getattr(model, f.name), dtype=float)
        rows.append((name, version, now, type(model).__name__, f.name, list(value.shape), value.ravel().tolist()))
    spark.createDataFrame(rows, TABLE).coalesce(1).write.mode("append").parquet(path)
    return version


def load(spark: SparkSession, path: str, name: str, version: str | None = None, kinds: dict[str, type[Motion]] = KINDS) -> Motion:
    """The model ``name`` of the given version, or of the one published last; ``kinds`` may name a user's own classes."""
    rows = spark.read.schema(TABLE).parquet(path).filter(F.col("name") == name)
    if version is None:
        last = rows.agg(F.max(F.struct("published", "version"))["version"].alias("v")).first().v
        version = last or ""
    found = rows.filter(F.col("version") == version).collect()
    if not found:
        raise LookupError(f"no model {name} {version or ''} in {path}".replace("  ", " "))
    if found[0].kind not in kinds:
        raise LookupError(f"unknown kind {found[0].kind}; known: {', '.join(kinds)}")
    values = {r.parameter: np.array(r["values"]).reshape(r.shape) for r in found}
    plain = {k: int(v) if k == "history" else float(v) if v.ndim == 0 else v for k, v in values.items()}
    return kinds[found[0].kind](**plain)
