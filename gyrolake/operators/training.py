"""Gradient training of a small net over a table of examples, the gradients summed in the tasks.

A round is one pass: every task adds up the gradient of its rows, the sums of many tasks meet in
a few groups, and the driver, which holds weights alone, takes one step of Adam. Rows are never
moved, and all count in every round; the result is the same for every number of partitions, but
for the order in which floats are added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolake.operators.motions import Net, clamped, examples, frames_of, left_spread, slices
from gyrolake.plans.staging import staged

GROUPS = 16  # of tasks, whose sums the driver collects


@dataclass(frozen=True)
class Training:
    hidden: int = 96
    rounds: int = 300
    rate: float = 1e-2
    decay: float = 1e-4
    seed: int = 0
    floor: float = 1e-6  # of the features' standard deviations


def moments(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """[2, features] and [2, targets]: mean and standard deviation of x and y, and the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            z = np.concatenate([c.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in (b.column("x"), b.column("y"))], axis=1)
            width = len(b.column("x").flatten()) // b.num_rows
            mean = z.mean(0)
            k = np.arange(z.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.full(len(k), width)), pa.array(np.full(len(k), len(z))), pa.array(mean), pa.array(((z - mean) ** 2).sum(0))], ["k", "width", "n", "mean", "m2"])

    parts = pairs.select("x", "y").mapInArrow(run, "k int, width bigint, n bigint, mean double, m2 double")
    # sums of squares about each batch's own mean, brought to the common one
    told = parts.groupBy("k").agg(F.first("width").alias("width"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.sum("m2").alias("m2"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("nmm"))
    rows = sorted(told.collect(), key=lambda r: r.k)
    if not rows:
        raise ValueError("no rows to fit")
    both = np.array([[r.mean for r in rows], [np.sqrt(max(0.0, (r.m2 + r.nmm) / r.n - r.mean**2)) for r in rows]])
    return both[:, : rows[0].width], both[:, rows[0].width :], rows[0].n


def start(features: int, hidden: int, targets: int, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    layer = lambda a, b: rng.normal(0.0, np.sqrt(2.0 / max(1, a + b)), (a, b))
    w1 = layer(features, hidden)
    return [w1, np.zeros(hidden), layer(hidden, targets), np.zeros(targets)]


def gradient(x: np.ndarray, y: np.ndarray, weights: list[np.ndarray]) -> tuple[float, list[np.ndarray]]:
    """The sum of squared errors of standardised rows, and its gradient."""
    w1, b1, w2, b2 = weights
    hidden = np.tanh(x @ w1 + b1)
    left = hidden @ w2 + b2 - y
    back = (2.0 * left @ w2.T) * (1.0 - hidden * hidden)
    return float((left * left).sum()), [x.T @ back, back.sum(0), hidden.T @ (2.0 * left), 2.0 * left.sum(0)]


def gradient_sum(pairs: DataFrame, weights: list[np.ndarray], at: np.ndarray, to: np.ndarray) -> tuple[float, np.ndarray]:
    """``gradient`` over all rows of ``pairs``, flattened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, total = 0.0, np.zeros(sum(w.size for w in weights))
        for b in slices(batches):
            x, y = (c.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in (b.column("x"), b.column("y")))
            part, grads = gradient((x - at[0]) / at[1], (y - to[0]) / to[1], weights)
            loss += part
            total += np.concatenate([g.ravel() for g in grads])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()), pa.array([loss]), pa.array([total.tobytes()])], ["part", "loss", "g"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(g.as_py()) for g in rows["g"])
        return pa.table({"loss": [sum(rows["loss"].to_pylist())], "g": [total.tobytes()]})

    sums = pairs.select("x", "y").mapInArrow(run, "part int, loss double, g binary")
    told = sums.groupBy("part").applyInArrow(add, "loss double, g binary").collect()
    return sum(r.loss for r in told), sum(np.frombuffer(r.g) for r in told)


def adam(weights: list[np.ndarray], gradient_of, rounds: int, rate: float, decay: float) -> list[float]:
    """``rounds`` steps in place; ``gradient_of(weights)`` gives (mean loss, flat gradient). Returns the losses."""
    first, second, losses = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], []
    cuts = np.cumsum([w.size for w in weights])[:-1]
    for k in range(1, rounds + 1):
        loss, flat = gradient_of(weights)
        losses.append(loss)
        for w, m, v, g in zip(weights, first, second, np.split(flat, cuts), strict=True):
            g = g.reshape(w.shape) + (decay * w if w.ndim == 2 else 0.0)  # biases do not decay
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return losses


@dataclass(frozen=True)
class Trained:
    """A net's moments and weights, what it leaves of the targets, and the loss of every round."""

    moments: np.ndarray
    target_moments: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    left: np.ndarray
    losses: list[float]


def trained(pairs: DataFrame, how: Training) -> Trained:
    """A net from x to y, for staged ``pairs`` (x, y)."""
    at, to, n = moments(pairs)
    at[1], to[1] = np.maximum(at[1], how.floor), clamped(to[1], None)
    weights = start(at.shape[1], how.hidden, to.shape[1], how.seed)

    def mean_gradient(w: list[np.ndarray]) -> tuple[float, np.ndarray]:
        loss, flat = gradient_sum(pairs, w, at, to)
        return loss / (n * to.shape[1]), flat / (n * to.shape[1])

    losses = adam(weights, mean_gradient, how.rounds, how.rate, how.decay)
    w1, b1, w2, b2 = weights
    left = left_spread(pairs, lambda x: (np.tanh((x - at[0]) / at[1] @ w1 + b1) @ w2 + b2) * to[1] + to[0])
    return Trained(at, to, w1, b1, w2, b2, left, losses)


def fit_net(poses: DataFrame, history: int = 0, how: Training = Training(), cap_deg: float | None = None, scale: float = 1.0, step_cap: float = np.inf) -> tuple[Net, list[float]]:
    """A net from a pose (and its last ``history`` steps) to the next step, and the loss of every round."""
    t = trained(staged(examples(frames_of(poses), history), "examples"), how)
    return Net(clamped(t.left.reshape(-1, 3), cap_deg), t.moments, t.target_moments, t.w1, t.b1, t.w2, t.b2, scale, step_cap, history=history), t.losses
