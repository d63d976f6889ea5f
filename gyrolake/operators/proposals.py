"""Learned corrections of predicted rotations towards the truth, given what is seen: a linear one, and a net.

The correction is a linear map, one for all joints, from what a filter knows of a joint (the
step to the observation, the prediction, the step before, visibility and confidence) to the
tangent vector from the prediction to the truth. It is fitted on predictions that stand still.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyrolake.functions import kernels as K
from gyrolake.functions import rotations as R
from gyrolake.operators import motions as M
from gyrolake.operators import training as T
from gyrolake.operators.smoothing import ridge
from gyrolake.plans.staging import staged

FEATURES = 14


def features(predicted: np.ndarray, step: np.ndarray, observed: np.ndarray, mask: np.ndarray, confidence: np.ndarray) -> np.ndarray:
    """[N, J, FEATURES + 1] for particles [N, J, 3, 3] and their last steps [N, J, 3]; the last feature is one."""
    seen, sure = mask.astype(float)[None, :, None], np.where(mask, confidence, 0.0)[None, :, None]
    towards = K.log(observed @ np.swapaxes(predicted, -1, -2))
    flags = [np.broadcast_to(f, (*towards.shape[:2], 1)) for f in (seen, sure, np.ones_like(seen))]
    return np.concatenate([seen * towards, sure * towards, K.log(predicted), step, *flags], axis=-1)


def training_pairs(measured: DataFrame) -> DataFrame:
    """(x, y): features and targets of every joint and frame after the first; ``measured`` has the truth in r0..r8."""
    w = Window.partitionBy("seq", "joint").orderBy("t")
    rows = measured.select("seq", "joint", "t", "mask", "confidence", *R.names("r"), *R.names("o"))
    rows = rows.withColumns({f"p{k}": F.lag(f"r{k}").over(w) for k in range(9)})
    rows = R.with_left_delta(rows, "p", "r", "d").withColumns({f"h{k}": F.coalesce(F.lag(f"d{k}").over(w), F.lit(0.0)) for k in range(3)})
    rows = R.with_log(R.with_left_delta(rows.filter("p0 is not null"), "p", "o", "b"), "p", "l")
    seen = F.col("mask").cast("double")
    sure = seen * F.col("confidence")
    x = [seen * F.col(f"b{k}") for k in range(3)] + [sure * F.col(f"b{k}") for k in range(3)] + R.cols("l", 3) + R.cols("h", 3) + [seen, sure]
    return rows.select(F.array(*x).alias("x"), F.array(*R.cols("d", 3)).alias("y"))


def fit(measured: DataFrame, penalty: float = 1e-3) -> tuple[tuple[float, ...], float]:
    """Weights [FEATURES + 1, 3], flattened, and the standard deviation of what they leave, over all three directions."""
    pairs = training_pairs(measured)
    weights = ridge(pairs, "x", "y", penalty)
    told = [reduce(add, (F.get("x", i) * float(weights[i, k]) for i in range(FEATURES)), F.lit(float(weights[-1, k]))) for k in range(3)]
    left = [F.avg(F.pow(F.get("y", k) - told[k], F.lit(2.0))) for k in range(3)]
    spread = pairs.agg(F.sqrt(reduce(add, left) / 3.0).alias("spread")).first().spread
    return tuple(map(float, weights.ravel())), float(spread)


def correction(weights: tuple[float, ...], x: np.ndarray, largest: float | None) -> np.ndarray:
    """Tangent vectors [N, J, 3] for the features, shortened to ``largest``."""
    delta = x @ np.reshape(weights, (FEATURES + 1, 3))
    if largest is None:
        return delta
    return delta * np.minimum(1.0, largest / np.maximum(np.linalg.norm(delta, axis=-1, keepdims=True), 1e-12))


@dataclass(frozen=True, eq=False)
class NetProposal:
    """A net from a whole predicted pose, the past and the measurements to tangent vectors towards the truth.

    ``spread`` [joints, 3] is what it leaves; corrections are drawn around the net's by ``noise`` times that,
    and shortened to ``cap``.
    """

    spread: np.ndarray
    moments: np.ndarray
    target_moments: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    history: int = 2
    noise: float = 1.0
    cap: float = math.inf

    def mean(self, x, past, observed, mask, confidence, sigma) -> np.ndarray:
        f = (net_features(x, past, observed, mask, confidence, sigma, self.history) - self.moments[0]) / self.moments[1]
        return ((np.tanh(f @ self.w1 + self.b1) @ self.w2 + self.b2) * self.target_moments[1] + self.target_moments[0]).reshape(len(x), -1, 3)

    def corrected(self, x, past, observed, mask, confidence, sigma, rng: np.random.Generator) -> np.ndarray:
        delta = self.mean(x, past, observed, mask, confidence, sigma)
        drawn = rng.normal(size=delta.shape) * self.spread * self.noise if self.noise > 0 else 0.0
        return K.exp(M.stabilised(delta + drawn, 1.0, self.cap)) @ x


def net_features(x: np.ndarray, past: list[np.ndarray], observed: np.ndarray, mask: np.ndarray, confidence: np.ndarray, sigma: np.ndarray, history: int) -> np.ndarray:
    """[n, features] of predictions [n, joints, 3, 3] whose past poses are ``past``, the latest last; measurements are of one frame, or one each."""
    n = len(x)
    rows = lambda a: np.broadcast_to(a, (n, x.shape[1])).astype(float)
    seen = rows(mask)
    towards = K.log(observed @ np.swapaxes(x, -1, -2)) * seen[:, :, None]
    parts = [K.log(x).reshape(n, -1), towards.reshape(n, -1), seen, rows(confidence) * seen, rows(sigma)]
    for k in range(1, history + 1):
        parts.append(M.steps(past[-k - 1], past[-k]).reshape(n, -1) if len(past) > k else np.zeros((n, 3 * x.shape[1])))
    return np.concatenate(parts, axis=1)


def net_examples(drawn: DataFrame, model: M.Motion, history: int) -> DataFrame:
    """(x, y) of every frame after the first of measured poses (seq, t, joint, r0..r8, o0..o8, mask, confidence, sigma): the model's prediction is to be corrected."""
    joint = F.array_sort(F.collect_list(F.struct("joint", F.array(*R.cols("r")).alias("r"), F.array(*R.cols("o")).alias("o"), F.array(F.col("mask").cast("double"), "confidence", "sigma").alias("m"))))
    frames = drawn.groupBy("seq", "t").agg(joint.alias("j")).select("seq", "t", *[F.flatten(F.transform("j", lambda s: s[c])).alias(n) for n, c in (("x", "r"), ("o", "o"), ("m", "m"))])
    w = Window.partitionBy("seq").orderBy("t")
    deep = max(history, model.history)
    held = frames.withColumns({**{f"x{k}": F.lag("x", k).over(w) for k in range(1, deep + 1)}, **{f"next_{c}": F.lead(c).over(w) for c in "xom"}}).filter("next_x is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in M.slices(batches):
            made = []
            for rows, past in M.pasts(b, deep):
                true, seen = (M.poses_of(b.column(f"next_{c}").take(pa.array(rows))) for c in "xo")
                told = b.column("next_m").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1, 3)
                predicted = model.following(past[-1 - model.history :])
                made.append((net_features(predicted, past, seen, told[:, :, 0], told[:, :, 1], told[:, :, 2], history), M.steps(predicted, true).reshape(len(rows), -1)))
            yield pa.RecordBatch.from_arrays([M.lists(np.concatenate([m[k] for m in made])) for k in (0, 1)], ["x", "y"])

    return held.mapInArrow(run, "x array<double>, y array<double>")


def fit_proposal(drawn: DataFrame, model: M.Motion, history: int = 2, how: T.Training = T.Training(hidden=128, rounds=200), cap_deg: float | None = None, noise: float = 1.0, largest: float = math.inf) -> tuple[NetProposal, list[float]]:
    """A net proposal for ``model``, trained on measurements drawn under any number of noises (see gyrolake.operators.experiments.drawn)."""
    t = T.trained(staged(net_examples(drawn, model, history), "proposal_examples"), how)
    return NetProposal(M.clamped(t.left.reshape(-1, 3), cap_deg), t.moments, t.target_moments, t.w1, t.b1, t.w2, t.b2, history, noise, largest), t.losses
