"""Particle filters over sequences of partly hidden rotations, in batch and as a stream.

A sequence's past is its state, so frames of one sequence meet in one task, in order, and
sequences run side by side. A task reads them in batches and holds one frame and the particles,
however long a sequence is. One step function serves both forms; its random numbers depend on
(seed, sequence, frame) alone, so results do not depend on how frames arrive.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolake.functions import kernels as K
from gyrolake.operators import proposals
from gyrolake.operators.blocks import checked
from gyrolake.operators.motions import Motion
from gyrolake.plans.staging import tasks

ESTIMATES = "seq long, t int, joint int, " + ", ".join(f"e{k} double" for k in range(9)) + ", ess double, resampled boolean, spread_deg double"
OBSERVED = [f"o{k}" for k in range(9)]


@dataclass(frozen=True)
class Options:
    """``blocks`` are the groups of joints that share weights, by name or as lists (see gyrolake.operators.blocks).

    ``shared_resampling`` gives every block the same ancestors, drawn by the mean weights.
    ``outlier`` mixes a floor into the likelihood, ``gain`` pulls predictions to what is seen,
    ``velocity`` repeats the last step instead of standing still. ``drift`` and ``spread`` are a
    fitted model's mean step and its standard deviation, three numbers a joint in order of the
    joints; without them particles stand still under ``noise``. With ``slow``, an angle,
    particles whose last step was shorter, or that made none yet, stand still. ``model`` is a model
    of motion in place of all these; particles keep as many past poses as it looks at. ``sigma`` is
    the noise where the measurements do not tell it. ``proposal`` holds the weights of a learned correction (see gyrolake.operators.proposals), which follows every
    prediction under ``proposal_noise`` and is at most ``proposal_cap`` long; ``corrector`` is a
    trained net in its place.
    """

    particles: int = 128
    noise: float = 0.05
    sigma: float = 0.2
    gain: float = 0.2
    threshold: float = 0.5
    blocks: str | tuple[tuple[int, ...], ...] = "joint"
    shared_resampling: bool = False
    outlier: float = 0.0
    velocity: bool = False
    drift: tuple[float, ...] = ()
    spread: tuple[float, ...] = ()
    slow: float | None = None
    model: Motion | None = None
    proposal: tuple[float, ...] = ()
    proposal_noise: float = 0.0
    proposal_cap: float | None = None
    corrector: proposals.NetProposal | None = None
    seed: int = 0


def fitted(options: Options, fit: DataFrame, slow: float | None = None) -> Options:
    """``options`` with the model of ``fit`` (joint, std0..2 and, if it drifts, mean0..2), one row a joint."""
    rows = sorted(fit.collect(), key=lambda r: r.joint)
    numbers = lambda name: tuple(float(r[f"{name}{k}"]) for r in rows for k in range(3)) if f"{name}0" in fit.columns else ()
    return replace(options, drift=numbers("mean"), spread=numbers("std"), slow=slow)


def partition(kind: str | tuple[tuple[int, ...], ...], joints: int) -> list[np.ndarray]:
    return _partition(kind if isinstance(kind, str) else tuple(map(tuple, kind)), joints)


@cache
def _partition(kind: str | tuple[tuple[int, ...], ...], joints: int) -> list[np.ndarray]:
    return [np.array(b) for b in checked(kind, joints)]


def resample(w: np.ndarray, u: float) -> np.ndarray:
    upto = np.cumsum(w)
    upto[-1] = 1.0
    return np.searchsorted(upto, (u + np.arange(len(w))) / len(w))


def step(state: dict | None, observed: np.ndarray, mask: np.ndarray, confidence: np.ndarray, t: int, key: int, o: Options, sigma: np.ndarray | None = None) -> tuple[dict, np.ndarray, float, bool, float]:
    """The state after frame ``t``, its estimate [J, 3, 3], effective size, whether particles were redrawn, and their spread in degrees.

    ``sigma`` [J] is the frame's noise, NaN where it is the options'. The state holds the particles
    ``x``, their log weights and ``past``, their earlier poses, oldest first; all are redrawn together.
    """
    sigma = np.full(len(observed), o.sigma) if sigma is None else np.where(np.isnan(sigma), o.sigma, sigma)
    rng = np.random.default_rng([o.seed, key % (1 << 63), t])
    joints, n = len(observed), o.particles
    c = np.where(mask, confidence, 0.0)
    parts = partition(o.blocks, joints)
    noise = None if o.model else K.exp(rng.normal(0, np.reshape(o.spread, (joints, 3)) if o.spread else o.noise, (n, joints, 3)))
    if state is None:
        start = np.where((c > 0)[:, None, None], observed, np.eye(3))
        x, past, lw = K.exp(rng.normal(0, max(0.25 * o.sigma, 1e-6), (n, joints, 3))) @ start, [], np.zeros((len(parts), n))
        stepped = np.zeros((n, joints, 3))
    else:
        x, past, lw = state["x"], state["past"], state["lw"]
        last = past[-1] if past else None
        stepped = K.log(x @ np.swapaxes(last, -1, -2)) if o.proposal and last is not None else np.zeros((n, joints, 3))
        # products of products drift off the rotations, so a repeated step is projected back
        moved = K.straightened((x @ np.swapaxes(last, -1, -2)) @ x) if o.velocity and last is not None else x
        if o.drift:
            drifted = K.exp(np.reshape(o.drift, (joints, 3))) @ moved
            still = np.zeros(n, bool) if o.slow is None else np.ones(n, bool) if last is None else K.angle(x, last).mean(axis=1) < o.slow
            moved = np.where(still[:, None, None, None], moved, drifted)
        keep = max(1, o.model.history if o.model else 1, o.corrector.history if o.corrector else 1)
        past, x = [*past, x][-keep:], o.model.drawn([*past, x][-1 - o.model.history :], rng) if o.model else noise @ moved
    if o.proposal:
        delta = proposals.correction(o.proposal, proposals.features(x, stepped, observed, mask, confidence), o.proposal_cap)
        drawn = rng.normal(0, o.proposal_noise, delta.shape) if o.proposal_noise > 0 else 0.0
        x = K.exp(delta + drawn) @ x
    if o.corrector and past:
        x = o.corrector.corrected(x, past, observed, mask, c, sigma, rng)
    if o.gain > 0:
        x = K.exp(o.gain * c[None, :, None] * K.log(observed @ np.swapaxes(x, -1, -2))) @ x
    ll = -0.5 * (K.angle(x, observed) / np.maximum(sigma, 1e-8)) ** 2
    if o.outlier > 0:
        ll = np.logaddexp(np.log1p(-o.outlier) + ll, np.log(o.outlier))
    told = (ll * c).T
    lw = lw + np.add.reduceat(told[np.concatenate(parts)], np.cumsum([0, *map(len, parts[:-1])]), axis=0)
    w = np.exp(lw - lw.max(axis=1, keepdims=True))
    w /= w.sum(axis=1, keepdims=True)
    of_joint = np.empty(joints, int)
    for b, p in enumerate(parts):
        of_joint[p] = b
    estimate = K.project(np.einsum("jn,njab->jab", w[of_joint], x))
    ess = 1 / (w * w).sum(axis=1)
    spread = float(np.degrees(K.angle(x, estimate)).mean())
    lw = np.log(w + 1e-300)
    us = rng.random(len(parts))
    held = [x, *past]
    if o.shared_resampling:
        due = np.full(len(parts), ess.mean() < o.threshold * n)
        if due.any():
            ancestors = resample(w.mean(axis=0), us[0])
            held, lw = [a[ancestors] for a in held], np.zeros_like(lw)
    else:
        due = ess < o.threshold * n
        if due.any():
            rows = np.repeat(np.arange(n)[:, None], joints, axis=1)  # each joint's ancestors
            for b in np.flatnonzero(due):
                rows[:, parts[b]] = resample(w[b], us[b])[:, None]
            held = [a[rows, np.arange(joints)] for a in held]
            lw[due] = 0.0
    return {"x": held[0], "past": held[1:], "lw": lw}, estimate, float(ess.mean()), bool(due.any()), spread


NOISE = "sigma"
INPUT = ["t", "joint", *OBSERVED, "mask", "confidence", NOISE]


def _picked(measured: DataFrame, *keys) -> DataFrame:
    """What the filter reads; ``sigma``, the noise of a joint and frame, may be missing or null."""
    noise = F.col(NOISE).cast("double") if NOISE in measured.columns else F.lit(None).cast("double")
    return measured.select(*keys, F.col("t").cast("int").alias("t"), F.col("joint").cast("int").alias("joint"), *[F.col(c).cast("double").alias(c) for c in OBSERVED], F.coalesce("mask", F.lit(False)).alias("mask"), F.col("confidence").cast("double").alias("confidence"), noise.alias(NOISE))


class _Sequence:
    """Frames of one sequence, taken in pieces that may end inside a frame."""

    def __init__(self, seq: int, options: Options, state: dict | None = None):
        self.key, self.options, self.state = xxhash.xxh64_intdigest(str(seq)), options, state
        self.open: list[np.ndarray] = []

    def take(self, rows: np.ndarray) -> list[np.ndarray]:
        """Rows of INPUT in order of frames and joints; the finished frames as rows t, joint, e0..e8, ess, resampled, spread."""
        done, cuts = [], np.flatnonzero(np.diff(rows[:, 0])) + 1
        for piece in np.split(rows, cuts):
            if self.open and self.open[0][0, 0] != piece[0, 0]:
                done.append(self.finish())
            self.open.append(piece)
        return done

    def finish(self) -> np.ndarray:
        frame = np.concatenate(self.open)
        self.open = []
        t, mask = int(frame[0, 0]), frame[:, 11] != 0
        self.state, estimate, ess, redrawn, spread = step(self.state, frame[:, 2:11].reshape(-1, 3, 3), mask, frame[:, 12], t, self.key, self.options, frame[:, 13])
        told = np.broadcast_to([ess, redrawn, spread], (len(frame), 3))
        return np.concatenate([frame[:, :2], estimate.reshape(-1, 9), told], axis=1)


def _estimates(keys: dict[str, int], rows: list[np.ndarray]) -> pa.RecordBatch:
    a = np.concatenate(rows)
    columns = {k: pa.array(np.full(len(a), v), pa.int32() if k == "variant" else pa.int64()) for k, v in keys.items()}
    columns |= {"t": pa.array(a[:, 0].astype(np.int32)), "joint": pa.array(a[:, 1].astype(np.int32)), **{f"e{k}": pa.array(a[:, 2 + k]) for k in range(9)}}
    columns |= {"ess": pa.array(a[:, 11]), "resampled": pa.array(a[:, 12] != 0), "spread_deg": pa.array(a[:, 13])}
    return pa.RecordBatch.from_pydict(columns)


def _in_order(measured: DataFrame, variants: list[Options], schema: str) -> DataFrame:
    """Filters sequences side by side, every one under all ``variants`` in the same pass over its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own = None, []

        def told(k: int, frames: list[np.ndarray]) -> pa.RecordBatch:
            return _estimates({"variant": k, "seq": current} if numbered else {"seq": current}, frames)

        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("seq").to_numpy()
            values = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in INPUT], axis=1)
            for piece in np.split(values, np.flatnonzero(ids[1:] != ids[:-1]) + 1):
                at, ids = int(ids[0]), ids[len(piece) :]
                if at != current:
                    for k, o in enumerate(own):
                        yield told(k, [o.finish()])
                    current, own = at, [_Sequence(at, o) for o in variants]
                for k, o in enumerate(own):
                    if done := o.take(piece):
                        yield told(k, done)
        for k, o in enumerate(own):
            yield told(k, [o.finish()])

    numbered = schema.startswith("variant")
    rows = _picked(measured, F.col("seq").cast("long").alias("seq"))
    # a sequence is little to read and much to filter, so parts of a few bytes are not joined again
    dealt = rows.repartition(tasks(rows.sparkSession), "seq").sortWithinPartitions("seq", "t", "joint")
    return dealt.mapInArrow(run, schema)


def run_filter(measured: DataFrame, options: Options = Options()) -> DataFrame:
    """ESTIMATES of every frame and joint of ``measured`` (seq, t, joint, o0..o8, mask, confidence and, if known, sigma)."""
    return _in_order(measured, [options], ESTIMATES)


def run_variants(measured: DataFrame, variants: list[Options]) -> DataFrame:
    """run_filter under several options side by side, told apart by ``variant``, their place in the list."""
    return _in_order(measured, variants, "variant int, " + ESTIMATES)


def stream_filter(measured: DataFrame, options: Options = Options()) -> DataFrame:
    """The same over a stream whose batches bring whole frames, each sequence's in order; particles are kept as state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        own = _Sequence(int(key[0]), options, pickle.loads(state.get[0]) if state.exists else None)
        rows = pd.concat(list(batches)).sort_values(["t", "joint"])
        done = own.take(rows[INPUT].to_numpy(float))
        told = _estimates({"seq": int(key[0])}, [*done, own.finish()])
        state.update((pickle.dumps(own.state),))
        yield told.to_pandas()

    return _picked(measured, "seq").groupBy("seq").applyInPandasWithState(run, ESTIMATES, "held binary", "append", "NoTimeout")


def diagnostics(estimates: DataFrame, particles: int) -> DataFrame:
    """Per sequence: mean, least and last effective size, shares of redrawn and of collapsed frames."""
    frames = estimates.groupBy("seq", "t").agg(*[F.first(c).alias(c) for c in ("ess", "resampled", "spread_deg")])
    collapsed = (F.col("ess") <= 0.05 * particles) | (F.col("spread_deg") <= 0.25)
    return frames.groupBy("seq").agg(F.avg("ess").alias("mean_ess"), F.min("ess").alias("min_ess"), F.max_by("ess", "t").alias("final_ess"), F.count_if("resampled").alias("resample_count"), F.avg(collapsed.cast("int")).alias("collapse_fraction"))
