"""Offline smoothers of visible rotations, and the learned step as a ridge regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyrolake.functions import kernels as K
from gyrolake.functions import rotations as R

OUT = "seq long, joint int, t int, " + ", ".join(f"e{k} double" for k in range(9))


def projected(df: DataFrame, matrix: str, out: str = "e") -> DataFrame:
    """Replaces the nine columns matrix0.. by out0.., the nearest rotation."""
    source = R.names(matrix)
    kept = [c for c in df.columns if c not in source]
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n in kept) + "".join(f", {c} double" for c in R.names(out))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in source], -1).reshape(-1, 3, 3)
            e = K.project(m).reshape(-1, 9) if len(m) else m.reshape(-1, 9)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(e[:, k]) for k in range(9)], [*kept, *R.names(out)])

    return df.mapInArrow(project, schema)


def chordal(measured: DataFrame, width: int = 5) -> DataFrame:
    """Centred chordal means of the visible frames; a window without any keeps the last estimate, at first the identity."""
    w = Window.partitionBy("seq", "joint").orderBy("t")
    near = w.rowsBetween(-(width // 2), width // 2)
    sums = measured.select("seq", "joint", "t", *[F.sum(F.when(F.col("mask"), F.col(f"o{k}"))).over(near).alias(f"s{k}") for k in range(9)])
    held = sums.select("seq", "joint", "t", *[F.coalesce(F.last(f"s{k}", ignorenulls=True).over(w), F.lit(1.0 if k % 4 == 0 else 0.0)).alias(f"s{k}") for k in range(9)])
    return projected(held, "s")


def _per_sequence(measured: DataFrame, smooth) -> DataFrame:
    """Applies ``smooth`` to a sequence's observations [T, J, 3, 3] and mask [T, J]; rows that are not there are hidden."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        times, t = np.unique(rows["t"].to_numpy(), return_inverse=True)
        joints, j = np.unique(rows["joint"].to_numpy(), return_inverse=True)
        o, mask = np.broadcast_to(np.eye(3), (len(times), len(joints), 3, 3)).copy(), np.zeros((len(times), len(joints)), bool)
        o[t, j] = rows[[f"o{k}" for k in range(9)]].to_numpy().reshape(-1, 3, 3)
        mask[t, j] = rows["mask"].to_numpy(bool)
        told = pd.DataFrame(smooth(o, mask)[t, j].reshape(-1, 9), columns=R.names("e"))
        told.insert(0, "t", rows["t"].to_numpy())
        told.insert(0, "joint", rows["joint"].to_numpy())
        told.insert(0, "seq", key[0])
        return told

    return measured.select("seq", "joint", "t", "mask", *[f"o{k}" for k in range(9)]).groupBy("seq").applyInPandas(run, OUT)


def savgol(measured: DataFrame, width: int = 7, degree: int = 2) -> DataFrame:
    """A polynomial through the visible tangents of a centred window, at the frame; with too few, a lower degree.

    The value at the frame is a fixed sum of the tangents for each pattern of visible
    frames, so all frames and joints of a sequence are done at once.
    """
    half = width // 2
    offsets = np.arange(-half, half + 1)

    def weights(seen: np.ndarray) -> np.ndarray:
        out, near = np.zeros(width), offsets[seen]
        if len(near):
            out[seen] = np.linalg.pinv(np.vander(near, min(degree, len(near) - 1) + 1, increasing=True).astype(float))[0]
        return out

    def smooth(o: np.ndarray, mask: np.ndarray) -> np.ndarray:
        frames, joints = mask.shape
        at = np.arange(frames)[:, None] + offsets
        inside = (at >= 0) & (at < frames)
        at = at.clip(0, frames - 1)
        seen = (mask[at] & inside[:, :, None]).transpose(0, 2, 1).reshape(-1, width)
        near = o[at].transpose(0, 2, 1, 3, 4).reshape(-1, width, 3, 3)
        base = near[np.arange(len(near)), np.where(seen, np.abs(offsets), width).argmin(axis=1)]
        patterns, which = np.unique(seen, axis=0, return_inverse=True)
        rows = np.stack([weights(x) for x in patterns])[which.ravel()]
        tangent = K.log(near @ np.swapaxes(base, -1, -2)[:, None])
        value = K.exp((rows[:, :, None] * np.where(seen[:, :, None], tangent, 0.0)).sum(axis=1)) @ base
        value = value.reshape(frames, joints, 3, 3)
        known = seen.any(axis=1).reshape(frames, joints)
        last = np.maximum.accumulate(np.where(known, np.arange(frames)[:, None], -1), axis=0)
        held = value[last.clip(0), np.arange(joints)]
        held[last < 0] = np.eye(3)
        return held

    return _per_sequence(measured, smooth)


def ema(measured: DataFrame, alpha: float = 0.35) -> DataFrame:
    """Causal exponential mean on the rotations; hidden frames repeat the state, the identity before the first."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")

    def smooth(o: np.ndarray, mask: np.ndarray) -> np.ndarray:
        out, state, started = np.empty_like(o), np.broadcast_to(np.eye(3), o.shape[1:]).copy(), np.zeros(o.shape[1], bool)
        for t in range(len(o)):
            moved = K.exp(alpha * K.log(o[t] @ np.swapaxes(state, -1, -2))) @ state
            state = np.where(mask[t][:, None, None], np.where(started[:, None, None], moved, o[t]), state)
            started |= mask[t]
            out[t] = state
        return out

    return _per_sequence(measured, smooth)


def ridge(pairs: DataFrame, features: str, targets: str, penalty: float = 1e-3) -> np.ndarray:
    """Weights [features + 1, targets] of a linear map between two array columns; the last row is the bias, not penalised.

    Tasks sum up the normal equations; only these, of a size set by the columns, are collected.
    """

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xx = xy = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.array(c.flatten()).reshape(batch.num_rows, -1) for c in batch.columns)
            x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            xx, xy = (x.T @ x, x.T @ y) if xx is None else (xx + x.T @ x, xy + x.T @ y)
        if xx is not None:
            yield pa.RecordBatch.from_pydict({"xx": [xx.tobytes()], "xy": [xy.tobytes()], "n": [len(xx)]}, schema=pa.schema([("xx", pa.binary()), ("xy", pa.binary()), ("n", pa.int32())]))

    parts = pairs.select(features, targets).mapInArrow(gram, "xx binary, xy binary, n int").collect()
    if not parts:
        raise ValueError("no rows to fit")
    n = parts[0].n
    xx = sum(np.frombuffer(p.xx).reshape(n, n) for p in parts)
    xy = sum(np.frombuffer(p.xy).reshape(n, -1) for p in parts)
    cost = penalty * np.eye(n)
    cost[-1, -1] = 0.0
    return np.linalg.solve(xx + cost, xy)
