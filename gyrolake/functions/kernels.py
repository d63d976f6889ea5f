"""Rotation kernels on NumPy arrays (..., 3, 3), for the operators that are sequential in time."""

from __future__ import annotations

import numpy as np


def exp(w: np.ndarray) -> np.ndarray:
    x, y, z = np.ascontiguousarray(w.reshape(-1, 3).T)
    xx, yy, zz = x * x, y * y, z * z
    s = xx + yy + zz
    t = np.sqrt(s)
    small = t < 1e-6
    if small.any():
        safe = np.where(small, 1.0, t)
        a = np.where(small, 1 - s / 6 + s * s / 120, np.sin(safe) / safe)
        b = np.where(small, 0.5 - s / 24 + s * s / 720, (1 - np.cos(safe)) / (safe * safe))
    else:
        a, b = np.sin(t) / t, (1 - np.cos(t)) / s
    xy, xz, yz = b * x * y, b * x * z, b * y * z
    x, y, z = a * x, a * y, a * z
    r = np.stack([1 - b * (yy + zz), xy - z, xz + y, xy + z, 1 - b * (xx + zz), yz - x, xz - y, yz + x, 1 - b * (xx + yy)], axis=-1)
    return r.reshape(*w.shape[:-1], 3, 3)


def log(r: np.ndarray) -> np.ndarray:
    c = np.ascontiguousarray(r.reshape(-1, 9).T)
    t = np.arccos(np.minimum(np.maximum((c[0] + c[4] + c[8] - 1) / 2, -1), 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        half = np.where(t < 1e-6, 0.5, t / (2 * np.sin(t)))
    out = np.stack([(c[7] - c[5]) * half, (c[2] - c[6]) * half, (c[3] - c[1]) * half], axis=-1).reshape(*r.shape[:-2], 3)
    t = t.reshape(r.shape[:-2])
    near = np.pi - t <= 1e-5
    if near.any():
        sym = (r[near] + np.swapaxes(r[near], -1, -2)) / 2 + np.eye(3)
        k = np.einsum("nii->ni", sym).argmax(-1)
        axis = sym[np.arange(len(k)), k]
        out[near] = axis / np.linalg.norm(axis, axis=-1, keepdims=True) * t[near][:, None]
    return out


def project(m: np.ndarray) -> np.ndarray:
    """The nearest rotations."""
    u, _, vt = np.linalg.svd(m)
    u[..., -1] *= np.sign(np.linalg.det(u @ vt))[..., None]
    return u @ vt


def straightened(m: np.ndarray) -> np.ndarray:
    """``project``, by one Newton step for matrices that are rotations but for rounding, whose nearest one it finds to the last digits."""
    c = np.ascontiguousarray(m.reshape(-1, 9).T)
    gram = {(i, j): c[i] * c[j] + c[3 + i] * c[3 + j] + c[6 + i] * c[6 + j] for i in range(3) for j in range(i, 3)}
    off = np.max([np.abs(g - 1.0 if i == j else g) for (i, j), g in gram.items()], axis=0)
    out = np.empty_like(c)
    for i in range(3):
        for j in range(3):
            out[3 * i + j] = 1.5 * c[3 * i + j] - 0.5 * sum(c[3 * i + k] * gram[min(k, j), max(k, j)] for k in range(3))
    out = out.T.reshape(m.shape)
    far = ~(off < 1e-8).reshape(m.shape[:-2])  # NaN too
    mirrored = (c[0] * (c[4] * c[8] - c[5] * c[7]) - c[1] * (c[3] * c[8] - c[5] * c[6]) + c[2] * (c[3] * c[7] - c[4] * c[6]) < 0).reshape(far.shape)
    if (far | mirrored).any():
        out[far | mirrored] = project(m[far | mirrored])
    return out


def angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip((np.einsum("...ij,...ij->...", a, b) - 1) / 2, -1, 1))
