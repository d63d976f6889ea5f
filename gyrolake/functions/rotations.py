"""Rotations as columns: a 3x3 matrix is a list of nine columns, row by row; a tangent vector one of three.

Everything is an expression of built-in functions, so a chain of these stays in generated
code. Angles are radians. Steps that are used more than once are made columns first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL = 1e-6
NEAR_PI = 1e-5


def names(prefix: str, n: int = 9) -> list[str]:
    return [f"{prefix}{k}" for k in range(n)]


def cols(prefix: str, n: int = 9) -> list[Column]:
    return [F.col(c) for c in names(prefix, n)]


def clamp(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """``x`` within [low, high]; null stays null, which greatest and least alone would not keep."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def norm(v: list[Column]) -> Column:
    return F.sqrt(sum((x * x for x in v[1:]), v[0] * v[0]))


def skew(v: list[Column]) -> list[Column]:
    x, y, z = v
    o = F.lit(0.0)
    return [o, -z, y, z, o, -x, -y, x, o]


def unskew(m: list[Column]) -> list[Column]:
    return [(m[7] - m[5]) * 0.5, (m[2] - m[6]) * 0.5, (m[3] - m[1]) * 0.5]


def transpose(m: list[Column]) -> list[Column]:
    return [m[3 * j + i] for i in range(3) for j in range(3)]


def matmul(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)]


def with_exp(df: DataFrame, v: list[str], out: str) -> DataFrame:
    """Adds out0..out8, the rotation of the tangent vector in columns ``v`` (Rodrigues, series near zero)."""
    x, y, z = (F.col(c) for c in v)
    s, t, a, b = (F.col(f"__{k}") for k in "stab")
    steps = df.withColumn("__s", x * x + y * y + z * z).withColumn("__t", F.sqrt("__s"))
    steps = steps.withColumns(
        {
            "__a": F.when(t < SMALL, 1.0 - s / 6.0 + s * s / 120.0).otherwise(F.try_divide(F.sin(t), t)),
            "__b": F.when(t < SMALL, 0.5 - s / 24.0 + s * s / 720.0).otherwise(F.try_divide(1.0 - F.cos(t), s)),
        }
    )
    r = [1.0 - b * (y * y + z * z), b * x * y - a * z, b * x * z + a * y, b * x * y + a * z, 1.0 - b * (x * x + z * z), b * y * z - a * x, b * x * z - a * y, b * y * z + a * x, 1.0 - b * (x * x + y * y)]
    return steps.withColumns(dict(zip(names(out), r, strict=True))).drop("__s", "__t", "__a", "__b")


def with_log(df: DataFrame, m: str, out: str) -> DataFrame:
    """Adds out0..out2, the tangent vector of the rotation in m0..m8; the axis near a half turn comes from the largest diagonal."""
    r = cols(m)
    v = [r[7] - r[5], r[2] - r[6], r[3] - r[1]]
    t = F.col("__t")
    steps = df.withColumn("__t", F.acos(clamp((r[0] + r[4] + r[8] - 1.0) / 2.0)))
    regular = F.when(t < SMALL, F.lit(0.5)).otherwise(F.try_divide(t, 2.0 * F.sin(t)))
    root = lambda k: F.sqrt(F.greatest((r[4 * k] + 1.0) / 2.0, F.lit(0.0)))
    mixed = lambda i, j: (r[3 * i + j] + r[3 * j + i]) / 4.0
    axes = []
    for k in range(3):
        axes.append([root(k) if j == k else F.try_divide(mixed(k, j), root(k)) for j in range(3)])
    first = (r[0] >= r[4]) & (r[0] >= r[8])
    second = r[4] >= r[8]
    axis = [F.when(first, axes[0][j]).when(second, axes[1][j]).otherwise(axes[2][j]) for j in range(3)]
    steps = steps.withColumns(dict(zip(("__x", "__y", "__z"), axis, strict=True)))
    unit = F.try_divide(t, norm([F.col("__x"), F.col("__y"), F.col("__z")]))
    near = (math.pi - t) <= NEAR_PI
    value = {f"{out}{j}": F.when(near, F.col(c) * unit).otherwise(regular * v[j]) for j, c in enumerate(("__x", "__y", "__z"))}
    return steps.withColumns(value).drop("__t", "__x", "__y", "__z")


def geodesic(a: list[Column], b: list[Column]) -> Column:
    """The angle between two rotations."""
    trace = sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])
    return F.acos(clamp((trace - 1.0) / 2.0))


def with_left_delta(df: DataFrame, current: str, following: str, out: str) -> DataFrame:
    """Adds out0..out2 = log(following x current transposed)."""
    product = matmul(cols(following), transpose(cols(current)))
    return with_log(df.withColumns(dict(zip(names("__m"), product, strict=True))), "__m", out).drop(*names("__m"))


def clip_tangent(v: list[Column], largest: float | None) -> list[Column]:
    """``v`` shortened to ``largest``; no limit where that is None, not positive or not finite."""
    if largest is None or largest <= 0 or not math.isfinite(largest):
        return v
    scale = F.least(F.lit(1.0), F.lit(largest) / F.greatest(norm(v), F.lit(1e-12)))
    return [x * scale for x in v]


def canonical(q: list[Column]) -> list[Column]:
    """A quaternion (x, y, z, w) of unit norm and w >= 0; null where it has no length."""
    length = norm(q)
    sign = F.when(q[3] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return [F.when(length > 1e-12, F.try_divide(x * sign, length)) for x in q]


def to_quaternion(r: list[Column]) -> list[Column]:
    """(x, y, z, w) by the largest of the trace and the diagonal, with w >= 0."""
    trace = r[0] + r[4] + r[8]
    s = [F.sqrt(F.greatest(e, F.lit(0.0))) * 2.0 for e in (trace + 1.0, 1.0 + r[0] - r[4] - r[8], 1.0 + r[4] - r[0] - r[8], 1.0 + r[8] - r[0] - r[4])]
    over = lambda x, k: F.try_divide(x, s[k])
    cases = [
        [over(r[7] - r[5], 0), over(r[2] - r[6], 0), over(r[3] - r[1], 0), 0.25 * s[0]],
        [0.25 * s[1], over(r[1] + r[3], 1), over(r[2] + r[6], 1), over(r[7] - r[5], 1)],
        [over(r[1] + r[3], 2), 0.25 * s[2], over(r[5] + r[7], 2), over(r[2] - r[6], 2)],
        [over(r[2] + r[6], 3), over(r[5] + r[7], 3), 0.25 * s[3], over(r[3] - r[1], 3)],
    ]
    pick = lambda j: F.when(trace > 0, cases[0][j]).when((r[0] > r[4]) & (r[0] > r[8]), cases[1][j]).when(r[4] > r[8], cases[2][j]).otherwise(cases[3][j])
    return canonical([pick(j) for j in range(4)])


def from_quaternion(q: list[Column]) -> list[Column]:
    x, y, z, w = q
    return [
        1.0 - 2.0 * (y * y + z * z), 2.0 * (x * y - z * w), 2.0 * (x * z + y * w),
        2.0 * (x * y + z * w), 1.0 - 2.0 * (x * x + z * z), 2.0 * (y * z - x * w),
        2.0 * (x * z - y * w), 2.0 * (y * z + x * w), 1.0 - 2.0 * (x * x + y * y),
    ]


def confidence_sigma(confidence: Column, low: float, high: float, gamma: float = 1.0, mask: Column | None = None) -> Column:
    """sigma^2 = low^2 + (1 - c)^gamma (high^2 - low^2); hidden joints get ``high``."""
    sigma = F.sqrt(F.greatest(F.lit(low * low) + F.pow(1.0 - clamp(confidence, 0.0, 1.0), F.lit(gamma)) * (high * high - low * low), F.lit(1e-16)))
    return sigma if mask is None else F.when(mask, sigma).otherwise(F.lit(high))


def finite(x: Column) -> Column:
    """``x``, or null where it is null, NaN or infinite."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def uniform(*key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone, the same in every engine and partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in key])), 1, 8), 16, 10).cast("double") / 4294967296.0


def normal(*key: Column) -> Column:
    """A standard normal number of the key, by Box-Muller."""
    u, v = uniform(*key, F.lit("u")), uniform(*key, F.lit("v"))
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2.0 * math.pi * v)
