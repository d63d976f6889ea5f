"""What an evaluation reports of estimates beside the truth: errors by visibility, smoothness, the state of the particles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyrolake.functions import rotations as R
from gyrolake.operators.particle_filter import Options, run_variants
from gyrolake.plans.staging import staged

KEYS = ("seq",)


def with_changes(df: DataFrame, prefixes: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``df`` with the acceleration <p>a0..2 and the jerk <p>j0..2 of the rotations <p>0..8, for every prefix."""
    w = Window.partitionBy(*keys, "joint").orderBy("t")
    for p in prefixes:
        df = df.withColumns({f"__b{k}": F.lag(f"{p}{k}").over(w) for k in range(9)})
        df = R.with_left_delta(df, "__b", p, f"{p}v").drop(*R.names("__b"))
        df = df.withColumns({f"{p}a{k}": F.col(f"{p}v{k}") - F.lag(f"{p}v{k}").over(w) for k in range(3)})
        df = df.withColumns({f"{p}j{k}": F.col(f"{p}a{k}") - F.lag(f"{p}a{k}").over(w) for k in range(3)})
    return df


def temporal(prefix: str | None, truth: str = "r") -> dict[str, Column]:
    """Mean norms in degrees of acceleration and jerk, and of their differences from the truth's; None stands for a held pose."""

    def mean(kind: str, against: bool) -> Column:
        true = R.cols(f"{truth}{kind}", 3)
        own = R.cols(f"{prefix}{kind}", 3) if prefix else [x * 0.0 for x in true]
        return F.avg(F.degrees(R.norm([a - b for a, b in zip(own, true, strict=True)] if against else own)))

    return {
        "acceleration_deg": mean("a", False),
        "jerk_deg": mean("j", False),
        "acceleration_error_deg": mean("a", True),
        "jerk_error_deg": mean("j", True),
    }


def temporal_rows(df: DataFrame, estimates: dict[str, str | None], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, estimate, temporal columns): a row for each named estimate."""
    told = [F.struct(F.lit(name).alias("estimate"), *[c.alias(n) for n, c in temporal(p).items()]) for name, p in estimates.items()]
    needed = list(dict.fromkeys(["r", *filter(None, estimates.values())]))
    wide = with_changes(df, needed, keys).groupBy(*keys).agg(F.array(*told).alias("rows"))
    return wide.select(*keys, F.inline("rows"))


def with_held(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``df`` with ``held``, the error in degrees of the first true pose, and ``back``, whether a joint is seen again."""
    w = Window.partitionBy(*keys, "joint").orderBy("t")
    first = df.withColumns({f"__f{k}": F.first(f"r{k}").over(w) for k in range(9)})
    back = F.col("mask") & ~F.coalesce(F.lag("mask").over(w), F.lit(True))
    return first.withColumns({"held": F.degrees(R.geodesic(R.cols("r"), R.cols("__f"))), "back": back}).drop(*R.names("__f"))


def split_errors(name: str, error: Column) -> dict[str, Column]:
    """Mean errors over all joints, seen ones, hidden ones and those seen again."""
    return {
        f"{name}_error_deg": F.avg(error),
        f"{name}_observed_joint_error_deg": F.avg(F.when(F.col("mask"), error)),
        f"{name}_occluded_joint_error_deg": F.avg(F.when(~F.col("mask"), error)),
        f"{name}_reappeared_joint_error_deg": F.avg(F.when(F.col("back"), error)),
    }


def measurement_columns(noise_deg: float) -> dict[str, Column]:
    """Frames, confidence and errors of what is seen, under one noise for all joints."""
    mask, err, c = F.col("mask"), F.col("err"), F.col("confidence")
    return {
        "frames": F.max("t") + 1,
        "mean_confidence": F.avg(F.when(mask, c)),
        "mean_joint_noise_sigma_deg": F.lit(noise_deg),
        "observed_error_deg": F.try_divide(F.sum(F.when(mask, c * err)), F.sum(F.when(mask, c))),
        "observed_joint_error_deg": F.avg(F.when(mask, err)),
        "reappeared_joint_count": F.count_if("back"),
    }


def health(estimates: DataFrame, particles: Column, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, effective sizes, redrawn frames, spreads, share of collapsed frames) of a filter's estimates."""
    frames = estimates.groupBy(*keys, "t").agg(*[F.first(c).alias(c) for c in ("ess", "resampled", "spread_deg")], F.first(particles).alias("n"))
    collapsed = (F.col("ess") <= 0.05 * F.col("n")) | (F.col("spread_deg") <= 0.25)
    sizes = {f"{f}_{name}": a(c) for c, name in (("ess", "ess"), ("spread_deg", "particle_spread_deg")) for f, a in (("mean", F.avg), ("min", F.min), ("final", lambda x: F.max_by(x, "t")))}
    redrawn = {"resample_count": F.count_if("resampled"), "resample_fraction": F.avg(F.col("resampled").cast("int"))}
    return frames.groupBy(*keys).agg(*[c.alias(n) for n, c in (sizes | redrawn | {"collapse_fraction": F.avg(collapsed.cast("int"))}).items()])


def sequence_metrics(known: DataFrame, estimates: DataFrame, particles: Column, noise_deg: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row a sequence: errors of the observations, of the filter and of a held pose, their smoothness, and the particles' state.

    ``known`` (seq, t, joint, mask, confidence, err, r0..r8, o0..o8) has the truth, ``estimates`` what a filter
    made of it; ``keys`` tell runs over the same measurements apart. Rows without an estimate do not count.
    What depends on the measurements alone is told once, however many runs there are.
    """
    at, changes = ["seq", "t", "joint"], lambda p: [f"{p}{c}{k}" for c in "aj" for k in range(3)]
    covered = known.join(estimates.select(*at), at, "left_semi")
    own = with_changes(with_held(covered), ["r", "o"]).select(*at, *R.names("r"), "mask", "confidence", "err", "held", "back", *changes("r"), *changes("o"))
    both = own.join(with_changes(estimates.select(*keys, "t", "joint", *R.names("e")), ["e"], keys).select(*keys, "t", "joint", *R.names("e"), *changes("e")), at)
    error = F.degrees(R.geodesic(R.cols("e"), R.cols("r")))
    columns = measurement_columns(noise_deg) | split_errors("filter", error) | split_errors("persistence", F.col("held"))
    for name, prefix in (("observed", "o"), ("filter", "e"), ("persistence", None)):
        columns |= {f"{name}_{n}": c for n, c in temporal(prefix).items()}
    told = both.groupBy(*keys).agg(*[c.alias(n) for n, c in columns.items()])
    return told.join(health(estimates, particles, keys), [*keys])


def smoother_errors(known: DataFrame, smoothers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(seq, <name>_error_deg...): the mean error of every smoother."""
    truth = known.select("seq", "t", "joint", *R.names("r"))
    out = None
    for name, smooth in smoothers.items():
        error = F.avg(F.degrees(R.geodesic(R.cols("e"), R.cols("r")))).alias(f"{name}_error_deg")
        one = smooth(known).join(truth, ["seq", "t", "joint"]).groupBy("seq").agg(error)
        out = one if out is None else out.join(one, "seq")
    return out


def variants(base: Options, particles: list[int], gains: list[float], factorized: list[bool], thresholds: list[float]) -> list[tuple[str, str, Options]]:
    """(axis, value, options): the baseline, then one axis at a time; values in order, each once."""

    def weighed(on: bool) -> Options:
        return replace(base, blocks="joint" if on else "global", shared_resampling=on)

    out = [("baseline", "baseline", base)]
    out += [("num_particles", str(n), replace(base, particles=n)) for n in [base.particles, *particles]]
    out += [("proposal_gain", f"{g:g}", replace(base, gain=g)) for g in [0.0, base.gain, *gains]]
    out += [("factorized_update", str(on).lower(), weighed(on)) for on in [False, base.blocks != "global", *factorized]]
    out += [("resample_threshold", f"{x:g}", replace(base, threshold=x)) for x in [base.threshold, *thresholds]]
    return list(dict.fromkeys(out))


def ablation(known: DataFrame, runs: list[tuple[str, str, Options]], noise_deg: float) -> DataFrame:
    """Means over sequences of the metrics of every run; all run side by side, options that occur twice once."""
    distinct = list(dict.fromkeys(o for _, _, o in runs))
    particles = F.get(F.array(*[F.lit(o.particles) for o in distinct]), F.col("variant"))
    estimates = staged(run_variants(known, distinct), "estimates")
    per = sequence_metrics(known, estimates, particles, noise_deg, ("variant", "seq"))
    means = per.groupBy("variant").agg(*[F.avg(c).alias(c) for c in per.columns if c not in ("variant", "seq", "frames")])
    named = [F.struct(F.lit(k).alias("run"), F.lit(a).alias("ablation"), F.lit(v).alias("value"), F.lit(o.particles).alias("num_particles"), F.lit(float(o.gain)).alias("proposal_gain"), F.lit(o.blocks != "global").alias("factorized_update"), F.lit(float(o.threshold)).alias("resample_threshold"), F.lit(distinct.index(o)).alias("of")) for k, (a, v, o) in enumerate(runs)]
    told = means.select("*", F.inline(F.filter(F.array(*named), lambda r: r["of"] == F.col("variant"))))
    first = ["run", "ablation", "value", "num_particles", "proposal_gain", "factorized_update", "resample_threshold"]
    return told.select(*first, *[c for c in means.columns if c != "variant"])
