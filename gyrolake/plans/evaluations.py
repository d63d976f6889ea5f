"""Queries that evaluate estimates beside the truth; those with particles are random and have no SQL."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyrolake.functions import rotations as R
from gyrolake.operators import evaluation as E
from gyrolake.operators import particle_filter as P
from gyrolake.operators import proposals
from gyrolake.operators import smoothing as S
from gyrolake.plans.bindings import delta_sql, dist_sql
from gyrolake.plans.estimators import scored
from gyrolake.plans.staging import staged
from gyrolake.plans.streams import MEASURED_SQL, measured

QUERIES: dict = {}
NOISE_DEG = math.degrees(0.2)


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def five(x, name: str):
    return (F.round(x, 5) + 0.0).alias(name)


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(measured(spark, sf_dir).select("seq", "t", "joint", "mask", "confidence", "err", *R.names("r"), *R.names("o")), "measured")


_W = "WINDOW w AS (PARTITION BY seq, joint ORDER BY t)"


def _changes_sql(source: str, before: str, after: str) -> str:
    return f"{after} AS (SELECT *, " + ", ".join(f"{p}{before}{k} - lag({p}{before}{k}) OVER w AS {p}{after[0]}{k}" for p in "ro" for k in range(3)) + f" FROM {source} {_W})"


def _norm_sql(own: str, against: str | None = None) -> str:
    parts = [f"{own}{k}" if against is None else f"({own}{k} - {against}{k})" for k in range(3)]
    return "round(avg(degrees(sqrt(" + " + ".join(f"{x}*{x}" for x in parts) + "))),5)+0.0"


def _temporal_sql(name: str, own: str | None) -> str:
    columns = {
        "acceleration_deg": _norm_sql(f"{own}a") if own else "0.0::DOUBLE",
        "jerk_deg": _norm_sql(f"{own}j") if own else "0.0::DOUBLE",
        "acceleration_error_deg": _norm_sql(f"{own}a", "ra") if own else _norm_sql("ra"),
        "jerk_error_deg": _norm_sql(f"{own}j", "rj") if own else _norm_sql("rj"),
    }
    return f"SELECT seq, '{name}' AS estimate, " + ", ".join(f"{c} AS {n}" for n, c in columns.items()) + " FROM jerk GROUP BY seq"


TEMPORAL_SQL = (
    MEASURED_SQL
    + ", lagged AS (SELECT *, " + ", ".join(f"lag(r{k}) OVER w AS p{k}, lag(o{k}) OVER w AS s{k}" for k in range(9)) + f" FROM measured {_W}),"
    + delta_sql("lagged", "true_steps", "p{k}", "r{k}", "rv") + "," + delta_sql("true_steps", "all_steps", "s{k}", "o{k}", "ov")
    + ", " + _changes_sql("all_steps", "v", "acceleration") + ", " + _changes_sql("acceleration", "a", "jerk")
)


@register(f"WITH {TEMPORAL_SQL} {_temporal_sql('truth', 'r')} UNION ALL {_temporal_sql('observed', 'o')} UNION ALL {_temporal_sql('persistence', None)}")
def temporal_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceleration and jerk of the truth, the observations and a held pose, and how far they are from the truth's."""
    rows = E.temporal_rows(measured(spark, sf_dir), {"truth": "r", "observed": "o", "persistence": None})
    return rows.select("seq", "estimate", *[five(F.col(c), c) for c in E.temporal("r")])


_HELD = "avg(CASE WHEN {} THEN held END)"


@register(
    f"WITH {MEASURED_SQL}, f AS (SELECT *, " + ", ".join(f"first_value(r{k}) OVER (PARTITION BY seq, joint ORDER BY t) AS f{k}" for k in range(9)) + f" FROM erred), h AS (SELECT *, degrees({dist_sql('r{k}', 'f{k}')}) AS held, mask AND NOT coalesce(before, true) AS back FROM f) "
    "SELECT seq, max(t) + 1 AS frames, count(*) FILTER (back) AS reappeared_joint_count, round(avg(CASE WHEN mask THEN confidence END),5)+0.0 AS mean_confidence, round(sum(CASE WHEN mask THEN confidence*err END)/sum(CASE WHEN mask THEN confidence END),5)+0.0 AS observed_error_deg, round(avg(CASE WHEN mask THEN err END),5)+0.0 AS observed_joint_error_deg, "
    f"round(avg(held),5)+0.0 AS persistence_error_deg, round({_HELD.format('mask')},5)+0.0 AS persistence_observed_joint_error_deg, round({_HELD.format('NOT mask')},5)+0.0 AS persistence_occluded_joint_error_deg, round({_HELD.format('back')},5)+0.0 AS persistence_reappeared_joint_error_deg FROM h GROUP BY seq"
)
def sequence_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of an evaluation that need no filter."""
    seen = {n: c for n, c in E.measurement_columns(NOISE_DEG).items() if n != "mean_joint_noise_sigma_deg"}
    whole = [seen.pop(n).alias(n) for n in ("frames", "reappeared_joint_count")]
    return E.with_held(measured(spark, sf_dir)).groupBy("seq").agg(*whole, *[five(c, n) for n, c in (seen | E.split_errors("persistence", F.col("held"))).items()])


@register()
def filter_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of an evaluation: measurements, filter, held pose, smoothers, smoothness, particles."""
    rows, options = known(spark, sf_dir), P.Options(shared_resampling=True)
    estimates = staged(P.run_filter(rows, options), "estimates")
    told = E.sequence_metrics(rows, estimates, F.lit(options.particles), NOISE_DEG)
    setting = {"noise_deg": NOISE_DEG, "occlusion_prob": 0.25, "occlusion_model": "iid", "outlier_prob": 0.0, "outlier_fraction": 0.0, "confidence_calibrated_noise": False}
    setting |= {"num_particles": options.particles, "proposal_gain": options.gain, "factorized_update": True, "resample_threshold": options.threshold}
    told = told.withColumns({n: F.lit(v) for n, v in setting.items()})
    return told.join(E.smoother_errors(rows, {"smoother_ema": S.ema, "smoother_chordal": S.chordal, "savgol_tangent": S.savgol}), "seq")


@register()
def filter_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothness of the truth, the observations, a filter and a held pose, a row each."""
    rows = known(spark, sf_dir)
    both = rows.join(P.run_filter(rows, P.Options()).select("seq", "t", "joint", *R.names("e")), ["seq", "t", "joint"])
    return E.temporal_rows(both, {"truth": "r", "observed": "o", "filter": "e", "persistence": None})


@register()
def filter_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One option of the filter changed at a time; means over all sequences."""
    base = P.Options(particles=32, shared_resampling=True)
    runs = E.variants(base, particles=[16, 32, 64], gains=[0.0, 0.2], factorized=[False, True], thresholds=[0.5])
    return E.ablation(known(spark, sf_dir), runs, NOISE_DEG)


@register()
def particle_filter_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles corrected by a learned proposal after each prediction; each half of the sequences by what the other half taught."""

    def estimate(rows: DataFrame) -> DataFrame:
        half = F.pmod(F.xxhash64("seq"), F.lit(2))
        parts = []
        for k in range(2):
            weights, spread = proposals.fit(rows.filter(half != k))
            options = replace(P.Options(gain=0.0), proposal=weights, proposal_noise=0.5 * spread, proposal_cap=1.0)
            parts.append(P.run_filter(rows.filter(half == k), options))
        return parts[0].unionByName(parts[1])

    return scored(spark, sf_dir, estimate)
