"""Evaluations against the same sums in NumPy, and properties of variants and proposals."""

import numpy as np
import pytest

from gyrolake.functions import kernels as K
from gyrolake.operators import evaluation as E
from gyrolake.operators import particle_filter as P
from gyrolake.operators import proposals

FRAMES, JOINTS = 12, 3


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    steps = K.exp(rng.normal(0, 0.1, (FRAMES, JOINTS, 3)))
    truth = [np.broadcast_to(np.eye(3), (JOINTS, 3, 3))]
    for s in steps[1:]:
        truth.append(s @ truth[-1])
    truth = np.stack(truth)
    seen = K.exp(rng.normal(0, 0.2, (FRAMES, JOINTS, 3))) @ truth
    mask = rng.random((FRAMES, JOINTS)) < 0.7
    mask[0] = True
    err = np.degrees(K.angle(seen, truth))
    told = [(0, t, j, bool(mask[t, j]), 0.5 + 0.1 * j, float(err[t, j]), *map(float, truth[t, j].ravel()), *map(float, seen[t, j].ravel())) for t in range(FRAMES) for j in range(JOINTS)]
    schema = "seq long, t int, joint int, mask boolean, confidence double, err double, " + ", ".join(f"{p}{k} double" for p in "ro" for k in range(9))
    return spark.createDataFrame(told, schema), truth, seen, mask


def changes(x):
    v = K.log(x[1:] @ np.swapaxes(x[:-1], -1, -2))
    return np.diff(v, axis=0), np.diff(v, 2, axis=0)


def mean(v):
    return np.degrees(np.linalg.norm(v, axis=-1)).mean()


def test_metrics_against_numpy(rows):
    df, truth, seen, mask = rows
    options = P.Options(particles=16)
    estimates = P.run_filter(df, options)
    e = np.array([[r[f"e{k}"] for k in range(9)] for r in estimates.orderBy("t", "joint").collect()]).reshape(truth.shape)
    got = E.sequence_metrics(df, estimates, E.F.lit(options.particles), 11.0).first().asDict()
    far, held, back = np.degrees(K.angle(e, truth)), np.degrees(K.angle(truth, truth[:1])), np.zeros_like(mask)
    back[1:] = mask[1:] & ~mask[:-1]
    want = {"frames": FRAMES, "reappeared_joint_count": back.sum(), "filter_error_deg": far.mean(), "filter_observed_joint_error_deg": far[mask].mean(), "filter_occluded_joint_error_deg": far[~mask].mean(), "filter_reappeared_joint_error_deg": far[back].mean(), "persistence_error_deg": held.mean(), "persistence_occluded_joint_error_deg": held[~mask].mean()}
    (ta, tj), (oa, oj), (ea, ej) = changes(truth), changes(seen), changes(e)
    want |= {"observed_acceleration_deg": mean(oa), "observed_jerk_deg": mean(oj), "observed_acceleration_error_deg": mean(oa - ta), "observed_jerk_error_deg": mean(oj - tj)}
    want |= {"filter_acceleration_deg": mean(ea), "filter_jerk_error_deg": mean(ej - tj), "persistence_jerk_deg": 0.0, "persistence_acceleration_error_deg": mean(ta)}
    for name, value in want.items():
        assert got[name] == pytest.approx(value, abs=1e-6), name
    assert 1 <= got["min_ess"] <= got["mean_ess"] <= 16 and 0 <= got["collapse_fraction"] <= 1
    assert got["resample_fraction"] == pytest.approx(got["resample_count"] / FRAMES)


def test_short_sequences_have_no_jerk(rows):
    df = rows[0].filter("t < 3")
    told = {r.estimate: r for r in E.temporal_rows(df, {"observed": "o", "persistence": None}).collect()}
    assert told["observed"].acceleration_deg > 0 and told["observed"].jerk_deg is None and told["persistence"].jerk_error_deg is None


def test_variants_and_ablation(rows):
    runs = E.variants(P.Options(particles=8, shared_resampling=True), [8, 4, 4], [0.2], [True], [0.5, 0.9])
    assert [r[:2] for r in runs] == [("baseline", "baseline"), ("num_particles", "8"), ("num_particles", "4"), ("proposal_gain", "0"), ("proposal_gain", "0.2"), ("factorized_update", "false"), ("factorized_update", "true"), ("resample_threshold", "0.5"), ("resample_threshold", "0.9")]
    told = sorted(E.ablation(rows[0], runs, 11.0).collect(), key=lambda r: r.run)
    assert [(r.ablation, r.value) for r in told] == [r[:2] for r in runs]
    one = E.sequence_metrics(rows[0], P.run_filter(rows[0], runs[5][2]), E.F.lit(8), 11.0).first()
    assert told[5].filter_error_deg == pytest.approx(one.filter_error_deg) and told[0].filter_error_deg == pytest.approx(told[1].filter_error_deg)


def test_proposal(rows):
    df, truth, seen, mask = rows
    pairs = proposals.training_pairs(df).collect()
    still, steps = truth[:-1].reshape(1, -1, 3, 3), np.zeros((1, (FRAMES - 1) * JOINTS, 3))
    steps[0, JOINTS:] = K.log(truth[1:-1] @ np.swapaxes(truth[:-2], -1, -2)).reshape(-1, 3)
    confidence = np.tile(0.5 + 0.1 * np.arange(JOINTS), FRAMES - 1)
    x = proposals.features(still, steps, seen[1:].reshape(-1, 3, 3), mask[1:].ravel(), confidence)[0]
    assert np.allclose(sorted(map(tuple, x[:, :-1].round(6))), sorted(tuple(np.round(r.x, 6)) for r in pairs), atol=2e-6)
    weights, spread = proposals.fit(df)
    assert len(weights) == 3 * (proposals.FEATURES + 1) and spread > 0
    none = P.run_filter(df, P.Options(particles=16, gain=0.0)).orderBy("t", "joint").collect()
    zero = P.run_filter(df, P.Options(particles=16, gain=0.0, proposal=(0.0,) * len(weights))).orderBy("t", "joint").collect()
    assert np.allclose([r.e0 for r in none], [r.e0 for r in zero])
    capped = proposals.correction(weights, x[None], 0.01)
    assert np.linalg.norm(capped, axis=-1).max() <= 0.01 + 1e-12
