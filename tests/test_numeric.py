import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gyrolake.functions import kernels as K
from gyrolake.functions import rotations as R
from gyrolake.operators import particle_filter as P
from gyrolake.operators import reporting as B
from gyrolake.operators import smoothing as S
from gyrolake.operators import splits
from gyrolake.operators.filtering import markov_rates


def vectors(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "i int, x double, y double, z double")


def test_exp_log_round_trip_in_all_regimes(spark):
    rng = np.random.default_rng(1)
    axis = rng.normal(size=(40, 3))
    axis /= np.linalg.norm(axis, axis=1, keepdims=True)
    angles = np.concatenate([[0.0, 1e-9, 1e-7], rng.uniform(0, 3, 30), [math.pi - 1e-7, math.pi - 1e-6, math.pi - 1e-4, 1.5, 2.5, 3.1, 3.14]])
    w = axis * angles[:, None]
    out = R.with_log(R.with_exp(vectors(spark, w), ["x", "y", "z"], "r"), "r", "v").orderBy("i").toPandas()
    r = out[R.names("r")].to_numpy().reshape(-1, 3, 3)
    assert np.allclose(r, K.exp(w), atol=1e-12) and np.allclose(np.einsum("nij,nkj->nik", r, r), np.eye(3), atol=1e-12)
    v = out[["v0", "v1", "v2"]].to_numpy()
    gap = np.abs(K.exp(v) - r).max(axis=(1, 2))
    assert gap[np.pi - angles > 1e-5].max() < 1e-6 and gap.max() < 1e-5  # the sign of an axis is free at a half turn
    assert np.allclose(v[:33], w[:33], atol=1e-6) and np.allclose(K.exp(K.log(r)), r, atol=1e-5)


def test_quaternions(spark):
    rng = np.random.default_rng(2)
    w = rng.normal(size=(60, 3)) * 2
    df = R.with_exp(vectors(spark, w), ["x", "y", "z"], "r")
    df = df.withColumns({f"q{k}": c for k, c in enumerate(R.to_quaternion(R.cols("r")))})
    df = df.withColumns({f"b{k}": c for k, c in enumerate(R.from_quaternion(R.cols("q")[:4]))})
    out = df.toPandas()
    q = out[[f"q{k}" for k in range(4)]].to_numpy()
    assert (q[:, 3] >= 0).all() and np.allclose(np.linalg.norm(q, axis=1), 1)
    assert np.allclose(out[R.names("b")].to_numpy(), out[R.names("r")].to_numpy(), atol=1e-9)


def test_null_is_no_distance(spark):
    df = spark.range(1).withColumns({**{f"a{k}": F.lit(None).cast("double") for k in range(9)}, **{f"b{k}": F.lit(1.0) for k in range(9)}})
    assert df.select(R.geodesic(R.cols("a"), R.cols("b"))).first()[0] is None


def test_confidence_sigma_falls(spark):
    df = spark.range(11).select((F.col("id") / 10).alias("c")).orderBy("c")
    s = [r[0] for r in df.select(R.confidence_sigma(F.col("c"), 0.02, 0.4)).collect()]
    assert s == sorted(s, reverse=True) and abs(s[0] - 0.4) < 1e-12 and abs(s[-1] - 0.02) < 1e-12


CASES = {("10.0", "0.0"): {"raw_measurement": 10, "persistence": 12, "gaussian_rw": 8, "savgol_tangent": 7}, ("20.0", "0.5"): {"raw_measurement": 20, "persistence": 15, "gaussian_rw": 12, "savgol_tangent": 13}}


def test_report_by_hand(spark):
    rows = [("d", "low_motion", n, o, m, float(e), 3) for (n, o), ms in CASES.items() for m, e in ms.items()]
    board = spark.createDataFrame(rows, "dataset string, motion_bin string, noise_deg string, occlusion_prob string, method string, err double, row_count long")
    first = {r.noise_deg: r.method for r in B.ranked(board).filter("rank = 1").collect()}
    assert first == {"10.0": "savgol_tangent", "20.0": "gaussian_rw"}
    walk = B.paper_summary(board).filter("method = 'gaussian_rw'").first()
    assert (walk.condition_count, walk.win_count, walk.mean_err, walk.method_class) == (2, 1, 10.0, "causal_online_filter")
    keys = ["target", "baseline"]
    pairs = B.compared(B.method_pairs(board), keys).filter("target = 'gaussian_rw'")
    got = {r.baseline: (r.win_count, r.loss_count, r.mean_improvement, r.sign_test_p) for r in pairs.collect()}
    assert got["raw_measurement"] == (2, 0, 5.0, 0.5) and got["savgol_tangent"] == (1, 1, 0.0, 1.0)
    claims = {r.baseline: r.e for r in pairs.select("baseline", B.evidence(F.when(F.col("baseline") == "raw_measurement", 2.0).otherwise(-1.0)).alias("e")).collect()}
    assert claims["raw_measurement"] == "strong_positive" and claims["savgol_tangent"] == "mixed"
    head = B.selector_headroom(board).first()
    assert (head.best_threshold, head.best_err, head.oracle, head.oracle_gaussian_count) == ("20.0", 10.0, 10.0, 2)


def moving(spark, frames=10, joints=3, seqs=2, hide=None):
    rows = []
    for s in range(seqs):
        for t in range(frames):
            for j in range(joints):
                r = K.exp(np.array([0.05 * t, -0.02 * t * (j + 1), 0.01 * s]))
                rows.append((s, t, j, *map(float, r.reshape(-1)), (t, j) != hide, 1.0))
    return spark.createDataFrame(rows, "seq long, t int, joint int, " + ", ".join(f"o{k} double" for k in range(9)) + ", mask boolean, confidence double")


@pytest.mark.parametrize("kind", ["global", "joint", "contiguous"])
def test_filter_follows_and_is_a_rotation(spark, kind):
    df = moving(spark, hide=(4, 1))
    out = P.run_filter(df, P.Options(particles=64, sigma=0.08, blocks=kind, outlier=0.01)).join(df, ["seq", "t", "joint"]).toPandas()
    e, o = (out[R.names(p)].to_numpy().reshape(-1, 3, 3) for p in "eo")
    assert np.allclose(np.linalg.det(e), 1) and np.degrees(K.angle(e, o)).mean() < 5
    assert out.ess.between(1, 64.0001).all() and len(out) == 60
    again = P.run_filter(df.repartition(5), P.Options(particles=64, sigma=0.08, blocks=kind, outlier=0.01)).agg(F.sum("e0")).first()[0]
    assert abs(again - out.e0.sum()) < 1e-9


def test_unknown_blocks():
    with pytest.raises(ValueError):
        P.partition("nose", 3)


def test_smoothers(spark):
    df = moving(spark, frames=9, hide=(4, 1))
    truth = {(r.seq, r.t, r.joint): np.array([r[f"o{k}"] for k in range(9)]) for r in df.collect()}
    far = lambda out: max(np.abs(truth[r.seq, r.t, r.joint] - [r[f"e{k}"] for k in range(9)]).max() for r in out.collect() if r.t in (4,))
    assert far(S.savgol(df)) < 1e-3
    tracked = S.ema(df, 1.0).collect()
    assert all(np.allclose([r[f"e{k}"] for k in range(9)], truth[r.seq, r.t, r.joint]) for r in tracked if (r.t, r.joint) != (4, 1))
    m = S.chordal(df, 3).toPandas()[R.names("e")].to_numpy().reshape(-1, 3, 3)
    assert np.allclose(np.linalg.det(m), 1) and np.allclose(m @ np.swapaxes(m, 1, 2), np.eye(3))


def test_ridge_recovers_a_linear_map(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4))
    w = rng.normal(size=(5, 2))
    y = np.concatenate([x, np.ones((200, 1))], axis=1) @ w
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], "x array<double>, y array<double>").repartition(3)
    assert np.allclose(S.ridge(df, "x", "y", 1e-9), w, atol=1e-6)


def test_splits_and_rates():
    assert splits.counts(10, 0.7, 0.15) == (7, 2) and sum(splits.counts(3, 0.7, 0.15)) == 2
    assert markov_rates(0) == (0.0, 1.0) and markov_rates(1) == (1.0, 0.0) and markov_rates(0.5) == (0.25, 0.25)


def test_savgol_against_one_fit_a_frame(spark):
    rng = np.random.default_rng(5)
    o = K.exp(np.cumsum(rng.normal(0, 0.1, (23, 2, 3)), axis=0))
    mask = rng.random((23, 2)) > 0.45
    rows = [(3, t, j, *map(float, o[t, j].reshape(-1)), bool(mask[t, j])) for t in range(23) for j in range(2)]
    df = spark.createDataFrame(rows, "seq long, t int, joint int, " + ", ".join(f"o{k} double" for k in range(9)) + ", mask boolean")
    got = {(r.t, r.joint): np.array([r[f"e{k}"] for k in range(9)]).reshape(3, 3) for r in S.savgol(df).collect()}
    for j in range(2):
        last = np.eye(3)
        for t in range(23):
            near = [k for k in range(max(0, t - 3), min(23, t + 4)) if mask[k, j]]
            if near:
                base = o[min(near, key=lambda k: (abs(k - t), k)), j]
                powers = np.vander(np.array(near) - t, min(2, len(near) - 1) + 1, increasing=True).astype(float)
                last = K.exp(np.linalg.lstsq(powers, K.log(o[near, j] @ base.T), rcond=None)[0][0]) @ base
            assert np.allclose(got[t, j], last, atol=1e-9), (t, j)


def test_estimators_of_the_whole_table(spark):
    from gyrolake.plans import estimators

    sf = "/root/testdata/sf0.01"
    for name in ("particle_filter_partitioned", "particle_filter_factorized", "particle_filter_fitted", "particle_filter_adaptive", "particle_filter_second_differences", "chordal_smoother", "savgol_smoother", "ema_smoother"):
        rows = estimators.QUERIES[name][0](spark, sf).collect()
        assert sorted(r.seq for r in rows) == list(range(10))
        assert all(0 < r.error_deg < 180 and 0 < r.observed_deg < 180 and 0 < r.occluded_deg < 180 for r in rows)
        assert name.startswith("ema") or sum(r.error_deg for r in rows) < sum(r.observed_deg for r in rows) * 3
    for r in estimators.filter_diagnostics(spark, sf).collect():
        assert 1 <= r.min_ess <= r.mean_ess <= P.Options().particles + 1e-6 and r.min_ess <= r.final_ess and 0 <= r.collapse_fraction <= 1


def test_learned_delta_against_numpy(spark):
    from gyrolake.plans import estimators
    from gyrolake.plans.bindings import vectors as pose_vectors

    rows = pose_vectors(spark, "/root/testdata/sf0.01").toPandas().sort_values(["seq", "t", "joint"])
    x, y = [], []
    for _, own in rows.groupby("seq"):
        v = K.log(K.exp(own[["x", "y", "z"]].to_numpy().reshape(-1, 21, 3))).reshape(-1, 63)
        x.append(v[:-1])
        y.append(v[1:] - v[:-1])
    x, y = np.concatenate(x), np.concatenate(y)
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    cost = 1e-3 * np.eye(64)
    cost[-1, -1] = 0
    got = np.array([r.weights for r in estimators.learned_delta_fit(spark, "/root/testdata/sf0.01").orderBy("feature").collect()])
    assert np.allclose(got, np.linalg.solve(x.T @ x + cost, x.T @ y), atol=1e-6)


def test_a_fitted_drift_carries_hidden_joints(spark):
    rows = []
    for t in range(20):
        for j in range(2):
            r = K.exp(np.array([0.1 * t, 0.02 * j, 0.0]))
            rows.append((0, t, j, *map(float, r.reshape(-1)), t < 10, 1.0))
    df = spark.createDataFrame(rows, "seq long, t int, joint int, " + ", ".join(f"o{k} double" for k in range(9)) + ", mask boolean, confidence double")
    fit = spark.createDataFrame([(j, 0.1, 0.0, 0.0, 0.01, 0.01, 0.01) for j in (1, 0)], "joint int, mean0 double, mean1 double, mean2 double, std0 double, std1 double, std2 double")
    plain = P.Options(particles=64, sigma=0.05)

    def error(options):
        out = P.run_filter(df, options).join(df, ["seq", "t", "joint"]).filter("t = 19").toPandas()
        return np.degrees(K.angle(*(out[R.names(p)].to_numpy().reshape(-1, 3, 3) for p in "eo"))).mean()

    moved = P.fitted(plain, fit)
    assert moved.spread == (0.01,) * 6 and moved.drift[:3] == (0.1, 0.0, 0.0)
    assert error(moved) < 6 and error(plain) > 40  # ten hidden steps of 5.7 degrees
    assert error(P.fitted(plain, fit, 0.01)) < 10 and error(P.fitted(plain, fit, 3.0)) > 40
    assert P.fitted(plain, fit.select("joint", "std0", "std1", "std2")).drift == ()


def test_a_baseline_is_no_worse_than_itself(spark):
    """The errors are drawn anew whenever the board is computed, as the last bits of a mean may be."""
    drawn = F.udf(lambda: float(np.random.default_rng().random()), "double").asNondeterministic()
    cells = spark.range(12).select(F.lit("a").alias("dataset"), F.lit("b").alias("motion_bin"), F.col("id").cast("string").alias("noise_deg"), F.lit("0").alias("occlusion_prob"))
    methods = spark.createDataFrame([("raw_measurement",), ("persistence",), ("ema",)], "method string")
    board = cells.crossJoin(methods).withColumns({"err": drawn(), "row_count": F.lit(1)})
    told = {r.method: r for r in B.paper_summary(board).collect()}
    assert told["raw_measurement"].mean_improvement_vs_raw == told["persistence"].mean_improvement_vs_persistence == 0.0
    assert told["raw_measurement"].worse_than_raw_count == told["persistence"].worse_than_persistence_count == 0
    unknown = board.withColumn("noise_deg", F.lit(None).cast("string"))
    assert B.with_baselines(unknown).count() == 0


def test_numbers_keep_the_sign_of_what_rounds_to_zero(spark):
    values = [(-0.003,), (0.003,), (-0.005,), (0.005,), (-1.236,), (1.236,), (0.0,), (None,), (float("nan"),), (float("-inf"),)]
    got = [r.x for r in spark.createDataFrame(values, "v double").select(B.number(F.col("v"), 2).alias("x")).collect()]
    assert got == ["-0.00", "0.00", "-0.01", "0.01", "-1.24", "1.24", "0.00", "", "", ""]


def test_straightened_finds_the_nearest_rotations():
    rng = np.random.default_rng(5)
    a, b = K.exp(rng.normal(0, 2.0, (40, 6, 3))), K.exp(rng.normal(0, 0.3, (40, 6, 3)))
    m = a @ b @ a
    m[3, 2] *= 1.02
    m[4] += rng.normal(0, 0.05, (6, 3, 3))
    m[5, 1] *= -1.0
    m[6] += rng.normal(0, 1e-9, (6, 3, 3))
    got = K.straightened(m)
    assert np.allclose(got, K.project(m), atol=1e-14) and np.allclose(np.linalg.det(got), 1.0, atol=1e-14)


@pytest.mark.parametrize("options", [P.Options(particles=24, velocity=True), P.Options(particles=24, velocity=True, spread=(0.05,) * 18)])
def test_a_repeated_step_takes_no_singular_values_of_particles(monkeypatch, options):
    """Of a frame only the six estimates are decomposed, not the 24 x 6 particles."""
    rng, sizes, svd = np.random.default_rng(1), [], np.linalg.svd
    monkeypatch.setattr(np.linalg, "svd", lambda m, *a, **k: (sizes.append(len(m.reshape(-1, 9))), svd(m, *a, **k))[1])
    state = None
    for t in range(30):
        state, estimate, *_ = P.step(state, K.exp(rng.normal(0, 0.5, (6, 3))), np.ones(6, bool), np.ones(6), t, 7, options)
    assert sizes == [6] * 30
    monkeypatch.undo()
    assert np.allclose(state["x"], K.project(state["x"]), atol=1e-12)


def test_variants_share_one_pass_over_the_measurements(spark):
    rows = spark.range(60).select((F.col("id") % 3).alias("seq"), (F.floor(F.col("id") / 6) % 10).cast("int").alias("t"), (F.floor(F.col("id") / 3) % 2).cast("int").alias("joint"), *[F.lit(1.0 if k % 4 == 0 else 0.0).alias(f"o{k}") for k in range(9)], F.lit(True).alias("mask"), F.lit(1.0).alias("confidence"))
    runs = [P.Options(particles=8), P.Options(particles=16, gain=0.0), P.Options(particles=8, blocks="global")]
    both = P.run_variants(rows, runs)
    plan = both._jdf.queryExecution().toString()
    assert "Generate" not in plan and "explode" not in plan and "REPARTITION_BY_NUM" in plan
    got = {(r.variant, r.seq, r.t, r.joint): r[4:] for r in both.collect()}
    for k, o in enumerate(runs):
        for r in P.run_filter(rows, o).collect():
            assert got.pop((k, r.seq, r.t, r.joint)) == r[3:]
    assert not got
