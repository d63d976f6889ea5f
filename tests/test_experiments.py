import numpy as np
import pytest
from pyspark.sql import functions as F

from gyrolake.functions import kernels as K
from gyrolake.functions import rotations as R
from gyrolake.operators import experiments as X
from gyrolake.operators import motions as M
from gyrolake.operators import particle_filter as P
from gyrolake.operators import training as T

SETTINGS = X.Settings(training=T.Training(hidden=6, rounds=40, rate=0.03))


def known_of(spark, n=8, frames=24, seed=0, joints=2):
    """Swinging joints, seen with noise."""
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(n):
        t = np.arange(frames)[:, None, None]
        r = K.exp(0.6 * np.sin(0.3 * t + s + np.arange(joints)[:, None]) * np.array([1.0, 0.3, 0.2]) + rng.normal(0, 0.005, (frames, joints, 3)))
        o = K.exp(rng.normal(0, 0.15, r.shape[:-1])) @ r
        hidden = rng.random((frames, joints)) < 0.2
        for f in range(frames):
            for j in range(joints):
                rows.append((s, f, j, *map(float, r[f, j].ravel()), *map(float, o[f, j].ravel()), bool(f == 0 or not hidden[f, j]), 0.9))
    df = spark.createDataFrame(rows, "seq long, t int, joint int, " + ", ".join(f"{p}{k} double" for p in "ro" for k in range(9)) + ", mask boolean, confidence double")
    return df.withColumn("err", F.degrees(R.geodesic(R.cols("o"), R.cols("r"))))


@pytest.fixture(scope="module")
def known(spark):
    return known_of(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def ran(known):
    names = ["persistence", "constant_velocity", "learned_delta", "history_mlp_delta"]
    return X.run(known, names, P.Options(particles=32, shared_resampling=True), 8.6, 6, train=0.5, val=0.25, fits=X.model_fits(SETTINGS))


def test_no_fit_sees_what_it_is_scored_on(known):
    """Changing every test sequence leaves the models as they were."""
    rows = X.split_rows(known, train=0.5, val=0.25)
    kinds = {r.split: r.n for r in rows.groupBy("split").agg(F.count_distinct("seq").alias("n")).collect()}
    assert kinds == {"train": 4, "val": 2, "test": 2}
    other = rows.withColumns({f"r{k}": F.when(F.col("split") == "train", F.col(f"r{k}")).otherwise(1.0 if k % 4 == 0 else 0.0) for k in range(9)})
    for name, fit in X.model_fits(SETTINGS).items():
        a, b = (fit(x.filter("split = 'train'").drop("split")) for x in (rows, other))
        past = [np.tile(K.exp(np.full((2, 3), 0.1 * k)), (2, 1, 1, 1)) for k in range(a.history + 1)]
        assert np.allclose(a.mean(past), b.mean(past), atol=1e-9) and np.allclose(a.spread, b.spread, atol=1e-9), name


def test_tables_of_a_run(ran, tmp_path):
    assert {r.split: (r.sequences, r.frames) for r in ran.splits.collect()} == {"train": (4, 96), "val": (2, 48), "test": (2, 48)}
    rows = {(r.model, r.metric): r.value for r in ran.transition_metrics.collect()}
    assert len(rows) == 8 and rows["constant_velocity", "one_step_error_deg"] < rows["persistence", "one_step_error_deg"]
    # without a step before the first pose, repeating the last step stands still
    assert abs(rows["constant_velocity", "rollout_error_deg"] - rows["persistence", "rollout_error_deg"]) < 1e-9
    filters = ran.filter_metrics.collect()
    assert len(filters) == 8 and {"filter_error_deg", "collapse_fraction", "observed_jerk_error_deg"} <= set(ran.filter_metrics.columns)
    told = {r.model: r for r in ran.comparison.collect()}
    for name, r in told.items():
        mean = np.mean([f.filter_error_deg for f in filters if f.model == name])
        assert abs(r.filter_error_deg - mean) < 1e-9 and r.one_step_error_deg == rows[name, "one_step_error_deg"]
    assert [n for n, r in told.items() if r.best] == [min(told, key=lambda n: told[n].filter_error_deg)]
    ran.write(str(tmp_path))
    spark = ran.splits.sparkSession
    assert spark.read.parquet(str(tmp_path / "comparison")).count() == 4
    assert M.load(spark, str(tmp_path / "models"), "history_mlp_delta").history == 2


def test_transition_metrics_count_by_length(known, spark):
    uneven = known.filter("seq < 2 and (seq = 0 or t < 5)")
    model = {"still": M.Motion(np.ones((2, 3)))}
    d = {}
    rows = uneven.orderBy("seq", "t", "joint").collect()
    at = {(r.seq, r.t, r.joint): np.array([r[f"r{k}"] for k in range(9)]).reshape(3, 3) for r in rows}
    for s, t, j in at:
        if t:
            d[s, t, j] = np.degrees(K.angle(at[s, t, j], at[s, t - 1, j]))
    got = {r.metric: r.value for r in X.transition_metrics(uneven, model, 3).collect()}
    assert abs(got["one_step_error_deg"] - np.mean(list(d.values()))) < 1e-8
    far = [np.degrees(K.angle(at[s, t, j], at[s, 0, j])) for s, t, j in at if 1 <= t <= 3]
    assert abs(got["rollout_error_deg"] - np.mean(far)) < 1e-8


def test_unknown_models_are_named(known):
    with pytest.raises(ValueError, match="unknown models other"):
        X.fitted(known, ["persistence", "other"])


def test_a_users_own_model(known):
    class Turn(M.Motion):
        def mean(self, past):
            return np.broadcast_to([0.1, 0.0, 0.0], (*past[-1].shape[:2], 3))

    mine = {**X.model_fits(), "turn": lambda poses: Turn(np.full((2, 3), 0.05))}
    rows = X.step_errors(known.filter("seq = 0"), X.fitted(known, ["turn"], mine)).collect()
    assert len(rows) == 1 and rows[0].steps == 23 and rows[0].log_density is not None


def test_grid_shares_measurements_and_tells_noise(known):
    grid = X.Grid((2.0, 20.0), (0.0, 0.5), (1, 2))
    rows = X.drawn(known, grid)
    cells = {r.cell: r for r in rows.groupBy("cell", "noise_deg", "occlusion_prob", "seed").agg(F.avg("err").alias("err"), F.avg((~F.col("mask")).cast("int")).alias("hidden"), F.count_distinct("key").alias("keys")).collect()}
    assert len(cells) == 8 and all(c.keys == 8 for c in cells.values())
    for c in cells.values():
        assert abs(c.err / c.noise_deg - 1.6) < 0.15  # the mean length of three normal numbers
        assert c.hidden == 0 if c.occlusion_prob == 0 else abs(c.hidden - 0.5 * 23 / 24) < 0.08
    models = {"persistence": M.Motion(np.full((2, 3), 0.1)), "repeat": M.Repeat(np.full((2, 3), 0.1))}
    told = X.grid_metrics(known.filter("seq < 3"), models, P.Options(particles=8), X.Grid((2.0, 20.0), (0.5,), (1,)))
    per = told.collect()
    assert len(per) == 2 * 2 * 3 and {r.seq for r in per} == {0, 1, 2} and len({(r.cell, r.seq, round(r.observed_error_deg, 9)) for r in per}) == 6
    means = X.means(told, ["noise_deg", "model"]).collect()
    assert len(means) == 4 and all(abs(m.filter_error_deg - np.mean([r.filter_error_deg for r in per if (r.noise_deg, r.model) == (m.noise_deg, m.model)])) < 1e-9 for m in means)


def test_alignment_and_detector_rows(known):
    truth = known.select("seq", "t", "joint", *R.names("r"))
    seen = known.filter("seq <> 3 and (seq <> 4 or t < 7) and (seq <> 5 or t < 1)").select("seq", "t", "joint", *R.names("o"), "mask", "confidence", F.lit(0.15).alias("sigma"))
    both, told = X.aligned(truth, seen.filter("t < 20"))
    assert {r.seq: (r.frames, r.problem) for r in told.collect()} == {0: (20, None), 1: (20, None), 2: (20, None), 3: (None, "missing"), 4: (7, None), 5: (1, "too few frames"), 6: (20, None), 7: (20, None)}
    rows = {r.seq: r for r in X.detector_metrics(both, P.Options(particles=32, sigma=0.15)).collect()}  # first particles scatter by the options' sigma
    assert rows.keys() == {0, 1, 2, 4, 6, 7} and rows[4].frames == 7
    constant = {r.seq: r for r in X.detector_metrics(both.withColumn("sigma", F.lit(None).cast("double")), P.Options(particles=32, sigma=0.15)).collect()}
    for s, r in rows.items():
        assert abs(r.filter_error_deg - constant[s].filter_error_deg) < 1e-9 and abs(r.mean_sigma_deg - np.degrees(0.15)) < 1e-9
        mine = both.filter(F.col("seq") == s).toPandas()
        assert abs(r.observed_joint_error_deg - mine.err[mine["mask"]].mean()) < 1e-9
