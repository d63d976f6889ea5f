"""Queries of whole experiments over moving poses: split, fits on training sequences, scores on test sequences, grids, detector files."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyrolake.functions import rotations as R
from gyrolake.operators import blocks, proposals
from gyrolake.operators import evaluation as E
from gyrolake.operators import experiments as X
from gyrolake.operators import motions as M
from gyrolake.operators import particle_filter as P
from gyrolake.operators import training as T
from gyrolake.operators import transitions
from gyrolake.plans.bindings import MOVING_SQL, POSES_SQL, delta_sql, dist_sql, exp_sql, moving, table
from gyrolake.plans.estimators import scored
from gyrolake.plans.evaluations import _HELD, five
from gyrolake.plans.sourced import new_folder, written
from gyrolake.plans.staging import staged
from gyrolake.plans.streams import MEASURED_SQL, _n_sql, observed, u_sql
from gyrolake.sources import measurements as S

QUERIES: dict = {}
SEED, TRAIN, VAL = 4, 0.5, 0.2
SLOW_DEG = 1.5
ALL = list(X.model_fits())
SETTINGS = X.Settings(training=T.Training(hidden=24, rounds=60, rate=0.02))
NOISE_DEG = math.degrees(0.2)


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def split_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(X.split_rows(moving(spark, sf_dir), SEED, TRAIN, VAL), "split")


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Training and test poses."""
    rows = split_poses(spark, sf_dir)
    return tuple(rows.filter(F.col("split") == s).drop("split") for s in ("train", "test"))


SPLIT_SQL = f""", ids AS (SELECT seq, count(DISTINCT t) AS frames FROM poses GROUP BY seq), placed AS (SELECT *, row_number() OVER (ORDER BY {u_sql(f"'{SEED}'", "seq")}, seq) AS place, count(*) OVER () AS n FROM ids),
cut AS (SELECT *, greatest(1, round_even(n*{TRAIN}::DOUBLE, 0)) AS a, greatest(1, round_even(n*{VAL}::DOUBLE, 0)) AS b FROM placed), split AS (SELECT seq, frames, CASE WHEN place <= a THEN 'train' WHEN place <= a + b THEN 'val' ELSE 'test' END AS split FROM cut)"""
LAGGED_SQL = MOVING_SQL + SPLIT_SQL + ", steps AS (SELECT *, " + ", ".join(f"lag(r{k}) OVER (PARTITION BY seq, joint ORDER BY t) AS p{k}" for k in range(9)) + " FROM poses)," + delta_sql("steps", "deltas", "p{k}", "r{k}", "d")
_FLOOR = f"{math.radians(transitions.FLOOR_DEG)!r}::DOUBLE"
_W = "WINDOW w AS (PARTITION BY seq, joint ORDER BY t)"
FIT_SQL = LAGGED_SQL + ", taught AS (SELECT d.* FROM deltas d JOIN split USING (seq) WHERE split = 'train'), second AS (SELECT *, " + ", ".join(f"d{k} - lag(d{k}) OVER w AS c{k}" for k in range(3)) + f" FROM taught {_W}), fit AS (SELECT joint, " + ", ".join(f"avg(d{k}) AS m{k}, greatest({_FLOOR}, stddev_pop(d{k})) AS s{k}, greatest({_FLOOR}, stddev_pop(c{k})) AS v{k}" for k in range(3)) + ", count(d0) AS n FROM second GROUP BY joint)"


@register(f"WITH {MOVING_SQL}{SPLIT_SQL} SELECT seq, split, frames FROM split")
def experiment_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sequences train, validate and test."""
    return split_poses(spark, sf_dir).groupBy("seq", "split").agg(F.count_distinct("t").alias("frames"))


@register(f"WITH {FIT_SQL} SELECT joint, n, " + ", ".join(f"round({c}{k},6)+0.0 AS {name}{k}" for c, name in (("m", "mean"), ("s", "std"), ("v", "repeat_std")) for k in range(3)) + " FROM fit")
def experiment_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift, spread and spread of second differences of the training sequences alone."""
    steps = M.deltas_of(parts(spark, sf_dir)[0])
    both = transitions.fit_random_walk(steps).join(transitions.fit_constant_velocity(steps).select("joint", *[F.col(f"std{k}").alias(f"repeat_std{k}") for k in range(3)]), "joint")
    return both.select("joint", "n", *[(F.round(f"{c}{k}", 6) + 0.0).alias(f"{c}{k}") for c in ("mean", "std", "repeat_std") for k in range(3)])


def _stored(spark: SparkSession, model: M.Motion) -> M.Motion:
    path = new_folder(spark, "models")
    return M.load(spark, path, "model", M.save(spark, model, path, "model"))


@register(f"WITH {FIT_SQL} " + " UNION ALL ".join(f"SELECT '{name}' AS parameter, joint, CAST({k} AS INTEGER) AS axis, round({c}{k},6)+0.0 AS value FROM fit" for c, name in (("m", "drift"), ("s", "spread")) for k in range(3)))
def experiment_stored_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of a fitted model after it was published and read again."""
    model = _stored(spark, M.fit_drift(parts(spark, sf_dir)[0]))
    rows = [(name, j, k, round(float(getattr(model, name)[j, k]), 6) + 0.0) for name in ("drift", "spread") for j in range(len(model.drift)) for k in range(3)]
    return spark.createDataFrame(rows, "parameter string, joint int, axis int, value double")


def _applied(source: str, out: str, step: str) -> str:
    """CTEs that turn p0..p8 of ``source`` by the steps ``step``, with the angle to r0..r8 as ``error``."""
    columns = ", ".join(f"{step.format(k=k)} AS g{k}" for k in range(3))
    turned = ", ".join(f"q{3 * i}*p{j} + q{3 * i + 1}*p{3 + j} + q{3 * i + 2}*p{6 + j} AS e{3 * i + j}" for i in range(3) for j in range(3))
    return f"{out}_g AS (SELECT *, {columns} FROM {source})," + exp_sql(f"{out}_g", f"{out}_q", ("g0", "g1", "g2"), "q") + f", {out}_e AS (SELECT *, {turned} FROM {out}_q), {out} AS (SELECT *, {dist_sql('r{k}', 'e{k}')} AS error FROM {out}_e)"


BY_SQL = FIT_SQL + f", held AS (SELECT d.*, m0, m1, m2, " + ", ".join(f"lag(d{k}) OVER w AS b{k}" for k in range(3)) + f" FROM deltas d JOIN split USING (seq) JOIN fit USING (joint) WHERE split = 'test' {_W}), speed AS (SELECT seq, t + 1 AS t, avg({dist_sql('r{k}', 'p{k}')}) AS before FROM held WHERE p0 IS NOT NULL GROUP BY seq, t), scored AS (SELECT h.*, coalesce(before < radians({SLOW_DEG}::DOUBLE), true) AS low FROM held h LEFT JOIN speed s ON s.seq = h.seq AND s.t = h.t WHERE p0 IS NOT NULL)"
STEP_OF = {"persistence": "0.0::DOUBLE * m{k}", "gaussian_rw": "m{k}", "adaptive_gaussian_rw": "CASE WHEN low THEN 0.0 ELSE m{k} END", "constant_velocity": "coalesce(b{k}, 0.0)"}
CLOSED = list(STEP_OF)


@register(f"WITH {BY_SQL}, " + ", ".join(_applied("scored", n, s) for n, s in STEP_OF.items()) + " " + " UNION ALL ".join(f"SELECT '{n}' AS model, seq, count(DISTINCT t) AS steps, round(degrees(avg(error)),5)+0.0 AS one_step_error_deg FROM {n} GROUP BY seq" for n in CLOSED))
def experiment_one_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of one step on test sequences, of models fitted to training sequences."""
    train, test = parts(spark, sf_dir)
    told = X.step_errors(test, X.fitted(train, CLOSED))
    return told.select("model", "seq", "steps", five(F.col("one_step_error_deg"), "one_step_error_deg"))


WARM, HORIZON = 2, 10
_TO = f"(h.t - {WARM})"
FAR_SQL = BY_SQL + f", begun AS (SELECT seq, joint, low, b0, b1, b2, d0, d1, d2, {', '.join(f'r{k} AS p{k}' for k in range(9))} FROM scored WHERE t = {WARM}), gate AS (SELECT seq, avg({dist_sql('r{k}', 'p{k}')}) < radians({SLOW_DEG}::DOUBLE) AS low FROM scored WHERE t = {WARM} GROUP BY seq), size AS (SELECT avg(sqrt(m0*m0+m1*m1+m2*m2)) AS size FROM fit), far AS (SELECT h.seq, h.joint, h.t, " + ", ".join(f"h.r{k}" for k in range(9)) + ", " + ", ".join(f"g.p{k}" for k in range(9)) + f", {_TO} AS far, CASE WHEN gate.low THEN 0 WHEN size >= radians({SLOW_DEG}::DOUBLE) THEN {_TO} ELSE 1 END AS moves, g.d0 AS b0, g.d1 AS b1, g.d2 AS b2, m0, m1, m2 FROM scored h JOIN begun g ON g.seq = h.seq AND g.joint = h.joint JOIN gate ON gate.seq = h.seq, size WHERE h.t BETWEEN {WARM + 1} AND {WARM + HORIZON})"
FAR_OF = {"persistence": "0.0::DOUBLE * m{k}", "gaussian_rw": "far * m{k}", "adaptive_gaussian_rw": "moves * m{k}", "constant_velocity": "far * b{k}"}


@register(f"WITH {FAR_SQL}, " + ", ".join(_applied("far", n, s) for n, s in FAR_OF.items()) + " " + " UNION ALL ".join(f"SELECT '{n}' AS model, t, round(degrees(avg(error)),5)+0.0 AS rollout_error_deg FROM {n} GROUP BY t" for n in CLOSED))
def experiment_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions fed back for ten frames after three true ones; in SQL, equal steps about one axis add up."""
    train, test = parts(spark, sf_dir)
    told = X.rollout_errors(test, X.fitted(train, CLOSED), HORIZON, WARM).groupBy("model", "t").agg(F.degrees(F.avg("error")).alias("e"))
    return told.select("model", "t", five(F.col("e"), "rollout_error_deg"))


SEEN_SQL = MEASURED_SQL.replace(POSES_SQL, MOVING_SQL)


@register(
    f"WITH {SEEN_SQL}{SPLIT_SQL}, tested AS (SELECT e.* FROM erred e JOIN split USING (seq) WHERE split = 'test'), f AS (SELECT *, " + ", ".join(f"first_value(r{k}) OVER (PARTITION BY seq, joint ORDER BY t) AS f{k}" for k in range(9)) + f" FROM tested), h AS (SELECT *, degrees({dist_sql('r{k}', 'f{k}')}) AS held, mask AND NOT coalesce(before, true) AS back FROM f) "
    "SELECT seq, count(DISTINCT t) AS frames, round(sum(CASE WHEN mask THEN confidence*err END)/sum(CASE WHEN mask THEN confidence END),5)+0.0 AS observed_error_deg, round(avg(CASE WHEN mask THEN err END),5)+0.0 AS observed_joint_error_deg, "
    f"round(avg(held),5)+0.0 AS persistence_error_deg, round({_HELD.format('mask')},5)+0.0 AS persistence_observed_joint_error_deg, round({_HELD.format('NOT mask')},5)+0.0 AS persistence_occluded_joint_error_deg, round({_HELD.format('back')},5)+0.0 AS persistence_reappeared_joint_error_deg FROM h GROUP BY seq"
)
def experiment_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the test sequences that need no model: the measurements, and the first pose held."""
    rows = X.split_rows(observed(moving(spark, sf_dir)), SEED, TRAIN, VAL).filter("split = 'test'")
    columns = {c: x for c, x in E.measurement_columns(NOISE_DEG).items() if c in ("observed_error_deg", "observed_joint_error_deg")} | E.split_errors("persistence", F.col("held"))
    return E.with_held(rows).groupBy("seq").agg(F.count_distinct("t").alias("frames"), *[five(x, c) for c, x in columns.items()])


def experiment(spark: SparkSession, sf_dir: str, names: list[str], particles: int = 32) -> X.Experiment:
    known = observed(moving(spark, sf_dir)).select("seq", "t", "joint", "mask", "confidence", "err", *R.names("r"), *R.names("o"))
    return X.run(known, names, P.Options(particles=particles, shared_resampling=True), NOISE_DEG, HORIZON, SEED, TRAIN, VAL, X.model_fits(SETTINGS))


@register()
def experiment_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every model, fitted on training and scored on test sequences; the one of least filter error is marked."""
    return experiment(spark, sf_dir, ALL).comparison


@register()
def experiment_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of every test sequence under the filters of three models."""
    return experiment(spark, sf_dir, ["gaussian_rw", "constant_velocity", "learned_delta"]).filter_metrics


@register()
def experiment_learned_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-step errors of the learned models on every test sequence, beside standing still and repeating the last step."""
    train, test = parts(spark, sf_dir)
    return X.step_errors(test, X.fitted(train, ["persistence", "constant_velocity", "learned_delta", "mlp_delta", "history_mlp_delta"], X.model_fits(SETTINGS)))


GRID = X.Grid((5.0, 20.0), (0.0, 0.5), (1,))
_CELLS = ", ".join(f"({k}, {n}::DOUBLE, {o}::DOUBLE, {s})" for k, n, o, s in GRID.cells())
_AT = ("seed", "seq", "t", "joint")
GRID_SQL = MOVING_SQL + f", cells(cell, noise_deg, occlusion_prob, seed) AS (VALUES {_CELLS}), noisy AS (SELECT p.*, cells.*, " + ", ".join(f"radians(noise_deg)*{_n_sql(chr(39) + 'noise' + chr(39), *_AT, str(k))} AS n{k}" for k in range(3)) + f", t = 0 OR {u_sql(chr(39) + 'seen' + chr(39), *_AT)} >= occlusion_prob AS mask FROM poses p, cells)," + exp_sql("noisy", "turned", ("n0", "n1", "n2"), "q") + ", seen AS (SELECT *, " + ", ".join(f"q{3 * i}*r{j} + q{3 * i + 1}*r{3 + j} + q{3 * i + 2}*r{6 + j} AS o{3 * i + j}" for i in range(3) for j in range(3)) + " FROM turned)"


@register(f"WITH {GRID_SQL} SELECT cell, noise_deg, occlusion_prob, seq, count(*) FILTER (NOT mask) AS hidden, round(avg(CASE WHEN mask THEN degrees({dist_sql('o{k}', 'r{k}')}) END),5)+0.0 AS observed_joint_error_deg FROM seen GROUP BY cell, noise_deg, occlusion_prob, seq")
def experiment_grid_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measurements that all models of a cell share."""
    rows = X.drawn(moving(spark, sf_dir), GRID)
    return rows.groupBy("cell", "noise_deg", "occlusion_prob", "seq").agg(F.count_if(~F.col("mask")).alias("hidden"), five(F.avg(F.when(F.col("mask"), F.col("err"))), "observed_joint_error_deg"))


@register()
def experiment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean metrics of every cell and model on the test sequences."""
    train, test = parts(spark, sf_dir)
    rows = X.grid_metrics(test, X.fitted(train, ["persistence", "constant_velocity"]), P.Options(particles=16), GRID)
    return X.means(rows, ["cell", "noise_deg", "occlusion_prob", "seed", "model"])


TEACHING = X.Grid((5.0, 12.0, 20.0), (0.25,), (2,))


@register()
def experiment_net_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test sequences under a filter that stands still: alone, with a linear correction and with a net's, both taught on drawn measurements of training sequences."""
    train, test = parts(spark, sf_dir)
    model = M.fit_still(train, math.degrees(0.05))
    taught = staged(X.drawn(train, TEACHING).withColumn("sigma", F.radians("noise_deg")).withColumn("seq", F.col("key")), "taught")
    net, _ = proposals.fit_proposal(taught, model, 2, T.Training(hidden=48, rounds=80, rate=0.02), noise=0.5)
    weights, spread = proposals.fit(taught)
    base = P.Options(particles=32, gain=0.0, model=model)
    runs = {"alone": base, "linear": replace(base, proposal=weights, proposal_noise=0.5 * spread, proposal_cap=1.0), "net": replace(base, corrector=net)}
    known = staged(observed(test).withColumn("sigma", F.lit(0.2)), "known")
    estimates = staged(P.run_variants(known, list(runs.values())), "estimates")
    told = E.sequence_metrics(known, estimates, F.lit(32), NOISE_DEG, ("variant", "seq"))
    return told.withColumn("proposal", F.get(F.array(*map(F.lit, runs)), F.col("variant"))).select("proposal", "seq", "observed_error_deg", "filter_error_deg", "filter_observed_joint_error_deg", "filter_occluded_joint_error_deg", "mean_ess")


LIMBS = ((2, 5, 8, 11, 14), (0, 3, 6, 9), (1, 4, 7, 10), (12, 15, 17, 19), (13, 16, 18, 20))


@register()
def particle_filter_limbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joints of a limb share weights and ancestors; the lists come from a table of blocks."""
    given = blocks.of_table(blocks.block_table(spark, LIMBS, 21), 21)
    return scored(spark, sf_dir, lambda m: P.run_filter(m, P.Options(blocks=given)))


_BLOCKS = "given AS (SELECT p_brand AS block, CAST(p_size * 3 % 70 AS INTEGER) AS joint FROM part)"


@register(
    f"WITH {_BLOCKS} SELECT 'unknown joint' AS problem, block, joint FROM given WHERE joint NOT BETWEEN 0 AND 59 GROUP BY ALL UNION ALL "
    "SELECT 'doubled joint', NULL, joint FROM given WHERE joint BETWEEN 0 AND 59 GROUP BY joint HAVING count(*) > 1 UNION ALL "
    "SELECT 'uncovered joint', NULL, CAST(j AS INTEGER) FROM range(60) t(j) WHERE j NOT IN (SELECT joint FROM given)"
)
def block_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps a table of blocks from being a partition of 60 joints."""
    given = table(spark, sf_dir, "part").select(F.col("p_brand").alias("block"), (F.col("p_size") * 3 % 70).cast("int").alias("joint"))
    return blocks.problems(given, 60)


# --- detector files -----------------------------------------------------------------------------


def _listed(rows: DataFrame, name: str, value) -> DataFrame:
    """(seq, name): each sequence's frames in order, a list over its joints of ``value``."""
    frames = rows.groupBy("seq", "t").agg(F.array_sort(F.collect_list(F.struct("joint", value.alias("v")))).alias("j"))
    return frames.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("t", F.transform("j", lambda x: x["v"]).alias("v")))).alias("f")).select("seq", F.transform("f", lambda x: x["v"]).alias(name))


def detector_files(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Folders of motion files and of detector files: every seventh sequence has no detections, another seventh only its first ten frames."""
    rows = staged(R.with_log(observed(moving(spark, sf_dir)), "o", "v"), "seen")
    flat = lambda column: F.transform(column, F.flatten)
    truth = _listed(rows, "a", F.array("x", "y", "z"))
    poses = F.transform(flat("a"), lambda f: F.concat(F.array_repeat(F.lit(0.0), 3), f))
    motion = written(truth.select(F.col("seq").alias("file"), poses.alias("poses"), F.lit(20).alias("mocap_framerate")), "motion")
    kept = rows.filter("seq % 7 <> 3 and (seq % 7 <> 5 or t < 10)")
    told = _listed(kept, "pose", F.array("v0", "v1", "v2"))
    for name, value in (("visible", F.col("mask")), ("scores", F.col("confidence")), ("sigma_deg", 10.0 + F.col("joint") % 3)):
        told = told.join(_listed(kept, name, value), "seq")
    return motion, written(told.select(F.col("seq").alias("file"), flat("pose").alias("body_pose"), "visible", "scores", "sigma_deg", F.lit(20).alias("fps")), "detector")


def from_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    motion, detector = detector_files(spark, sf_dir)
    truth = R.with_exp(S.motion_vectors(S.motion_files(spark, motion, 20, 21), 21), ["x", "y", "z"], "r")
    seen = S.load_measurements(spark, detector, S.Import(joints=21))
    seen = seen.select("seq", "t", "joint", *[F.col(f"r{k}").alias(f"o{k}") for k in range(9)], "mask", "confidence", "sigma")
    return X.aligned(truth, seen)


_FOUND = SEEN_SQL + ", used AS (SELECT * FROM erred WHERE seq % 7 <> 3 AND (seq % 7 <> 5 OR t < 10)), f AS (SELECT *, " + ", ".join(f"first_value(r{k}) OVER (PARTITION BY seq, joint ORDER BY t) AS f{k}" for k in range(9)) + f" FROM used), h AS (SELECT *, degrees({dist_sql('r{k}', 'f{k}')}) AS held, mask AND NOT coalesce(before, true) AS back FROM f)"


@register(
    f"WITH {_FOUND}, told AS (SELECT seq, count(DISTINCT t) AS frames, round(avg(CAST(mask AS INTEGER)),5)+0.0 AS observed_joint_fraction, round(avg(CASE WHEN mask THEN confidence END),5)+0.0 AS mean_confidence, round(avg(10.0::DOUBLE + joint % 3),5)+0.0 AS mean_sigma_deg, round(sum(CASE WHEN mask THEN confidence*err END)/sum(CASE WHEN mask THEN confidence END),5)+0.0 AS observed_error_deg, round(avg(CASE WHEN mask THEN err END),5)+0.0 AS observed_joint_error_deg, "
    f"round(avg(held),5)+0.0 AS persistence_error_deg, round({_HELD.format('mask')},5)+0.0 AS persistence_observed_joint_error_deg, round({_HELD.format('NOT mask')},5)+0.0 AS persistence_occluded_joint_error_deg, round({_HELD.format('back')},5)+0.0 AS persistence_reappeared_joint_error_deg FROM h GROUP BY seq), every AS (SELECT DISTINCT seq FROM frames) "
    "SELECT CAST(e.seq AS INTEGER) AS seq, CASE WHEN t.seq IS NULL THEN 'missing' END AS problem, t.* EXCLUDE (seq) FROM every e LEFT JOIN told t ON t.seq = e.seq"
)
def detector_evaluation_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From motion and detector files to what an evaluation says without a filter; sequences without detections are named."""
    both, told = from_files(spark, sf_dir)
    columns = measured_and_held()
    rows = E.with_held(both).groupBy("seq").agg(*[x.alias(c) if c == "frames" else five(x, c) for c, x in columns.items()])
    return told.select("seq", "problem").join(rows, "seq", "left").withColumn("seq", F.col("seq").cast("int"))


def measured_and_held() -> dict:
    return X.measured_columns() | E.split_errors("persistence", F.col("held"))


@register()
def detector_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From motion and detector files to metric rows: the noise that the files tell for every joint and frame weighs the particles."""
    both, _ = from_files(spark, sf_dir)
    return X.detector_metrics(both, P.Options(particles=64, shared_resampling=True))
