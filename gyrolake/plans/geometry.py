"""Queries over poses: rotation algebra, temporal differences, errors and models of motion."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyrolake.functions import rotations as R
from gyrolake.operators import transitions
from gyrolake.plans.bindings import POSES_SQL, VECTORS_SQL, delta_sql, dist_sql, exp_sql, poses, vectors

QUERIES: dict = {}


def ordered() -> Window:
    return Window.partitionBy("seq", "joint").orderBy("t")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def stepped(df: DataFrame, prefix: str = "r") -> DataFrame:
    """Adds the previous frame's rotation as p0..p8."""
    return df.withColumns({f"p{k}": F.lag(f"{prefix}{k}").over(ordered()) for k in range(9)})


STEPS_SQL = POSES_SQL + ", steps AS (SELECT *, " + ", ".join(f"lag(r{k}) OVER (PARTITION BY seq, joint ORDER BY t) AS p{k}" for k in range(9)) + " FROM poses)"
STEP = dist_sql("r{k}", "p{k}")


@register(f"WITH {STEPS_SQL}, d AS (SELECT seq, joint, degrees({STEP}) AS d FROM steps) SELECT seq, joint, round(avg(d),6)+0.0 AS mean_deg, count(d) AS steps FROM d GROUP BY seq, joint")
def geodesic_per_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.degrees(R.geodesic(R.cols("r"), R.cols("p")))
    return stepped(poses(spark, sf_dir)).groupBy("seq", "joint").agg(r6(F.avg(d)).alias("mean_deg"), F.count(d).alias("steps"))


def sequence_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, motion): mean over frames of the mean joint step, in degrees."""
    d = F.degrees(R.geodesic(R.cols("r"), R.cols("p")))
    frames = stepped(poses(spark, sf_dir)).groupBy("seq", "t").agg(F.avg(d).alias("d"))
    return frames.groupBy("seq").agg(F.avg("d").alias("motion"), F.count(F.lit(1)).alias("frames"))


def motion_bin(x: Column) -> Column:
    return F.when((x >= 0) & (x < 0.5), "low_motion").when((x >= 0.5) & (x < 1.5), "medium_motion").otherwise("high_motion")


MOTION_SQL = STEPS_SQL + f""", frame_motion AS (SELECT seq, t, avg(degrees({STEP})) AS d FROM steps GROUP BY seq, t),
motion AS (SELECT seq, avg(d) AS motion, count(*) AS frames FROM frame_motion GROUP BY seq)"""
BIN_SQL = "CASE WHEN motion >= 0 AND motion < 0.5 THEN 'low_motion' WHEN motion >= 0.5 AND motion < 1.5 THEN 'medium_motion' ELSE 'high_motion' END"


@register(f"WITH {MOTION_SQL} SELECT seq, round(motion,6)+0.0 AS motion_deg_per_frame, frames, {BIN_SQL} AS motion_bin FROM motion")
def motion_by_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_motion(spark, sf_dir).select("seq", r6("motion").alias("motion_deg_per_frame"), "frames", motion_bin(F.col("motion")).alias("motion_bin"))


@register(f"WITH {MOTION_SQL} SELECT {BIN_SQL} AS motion_bin, count(*) AS sequences, sum(frames)::BIGINT AS frames FROM motion GROUP BY 1")
def motion_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_motion(spark, sf_dir).groupBy(motion_bin(F.col("motion")).alias("motion_bin")).agg(F.count(F.lit(1)).alias("sequences"), F.sum("frames").alias("frames"))


@register(f"WITH {POSES_SQL} SELECT seq, t, joint, " + ", ".join(f"round(r{k},6)+0.0 AS r{k}" for k in range(9)) + " FROM poses")
def expmap_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poses(spark, sf_dir).select("seq", "t", "joint", *[r6(f"r{k}").alias(f"r{k}") for k in range(9)])


#: The identity as a rotation beside each pose, so that the delta is the logarithm itself.
LOG_SQL = POSES_SQL + ", with_id AS (SELECT *, " + ", ".join(f"{float(k in (0, 4, 8))}::DOUBLE AS i{k}" for k in range(9)) + " FROM poses)," + delta_sql("with_id", "logs", "i{k}", "r{k}", "v")


@register(f"WITH {LOG_SQL} SELECT seq, t, joint, round(v0,6)+0.0 AS v0, round(v1,6)+0.0 AS v1, round(v2,6)+0.0 AS v2, sqrt((v0-x)**2+(v1-y)**2+(v2-z)**2) < 1e-6 AS closes FROM logs")
def logmap_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = R.with_log(poses(spark, sf_dir), "r", "v")
    gap = R.norm([F.col("v0") - F.col("x"), F.col("v1") - F.col("y"), F.col("v2") - F.col("z")])
    return logs.select("seq", "t", "joint", *[r6(f"v{k}").alias(f"v{k}") for k in range(3)], (gap < 1e-6).alias("closes"))


@register(f"WITH {VECTORS_SQL} SELECT seq, t, joint, -z AS k1, y AS k2, z AS k3, -x AS k5, -y AS k6, x AS k7, x AS u0, y AS u1, z AS u2 FROM vectors")
def skew_unskew(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = R.skew([F.col("x"), F.col("y"), F.col("z")])
    u = R.unskew(k)
    return vectors(spark, sf_dir).select("seq", "t", "joint", *[k[i].alias(f"k{i}") for i in (1, 2, 3, 5, 6, 7)], *[u[i].alias(f"u{i}") for i in range(3)])


QUAT_SQL = POSES_SQL + """, q_ AS (SELECT *, sqrt(greatest(r0+r4+r8+1,0))*2 AS sw, sqrt(greatest(1+r0-r4-r8,0))*2 AS sx, sqrt(greatest(1+r4-r0-r8,0))*2 AS sy, sqrt(greatest(1+r8-r0-r4,0))*2 AS sz,
  CASE WHEN r0+r4+r8 > 0 THEN 0 WHEN r0 > r4 AND r0 > r8 THEN 1 WHEN r4 > r8 THEN 2 ELSE 3 END AS c FROM poses),
raw AS (SELECT *, CASE c WHEN 0 THEN (r7-r5)/sw WHEN 1 THEN sx/4 WHEN 2 THEN (r1+r3)/sy ELSE (r2+r6)/sz END AS qx, CASE c WHEN 0 THEN (r2-r6)/sw WHEN 1 THEN (r1+r3)/sx WHEN 2 THEN sy/4 ELSE (r5+r7)/sz END AS qy,
  CASE c WHEN 0 THEN (r3-r1)/sw WHEN 1 THEN (r2+r6)/sx WHEN 2 THEN (r5+r7)/sy ELSE sz/4 END AS qz, CASE c WHEN 0 THEN sw/4 WHEN 1 THEN (r7-r5)/sx WHEN 2 THEN (r2-r6)/sy ELSE (r3-r1)/sz END AS qw FROM q_),
quats AS (SELECT *, CASE WHEN qw < 0 THEN -1 ELSE 1 END / sqrt(qx*qx+qy*qy+qz*qz+qw*qw) AS f_ FROM raw)"""


@register(f"WITH {QUAT_SQL} SELECT seq, t, joint, round(qx*f_,6)+0.0 AS q0, round(qy*f_,6)+0.0 AS q1, round(qz*f_,6)+0.0 AS q2, round(qw*f_,6)+0.0 AS q3 FROM quats")
def quat_from_rot(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = R.to_quaternion(R.cols("r"))
    return poses(spark, sf_dir).select("seq", "t", "joint", *[r6(q[k]).alias(f"q{k}") for k in range(4)])


@register(f"""WITH {VECTORS_SQL}, q AS (SELECT seq, t, joint, x AS a, y AS b, z AS c, x - y AS d, sqrt(x*x+y*y+z*z+(x-y)*(x-y)) AS n FROM vectors),
s AS (SELECT *, CASE WHEN n > 1e-12 THEN CASE WHEN d < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END END AS g FROM q)
SELECT seq, t, joint, round(a*g/n,6)+0.0 AS q0, round(b*g/n,6)+0.0 AS q1, round(c*g/n,6)+0.0 AS q2, round(d*g/n,6)+0.0 AS q3,
  round(1-2*(b*b+c*c)/(n*n),6)+0.0 AS r0, round(2*(a*b-c*d)/(n*n),6)+0.0 AS r1, round(1-2*(a*a+b*b)/(n*n),6)+0.0 AS r8 FROM s""")
def quat_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    named = vectors(spark, sf_dir).withColumns({f"q{k}": c for k, c in enumerate(R.canonical([x, y, z, x - y]))})
    m = R.from_quaternion(R.cols("q")[:4])
    return named.select("seq", "t", "joint", *[r6(f"q{k}").alias(f"q{k}") for k in range(4)], *[r6(m[k]).alias(f"r{k}") for k in (0, 1, 8)])


DELTAS_SQL = STEPS_SQL + "," + delta_sql("steps", "deltas", "p{k}", "r{k}", "d")


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """poses with the left delta from the previous frame in d0..d2, null on the first frame."""
    return R.with_left_delta(stepped(poses(spark, sf_dir)), "p", "r", "d")


@register(f"WITH {DELTAS_SQL} SELECT seq, joint, count(d0) AS n, round(avg(degrees(sqrt(d0*d0+d1*d1+d2*d2))),6)+0.0 AS mean_speed_deg, round(avg(d0),6)+0.0 AS mean_x, round(avg(d1),6)+0.0 AS mean_y, round(avg(d2),6)+0.0 AS mean_z FROM deltas GROUP BY seq, joint")
def left_delta_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    speed = F.degrees(R.norm(R.cols("d")[:3]))
    return deltas(spark, sf_dir).groupBy("seq", "joint").agg(F.count("d0").alias("n"), r6(F.avg(speed)).alias("mean_speed_deg"), *[r6(F.avg(f"d{k}")).alias(f"mean_{a}") for k, a in enumerate("xyz")])


_A = ", ".join(f"d{k} - lag(d{k}) OVER w AS a{k}" for k in range(3))
_J = ", ".join(f"a{k} - lag(a{k}) OVER w AS j{k}" for k in range(3))
_W = "WINDOW w AS (PARTITION BY seq, joint ORDER BY t)"


@register(f"WITH {DELTAS_SQL}, acc AS (SELECT *, {_A} FROM deltas {_W}), jerk AS (SELECT *, {_J} FROM acc {_W}) SELECT seq, round(avg(degrees(sqrt(a0*a0+a1*a1+a2*a2))),5)+0.0 AS mean_acceleration_deg, round(avg(degrees(sqrt(j0*j0+j1*j1+j2*j2))),5)+0.0 AS mean_jerk_deg FROM jerk GROUP BY seq")
def temporal_accel_jerk(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = deltas(spark, sf_dir).withColumns({f"a{k}": F.col(f"d{k}") - F.lag(f"d{k}").over(ordered()) for k in range(3)})
    jerk = acc.withColumns({f"j{k}": F.col(f"a{k}") - F.lag(f"a{k}").over(ordered()) for k in range(3)})
    five = lambda p: F.round(F.avg(F.degrees(R.norm(R.cols(p)[:3]))), 5) + 0.0
    return jerk.groupBy("seq").agg(five("a").alias("mean_acceleration_deg"), five("j").alias("mean_jerk_deg"))


@register(f"WITH {VECTORS_SQL}, n AS (SELECT *, sqrt(x*x+y*y+z*z) AS n FROM vectors) SELECT seq, t, joint, round(x*least(1.0, 0.01/greatest(n,1e-12)),6)+0.0 AS c0, round(y*least(1.0, 0.01/greatest(n,1e-12)),6)+0.0 AS c1, round(z*least(1.0, 0.01/greatest(n,1e-12)),6)+0.0 AS c2 FROM n")
def clip_tangent_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.clip_tangent([F.col("x"), F.col("y"), F.col("z")], 0.01)
    return vectors(spark, sf_dir).select("seq", "t", "joint", *[r6(c[k]).alias(f"c{k}") for k in range(3)])


_RV = VECTORS_SQL + """, u AS (SELECT seq, t, joint, """ + ", ".join(f"CAST(('0x' || substr(md5(concat_ws('|', '7', seq, t, joint, '{k}')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u{k}" for k in range(3)) + """ FROM vectors),
q AS (SELECT seq, t, joint, sqrt(1-u0)*sin(2*pi()*u1) AS a, sqrt(1-u0)*cos(2*pi()*u1) AS b, sqrt(u0)*sin(2*pi()*u2) AS c, sqrt(u0)*cos(2*pi()*u2) AS d FROM u)"""


@register(f"WITH {_RV} SELECT seq, t, joint, round(1-2*(b*b+c*c),6)+0.0 AS r0, round(2*(a*b-c*d),6)+0.0 AS r1, round(2*(a*c+b*d),6)+0.0 AS r2, round(1-2*(a*a+b*b),6)+0.0 AS r8 FROM q")
def random_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haar-uniform rotations from three uniform numbers of the row's key."""
    key = [F.col("seq"), F.col("t"), F.col("joint")]
    q = transitions.random_quaternion(7, key)
    named = vectors(spark, sf_dir).withColumns({f"q{k}": c for k, c in enumerate(q)})
    m = R.from_quaternion(R.cols("q")[:4])
    return named.select("seq", "t", "joint", *[r6(m[k]).alias(f"r{k}") for k in (0, 1, 2, 8)])


# --- models of motion -------------------------------------------------------------------------

FLOOR = math.radians(0.25)


@register(f"WITH {DELTAS_SQL} SELECT joint, " + ", ".join(f"round(avg(d{k}),6)+0.0 AS mean{k}, round(greatest({FLOOR}, stddev_pop(d{k})),6)+0.0 AS std{k}" for k in range(3)) + ", count(d0) AS n FROM deltas GROUP BY joint")
def rw_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = transitions.fit_random_walk(deltas(spark, sf_dir))
    return fit.select("joint", *[r6(f"{s}{k}").alias(f"{s}{k}") for k in range(3) for s in ("mean", "std")], "n")


_V2 = ", ".join(f"lag(d{k}) OVER w AS v{k}" for k in range(3))


@register(f"WITH {DELTAS_SQL}, second AS (SELECT *, {_V2} FROM deltas {_W}) SELECT joint, " + ", ".join(f"round(greatest({FLOOR}, stddev_pop(d{k} - v{k})),6)+0.0 AS std{k}" for k in range(3)) + " FROM second GROUP BY joint")
def constant_velocity_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = transitions.fit_constant_velocity(deltas(spark, sf_dir))
    return fit.select("joint", *[r6(f"std{k}").alias(f"std{k}") for k in range(3)])


@register(f"WITH {STEPS_SQL} SELECT 'persistence' AS model, round(avg(degrees({STEP})),6)+0.0 AS one_step_deg FROM steps")
def persistence_onestep(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.degrees(R.geodesic(R.cols("r"), R.cols("p")))
    return stepped(poses(spark, sf_dir)).agg(r6(F.avg(error)).alias("one_step_deg")).select(F.lit("persistence").alias("model"), "one_step_deg")


_FIT = ", fit AS (SELECT joint, avg(d0) AS m0, avg(d1) AS m1, avg(d2) AS m2 FROM deltas GROUP BY joint), with_fit AS (SELECT s.*, m0 AS g0, m1 AS g1, m2 AS g2 FROM steps s JOIN fit USING (joint))"
_APPLY = ", ".join(f"q{3 * i}*p{j} + q{3 * i + 1}*p{3 + j} + q{3 * i + 2}*p{6 + j} AS e{3 * i + j}" for i in range(3) for j in range(3))
RW_SQL = DELTAS_SQL + _FIT + "," + exp_sql("with_fit", "moved", ("g0", "g1", "g2"), "q") + f", predicted AS (SELECT *, {_APPLY} FROM moved)"


@register(f"WITH {RW_SQL} SELECT 'gaussian_rw' AS model, round(avg(degrees({dist_sql('r{k}', 'e{k}')})),6)+0.0 AS one_step_deg FROM predicted")
def gaussian_rw_onestep(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = deltas(spark, sf_dir)
    fit = transitions.fit_random_walk(moved).select("joint", *[F.col(f"mean{k}").alias(f"g{k}") for k in range(3)])
    return transitions.one_step(R.with_exp(moved.join(F.broadcast(fit), "joint"), ["g0", "g1", "g2"], "q"), "gaussian_rw")


_CV = DELTAS_SQL + f", with_v AS (SELECT *, {', '.join(f'coalesce(lag(d{k}) OVER w, 0) AS g{k}' for k in range(3))} FROM deltas {_W})," + exp_sql("with_v", "moved", ("g0", "g1", "g2"), "q") + f", predicted AS (SELECT *, {_APPLY} FROM moved)"


@register(f"WITH {_CV} SELECT 'constant_velocity' AS model, round(avg(degrees({dist_sql('r{k}', 'e{k}')})),6)+0.0 AS one_step_deg FROM predicted")
def constant_velocity_onestep(spark: SparkSession, sf_dir: str) -> DataFrame:
    velocity = deltas(spark, sf_dir).withColumns({f"g{k}": F.coalesce(F.lag(f"d{k}").over(ordered()), F.lit(0.0)) for k in range(3)})
    return transitions.one_step(R.with_exp(velocity, ["g0", "g1", "g2"], "q"), "constant_velocity")


_AD = DELTAS_SQL + f""", frame_speed AS (SELECT seq, t, avg({STEP}) AS d FROM steps GROUP BY seq, t), gate AS (SELECT seq, t, coalesce(lag(d) OVER (PARTITION BY seq ORDER BY t) < radians(1.5), true) AS low FROM frame_speed),
fit AS (SELECT joint, avg(d0) AS m0, avg(d1) AS m1, avg(d2) AS m2 FROM deltas GROUP BY joint),
gated AS (SELECT s.*, low, CASE WHEN low THEN 0 ELSE m0 END AS g0, CASE WHEN low THEN 0 ELSE m1 END AS g1, CASE WHEN low THEN 0 ELSE m2 END AS g2 FROM steps s JOIN fit USING (joint) JOIN gate USING (seq, t)),""" + exp_sql("gated", "moved", ("g0", "g1", "g2"), "q") + f", predicted AS (SELECT *, {_APPLY} FROM moved)"


@register(f"WITH {_AD} SELECT seq, count(DISTINCT CASE WHEN low THEN t END) AS low_frames, round(avg(degrees({dist_sql('r{k}', 'e{k}')})),6)+0.0 AS one_step_deg FROM predicted GROUP BY seq")
def adaptive_gate_onestep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persistence after a slow step (or without one), the random walk's mean otherwise."""
    moved = deltas(spark, sf_dir)
    speed = moved.groupBy("seq", "t").agg(F.avg(R.geodesic(R.cols("r"), R.cols("p"))).alias("d"))
    low = F.coalesce(F.lag("d").over(Window.partitionBy("seq").orderBy("t")) < math.radians(1.5), F.lit(True))
    fit = transitions.fit_random_walk(moved)
    gated = moved.join(speed.select("seq", "t", low.alias("low")), ["seq", "t"]).join(F.broadcast(fit), "joint")
    gated = gated.withColumns({f"g{k}": F.when(F.col("low"), 0.0).otherwise(F.col(f"mean{k}")) for k in range(3)})
    predicted = transitions.predicted(R.with_exp(gated, ["g0", "g1", "g2"], "q"))
    error = F.degrees(R.geodesic(R.cols("r"), R.cols("e")))
    return predicted.groupBy("seq").agg(F.count_distinct(F.when(F.col("low"), F.col("t"))).alias("low_frames"), r6(F.avg(error)).alias("one_step_deg"))


@register(f"""WITH {DELTAS_SQL}, fit AS (SELECT joint, avg(d0) AS m0, avg(d1) AS m1, avg(d2) AS m2, {', '.join(f'greatest({FLOOR}, stddev_pop(d{k})) AS s{k}' for k in range(3))} FROM deltas GROUP BY joint)
SELECT seq, round(sum(-0.5*((d0-m0)*(d0-m0)/(s0*s0) + (d1-m1)*(d1-m1)/(s1*s1) + (d2-m2)*(d2-m2)/(s2*s2)) - ln(s0) - ln(s1) - ln(s2) - 1.5*ln(2*pi())),4)+0.0 AS log_prob FROM deltas JOIN fit USING (joint) GROUP BY seq""")
def rw_log_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = deltas(spark, sf_dir)
    return transitions.log_prob(moved, transitions.fit_random_walk(moved)).groupBy("seq").agg((F.round(F.sum("log_prob"), 4) + 0.0).alias("log_prob"))


_ROLL = DELTAS_SQL + ", fit AS (SELECT joint, avg(d0) AS m0, avg(d1) AS m1, avg(d2) AS m2 FROM deltas GROUP BY joint), starts AS (SELECT seq, joint, " + ", ".join(f"r{k} AS p{k}" for k in range(9)) + " FROM poses WHERE t = 0), horizon AS (SELECT s.seq, s.joint, h.t, " + ", ".join(f"p{k}" for k in range(9)) + ", " + ", ".join(f"r{k}" for k in range(9)) + ", m0*h.t AS g0, m1*h.t AS g1, m2*h.t AS g2 FROM starts s JOIN fit USING (joint) JOIN poses h ON h.seq = s.seq AND h.joint = s.joint AND h.t BETWEEN 1 AND 10)," + exp_sql("horizon", "moved", ("g0", "g1", "g2"), "q") + f", predicted AS (SELECT *, {_APPLY} FROM moved)"


@register(f"WITH {_ROLL} SELECT t AS horizon, round(avg(degrees({dist_sql('r{k}', 'e{k}')})),6)+0.0 AS rollout_deg FROM predicted GROUP BY t")
def rollout_rw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The random walk fed with its own predictions: t equal steps are one rotation about the same axis."""
    all_poses = poses(spark, sf_dir)
    fit = transitions.fit_random_walk(deltas(spark, sf_dir))
    starts = all_poses.filter("t = 0").select("seq", "joint", *[F.col(f"r{k}").alias(f"p{k}") for k in range(9)])
    horizon = all_poses.filter("t between 1 and 10").join(F.broadcast(fit), "joint").join(starts, ["seq", "joint"])
    horizon = horizon.withColumns({f"g{k}": F.col(f"mean{k}") * F.col("t") for k in range(3)})
    error = F.degrees(R.geodesic(R.cols("r"), R.cols("e")))
    return transitions.predicted(R.with_exp(horizon, ["g0", "g1", "g2"], "q")).groupBy(F.col("t").alias("horizon")).agg(r6(F.avg(error)).alias("rollout_deg"))


@register(f"WITH {LOG_SQL}, d AS (SELECT seq, t + 1 AS t, joint, v0, v1, v2 FROM logs), y AS (SELECT l.joint, d.v0 AS a, d.v1 AS b, d.v2 AS c, l.v0 AS ya, l.v1 AS yb, l.v2 AS yc FROM logs l JOIN d USING (seq, t, joint)) SELECT joint, count(*) AS n, round(sum(a*a),6)+0.0 AS aa, round(sum(a*b),6)+0.0 AS ab, round(sum(b*b),6)+0.0 AS bb, round(sum(c*c),6)+0.0 AS cc, round(sum(a*ya),6)+0.0 AS aya, round(sum(b*yb),6)+0.0 AS byb, round(sum(c*yc),6)+0.0 AS cyc FROM y GROUP BY joint")
def ridge_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal equations of one joint's linear predictor, as partial sums."""
    logs = R.with_log(poses(spark, sf_dir), "r", "v")
    y = logs.withColumns({a: F.lag(f"v{k}").over(ordered()) for k, a in enumerate("abc")}).filter("a is not null")
    s = lambda p, q, n: r6(F.sum(F.col(p) * F.col(q))).alias(n)
    return y.groupBy("joint").agg(F.count(F.lit(1)).alias("n"), s("a", "a", "aa"), s("a", "b", "ab"), s("b", "b", "bb"), s("c", "c", "cc"), s("a", "v0", "aya"), s("b", "v1", "byb"), s("c", "v2", "cyc"))


@register(f"WITH {POSES_SQL} SELECT seq, t, joint, count(*) OVER w AS n, " + ", ".join(f"round(sum(r{k}) OVER w,6)+0.0 AS s{k}" for k in range(9)) + " FROM poses WINDOW w AS (PARTITION BY seq, joint ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def chordal_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of rotations over centred windows of five frames; a projection makes them chordal means."""
    near = ordered().rowsBetween(-2, 2)
    return poses(spark, sf_dir).select("seq", "t", "joint", F.count(F.lit(1)).over(near).alias("n"), *[r6(F.sum(f"r{k}").over(near)).alias(f"s{k}") for k in range(9)])


_NP = 3 * math.log(2 * math.pi * 0.05**2)


@register(f"WITH {DELTAS_SQL}, drawn AS (SELECT *, " + ", ".join(f"0.05::DOUBLE * sqrt(-2*ln(1-CAST(('0x' || substr(md5(concat_ws('|', '21', seq, t, joint, '{k}', 'u')), 1, 8)) AS BIGINT)/4294967296.0::DOUBLE)) * cos(2*pi()*(CAST(('0x' || substr(md5(concat_ws('|', '21', seq, t, joint, '{k}', 'v')), 1, 8)) AS BIGINT)/4294967296.0::DOUBLE)) AS g{k}" for k in range(3)) + " FROM deltas WHERE d0 IS NOT NULL)," + exp_sql("drawn", "moved", ("g0", "g1", "g2"), "q") + f", predicted AS (SELECT *, {_APPLY} FROM moved) SELECT seq, round(sum(-0.5*((d0*d0 + d1*d1 + d2*d2)/0.0025::DOUBLE + {_NP!r})),4)+0.0 AS log_prob, round(avg(degrees({dist_sql('r{k}', 'e{k}')})),6)+0.0 AS sampled_deg FROM predicted GROUP BY seq")
def noisy_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standing still with the same small noise in every direction: the steps' log density, and the error of a drawn step."""
    key = [F.col("seq"), F.col("t"), F.col("joint")]
    steps = deltas(spark, sf_dir).filter("d0 is not null").withColumns({f"g{k}": 0.05 * R.normal(F.lit(21), *key, F.lit(k)) for k in range(3)})
    drawn = transitions.predicted(R.with_exp(steps, ["g0", "g1", "g2"], "q"))
    density = transitions.isotropic_log_prob([F.col(f"d{k}") for k in range(3)], 0.05)
    return drawn.groupBy("seq").agg((F.round(F.sum(density), 4) + 0.0).alias("log_prob"), r6(F.avg(F.degrees(R.geodesic(R.cols("r"), R.cols("e"))))).alias("sampled_deg"))


@register(f"WITH {DELTAS_SQL}, h AS (SELECT seq, t, joint, d0, " + ", ".join(f"round(coalesce(lag(d{k}, {lag}) OVER w, 0),6)+0.0 AS h{lag}_{k}" for lag in (1, 2, 3) for k in range(3)) + f" FROM deltas {_W}) SELECT * EXCLUDE (d0) FROM h WHERE d0 IS NOT NULL")
def history_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three steps before each step; zeros where there were none."""
    held = transitions.with_history(deltas(spark, sf_dir), 3)
    return held.filter("d0 is not null").select("seq", "t", "joint", *[r6(f"h{lag}_{k}").alias(f"h{lag}_{k}") for lag in (1, 2, 3) for k in range(3)])
