"""Queries through files: tables of the test data are written as array and report files, and read by the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gyrolake.functions import rotations as R
from gyrolake.plans.bindings import METRICS_SQL, VECTORS_SQL, exp_sql, metric_rows, sequence, table
from gyrolake.plans.geometry import r6
from gyrolake.plans.reports import BASED_SQL, CND, board
from gyrolake.plans.staging import shared_dir
from gyrolake.sources import measurements as M
from gyrolake.sources import reports as T
from gyrolake.sources import tracks as K

QUERIES: dict = {}
NUMBERS = 63  # of a frame: 21 joints


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gyrolake/{uuid.uuid4().hex}/{name}"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, a): each sequence's frames in order, lists of 63 numbers."""
    e = table(spark, sf_dir, "embeddings").withColumn("seq", sequence())
    numbers = F.transform(F.slice("embedding", 1, NUMBERS), lambda x: x.cast("double") * (F.lit(0.02) * (F.col("label") + 1)))
    held = e.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("vec_id", numbers.alias("a")))).alias("f"))
    return held.select("seq", F.transform("f", lambda x: x["a"]).alias("a"))


def written(rows: DataFrame, name: str) -> str:
    """The folder in which each row of ``rows`` (file, ...) is a JSON file named by the column file."""
    path = new_folder(rows.sparkSession, name)
    rows.withColumn("file", F.when(F.col("file").cast("string").rlike("^[0-9]+$"), F.lpad(F.col("file").cast("string"), 9, "0")).otherwise(F.col("file").cast("string"))).repartition("file").write.partitionBy("file").json(path)
    return path


def of_frame(a: Column, value) -> Column:
    return F.transform(a, lambda f, t: value(t))


def shown(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("seq").cast("int").alias("seq"), "t", "joint", *[r6(f"r{k}").alias(f"r{k}") for k in (0, 1, 2, 8)], "mask", r6("confidence").alias("confidence"), r6("sigma").alias("sigma"))


_SHOWN = "round(r0,6)+0.0 AS r0, round(r1,6)+0.0 AS r1, round(r2,6)+0.0 AS r2, round(r8,6)+0.0 AS r8"
_STRIDED = VECTORS_SQL + ", every_third AS (SELECT seq, CAST(t // 3 AS INTEGER) AS t, t AS source_t, joint, x, y, z FROM vectors WHERE t % 3 = 0)"


@register(f"WITH {_STRIDED}," + exp_sql("every_third", "turned") + f", m AS (SELECT *, (source_t + joint) % 7 <> 0 AND source_t % 5 <> 0 AS seen FROM turned) SELECT seq, t, joint, {_SHOWN}, seen AS mask, CASE WHEN seen THEN round((source_t % 5)/4.0::DOUBLE,6) ELSE 0 END + 0.0 AS confidence, round(radians(6.0::DOUBLE),6)+0.0 AS sigma FROM m")
def detector_axis_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of axis-angle arrays at 60 frames a second, read at 20, with a confidence a frame, a mask and one noise."""
    f = frames(spark, sf_dir)
    mask = F.transform("a", lambda x, t: F.transform(F.sequence(F.lit(0), F.lit(20)), lambda j: (t + j) % 7 != 0))
    path = written(f.select(F.col("seq").alias("file"), F.col("a").alias("body_pose"), of_frame(F.col("a"), lambda t: (t % 5) / 4).alias("scores"), mask.alias("visible"), F.lit(60).alias("fps"), F.lit(6.0).alias("sigma_deg")), "detector")
    return shown(M.load_measurements(spark, path, M.Import(joints=21)))


_QUAT = VECTORS_SQL + ", n AS (SELECT *, sqrt(1 + x*x + y*y + z*z) AS n FROM vectors), q AS (SELECT seq, t, joint, x/n AS x, y/n AS y, z/n AS z, 1/n AS w FROM n), turned AS (SELECT seq, t, joint, 1-2*(y*y+z*z) AS r0, 2*(x*y-z*w) AS r1, 2*(x*z+y*w) AS r2, 1-2*(x*x+y*y) AS r8 FROM q)"


@register(f"WITH {_QUAT} SELECT seq, t, joint, {_SHOWN}, true AS mask, 0.5::DOUBLE AS confidence, NULL::DOUBLE AS sigma FROM turned")
def detector_quaternion_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of frames, one object each, of quaternions that are not of unit norm; a key that some frames lack is not used."""
    quaternion = lambda f: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda j: F.array(F.lit(-2.0), *[-2.0 * F.get(f, 3 * j + k) for k in range(3)])))
    frame = F.transform("a", lambda f, t: F.struct(quaternion(f).alias("pose_quat"), F.lit(0.5).alias("confidence"), F.when(t > 0, 0).alias("mask")))
    path = written(frames(spark, sf_dir).select(F.col("seq").alias("file"), frame.alias("frames")), "detector")
    return shown(M.load_measurements(spark, path, M.Import(joints=21, quaternion_order="wxyz")))


@register(f"WITH {VECTORS_SQL}," + exp_sql("vectors", "turned") + f" SELECT seq, t, joint, {_SHOWN}, seq % 2 = 0 OR joint <> 3 OR t <> 2 AS mask, CASE WHEN seq % 2 = 0 OR joint <> 3 OR t <> 2 THEN 1.0::DOUBLE ELSE 0 END AS confidence, round(radians(2.0::DOUBLE + joint),6)+0.0 AS sigma FROM turned")
def detector_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of rotation matrices with a root joint, lengthened by a factor that the projection takes away; some are not finite."""
    v = frames(spark, sf_dir).select("seq", F.posexplode("a").alias("t", "f")).select("seq", "t", "f", F.explode(F.sequence(F.lit(-1), F.lit(20))).alias("joint"))
    v = v.select("seq", "t", "joint", *[F.coalesce(F.get("f", F.when(F.col("joint") >= 0, F.col("joint") * 3 + k)), F.lit(0.3)).alias(c) for k, c in enumerate("xyz")])
    lost = (F.col("seq") % 2 == 1) & (F.col("joint") == 3) & (F.col("t") == 2)
    numbers = F.array(*[F.when(~lost, 1.25 * F.col(f"r{k}")) for k in range(9)])
    joints = R.with_exp(v, ["x", "y", "z"], "r").groupBy("seq", "t").agg(F.array_sort(F.collect_list(F.struct("joint", numbers.alias("m")))).alias("j"))
    held = joints.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("t", F.transform("j", lambda x: x["m"]).alias("m")))).alias("f"))
    sigma = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda j: 2.0 + j)
    path = written(held.select(F.col("seq").alias("file"), F.transform("f", lambda x: x["m"]).alias("pred_rotmats"), sigma.alias("joint_sigma_deg")), "detector")
    rows = M.load_measurements(spark, path, M.Import(joints=21)).withColumn("seq", F.col("seq").cast("int"))
    truth = [1.0 if k % 4 == 0 else 0.0 for k in range(9)]
    back = rows.join(R.with_exp(v, ["x", "y", "z"], "w").select("seq", "t", "joint", *R.names("w")), ["seq", "t", "joint"])
    still = F.forall(F.array(*[F.abs(F.col(f"r{k}") - truth[k]) for k in range(9)]), lambda x: x < 1e-12)
    return shown(back.withColumns({f"r{k}": F.when(~F.col("mask") & still, F.col(f"w{k}")).otherwise(F.col(f"r{k}")) for k in range(9)}))


@register(f"WITH {VECTORS_SQL}, n AS (SELECT seq, count(*) AS n FROM frames GROUP BY 1) SELECT seq, CASE WHEN seq = 4 THEN 'no usable pose' WHEN seq = 5 THEN 'confidence outside 0 to 1' WHEN seq = 6 THEN 'noise not above zero' END AS problem, CASE WHEN seq NOT IN (4, 5, 6) THEN CAST(n AS INTEGER) END AS n, CASE WHEN seq NOT IN (4, 5, 6) THEN round(CASE WHEN seq = 7 THEN 0.125 WHEN seq = 8 THEN radians(4.0::DOUBLE) ELSE radians(10.0::DOUBLE) END,6) + 0.0 END AS noise_sigma_rad FROM n")
def detector_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that cannot be used are rows with their reason; the noise of the others is their own or the usual one."""
    f = frames(spark, sf_dir)
    only = lambda k, x: F.when(F.col("seq") == k, F.lit(x))
    pose = F.when(F.col("seq") == 4, F.transform("a", lambda x: F.slice(x, 1, 5))).otherwise(F.col("a"))
    path = written(f.select(F.col("seq").alias("file"), pose.alias("body_pose"), only(5, 1.5).alias("confidence"), only(6, -1.0).alias("sigma_rad"), only(7, 0.125).alias("noise_sigma_rad"), only(8, 4.0).alias("noise_sigma_deg")), "detector")
    return M.parsed(spark, path, M.Import(joints=21)).select(F.col("seq").cast("int").alias("seq"), "problem", "n", r6("noise_sigma_rad").alias("noise_sigma_rad"))


@register(f"WITH {VECTORS_SQL} SELECT seq, t, joint, round(x,6)+0.0 AS x, round(y,6)+0.0 AS y, round(z,6)+0.0 AS z FROM vectors WHERE seq % 2 = 0")
def detector_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of files that name one sequence the last is taken; files of few frames and outside the subset are left out."""
    f = frames(spark, sf_dir)
    own = f.select(F.concat(F.lit("Take_"), F.col("seq").cast("string"), F.lit("b")).alias("file"), F.when(F.col("seq") % 2 == 0, F.col("a")).otherwise(F.slice("a", 1, 1)).alias("poses"), F.col("seq").cast("string").alias("sequence_name"))
    older = f.select(F.concat(F.lit("Take_"), F.col("seq").cast("string"), F.lit("a")).alias("file"), F.slice("a", 2, 9).alias("poses"), F.when(F.col("seq") % 2 == 0, F.col("seq").cast("string")).otherwise("short").alias("sequence_name"))
    other = f.select(F.concat(F.lit("other_"), F.col("seq").cast("string")).alias("file"), F.col("a").alias("poses"), F.lit(None).cast("string").alias("sequence_name"))
    path = written(own.unionByName(older).unionByName(other), "detector")
    rows = M.load_measurements(spark, path, M.Import(joints=21, frame_rate=None, min_frames=10), subset="take")
    told = R.with_log(rows, "r", "v").filter("seq <> 'short'")
    return told.select(F.col("seq").cast("int").alias("seq"), "t", "joint", r6("v0").alias("x"), r6("v1").alias("y"), r6("v2").alias("z"))


_MOTION = VECTORS_SQL + ", s AS (SELECT seq, t, joint, x, y, z, CASE WHEN seq % 2 = 0 THEN 2 ELSE 3 END AS stride FROM vectors WHERE seq < 7), taken AS (SELECT seq, CAST(t // stride AS INTEGER) AS t, joint, x, y, z, count(*) OVER (PARTITION BY seq, joint) AS n FROM s WHERE t % stride = 0)"


@register(f"WITH {_MOTION} SELECT seq, t, joint, round(x,6)+0.0 AS x, round(y,6)+0.0 AS y, round(z,6)+0.0 AS z FROM taken WHERE n >= 16")
def motion_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first seven motion files by path, then those of enough frames; 50 frames a second make a stride of 2, an unknown rate one of 3."""
    rooted = F.transform("a", lambda f: F.concat(F.array_repeat(F.lit(9.0), 3), f))
    path = written(frames(spark, sf_dir).select(F.col("seq").alias("file"), rooted.alias("poses"), F.when(F.col("seq") % 2 == 0, 50.0).alias("mocap_framerate")), "motion")
    rows = M.motion_vectors(M.motion_files(spark, path, 20, 21, limit=7), 21, 16)
    return rows.select(F.col("seq").cast("int").alias("seq"), "t", "joint", r6("x").alias("x"), r6("y").alias("y"), r6("z").alias("z"))


@register(f"WITH {VECTORS_SQL} SELECT seq, round(CASE WHEN seq % 3 = 0 THEN 50.0 WHEN seq % 3 = 1 THEN 60.0 ELSE 25.0 END,6)+0.0 AS fps, CAST(count(*) AS INTEGER) AS source_frames, CASE WHEN seq = 2 THEN 30 ELSE 66 END AS numbers, count(*) >= 45 AND seq <> 2 AS valid FROM frames GROUP BY seq")
def motion_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by the first of their keys, and whether a file's table is large enough."""
    rooted = F.transform("a", lambda f: F.when(F.col("seq") == 2, F.slice(f, 1, 30)).otherwise(F.concat(F.array_repeat(F.lit(9.0), 3), f)))
    rate = F.col("seq") % 3
    path = written(frames(spark, sf_dir).select(F.col("seq").alias("file"), rooted.alias("poses"), F.when(rate == 0, 50).alias("mocap_frame_rate"), F.when(rate == 2, 25).otherwise(F.when(rate == 0, 99)).alias("fps")), "motion")
    files = M.motion_files(spark, path, 20, 9)
    return files.select(F.col("seq").cast("int").alias("seq"), r6("fps").alias("fps"), "source_frames", "numbers", M.is_motion(45, 60).alias("valid"))


@register(f"WITH {VECTORS_SQL}, dim AS (SELECT CAST(unnest(range(23)) AS INTEGER) AS joint), f AS (SELECT DISTINCT seq, t FROM vectors WHERE t % 2 = 0), padded AS (SELECT f.seq, CAST(f.t // 2 AS INTEGER) AS t, dim.joint, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(z, 0) AS z, v.joint IS NOT NULL AS mask FROM f CROSS JOIN dim LEFT JOIN vectors v ON v.seq = f.seq AND v.t = f.t AND v.joint = dim.joint)," + exp_sql("padded", "turned") + f" SELECT seq, t, joint, {_SHOWN}, mask, CASE WHEN mask THEN 0.75::DOUBLE ELSE 0 END AS confidence, NULL::DOUBLE AS sigma FROM turned")
def hmr_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of several tracks each; global poses come before those of the camera, and two joints are missing."""
    f = frames(spark, sf_dir)
    params = lambda sign: F.struct(F.transform("a", lambda x: F.transform(x, lambda v: v * sign)).alias("body_pose"))
    score = of_frame(F.col("a"), lambda t: F.array_repeat(F.array(F.lit(0.1), F.lit(0.2), F.lit(0.75)), 21))
    track = F.struct(params(1.0).alias("smpl_params_global"), params(-1.0).alias("smpl_params_incam"), score.alias("keypoint_scores"), F.lit(40.0).alias("fps"))
    one = [F.any_value(F.when(F.col("seq") % 10 == k, track), F.lit(True)).alias(str(k)) for k in range(10)]
    path = written(f.groupBy((F.floor(F.col("seq") / 10) * 3 + F.col("seq") % 10 % 3).cast("int").alias("file")).agg(*one), "tracks")
    rows = M.measurements(M.usable(K.tracks(spark, path, M.Import())), M.Import())
    parts = F.split("seq", "_")
    return shown(rows.withColumn("seq", F.floor(parts[0].cast("int") / 3) * 10 + parts[1].cast("int")))


# --- report files -------------------------------------------------------------------------------


def report_file(spark: SparkSession, sf_dir: str) -> str:
    """Aggregate rows of a board as a CSV file."""
    from gyrolake.operators import reporting as P

    rows = P.with_baselines(board(spark, sf_dir))
    told = rows.select("motion_bin", "noise_deg", "occlusion_prob", "method", F.col("err").alias("mean_tracking_error_deg"), F.col("improvement_vs_raw").alias("mean_improvement_vs_raw_deg"), F.when(F.col("method") != "ema", F.col("improvement_vs_persistence")).alias("mean_improvement_vs_persistence_deg"), F.col("row_count").cast("string").alias("row_count"), "dataset")
    path = new_folder(spark, "report")
    T.write_csv(told, path)
    return path


@register(f"WITH {BASED_SQL} SELECT method, count(*) AS n, round(avg(err),6)+0.0 AS err, round(avg(CASE WHEN method <> 'ema' THEN improvement_vs_persistence END),6)+0.0 AS gained FROM based GROUP BY method")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of a file as numbers; blanks are no values."""
    rows = T.read_csv(spark, report_file(spark, sf_dir))
    return rows.groupBy("method").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(T.real("mean_tracking_error_deg"))).alias("err"), r6(F.avg(T.real("mean_improvement_vs_persistence_deg"))).alias("gained"))


@register(f"WITH {BASED_SQL} SELECT dataset, 'motion_stratified:' || motion_bin AS source, motion_bin, noise_deg, occlusion_prob, method, method AS transition_model, round(err,6)+0.0 AS tracking_error_deg, round(raw_err,6)+0.0 AS raw_measurement_error_deg, CASE WHEN method <> 'ema' THEN round(persistence_err,6)+0.0 END AS persistence_error_deg, row_count FROM based WHERE dataset = 'ASIA'")
def motion_run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a run's file, or of the other file where that has none."""
    path = report_file(spark, sf_dir)
    rows = T.first_of(T.read_csv(spark, f"{path}/none"), T.read_csv(spark, path)).filter("dataset = 'ASIA'")
    told = T.motion_rows(rows.drop("dataset"), "ASIA")
    return told.select("dataset", "source", "motion_bin", "noise_deg", "occlusion_prob", "method", "transition_model", *[r6(c).alias(c) for c in ("tracking_error_deg", "raw_measurement_error_deg", "persistence_error_deg")], "row_count")


_RUN = METRICS_SQL + """, runs AS (SELECT dataset, avg(CASE WHEN method = 'gaussian_rw' THEN err END) AS f, avg(CASE WHEN method = 'raw_measurement' THEN err END) AS o, avg(CASE WHEN method = 'ema' THEN err END) AS j, avg(CASE WHEN method = 'persistence' THEN err END) AS p, count(*) AS row_count FROM metrics GROUP BY dataset),
means AS (SELECT dataset, CASE WHEN dataset = 'ASIA' THEN 7.5 ELSE f END AS f, CASE WHEN dataset <> 'EUROPE' THEN o END AS o, j, p, row_count FROM runs)"""


def detector_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of runs and their summaries through files, as means of each run."""
    of = lambda m: F.when(F.col("method") == m, F.col("err"))
    rows = metric_rows(spark, sf_dir).select("dataset", of("gaussian_rw").alias("filter_error_deg"), F.when(F.col("dataset") != "EUROPE", of("raw_measurement")).alias("observed_error_deg"), of("ema").alias("observed_joint_error_deg"), of("persistence").alias("persistence_error_deg"))
    csv, summary = new_folder(spark, "metrics"), new_folder(spark, "summary")
    T.write_csv(rows, csv)
    schema = "dataset string, filter_error_deg double, observed_error_deg double, observed_joint_error_deg double, persistence_error_deg double"
    T.write_json(spark.createDataFrame([("ASIA", 7.5, None, None, None), ("EUROPE", float("nan"), None, None, None)], schema), summary)
    return T.detector_means(T.read_csv(spark, csv), T.read_json(spark, summary, schema), ["dataset"])


@register(f"""WITH {_RUN}, r AS (SELECT dataset, 'raw_measurement' AS method, o AS err, 0.0::DOUBLE AS a, p - o AS b, o, p, row_count FROM means WHERE o IS NOT NULL UNION ALL SELECT dataset, 'persistence', p, o - p, 0.0, o, p, row_count FROM means UNION ALL SELECT dataset, 'gaussian_rw', f, coalesce(o, j) - f, p - f, o, p, row_count FROM means)
SELECT dataset, method, round(err,6)+0.0 AS tracking_error_deg, round(a,6)+0.0 AS improvement_vs_raw_deg, round(b,6)+0.0 AS improvement_vs_persistence_deg, row_count FROM r""")
def detector_run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary's finite means come before those of the rows; the gain on raw falls back to the unweighted error."""
    rows = T.detector_rows(detector_run(spark, sf_dir), "gaussian_rw")
    return rows.select("dataset", "method", *[r6(c).alias(c) for c in ("tracking_error_deg", "improvement_vs_raw_deg", "improvement_vs_persistence_deg")], "row_count")


@register(f"WITH {_RUN}, m AS (SELECT {CND} FROM metrics WHERE dataset = 'ASIA' GROUP BY {CND}, method) SELECT dataset, 'motion_stratified:' || motion_bin AS source, noise_deg, count(*) AS n FROM m GROUP BY ALL UNION ALL SELECT dataset, 'detector_hmr', NULL, CASE WHEN dataset = 'EUROPE' THEN 2 ELSE 3 END FROM means")
def ragged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector rows and motion rows in one table, each null where it has no such column."""
    motion = T.motion_rows(T.read_csv(spark, report_file(spark, sf_dir)).filter("dataset = 'ASIA'").drop("dataset"), "ASIA")
    rows = T.united(motion, T.detector_rows(detector_run(spark, sf_dir), "gaussian_rw"))
    return rows.groupBy("dataset", "source", "noise_deg").agg(F.count(F.lit(1)).alias("n"))


@register(f"WITH {METRICS_SQL} SELECT method, 7 AS seed, num_particles, 'run_b' AS run_dir, count(*) AS n FROM metrics WHERE motion_bin = 'low_motion' GROUP BY ALL UNION ALL SELECT method, 5, 256, 'run_a', count(*) FROM metrics WHERE motion_bin = 'high_motion' GROUP BY ALL")
def run_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of several runs with each run's tags; what a row says itself stays."""
    rows = metric_rows(spark, sf_dir)
    a = T.tagged(rows.filter("motion_bin = 'high_motion'").drop("num_particles"), seed=5, num_particles=256, run_dir="run_a")
    b = T.tagged(rows.filter("motion_bin = 'low_motion'"), seed=7, num_particles=1, run_dir="run_b")
    return T.united(a, b).groupBy("method", "seed", "num_particles", "run_dir").agg(F.count(F.lit(1)).alias("n"))


@register(f"WITH {BASED_SQL} SELECT method, noise_deg, NULL::VARCHAR AS more, CAST(row_count AS VARCHAR) AS row_count, occlusion_prob FROM based WHERE dataset = 'AFRICA' AND motion_bin = 'low_motion'")
def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written table has the columns asked for, in order; those it lacks are blank."""
    rows = board(spark, sf_dir).filter("dataset = 'AFRICA' and motion_bin = 'low_motion'")
    path = new_folder(spark, "table")
    T.write_csv(rows, path, ["method", "noise_deg", "more", "row_count", "occlusion_prob"])
    return T.read_csv(spark, path)


@register(f"WITH {VECTORS_SQL} SELECT seq, count(*) AS frames, round(avg(x),6)+0.0 AS mean_x FROM vectors WHERE joint = 0 GROUP BY seq")
def bundle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements saved by sequence and read again."""
    path = written(frames(spark, sf_dir).select(F.col("seq").alias("file"), F.col("a").alias("poses")), "detector")
    saved = new_folder(spark, "bundle")
    M.load_measurements(spark, path, M.Import(joints=21)).write.partitionBy("seq").parquet(saved)
    back = R.with_log(spark.read.parquet(saved).filter("joint = 0"), "r", "v")
    return back.groupBy(F.col("seq").cast("int").alias("seq")).agg(F.count(F.lit(1)).alias("frames"), r6(F.avg("v0")).alias("mean_x"))
