"""Queries over detector streams, windows and splits."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyrolake.functions import rotations as R
from gyrolake.operators import filtering as O
from gyrolake.operators import windows as N
from gyrolake.plans.bindings import DETECTIONS_SQL, POSES_SQL, VECTORS_SQL, detections, dist_sql, exp_sql, poses, sequence, table, vectors
from gyrolake.plans.geometry import STEPS_SQL, STEP, ordered, r6, stepped

QUERIES: dict = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def by_time() -> Window:
    return Window.partitionBy("seq").orderBy("t")


def u_sql(*key: str) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {', '.join(key)})), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


@register(f"WITH {VECTORS_SQL} SELECT seq, t, joint, t = 0 OR {u_sql('3', 'seq', 't', 'joint')} >= 0.25 AS visible FROM vectors")
def iid_occlusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = R.uniform(F.lit(3), F.col("seq"), F.col("t"), F.col("joint"))
    return vectors(spark, sf_dir).select("seq", "t", "joint", ((F.col("t") == 0) | (u >= 0.25)).alias("visible"))


_E, _L = O.markov_rates(0.3)


@register(f"""WITH RECURSIVE {DETECTIONS_SQL}, u AS (SELECT seq, t, {u_sql('5', 'seq', 't')} AS u FROM detections),
chain AS (SELECT seq, t, u < 0.3 AS hidden FROM u WHERE t = 0 UNION ALL SELECT u.seq, u.t, CASE WHEN c.hidden THEN u.u >= {_L!r} ELSE u.u < {_E!r} END FROM chain c JOIN u ON u.seq = c.seq AND u.t = c.t + 1)
SELECT seq, count(*) AS frames, count(*) FILTER (hidden) AS hidden FROM chain GROUP BY seq""")
def markov_occlusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = O.markov_hidden(detections(spark, sf_dir).select("seq", "t"), ["seq"], 0.3, 5)
    return chain.groupBy("seq").agg(F.count(F.lit(1)).alias("frames"), F.count_if("hidden").alias("hidden"))


_SIG = "sqrt(greatest(0.0004 + pow(1 - greatest(0.0, least(1.0, confidence)), 2.0) * (0.16 - 0.0004), 1e-16))"


@register(f"WITH {DETECTIONS_SQL} SELECT seq, t, round(CASE WHEN mask THEN {_SIG} ELSE 0.4 END,6)+0.0 AS sigma FROM detections")
def confidence_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select("seq", "t", r6(R.confidence_sigma(F.col("confidence"), 0.02, 0.4, 2.0, F.col("mask"))).alias("sigma"))


def _n_sql(*key: str) -> str:
    u, v = u_sql(*key, "'u'"), u_sql(*key, "'v'")
    return f"(sqrt(-2*ln(1-{u}))*cos(2*pi()*{v}))"


MEASURED_SQL = POSES_SQL + ", noise AS (SELECT *, " + ", ".join(f"0.2::DOUBLE*{_n_sql('9', 'seq', 't', 'joint', str(k))} AS n{k}" for k in range(3)) + f", t = 0 OR {u_sql('3', 'seq', 't', 'joint')} >= 0.25 AS mask, 0.2 + 0.8*{u_sql('4', 'seq', 't', 'joint')} AS confidence FROM poses)," + exp_sql("noise", "turned", ("n0", "n1", "n2"), "q") + ", measured AS (SELECT *, " + ", ".join(f"q{3 * i}*r{j} + q{3 * i + 1}*r{3 + j} + q{3 * i + 2}*r{6 + j} AS o{3 * i + j}" for i in range(3) for j in range(3)) + f" FROM turned), erred AS (SELECT *, degrees({dist_sql('o{k}', 'r{k}')}) AS err, lag(mask) OVER (PARTITION BY seq, joint ORDER BY t) AS before FROM measured)"


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """poses with mask, confidence, the noisy observation o0..o8, its error in degrees, and the mask of the frame before."""
    return observed(poses(spark, sf_dir))


def observed(p: DataFrame) -> DataFrame:
    """The same for any poses."""
    key = [F.col("seq"), F.col("t"), F.col("joint")]
    p = p.withColumns({f"n{k}": 0.2 * R.normal(F.lit(9), *key, F.lit(k)) for k in range(3)})
    p = p.withColumns({"mask": (F.col("t") == 0) | (R.uniform(F.lit(3), *key) >= 0.25), "confidence": 0.2 + 0.8 * R.uniform(F.lit(4), *key)})
    p = R.with_exp(p, ["n0", "n1", "n2"], "q")
    p = p.withColumns(dict(zip(R.names("o"), R.matmul(R.cols("q"), R.cols("r")), strict=True)))
    return p.withColumn("err", F.degrees(R.geodesic(R.cols("o"), R.cols("r")))).withColumn("before", F.lag("mask").over(ordered()))


@register(f"WITH {MEASURED_SQL} SELECT seq, t, joint, mask, " + ", ".join(f"round(o{k},5)+0.0 AS o{k}" for k in range(9)) + " FROM measured")
def synthetic_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).select("seq", "t", "joint", "mask", *[(F.round(f"o{k}", 5) + 0.0).alias(f"o{k}") for k in range(9)])


_ERR = "round(avg(CASE WHEN mask THEN err END),5)+0.0 AS observed, round(avg(CASE WHEN NOT mask THEN err END),5)+0.0 AS occluded, round(avg(CASE WHEN mask AND NOT before THEN err END),5)+0.0 AS reappeared, round(sum(CASE WHEN mask THEN confidence*err END)/sum(CASE WHEN mask THEN confidence END),5)+0.0 AS weighted, count(*) FILTER (NOT mask) AS hidden"


def _errors():
    mask, err, c = F.col("mask"), F.col("err"), F.col("confidence")
    five = lambda x, n: (F.round(x, 5) + 0.0).alias(n)
    return [
        five(F.avg(F.when(mask, err)), "observed"),
        five(F.avg(F.when(~mask, err)), "occluded"),
        five(F.avg(F.when(mask & ~F.col("before"), err)), "reappeared"),
        five(F.try_divide(F.sum(F.when(mask, c * err)), F.sum(F.when(mask, c))), "weighted"),
        F.count_if(~mask).alias("hidden"),
    ]


@register(f"WITH {MEASURED_SQL} SELECT seq, {_ERR} FROM erred GROUP BY seq")
def filter_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).groupBy("seq").agg(*_errors())


@register(f"WITH {MEASURED_SQL} SELECT seq, joint, {_ERR} FROM erred GROUP BY seq, joint")
def per_joint_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).groupBy("seq", "joint").agg(*_errors())


@register(f"WITH {MEASURED_SQL} SELECT seq, t, {_ERR}, round(avg(avg(confidence)) OVER (PARTITION BY seq),6)+0.0 AS sequence_confidence FROM erred GROUP BY seq, t")
def trajectory_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = measured(spark, sf_dir).groupBy("seq", "t").agg(*_errors(), F.avg("confidence").alias("c"))
    return frames.withColumn("sequence_confidence", r6(F.avg("c").over(Window.partitionBy("seq")))).drop("c")


@register(f"WITH {MEASURED_SQL}, f AS (SELECT *, " + ", ".join(f"first_value(r{k}) OVER (PARTITION BY seq, joint ORDER BY t) AS f{k}" for k in range(9)) + f" FROM poses) SELECT seq, round(avg(degrees({dist_sql('r{k}', 'f{k}')})),6)+0.0 AS persistence_deg FROM f GROUP BY seq")
def persistence_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = poses(spark, sf_dir).withColumns({f"f{k}": F.first(f"r{k}").over(ordered()) for k in range(9)})
    return held.groupBy("seq").agg(r6(F.avg(F.degrees(R.geodesic(R.cols("r"), R.cols("f"))))).alias("persistence_deg"))


_CLEAN = "(ln(1 - 0.05::DOUBLE) - 0.5*pow(radians(err)/0.3, 2.0))"


@register(f"WITH {MEASURED_SQL} SELECT seq, t, round(sum(CASE WHEN mask THEN confidence * -0.5*pow(radians(err)/0.3, 2.0) ELSE 0 END),5)+0.0 AS clean, round(sum(CASE WHEN mask THEN confidence*(greatest({_CLEAN}, ln(0.05::DOUBLE)) + ln(1+exp(-abs({_CLEAN} - ln(0.05::DOUBLE))))) ELSE 0 END),5)+0.0 AS robust FROM erred GROUP BY seq, t")
def joint_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, c = F.radians("err"), F.when(F.col("mask"), F.col("confidence")).otherwise(0.0)
    five = lambda x, n: (F.round(F.sum(x), 5) + 0.0).alias(n)
    return measured(spark, sf_dir).groupBy("seq", "t").agg(five(O.log_likelihood(d, F.lit(0.3), c), "clean"), five(O.log_likelihood(d, F.lit(0.3), c, 0.05), "robust"))


OUTLIER_SQL = f"{u_sql('13', 'seq', 't', 'joint')} < 0.15 AND mask"


@register(f"WITH {MEASURED_SQL} SELECT seq, count(*) FILTER ({OUTLIER_SQL}) AS outliers, round(avg(CASE WHEN mask THEN CAST({OUTLIER_SQL} AS INTEGER) END),6)+0.0 AS outlier_fraction, round(avg(CASE WHEN mask THEN CASE WHEN {OUTLIER_SQL} THEN 60.0 ELSE err END END),5)+0.0 AS observed FROM erred GROUP BY seq")
def outlier_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible joints replaced with probability 0.15, by an error of 60 degrees."""
    mask = F.col("mask")
    out = (R.uniform(F.lit(13), F.col("seq"), F.col("t"), F.col("joint")) < 0.15) & mask
    return measured(spark, sf_dir).groupBy("seq").agg(F.count_if(out).alias("outliers"), r6(F.avg(F.when(mask, out.cast("int")))).alias("outlier_fraction"), (F.round(F.avg(F.when(mask, F.when(out, 60.0).otherwise(F.col("err")))), 5) + 0.0).alias("observed"))


# --- weights: a user's events as particles ----------------------------------------------------

WEIGHTS_SQL = DETECTIONS_SQL + ", lw AS (SELECT *, -0.5*pow(angle/0.3, 2.0) AS lw FROM detections), e AS (SELECT *, exp(lw - max(lw) OVER (PARTITION BY seq)) AS e FROM lw), weights AS (SELECT *, e / sum(e) OVER (PARTITION BY seq) AS w FROM e)"


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.normalised(detections(spark, sf_dir).withColumn("lw", -0.5 * F.pow(F.col("angle") / 0.3, F.lit(2.0))), ["seq"])


@register(f"WITH {WEIGHTS_SQL} SELECT seq, t, round(w,9)+0.0 AS w FROM weights")
def weight_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights(spark, sf_dir).select("seq", "t", (F.round("w", 9) + 0.0).alias("w"))


@register(f"WITH {WEIGHTS_SQL} SELECT seq, round(1/sum(w*w),5)+0.0 AS ess, count(*) AS n, 1/sum(w*w) <= 0.05*count(*) AS collapsed FROM weights GROUP BY seq")
def ess_by_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = O.effective_size(weights(spark, sf_dir), ["seq"])
    return e.select("seq", (F.round("ess", 5) + 0.0).alias("ess"), "n", (F.col("ess") <= 0.05 * F.col("n")).alias("collapsed"))


@register(f"""WITH {WEIGHTS_SQL}, c AS (SELECT seq, t, sum(w) OVER (PARTITION BY seq ORDER BY t) AS upto, count(*) OVER (PARTITION BY seq) AS n FROM weights), d AS (SELECT seq, t, n, CASE WHEN t = n - 1 THEN 1.0 ELSE upto END AS upto FROM c),
pos AS (SELECT seq, unnest(range(n)) AS position, n FROM (SELECT DISTINCT seq, n FROM d)) SELECT p.seq, position, min(t) AS t FROM pos p JOIN d ON d.seq = p.seq AND upto >= (0.37 + position)/p.n GROUP BY p.seq, position""")
def systematic_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.systematic(weights(spark, sf_dir), ["seq"], "t", 0.37)


@register(f"""WITH {DETECTIONS_SQL}, l AS (SELECT seq, list(CASE WHEN mask THEN angle END ORDER BY t) AS a FROM detections GROUP BY seq)
SELECT seq, round(list_reduce(a, lambda s, x: CASE WHEN x IS NULL THEN s WHEN s IS NULL THEN x ELSE s + 0.35*(x - s) END),6)+0.0 AS ema FROM l""")
def ema_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causal exponential mean of the visible angles about one axis; hidden frames keep the state."""
    steps = detections(spark, sf_dir).groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("t", F.when(F.col("mask"), F.col("angle")).alias("x")))).alias("s"))
    fold = F.aggregate(F.transform("s", lambda e: e["x"]), F.lit(None).cast("double"), lambda s, x: F.when(x.isNull(), s).when(s.isNull(), x).otherwise(s + 0.35 * (x - s)))
    return steps.select("seq", r6(fold).alias("ema"))


@register(f"WITH {DETECTIONS_SQL} SELECT seq, t, last_value(CASE WHEN mask THEN round(angle,6)+0.0 END IGNORE NULLS) OVER (PARTITION BY seq ORDER BY t) AS held FROM detections")
def hold_last_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select("seq", "t", F.last(F.when(F.col("mask"), r6("angle")), ignorenulls=True).over(by_time()).alias("held"))


@register(f"WITH {DETECTIONS_SQL} SELECT seq, count(*) FILTER (mask AND confidence > 0 AND value < 450) AS active, round(avg(CASE WHEN mask AND confidence > 0 AND value < 450 THEN confidence END),6)+0.0 AS mean_confidence FROM detections GROUP BY seq")
def mask_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame is active if its value is in range, it is not masked and its confidence is positive."""
    active = F.col("mask") & (F.col("confidence") > 0) & (F.col("value") < 450)
    return detections(spark, sf_dir).groupBy("seq").agg(F.count_if(active).alias("active"), r6(F.avg(F.when(active, F.col("confidence")))).alias("mean_confidence"))


@register(f"WITH {DETECTIONS_SQL}, {VECTORS_SQL}, f AS (SELECT DISTINCT seq, t FROM vectors) SELECT f.seq, count(*) AS frames, round(avg(confidence),6)+0.0 AS confidence FROM f JOIN detections d ON f.seq = d.seq AND f.t = d.t GROUP BY f.seq HAVING count(*) >= 2")
def detector_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and detections of a sequence meet frame by frame, over the frames that both have."""
    frames = vectors(spark, sf_dir).select("seq", "t").distinct()
    met = frames.join(detections(spark, sf_dir), ["seq", "t"]).groupBy("seq").agg(F.count(F.lit(1)).alias("frames"), r6(F.avg("confidence")).alias("confidence"))
    return met.filter("frames >= 2")


@register(f"WITH {DETECTIONS_SQL}, {VECTORS_SQL} SELECT DISTINCT seq FROM detections WHERE seq NOT IN (SELECT seq FROM frames)")
def detector_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "embeddings").select(sequence().alias("seq"))
    return detections(spark, sf_dir).select("seq").distinct().join(known, "seq", "left_anti")


@register(f"WITH {VECTORS_SQL}, dim AS (SELECT unnest(range(23)) AS j), f AS (SELECT DISTINCT seq, t FROM vectors) SELECT f.seq, f.t, CAST(j AS INTEGER) AS joint, round(coalesce(x,0),6)+0.0 AS x, x IS NOT NULL AS valid FROM f CROSS JOIN dim LEFT JOIN vectors v ON v.seq = f.seq AND v.t = f.t AND v.joint = j")
def hmr_pad_joints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """21 joints padded to 23: missing ones stand still and are not valid."""
    v = vectors(spark, sf_dir).groupBy("seq", "t").agg(F.map_from_entries(F.collect_list(F.struct("joint", "x"))).alias("m"))
    full = v.select("seq", "t", "m", F.explode(F.sequence(F.lit(0), F.lit(22))).alias("joint"))
    x = F.try_element_at("m", F.col("joint"))
    return full.select("seq", "t", "joint", r6(F.coalesce(x, F.lit(0.0))).alias("x"), x.isNotNull().alias("valid"))


@register("WITH k AS (SELECT user_id AS seq, unnest(json_keys(props)) AS key FROM events UNION ALL SELECT user_id, event_type FROM events), n AS (SELECT user_id AS seq, count(*) AS frames FROM events GROUP BY 1) SELECT k.seq, key FROM k JOIN n USING (seq) GROUP BY k.seq, key, frames HAVING count(*) = frames")
def json_frames_all_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that every frame of a sequence has."""
    e = table(spark, sf_dir, "events")
    keys = F.concat(F.json_object_keys("props"), F.array("event_type"))
    n = e.groupBy(F.col("user_id").alias("seq")).agg(F.count(F.lit(1)).alias("frames"))
    found = e.select(F.col("user_id").alias("seq"), F.explode(keys).alias("key")).groupBy("seq", "key").agg(F.count(F.lit(1)).alias("n"))
    return found.join(n, "seq").filter("n = frames").select("seq", "key")


@register("SELECT p_partkey, greatest(1, CAST(round_even(p_size / 20.0::DOUBLE, 0) AS BIGINT)) AS stride FROM part")
def downsample_bround(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strides round half to even, and are at least 1."""
    return table(spark, sf_dir, "part").select("p_partkey", F.greatest(F.lit(1), F.bround(F.col("p_size") / 20.0, 0).cast("long")).alias("stride"))


@register("SELECT user_id, count(*) AS sessions, CAST(max(n) AS BIGINT) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS g FROM events)) GROUP BY ALL) GROUP BY user_id")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    sessions = e.groupBy("user_id", F.session_window("at", "6 hours")).agg(F.count(F.lit(1)).alias("n"))
    return sessions.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


# --- windows over sequences -------------------------------------------------------------------

LENGTH, STRIDE, LIMIT = 12, 5, 20
FRAMES_SQL = STEPS_SQL + f", moved AS (SELECT seq, t, avg(degrees({STEP})) AS d FROM steps GROUP BY seq, t)"
CANDIDATES_SQL = FRAMES_SQL + f""", sizes AS (SELECT seq, max(t)+1 AS n FROM moved GROUP BY seq), placed AS (SELECT seq, n, unnest(CASE WHEN n <= {LENGTH} THEN [0] ELSE list_distinct(list_concat(range(0, n-{LENGTH}+1, {STRIDE}), [n-{LENGTH}])) END) AS start FROM sizes),
wins AS (SELECT seq, CAST(start AS INTEGER) AS start, CAST(least(start+{LENGTH}, n) AS INTEGER) AS stop FROM placed), cand AS (SELECT w.seq, start, stop, round(avg(d),9) AS motion FROM wins w JOIN moved f ON f.seq = w.seq AND f.t > start AND f.t < stop GROUP BY ALL)"""


def window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.degrees(R.geodesic(R.cols("r"), R.cols("p")))
    frames = stepped(poses(spark, sf_dir)).groupBy("seq", "t").agg(F.avg(d).alias("d"))
    return N.candidates(frames, LENGTH, STRIDE).withColumn("motion", F.round("motion", 9))


WINDOW_COLUMNS = "seq, start, stop, round(motion,6)+0.0 AS motion"


def window_columns(df: DataFrame) -> DataFrame:
    return df.select("seq", "start", "stop", r6("motion").alias("motion"))


@register(f"WITH {CANDIDATES_SQL} SELECT {WINDOW_COLUMNS} FROM cand")
def window_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_columns(window_rows(spark, sf_dir))


@register(f"WITH {CANDIDATES_SQL} SELECT {WINDOW_COLUMNS} FROM cand ORDER BY cand.seq, cand.start LIMIT {LIMIT}")
def select_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_columns(N.select_first(window_rows(spark, sf_dir), LIMIT))


@register(f"WITH {CANDIDATES_SQL} SELECT {WINDOW_COLUMNS} FROM cand ORDER BY cand.motion DESC, cand.seq, cand.start LIMIT {LIMIT}")
def select_top_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_columns(N.select_top_motion(window_rows(spark, sf_dir), LIMIT))


_BIN = "CASE WHEN motion >= 0 AND motion < 0.5 THEN 'low_motion' WHEN motion >= 0.5 AND motion < 1.5 THEN 'medium_motion' ELSE 'high_motion' END"


@register(
    f"WITH {CANDIDATES_SQL}, top AS (SELECT * FROM cand ORDER BY motion DESC, seq, start LIMIT {LIMIT}), r AS (SELECT *, row_number() OVER (ORDER BY motion DESC, seq, start) - 1 AS rank FROM top) "
    f"SELECT CAST(rank AS INTEGER) AS rank, 'takes/take ' || seq || '.npz' AS source, start * 3 AS source_start_frame, stop * 3 AS source_stop_frame, round(motion,6)+0.0 AS motion, {_BIN} AS motion_bin, 'segment_' || lpad(CAST(rank AS VARCHAR), 3, '0') || '_take_' || seq || '.npz' AS output FROM r"
)
def window_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the fastest windows come from, and the files they become."""
    chosen = N.select_top_motion(window_rows(spark, sf_dir), LIMIT)
    source = F.concat(F.lit("takes/take "), F.col("seq").cast("string"), F.lit(".npz"))
    return N.manifest(chosen, [F.desc("motion"), "seq", "start"], source, 3).withColumn("motion", r6("motion"))


_AT = "'take_' || seq || '@' || start"


@register(
    f"WITH {CANDIDATES_SQL}, w AS (SELECT *, {_BIN} AS motion_bin, CAST(ceil((stop - start) / 5.0) AS BIGINT) AS frames, {_AT} AS told FROM cand), e AS (SELECT *, row_number() OVER (PARTITION BY motion_bin ORDER BY seq, start) AS nth, row_number() OVER (PARTITION BY motion_bin, frames < 3 ORDER BY seq, start) AS short FROM w) "
    "SELECT motion_bin, count(*) AS windows, count(*) FILTER (frames >= 3) AS usable, string_agg(told, '; ' ORDER BY nth) FILTER (nth <= 5) AS source_examples, coalesce(string_agg(told || ': ' || frames || ' frames, 3 needed', '; ' ORDER BY short) FILTER (frames < 3 AND short <= 5), '') AS rejection_examples FROM e GROUP BY motion_bin"
)
def segment_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of each motion bin, those that are long enough after downsampling by five, and examples."""
    return N.segment_diagnostics(window_rows(spark, sf_dir), F.concat(F.lit("take_"), F.col("seq").cast("string")), 5, 3)


@register(f"WITH {CANDIDATES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY motion DESC, start) AS nth FROM cand) SELECT {WINDOW_COLUMNS} FROM k WHERE nth <= 2 ORDER BY k.motion DESC, k.seq, k.start LIMIT {LIMIT}")
def per_file_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_columns(N.select_top_motion(window_rows(spark, sf_dir), LIMIT, per_file=2))


@register(f"WITH {CANDIDATES_SQL}, k AS (SELECT *, row_number() OVER (ORDER BY seq, start) - 1 AS place, count(*) OVER () AS n FROM cand) SELECT {WINDOW_COLUMNS} FROM k WHERE n <= {LIMIT} OR place IN (SELECT i*(SELECT max(n)-1 FROM k)//{LIMIT - 1} FROM range({LIMIT}) r(i))")
def select_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_columns(N.select_uniform(window_rows(spark, sf_dir), LIMIT))


@register(f"""WITH {CANDIDATES_SQL}, b AS (SELECT *, CASE WHEN motion < 0.5 THEN 0 WHEN motion < 1.5 THEN 1 ELSE 2 END AS bin FROM cand), p AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY motion DESC, seq, start) AS place FROM b),
l AS (SELECT *, CASE WHEN place > {LIMIT // 3} + CASE WHEN bin < {LIMIT - LIMIT // 3 * 3} THEN 1 ELSE 0 END THEN 1 ELSE 0 END AS late FROM p) SELECT {WINDOW_COLUMNS} FROM l ORDER BY late, CASE WHEN late = 0 THEN bin ELSE 0 END, l.motion DESC, l.seq, l.start LIMIT {LIMIT}""")
def select_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_columns(N.select_balanced(window_rows(spark, sf_dir), LIMIT))


@register(f"WITH {CANDIDATES_SQL} SELECT w.seq, w.start, f.t, f.t - w.start AS t_in_window, round(d,6)+0.0 AS d FROM wins w JOIN moved f ON f.seq = w.seq AND f.t >= w.start AND f.t < w.stop")
def materialise_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each window's frames: a range join within the sequence and a block of frames."""
    d = F.degrees(R.geodesic(R.cols("r"), R.cols("p")))
    frames = stepped(poses(spark, sf_dir)).groupBy("seq", "t").agg(F.avg(d).alias("d"))
    sizes = frames.groupBy("seq").agg((F.max("t") + 1).cast("int").alias("n"))
    placed = sizes.select("seq", F.explode(N.starts(F.col("n"), LENGTH, STRIDE)).alias("start"), "n").withColumn("stop", F.least(F.col("start") + LENGTH, F.col("n")))
    dealt = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / LENGTH), F.floor((F.col("stop") - 1) / LENGTH))))
    met = dealt.join(frames.withColumn("block", F.floor(F.col("t") / LENGTH)), ["seq", "block"]).filter("t >= start and t < stop")
    return met.select("seq", "start", "t", (F.col("t") - F.col("start")).alias("t_in_window"), r6("d").alias("d"))


@register("SELECT page_id, url FROM pages ORDER BY CASE WHEN lower(url) LIKE '%.html' THEN 0 ELSE 1 END, lower(url), page_id LIMIT 25")
def select_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferred endings first, then by name whatever its case."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.orderBy(F.when(F.lower("url").like("%.html"), 0).otherwise(1), F.lower("url"), "page_id").limit(25)


@register(f"""WITH s AS (SELECT DISTINCT user_id AS seq FROM events), r AS (SELECT seq, row_number() OVER (ORDER BY {u_sql('0', 'seq')}, seq) AS place, count(*) OVER () AS n FROM s), c AS (SELECT *, greatest(1, round_even(n*0.7, 0)) AS a, greatest(1, round_even(n*0.15, 0)) AS b FROM r)
SELECT seq, CASE WHEN place <= a THEN 'train' WHEN place <= a + b THEN 'val' ELSE 'test' END AS split FROM c""")
def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gyrolake.operators.splits import assign

    return assign(table(spark, sf_dir, "events").select(F.col("user_id").alias("seq")).distinct(), 0)


@register(f"""WITH RECURSIVE {VECTORS_SQL}, u AS (SELECT seq, joint, t, {u_sql('6', 'seq', 'joint', 't')} AS u FROM vectors),
chain AS (SELECT seq, joint, t, u < 0.4 AS hidden FROM u WHERE t = 0 UNION ALL SELECT u.seq, u.joint, u.t, CASE WHEN c.hidden THEN u.u >= 0.08 ELSE u.u < {O.markov_rates(0.4, 0.08)[0]!r} END FROM chain c JOIN u ON u.seq = c.seq AND u.joint = c.joint AND u.t = c.t + 1)
SELECT seq, joint, t, hidden FROM chain""")
def markov_joint_occlusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of hidden and seen frames for each joint, with a given rate of coming back."""
    return O.markov_hidden(vectors(spark, sf_dir).select("seq", "joint", "t"), ["seq", "joint"], 0.4, 6, recovery=0.08)


@register(f"WITH {CANDIDATES_SQL} SELECT {WINDOW_COLUMNS} FROM cand WHERE cand.motion >= 1.0 AND stop - start >= {LENGTH}")
def windows_that_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole windows of at least a given motion."""
    return window_columns(window_rows(spark, sf_dir).filter((F.col("motion") >= 1.0) & (F.col("stop") - F.col("start") >= LENGTH)))


_GRID = ", ".join(f"({n}, {o})" for n in (5, 10, 20) for o in (0.0, 0.25, 0.5))
_UNIT = ", ".join(f"{_n_sql('9', 'seq', 't', 'joint', str(k))} * radians(CAST(noise_deg AS DOUBLE)) AS n{k}" for k in range(3))
GRID_SQL = POSES_SQL + f", grid(noise_deg, occlusion_prob) AS (VALUES {_GRID}), noise AS (SELECT noise_deg, occlusion_prob, seq, t, joint, {_UNIT}, t = 0 OR {u_sql('3', 'seq', 't', 'joint')} >= occlusion_prob AS mask, {', '.join(f'r{k}' for k in range(9))} FROM poses, grid)," + exp_sql("noise", "turned", ("n0", "n1", "n2"), "q") + ", measured AS (SELECT *, " + ", ".join(f"q{3 * i}*r{j} + q{3 * i + 1}*r{3 + j} + q{3 * i + 2}*r{6 + j} AS o{3 * i + j}" for i in range(3) for j in range(3)) + f" FROM turned), erred AS (SELECT *, degrees({dist_sql('o{k}', 'r{k}')}) AS err FROM measured)"


def over_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of all poses under every noise and occlusion of a grid: (noise_deg, occlusion_prob, seq, t, joint, mask, err, ...)."""
    grid = F.explode(F.array(*[F.struct(F.lit(n).alias("noise_deg"), F.lit(o).alias("occlusion_prob")) for n in (5, 10, 20) for o in (0.0, 0.25, 0.5)]))
    key = [F.col("seq"), F.col("t"), F.col("joint")]
    unit = poses(spark, sf_dir).withColumns({f"u{k}": R.normal(F.lit(9), *key, F.lit(k)) for k in range(3)}).withColumn("shown", R.uniform(F.lit(3), *key))
    cells = unit.select("*", grid.alias("g")).select("*", "g.*").drop("g")
    cells = cells.withColumns({f"n{k}": F.col(f"u{k}") * F.radians(F.col("noise_deg").cast("double")) for k in range(3)})
    cells = R.with_exp(cells.withColumn("mask", (F.col("t") == 0) | (F.col("shown") >= F.col("occlusion_prob"))), ["n0", "n1", "n2"], "q")
    cells = cells.withColumns(dict(zip(R.names("o"), R.matmul(R.cols("q"), R.cols("r")), strict=True)))
    return cells.withColumn("err", F.degrees(R.geodesic(R.cols("o"), R.cols("r"))))


@register(f"WITH {GRID_SQL}, per AS (SELECT noise_deg, occlusion_prob, seq, avg(CASE WHEN mask THEN err END) AS seen, avg(CAST(mask AS INTEGER)) AS share FROM erred GROUP BY ALL) SELECT noise_deg, CAST(occlusion_prob AS DOUBLE) AS occlusion_prob, round(avg(seen),5)+0.0 AS raw_error_deg, round(min(seen),5)+0.0 AS least, round(max(seen),5)+0.0 AS most, round(avg(share),6)+0.0 AS seen_share, count(*) AS sequences FROM per GROUP BY ALL")
def grid_cell_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over sequences of each sequence's mean error, for every cell of a grid of noise and occlusion."""
    per = over_grid(spark, sf_dir).groupBy("noise_deg", "occlusion_prob", "seq").agg(F.avg(F.when(F.col("mask"), F.col("err"))).alias("seen"), F.avg(F.col("mask").cast("int")).alias("share"))
    five = lambda x, n: (F.round(x, 5) + 0.0).alias(n)
    return per.groupBy("noise_deg", "occlusion_prob").agg(five(F.avg("seen"), "raw_error_deg"), five(F.min("seen"), "least"), five(F.max("seen"), "most"), r6(F.avg("share")).alias("seen_share"), F.count(F.lit(1)).alias("sequences"))


_FAR = ", ".join(f"{_n_sql('31', 'seq', 't', 'joint', str(k))} * radians(greatest(45.0, 6 * 12.0)::DOUBLE) AS h{k}" for k in range(3))


@register(f"WITH {MEASURED_SQL}, far AS (SELECT *, {_FAR} FROM erred)," + exp_sql("far", "spun", ("h0", "h1", "h2"), "w") + f", z AS (SELECT *, {', '.join(f'w{3 * i}*r{j} + w{3 * i + 1}*r{3 + j} + w{3 * i + 2}*r{6 + j} AS z{3 * i + j}' for i in range(3) for j in range(3))} FROM spun) SELECT seq, count(*) FILTER ({OUTLIER_SQL}) AS outliers, round(avg(CASE WHEN mask THEN CASE WHEN {OUTLIER_SQL} THEN degrees({dist_sql('z{k}', 'r{k}')}) ELSE err END END),5)+0.0 AS observed FROM z GROUP BY seq")
def outlier_large_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seen joints replaced with probability 0.15 by the truth under a noise six times as large, at least 45 degrees."""
    key = [F.col("seq"), F.col("t"), F.col("joint")]
    out = (R.uniform(F.lit(13), *key) < 0.15) & F.col("mask")
    far = measured(spark, sf_dir).withColumns({f"h{k}": R.normal(F.lit(31), *key, F.lit(k)) * F.radians(F.lit(max(45.0, 6 * 12.0))) for k in range(3)})
    far = R.with_exp(far, ["h0", "h1", "h2"], "w")
    far = far.withColumns(dict(zip(R.names("z"), R.matmul(R.cols("w"), R.cols("r")), strict=True)))
    err = F.when(out, F.degrees(R.geodesic(R.cols("z"), R.cols("r")))).otherwise(F.col("err"))
    return far.groupBy("seq").agg(F.count_if(out).alias("outliers"), (F.round(F.avg(F.when(F.col("mask"), err)), 5) + 0.0).alias("observed"))
