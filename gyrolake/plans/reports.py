"""Queries of the reporting layer, over metric rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyrolake.operators import reporting as P
from gyrolake.plans.bindings import METRICS_SQL, metric_rows
from gyrolake.plans.geometry import r6

QUERIES: dict = {}
CTX, CND = "dataset, motion_bin", "dataset, motion_bin, noise_deg, occlusion_prob"
BOARD_SQL = METRICS_SQL + f", board AS (SELECT {CND}, method, avg(err) AS err, count(*) AS row_count FROM metrics GROUP BY ALL)"
BASED_SQL = BOARD_SQL + f""", base AS (SELECT {CND}, max(CASE WHEN method = 'raw_measurement' THEN err END) AS raw_err, max(CASE WHEN method = 'persistence' THEN err END) AS persistence_err FROM board GROUP BY ALL),
based AS (SELECT *, raw_err - err AS improvement_vs_raw, persistence_err - err AS improvement_vs_persistence FROM board JOIN base USING ({CND}))"""
CLASS_SQL = "CASE WHEN method = 'raw_measurement' THEN 'raw_measurement' WHEN method = 'persistence' THEN 'causal_baseline' WHEN method IN ('ema', 'chordal', 'savgol_tangent') THEN 'offline_smoother' ELSE 'causal_online_filter' END"
SIGN_SQL = "CASE WHEN w + l > 0 THEN least(1.0, 2 * list_sum(list_transform(range(least(w, l) + 1), lambda k: exp(lgamma(w + l + 1) - lgamma(k + 1) - lgamma(w + l - k + 1) - (w + l) * ln(2))))) END"
SPREAD_SQL = "round(avg(err),6)+0.0 AS mean_err, round(stddev_samp(err),6)+0.0 AS std_err, round(stddev_samp(err)/sqrt(count(err)),6)+0.0 AS sem_err, count(*) AS row_count"


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.board(metric_rows(spark, sf_dir))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@register(f"WITH {METRICS_SQL} SELECT motion_bin, method, {SPREAD_SQL} FROM metrics GROUP BY motion_bin, method")
def method_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metric_rows(spark, sf_dir).groupBy("motion_bin", "method").agg(*P.spread("err", "err"), F.count(F.lit(1)).alias("row_count")))


@register(f"WITH {METRICS_SQL} SELECT motion_bin, noise_deg, occlusion_prob, method, {SPREAD_SQL} FROM metrics GROUP BY GROUPING SETS ((motion_bin, method), (motion_bin, noise_deg, occlusion_prob, method))")
def method_means_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metric_rows(spark, sf_dir)
    keys = ["motion_bin", "noise_deg", "occlusion_prob", "method"]
    grouped = rows.groupingSets([["motion_bin", "method"], keys], *keys)
    return rounded(grouped.agg(*P.spread("err", "err"), F.count(F.lit(1)).alias("row_count")))


@register(f"WITH {BOARD_SQL} SELECT motion_bin, method, round(min(err),6)+0.0 AS min_err, round(median(err),6)+0.0 AS median_err, round(max(err),6)+0.0 AS max_err, round(avg(err),6)+0.0 AS mean_err, count(*) AS grid_point_count FROM board GROUP BY motion_bin, method")
def robustness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("err")
    return rounded(board(spark, sf_dir).groupBy("motion_bin", "method").agg(F.min(e).alias("min_err"), F.median(e).alias("median_err"), F.max(e).alias("max_err"), F.avg(e).alias("mean_err"), F.count(F.lit(1)).alias("grid_point_count")))


TRANSITION_SQL = METRICS_SQL + ", transition AS (SELECT motion_bin, method AS model, 'one_step' AS metric, avg(err) AS value FROM metrics WHERE num_particles = 64 GROUP BY ALL UNION ALL SELECT motion_bin, method, 'rollout', avg(err * 2) FROM metrics WHERE num_particles = 128 AND method <> 'ema' GROUP BY ALL)"


def transition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metric_rows(spark, sf_dir).withColumn("model", F.col("method"))
    one = rows.filter("num_particles = 64").groupBy("motion_bin", "model").agg(F.avg("err").alias("value")).withColumn("metric", F.lit("one_step"))
    far = rows.filter("num_particles = 128 and method <> 'ema'").groupBy("motion_bin", "model").agg(F.avg(F.col("err") * 2).alias("value")).withColumn("metric", F.lit("rollout"))
    return one.unionByName(far).select("motion_bin", "model", "metric", "value")


@register(f"WITH {TRANSITION_SQL} SELECT motion_bin, model, metric, round(value,6)+0.0 AS value FROM transition")
def transition_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(transition_rows(spark, sf_dir))


@register(f"""WITH {TRANSITION_SQL}, means AS (SELECT motion_bin, method, avg(err) AS err FROM metrics GROUP BY ALL), wide AS (SELECT motion_bin, model, max(CASE WHEN metric = 'one_step' THEN value END) AS one_step, max(CASE WHEN metric = 'rollout' THEN value END) AS rollout FROM transition GROUP BY ALL)
SELECT m.motion_bin, method, round(err,6)+0.0 AS err, round(one_step,6)+0.0 AS one_step, round(rollout,6)+0.0 AS rollout FROM means m LEFT JOIN wide w ON m.motion_bin = w.motion_bin AND method = model WHERE one_step IS NOT NULL OR rollout IS NOT NULL""")
def transition_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = transition_rows(spark, sf_dir).groupBy("motion_bin", F.col("model").alias("method")).pivot("metric", ["one_step", "rollout"]).agg(F.max("value"))
    means = metric_rows(spark, sf_dir).groupBy("motion_bin", "method").agg(F.avg("err").alias("err"))
    return rounded(means.join(wide, ["motion_bin", "method"], "left").filter("one_step is not null or rollout is not null"))


@register(f"""WITH {METRICS_SQL}, f AS (SELECT *, num_particles * (err - floor(err)) AS ess, err - floor(err/7)*7 AS spread FROM metrics WHERE method IN ('gaussian_rw', 'constant_velocity'))
SELECT motion_bin, method, round(avg(ess),6)+0.0 AS mean_ess, round(min(ess),6)+0.0 AS min_ess, round(avg(CAST(ess <= 0.05*num_particles OR spread <= 0.25 AS INTEGER)),6)+0.0 AS collapse_fraction, round(avg(CAST(ess < 0.5*num_particles AS INTEGER)),6)+0.0 AS resample_fraction FROM f GROUP BY ALL""")
def collapse_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metric_rows(spark, sf_dir).filter(F.col("method").isin("gaussian_rw", "constant_velocity"))
    rows = rows.withColumns({"ess": F.col("num_particles") * (F.col("err") - F.floor("err")), "spread": F.col("err") - F.floor(F.col("err") / 7) * 7})
    share = lambda c: F.avg(c.cast("int"))
    collapsed = (F.col("ess") <= 0.05 * F.col("num_particles")) | (F.col("spread") <= 0.25)
    return rounded(rows.groupBy("motion_bin", "method").agg(F.avg("ess").alias("mean_ess"), F.min("ess").alias("min_ess"), share(collapsed).alias("collapse_fraction"), share(F.col("ess") < 0.5 * F.col("num_particles")).alias("resample_fraction")))


@register(f"WITH {BASED_SQL} SELECT {CND}, method, round(err,6)+0.0 AS err, round(improvement_vs_raw,6)+0.0 AS improvement_vs_raw, round(improvement_vs_persistence,6)+0.0 AS improvement_vs_persistence FROM based")
def method_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.with_baselines(board(spark, sf_dir)).select(*P.CONDITION, "method", "err", "improvement_vs_raw", "improvement_vs_persistence"))


@register(f"""WITH {BOARD_SQL}, both_ AS (SELECT {CND}, max(CASE WHEN method = 'persistence' THEN err END) AS p, max(CASE WHEN method = 'gaussian_rw' THEN err END) AS g FROM board GROUP BY ALL)
SELECT {CND}, round(CASE WHEN CAST(noise_deg AS DOUBLE) <= 10 THEN g ELSE p END,6)+0.0 AS err, CASE WHEN CAST(noise_deg AS DOUBLE) <= 10 THEN 'gaussian_rw:filter_error_deg' ELSE 'persistence:persistence_error_deg' END AS source_metric FROM both_""")
def noise_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.noise_selected(board(spark, sf_dir)))


@register(f"""WITH {BASED_SQL}, near AS (SELECT *, row_number() OVER (PARTITION BY {CTX}, method ORDER BY abs(CAST(noise_deg AS DOUBLE) - 12), abs(CAST(occlusion_prob AS DOUBLE) - 0.4), CAST(noise_deg AS DOUBLE), CAST(occlusion_prob AS DOUBLE)) AS k FROM based WHERE method = 'gaussian_rw')
SELECT {CTX}, method AS target_method, max(CASE WHEN k = 1 THEN noise_deg END) AS representative_noise_deg, max(CASE WHEN k = 1 THEN occlusion_prob END) AS representative_occlusion_prob, bool_or(k = 1 AND improvement_vs_raw > 0) AS beats_raw_at_representative,
bool_or(improvement_vs_raw > 0) AS beats_raw_any, bool_or(improvement_vs_persistence > 0) AS beats_persistence_any FROM near GROUP BY ALL""")
def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the target method beats the baselines anywhere, and at the grid cell nearest to (12, 0.4)."""
    rows = P.with_baselines(board(spark, sf_dir)).filter("method = 'gaussian_rw'")
    noise, hidden = (F.expr(f"try_cast({c} as double)") for c in ("noise_deg", "occlusion_prob"))
    at = F.struct(F.abs(noise - 12), F.abs(hidden - 0.4), noise, hidden)
    return rows.groupBy(*P.CONTEXT, F.col("method").alias("target_method")).agg(
        F.min_by("noise_deg", at).alias("representative_noise_deg"),
        F.min_by("occlusion_prob", at).alias("representative_occlusion_prob"),
        F.coalesce(F.min_by(F.col("improvement_vs_raw") > 0, at), F.lit(False)).alias("beats_raw_at_representative"),
        F.bool_or(F.col("improvement_vs_raw") > 0).alias("beats_raw_any"),
        F.bool_or(F.col("improvement_vs_persistence") > 0).alias("beats_persistence_any"),
    )


@register(f"WITH {BOARD_SQL} SELECT {CND}, method, round(err,6)+0.0 AS err, CAST(row_number() OVER (PARTITION BY {CND} ORDER BY coalesce(err, 'infinity'::DOUBLE), method) AS INTEGER) AS rank FROM board")
def leaderboard_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.ranked(board(spark, sf_dir)).select(*P.CONDITION, "method", "err", "rank"))


@register(f"WITH {METRICS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY {CND}, method ORDER BY l_orderkey, l_linenumber, err) AS first FROM metrics) SELECT method, count(*) AS rows, round(sum(err),3)+0.0 AS err FROM f WHERE first = 1 OR method NOT IN ('raw_measurement', 'persistence') GROUP BY method")
def baseline_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = P.dedupe_baselines(metric_rows(spark, sf_dir), ["l_orderkey", "l_linenumber", "err"])
    return kept.groupBy("method").agg(F.count(F.lit(1)).alias("rows"), (F.round(F.sum("err"), 3) + 0.0).alias("err"))


@register(f"""WITH {BASED_SQL}, b AS (SELECT *, min(err) OVER (PARTITION BY {CND}) AS best FROM based)
SELECT {CTX}, method, {CLASS_SQL} AS method_class, count(DISTINCT noise_deg || '/' || occlusion_prob) AS condition_count, count(*) FILTER (abs(err-best) <= greatest(1e-12*greatest(abs(err),abs(best)),1e-12)) AS win_count, round(avg(err),6)+0.0 AS mean_err,
round(avg(improvement_vs_raw),6)+0.0 AS mean_improvement_vs_raw, round(avg(improvement_vs_persistence),6)+0.0 AS mean_improvement_vs_persistence, count(*) FILTER (improvement_vs_raw < 0) AS worse_than_raw_count, count(*) FILTER (improvement_vs_persistence < 0) AS worse_than_persistence_count, CAST(sum(row_count) AS BIGINT) AS row_count FROM b GROUP BY {CTX}, method""")
def paper_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.paper_summary(board(spark, sf_dir)))


@register(f"WITH {METRICS_SQL} SELECT {CND}, method, count(*) AS n FROM metrics GROUP BY ALL HAVING count(*) > 1")
def sanity_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_rows(spark, sf_dir).groupBy(*P.CONDITION, "method").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@register(f"WITH {METRICS_SQL} SELECT {CND}, bool_or(method = 'raw_measurement') AS has_raw, bool_or(method = 'persistence') AS has_persistence FROM metrics WHERE err < 40 AND l_linenumber > 1 GROUP BY ALL")
def sanity_missing_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metric_rows(spark, sf_dir).filter("err < 40 and l_linenumber > 1")
    return rows.groupBy(*P.CONDITION).agg(F.bool_or(F.col("method") == "raw_measurement").alias("has_raw"), F.bool_or(F.col("method") == "persistence").alias("has_persistence"))


@register(f"WITH {BOARD_SQL} SELECT {CTX}, arg_min(method, (err, method)) AS best_method, round(min(err),6)+0.0 AS best_err FROM board GROUP BY ALL")
def sanity_best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = board(spark, sf_dir).groupBy(*P.CONTEXT).agg(F.min(F.struct("err", "method")).alias("b"))
    return rounded(best.select(*P.CONTEXT, F.col("b.method").alias("best_method"), F.col("b.err").alias("best_err")))


COMPARED = "count(diff) AS condition_count, round(avg(target_err),6)+0.0 AS target_mean, round(avg(baseline_err),6)+0.0 AS baseline_mean, round(avg(diff),6)+0.0 AS mean_improvement, round(median(diff),6)+0.0 AS median_improvement, count(*) FILTER (diff > 1e-9) AS win_count, count(*) FILTER (diff < -1e-9) AS loss_count"
FINISH = f"*, condition_count - win_count - loss_count AS tie_count, round(win_count / condition_count,6)+0.0 AS win_rate, round({SIGN_SQL.replace('w + l', 'win_count + loss_count').replace('least(w, l)', 'least(win_count, loss_count)')},6)+0.0 AS sign_test_p"
PAIRS_SQL = BOARD_SQL + f", pairs AS (SELECT a.dataset, a.motion_bin, a.method AS target, b.method AS baseline, a.err AS target_err, b.err AS baseline_err, b.err - a.err AS diff FROM board a JOIN board b USING ({CND}) WHERE a.method <> b.method)"


@register(f"WITH {PAIRS_SQL}, c AS (SELECT {CTX}, target, baseline, {COMPARED} FROM pairs GROUP BY ALL) SELECT {FINISH} FROM c")
def method_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.compared(P.method_pairs(board(spark, sf_dir)), [*P.CONTEXT, "target", "baseline"]))


CLASSES_SQL = BOARD_SQL + f""", best AS (SELECT {CND}, {CLASS_SQL} AS class, min(err) AS err, arg_min(method, (err, method)) AS method FROM board GROUP BY ALL),
kinds(target_class, baseline_class) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in P.CLASS_PAIRS)}),
pairs AS (SELECT a.dataset, a.motion_bin, target_class, baseline_class, a.err AS target_err, b.err AS baseline_err, b.err - a.err AS diff, a.method AS target_method FROM best a JOIN kinds ON a.class = target_class JOIN best b ON b.class = baseline_class AND a.dataset = b.dataset AND a.motion_bin = b.motion_bin AND a.noise_deg = b.noise_deg AND a.occlusion_prob = b.occlusion_prob)"""


@register(f"WITH {CLASSES_SQL}, c AS (SELECT {CTX}, target_class, baseline_class, {COMPARED} FROM pairs GROUP BY ALL) SELECT {FINISH} FROM c")
def class_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.compared(P.class_pairs(board(spark, sf_dir)), [*P.CONTEXT, "target_class", "baseline_class"]))


@register(f"WITH {CLASSES_SQL}, m AS (SELECT {CTX}, target_class, baseline_class, target_method, count(*) AS n FROM pairs GROUP BY ALL) SELECT {CTX}, target_class, baseline_class, string_agg(target_method || ':' || n, ';' ORDER BY target_method) AS target_best_methods FROM m GROUP BY ALL")
def class_best_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.class_pairs(board(spark, sf_dir)).groupBy(*P.CONTEXT, "target_class", "baseline_class").agg(P.method_counts("target_method").alias("target_best_methods"))


@register(f"""WITH {PAIRS_SQL}, c AS (SELECT {CTX}, target, baseline, {COMPARED}, avg(diff) - 1.96*stddev_samp(diff)/sqrt(count(diff)) AS low FROM pairs GROUP BY ALL)
SELECT {CTX}, target, baseline, CASE WHEN condition_count < 2 THEN 'insufficient' WHEN low > 0 AND win_count/condition_count >= 0.75 THEN 'strong_positive' WHEN mean_improvement > 0 AND win_count > loss_count THEN 'positive' WHEN mean_improvement > 0 THEN 'mixed_positive' WHEN loss_count > win_count THEN 'negative' ELSE 'mixed' END AS evidence FROM c""")
def claim_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence labels with the normal interval's lower end; bootstrap_ci has the resampled one."""
    keys = [*P.CONTEXT, "target", "baseline"]
    pairs = P.method_pairs(board(spark, sf_dir))
    low = pairs.groupBy(*keys).agg((F.avg("diff") - 1.96 * F.stddev_samp("diff") / F.sqrt(F.count("diff"))).alias("low"))
    return P.compared(pairs, keys).join(low, keys).select(*keys, P.evidence(F.col("low")).alias("evidence"))


@register(f"""WITH {BOARD_SQL}, both_ AS (SELECT {CND}, CAST(noise_deg AS DOUBLE) AS noise, max(CASE WHEN method = 'persistence' THEN err END) AS p, max(CASE WHEN method = 'gaussian_rw' THEN err END) AS g FROM board GROUP BY ALL HAVING p IS NOT NULL AND g IS NOT NULL),
thr AS (SELECT DISTINCT {CTX}, noise AS threshold, noise_deg AS shown FROM both_ UNION ALL SELECT DISTINCT {CTX}, '-infinity'::DOUBLE, '-inf' FROM both_ UNION ALL SELECT DISTINCT {CTX}, 'infinity'::DOUBLE, 'inf' FROM both_),
scored AS (SELECT {CTX}, shown, round(avg(CASE WHEN noise <= threshold THEN g ELSE p END),9) AS e, count(*) FILTER (noise <= threshold) AS gaussian FROM both_ JOIN thr USING ({CTX}) GROUP BY ALL),
best AS (SELECT {CTX}, arg_min(shown, (e, shown)) AS shown, min(e) AS e, arg_min(gaussian, (e, shown)) AS gaussian FROM scored GROUP BY ALL)
SELECT {CTX}, count(*) AS condition_count, CASE any_value(shown) WHEN '-inf' THEN 'always_persistence' WHEN 'inf' THEN 'always_gaussian_rw' ELSE any_value(shown) END AS best_threshold, round(any_value(e),6)+0.0 AS best_err, round(avg(least(p,g)),6)+0.0 AS oracle, round(avg(p),6)+0.0 AS persistence_mean, round(avg(g),6)+0.0 AS gaussian_mean, count(*) FILTER (g < p) AS oracle_gaussian_count, any_value(gaussian) AS threshold_gaussian_count FROM both_ JOIN best USING ({CTX}) GROUP BY {CTX}""")
def selector_headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.selector_headroom(board(spark, sf_dir)))


_DRAW = "CAST(('0x' || substr(md5(concat_ws('|', dataset, motion_bin, target, baseline, d, i // 4)), CAST((i % 4)*8 + 1 AS BIGINT), 8)) AS BIGINT) / 4294967296.0::DOUBLE"


@register(f"""WITH {PAIRS_SQL.replace("b.err - a.err AS diff", "b.err - a.err AS diff, a.noise_deg, a.occlusion_prob")}, g AS (SELECT {CTX}, target, baseline, list(diff ORDER BY noise_deg, occlusion_prob) AS v FROM pairs GROUP BY ALL), draws AS (SELECT *, unnest(range(2000)) AS d FROM g), places AS (SELECT *, unnest(range(len(v))) AS i FROM draws),
means AS (SELECT {CTX}, target, baseline, len(v) AS n, d, avg(v[CAST(floor({_DRAW} * len(v)) AS BIGINT) + 1]) AS m FROM places GROUP BY ALL), ends AS (SELECT {CTX}, target, baseline, n, list_sort(list(m)) AS m FROM means GROUP BY ALL)
SELECT {CTX}, target, baseline, n AS condition_count, round(m[50],6)+0.0 AS ci95_low, round(m[1950],6)+0.0 AS ci95_high FROM ends""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gyrolake.operators.resampling import bootstrap_means

    return rounded(bootstrap_means(P.method_pairs(board(spark, sf_dir)), [*P.CONTEXT, "target", "baseline"], ["noise_deg", "occlusion_prob"]))


@register(f"WITH {PAIRS_SQL}, c AS (SELECT {CTX}, target, baseline, count(*) AS n, avg(diff) AS m FROM pairs GROUP BY ALL) SELECT {CTX}, target, baseline, CAST(row_number() OVER (PARTITION BY {CTX} ORDER BY round(m, 9) DESC, target, baseline) AS INTEGER) AS place FROM c")
def comparison_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons of a context in order of what the target gains, the largest gain first."""
    return P.placed(P.compared(P.method_pairs(board(spark, sf_dir)), [*P.CONTEXT, "target", "baseline"]), [F.desc(F.round("mean_improvement", 9)), "target", "baseline"]).select(*P.CONTEXT, "target", "baseline", "place")


_LABELS = ", ".join(f"('{x}', {i})" for i, x in enumerate(P.EVIDENCE))


@register(f"""WITH {PAIRS_SQL}, c AS (SELECT {CTX}, target, baseline, {COMPARED}, avg(diff) - 1.96*stddev_samp(diff)/sqrt(count(diff)) AS low, avg(diff) AS m FROM pairs GROUP BY ALL), e AS (SELECT *, CASE WHEN condition_count < 2 THEN 'insufficient' WHEN low > 0 AND win_count/condition_count >= 0.75 THEN 'strong_positive' WHEN m > 0 AND win_count > loss_count THEN 'positive' WHEN m > 0 THEN 'mixed_positive' WHEN loss_count > win_count THEN 'negative' ELSE 'mixed' END AS evidence FROM c), labels(evidence, strength) AS (VALUES {_LABELS})
SELECT {CTX}, target, baseline, evidence, CAST(row_number() OVER (PARTITION BY {CTX} ORDER BY strength, round(m, 9) DESC, target, baseline) AS INTEGER) AS place, target || ' improves on ' || baseline || ' by ' || format('{{:.2f}}', round(m, 2)) || ' deg in ' || win_count || ' of ' || condition_count || ' conditions' AS claim FROM e JOIN labels USING (evidence)""")
def claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims as sentences, the strongest evidence first."""
    keys = [*P.CONTEXT, "target", "baseline"]
    pairs = P.method_pairs(board(spark, sf_dir))
    low = pairs.groupBy(*keys).agg((F.avg("diff") - 1.96 * F.stddev_samp("diff") / F.sqrt(F.count("diff"))).alias("low"))
    told = P.compared(pairs, keys).join(low, keys).withColumn("evidence", P.evidence(F.col("low")))
    strength = F.array_position(F.array(*map(F.lit, P.EVIDENCE)), F.col("evidence"))
    told = P.placed(told, [strength, F.desc(F.round("mean_improvement", 9)), "target", "baseline"])
    return told.select(*keys, "evidence", "place", P.claim("target", "baseline").alias("claim"))


@register(f"WITH {BASED_SQL}, s AS (SELECT {CTX}, method, avg(err) AS m FROM based GROUP BY ALL) SELECT {CTX}, method, CAST(row_number() OVER (PARTITION BY {CTX} ORDER BY round(m, 9), method) AS INTEGER) AS place FROM s")
def paper_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods of a context in order of their mean error."""
    return P.placed(P.paper_summary(board(spark, sf_dir)), [F.round("mean_err", 9), "method"]).select(*P.CONTEXT, "method", "place")


@register(f"""WITH {BOARD_SQL}, near AS (SELECT {CTX}, arg_min(noise_deg, (abs(CAST(noise_deg AS DOUBLE) - 7.5), CAST(noise_deg AS DOUBLE))) AS noise_deg, arg_min(occlusion_prob, (abs(CAST(occlusion_prob AS DOUBLE) - 0.25), CAST(occlusion_prob AS DOUBLE))) AS occlusion_prob FROM board GROUP BY ALL)
SELECT {CND}, method, round(err,6)+0.0 AS err FROM board JOIN near USING ({CND})""")
def closest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the grid cell whose values are each nearest to (7.5, 0.25), of two as near the lesser."""
    rows = board(spark, sf_dir)
    return rounded(P.closest_cell(rows, {"noise_deg": 7.5, "occlusion_prob": 0.25}).select(*P.CONDITION, "method", "err"))


@register("SELECT page_id, coalesce(nullif(left(trim(regexp_replace(regexp_replace(regexp_replace(url, '^.*/', ''), '\\.[^.]*$', ''), '[^A-Za-z0-9_.-]+', '_', 'g'), '_'), 80), ''), 'segment') AS name, format('{:.3f}', round(page_id / 7.0::DOUBLE, 3)) AS shown FROM pages")
def names_and_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names made of safe characters, and numbers with a fixed number of digits."""
    from gyrolake.plans.bindings import table

    return table(spark, sf_dir, "pages").select("page_id", P.safe_name(F.col("url")).alias("name"), P.number(F.col("page_id") / 7.0, 3).alias("shown"))
