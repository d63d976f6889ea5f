"""The relational reporting layer: means, ranks, comparisons and selectors over metric rows.

A board is one row per condition and method: the condition columns, method, err (the
tracking error in degrees). Conditions are strings, as report files have them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyrolake.functions.rotations import finite

CONTEXT = ["dataset", "motion_bin"]
CONDITION = [*CONTEXT, "noise_deg", "occlusion_prob"]

# Method names and classes that reports of this kind use.
RAW_METHODS = ("raw_measurement", "raw")
PERSISTENCE_METHODS = ("persistence",)
OFFLINE_METHODS = ("ema", "chordal", "savgol_tangent")
ONLINE_METHODS = ("gaussian_rw", "adaptive_gaussian_rw", "noise_adaptive_selector", "constant_velocity", "mlp_delta", "history_mlp_delta", "gru_delta", "learned_proposal")
EVIDENCE = ("strong_positive", "positive", "mixed_positive", "mixed", "negative", "insufficient")  # strongest first
CLASS_PAIRS = (("causal_online_filter", "offline_smoother"), ("causal_online_filter", "causal_baseline"), ("causal_online_filter", "raw_measurement"), ("offline_smoother", "causal_baseline"))


def spread(value: str, name: str) -> list[Column]:
    """mean_, std_ and sem_ of the finite values; the last two null below two of them."""
    x = finite(F.col(value))
    return [F.avg(x).alias(f"mean_{name}"), F.stddev_samp(x).alias(f"std_{name}"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias(f"sem_{name}")]


def board(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(keys or CONDITION), "method").agg(F.avg(finite(F.col("err"))).alias("err"), F.count(F.lit(1)).alias("row_count"))


def method_class(method: Column, backend: Column | None = None) -> Column:
    backend = F.lit("") if backend is None else F.coalesce(backend, F.lit(""))
    return (
        F.when(method.isin(*RAW_METHODS), "raw_measurement")
        .when(method.isin(*PERSISTENCE_METHODS), "causal_baseline")
        .when((backend == "offline_smoother") | method.isin(*OFFLINE_METHODS), "offline_smoother")
        .when(backend.isin("numpy", "quaternion") | method.isin(*ONLINE_METHODS), "causal_online_filter")
        .otherwise("other")
    )


def with_baselines(rows: DataFrame) -> DataFrame:
    """Adds raw_err and persistence_err of the condition, and the improvements over both; rows of no condition go.

    Both come from the very rows they stand beside: computed a second time, a mean's floats may be added in
    another order, and a baseline would then differ from itself.
    """
    own = lambda method: F.max(F.when(F.col("method") == method, F.col("err"))).over(Window.partitionBy(*CONDITION))
    based = rows.dropna(subset=CONDITION).withColumns({"raw_err": own("raw_measurement"), "persistence_err": own("persistence")})
    return based.withColumns({"improvement_vs_raw": F.col("raw_err") - F.col("err"), "improvement_vs_persistence": F.col("persistence_err") - F.col("err")})


def ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy(*CONDITION).orderBy(F.coalesce(finite(F.col("err")), F.lit(float("inf"))), "method")
    return rows.withColumn("rank", F.row_number().over(order))


def dedupe_baselines(rows: DataFrame, order: list[str]) -> DataFrame:
    """Of raw and persistence rows of a condition only the first by ``order``; all rows of other methods."""
    first = F.row_number().over(Window.partitionBy(*CONDITION, "method").orderBy(*order))
    return rows.withColumn("first", first).filter((F.col("first") == 1) | ~F.col("method").isin("raw_measurement", "persistence")).drop("first")


def paper_summary(rows: DataFrame) -> DataFrame:
    best = F.min("err").over(Window.partitionBy(*CONDITION))
    wins = F.abs(F.col("err") - best) <= F.greatest(1e-12 * F.greatest(F.abs("err"), F.abs(best)), F.lit(1e-12))
    marked = with_baselines(rows).withColumn("wins", wins)
    return marked.groupBy(*CONTEXT, "method").agg(
        method_class(F.col("method")).alias("method_class"),
        F.count_distinct("noise_deg", "occlusion_prob").alias("condition_count"),
        F.count_if("wins").alias("win_count"),
        F.avg("err").alias("mean_err"),
        F.avg("improvement_vs_raw").alias("mean_improvement_vs_raw"),
        F.avg("improvement_vs_persistence").alias("mean_improvement_vs_persistence"),
        F.count_if(F.col("improvement_vs_raw") < 0).alias("worse_than_raw_count"),
        F.count_if(F.col("improvement_vs_persistence") < 0).alias("worse_than_persistence_count"),
        F.sum("row_count").alias("row_count"),
    )


def sign_test(wins: Column, losses: Column) -> Column:
    """Two-sided exact sign test; null without trials. Binomial terms are summed in logarithms of their ratios."""
    n = wins + losses
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("total"))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] + F.log((n - k + 1).cast("double") / k)
        return F.struct(term.alias("term"), (acc["total"] + F.exp(term)).alias("total"))

    least = F.least(wins, losses)
    ks = F.when(least > 0, F.sequence(F.lit(1).cast("long"), least)).otherwise(F.array().cast("array<bigint>"))
    return F.when(n > 0, F.least(F.lit(1.0), 2.0 * F.aggregate(ks, start, add, lambda acc: acc["total"])))


def compared(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and means of ``diff`` (baseline minus target error) per key: positive means the target is better."""
    counted = pairs.groupBy(*keys).agg(
        F.count("diff").alias("condition_count"),
        F.avg("target_err").alias("target_mean"),
        F.avg("baseline_err").alias("baseline_mean"),
        F.avg("diff").alias("mean_improvement"),
        F.median("diff").alias("median_improvement"),
        F.count_if(F.col("diff") > 1e-9).alias("win_count"),
        F.count_if(F.col("diff") < -1e-9).alias("loss_count"),
    )
    ties = F.col("condition_count") - F.col("win_count") - F.col("loss_count")
    return counted.withColumns({"tie_count": ties, "win_rate": F.try_divide("win_count", "condition_count"), "sign_test_p": sign_test(F.col("win_count"), F.col("loss_count"))})


def method_pairs(rows: DataFrame) -> DataFrame:
    """Every two methods of a condition; a condition has one row per method."""
    a = rows.select(*CONDITION, F.col("method").alias("target"), F.col("err").alias("target_err"))
    b = rows.select(*CONDITION, F.col("method").alias("baseline"), F.col("err").alias("baseline_err"))
    return a.join(b, CONDITION).filter("target <> baseline").withColumn("diff", F.col("baseline_err") - F.col("target_err"))


def class_pairs(rows: DataFrame) -> DataFrame:
    """The best method of each class against that of another, for the fixed pairs of classes."""
    best = rows.filter("err is not null").groupBy(*CONDITION, method_class(F.col("method")).alias("class")).agg(F.min(F.struct("err", "method")).alias("best"))
    pairs = rows.sparkSession.createDataFrame(list(CLASS_PAIRS), "target_class string, baseline_class string")
    a = best.select(*CONDITION, F.col("class").alias("target_class"), F.col("best.err").alias("target_err"), F.col("best.method").alias("target_method"))
    b = best.select(*CONDITION, F.col("class").alias("baseline_class"), F.col("best.err").alias("baseline_err"), F.col("best.method").alias("baseline_method"))
    return a.join(F.broadcast(pairs), "target_class").join(b, [*CONDITION, "baseline_class"]).withColumn("diff", F.col("baseline_err") - F.col("target_err"))


def method_counts(method: str) -> Column:
    """``a:2;b:1`` over the group's values, sorted."""
    values = F.array_sort(F.collect_list(method))
    return F.array_join(F.transform(F.array_distinct(values), lambda m: F.concat_ws(":", m, F.size(F.filter(values, lambda x: x == m)))), ";")


def evidence(ci_low: Column) -> Column:
    mean, wins, losses = F.col("mean_improvement"), F.col("win_count"), F.col("loss_count")
    return (
        F.when(F.col("condition_count") < 2, "insufficient")
        .when((ci_low > 0) & (F.col("win_rate") >= 0.75), "strong_positive")
        .when((mean > 0) & (wins > losses), "positive")
        .when(mean > 0, "mixed_positive")
        .when(losses > wins, "negative")
        .otherwise("mixed")
    )


def selector_headroom(rows: DataFrame) -> DataFrame:
    """Per context: the best noise threshold between persistence and the random walk, and the best of two."""
    both = rows.groupBy(*CONDITION).agg(*[F.max(F.when(F.col("method") == m, F.col("err"))).alias(c) for m, c in (("persistence", "p"), ("gaussian_rw", "g"))]).filter("p is not null and g is not null")
    both = both.withColumn("noise", F.expr("try_cast(noise_deg as double)"))
    levels = both.select(*CONTEXT, "noise", F.col("noise_deg").alias("shown")).distinct()
    ends = both.select(*CONTEXT).distinct().select(*CONTEXT, F.inline(F.expr("array(struct(double('-infinity') as noise, '-inf' as shown), struct(double('infinity') as noise, 'inf' as shown))")))
    thresholds = levels.unionByName(ends).withColumnRenamed("noise", "threshold")
    used = F.col("noise") <= F.col("threshold")
    scored = both.join(thresholds, CONTEXT).groupBy(*CONTEXT, "shown").agg(F.avg(F.when(used, F.col("g")).otherwise(F.col("p"))).alias("e"), F.count_if(used).alias("gaussian"))
    best = scored.groupBy(*CONTEXT).agg(F.min(F.struct(F.round("e", 9).alias("e"), "shown", "gaussian")).alias("best"))
    oracle = both.groupBy(*CONTEXT).agg(F.count(F.lit(1)).alias("condition_count"), F.avg(F.least("p", "g")).alias("oracle"), F.count_if(F.col("g") < F.col("p")).alias("oracle_gaussian_count"), F.avg("p").alias("persistence_mean"), F.avg("g").alias("gaussian_mean"))
    label = F.when(F.col("best.shown") == "-inf", "always_persistence").when(F.col("best.shown") == "inf", "always_gaussian_rw").otherwise(F.col("best.shown"))
    return best.join(oracle, CONTEXT).select(*CONTEXT, "condition_count", label.alias("best_threshold"), F.col("best.e").alias("best_err"), "oracle", "persistence_mean", "gaussian_mean", "oracle_gaussian_count", F.col("best.gaussian").alias("threshold_gaussian_count"))


def noise_selected(rows: DataFrame, threshold: float = 10.0) -> DataFrame:
    """The selector's error per condition: the random walk's up to the noise threshold, persistence's above."""
    both = rows.groupBy(*CONDITION).agg(*[F.max(F.when(F.col("method") == m, F.col("err"))).alias(m) for m in ("persistence", "gaussian_rw")])
    walk = F.expr("try_cast(noise_deg as double)") <= threshold
    return both.select(*CONDITION, F.when(walk, F.col("gaussian_rw")).otherwise(F.col("persistence")).alias("err"), F.when(walk, "gaussian_rw:filter_error_deg").otherwise("persistence:persistence_error_deg").alias("source_metric"))


def placed(rows: DataFrame, order: list) -> DataFrame:
    """Adds place, a row's number in its context by ``order``."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*CONTEXT).orderBy(*order)))


def claim(target: str, baseline: str) -> Column:
    """What a comparison says, as a sentence; null if it has no mean."""
    gain = F.when(F.col("mean_improvement").isNotNull(), number(F.col("mean_improvement"), 2))
    return F.concat(F.col(target), F.lit(" improves on "), F.col(baseline), F.lit(" by "), gain, F.lit(" deg in "), F.col("win_count").cast("string"), F.lit(" of "), F.col("condition_count").cast("string"), F.lit(" conditions"))


def number(x: Column, digits: int) -> Column:
    """A finite number with so many digits, else a blank; what is rounded to zero from below keeps its sign."""
    x = finite(x.cast("double"))
    return F.when(x.isNull(), "").otherwise(F.format_string(f"%.{digits}f", F.when(x < 0, -F.round(-x, digits)).otherwise(F.round(x, digits))))


def safe_name(path: Column) -> Column:
    """A path's file name without its suffix, of letters, digits, points, dashes and underscores, at most 80; never empty."""
    stem = F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"\.[^.]*$", "")
    name = F.substring(F.btrim(F.regexp_replace(stem, "[^A-Za-z0-9_.-]+", "_"), F.lit("_")), 1, 80)
    return F.when(name == "", "segment").otherwise(name)


def closest_cell(rows: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """The rows whose values in the columns ``wanted`` are, within their context, each nearest to the number; of two as near, the lesser."""
    value = lambda c: F.expr(f"try_cast({c} as double)")
    near = rows.groupBy(*CONTEXT).agg(*[F.min_by(c, F.struct(F.abs(value(c) - x), value(c))).alias(c) for c, x in wanted.items()])
    return rows.join(near, [*CONTEXT, *wanted])
