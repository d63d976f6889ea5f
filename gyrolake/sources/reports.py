"""Report tables: CSV and JSON files of metric rows in, tables with fixed columns out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gyrolake.functions.rotations import finite

ROW = ["dataset", "source", "motion_bin", "noise_deg", "occlusion_prob", "method", "transition_model", "filter_backend", "num_particles", "tracking_error_deg", "visible_error_deg", "occluded_error_deg", "raw_measurement_error_deg", "persistence_error_deg", "improvement_vs_raw_deg", "improvement_vs_persistence_deg", "mean_ess", "row_count"]
NUMBERS = [c for c in ROW if c.endswith("_error_deg") or c.startswith("improvement") or c == "mean_ess"]


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All columns as strings; a missing file is an empty table of ``columns``."""
    try:
        found = spark.read.option("header", "true").option("inferSchema", "false").csv(path)
    except AnalysisException as why:
        if "PATH_NOT_FOUND" not in str(why):
            raise
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns or ["value"]))
    return found.select(*[(F.col(f"`{c}`") if c in found.columns else F.lit(None).cast("string")).alias(c) for c in columns or found.columns])


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of one file or folder by a given schema; a missing file is an empty table."""
    try:
        return spark.read.schema(schema).option("multiLine", "false").json(path)
    except AnalysisException as why:
        if "PATH_NOT_FOUND" not in str(why):
            raise
        return spark.createDataFrame([], schema)


def first_of(*tables: DataFrame) -> DataFrame:
    """The first table that has rows, else the last."""
    return next((t for t in tables if not t.isEmpty()), tables[-1])


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A header and the columns in order, blank where a row or the table has no value or no finite one."""
    kinds = dict(df.dtypes)
    text = lambda c: (finite(F.col(c)) if kinds[c] in ("double", "float") else F.col(c)).cast("string")
    cells = [(F.coalesce(text(c), F.lit("")) if c in kinds else F.lit("")).alias(c) for c in columns or df.columns]
    df.select(*cells).write.option("header", "true").option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object a line; non-finite numbers are left out."""
    df.select(*[(finite(F.col(c)) if t in ("double", "float") else F.col(c)).alias(c) for c, t in df.dtypes]).write.json(path)


def real(c: str | Column) -> Column:
    """A text's finite number, or null."""
    return finite((F.col(c) if isinstance(c, str) else c).try_cast("double"))


def whole(c: str) -> Column:
    return F.col(c).try_cast("double").cast("long")


def tagged(rows: DataFrame, **tags: object) -> DataFrame:
    """``rows`` with the tags as columns; a row's own columns win."""
    return rows.withColumns({k: F.lit(v) for k, v in tags.items() if k not in rows.columns})


def united(*tables: DataFrame) -> DataFrame:
    """All rows by column name; what a table lacks is null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def motion_rows(rows: DataFrame, dataset: str) -> DataFrame:
    """Report rows from aggregate rows of strings: the baselines' errors are the tracking error and what was gained on them."""
    tracking, raw, held = real("mean_tracking_error_deg"), real("mean_improvement_vs_raw_deg"), real("mean_improvement_vs_persistence_deg")
    named = F.coalesce("motion_bin", F.lit(""))
    rows = united(rows, rows.sparkSession.createDataFrame([], "transition_model string, filter_backend string, num_particles string"))
    return rows.select(
        F.lit(dataset).alias("dataset"),
        F.when(named == "", "motion_stratified").otherwise(F.concat(F.lit("motion_stratified:"), named)).alias("source"),
        named.alias("motion_bin"),
        "noise_deg",
        "occlusion_prob",
        "method",
        F.coalesce("transition_model", "method").alias("transition_model"),
        F.coalesce("filter_backend", F.lit("")).alias("filter_backend"),
        whole("num_particles").alias("num_particles"),
        tracking.alias("tracking_error_deg"),
        (tracking + raw).alias("raw_measurement_error_deg"),
        (tracking + held).alias("persistence_error_deg"),
        raw.alias("improvement_vs_raw_deg"),
        held.alias("improvement_vs_persistence_deg"),
        whole("row_count").alias("row_count"),
    )


def detector_means(rows: DataFrame, summary: DataFrame, by: list[str]) -> DataFrame:
    """Means of the rows' numbers per run, replaced by the summary's where that has finite ones; a run may be in either alone."""
    numbers = [c for c in summary.columns if c not in by]
    means = rows.groupBy(*by).agg(*[F.avg(real(c)).alias(c) for c in numbers], F.count(F.lit(1)).alias("row_count"))
    own = summary.select(*by, *[finite(F.col(c)).alias(f"own_{c}") for c in numbers])
    return means.join(own, by, "full").select(*by, *[F.coalesce(f"own_{c}", c).alias(c) for c in numbers], "row_count")


def detector_rows(means: DataFrame, method: str) -> DataFrame:
    """Three rows a run: raw measurement, persistence, and the method; baselines without a finite error are left out.

    ``means`` has dataset, row_count, filter_error_deg, observed_error_deg, observed_joint_error_deg, persistence_error_deg.
    """
    raw, held, own, joint = (F.col(f"{c}_error_deg") for c in ("observed", "persistence", "filter", "observed_joint"))
    none = F.lit(None).cast("double")
    kind = lambda name, error, vs_raw, vs_held, visible: F.struct(F.lit(name).alias("method"), error.alias("tracking_error_deg"), visible.alias("visible_error_deg"), vs_raw.alias("improvement_vs_raw_deg"), vs_held.alias("improvement_vs_persistence_deg"))
    rows = F.array(
        kind("raw_measurement", raw, F.lit(0.0), held - raw, joint),
        kind("persistence", held, raw - held, F.lit(0.0), none),
        kind(method, own, F.coalesce(raw - own, joint - own), held - own, none),
    )
    told = means.select("dataset", "row_count", raw.alias("raw_measurement_error_deg"), held.alias("persistence_error_deg"), F.explode(rows).alias("r"))
    return told.select("dataset", F.lit("detector_hmr").alias("source"), "r.*", "raw_measurement_error_deg", "persistence_error_deg", "row_count").filter(F.col("tracking_error_deg").isNotNull() | (F.col("method") == method))
