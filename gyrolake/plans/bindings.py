"""The tables of the test data as poses, detector streams and metric rows, in Spark and as SQL.

Poses: each label of ``embeddings`` within a block of BLOCK ids is a sequence (label + 10 x
block), its vectors in order of id are frames, and 63 of the 64 numbers are the axis-angle
vectors of 21 joints, scaled by label so that slow and fast sequences occur. A sequence has
about 64 frames whatever the table's size; their number grows. Detector stream: each user of ``events`` is a sequence,
errors are hidden frames, the JSON number is the confidence in percent. Metric rows: order
lines as results of methods under conditions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyrolake.functions import rotations as R

JOINTS = 21
BLOCK = 640  # ids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequence() -> Column:
    return (F.col("label") + 10 * F.floor(F.col("vec_id") / BLOCK)).cast("int")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, t, joint, x, y, z)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", sequence().alias("seq"), "label", "embedding")
    t = F.row_number().over(Window.partitionBy("seq").orderBy("vec_id")) - 1
    joint = e.withColumn("t", t).select("seq", "t", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(JOINTS - 1))).alias("joint"))
    scale = F.lit(0.02) * (F.col("label") + 1)
    part = lambda k: F.get("embedding", F.col("joint") * 3 + k).cast("double") * scale
    return joint.select("seq", "t", "joint", part(0).alias("x"), part(1).alias("y"), part(2).alias("z"))


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, t, joint, x, y, z, r0..r8)."""
    return R.with_exp(vectors(spark, sf_dir), ["x", "y", "z"], "r")


def moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, t, joint, x, y, z, r0..r8): the same sequences with motion of their own.

    Joints swing with a period of 24 frames, by an angle that the sequence's mean numbers tell,
    and the frame's own numbers add a little noise. Steps are some ten times as long as in ``poses``.
    """
    e = table(spark, sf_dir, "embeddings").select("vec_id", sequence().alias("seq"), "embedding")
    t = F.row_number().over(Window.partitionBy("seq").orderBy("vec_id")) - 1
    joint = e.withColumn("t", t).select("seq", "t", "embedding", F.explode(F.sequence(F.lit(0), F.lit(JOINTS - 1))).alias("joint"))
    raw = joint.select("seq", "t", "joint", *[F.get("embedding", F.col("joint") * 3 + k).cast("double").alias(f"e{k}") for k in range(3)])
    mean = [F.avg(f"e{k}").over(Window.partitionBy("seq", "joint")) for k in range(3)]
    swing = [F.sin(2.0 * math.pi * F.col("t") / 24.0 + F.col("joint") + k) * (0.4 + 2.0 * mean[k]) + 0.1 * F.col(f"e{k}") for k in range(3)]
    return R.with_exp(raw.select("seq", "t", "joint", *[c.alias(n) for c, n in zip(swing, "xyz", strict=True)]), ["x", "y", "z"], "r")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, t, mask, confidence, angle, value, ts, event_id)."""
    e = table(spark, sf_dir, "events")
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(
        F.col("user_id").alias("seq"),
        t.alias("t"),
        (F.col("event_type") != "error").alias("mask"),
        (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("confidence"),
        (F.col("value") / 500.0).alias("angle"),
        "value",
        "ts",
        "event_id",
    )


METHODS = ("raw_measurement", "persistence", "gaussian_rw", "ema", "chordal", "savgol_tangent", "constant_velocity")


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, motion_bin, noise_deg, occlusion_prob, num_particles, method, err): the conditions are strings, as in report files."""
    li, o, c, n, r = (table(spark, sf_dir, x) for x in ("lineitem", "orders", "customer", "nation", "region"))
    rows = (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
    )
    method = F.element_at(F.array(*map(F.lit, METHODS)), (F.col("l_partkey") % len(METHODS) + 1).cast("int"))
    return rows.select(
        F.col("r_name").alias("dataset"),
        F.when(F.col("l_quantity") < 10, "low_motion").when(F.col("l_quantity") < 30, "medium_motion").otherwise("high_motion").alias("motion_bin"),
        F.when(F.col("l_discount") < 0.03, "5.0").when(F.col("l_discount") < 0.07, "10.0").otherwise("20.0").alias("noise_deg"),
        F.when(F.col("l_tax") < 0.04, "0.0").otherwise("0.5").alias("occlusion_prob"),
        F.when(F.col("l_linenumber") < 4, 64).otherwise(128).alias("num_particles"),
        method.alias("method"),
        (F.col("l_extendedprice") / 1000.0).alias("err"),
        F.col("l_orderkey"),
        F.col("l_linenumber"),
    )


VECTORS_SQL = f"""
named AS (SELECT CAST(label + 10 * (vec_id // {BLOCK}) AS INTEGER) AS seq, vec_id, label, embedding FROM embeddings),
frames AS (SELECT seq, CAST(row_number() OVER (PARTITION BY seq ORDER BY vec_id) - 1 AS INTEGER) AS t, embedding, CAST(0.02 AS DOUBLE) * (label + 1) AS scale FROM named),
vectors AS (SELECT seq, t, CAST(j AS INTEGER) AS joint, CAST(embedding[3 * j + 1] AS DOUBLE) * scale AS x, CAST(embedding[3 * j + 2] AS DOUBLE) * scale AS y, CAST(embedding[3 * j + 3] AS DOUBLE) * scale AS z FROM frames, range(21) g(j))
"""


def exp_sql(source: str, name: str, v: tuple[str, str, str] = ("x", "y", "z"), out: str = "r") -> str:
    """CTE ``name``: ``source`` with the rotation of v in out0..out8."""
    x, y, z = v
    return f"""
{name}_s AS (SELECT *, {x}*{x} + {y}*{y} + {z}*{z} AS s_, sqrt({x}*{x} + {y}*{y} + {z}*{z}) AS t_ FROM {source}),
{name}_a AS (SELECT *, CASE WHEN t_ < 1e-6 THEN 1 - s_/6 + s_*s_/120 ELSE sin(t_)/t_ END AS a_, CASE WHEN t_ < 1e-6 THEN 0.5 - s_/24 + s_*s_/720 ELSE (1 - cos(t_))/s_ END AS b_ FROM {name}_s),
{name} AS (SELECT * EXCLUDE (s_, t_, a_, b_), 1 - b_*({y}*{y}+{z}*{z}) AS {out}0, b_*{x}*{y} - a_*{z} AS {out}1, b_*{x}*{z} + a_*{y} AS {out}2,
  b_*{x}*{y} + a_*{z} AS {out}3, 1 - b_*({x}*{x}+{z}*{z}) AS {out}4, b_*{y}*{z} - a_*{x} AS {out}5,
  b_*{x}*{z} - a_*{y} AS {out}6, b_*{y}*{z} + a_*{x} AS {out}7, 1 - b_*({x}*{x}+{y}*{y}) AS {out}8 FROM {name}_a)"""


POSES_SQL = VECTORS_SQL + "," + exp_sql("vectors", "poses")

MOVING_SQL = f"""
named AS (SELECT CAST(label + 10 * (vec_id // {BLOCK}) AS INTEGER) AS seq, vec_id, embedding FROM embeddings),
frames AS (SELECT seq, CAST(row_number() OVER (PARTITION BY seq ORDER BY vec_id) - 1 AS INTEGER) AS t, embedding FROM named),
raw AS (SELECT seq, t, CAST(j AS INTEGER) AS joint, {", ".join(f"CAST(embedding[3 * j + {k + 1}] AS DOUBLE) AS e{k}" for k in range(3))} FROM frames, range(21) g(j)),
swing AS (SELECT seq, t, joint, {", ".join(f"sin(2.0::DOUBLE*pi()*t/24.0::DOUBLE + joint + {k}) * (0.4::DOUBLE + 2.0::DOUBLE * avg(e{k}) OVER (PARTITION BY seq, joint)) + 0.1::DOUBLE * e{k} AS {c}" for k, c in enumerate("xyz"))} FROM raw)
""" + "," + exp_sql("swing", "poses")


def dist_sql(a: str, b: str) -> str:
    """The angle between rotations whose elements are named by the patterns a and b, with {k} for 0 to 8."""
    trace = " + ".join(f"{a.format(k=k)}*{b.format(k=k)}" for k in range(9))
    return f"CASE WHEN ({trace}) IS NOT NULL THEN acos(greatest(-1.0, least(1.0, (({trace}) - 1)/2))) END"


def delta_sql(source: str, name: str, current: str, following: str, out: str) -> str:
    """CTE ``name``: ``source`` with the left delta between rotations in out0..out2."""
    m = {3 * i + j: " + ".join(f"{following.format(k=3 * i + k)}*{current.format(k=3 * j + k)}" for k in range(3)) for i in range(3) for j in range(3)}
    product = ", ".join(f"{e} AS m{k}" for k, e in m.items())
    axis = {
        0: ("sqrt(greatest((m0+1)/2,0))", "(m1+m3)/4/sqrt(greatest((m0+1)/2,0))", "(m2+m6)/4/sqrt(greatest((m0+1)/2,0))"),
        1: ("(m3+m1)/4/sqrt(greatest((m4+1)/2,0))", "sqrt(greatest((m4+1)/2,0))", "(m5+m7)/4/sqrt(greatest((m4+1)/2,0))"),
        2: ("(m6+m2)/4/sqrt(greatest((m8+1)/2,0))", "(m7+m5)/4/sqrt(greatest((m8+1)/2,0))", "sqrt(greatest((m8+1)/2,0))"),
    }
    pick = ", ".join(f"CASE WHEN m0 >= m4 AND m0 >= m8 THEN {axis[0][j]} WHEN m4 >= m8 THEN {axis[1][j]} ELSE {axis[2][j]} END AS u{j}" for j in range(3))
    v = ("m7 - m5", "m2 - m6", "m3 - m1")
    value = ", ".join(f"CASE WHEN pi() - th <= 1e-5 THEN u{j}*th/sqrt(u0*u0+u1*u1+u2*u2) WHEN th < 1e-6 THEN 0.5*({v[j]}) ELSE th/(2*sin(th))*({v[j]}) END AS {out}{j}" for j in range(3))
    return f"""
{name}_m AS (SELECT *, {product} FROM {source}),
{name}_t AS (SELECT *, CASE WHEN m0 IS NOT NULL THEN acos(greatest(-1.0, least(1.0, (m0+m4+m8-1)/2))) END AS th, {pick} FROM {name}_m),
{name} AS (SELECT * EXCLUDE (m0,m1,m2,m3,m4,m5,m6,m7,m8,th,u0,u1,u2), {value} FROM {name}_t)"""


DETECTIONS_SQL = """
detections AS (SELECT user_id AS seq, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS t, event_type <> 'error' AS mask,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS confidence, value / 500 AS angle, value, ts, event_id FROM events)
"""

METRICS_SQL = f"""
metrics AS (SELECT r_name AS dataset, CASE WHEN l_quantity < 10 THEN 'low_motion' WHEN l_quantity < 30 THEN 'medium_motion' ELSE 'high_motion' END AS motion_bin,
  CASE WHEN l_discount < 0.03 THEN '5.0' WHEN l_discount < 0.07 THEN '10.0' ELSE '20.0' END AS noise_deg, CASE WHEN l_tax < 0.04 THEN '0.0' ELSE '0.5' END AS occlusion_prob,
  CASE WHEN l_linenumber < 4 THEN 64 ELSE 128 END AS num_particles, [{", ".join(f"'{m}'" for m in METHODS)}][l_partkey % 7 + 1] AS method, l_extendedprice / 1000 AS err, l_orderkey, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""
