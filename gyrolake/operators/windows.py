"""Windows over sequences: starts, candidates, selections and the frames they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyrolake.operators.reporting import safe_name

RANGES = 64
BINS = (("low_motion", 0.0, 0.5), ("medium_motion", 0.5, 1.5), ("high_motion", 1.5, float("inf")))


def starts(n_frames: Column, length: int, stride: int) -> Column:
    """Starts every ``stride`` frames and a last window at the tail; [0] for a short sequence."""
    last = n_frames - length
    regular = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(max(1, stride)))
    return F.when(last <= 0, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(regular, F.array(last))))


def candidates(frames: DataFrame, length: int, stride: int) -> DataFrame:
    """(seq, start, stop, motion) from ``frames`` (seq, t, d): d is the step that ends at t, null at the first.

    A window's motion is the mean step between its frames. Windows meet frames by sequence
    and a block of ``length`` frames, so no frame is compared with windows far away.
    """
    sizes = frames.groupBy("seq").agg((F.max("t") + 1).cast("int").alias("n"))
    placed = sizes.select("seq", "n", F.explode(starts(F.col("n"), length, stride)).alias("start"))
    placed = placed.withColumn("stop", F.least(F.col("start") + length, F.col("n")))
    blocks = F.sequence(F.floor(F.col("start") / length), F.floor((F.col("stop") - 1) / length))
    dealt = placed.withColumn("block", F.explode(blocks))
    held = frames.filter("d is not null").withColumn("block", F.floor(F.col("t") / length))
    inside = dealt.join(held, ["seq", "block"]).filter("t > start and t < stop")
    return inside.groupBy("seq", "start", "stop").agg(F.avg("d").alias("motion"))


def bin_of(motion: Column) -> Column:
    return F.when((motion >= 0) & (motion < 0.5), "low_motion").when((motion >= 0.5) & (motion < 1.5), "medium_motion").otherwise("high_motion")


def capped(ordered: DataFrame, order: list, limit: int, per_file: int | None, file: str = "seq") -> DataFrame:
    """The first ``limit`` rows by ``order`` of which no file has more than ``per_file``."""
    if per_file is not None:
        ordered = ordered.withColumn("nth", F.row_number().over(Window.partitionBy(file).orderBy(*order))).filter(F.col("nth") <= per_file).drop("nth")
    return ordered.orderBy(*order).limit(limit)


def select_first(rows: DataFrame, limit: int, per_file: int | None = None) -> DataFrame:
    return capped(rows, ["seq", "start"], limit, per_file)


def select_top_motion(rows: DataFrame, limit: int, per_file: int | None = None) -> DataFrame:
    return capped(rows, [F.desc("motion"), "seq", "start"], limit, per_file)


def select_uniform(rows: DataFrame, limit: int, per_file: int | None = None) -> DataFrame:
    """Evenly spaced rows of the whole list in order of (seq, start): places floor(i (n - 1) / (limit - 1))."""
    per_seq = rows.groupBy("seq").agg(F.count(F.lit(1)).alias("m"))
    # sequences are dealt to ranges of their names, so that no task orders all of them
    cuts = sorted(r.seq for r in per_seq.orderBy(F.xxhash64("seq")).limit(RANGES).select("seq").collect())
    dealt = per_seq.withColumn("range", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("seq"))))
    sizes = dealt.groupBy("range").agg(F.sum("m").alias("m"))
    first = F.coalesce(F.sum("m").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over at most RANGES + 1 rows
    within = F.coalesce(F.sum("m").over(Window.partitionBy("range").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = dealt.withColumn("within", within).join(F.broadcast(sizes.select("range", first.alias("first"))), "range").select("seq", (F.col("within") + F.col("first")).alias("ahead"))
    at = rows.join(ahead, "seq").withColumn("at", F.col("ahead") + F.row_number().over(Window.partitionBy("seq").orderBy("start")) - 1)
    n = rows.count()
    if n > limit:
        wanted = {i * (n - 1) // max(1, limit - 1) for i in range(limit)} if limit > 1 else {0}
        at = at.filter(F.col("at").isin(sorted(wanted)))
    return capped(at, ["at"], limit, per_file).drop("at", "ahead")


def select_balanced(rows: DataFrame, limit: int, per_file: int | None = None) -> DataFrame:
    """A quota of the fastest of each motion bin, the remainder to the first bins, then the fastest of the rest."""
    quota, left = max(1, limit // len(BINS)), limit - max(1, limit // len(BINS)) * len(BINS)
    place = F.row_number().over(Window.partitionBy("bin").orderBy(F.desc("motion"), "seq", "start"))
    order = F.when(F.col("bin") == BINS[0][0], 0).when(F.col("bin") == BINS[1][0], 1).otherwise(2)
    take = F.lit(quota) + (F.col("bin_order") < left).cast("int")
    marked = rows.withColumn("bin", bin_of(F.col("motion"))).withColumn("bin_order", order).withColumn("place", place)
    marked = marked.withColumn("late", (F.col("place") > take).cast("int"))
    by = ["late", F.when(F.col("late") == 0, F.col("bin_order")).otherwise(F.lit(0)), F.desc("motion"), "seq", "start"]
    chosen = marked.orderBy(*by).limit(limit)
    return capped(chosen, by, limit, per_file).drop("bin_order", "place", "late")


def manifest(selected: DataFrame, order: list, source: Column, per_source: int = 1) -> DataFrame:
    """One row a selected window: rank in ``order``, source, its first and last source frame, motion, bin and the file it becomes.

    ``selected`` (seq, start, stop, motion) is a selection and thus bounded; a frame stands for ``per_source`` source frames.
    """
    ranked = selected.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1).withColumn("source", source)
    name = F.concat(F.lit("segment_"), F.lpad(F.col("rank").cast("string"), 3, "0"), F.lit("_"), safe_name(F.col("source")), F.lit(".npz"))
    frames = [(F.col(c) * per_source).alias(f"source_{n}_frame") for c, n in (("start", "start"), ("stop", "stop"))]
    return ranked.select("rank", "source", *frames, "motion", bin_of(F.col("motion")).alias("motion_bin"), name.alias("output"))


def segment_diagnostics(windows: DataFrame, source: Column, stride: int, min_frames: int, examples: int = 5) -> DataFrame:
    """Per motion bin of ``windows`` (seq, start, stop, motion): how many there are and how many keep ``min_frames`` after ``stride``, with the first sources and rejections.

    Examples are found by rank within parts of a bin, then of the bin, so no bin is gathered.
    """
    frames = F.ceil((F.col("stop") - F.col("start")) / stride)
    rows = windows.withColumns({"source": source, "frames": frames, "motion_bin": bin_of(F.col("motion"))}).withColumn("usable", F.col("frames") >= min_frames)
    counted = rows.groupBy("motion_bin").agg(F.count(F.lit(1)).alias("windows"), F.count_if("usable").alias("usable"))
    told = F.concat("source", F.lit("@"), F.col("start").cast("string"))
    short = F.concat(told, F.lit(": "), F.col("frames").cast("string"), F.lit(f" frames, {min_frames} needed"))

    def first(df: DataFrame, what: Column, name: str) -> DataFrame:
        order = ["seq", "start"]
        part = df.withColumn("part", F.pmod(F.xxhash64("seq", "start"), F.lit(RANGES)))
        for keys in (["motion_bin", "part"], ["motion_bin"]):
            part = part.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("nth") <= examples)
        held = F.array_sort(F.collect_list(F.struct("nth", what.alias("w"))))
        return part.groupBy("motion_bin").agg(F.array_join(F.transform(held, lambda x: x["w"]), "; ").alias(name))

    out = counted.join(first(rows, told, "source_examples"), "motion_bin", "left").join(first(rows.filter(~F.col("usable")), short, "rejection_examples"), "motion_bin", "left")
    return out.select("motion_bin", "windows", "usable", "source_examples", F.coalesce("rejection_examples", F.lit("")).alias("rejection_examples"))
