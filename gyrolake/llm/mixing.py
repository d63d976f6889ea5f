"""Operator 1, mixing sources to target weights: Poisson replication, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyrolake.llm.text import packed
from gyrolake.plans.staging import staged

PART = 16.0  # a rate above this is drawn as a sum of equal parts, so that exp(-rate) stays exact
TERMS = 96  # the distribution function of a part is 1 in doubles well before


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts, the same in every run and engine."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_table(rates: DataFrame) -> DataFrame:
    """``rates`` (..., rate) with parts and cdf: the distribution function of one part at 0, 1, ..."""
    parts = rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART).cast("int")))
    one = parts.withColumn("mean", F.col("rate") / F.col("parts"))
    zero = F.exp(-F.col("mean"))
    start = F.struct(zero.alias("term"), F.array(zero).alias("cdf"))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] * F.col("mean") / k
        return F.struct(term.alias("term"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + term)).alias("cdf"))

    return one.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, add, lambda acc: acc["cdf"])).drop("mean")


def replicate(docs: DataFrame, weights: DataFrame | None = None, total: int | None = None, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(row, id, rate, copies, copy): each row ``copies`` times, in an order shuffled over all partitions.

    ``weights`` (source, weight) gives sources their share of about ``total`` rows, by
    default as many as come in; sources that it lacks get none, and by default all
    sources share alike, null being one of them. A source's rate is its share over its
    rows. The number of copies inverts the Poisson distribution of that mean at a
    uniform number seeded by the hash of (seed, id): independent of partitioning and
    retries. Equal ids get equal numbers, so repeated rows are repeated alike; a null id
    draws by its text's hash. ``row`` is the input row as a struct, so extra columns pass
    through whatever their names; texts may be null, empty or long. An empty table
    gives an empty result. Copies are scattered by the hash of (id, text, copy, seed), never
    by source, so neither a hot source nor a hot id is a hot partition.
    """
    rows = packed(docs, F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("draw"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    counts = staged(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source_counts")
    if weights is None:
        weighed = counts.withColumn("weight", F.lit(1.0))
    else:
        given = weights.select(F.col("source").cast("string").alias("of"), F.col("weight").cast("double").alias("weight"))
        weighed = counts.join(given, counts.source.eqNullSafe(given.of)).drop("of")
    sums = weighed.agg(F.sum("weight").alias("w"), F.sum("n").alias("n")).first()
    if not sums.w:
        return rows.filter("false").select("row", "id", F.lit(0.0).alias("rate"), F.lit(0).alias("copies"), F.lit(0).alias("copy"))
    wanted = float(counts.agg(F.sum("n")).first()[0] if total is None else total)
    rates = weighed.select(F.col("source").alias("of"), (F.col("weight") / F.lit(float(sums.w)) * wanted / F.col("n")).alias("rate"))
    table = staged(poisson_table(rates), "rates")
    drawn = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: uniform(F.lit(seed), F.col("draw"), j))
    count = F.aggregate(drawn, F.lit(0), lambda acc, u: acc + F.size(F.filter("cdf", lambda c: c <= u)))
    counted = rows.join(table, rows.source.eqNullSafe(table.of)).select("row", "id", "text_hash", "rate", count.alias("copies"))
    copies = counted.filter("copies > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    shuffled = copies.withColumn("at", F.xxhash64("id", "text_hash", "copy", F.lit(seed)))
    return shuffled.repartition("at").sortWithinPartitions("at").drop("at", "text_hash")


def mix(docs: DataFrame, weights: DataFrame | None = None, total: int | None = None, seed: int = 0, **columns: str) -> DataFrame:
    """The replicated rows with the columns of ``docs`` alone."""
    return replicate(docs, weights, total, seed, **columns).select("row.*")
