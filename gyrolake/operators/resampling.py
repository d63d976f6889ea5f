"""Bootstrap confidence intervals of grouped means, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DRAWS = 2000


def drawn(key: Column, draw: Column, place: Column) -> Column:
    """A number in [0, 1) of the key, the draw and the place in it: a quarter of an MD5 digest."""
    digest = F.md5(F.concat_ws("|", key, draw.cast("string"), F.floor(place / 4).cast("string")))
    return F.conv(F.substring(digest, (place % 4) * 8 + 1, F.lit(8)), 16, 10).cast("double") / 4294967296.0


def bootstrap_means(rows: DataFrame, keys: list[str], order: list[str], value: str = "diff", draws: int = DRAWS) -> DataFrame:
    """(keys, condition_count, ci95_low, ci95_high): the 2.5 and 97.5 percent places among sorted means of resamples.

    A group is one number per condition of the grid, so it is small whatever the rows
    behind the conditions. Draws depend on the group's keys alone, so they are the same in
    every engine and partitioning. A group of one has its number at both ends.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value])
    grouped = rows.groupBy(*keys).agg(listed.alias("values")).withColumn("key", F.concat_ws("|", *keys))
    n = F.size("values")
    places = F.sequence(F.lit(0), n - 1)
    mean = lambda d: F.aggregate(places, F.lit(0.0), lambda acc, i: acc + F.get("values", F.floor(drawn(F.col("key"), d, i) * n).cast("int"))) / n
    means = F.when(n > 1, F.sort_array(F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), mean))).otherwise(F.array_repeat(F.get("values", 0), draws))
    told = grouped.withColumn("means", means)
    return told.select(*keys, n.cast("long").alias("condition_count"), F.get("means", int(0.025 * draws) - 1).alias("ci95_low"), F.get("means", int(0.975 * draws) - 1).alias("ci95_high"))
