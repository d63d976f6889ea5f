"""Operator 5, document fingerprints by winnowing, in DataFrame operations only.

A text's grams are the hashes of every ``gram`` consecutive words. In each ``window``
consecutive grams the least is chosen, the rightmost of equal ones, and kept with its
position. Two texts that share window + gram - 1 consecutive words share a chosen hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyrolake.llm.text import words
from gyrolake.plans.staging import tasks

GRAM = 5
WINDOW = 8
LONGS = "array<bigint>"
LAST = -(1 << 63)  # null ids are ordered as this one


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def grams(text: Column, gram: int = GRAM) -> Column:
    """Hashes of every ``gram`` consecutive words; of the whole where it has fewer; none without words."""

    def hashed(w: Column) -> Column:
        n = F.size(w)
        rolled = F.transform(F.slice(w, 1, n - gram + 1), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, gram)]))
        return F.when(n >= gram, rolled).when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast(LONGS))

    return let(words(text), hashed)


def fingerprint(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """array<struct<hash, pos>>: the chosen grams in order of position; one window where there are fewer grams."""

    def choose(g: Column) -> Column:
        wide = F.least(F.lit(window), F.size(g))
        least = F.transform(F.sequence(F.lit(1), F.size(g) - wide + 1), lambda i: F.array_min(F.slice(g, i, wide)))

        def chosen(m: Column) -> Column:
            fresh = lambda v, i: F.when((i == 0) | (F.get(m, i - 1) != v) | (F.get(g, i + wide - 1) == v), i)
            at = F.filter(F.transform(m, fresh), lambda i: i.isNotNull())
            last = lambda i: i + wide - F.array_position(F.reverse(F.slice(g, i + 1, wide)), F.get(m, i)).cast("int")
            return F.transform(at, lambda i: F.struct(F.get(m, i).alias("hash"), last(i).alias("pos")))

        return F.when(F.size(g) > 0, let(least, chosen)).otherwise(F.array().cast("array<struct<hash:bigint,pos:int>>"))

    return let(grams(text, gram), choose)


def shown(fp: Column) -> Column:
    """A fingerprint as text: hash@position, in order."""
    return F.array_join(F.transform(fp, lambda x: F.concat(F.lower(F.hex(x["hash"])), F.lit("@"), x["pos"].cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two hash arrays; 1 where neither has any."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def in_chain(docs: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Window]:
    """Rows (bucket, wrap, id, text, copy) and the window in which each row's successor follows it.

    The order is descending id, null ids last, equal ids by the text's hash; after the last
    row comes the first. No task holds it all: ids are cut at quantiles into buckets, and
    an id that fills several quantiles is cut by ranges of the hash as well. Each bucket
    also gets a copy of the row that follows its last one, which is the first of the next
    bucket. At most 2 x ``buckets`` numbers pass through the driver.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"place": F.bitwise_not("id"), "hash": F.xxhash64("text")})
    shares = [k / buckets for k in range(1, buckets + 1)]
    quantiles = rows.agg(F.percentile_approx("place", shares, 20 * buckets + 10_000).alias("q")).first().q or []
    cuts = sorted(set(quantiles))
    ranges = [quantiles.count(c) if quantiles.count(c) > 2 else 0 for c in cuts] + [0]
    firsts = [k + sum(ranges[:k]) for k in range(len(ranges))]
    cut, many, first = (F.array(*map(F.lit, x)).cast(LONGS) for x in (cuts, ranges, firsts))
    at = F.size(F.filter(cut, lambda c: c < F.col("place")))
    within = F.shiftright((F.shiftright("hash", 40) + (1 << 23)) * F.get(many, at), 24)
    bucket = F.get(first, at) + F.when((F.get(many, at) > 0) & (F.get(cut, at) == F.col("place")), within + 1).otherwise(0)
    rows = rows.withColumn("own", bucket)
    heads = sorted(rows.groupBy("own").agg(F.min(F.struct("place", "hash")).alias("head")).select("own", "head.*").collect())
    before = {h.own: heads[k - 1].own for k, h in enumerate(heads)}
    size = sum(ranges) + len(ranges)
    spread = lambda values: F.array(*[F.lit(values.get(k)) for k in range(size)]).cast(LONGS)
    target, place, hashed = spread(before), spread({h.own: h.place for h in heads}), spread({h.own: h.hash for h in heads})
    wraps = F.col("own") == (heads[0].own if heads else 0)
    slot = lambda b, wrap, copy: F.struct(b.cast("int").alias("bucket"), wrap.cast("int").alias("wrap"), F.lit(copy).alias("copy"))
    own = slot(F.col("own"), F.lit(0), False)
    leads = (F.get(place, F.col("own").cast("int")) == F.col("place")) & (F.get(hashed, F.col("own").cast("int")) == F.col("hash"))
    slots = F.when(leads, F.array(own, slot(F.get(target, F.col("own").cast("int")), wraps, True))).otherwise(F.array(own))
    return rows.select("id", "text", "place", "hash", F.inline(slots)), Window.partitionBy("bucket").orderBy("wrap", "copy", "place", "hash")


def edited_pairs(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, edited, fp, edited_fp, next_hashes) of every row.

    The edited text is the row's text with its last half replaced by the next row's
    beginning (see in_chain for the order), which is a planted near copy. Null texts are
    empty and have an empty fingerprint, like texts without words. Repeated rows follow
    one another. A single row follows itself; an empty table gives an empty result.
    Other columns are ignored. Texts are shuffled once.
    """
    spark = docs.sparkSession
    rows, chain = in_chain(docs, 4 * tasks(spark), id_col, text_col)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - half)"), F.expr("left(following, half)"))
    paired = rows.withColumn("following", F.lead("text").over(chain)).withColumn("half", half)
    printed = paired.withColumn("edited", edited).drop("following", "half").withColumn("fp", fingerprint(F.col("text"), gram, window))
    return (
        printed.withColumn("next_hashes", F.lead(F.col("fp.hash")).over(chain))
        .filter(~F.col("copy"))
        .withColumn("edited_fp", fingerprint(F.col("edited"), gram, window))
        .select(F.nullif(F.col("id"), F.lit(LAST)).alias(id_col), F.length("text").cast("long").alias("n_chars"), "edited", "fp", "edited_fp", "next_hashes")
    )
