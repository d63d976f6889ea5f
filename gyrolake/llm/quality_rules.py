"""Operator 2, quality rules: risk-controlled thresholds, in DataFrame operations only.

Fixed rules (too few words, too much repetition) come first. Beyond them, a ladder of
nested steps goes from lenient to strict; each step has a cutoff for every feature and
rejects what exceeds any of them. For each stratum, labelled good documents that pass the
fixed rules are the holdout: a step is certified if the exact binomial tail
P(Bin(n, risk) <= rejected) is at most miss / groups, where ``rejected`` counts all the
step's rules together. That is Bonferroni's correction over the groups; along the ladder
steps are tested in order up to the first that fails, which needs no correction
(fixed-sequence testing). All certified steps hold together, so any may be chosen: the
most lenient of those that reject most labelled bad documents applies, the strictest where
a group has no labelled bad documents. A group is a stratum, or
all strata together that have too few labels to certify anything alone: for those the
risk holds over the group, not in each. A group without enough labels, and a stratum
without any, certify nothing and reject nothing beyond the fixed rules. Cutoffs are
kept in a table of one row a stratum.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyrolake.llm.text import packed, words
from gyrolake.plans.staging import staged

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rules:
    """With probability 1 - ``miss`` no group's rules together reject more than ``risk`` of its good documents.

    A document is rejected if a feature exceeds its cutoff; ``ladders`` have a cutoff for
    each step, from lenient to strict.
    """

    risk: float = 0.03
    miss: float = 0.1
    ladders: dict[str, tuple[float, ...]] = field(
        default_factory=lambda: {
            "symbol_share": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.05, 0.03, 0.02, 0.015),
            "dup_line_share": (0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.5, 0.45, 0.4, 0.3, 0.2),
            "repeat_share": (0.48, 0.46, 0.44, 0.42, 0.4, 0.38, 0.36, 0.33, 0.3, 0.25, 0.2, 0.15),
            "upper_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12),
            "short_word_excess": (3.5, 3.2, 3.0, 2.8, 2.5, 2.2, 2.0, 1.7, 1.5, 1.2, 1.0, 0.8),
        }
    )


def text_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper of column ``text``.

    Everything stays in arrays of the row. Two steps must not be merged by the
    optimizer into an expression evaluated for each array element, so each step's
    arrays are used more than once in the next.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = docs.withColumns({"__w": words(F.col(text)), "__l": lines})
    w = F.col("__w")
    shingles = F.when(F.size(w) >= 3, F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    two = one.select(
        *docs.columns,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.length(whole) - F.length(F.regexp_replace(whole, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        shingles.alias("__h"),
    )
    h = F.col("__h")
    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    three = two.withColumn("__s", F.when(F.size(F.array_distinct(h)) < F.size(h), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    s = F.col("__s")
    twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
    four = three.withColumn("__r", F.sort_array(F.transform(twice, lambda x: x["i"])))
    r = F.col("__r")
    covered = F.aggregate(F.transform(r, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(r, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return four.withColumn("n_repeat_words", covered).drop("__h", "__s", "__r")


def ratios() -> dict[str, Column]:
    """The features of the ladders, from the counts."""
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return {
        "symbol_share": per("n_symbols", "word_chars"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "upper_share": per("n_upper", "word_chars"),
        "short_word_excess": F.greatest(F.lit(0.0), F.lit(5.0) - per("word_chars", "n_words")),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def tail(n: Column, k: Column, risk: float) -> Column:
    """P(Bin(n, risk) <= k), summed in logarithms; 1 where k is at or above the mean, where no test can pass."""
    step = math.log(risk) - math.log1p(-risk)
    start = F.struct((n * math.log1p(-risk)).alias("term"), (n * math.log1p(-risk)).alias("total"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log(((n - i + 1) / i).cast("double")) + step
        top = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(F.least(acc["total"], term) - top))).alias("total"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * risk, F.lit(1.0)).otherwise(F.exp(F.aggregate(terms, start, add, lambda acc: acc["total"])))


def certified(holdout: DataFrame, rules: Rules) -> DataFrame:
    """(stratum, cut_<feature>...): the cutoffs of the chosen certified step, if any.

    ``holdout`` has stratum, good and the ladders' features of labelled documents. A stratum is
    thin if not even a step without rejections could pass; which are is settled by the
    numbers of labels alone. Thin strata are tested as one group. A thin stratum takes a
    step of the group only if no more than ``risk`` of its own holdout is rejected.
    """
    steps = range(len(next(iter(rules.ladders.values()))))
    exceeds = lambda i: reduce(or_, (F.col(f) > cs[i] for f, cs in rules.ladders.items()))
    count = lambda test: F.sum(test.cast("long"))
    told = F.array(*[F.struct(count(F.col("good") & exceeds(i)).alias("k"), count(~F.col("good") & exceeds(i)).alias("caught")) for i in steps])
    strata = holdout.groupBy("stratum").agg(count(F.col("good")).alias("n"), count(~F.col("good")).alias("bad"), told.alias("told"))
    strata = staged(strata.filter("n > 0"), "strata")
    thin = F.col("n") * math.log1p(-rules.risk) > math.log(rules.miss / max(strata.count(), 1))
    strata = strata.withColumn("thin", thin).withColumn("alone", F.when(~thin, F.col("stratum")))
    level = rules.miss / max(strata.select("thin", "alone").distinct().count(), 1)
    tests = strata.select("stratum", "n", "bad", "thin", "alone", F.posexplode("told").alias("step", "t")).select("*", "t.*")
    group = Window.partitionBy("thin", "alone", "step")
    tests = tests.withColumns({f"group_{c}": F.sum(c).over(group) for c in ("n", "k", "bad", "caught")})
    own = ~F.col("thin") | (F.col("k") <= F.col("n") * rules.risk)
    tests = tests.withColumn("passes", own & (tail(F.col("group_n"), F.col("group_k"), rules.risk) <= level))
    so_far = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = tests.withColumn("ok", F.min("passes").over(so_far)).filter("ok")
    lenient = F.when(F.col("group_bad") > 0, -F.col("step")).otherwise(F.col("step"))
    best = best.groupBy("stratum").agg(F.max(F.struct("group_caught", lenient.alias("rank"), "step")).alias("best")).select("stratum", "best.step")
    return best.select("stratum", *[F.get(F.array(*map(F.lit, cs)), F.col("step")).alias(f"cut_{f}") for f, cs in rules.ladders.items()])


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(row, id, stratum, counts, base_failed) of every row."""
    rows = packed(docs, F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(stratum_col).cast("string").alias("stratum"))
    return text_features(rows).drop("text").withColumn("base_failed", base_failed())


def learn_cutoffs(counts: DataFrame, labels: DataFrame, rules: Rules) -> DataFrame:
    """One row per stratum with certified cutoffs: at_stratum, cut_<feature>..."""
    told = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.min("quality") == 1).alias("good"), F.max("quality").alias("most"))
    told = told.filter("good or most = 0").select("id", "good")
    features = counts.filter(~F.col("base_failed")).withColumns(ratios())
    return staged(certified(features.join(told, "id"), rules).withColumnRenamed("stratum", "at_stratum"), "cutoffs")


def verdicts(counts: DataFrame, cutoffs: DataFrame, rules: Rules) -> DataFrame:
    """``counts`` with ``kept``."""
    fails = F.lit(False)
    for f, value in ratios().items():
        fails = fails | F.coalesce(value > F.col(f"cut_{f}"), F.lit(False))
    joined = counts.join(cutoffs, counts.stratum.eqNullSafe(cutoffs.at_stratum), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~fails).drop("at_stratum", *[f"cut_{f}" for f in rules.ladders])


def judge(docs: DataFrame, labels: DataFrame, rules: Rules | None = None, **columns: str) -> DataFrame:
    """(id, stratum, counts, base_failed, kept) of every row.

    ``labels`` (doc_id, quality) holds 1 for good documents and 0 for bad ones; nulls are
    not used; a document labelled several times counts once, if all say the same.
    Null texts have no words and fail the fixed rules. Null strata are a stratum of
    their own. Repeated rows are judged each on their own, alike. Without labels only
    the fixed rules reject. An empty table gives an empty result. Other columns are
    ignored, whatever their names; ``columns`` names id_col, text_col and stratum_col.
    """
    rules = rules or Rules()
    counts = staged(counted(docs, **columns).drop("row"), "counts")
    return verdicts(counts, learn_cutoffs(counts, labels, rules), rules)


def keep_good(docs: DataFrame, labels: DataFrame, rules: Rules | None = None, **columns: str) -> DataFrame:
    """The rows that the rules keep, with the columns of ``docs``; rows are written once beside their counts, so that texts are counted once."""
    rules = rules or Rules()
    rows = staged(counted(docs, **columns), "counts")
    return verdicts(rows, learn_cutoffs(rows.drop("row"), labels, rules), rules).filter("kept").select("row.*")
