"""Operator 3, personal data by weak supervision, in DataFrame operations only.

Patterns find candidate spans. Those of the fixed formats that pass their checks are base
spans and stay. For every candidate five labellers vote (1 personal, -1 not, 0 nothing):
the format's own check, a gazetteer of domains, prefixes, names and reserved ranges, the
words before the span, the characters around it, and the variety of its characters. Counts
of vote patterns over the whole corpus go to the driver, where expectation-maximisation
estimates each labeller's reliability on personal and on other spans, kind by kind. The
posteriors are the labels of the final span classifier, a logistic model of the votes, the
span's character shape and the word before it; it is fitted to the corpus-wide counts of
these, at most kinds x 3^5 x SHAPES x WORDS rows whatever the corpus, and decides on the
candidates that are not base spans. Patterns are possessive or bounded, so that no text
makes them recurse or scan a stretch twice.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyrolake.llm.text import keyed
from gyrolake.llm.winnowing import let
from gyrolake.plans.staging import staged

KINDS = ("email", "ip", "card", "phone", "ssn", "secret", "iban", "name", "address")
LOCAL = "[A-Za-z0-9._%+-]"
#: The fixed formats. A run is entered at its first character or where the last match ended,
#: and never given back, which finds what the plain patterns find, in linear time. Only chains
#: of 12 to 19 digits can be cards, so others are not listed.
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Words that introduce secrets, titles, street words.
SECRET_WORDS = "token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|credentials?"
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sra"
STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Square|Court"
SECRET_START = rf"(?i:(?<![A-Za-z0-9])(?:{SECRET_WORDS})[\"']?\x20{{0,3}}[=:]\x20{{0,3}}[\"']?)"
#: Further candidates: e-mail addresses spelt out, telephone numbers without a country code, social security numbers,
#: secrets after a word that introduces them or of a known form, account numbers, names after titles, street addresses.
MORE = [
    ("email", rf"(?<!{LOCAL}){LOCAL}++\x20[\[(]?at[\])]?\x20[A-Za-z0-9-]++\x20[\[(]?dot[\])]?\x20[A-Za-z]{{2,10}}+(?![A-Za-z])", r"(?: |\(|\[)at(?: |\)|\])"),
    ("phone", r"(?<![0-9+(][\x20(]?)(?<![0-9][ .-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])", "[0-9]{3}[.-][0-9]{4}"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]{2}-[0-9]"),
    ("secret", SECRET_START + "[A-Za-z0-9+/_.~-]{15,}[A-Za-z0-9+/_]", SECRET_START),
    ("secret", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36,}+|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+|[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])", "AKIA|gh[opsu]_|eyJ|[0-9a-f]{32}|[0-9A-F]{32}"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}"),
    ("name", rf"(?<![A-Za-z])(?:{TITLES})\.?\x20\p{{Lu}}\p{{Ll}}++(?:\x20\p{{Lu}}\p{{Ll}}++)?(?!\p{{L}})", rf"(?:{TITLES})\.?\x20\p{{Lu}}"),
    ("address", rf"(?<![0-9.,-])[0-9]{{1,5}}+[a-z]?\x20(?:\p{{Lu}}\p{{Ll}}{{1,20}}+\x20){{1,3}}(?:{STREETS})(?!\p{{L}})", rf"\x20(?:{STREETS})(?!\p{{L}})"),
]
# A gazetteer and context words.
DOMAINS = "com|org|net|edu|gov|mil|int|io|info|biz|app|dev|ai|co|me|tv|de|fr|es|uk|it|nl|eu|ch|at|be|pt|pl|se|no|dk|fi|cz|ie|us|ca|mx|br|ar|cl|au|nz|jp|cn|kr|in|za|ru|ua|tr|gr"
NAMES = "james|mary|john|anna|peter|paul|maria|michael|laura|thomas|julia|david|sarah|daniel|emma|hans|karl|heinz|klaus|sabine|ursula|monika|pierre|jean|marie|claire|luc|sophie|carlos|juan|jose|carmen|lucia|pablo|elena|smith|jones|brown|miller|wilson|taylor|müller|schmidt|schneider|fischer|weber|meyer|martin|bernard|dubois|durand|garcía|garcia|fernández|lópez|lopez|sánchez|pérez"
CONTEXT = {
    "email": "mail|contact|write|send|@",
    "ip": r"\bip\b|host|server|address|ping",
    "card": "card|visa|master|credit|pay",
    "phone": "call|tel|phone|fax|mobile|contact",
    "ssn": "ssn|social|security|tax",
    "secret": SECRET_WORDS,
    "iban": "iban|account|konto|bank|transfer",
    "name": "dear|contact|by|from|with|signed|attn",
    "address": r"\bat\b|address|lives?|located|ship|deliver",
}
AGAINST = r"version|order|page|chapter|isbn|serial|build|commit|sha|md5|checksum|#\s*$"
NO_SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,votes:array<int>,shape:int,word:int>>"
VOTES, SHAPES, WORDS = 5, 16, 16
EM_ROUNDS = 40
FIT_ROUNDS = 300
STRIDE = 64  # lengths summed at once


def prefix_sums(a: Column) -> Column:
    """For an array<int>, the sum of all elements before each; by strides, so that long arrays stay fast."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda acc, v: acc + v)

    def strided(v: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / STRIDE).cast("int")), lambda b: total(F.slice(v, b * STRIDE + 1, F.lit(STRIDE))))
        before = let(many, lambda m: F.transform(m, lambda x, b: total(F.slice(m, F.lit(1), b))))
        return let(before, lambda p: F.transform(v, lambda x, i: F.get(p, F.floor(i / STRIDE).cast("int")) + total(F.slice(v, F.floor(i / STRIDE).cast("int") * STRIDE + 1, i % STRIDE))))

    return let(a, strided)


def scanned(a: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What ``step`` has made of all elements before each, from ``zero`` on; by strides, so that long arrays stay fast."""

    def within(v: Column, start: Column) -> Column:
        first = F.struct(start.alias("now"), F.array().cast("array<int>").alias("held"))
        return F.aggregate(v, first, lambda acc, x: F.struct(step(acc["now"], x).alias("now"), F.concat(acc["held"], F.array(acc["now"])).alias("held")))["held"]

    strides = F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / STRIDE).cast("int")), lambda b: F.slice(a, b * STRIDE + 1, F.lit(STRIDE)))

    def joined_up(vs: Column) -> Column:
        starts = F.aggregate(vs, F.array(zero), lambda acc, v: F.concat(acc, F.array(F.aggregate(v, F.element_at(acc, -1), step))))
        return let(starts, lambda at: F.flatten(F.transform(vs, lambda v, b: within(v, F.get(at, b)))))

    return let(strides, joined_up)


def found(text: Column, pattern: str) -> Column:
    """array<struct<match, start, before, after>>: leftmost non-overlapping matches, their places in code points, and what lies beside them.

    What lies beside a match is taken from the gaps between matches, so that no match
    walks the text to its place.
    """
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def placed(p: Column) -> Column:
        both = F.transform(p["hits"], lambda m, i: F.length(F.get(p["gaps"], i)) + F.length(m))
        beside = lambda i: (F.right(F.get(p["gaps"], i), F.lit(30)).alias("before"), F.left(F.get(p["gaps"], i + 1), F.lit(1)).alias("after"))
        return let(prefix_sums(both), lambda before: F.transform(p["hits"], lambda m, i: F.struct(m.alias("match"), (F.get(before, i) + F.length(F.get(p["gaps"], i))).alias("start"), *beside(i))))

    return let(parts, placed)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    def worth(rev: Column) -> Column:
        doubled = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.aggregate(F.sequence(F.lit(0), F.length(rev) - 1), F.lit(0), lambda acc, i: acc + doubled(F.substring(rev, i + 1, F.lit(1)).cast("int"), i))

    return let(F.reverse(digits(match)), worth) % 10 == 0


def remainder(match: Column) -> Column:
    """An account number's remainder modulo 97, its first four characters moved to the end; 1 where it is right."""
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    turned = let(F.regexp_replace(match, "\x20", ""), lambda m: F.concat(F.substring(m, F.lit(5), F.length(m)), F.substring(m, 1, 4)))
    step = lambda acc, v: (acc * F.when(v < 10, 10).otherwise(100) + v) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, value(c))))


def passes(kind: str, match: Column) -> Column:
    """The format's own check of a match."""
    n = F.length(digits(match))
    if kind == "ip":
        small = lambda p: let(F.regexp_replace(p, "^0+", ""), lambda s: (F.length(s) < 3) | ((F.length(s) == 3) & (s <= "255")))
        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        return n.between(12, 19) & luhn(match)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    if kind == "iban":
        return remainder(match) == 1
    return F.lit(True)


def gazetteer(kind: str, match: Column) -> Column:
    vote = lambda good, bad: F.when(good, 1).when(bad, -1).otherwise(0)
    if kind == "email":
        return vote(match.rlike(rf"(?i)(\.|dot[\])]?\x20)(?:{DOMAINS})$"), match.rlike(r"\.[0-9]+$"))
    if kind == "ip":
        return vote(match.rlike(r"^(?:[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])\."), match.rlike(r"^0+\."))
    if kind == "card":
        return vote(digits(match).rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), digits(match).rlike("^[0789]"))
    if kind == "phone":
        return vote(match.rlike(r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9][0-9]{2}\)?[\x20.-][2-9])"), match.rlike(r"^\+?0"))
    if kind == "secret":
        return vote(match.rlike("^(?:AKIA|gh[opsu]_|eyJ)") | match.rlike("^(?i:[0-9a-f]+)$"), match.rlike("^[A-Za-z]+$") | match.rlike(r"\.(?i:com|org|net|html?|txt)$"))
    if kind == "iban":
        return vote(match.rlike("^(?:AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK)"), match.rlike("^[A-Z]{2}00"))
    if kind == "name":
        return F.when(F.lower(match).rlike(rf"\x20(?:{NAMES})(?:\x20|$)"), 1).otherwise(0)
    if kind == "address":
        return vote(match.rlike("(?:Street|Avenue|Road|Lane|Drive|Boulevard)$"), match.rlike("^0"))
    return vote(~match.rlike("^(?:000|666|9)|-00-|-0000$"), match.rlike("^(?:000|666|9)|-00-|-0000$"))


def candidates(text: Column) -> Column:
    """array<struct<kind, start, end, base, votes, shape, word>> of all patterns."""
    needs = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]")}
    patterns = [(kind, pattern, needs[kind], True) for kind, pattern in BASE.items()] + [(kind, pattern, text.rlike(need), False) for kind, pattern, need in MORE]
    spans = [F.when(wanted, F.transform(found(text, pattern), judged(kind, first))).otherwise(F.array().cast(NO_SPANS)) for kind, pattern, wanted, first in patterns]
    return F.concat(*spans)


def bucket(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def shape(match: Column) -> Column:
    """A span's classes of characters, runs made one."""
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(match, "[0-9]+", "9"), r"\p{Lu}+", "A"), r"\p{Ll}+", "a")
    return F.substring(runs, 1, 12)


def judged(kind: str, first: bool) -> Callable[[Column], Column]:
    """From a match to the candidate with the labellers' votes; ``first`` for the fixed formats."""

    def span(x: Column) -> Column:
        if kind != "secret":
            return told(x)
        cut = lambda intro: F.struct(F.substring(x["match"], F.length(intro) + 1, F.length(x["match"])).alias("match"), (x["start"] + F.length(intro)).alias("start"), F.concat(x["before"], intro).alias("before"), x["after"].alias("after"))
        return let(let(F.regexp_extract(x["match"], f"^{SECRET_START}", 0), cut), told)

    def told(x: Column) -> Column:
        m, start = x["match"], x["start"]
        end = start + F.length(m)
        ok = passes(kind, m)
        before = F.lower(x["before"])
        around = F.concat(F.right(x["before"], F.lit(1)), F.lit(" "), x["after"])
        few = m.rlike(r"^(.)\1+$") if kind == "secret" else digits(m).rlike("^([0-9])\\1{5,}$")
        votes = F.array(
            F.when(ok, 1).otherwise(-1),
            gazetteer(kind, m),
            F.when(before.rlike(CONTEXT[kind]), 1).when(before.rlike(AGAINST), -1).otherwise(0),
            F.when(around.rlike("[A-Za-z0-9_]"), -1).otherwise(1),
            F.when(few, -1).otherwise(0),
        )
        word = F.regexp_extract(before, r"([^\x20\x09-\x0D]+)[^a-z0-9]*$", 1)
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), (ok & F.lit(first)).alias("base"), votes.alias("votes"), bucket(shape(m), SHAPES).alias("shape"), bucket(word, WORDS).alias("word"))

    return span


def estimate(patterns: dict[tuple[str, tuple[int, ...]], int]) -> dict[tuple[str, tuple[int, ...]], float]:
    """P(personal) of each (kind, votes), by EM within the kind: labellers are independent given the truth."""
    out: dict[tuple[str, tuple[int, ...]], float] = {}
    for kind in {k for k, _ in patterns}:
        own = {v: n for (k, v), n in patterns.items() if k == kind}
        p = {v: 1 / (1 + math.exp(-1.5 * sum(v))) for v in own}
        size = len(next(iter(own)))
        for _ in range(EM_ROUNDS):
            mass = {True: 1.0, False: 1.0}
            seen = {(t, j, x): (3.0 if (x == 1) == t and x else 1.0) for t in (True, False) for j in range(size) for x in (-1, 0, 1)}
            for v, n in own.items():
                for t in (True, False):
                    share = n * (p[v] if t else 1 - p[v])
                    mass[t] += share
                    for j, x in enumerate(v):
                        seen[t, j, x] += share
            total = {(t, j): sum(seen[t, j, x] for x in (-1, 0, 1)) for t in (True, False) for j in range(size)}
            for v in own:
                odds = math.log(mass[True] / mass[False]) + sum(math.log(seen[True, j, x] / total[True, j]) - math.log(seen[False, j, x] / total[False, j]) for j, x in enumerate(v))
                p[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        out |= {(kind, v): q for v, q in p.items()}
    return out


PER_KIND = 1 + 3 * VOTES + SHAPES + WORDS  # weights: a bias, a weight for each vote, shape and word


def feature_places(kind: Column, votes: Column, shape_: Column, word: Column) -> Column:
    """Where a candidate's features lie among the weights."""
    start = (F.array_position(F.array(*map(F.lit, KINDS)), kind) - 1) * PER_KIND
    voted = [F.get(votes, j) + (2 + 3 * j) for j in range(VOTES)]
    return F.transform(F.array(F.lit(0), *voted, shape_ + (1 + 3 * VOTES), word + (1 + 3 * VOTES + SHAPES)), lambda x: start + x)


def fit(places: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Weights of a logistic model with soft labels ``p`` seen ``n`` times, by gradient steps with momentum."""
    w, speed = np.zeros(PER_KIND * len(KINDS)), np.zeros(PER_KIND * len(KINDS))
    share = n / np.bincount(places[:, 0] // PER_KIND, n, len(KINDS))[places[:, 0] // PER_KIND]  # each kind weighs alike
    for _ in range(FIT_ROUNDS):
        error = share * (1 / (1 + np.exp(-np.clip(w[places].sum(axis=1), -30, 30))) - p)
        g = np.bincount(places.ravel(), np.repeat(error, places.shape[1]), len(w)) + 1e-4 * w
        speed = 0.9 * speed - 0.5 * g
        w = w + speed
    return w


def classifier(spans: DataFrame) -> np.ndarray | None:
    """The weights of the span classifier; ``spans`` has one row ``s`` a candidate. None without candidates."""
    rows = spans.groupBy("s.kind", "s.votes", "s.shape", "s.word").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("kind", "votes", "n", feature_places(F.col("kind"), F.col("votes"), F.col("shape"), F.col("word")).alias("at")).orderBy("kind", "at").collect()
    if not rows:
        return None
    counted: dict[tuple[str, tuple[int, ...]], int] = {}
    for r in rows:
        counted[r.kind, tuple(r.votes)] = counted.get((r.kind, tuple(r.votes)), 0) + r.n
    belief = estimate(counted)
    return fit(np.array([r["at"] for r in rows]), np.array([r.n for r in rows], float), np.array([belief[r.kind, tuple(r.votes)] for r in rows]))


def apart(base: Column, more: Column) -> Column:
    """Those of ``more`` that overlap none of ``base``, and of those that overlap each other the leftmost, of equal starts the longest; both sorted by start."""
    least = lambda a, b: F.when(a < b, a).otherwise(b)
    most = lambda a, b: F.when(a > b, a).otherwise(b)
    # all spans by start, base ones first: how far those before reach, and, from the other end, where the next begins
    place = lambda s, of: F.struct(s["start"].alias("start"), F.lit(of).alias("of"), (-s["end"]).alias("back"), s["order"].alias("order"), s["kind"].alias("kind"), s["end"].alias("end"))
    every = F.array_sort(F.concat(F.transform(base, lambda s: place(s, 0)), F.transform(more, lambda s: place(s, 1))))

    def free(a: Column) -> Column:
        reach = scanned(a, F.lit(-1), lambda acc, s: F.when(s["of"] == 0, most(acc, s["end"])).otherwise(acc))
        begins = F.reverse(scanned(F.reverse(a), F.lit(2**31 - 1), lambda acc, s: F.when(s["of"] == 0, least(acc, s["start"])).otherwise(acc)))
        seen = F.zip_with(F.zip_with(a, reach, lambda s, r: F.struct(s.alias("s"), r.alias("r"))), begins, lambda x, n: F.struct(x["s"].alias("s"), ((x["s"]["of"] == 1) & (x["r"] <= x["s"]["start"]) & (n >= x["s"]["end"])).alias("free")))
        return F.transform(F.filter(seen, lambda x: x["free"]), lambda x: x["s"])

    def leftmost(a: Column) -> Column:
        upto = scanned(a, F.lit(-1), lambda acc, s: F.when(s["start"] >= acc, s["end"]).otherwise(acc))
        taken = F.zip_with(a, upto, lambda s, u: F.struct(s.alias("s"), (s["start"] >= u).alias("taken")))
        return F.transform(F.filter(taken, lambda x: x["taken"]), lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["order"].alias("order"), x["s"]["kind"].alias("kind"), x["s"]["end"].alias("end")))

    return let(let(every, free), leftmost)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, base, spans) of every row: arrays of struct<kind, start, end> in order of start, then kind.

    ``base`` are the fixed formats' spans that pass their checks, ``spans`` these and the
    candidates that the span classifier accepts and that overlap none of them nor, being the
    leftmost, the longest, one another. Places
    are code points, ends exclusive; a secret's span is its value, without the word that
    introduces it. Null and empty texts have none. Null ids stay null, repeated rows each
    get their spans, an empty table gives an empty result, and other columns are ignored.
    Texts are neither cut nor shuffled; long ones and those of many matches take time in
    proportion.
    """
    base = keyed(docs, id_col, text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    held = staged(base.select("id", candidates(F.col("text")).alias("c")), "candidates")
    weights = classifier(held.select(F.explode("c").alias("s")))
    worth = F.array(*[F.lit(float(w)) for w in (np.zeros(1) if weights is None else weights)])
    bare = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("order"), s["kind"].alias("kind"), s["end"].alias("end"))
    sure = F.transform(F.filter("c", lambda s: s["base"]), bare)
    score = lambda s: F.aggregate(feature_places(s["kind"], s["votes"], s["shape"], s["word"]), F.lit(0.0), lambda acc, x: acc + F.get(worth, x.cast("int")))
    more = F.filter("c", lambda s: ~s["base"] & (score(s) > 0))
    told = held.select("id", F.array_sort(sure).alias("base"), F.array_sort(F.array_distinct(F.transform(more, bare))).alias("more"))
    told = told.withColumn("spans", F.when(F.size("more") == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", apart(F.col("base"), F.col("more"))))))
    shown = lambda a: F.transform(a, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return told.select(F.col("id").alias(id_col), shown(F.col("base")).alias("base"), shown(F.col("spans")).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
