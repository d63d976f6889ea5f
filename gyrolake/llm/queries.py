"""The registered queries of the text operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyrolake.llm.quality_rules import Rules

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
MAX_TOKENS = 2048
FIELD_DOCS = 3  # documents of different words from which a position of a line template is variable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gyrolake.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), TOKENIZER, MAX_TOKENS)


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gyrolake.llm.templates import dedup_lines

    cut = dedup_lines(table(spark, sf_dir, "documents"))
    return cut.select(F.col("row.doc_id").alias("doc_id"), "n_dropped", "text")


def learned_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op8_line_templates, with wordy fields learnt in the tree's leaves."""
    from gyrolake.llm.templates import dedup_lines

    cut = dedup_lines(table(spark, sf_dir, "documents"), field_docs=FIELD_DOCS)
    return cut.select(F.col("row.doc_id").alias("doc_id"), "n_dropped", "text")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gyrolake.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), TOKENIZER).withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gyrolake.llm.mixing import replicate

    mixed = replicate(table(spark, sf_dir, "documents"), seed=11)
    return mixed.select(*[F.col(f"row.{c}") for c in ("doc_id", "text", "lang", "source", "n_chars")], F.round("rate", 9).alias("rate"), F.col("copies").cast("long"), F.col("copy").cast("long"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gyrolake.llm.quality_rules import judge

    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(F.col("id").alias("doc_id"), *counts, "base_failed", "kept")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gyrolake.llm.personal_data import find_personal_data, joined

    told = find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256")
    secrets = F.size(F.filter("spans", lambda s: s["kind"] == "secret")).cast("long").alias("n_secret")
    return told.select("doc_id", *map(count, ("email", "ip", "card", "phone")), base, joined(F.col("spans")).alias("spans"), secrets, F.size("spans").cast("long").alias("n_spans"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gyrolake.llm.weak_quality import classify

    return classify(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gyrolake.llm.winnowing import edited_pairs, likeness, shown

    pairs = edited_pairs(table(spark, sf_dir, "documents"))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown(F.col("fp")).alias("fingerprint"),
        shown(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp.hash"), F.col("edited_fp.hash")).alias("near_edited"),
        likeness(F.col("fp.hash"), F.col("next_hashes")).alias("near_next"),
    )


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gyrolake.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gyrolake.llm.repeats import remove_repeats

    cut = remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gyrolake.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gyrolake.llm.main_text import extract

    return extract(table(spark, sf_dir, "pages")).select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gyrolake.llm.vector_codes import compress, with_group_error

    codes, books = compress(table(spark, sf_dir, "embeddings"), keep=["vec_id", "label"])
    hexed = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "").alias("code")
    return with_group_error(codes, "label").select("row.vec_id", hexed, "error", F.col("group_error").alias("label_error"), F.lit(books.digest()).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_quality_rules, op3_personal_data, op4_quality_classifier, op5_fingerprints, op6_near_duplicates, op7_packing, op8_line_templates, op9_token_counts, op10_repeats, op11_phrases, op12_main_text, op13_vector_codes, learned_line_templates)}


#: Rates, distribution functions, draws and copies as in gyrolake.llm.mixing with seed 11 and equal weights.
MIXING_SQL = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
sums AS (SELECT CAST(count(*) AS DOUBLE) AS w, CAST(sum(n) AS DOUBLE) AS total FROM counts),
rates AS (SELECT source, 1.0::DOUBLE / w * total / n AS rate FROM counts, sums),
parts AS (SELECT source, rate, greatest(1, CAST(ceil(rate / 16.0) AS INTEGER)) AS parts FROM rates),
cdf AS (
  SELECT source, rate / parts AS mean, 0 AS k, exp(-(rate / parts)) AS term, exp(-(rate / parts)) AS upto FROM parts
  UNION ALL
  SELECT source, mean, k + 1, term * mean / (k + 1), upto + term * mean / (k + 1) FROM cdf WHERE k < 96
),
draws AS (
  SELECT d.doc_id, d.source, j,
    CAST(('0x' || substr(md5('11|' || coalesce(CAST(d.doc_id AS VARCHAR), md5(coalesce(d.text, ''))) || '|' || j), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(p.parts)) AS j)
),
copies AS (
  SELECT x.doc_id, CAST(count(c.k) AS BIGINT) AS copies
  FROM draws x LEFT JOIN cdf c ON c.source IS NOT DISTINCT FROM x.source AND c.upto <= x.u GROUP BY x.doc_id
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, round(r.rate, 9) AS rate, c.copies, t.copy
FROM documents d JOIN copies c USING (doc_id) JOIN rates r ON d.source IS NOT DISTINCT FROM r.source, LATERAL (SELECT unnest(range(c.copies)) AS copy) t
"""


REPEATS_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS p, w FROM w WHERE len(w) >= 35),
windows AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 34), ' ') AS words FROM starts),
repeated AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY words) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM repeated),
per AS (SELECT doc_id, list(i) AS gone, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN per ON w.doc_id = per.doc_id
"""


def rules_sql(rules: Rules) -> str:
    """Counts, certified steps and verdicts as in gyrolake.llm.quality_rules; the tail is summed through lgamma."""
    steps = ", ".join(f"({i}, {', '.join(repr(float(cs[i])) + '::DOUBLE' for cs in rules.ladders.values())})" for i in range(len(next(iter(rules.ladders.values())))))
    exceeds = " OR ".join(f"f.{f} > s.{f}" for f in rules.ladders)
    risk, miss = f"{rules.risk}::DOUBLE", f"{rules.miss}::DOUBLE"
    return rf"""
WITH steps(step, {", ".join(rules.ladders)}) AS (VALUES {steps}),
w AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
grams AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM w),
repeated AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(p, p + 3)) AS i FROM repeated) GROUP BY doc_id),
counts AS (SELECT w.doc_id, lang, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) AS n_upper, len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id),
features AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed, coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbol_share, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_share,
  coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_share, coalesce(n_upper / nullif(word_chars, 0), 0) AS upper_share, greatest(0.0::DOUBLE, 5.0 - coalesce(word_chars / nullif(n_words, 0), 0)) AS short_word_excess FROM counts),
told AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1 OR max(quality) = 0),
strata AS (SELECT f.lang, s.step, count(*) FILTER (good) AS n, count(*) FILTER (good AND ({exceeds})) AS k, count(*) FILTER (NOT good) AS bad, count(*) FILTER (NOT good AND ({exceeds})) AS caught
  FROM features f JOIN told USING (doc_id), steps s WHERE NOT base_failed GROUP BY f.lang, s.step HAVING count(*) FILTER (good) > 0),
thin AS (SELECT *, n * ln(1 - {risk}) > ln({miss} / (SELECT count(*) FROM (SELECT DISTINCT lang FROM strata))) AS thin FROM strata),
alone AS (SELECT *, CASE WHEN NOT thin THEN lang END AS alone FROM thin),
grouped AS (SELECT *, sum(n) OVER (PARTITION BY thin, alone, step) AS group_n, sum(k) OVER (PARTITION BY thin, alone, step) AS group_k, sum(bad) OVER (PARTITION BY thin, alone, step) AS group_bad, sum(caught) OVER (PARTITION BY thin, alone, step) AS group_caught FROM alone),
tails AS (SELECT *, CASE WHEN group_k >= group_n * {risk} THEN 1 ELSE list_sum(list_transform(range(CAST(group_k AS BIGINT) + 1), lambda i: exp(lgamma(group_n + 1) - lgamma(i + 1) - lgamma(group_n - i + 1) + i * ln({risk}) + (group_n - i) * ln(1 - {risk})))) END AS tail FROM grouped),
tests AS (SELECT *, (NOT thin OR k <= n * {risk}) AND tail <= {miss} / (SELECT count(*) FROM (SELECT DISTINCT thin, alone FROM alone)) AS passes FROM tails),
best AS (SELECT lang, step FROM (SELECT *, min(passes) OVER (PARTITION BY lang ORDER BY step) AS ok FROM tests) WHERE ok
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY group_caught DESC, CASE WHEN group_bad > 0 THEN step ELSE -step END) = 1),
cuts AS (SELECT lang AS at_lang, s.* FROM best JOIN steps s USING (step))
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({exceeds}, false) AS kept
FROM features f LEFT JOIN cuts s ON f.lang IS NOT DISTINCT FROM s.at_lang
"""


#: The template rule of gyrolake.llm.templates over two documents and more.
TEMPLATES_SQL = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
tokens AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS t FROM lines),
fields AS (SELECT *, list_transform(t, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '' ELSE x END) AS f FROM tokens),
leaves AS (SELECT doc_id, pos, line, CASE WHEN len(t) >= 3 AND (NOT regexp_matches(line, '[0-9]') OR regexp_matches(array_to_string(f, ''), '[A-Za-z]|[^\x00-\x7F]')) THEN f END AS f FROM fields),
owners AS (SELECT f, min(doc_id) AS owner FROM leaves WHERE f IS NOT NULL GROUP BY f),
kept AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n
  FROM leaves l LEFT JOIN owners o ON l.f = o.f WHERE l.f IS NULL OR l.doc_id = owner GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) - coalesce(n, 0) END AS n_dropped, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


#: As TEMPLATES_SQL, with the fields learnt behind the path of six tokens open as well.
LEARNED_TEMPLATES_SQL = rf"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
tokens AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS t FROM lines),
fields AS (SELECT *, list_transform(t, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '' ELSE x END) AS f FROM tokens),
leaves AS (SELECT doc_id, pos, line, CASE WHEN len(t) >= 3 AND (NOT regexp_matches(line, '[0-9]') OR regexp_matches(array_to_string(f, ''), '[A-Za-z]|[^\x00-\x7F]')) THEN f END AS f FROM fields),
seen AS (SELECT len(f) AS n, list_slice(f, 1, 6) AS path, p, f[p] AS value, min(doc_id) AS first
  FROM (SELECT doc_id, f, unnest(range(7, len(f) + 1)) AS p FROM leaves WHERE len(f) > 6) GROUP BY ALL),
varied AS (SELECT n, path, p FROM seen GROUP BY n, path, p HAVING count(DISTINCT first) >= {FIELD_DOCS}),
learnt AS (SELECT n, path, list(p) AS ps FROM varied GROUP BY n, path HAVING 2 * count(*) <= n),
blanked AS (SELECT l.*, ps, CASE WHEN ps IS NULL THEN f ELSE list_transform(f, lambda x, i: CASE WHEN list_contains(ps, i) THEN '' ELSE x END) END AS g
  FROM leaves l LEFT JOIN learnt o ON len(l.f) = o.n AND list_slice(l.f, 1, 6) = o.path),
templates AS (SELECT doc_id, pos, line, CASE WHEN ps IS NULL OR regexp_matches(array_to_string(g, ''), '[A-Za-z]|[^\x00-\x7F]') THEN g ELSE f END AS g FROM blanked),
owners AS (SELECT g, min(doc_id) AS owner FROM templates WHERE g IS NOT NULL GROUP BY g),
kept AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n
  FROM templates l LEFT JOIN owners o ON l.g = o.g WHERE l.g IS NULL OR l.doc_id = owner GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) - coalesce(n, 0) END AS n_dropped, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


#: All phrases of one to four words are counted; scores are exact in 128 bits.
PHRASES_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS p FROM words),
grams AS (SELECT lang, k, list_slice(w, p, p + k - 1) AS g FROM starts, range(1, 5) t(k) WHERE p + k - 1 <= len(w)),
freq AS MATERIALIZED (SELECT lang, k, g, count(*) AS f FROM grams GROUP BY lang, k, g HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
halves AS (SELECT lang, g, f AS a, x.k, list_slice(g, 1, x.k) AS head, list_slice(g, x.k + 1, freq.k) AS tail FROM freq, range(1, 4) x(k) WHERE x.k < freq.k),
cuts AS (SELECT c.lang, c.g, a, c.k, l.f AS l, r.f AS r, CAST(2000000 * CAST(a AS HUGEINT) // (l.f + r.f) AS BIGINT) AS score
  FROM halves c JOIN freq l ON l.lang = c.lang AND l.g = head JOIN freq r ON r.lang = c.lang AND r.g = tail),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (SELECT lang, list_slice(g, p, p + m - 1) AS g, max(f) AS f FROM freq, range(2, 4) t(m), range(1, 4) s(p) WHERE m < k AND p + m - 1 <= k GROUP BY ALL),
kept AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM best b LEFT JOIN inside i ON b.lang = i.lang AND b.g = i.g WHERE i.f IS NULL OR 100 * CAST(i.f AS HUGEINT) < 80 * CAST(a AS HUGEINT))
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM kept k JOIN totals t ON k.lang = t.lang QUALIFY rank <= 2000
"""


def codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2, width: int = 4) -> str:
    """Lloyd's rounds with every distance computed."""
    steps = [f"""
b0 AS MATERIALIZED (SELECT p, CAST(dense_rank() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS e, j, x FROM parts WHERE vec_id IN (SELECT vec_id FROM sound ORDER BY vec_id LIMIT {entries}))"""]
    near = "d{k} AS MATERIALIZED (SELECT a.vec_id, a.p, e, CAST(sum((a.x - b.x) * (a.x - b.x)) AS BIGINT) AS d FROM parts a JOIN b{k} b ON a.p = b.p AND a.j = b.j GROUP BY a.vec_id, a.p, e QUALIFY row_number() OVER (PARTITION BY a.vec_id, a.p ORDER BY d, e) = 1)"
    for k in range(rounds):
        steps.append(near.format(k=k))
        steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (SELECT d.p, d.e, j, CAST(sum(x) - (sum(x) % count(*) + count(*)) % count(*) AS BIGINT) // count(*) AS x FROM d{k} d JOIN parts a ON d.vec_id = a.vec_id AND d.p = a.p GROUP BY d.p, d.e, j) m ON b.p = m.p AND b.e = m.e AND b.j = m.j)")
    steps.append(near.format(k=rounds))
    return f"""
WITH sound AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, CAST(p AS INTEGER) AS p, CAST(j AS INTEGER) AS j, v[{width} * p + j + 1] AS x FROM sound, range({parts}) t(p), range({width}) s(j)), {", ".join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM d{rounds} GROUP BY vec_id)
SELECT s.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(x, ',' ORDER BY p, e, j)) FROM b{rounds}) AS codebooks_sha256
FROM sound s JOIN coded c ON s.vec_id = c.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_phrases": PHRASES_SQL, "op13_vector_codes": codes_sql(), "op1_mixing": MIXING_SQL, "op2_quality_rules": rules_sql(Rules()), "op8_line_templates": TEMPLATES_SQL, "learned_line_templates": LEARNED_TEMPLATES_SQL, "op10_repeats": REPEATS_SQL}
