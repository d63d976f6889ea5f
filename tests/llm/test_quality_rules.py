import re
from collections import Counter
from math import comb

from pyspark.sql import functions as F

from gyrolake.llm.quality_rules import Rules, judge, keep_good, tail

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_of_the_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    got = judge(docs, labels).collect()
    assert {r.id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == want
    for r in got:
        n, _, _, _, rep = want[r.id]
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)


def test_binomial_tail(spark):
    rows = [(200, 3), (200, 0), (5000, 20), (40, 30), (100, 4)]
    for r in spark.createDataFrame(rows, "n long, k long").select("n", "k", tail(F.col("n"), F.col("k"), 0.05).alias("p")).collect():
        exact = sum(comb(r.n, i) * 0.05**i * 0.95 ** (r.n - i) for i in range(r.k + 1)) if r.k < r.n * 0.05 else 1.0
        assert abs(r.p - exact) < 1e-9


def labelled(spark, n, bad_share=0.0):
    text = " ".join(f"word{i}" for i in range(80))
    noisy = text.replace("word", "#$")
    rows = [(i, noisy if i < n * bad_share else text, "en", i, "x") for i in range(n)] + [(10_000 + i, noisy, "en", 0, "x") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int, id string")
    return docs, spark.createDataFrame([(i, 1) for i in range(n)], "doc_id long, quality int")


def test_certified_cutoffs_reject_junk_only(spark):
    docs, labels = labelled(spark, 3000)
    assert sorted(r.doc_id for r in keep_good(docs, labels).collect()) == list(range(3000))
    assert keep_good(docs, labels).columns == docs.columns


def test_no_cutoff_without_evidence(spark):
    docs, labels = labelled(spark, 60)
    assert keep_good(docs, labels).count() == 65
    docs, labels = labelled(spark, 3000, 0.02)  # good documents look alike
    assert keep_good(docs, labels, Rules(risk=0.005)).count() == 3005
    assert keep_good(docs, labels.filter("false")).count() == 3005


def test_nulls_ties_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(60))
    long = " ".join(f"w{i % 5000}" for i in range(200_000))
    rows = [(1, None, None), (None, text, None), (2, text, "en"), (2, text, "en"), (3, "", "en"), (4, "a b a b a b", "de"), (5, long, "en"), (6, "x y z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(2, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = sorted(((r.id, r.n_words, r.n_repeat_words, r.kept) for r in judge(docs, labels, Rules()).collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (None, 60, 0, True), (2, 60, 0, True), (2, 60, 0, True), (3, 0, 0, False), (4, 6, 6, False), (5, 200_000, 200_000, False), (6, 3, 0, False)], key=str)
    assert judge(docs.filter("false"), labels).count() == 0


def test_thin_strata_are_tested_as_one_group(spark):
    text = " ".join(f"word{i}" for i in range(80))
    noisy = text.replace("word", "#$")
    rows = [(1000 * g + i, text, lang) for g, lang in enumerate(("de", "fr", "es", None)) for i in range(600)]
    junk = [(10_000 + g, noisy, lang) for g, lang in enumerate(("de", "fr", "es", None, "xx", "unlabelled"))]
    own = [(20_000, noisy, "xx"), (20_001, noisy, "xx")]  # good by their labels, so xx keeps what the group rejects
    docs = spark.createDataFrame(rows + junk + own, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, _, _ in rows + own], "doc_id long, quality int")
    strict = Rules(risk=0.005)
    kept = {r.doc_id for r in keep_good(docs, labels, strict).collect()}
    assert kept == {i for i, _, _ in rows + own} | {10_004, 10_005}
    few = labels.filter("doc_id % 1000 < 100")
    assert keep_good(docs, few, strict).count() == docs.count()


def test_rules_together_stay_within_the_risk(spark):
    text = " ".join(f"word{i}" for i in range(300))
    odd = {0: text.replace("word", "#$"), 1: text.upper(), 2: text + "\nend" * 60}
    rows = [(i, odd.get(i % 100, text), "en") for i in range(2000)]  # each rule alone would reject 1 %, together 3 %
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert keep_good(docs, labels, Rules(risk=0.03)).count() > 0.97 * 2000
    assert keep_good(docs, labels, Rules(risk=0.05)).count() <= 0.97 * 2000


def test_verdicts_of_the_whole_table_as_sql(spark):
    import duckdb

    from gyrolake.llm import queries

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    want = con.execute(queries.oracle_sql()["op2_quality_rules"]).df()
    got = queries.queries()["op2_quality_rules"](spark, "/root/testdata/sf0.01").toPandas()
    rows = lambda d: sorted(map(tuple, d[sorted(got.columns)].itertuples(index=False)))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    assert (~got.kept & ~got.base_failed).sum() > 0
