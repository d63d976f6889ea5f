import math
import random
import re
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from gyrolake.llm import queries
from gyrolake.llm.mixing import mix, replicate
from gyrolake.llm.templates import dedup_lines, drop_recurring_lines

SF = "/root/testdata/sf0.01"


def test_rates_and_distribution(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20_000, "a").when(F.col("id") < 29_000, "b").alias("source"), F.lit("t").alias("text"), F.lit(1).alias("rate"), F.lit(2).alias("copy"))
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("z", 5.0)], "source string, weight double")
    out = replicate(docs, weights, total=40_000)
    got = {r.source: r.n for r in out.groupBy("row.source").agg(F.count("*").alias("n")).collect()}
    assert set(got) == {"a", "b"} and all(abs(n - 20_000) < 5 * math.sqrt(20_000) for n in got.values())
    copies = Counter(r.copies for r in out.filter("row.source = 'a' and copy = 0").select("copies").collect())
    for k in range(1, 5):
        assert abs(copies[k] - 20_000 * math.exp(-1) / math.factorial(k)) < 5 * math.sqrt(20_000)
    assert mix(docs, weights).columns == docs.columns
    by_three = replicate(docs.repartition(3), weights, total=40_000)
    assert by_three.agg(F.sum(F.xxhash64("row.doc_id", "copy") % 1000)).first() == out.agg(F.sum(F.xxhash64("row.doc_id", "copy") % 1000)).first()


def test_large_rates_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, None, None), (None, "s", ""), (3, "s", "y"), (3, "s", "y")], "doc_id long, source string, text string")
    out = replicate(docs, total=6000)
    got = {r.source: r.n for r in out.groupBy("row.source").agg(F.count("*").alias("n")).collect()}
    assert set(got) == {None, "s"} and abs(got[None] - 3000) < 400 and abs(got["s"] - 3000) < 400
    assert replicate(docs.filter("false")).count() == 0
    assert replicate(docs, spark.createDataFrame([], "source string, weight double")).count() == 0


def test_rows_without_ids_draw_alone_and_are_scattered(spark):
    docs = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("s").alias("source"))
    out = replicate(docs, total=50_000)
    assert abs(out.count() - 50_000) < 5 * math.sqrt(50_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r["count"] for r in out.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 1.5 * sum(sizes) / len(sizes)


def same_as_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    key = sorted(got.columns)
    rows = lambda d: sorted(map(tuple, d[key].astype(object).itertuples(index=False)), key=str)
    assert rows(got) == rows(want)


def test_mixing_sql(spark):
    same_as_sql(spark, "op1_mixing")


def test_repeats_sql(spark):
    same_as_sql(spark, "op10_repeats")


def leaf(line):
    """A line's tokens with its variable fields open, or None."""
    t = re.findall(r"[^ \t\n\x0b\x0c\r]+", line)
    fields = tuple(None if re.search("[0-9]", x) else x for x in t)
    worded = re.search(r"[A-Za-z]|[^\x00-\x7f]", "".join(x or "" for x in fields))
    return fields if len(t) >= 3 and (worded or None not in fields) else None


def brute(rows, min_docs=2):
    """The rows (id, text) without lines whose leaf ``min_docs`` documents hold, this not the first of them."""
    docs = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            docs[leaf(line)].add((i is not None, i or 0, text))
    out = []
    for i, text in rows:
        if text is None:
            out.append((i, None, 0))
            continue
        first = lambda p: len(docs[p]) < min_docs or min(docs[p])[:2] == (i is not None, i or 0)
        kept = [line for line in text.split("\n") if leaf(line) is None or first(leaf(line))]
        out.append((i, "\n".join(kept), text.count("\n") + 1 - len(kept)))
    return sorted(out, key=str)


def test_templates_against_brute_force(spark):
    rows = [(1, "user 17 logged in today\nunique line here now\n\nok"), (2, "user 23 logged in today\nanother line is here"), (3, None), (None, "another line is here"), (4, ""), (5, "a b c d e f g\na b c d e f h\na b c d e f g"), (5, "a b c d e f g\na b c d e f h\na b c d e f g"), (6, "a b c d e f zz")]
    rows += [(10 + i, "\n".join(f"row {i * k % 7} of table {k} says é{k % 3}" for k in range(9))) for i in range(40)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_chars long, row string").repartition(3)
    got = sorted(((r.row.doc_id, r.text, r.n_dropped) for r in dedup_lines(docs).collect()), key=str)
    assert got == brute(rows)
    kept = drop_recurring_lines(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert all(r.text is None or r.n_chars == len(r.text) for r in kept.collect())
    assert sorted(((r.row.doc_id, r.text, r.n_dropped) for r in dedup_lines(docs, min_docs=5).collect()), key=str) == brute(rows, 5)
    assert drop_recurring_lines(docs.filter("false")).count() == 0


def test_templates_of_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.text, r.n_dropped) for r in queries.op8_line_templates(spark, SF).collect()), key=str)
    assert got == brute(rows)


def test_templates_sql(spark):
    same_as_sql(spark, "op8_line_templates")


def test_other_endings_and_repeats_inside_a_document_stay(spark):
    rows = [
        (1, "The clerk told us on Monday that ships sailed"),
        (2, "The clerk told us on Monday that prices fell"),
        (3, "Row 1 costs 5 in all\nRow 2 costs 9 in all\nRow 3 costs 7 in all"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.row.doc_id, r.text) for r in dedup_lines(docs).collect()) == rows


def test_templates_lose_no_words(spark):
    table = "1 2 3 4 5 6\n7 8 9 10 11 12\n| 1 | 2 |"
    rows = [(1, "a b c d e f g\nuser 17 logged in\nuser 18 logged in"), (2, "a b c d e f h\na b c d e f i\nuser 19 logged in"), (3, table), (4, table), (5, "a b c  d e f g\nok"), (6, "user 20 logged in")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_chars long, row string").repartition(3)
    got = {r.doc_id: r.text for r in drop_recurring_lines(docs).collect()}
    assert got == {1: rows[0][1], 2: "a b c d e f h\na b c d e f i", 3: table, 4: table, 5: "ok"}


def test_each_row_without_an_id_is_a_document(spark):
    rows = [(i, f"the line that recurs\nthe line of {name} alone") for i in (None, 4) for name in ("ann", "bob", "cyd", "dan")]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    owners = [r.row.doc_id for r in out if "recurs" in r.text]
    assert owners == [None] and sum(r.n_dropped for r in out) == 7 + 4


def test_many_rows_without_ids_and_a_long_text(spark):
    docs = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("the line that recurs\nline of "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit(" alone")).alias("text"))
    out = dedup_lines(docs).agg(F.count("*"), F.sum("n_dropped")).first()
    assert tuple(out) == (100_000, 99_999)
    long = "\n".join(f"word{'abcdefghij'[k % 10]} and {'x' * (k % 97)} here" for k in range(120_000))
    one = dedup_lines(spark.createDataFrame([(1, long), (2, "ok")], "doc_id long, text string")).filter("row.doc_id = 1").first()
    assert one.text == long


def test_pipeline_stage_drops_only_lines_held_elsewhere(spark):
    import corpus_pipeline

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {i: t for i, t, n in brute(rows, corpus_pipeline.BOILERPLATE_DOCS) if not n or re.search("[^ \\t\\n\\x0b\\x0c\\r]", t)}
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    assert got == want and got != dict(rows)


def test_equal_rows_are_one_document(spark):
    """Nine equal rows and one other document hold the line in two documents, not in ten."""
    rows = [(1, "the line that recurs here\nand more of the first")] * 9 + [(2, "the line that recurs here\nand more of the second")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 4):
        assert all(r.n_dropped == 0 for r in dedup_lines(docs.repartition(parts), min_docs=10).collect())
        assert sorted(r.n_dropped for r in dedup_lines(docs.repartition(parts), min_docs=2).collect()) == [0] * 9 + [1]
    others = docs.unionByName(spark.createDataFrame([(10 + k, "the line that recurs here") for k in range(8)], "doc_id long, text string"))
    assert sum(r.n_dropped for r in dedup_lines(others.repartition(3), min_docs=10).collect()) == 9
    assert sum(r.n_dropped for r in dedup_lines(others.repartition(3), min_docs=11).collect()) == 0


def test_wordy_fields_are_learnt_at_their_depth(spark):
    people = [("alice", "alpha"), ("bob", "beta"), ("carol", "gamma")]
    rows = [(k, f"user {who} logged in from desk {place}\nuser {who} says hello to all of the others") for k, (who, place) in enumerate(people)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dropped = lambda rows, **how: [r.n_dropped for r in sorted(dedup_lines(rows, **how).collect(), key=lambda r: r.row.doc_id)]
    assert dropped(docs) == [0, 0, 0]
    assert dropped(docs, depth=1, field_docs=3) == [0, 2, 2]
    assert dropped(docs, depth=6, field_docs=3) == [0, 0, 0]  # the name lies on the path
    assert dropped(docs, depth=1, field_docs=4) == [0, 0, 0]
    assert dropped(docs.filter("doc_id < 2"), depth=1, field_docs=3) == [0, 0]
    one = spark.createDataFrame([(1, "\n".join(r[1] for r in rows)), (2, rows[0][1].replace("alice", "dan"))], "doc_id long, text string")
    assert dropped(one, depth=1, field_docs=3) == [0, 0]  # one document's lines are told apart by one document alone


def brute_learnt(rows, depth, field_docs, min_docs):
    """As ``brute``, for rows whose ids differ, with learnt fields open."""
    seen = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
    node = lambda f: (len(f), f[:depth])
    for i, text in rows:
        for f in filter(None, map(leaf, (text or "").split("\n"))):
            for p in range(depth, len(f)):
                seen[node(f)][p][f[p]].add((i is not None, i or 0))
    fields = {of: {p for p, values in at.items() if len({min(d) for d in values.values()}) >= field_docs} for of, at in seen.items()}

    def opened(line):
        f = leaf(line)
        at = f and fields.get(node(f), set())
        if not at or 2 * len(at) > len(f):
            return f
        g = tuple(None if p in at else x for p, x in enumerate(f))
        return g if re.search("[A-Za-z]|[^\x00-\x7f]", "".join(x or "" for x in g)) else f

    docs = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            docs[opened(line)].add((i is not None, i or 0))
    stays = lambda i, g: g is None or len(docs[g]) < min_docs or min(docs[g]) == (i is not None, i or 0)
    out = []
    for i, text in rows:
        kept = [line for line in (text or "").split("\n") if stays(i, opened(line))]
        out.append((i, text and "\n".join(kept), (text or "").count("\n") + 1 - len(kept) if text is not None else 0))
    return sorted(out, key=str)


def logs(n=60):
    rng = random.Random(5)
    word = lambda k: rng.choice(["ann", "bob", "cyd", "dan", "eve", "é", "7", "--"][:k])
    makes = [
        lambda: f"user {word(8)} of group {word(2)} logged in from desk {word(4)}",
        lambda: f"the clerk told us on Monday that {word(5)} {word(5)} {word(5)} {word(5)} {word(5)} {word(5)} {word(5)} {word(5)}",
        lambda: f"the clerk told us on Monday that {word(5)} left",
        lambda: f"1 2 3 4 5 6 {word(3)} 8",
        lambda: f"{word(3)} {word(2)} end",
        lambda: "",
    ]
    return [(i, "\n".join(rng.choice(makes)() for _ in range(rng.randrange(7)))) for i in range(n)] + [(None, "the clerk told us on Monday that zed left"), (1000, None)]


def test_learnt_fields_against_brute_force(spark, monkeypatch):
    from gyrolake.llm import templates

    monkeypatch.setattr(templates, "HELD_VALUES", 5)
    rows = logs()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fields string").repartition(4)
    results = set()
    for depth, field_docs, min_docs in ((1, 3, 2), (3, 4, 2), (6, 3, 2), (6, 3, 5)):
        got = sorted(((r.row.doc_id, r.text, r.n_dropped) for r in dedup_lines(docs, depth, min_docs=min_docs, field_docs=field_docs).collect()), key=str)
        assert got == brute_learnt(rows, depth, field_docs, min_docs)
        results.add(str(got))
    assert len(results) == 4
    assert dedup_lines(docs.filter("false"), field_docs=3).count() == 0


def test_learned_templates_sql(spark, tmp_path):
    rows = [r for r in logs() if r[0] is not None]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT doc_id, text, n_dropped FROM ({queries.oracle_sql()['learned_line_templates']})").fetchall()
    got = [(r.doc_id, r.text, r.n_dropped) for r in queries.queries()["learned_line_templates"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    plain = [(r.doc_id, r.text, r.n_dropped) for r in queries.op8_line_templates(spark, str(tmp_path)).collect()]
    assert sum(r[2] for r in got) > sum(r[2] for r in plain)
