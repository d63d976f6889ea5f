import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    counts = [before]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] <= counts[1] and counts[3] < counts[2]
    rows = docs.collect()
    library = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(len(p.ids) for p in pieces) == sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in rows)
    at = {}
    for p in pieces:
        assert p.length == len(p.ids)
        at.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in at.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert sorted(at) == list(range(len(at)))


def test_run_gives_the_stages(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_stages_on_empty_tables_and_rows_without_ids(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    empty = docs.filter("false")
    odd = docs.filter("doc_id < 40").withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    odd = odd.unionByName(spark.createDataFrame([(None, None, None, None, None), (3, "", "en", "web", 0), (3, "", "en", "web", 0)], docs.schema))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, empty, SF)
        assert out.count() == 0 and (k == 4 or out.columns == docs.columns)
        odd = corpus_pipeline.staged(stage(spark, odd, SF), "odd")
        assert odd.count() > 0


def test_near_copies_survive_the_line_stage_and_go_in_the_next(spark):
    words = [f"w{i}" for i in range(300)]
    lines = [" ".join(words[i : i + 10]) for i in range(0, 300, 10)]
    copies = [(k, "\n".join([*lines[:k], f"other words here {'abcd'[k]}", *lines[k:]])) for k in range(4)]
    many = [(100 + k, "\n".join(["the same line in all of them", " ".join(f"u{k}_{i}" for i in range(80))])) for k in range(12)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in copies + many], "doc_id long, text string, lang string, source string, n_chars long")
    lined = corpus_pipeline.staged(corpus_pipeline.line_dedup(spark, docs, SF), "lined")
    texts = {r.doc_id: r.text for r in lined.collect()}
    assert all(texts[i] == t for i, t in copies) and sum("same line" in texts[i] for i, _ in many) == 1
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, lined, SF).collect()) == [0, *range(100, 112)]
