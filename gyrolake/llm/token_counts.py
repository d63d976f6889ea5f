"""Operator 9, token counts: a map-side two-tier lookup.

Tier 1 is a broadcast table of the corpus's most frequent white-space chunks and their
token counts, of a fixed size. Tier 2 encodes what it misses through caches that live in
the Python workers. Neither pre-tokens nor texts are shuffled: the counting of frequent
chunks exchanges only a bounded summary of each task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolake.llm.tokens import encoder
from gyrolake.plans.staging import staged

TABLE_ENTRIES = 32_768  # chunks in the broadcast table, each of at most CHUNK_CHARS
SUMMARY_ENTRIES = 4_096  # chunks that a task reports
CHUNK_CHARS = 32
COUNTED = "id long, n_bytes long, n_tokens long"


def frequent_chunks(texts: DataFrame) -> dict[str, int]:
    """Chunk -> number of times seen, for the most frequent chunks of the whole column ``text``.

    The table only saves work: counts are exact whatever it holds.
    """

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                if (t := text.as_py()) is not None:
                    seen.update(t.lower().split())
            if len(seen) > 64 * SUMMARY_ENTRIES:
                seen = Counter(dict(seen.most_common(16 * SUMMARY_ENTRIES)))
        top = [(c, n) for c, n in seen.most_common(SUMMARY_ENTRIES) if len(c) <= CHUNK_CHARS and n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["chunk", "n"])

    told = texts.select("text").mapInArrow(summaries, "chunk string, n long")
    seen = staged(told.groupBy("chunk").agg(F.sum("n").alias("n")), "chunks")
    order = F.floor(F.log2("n"))
    left, chosen = TABLE_ENTRIES, None
    for r in sorted(seen.groupBy(order.alias("o")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):  # at most 64 orders of magnitude
        part = -(-r.n // left) if left else 0  # of the last order that is taken, the share that fits
        if part:
            taken = (order == r.o) & (F.pmod(F.xxhash64("chunk"), F.lit(part)) == 0)
            chosen = taken if chosen is None else chosen | taken
        left = max(0, left - r.n)
    return {} if chosen is None else {r.chunk: r.n for r in seen.filter(chosen).collect()}


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens) of every row, as the tokenizer file's library counts them.

    ``tokenizer`` is the file's path, the same on every executor. A null text counts as
    empty: 0 bytes, 0 tokens. Null ids stay null; repeated rows give a row each; an empty
    table gives an empty result; other columns are ignored whatever their names. Texts
    may be of any length: each is handled alone.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    local = encoder(tokenizer)
    table = {c: len(local.chunks[c]) // 4 for c in frequent_chunks(texts) if local.split(c) == [c]}
    shared = spark.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lengths = encoder(tokenizer), _Lengths(shared.value, tokenizer)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column(1):
                t = text.as_py() or ""
                n_bytes.append(len(t) if t.isascii() else len(t.encode()))
                n_tokens.append(sum(map(lengths.__getitem__, chunks)) if (chunks := own.split(t)) is not None else len(own.whole(t)) // 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return texts.mapInArrow(count, COUNTED).withColumnRenamed("id", id_col)


class _Lengths(dict):
    """Tier 1 as its contents, tier 2 for what is missing; misses are remembered by the worker's encoder."""

    def __init__(self, table: dict[str, int], tokenizer: str):
        super().__init__(table)
        self.encoder = encoder(tokenizer)

    def __missing__(self, chunk: str) -> int:
        return len(self.encoder.chunks[chunk]) // 4
