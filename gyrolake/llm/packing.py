"""Operator 7, packing: shortest-pack-first over the length histogram.

Documents are tokenised map-side and cut into pieces of at most the sequence length. Only
the histogram of piece lengths, which has as many rows as there are lengths, reaches the
driver. There, lengths are placed longest first, each into the pack that is shortest so
far, updating counts of packing patterns instead of single packs. The patterns become
slots (length, ranks, first sequence, offset), joined back to the pieces by rank.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolake.llm.text import salted_rank
from gyrolake.llm.tokens import encoder
from gyrolake.plans.staging import staged, tasks

SEQUENCE_TOKENS = 2048
END_ID = 1
SLOTS_BROADCAST = 200_000  # rows; more slots are joined by a shuffle
PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, tokenizer: str, size: int = SEQUENCE_TOKENS, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document's ids and its end id: (id, start, length, ids_crc32, doc_tokens[, ids])."""
    end = end_id.to_bytes(4, "little")
    schema = PIECES + ", ids array<int>" * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            rows, cut = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = own.ids(text.as_py() or "") + end
                n = len(ids) // 4
                for start in range(0, n, size):
                    piece = ids[4 * start : 4 * (start + size)]
                    rows.append((i, start, len(piece) // 4, zlib.crc32(piece), n))
                    if with_ids:
                        cut.append(piece)
                if len(rows) >= 4096:
                    yield _batch(rows, cut, with_ids)
                    rows, cut = [], []
            yield _batch(rows, cut, with_ids)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(pieces, schema)


def _batch(rows: list[tuple], cut: list[bytes], with_ids: bool) -> pa.RecordBatch:
    names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
    arrays = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
    if with_ids:
        ends = np.concatenate([[0], np.cumsum([len(c) // 4 for c in cut], dtype=np.int64)]).astype(np.int32)
        arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(cut), "<i4"))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names)


def pack_histogram(counts: dict[int, int], size: int = SEQUENCE_TOKENS) -> list[tuple[list[int], int]]:
    """Packing patterns (lengths in order, number of sequences) for a histogram of lengths.

    Longest lengths first; each goes to the pattern with the most room left. A step uses
    up either a length or a pattern, so the work follows the number of lengths, not of
    documents.
    """
    by_room: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = max((r for r, packs in by_room.items() if packs), default=-1)
            if room < length:
                by_room[size - length].append(([length], left))
                break
            lengths, many = by_room[room].pop()
            used = min(left, many)
            by_room[room - length].append(([*lengths, length], used))
            if many > used:
                by_room[room].append((lengths, many - used))
            left -= used
    return [p for room in sorted(by_room) for p in by_room[room]]


def slots_of(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset, sequence's tokens) of each place in each pattern."""
    slots, ranked, sequence = [], defaultdict(int), 0
    for lengths, many in patterns:
        offset, total = 0, sum(lengths)
        for length in lengths:
            slots.append((length, ranked[length], ranked[length] + many, sequence, offset, total))
            ranked[length] += many
            offset += length
        sequence += many
    return slots


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE_TOKENS, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece's place: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, padded_tokens[, ids].

    Sequences hold at most ``size`` tokens. ``padded_tokens`` is ``size``, or the
    sequence's own tokens where those are a power of two. A null text is empty: its
    document is the end id alone. Null ids stay null. Equal rows are packed each on its
    own. Any length of text is cut into full pieces and one rest. An empty table gives
    an empty result, and other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = staged(cut_documents(docs, tokenizer, size, end_id, with_ids, id_col, text_col), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = slots_of(pack_histogram(counts, size))
    table = spark.createDataFrame(slots, "slot_length long, first_rank long, after_rank long, first_sequence long, offset long, sequence_tokens long")
    table = F.broadcast(table) if len(slots) <= SLOTS_BROADCAST else table
    ranked = salted_rank(pieces, ["length"], ["id", "start", "ids_crc32"], tasks(spark))
    placed = ranked.join(table, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("after_rank")))
    tokens = F.col("sequence_tokens")
    return placed.select(
        F.col("id").alias(id_col),
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"),
        "offset",
        "sequence_tokens",
        F.when(tokens.bitwiseAND(tokens - 1) == 0, tokens).otherwise(F.lit(size).cast("long")).alias("padded_tokens"),
        *(["ids"] if with_ids else []),
    )
