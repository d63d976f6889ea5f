"""Operator 10, substring dedup: seed and extend.

A window is ``window`` consecutive words. Winnowing picks one seed for each window: the
rightmost least hash of its ``SEED_WORDS``-grams, which depends on the window's words alone,
so equal windows have equal seeds at equal places. Consecutive windows with one seed
form a run, and the words of a run its span.

1. Seeds of all documents meet. A span is the seed extended both ways as far as its
   run reaches; where spans are equal, every window of both runs is a repeat. A seed
   seen once has no repeat.
2. Where a seed's spans differ (the ends of repeats), the extents are settled window by
   window: one occurrence of each different span sends its windows' hashes.
3. The union of repeated windows is each document's maximal repeats; their words go.

Work and rows follow the number of seeds, never pairs of occurrences: a passage of many
documents becomes one row in each task before anything is shuffled. A seed with more
than ``CONTEXTS`` different spans in one batch is dealt by span; such a seed is known to
be shared, so its rows need not meet.

Documents learn what was *not* repeated: a span or window that occurs once is known by
the one row it came from, and all others of a document are repeats. So nothing is
joined back to occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyrolake.llm.text import keyed
from gyrolake.plans.staging import staged

WINDOW = 35
SEED_WORDS = 8
CONTEXTS = 8  # different spans of a seed in a batch that are dealt by the seed
UNIQUE, OPEN, SAMPLE = 0, 1, 2  # a run whose seed is unique; one to be settled; one sent for others
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WORD_CACHE = 1_000_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


@lru_cache(maxsize=1)
def _word_hashes() -> _WordHashes:
    return _WordHashes()


@lru_cache(maxsize=64)
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    made = []
    for b in (base, inverse):
        p = np.full(1 << bits, b, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    return made[0], made[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Runs:
    """The windows of a text and the runs in which they share a seed."""

    def __init__(self, text: bytes, window: int):
        self.words, self.window = text.split(), window
        n = len(self.words)
        self.windows = max(0, n - window + 1)
        self.lo = self.hi = np.zeros(0, np.int64)
        if not self.windows:
            return
        hashes = np.fromiter(map(_word_hashes().__getitem__, self.words), np.uint64, n)
        self.sums = []
        for base in BASES:
            powers, inverse = _powers(base, max(14, n.bit_length()))
            self.sums.append((np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:n], dtype=np.uint64)]), inverse))
        grams = min(SEED_WORDS, window)
        at = np.arange(n - grams + 1)
        seeds = self.hash(0, at, at + grams)
        wide = window - grams + 1
        views = np.lib.stride_tricks.sliding_window_view(seeds[::-1], wide)[::-1]
        place = np.concatenate([wide - 1 - views[k : k + 65536].argmin(axis=1) for k in range(0, self.windows, 65536)]) + np.arange(self.windows)
        self.lo = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        self.hi = np.concatenate([self.lo[1:], [self.windows]]) - 1
        self.seed_at = place[self.lo]
        self.seed = seeds[self.seed_at]

    def hash(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums, inverse = self.sums[which]
        return _mix((sums[end] - sums[start]) * inverse[start])

    def spans(self) -> np.ndarray:
        """A hash of each run's words and of where its seed lies in them."""
        rest = self.hash(1, self.lo, self.hi + self.window)
        shape = ((self.seed_at - self.lo) * 4096 + (self.hi - self.lo)).astype(np.uint64)
        return _mix(rest + shape * np.uint64(BASES[0]))

    def window_hashes(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.hash(0, starts, starts + self.window), self.hash(1, starts, starts + self.window)

    def kept(self, repeated: np.ndarray) -> tuple[str, int, list[tuple[int, int]]]:
        """The words outside repeated windows, how many are inside, and the maximal repeats as word ranges."""
        n = len(self.words)
        edge = np.zeros(n + 1, np.int64)
        starts = np.flatnonzero(repeated)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + self.window, -1)
        gone = np.cumsum(edge[:n]) > 0
        if not gone.any():
            return b" ".join(self.words).decode(), 0, []
        turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        left = b" ".join([self.words[i] for i in np.flatnonzero(~gone)]).decode()
        return left, int(gone.sum()), [(int(a), int(b)) for a, b in turns.reshape(-1, 2)]


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64))


def _seed_rows(window: int):
    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                runs = Runs((text.as_py() or "").encode(), window)
                if runs.windows:
                    m = len(runs.lo)
                    parts.append((runs.seed, runs.spans(), np.full(m, k1), np.full(m, k2), runs.lo))
            if not parts:
                continue
            seed, span, k1, k2, lo = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((span, seed))
            seed, span = seed[order], span[order]
            new_seed = np.concatenate([[True], seed[1:] != seed[:-1]])
            first = np.flatnonzero(new_seed | np.concatenate([[True], span[1:] != span[:-1]]))
            times = np.diff(np.concatenate([first, [len(seed)]]))
            group = np.cumsum(new_seed[first]) - 1
            wide = np.bincount(group)[group] > CONTEXTS
            pick = order[first]
            deal = np.where(wide, _mix(seed[first] + span[first]), seed[first])
            rows = [deal, seed[first], span[first], times, wide, k1[pick], k2[pick], lo[pick]]
            mark = first[wide & new_seed[first]]  # tells rows of other batches that the seed is shared
            if len(mark):
                zero = np.zeros(len(mark), np.int64)
                extra = [seed[mark], seed[mark], ~span[mark], zero, zero == 0, zero, zero, zero]
                rows = [np.concatenate([a, b.astype(a.dtype)]) for a, b in zip(rows, extra, strict=True)]
            arrays = [pa.array(c) if c.dtype == bool else _signed(c) for c in rows]
            yield pa.RecordBatch.from_arrays(arrays, ["deal", "seed", "span", "times", "shared", "k1", "k2", "lo"])

    return seeds


def _open_windows(window: int):
    """Windows of the runs that are open or sent for others."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            parts = []
            for k1, k2, z, told in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                runs, told = Runs(unpack(z), window), np.array(told)
                sent = np.isin(runs.lo, told[told % 4 != UNIQUE] // 4)
                starts = np.flatnonzero(np.repeat(sent, runs.hi - runs.lo + 1))
                parts.append((*runs.window_hashes(starts), np.full(len(starts), k1), np.full(len(starts), k2), starts))
            if parts:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(c)) for c in zip(*parts, strict=True)], ["w1", "w2", "k1", "k2", "start"])

    return windows


def _without_repeats(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            ids, z, told, single = (batch.column(k) for k in range(4))
            out = ([], [], [], [])
            for packed, t, s in zip(z, told, single, strict=True):
                runs = Runs(unpack(packed.as_py()), window)
                t, s = np.array(t.as_py() or [], np.int64), np.array(s.as_py() or [], np.int64)
                kind = np.full(len(runs.lo), SAMPLE)
                for k in (UNIQUE, OPEN):
                    kind[np.isin(runs.lo, t[t % 4 == k] // 4)] = k
                of_window = np.repeat(kind, runs.hi - runs.lo + 1)
                repeated = of_window != UNIQUE
                repeated[s[of_window[s] == OPEN]] = False
                text, removed, spans = runs.kept(repeated)
                for column, value in zip(out, (len(runs.words), removed, text, [{"start": a, "end": b} for a, b in spans]), strict=True):
                    column.append(value)
            spans = pa.array(out[3], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([ids, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), spans], ["id", "n_words", "n_removed", "kept", "removed"])

    return cut


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        z = [pack((t.as_py() or "").encode()) for t in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(z, pa.binary())], ["k1", "k2", "id", "z"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_removed, kept, removed) of every row.

    A word goes if a window of ``window`` words that covers it also starts anywhere else, in
    the same document or another; windows are judged on the input. ``kept`` is the other
    words joined by single spaces, ``removed`` the maximal repeats as [start, end) word
    ranges. Null texts have no words. Texts of fewer than ``window`` words lose none. Rows
    repeated as a whole are documents of their own, so each is the other's copy. Null
    ids stay null; an empty table gives an empty result; other columns are ignored.
    """
    base = keyed(docs, id_col, text_col)
    seeds = base.mapInArrow(_seed_rows(window), "deal long, seed long, span long, times long, shared boolean, k1 long, k2 long, lo long")
    spans = (
        seeds.repartition("deal")
        .groupBy("deal", "seed", "span")
        .agg(F.sum("times").alias("times"), F.max("shared").alias("shared"), *[F.first(c).alias(c) for c in ("k1", "k2", "lo")])
    )
    of_seed = Window.partitionBy("deal", "seed")
    shared = (F.count(F.lit(1)).over(of_seed) > 1) | F.max("shared").over(of_seed)
    kind = F.when(~F.col("differ"), F.when(F.col("times") == 1, F.lit(UNIQUE))).otherwise(F.when(F.col("times") == 1, F.lit(OPEN)).otherwise(F.lit(SAMPLE)))
    told = spans.withColumn("differ", shared).filter("times > 0").withColumn("kind", kind).filter("kind is not null")
    told = told.groupBy("k1", "k2").agg(F.collect_list(F.col("lo") * 4 + F.col("kind")).alias("told"))
    told = staged(told, "told")
    zipped = base.mapInArrow(_zipped, "k1 long, k2 long, id long, z binary")
    some_open = told.filter(F.exists("told", lambda t: t % 4 != UNIQUE))
    unsettled = zipped.drop("id").join(some_open, ["k1", "k2"])
    opened = unsettled.mapInArrow(_open_windows(window), "w1 long, w2 long, k1 long, k2 long, start long")
    single = opened.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("k1", "k2", "start")]).filter("n = 1")
    single = staged(single.groupBy("k1", "k2").agg(F.collect_list("start").alias("single")), "single")
    joined = zipped.join(told, ["k1", "k2"], "left").join(single, ["k1", "k2"], "left")
    cut = joined.select("id", "z", "told", "single").mapInArrow(_without_repeats(window), "id long, n_words long, n_removed long, kept string, removed array<struct<start long, end long>>")
    return cut.withColumnRenamed("id", id_col)
