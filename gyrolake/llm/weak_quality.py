"""Operator 4, quality classifier: a weak-label model and a hashed linear scorer.

Heuristic labellers vote good (1), bad (-1) or nothing (0) on every document. Only the
counts of vote patterns over all documents reach the driver, at most 3 to the number of
labellers rows; expectation-maximisation there estimates how each labeller votes on good
and on bad documents, and from that the posterior of each pattern. The posteriors label
a bounded training sample of documents, on which a logistic scorer over hashed words and
word shapes is trained by full-batch gradients that the tasks sum up. It scores every
document.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolake.llm.text import keyed
from gyrolake.plans.staging import staged

TRAIN_ROWS = 20_000  # documents in the training sample, about: those whose hash is below the share of them
TRAIN_TASKS = 16  # each sends one gradient a round to the driver, of 256 KB
BUCKETS = 1 << 15
ROUNDS = 30
EM_ROUNDS = 60
WORD_CACHE = 1_000_000
LABELLERS = ("length", "symbols", "capitals", "lines", "variety", "function_words", "sentences")
STOP = frozenset("the of and to in is that it for as with was on be by le la les de des et un une que qui dans en du au el los las y que su con por para der die das und in den von zu mit ist ein eine für".encode().split())
NO_WORDS = "-1,0,0,0,0,0,0"
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
#: For the ends of sentences: all marks as a point, all white space as a blank.
ENDS = bytes.maketrans(b"!?\t\n\r\x0b\x0c", b"..     ")
#: A byte's class: small letters and bytes beyond ASCII, capitals, digits; others as they are.
CLASSES = bytes(97 if 97 <= c < 123 or c >= 128 else 65 if 65 <= c < 91 else 57 if 48 <= c < 58 else c for c in range(256))
RUN = re.compile(rb"(.)\1+")


def votes(text: str | None) -> list[int]:
    """The labellers' votes, in the order of LABELLERS; a text without words gets a bad vote for its length alone."""
    b = (text or "").encode()
    w = b.split()
    n = len(w)
    if not n:
        return [-1] + [0] * (len(LABELLERS) - 1)
    chars = sum(map(len, w))
    lines = [x for x in b.split(b"\n") if x.strip()]
    rate = lambda x, good, bad: 1 if x <= good else -1 if x >= bad else 0
    few = n < 50
    stop = sum(map(STOP.__contains__, b.lower().split())) / n
    count = lambda chars: len(b) - len(b.translate(None, chars))
    return [
        -1 if n < 20 else 1 if n >= 60 else 0,
        rate(count(SYMBOLS) / n, 0.02, 0.2),
        rate(count(CAPITALS) / chars, 0.06, 0.3),
        rate(1 - len(set(lines)) / len(lines), 0.0, 0.3) if len(lines) > 3 else 0,
        0 if few else rate(1 - len(set(w)) / n, 0.6, 0.8),
        0 if few else rate(-stop, -0.1, -0.02),
        0 if few else rate(n / (1 + b.translate(ENDS).count(b". ")), 30, 80),
    ]


def posteriors(patterns: dict[str, int]) -> tuple[dict[str, float], list[tuple[float, float]]]:
    """P(good) of each vote pattern, and each labeller's (accuracy on good, on bad) among its votes, by EM."""
    if not patterns:
        return {}, []
    keys = sorted(patterns)
    v = np.array([[int(x) + 1 for x in k.split(",")] for k in keys])
    n = np.array([patterns[k] for k in keys], float)
    balance = (v - 1).sum(axis=1) / np.maximum(1, (v != 1).sum(axis=1))
    good = 1 / (1 + np.exp(-4 * balance))  # starts from the votes' balance
    for _ in range(EM_ROUNDS):
        prior = (1 + (n * good).sum()) / (2 + n.sum())
        tables = np.empty((2, v.shape[1], 3))
        for y, share in enumerate((1 - good, good)):
            for value in range(3):
                tables[y, :, value] = 1 + ((n * share)[:, None] * (v == value)).sum(axis=0)
        tables /= tables.sum(axis=2, keepdims=True)
        like = np.log(tables)[:, np.arange(v.shape[1]), v].sum(axis=2)
        good = 1 / (1 + np.exp(np.clip(like[0] - like[1] + np.log1p(-prior) - np.log(prior), -50, 50)))
    voted = tables[:, :, 0] + tables[:, :, 2]
    accuracy = [(float(tables[1, j, 2] / voted[1, j]), float(tables[0, j, 0] / voted[0, j])) for j in range(v.shape[1])]
    return dict(zip(keys, good.tolist(), strict=True)), accuracy


def shape(word: bytes) -> bytes:
    """A word's classes of characters, runs made one: ``Don't,`` is ``Aa'a,``."""
    kind = word.translate(CLASSES)
    for one in (b"a", b"9"):
        while one + one in kind:
            kind = kind.replace(one + one, one)
    return RUN.sub(rb"\1\1", kind)[:12]


def buckets(word: bytes) -> tuple[int, int]:
    return xxhash.xxh32_intdigest(word.lower(), 1) % BUCKETS, xxhash.xxh32_intdigest(shape(word), 2) % BUCKETS


class _Cached(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = self.make(word)
        return value


@lru_cache(maxsize=1)
def _bucket_cache() -> _Cached:
    return _Cached(buckets)


@lru_cache(maxsize=1)
def _word_worth(model: str) -> _Cached:
    """A worker's words and their share in the score of one model."""
    return _Cached(None)


def _vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [",".join(map(str, votes(t.as_py()))) for t in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.string())], ["k1", "k2", "id", "votes"])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = _bucket_cache()
    for batch in batches:
        at, share = [], []
        for text in batch.column(0):
            w = (text.as_py() or "").encode().split()
            found = np.array([cache[x] for x in w], np.int64).reshape(-1)
            b, n = np.unique(found, return_counts=True)
            at.append(b)
            share.append(n / max(1, len(w)))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int64())), pa.array(share, pa.list_(pa.float64())), batch.column(1)], ["at", "share", "p"])


def train(sample: DataFrame) -> np.ndarray:
    """Weights of BUCKETS + 1 (the bias) from ``sample`` (k1, k2, text, p), by full-batch Adam with soft labels.

    The sample is dealt to ``TRAIN_TASKS`` tasks by its keys, so neither the gradients
    nor what the driver receives follow the partitions of the corpus.
    """
    dealt = sample.repartition(TRAIN_TASKS, "k1", "k2").sortWithinPartitions("k1", "k2")
    bags = staged(dealt.select("text", "p").mapInArrow(_bags, "at array<long>, share array<double>, p double"), "bags").coalesce(TRAIN_TASKS)
    weights, m, v = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for step in range(1, ROUNDS + 1):

        def gradients(batches: Iterator[pa.RecordBatch], w: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            total, mass = np.zeros(BUCKETS + 1), np.zeros(2)
            for batch in batches:
                offsets = batch.column(0).offsets.to_numpy()
                at, share = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()
                p = batch.column(2).to_numpy()
                doc = np.repeat(np.arange(len(p)), np.diff(offsets))
                z = np.bincount(doc, share * w[at], len(p)) + w[-1]
                error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - p
                total[:-1] += np.bincount(at, share * error[doc], BUCKETS)
                total[-1] += error.sum()
                mass += [len(p), 0]
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([int(mass[0])], pa.int64())], ["g", "n"])

        parts = bags.mapInArrow(gradients, "g binary, n long").collect()
        rows = sum(r.n for r in parts)
        if not rows:
            break
        g = sum(np.frombuffer(r.g) for r in parts) / rows + 1e-5 * weights
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        weights = weights - 0.5 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return weights


def classify(docs: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, score, good) of every row; score is the scorer's P(good), good its being at least one half.

    Null and empty texts have score 0. Repeated rows get the same score, ids may be null,
    other columns are ignored, and an empty table gives an empty result. Texts may be of
    any length. The training sample is the documents with a vote beside their length
    whose hash is below a threshold set by their number, so that about ``train_rows`` of
    them, a bound that does not follow the corpus, are taken; votes, patterns and scores
    cover all rows.
    """
    spark = docs.sparkSession
    base = keyed(docs, id_col, text_col)
    voted = staged(base.mapInArrow(_vote_rows, "k1 long, k2 long, id long, votes string"), "votes")
    patterns = {r.votes: r.n for r in voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    good, _ = posteriors(patterns)
    table = spark.createDataFrame([(k, float(p)) for k, p in good.items()], "votes string, p double")
    usable = sum(n for k, n in patterns.items() if k != NO_WORDS)
    share = min(1.0, train_rows / max(1, usable))
    drawn = F.pmod(F.xxhash64("k2", "k1"), F.lit(1 << 40)) < int(share * (1 << 40))
    chosen = voted.filter((F.col("votes") != NO_WORDS) & drawn).join(F.broadcast(table), "votes").select("k1", "k2", "p").dropDuplicates(["k1", "k2"])
    chosen = staged(chosen, "chosen")  # about train_rows rows of 24 bytes
    weights = train(base.join(F.broadcast(chosen), ["k1", "k2"]).dropDuplicates(["k1", "k2"]))
    shared, model = spark.sparkContext.broadcast(weights.tolist()), uuid.uuid4().hex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        worth = _word_worth(model)
        worth.make = lambda x: sum(w[b] for b in buckets(x))
        for batch in batches:
            n_words, scores = [], []
            for text in batch.column(1):
                words = (text.as_py() or "").encode().split()
                n_words.append(len(words))
                z = sum(map(worth.__getitem__, words)) / len(words) + w[-1] if words else -np.inf
                scores.append(round(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), 9) if words else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(scores, pa.float64())], ["id", "n_words", "score"])

    scored = base.select("id", "text").mapInArrow(score, "id long, n_words long, score double")
    return scored.withColumn("good", F.col("score") >= 0.5).withColumnRenamed("id", id_col)
