"""Near copies of whole documents: operator 6 proposes, exact similarity of shingle sets decides.

1. A document is its set of word shingles. Documents of equal sets are one, whatever
   their number: the first stays.
2. Pairs are proposed by SimHash fingerprints within ``radius`` bits, linked through
   BK-trees (see gyrolake.llm.simhash), and, as a fingerprint of 64 bits that differs in
   few bits misses most pairs near the threshold, by ``BANDS`` values made of ``BAND_ROWS``
   minima of the set each. Documents that share a value form a bucket.
3. In a bucket, in order of id, a document is proposed to the earlier documents whose minima
   agree enough: in the first round to the first of them, later to the first 16, 256.. of
   those that stay so far, by estimates from ``LONG`` more minima. Pairs that were tested are
   not tested again.
4. A proposed pair is a link if the exact similarity is at least ``similar``. After every
   round, over all links found so far, a document goes if it is linked to an earlier one that
   stays. Rounds end when those that stay have nothing left to be tested against, so a
   document that was told apart from its first proposals meets all others of its buckets;
   that is so when no document has more to propose and none that had gone is back.

A bucket may hold most documents. In the first round a large one is cut into parts, each of
which also gets the bucket's first document; groups of copies shrink to a few there. In later
rounds what stays of a bucket of several parts meets part by part, every two of them in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyrolake.llm.simhash import fingerprint_links, majority, shingle_hashes
from gyrolake.llm.text import keyed, packed, salted_join
from gyrolake.operators.components import connected_components
from gyrolake.plans.staging import staged

BANDS, BAND_ROWS = 10, 5
PART = 4096  # documents of a bucket's part
LONG = 200  # more minima, for later rounds
ERRORS = 3.2  # standard errors below the threshold from which an estimate leads to an exact comparison
SIMILAR = 0.8
ROUNDS = 5  # of settling links, before components are settled each in a task
LOCAL = 200_000  # links of such a component
GROWTH = 16  # of the number of proposals a document, from round to round
PRINTS = "k1 long, k2 long, id long, fp long, s1 long, s2 long, bands array<long>, sketch binary, long_sketch binary"


@lru_cache(maxsize=1)
def _multipliers() -> np.ndarray:
    """Odd multipliers, by which one hash of a shingle gives as many orders of the shingles."""
    return np.random.default_rng(17).integers(0, 1 << 63, BANDS * BAND_ROWS + LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_like(similar: float, minima_count: int) -> float:
    """The share of equal minima from which a pair is compared exactly."""
    return similar - ERRORS * (similar * (1 - similar) / minima_count) ** 0.5


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least shingle under each of the orders."""
    least = np.full(len(_multipliers()), np.iinfo(np.uint64).max, np.uint64)
    for part in range(0, len(hashes), 512):
        least = np.minimum(least, (hashes[part : part + 512, None] * _multipliers()[None, :]).min(axis=0))
    return least


def _prints(shingle: int):
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sets, bands, sketches, longer = [], [], [], [], []
            for text in batch.column(3):
                hashes = shingle_hashes(text.as_py(), shingle)
                fps.append(majority(hashes))
                hashes = np.unique(hashes)
                sets.append([xxhash.xxh64_intdigest(hashes.tobytes(), seed) - (1 << 63) for seed in (1, 2)])
                least = minima(hashes) if len(hashes) else np.zeros(0, np.uint64)
                bands.append([xxhash.xxh64_intdigest(least[k : k + BAND_ROWS].tobytes(), k) - (1 << 63) for k in range(0, min(len(least), BANDS * BAND_ROWS), BAND_ROWS)])
                low = (least >> np.uint64(40)).astype(np.uint8).tobytes()
                sketches.append(low[: BANDS * BAND_ROWS])
                longer.append(low[BANDS * BAND_ROWS :])
            columns = [pa.array(fps, pa.int64()), *(pa.array([s[k] for s in sets], pa.int64()) for k in (0, 1)), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(longer, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["k1", "k2", "id", "fp", "s1", "s2", "bands", "sketch", "long_sketch"])

    return compute


def order() -> Column:
    """The order in which documents are taken: of id, null ids last, then of key."""
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "k2", "k1")


def _proposed(like_enough: float, most: int):
    """From rows sorted by (bucket, meeting, order) to (a1, a2, b1, b2): a is proposed to the first ``most`` before it that are like it; a = b if there are more."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, keys, held = None, 0, np.zeros((0, 2), np.int64), np.zeros((0, 0), np.uint8)
        for batch in batches:
            out = []
            for bucket, meeting, k1, k2, sketch in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                own = np.frombuffer(sketch, np.uint8)
                if (bucket, meeting) != at:
                    at, n, keys, held = (bucket, meeting), 0, np.zeros((64, 2), np.int64), np.zeros((64, len(own)), np.uint8)
                if n:
                    like = np.flatnonzero((held[:n] == own).mean(axis=1) >= like_enough)
                    out += [(k1, k2, *keys[b]) for b in like[:most] if (keys[b] != (k1, k2)).any()]
                    if len(like) > most:
                        out.append((k1, k2, k1, k2))
                if n == len(held):
                    held, keys = np.concatenate([held, np.zeros_like(held)]), np.concatenate([keys, np.zeros_like(keys)])
                held[n], keys[n] = own, (k1, k2)
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([int(r[k]) for r in out], pa.int64()) for k in range(4)], ["a1", "a2", "b1", "b2"])

    return found


def bucket_pairs(dealt: DataFrame, prints: DataFrame, like_enough: float, most: int, first_round: bool) -> DataFrame:
    """(a1, a2, b1, b2) proposed in the buckets ``dealt`` (bucket, k1, k2) of ``prints``: a to earlier b; rows a = b tell that more is to be tested."""
    sketch = F.col("sketch" if first_round else "long_sketch").alias("sketch")
    full = staged(dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("parts", F.ceil(F.col("n") / PART)), "buckets")
    own = salted_join(dealt, full, ["bucket"], ["k1", "k2"]).join(prints.select("k1", "k2", "id", sketch), ["k1", "k2"])
    own = own.withColumn("part", F.pmod(F.xxhash64("k1", "k2"), F.col("parts")))
    columns = ["bucket", "meeting", "k1", "k2", "sketch", "id"]
    if first_round:
        own = staged(own, "in_buckets")
        firsts = own.filter("parts > 1").groupBy("bucket", "parts").agg(F.min(F.struct(order().alias("o"), "sketch")).alias("first"))
        firsts = firsts.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("meeting"), "first.o.id", "first.o.k1", "first.o.k2", "first.sketch")
        rows = own.withColumnRenamed("part", "meeting").select(*columns).unionByName(firsts.select(*columns))
    else:  # part i meets every part j, in the meeting of both
        other = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
        meeting = F.explode(F.transform(other, lambda j: F.least(j, F.col("part")) * F.col("parts") + F.greatest(j, F.col("part")))).alias("meeting")
        rows = own.select("bucket", meeting, "k1", "k2", "sketch", "id")
    sorted_ = rows.repartition("bucket", "meeting").sortWithinPartitions("bucket", "meeting", F.col("id").isNull(), "id", "k2", "k1")
    pairs = sorted_.drop("id").mapInArrow(_proposed(like_enough, most), "a1 long, a2 long, b1 long, b2 long")
    if first_round:  # parts of one bucket have not met
        cut = own.filter("parts > 1").select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("k1").alias("b1"), F.col("k2").alias("b2"))
        pairs = pairs.unionByName(cut.limit(1))
    return pairs


def fingerprint_pairs(prints: DataFrame, radius: int) -> DataFrame:
    """(a1, a2, b1, b2) proposed by fingerprints: each document to the first of its fingerprint, those along the trees' links."""
    firsts = staged(prints.groupBy("fp").agg(F.min(order()).alias("o")), "first_of_fingerprint")
    links = staged(fingerprint_links(firsts.select("fp"), radius), "fingerprint_links")
    a, b = firsts.select(F.col("fp").alias("a"), F.col("o").alias("x")), firsts.select(F.col("fp").alias("b"), F.col("o").alias("y"))
    along = salted_join(salted_join(links, a, ["a"], ["b"]).select("b", "x"), b, ["b"], ["x"]).select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    same = salted_join(prints.select("fp", order().alias("x")), firsts.select("fp", F.col("o").alias("y")), ["fp"], ["x"]).select("x", "y").filter("x <> y")
    return along.unionByName(same).select(F.col("x.k1").alias("a1"), F.col("x.k2").alias("a2"), F.col("y.k1").alias("b1"), F.col("y.k2").alias("b2"))


def similarity(a: Column, b: Column) -> Column:
    """The exact similarity of two shingle sets; 1 where both are empty."""
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(common, F.size(a) + F.size(b) - common), F.lit(1.0))


def exact_links(pairs: DataFrame, base: DataFrame, shingle: int, similar: float) -> DataFrame:
    """The pairs whose shingle sets are alike. Only texts in pairs are read again."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sets, pa.list_(pa.int64()))], ["k1", "k2", "shingles"])

    needed = staged(pairs.select(F.col("a1").alias("k1"), F.col("a2").alias("k2")).union(pairs.select("b1", "b2")).distinct(), "needed")
    texts = base.join(needed, ["k1", "k2"], "left_semi").select("k1", "k2", "text").dropDuplicates(["k1", "k2"])
    sets = staged(texts.mapInArrow(compute, "k1 long, k2 long, shingles array<long>"), "shingle_sets")
    first = pairs.join(sets.toDF("a1", "a2", "of_a"), ["a1", "a2"])
    both = salted_join(staged(first, "first_sets"), sets.toDF("b1", "b2", "of_b"), ["b1", "b2"], ["a1", "a2"])
    return both.filter(similarity(F.col("of_a"), F.col("of_b")) >= similar).select("a1", "a2", "b1", "b2")


def _settled(rows: pa.Table) -> pa.Table:
    """(k1, k2) of the documents of one component that go, from its links (a1, a2, b1, b2) to earlier documents."""
    a, b = (list(zip(rows[f"{x}1"].to_pylist(), rows[f"{x}2"].to_pylist(), strict=True)) for x in "ab")
    later, waits = {}, {}
    for x, y in zip(a, b, strict=True):
        later.setdefault(y, []).append(x)
        waits[x] = waits.get(x, 0) + 1
    gone, open_ = set(), [y for y in later if y not in waits]
    while open_:
        stays = open_.pop()
        for x in later.get(stays, ()):
            if x not in gone:
                gone.add(x)
                for y in later.get(x, ()):
                    waits[y] -= 1
                    if not waits[y] and y not in gone:
                        open_.append(y)
    keys = sorted(gone)
    return pa.table({"k1": pa.array([k for k, _ in keys], pa.int64()), "k2": pa.array([k for _, k in keys], pa.int64())})


def gone_of(links: DataFrame) -> DataFrame:
    """(k1, k2) of the documents that go: those linked to an earlier one that stays.

    A round settles the documents whose earlier ends are all settled. After ``ROUNDS`` of them
    what is left, such as long chains of versions, is settled component by component, each in
    a task; components of more than ``LOCAL`` links go on in rounds.
    """
    gone, left = [], links
    ends = lambda df, side: df.select(F.col(f"{side}1").alias("k1"), F.col(f"{side}2").alias("k2"))
    for done in count():
        if left.isEmpty():
            break
        if done % ROUNDS == ROUNDS - 1:
            node = lambda side: F.xxhash64(f"{side}1", f"{side}2")  # noqa: E731  equal hashes would only join two components
            roots = connected_components(left.select(node("a").alias("a"), node("b").alias("b")))
            named = staged(left.withColumn("node", node("a")).join(roots, "node").drop("node"), "named_links")
            sizes = named.groupBy("root").agg((F.count(F.lit(1)) <= LOCAL).alias("local"))
            named = staged(named.join(sizes, "root"), "sized_links")
            gone.append(staged(named.filter("local").groupBy("root").applyInArrow(lambda rows: _settled(rows), "k1 long, k2 long"), "gone"))
            left = named.filter("not local").select("a1", "a2", "b1", "b2")
            continue
        stay = ends(left, "b").distinct().join(ends(left, "a"), ["k1", "k2"], "left_anti").toDF("b1", "b2")
        gone.append(staged(ends(left.join(stay, ["b1", "b2"], "left_semi"), "a").distinct(), "gone"))
        left = left.join(gone[-1].toDF("a1", "a2"), ["a1", "a2"], "left_anti").join(gone[-1].toDF("b1", "b2"), ["b1", "b2"], "left_anti")
        left = staged(left, "open_links")
    out = ends(links, "a").filter("false")
    for part in gone:
        out = out.unionByName(part)
    return out


def near_copy_keys(docs: DataFrame, shingle: int, radius: int, similar: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Two tables (k1, k2): the first documents of all shingle sets, and those of them that go."""
    base = keyed(docs, id_col, text_col)
    prints = staged(base.mapInArrow(_prints(shingle), PRINTS), "prints")
    firsts = prints.groupBy("s1", "s2").agg(F.min(order()).alias("o")).select("o.k1", "o.k2")
    prints = staged(prints.join(firsts, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).drop("s1", "s2"), "distinct_sets")
    dealt = staged(prints.select("k1", "k2", F.explode("bands").alias("bucket")), "bands")
    keys = ["a1", "a2", "b1", "b2"]
    proposed = fingerprint_pairs(prints, radius)
    tested = links = proposed.filter("false")
    gone = prints.select("k1", "k2").filter("false")
    for k in count():
        live = dealt.join(gone, ["k1", "k2"], "left_anti") if k else dealt
        like_enough = least_like(similar, LONG if k else BANDS * BAND_ROWS)
        found = staged(bucket_pairs(staged(live, "live") if k else live, prints, like_enough, GROWTH**k, not k), "pairs")
        new = found.filter("a1 <> b1 or a2 <> b2")
        new = staged((new.unionByName(proposed) if not k else new).distinct().join(tested, keys, "left_anti"), "new_pairs")
        more = not found.filter("a1 = b1 and a2 = b2").isEmpty()
        if new.isEmpty():
            if not more:
                return prints.select("k1", "k2"), gone
            continue
        tested = tested.unionByName(new)
        linked = staged(exact_links(new, base, shingle, similar), "links")
        before = gone
        if not linked.isEmpty():
            links = links.unionByName(linked)
            gone = staged(gone_of(links), "gone_now")
        if not more and before.join(gone, ["k1", "k2"], "left_anti").isEmpty():
            return prints.select("k1", "k2"), gone


def drop_near_copies(docs: DataFrame, shingle: int = 5, radius: int = 4, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near copies of earlier documents that stay, and without repeats of rows equal in id and text.

    Earlier is a lesser id (null ids last), then a lesser key. Each document that goes has
    a similarity of ``similar`` or more with one that stays. Texts of fewer words than a
    shingle are one shingle; texts without words, nulls included, are all alike. All
    columns are kept whatever their names; an empty table gives an empty result. Long texts are handled one
    at a time, whole.
    """
    firsts, gone = near_copy_keys(docs, shingle, radius, similar, id_col, text_col)
    id_, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    rows = packed(docs, F.coalesce(id_, F.lit(0)).alias("k1"), F.xxhash64(id_, text).alias("k2"))
    kept = firsts.join(gone, ["k1", "k2"], "left_anti")
    return rows.join(kept, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row.*")
