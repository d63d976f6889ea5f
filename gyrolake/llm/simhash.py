"""Operator 6, SimHash near-dedup with BK-trees.

1. Each task computes 64-bit SimHash fingerprints of its texts; equal fingerprints
   become one row at once.
2. Fingerprints within ``radius`` bits agree on ``blocks - radius`` whole blocks of the 64
   bits, so each is sent to the shards of all its block combinations: no link is lost.
   There are ``radius + 1`` blocks, of which one must agree, and more only where a shard
   of so many fingerprints would grow too large for a tree.
3. A shard's BK-tree (children keyed by integer Hamming distance to the parent) is
   searched by the shard's own fingerprints along edges within the radius. Each
   fingerprint keeps one link, to the least label it can reach in its shard, which
   holds the shard's components together without listing pairs; a subtree that holds no
   lesser label is not entered.
4. Links are merged into connected components.

The trees reach the tasks with the shuffle rather than by broadcast: all trees together
grow with the corpus, a shard's tree does not. A shard of more than ``SHARD`` fingerprints
is cut into parts that share a few of its fingerprints; what the parts join is settled
first, and only the fingerprints outside the shard's main component meet all parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolake.llm.text import keyed, salted_join
from gyrolake.operators.components import connected_components
from gyrolake.plans.staging import staged

SEED = 42
SHARD = 4096  # fingerprints of a tree
LEAF = 1  # fingerprints that a tree node keeps without splitting: its pivot alone
EXPECTED = 1024  # fingerprints of a shard, were they spread evenly, up to which no more blocks are made
SHARED = 64  # of a large shard's fingerprints that all its parts get, about


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every ``shingle``-word shingle, repeats included; of the whole where it has fewer words; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), "<u8", n)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes, as a signed long; 0 without hashes."""
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for part in range(0, n, 65536):
        ones += np.unpackbits(hashes[part : part + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash over ``shingle``-word shingles, repeats included, as a signed long; 0 without words."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, id, fp) of every row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fps, pa.int64())], ["k1", "k2", "id", "fp"])

    return keyed(docs, id_col, text_col).mapInArrow(compute, "k1 long, k2 long, id long, fp long")


class BKTree:
    """A BK-tree over distinct fingerprints (uint64): a node's pivot, and its children by distance to it.

    ``visits`` counts the groups of queries that reached a node.
    """

    def __init__(self, fps: np.ndarray, members: np.ndarray | None = None):
        members = np.arange(len(fps)) if members is None else members
        self.fps, self.members, self.children, self.visits = fps, members, {}, 0
        if len(members) > LEAF:
            self.pivot = fps[members[0]]
            distance = np.bitwise_count(fps[members] ^ self.pivot)
            order = np.argsort(distance, kind="stable")
            cuts = np.flatnonzero(np.diff(distance[order])) + 1
            if len(cuts):
                self.children = {int(distance[part[0]]): BKTree(fps, members[part]) for part in np.split(order, cuts)}

    def lower_labels(self, labels: np.ndarray, radius: int, queries: np.ndarray | None = None) -> None:
        """Give each query the least label among the fingerprints within the radius, in place."""
        queries = np.arange(len(self.fps)) if queries is None else queries
        queries = queries[labels[queries] > labels[self.members].min()]
        if not len(queries):
            return
        self.visits += 1
        if self.children:
            distance = np.bitwise_count(self.fps[queries] ^ self.pivot).astype(np.int16)
            for edge, child in self.children.items():
                near = queries[np.abs(distance - edge) <= radius]
                if len(near):
                    child.lower_labels(labels, radius, near)
            return
        for part in range(0, len(queries), 1024):
            asked = queries[part : part + 1024]
            for m in range(0, len(self.members), 1024):
                held = self.members[m : m + 1024]
                near = np.bitwise_count(self.fps[asked, None] ^ self.fps[None, held]) <= radius
                best = np.where(near, labels[None, held], len(self.fps)).min(axis=1)
                labels[asked] = np.minimum(labels[asked], best)


def shard_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """One link from each fingerprint of a shard that is not the first of its component there."""
    labels = np.arange(len(fps))
    if len(fps) > 1:
        tree = BKTree(fps)
        while True:
            before = labels.copy()
            tree.lower_labels(labels, radius)
            labels = labels[labels]
            if (labels == before).all():
                break
    moved = np.flatnonzero(labels != np.arange(len(fps)))
    return fps[moved], fps[labels[moved]]


def _links_of_sorted(radius: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at = None

        def flush(shards: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero((np.diff(shards, axis=0) != 0).any(axis=1)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fps)]])
            pairs = starts[ends - starts == 2]
            close = pairs[np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= radius]
            a, b = [fps[close]], [fps[close + 1]]
            for s, e in zip(starts, ends, strict=True):
                if e - s > 2:
                    x, y = shard_links(fps[s:e], radius)
                    a.append(x)
                    b.append(y)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], ["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            if not len(rows):
                continue
            held.append(rows)
            if at is not None and (rows[-1, :3] == at).all():
                continue  # the shard goes on in the next batch
            at = rows[-1, :3]
            rows = np.concatenate(held)
            last = (rows[:, :3] == at).all(axis=1)
            held = [rows[last]]
            if not last.all():
                yield flush(rows[~last, :3], np.ascontiguousarray(rows[~last, 3]).view(np.uint64))
        if held:
            rows = np.concatenate(held)
            yield flush(rows[:, :3], np.ascontiguousarray(rows[:, 3]).view(np.uint64))

    return links


def blocks_for(n: int, radius: int) -> int:
    """The least number of blocks for which a shard holds few enough of ``n`` spread fingerprints."""
    blocks = radius + 1
    while blocks < 16 and n > EXPECTED << (64 // blocks) * (blocks - radius):
        blocks += 1
    return blocks


def _meetings(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b) links among the rows (combination, kept, meeting, fp) of each meeting."""
    dealt = rows.repartition("combination", "kept", "meeting").sortWithinPartitions("combination", "kept", "meeting", "fp")
    return dealt.select("combination", "kept", "meeting", "fp").mapInArrow(_links_of_sorted(radius), "a long, b long")


def fingerprint_links(fps: DataFrame, radius: int) -> DataFrame:
    """(a, b) links of distinct fingerprints ``fps`` (fp) whose components are those of all pairs within ``radius``.

    A table of the large shards, at most one for every ``SHARD`` rows, is joined to the rows.
    """
    blocks = blocks_for(fps.count(), radius)
    bounds = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum(((1 << bounds[b + 1]) - (1 << bounds[b])) for b in kept) for kept in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    shard = F.explode(F.transform(F.array(*map(F.lit, signed)), lambda m, i: F.struct(i.alias("combination"), m.bitwiseAND(F.col("fp")).alias("kept"))))
    sharded = fps.select("fp", shard.alias("s")).select(F.col("s.combination").cast("long").alias("combination"), "s.kept", "fp")
    sizes = sharded.groupBy("combination", "kept").agg(F.count(F.lit(1)).alias("n"))
    large = staged(sizes.filter(F.col("n") > SHARD).withColumn("parts", F.ceil(F.col("n") / SHARD)), "large_shards")
    if large.isEmpty():
        return _meetings(sharded.withColumn("meeting", F.lit(0).cast("long")), radius)
    sharded = sharded.join(large, ["combination", "kept"], "left")
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    own = F.array(F.pmod(F.xxhash64("fp"), F.col("parts")))
    shared = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("n")) < SHARED
    first = staged(_meetings(sharded.withColumn("meeting", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).when(shared, every).otherwise(own))), radius), "first_links")
    # what the parts have not joined: fingerprints outside the main component of a large shard meet all its parts
    named = connected_components(first)
    rows = sharded.filter("parts is not null").join(named, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node")
    rows = staged(rows, "rows_of_large_shards")
    counts = rows.groupBy("combination", "kept", "root").agg(F.count(F.lit(1)).alias("k"))
    main = staged(counts.groupBy("combination", "kept").agg(F.max(F.struct("k", "root")).alias("m"), F.count(F.lit(1)).alias("roots")), "main_components").filter("roots > 1")
    open_ = rows.join(F.broadcast(main) if large.count() <= 100_000 else main, ["combination", "kept"])
    second = _meetings(open_.withColumn("meeting", F.explode(F.when(F.col("root") == F.col("m.root"), own).otherwise(every))), radius)
    return first.unionByName(second)


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, id, fp, component) of every row; component is the least id of all rows linked to it, directly or not.

    Rows link where their fingerprints differ in at most ``radius`` bits. Rows without
    words, nulls included, have fingerprint 0. A null id never names a component; a
    component of nothing else has a null one. Equal rows share a result. An empty table
    gives an empty result; other columns are ignored. See text.keyed for k1 and k2.
    Most rows may share a fingerprint, and most fingerprints a component: both joins are salted.
    """
    fps = staged(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = staged(fps.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = connected_components(fingerprint_links(distinct.select("fp"), radius))
    rooted = staged(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", "root"), "rooted")
    linked = rooted.filter("root is not null")
    named = linked.groupBy("root").agg(F.min("least").alias("component"))
    joined = salted_join(linked, named, ["root"], ["fp"]).select("fp", "component")
    of_fp = staged(joined.unionByName(rooted.filter("root is null").select("fp", F.col("least").alias("component"))), "components")
    return salted_join(fps, of_fp, ["fp"], ["k1", "k2"]).select("k1", "k2", "id", "fp", "component")
