"""Frequent phrases and their collocation scores, from vertical positional inverted lists.

Texts are cut into blocks of about BLOCK_WORDS words at most of one language, at the ends of
pieces, which no phrase crosses; a hot language or a very long text is thus many blocks. In a
block a phrase is the list of the positions where it occurs. Lists of length k become lists of
length k + 1 by merge-joining them, shifted, with the postings of the words next to them; the
length of a list is the phrase's exact frequency in the block, and the sum over blocks its
frequency in the language; for that, the lists of a block travel bucket by bucket, there and back. Only phrases that reach the least frequency are extended, and only by words that
end another such phrase.

A word is told by the place (block, number) of its first posting, so keys are exact longs; no
table of words or phrases is broadcast. Blocks and levels are staged; what a task holds is one
block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyrolake.plans.staging import Stage, staged, tasks

BLOCK_WORDS = 1 << 21
NUMBERS = 1 << 24  # of words or phrases in a block; only a piece of as many different words without any end would need more
BLOCKS = 1 << 14  # of a task
BUCKETS = 16  # of lists for every shuffle partition
SHARE = 1 << 20  # occurrences of a phrase, from which what follows it is dealt to shares
LONGEST = 4  # words of a phrase
NO_LANG = "und"

# Ends of pieces become ".", ASCII capitals small letters, tabs spaces.
_TO = bytearray(range(256))
_TO[ord("A") : ord("Z") + 1] = b"abcdefghijklmnopqrstuvwxyz"
for _end in b".,;:!?\n\x0b\x0c\r":
    _TO[_end] = ord(".")
_TO[ord("\t")] = ord(" ")
_TO = bytes(_TO)


class Numbers(dict):
    """Numbers for words in order of first sight; 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def pieces(text: str | None) -> list[bytes]:
    """Words, with b"." after every piece."""
    spaced = (text or "").encode().translate(_TO).replace(b".", b" . ")
    return [w for w in spaced.split(b" ") if w] + [b"."]


def to_blocks(docs: DataFrame, text_col: str, lang_col: str, size: int = BLOCK_WORDS) -> DataFrame:
    """(block, lang, n_words, numbers, words, counts): texts as numbers of words, int32 in order, and the distinct words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, parts = 0, TaskContext.get().partitionId()
        held: dict[str, tuple[Numbers, list[np.ndarray]]] = {}
        sizes: dict[str, int] = {}

        def block(lang: str) -> pa.RecordBatch:
            nonlocal made
            words, arrays = held.pop(lang)
            del sizes[lang]
            numbers = np.concatenate(arrays)
            counts = np.bincount(numbers, minlength=len(words))
            spelt = list(words)[1:]
            made += 1
            if len(words) > NUMBERS or made >= BLOCKS:
                raise ValueError(f"a block of {len(words)} different words, or {made} blocks in a task: read the table in smaller partitions")
            row = [[parts * BLOCKS + made], [lang], [int(counts[1:].sum())], [numbers.astype("<i4").tobytes()], [[w.decode() for w in spelt]], [counts[1:].tolist()]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32())), strict=True)], ["block", "lang", "n_words", "numbers", "words", "counts"])

        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = pieces(text)
                at = 0
                while at < len(found):
                    words, arrays = held.setdefault(lang, (Numbers(), []))
                    room = size - sizes.get(lang, 0)
                    end = len(found) if len(found) - at <= room else found.index(b".", at + max(0, room - 1)) + 1
                    arrays.append(np.fromiter(map(words.__getitem__, found[at:end]), np.int32, end - at))
                    sizes[lang] = sizes.get(lang, 0) + end - at
                    at = end
                    if sizes[lang] >= size:
                        yield block(lang)
        for lang in list(held):
            yield block(lang)

    picked = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANG)).alias("lang"))
    return picked.mapInArrow(run, "block bigint, lang string, n_words bigint, numbers binary, words array<string>, counts array<int>")


def place(block: str = "block", number: str = "number") -> Column:
    return F.col(block) * NUMBERS + F.col(number)


def frequent(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """``rows`` (block, number, keys, n) of the keys that occur ``least`` times, with f, their frequency, and first, their least place."""
    same = Window.partitionBy(*keys)
    told = rows.withColumns({"f": F.sum("n").over(same), "first": F.min(place()).over(same)})
    return told.filter(F.col("f") >= least)


def counted(dealt: DataFrame, names: list[str], least: int, again: bool = True) -> DataFrame:
    """Of lists (block, bucket, number, ``names`` and n as arrays) those whose phrases occur ``least`` times, as one row for a bucket and a block.

    The lists of a bucket are counted where they meet, and go back to their blocks together: ``number``, ``names`` and ``shares`` are
    arrays of a row's lists. Lists whose place is their phrase's least come first; f has the frequencies of these alone, once a phrase.
    Without ``again``, when no list is extended any more, the others are left out.
    """

    def run(held: pa.Table) -> pa.Table:
        sizes = np.array([len(x) for x in held["n"]])
        n = flat(held["n"]).astype(np.int64)
        words = np.stack([flat(held[w]) for w in names])
        begin = np.cumsum(sizes) - sizes
        block = np.repeat(held["block"].to_numpy(), sizes)
        number = np.repeat(held["number"].to_numpy().astype(np.int64) - begin, sizes) + np.arange(len(n))
        order = np.lexsort((number, block, *words[::-1]))
        block, number, n, words = block[order], number[order], n[order], words[:, order]
        own = np.ones(len(n), bool)
        own[1:] = (words[:, 1:] != words[:, :-1]).any(axis=0)
        f = np.add.reduceat(n, np.flatnonzero(own))[np.cumsum(own) - 1]
        good = np.flatnonzero((f >= least) & (own | again))
        good = good[np.lexsort((~own[good], block[good]))]
        block, own, f = block[good], own[good], f[good]
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        ends = np.append(starts, len(good)).astype(np.int32)
        owned = np.append(0, np.cumsum(own))[ends].astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (number[good].astype(np.int32), *words[:, good], f // SHARE + 1)]
        return pa.Table.from_arrays([pa.array(block[starts]), *lists, pa.ListArray.from_arrays(pa.array(owned), pa.array(f[own]))], ["block", "number", *names, "shares", "f"])

    return dealt.groupBy("bucket").applyInArrow(run, "block bigint, number array<int>, " + ", ".join(f"{w} array<bigint>" for w in names) + ", shares array<bigint>, f array<bigint>")


def flat(column: pa.ChunkedArray) -> np.ndarray:
    """The values of a column, those of its arrays one after the other."""
    values = column.combine_chunks()
    return (values.flatten() if pa.types.is_list(values.type) else values).to_numpy()


def packed(values: np.ndarray) -> bytes:
    """int32 values byte by byte, lowest bytes first, compressed."""
    return zstandard.compress(np.ascontiguousarray(values, np.int32).view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def ints(value: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(value[0].as_py()), np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel()


def share(word: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Which of ``shares`` a following word belongs to."""
    return (word * np.int64(0x9E3779B1) >> np.int64(7)) % shares


def bucket(words: np.ndarray, part: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of phrases [k, n] and shares; all lists that begin with a phrase and have a share go to one."""
    mixed = part.astype(np.int64) * np.int64(0x85EBCA77)
    for w in words:
        mixed = (mixed ^ w) * np.int64(0x9E3779B97F4A7C1)
        mixed ^= mixed >> np.int64(29)
    return mixed % buckets


def extend(k: int, blocks: DataFrame, kept: DataFrame, buckets: int) -> DataFrame:
    """Lists of k + 1 words from lists of k words.

    ``blocks`` (block, steps, numbers) has the list number of every position that is in a list, and
    the steps from one such position to the next; for k = 1 (block, numbers) has the word at every
    position. ``kept`` (block, number, w1..wk, shares), single values or arrays, tells the lists whose phrases are frequent, and in
    how many shares their followers are counted. The result has the new lists as ``steps`` and ``numbers`` again, and bucket by bucket
    the number of the first list, the lists' words w1..w<k+1> and lengths n. A bucket has all lists
    with the same first k words; those of a very frequent phrase are dealt to shares by the following
    word, so that what must meet in a bucket has no more than about SHARE occurrences.
    """
    names = [f"w{j}" for j in range(1, k + 2)]
    schema = "block bigint, steps binary, numbers binary, bucket array<int>, number array<int>, " + ", ".join(f"{w} array<array<bigint>>" for w in names) + ", n array<array<int>>"
    columns = ["block", "steps", "numbers", "bucket", "number", *names, "n"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.list_(pa.list_(pa.int64()))] * (k + 1), pa.list_(pa.list_(pa.int32()))]

    def run(key: tuple, held: pa.Table, good: pa.Table) -> pa.Table:
        if held.num_rows == 0 or good.num_rows == 0:
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], columns)
        numbers = np.frombuffer(held["numbers"][0].as_py(), "<i4") if k == 1 else ints(held["numbers"])
        positions = np.arange(len(numbers)) if k == 1 else np.cumsum(ints(held["steps"]), dtype=np.int64)
        words, shares, listed = np.stack([flat(good[w]) for w in names[:-1]]), flat(good["shares"]), flat(good["number"])
        row = np.full(max(int(numbers.max(initial=0)), int(listed.max())) + 1, -1, np.int32)
        row[listed] = np.arange(len(listed))
        of = row[numbers]
        at, of = positions[of >= 0], of[of >= 0]
        # postings of the words that end a frequent phrase of k words, each at its own position
        post_at, post_word = at + k - 1, words[k - 1, of]
        _, left, right = np.intersect1d(at + k, post_at, assume_unique=True, return_indices=True)
        head, word, found = of[left], post_word[right], at[left]
        part = share(word, shares[head])
        dealt = bucket(words[:, head], part, buckets)
        order = np.lexsort((word, head, dealt))
        head, word, dealt = head[order], word[order], dealt[order]
        new = np.ones(len(order), bool)  # whether a list begins
        new[1:] = (head[1:] != head[:-1]) | (word[1:] != word[:-1])
        starts = np.flatnonzero(new)
        number = np.empty(len(order), np.int32)
        number[order] = np.cumsum(new) - 1
        lengths = np.diff(np.append(starts, len(order)))
        first = np.flatnonzero(np.diff(dealt[starts], prepend=-1))  # the first list of every bucket
        offsets = pa.array(np.append(first, len(starts)).astype(np.int32))

        def nested(values: np.ndarray, kind: pa.DataType) -> pa.Array:
            inner = pa.ListArray.from_arrays(offsets, pa.array(values, kind))
            return pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner)

        back = np.argsort(found)
        told = [[key[0].as_py()], [packed(np.diff(found[back], prepend=0))], [packed(number[back])], [dealt[starts[first]].astype(np.int32)], [first.astype(np.int32)]]
        lists = [nested(words[j, head[starts]], pa.int64()) for j in range(k)] + [nested(word[starts], pa.int64()), nested(lengths, pa.int32())]
        return pa.Table.from_arrays([*(pa.array(v, t) for v, t in zip(told, kinds, strict=False)), *lists], columns)

    return blocks.groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(run, schema)


def mine(docs: DataFrame, text_col: str, lang_col: str, least: int, size: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The frequent phrases of one to LONGEST words (w array<bigint>, f), the frequent words (id, lang, word), and the languages (lang, n)."""
    blocks = Stage(to_blocks(docs, text_col, lang_col, size), "blocks")
    totals = staged(blocks.rows.groupBy("lang").agg(F.sum("n_words").alias("n")), "totals")
    each = blocks.rows.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("number", "x"))
    each = each.select("block", (F.col("number") + 1).alias("number"), "lang", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    told = frequent(each, ["lang", "word"], least)
    own = F.col("first") == place()
    shares = (F.floor(F.col("f") / SHARE) + 1).alias("shares")
    kept = staged(told.select("block", "number", F.col("first").alias("w1"), shares, "f", F.when(own, F.col("lang")).alias("lang"), F.when(own, F.col("word")).alias("word")), "words")
    vocabulary = kept.filter("word is not null").select(F.col("w1").alias("id"), "lang", "word")
    found = [kept.filter("word is not null").select(F.array("w1").alias("w"), "f")]
    held, buckets = blocks, BUCKETS * tasks(docs.sparkSession)
    for k in range(1, LONGEST):
        names = [f"w{j}" for j in range(1, k + 2)]
        extended = Stage(extend(k, held.rows.select("block", "numbers", *["steps"][: k - 1]), kept.select("block", "number", *names[:-1], "shares"), buckets), f"lists_{k + 1}")
        held.drop()
        held = extended
        dealt = held.rows.select("block", F.explode(F.arrays_zip("bucket", "number", *names, "n")).alias("x")).select("block", "x.*")
        kept = staged(counted(dealt, names, least, again=k + 1 < LONGEST), f"phrases_{k + 1}")
        first = [F.slice(w, F.lit(1), F.size("f")).alias(w) for w in names]
        found.append(kept.select(*first, "f").select(F.explode(F.arrays_zip(*names, "f")).alias("x")).select(F.array(*[f"x.{w}" for w in names]).alias("w"), "x.f"))
    held.drop()
    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    return staged(every, "frequent"), vocabulary, totals


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, top: int = 2000, covered: int = 80, size: int = BLOCK_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two to LONGEST words of every language.

    a is a phrase's frequency, l and r those of its two parts at the cut of least score
    floor(2000000 a / (l + r)), ties to the earliest cut, and n the language's words. A phrase
    inside a longer frequent one that has ``covered`` percent of its occurrences or more is left
    out. Order: score and a descending, phrase ascending by bytes. Null texts are empty, null
    languages are "und"; a table without frequent phrases gives no rows; repeated rows and rows
    without ids count like all others, since no id is read.
    """
    every, vocabulary, totals = mine(docs, text_col, lang_col, least, size)
    phrases = every.filter(F.size("w") > 1)
    cut = phrases.select("w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cut = cut.withColumns({"head": F.slice("w", F.lit(1), F.col("k")), "tail": F.slice("w", F.col("k") + 1, F.size("w"))})
    cut = cut.join(every.select(F.col("w").alias("head"), F.col("f").alias("l")), "head").join(every.select(F.col("w").alias("tail"), F.col("f").alias("r")), "tail")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cut = cut.withColumns({"x": F.lit(2_000_000).cast("decimal(7,0)") * wide("a"), "y": wide("l") + wide("r")}).withColumn("score", F.expr("x div y"))
    best = cut.groupBy("w", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    long = phrases.filter(F.size("w") > 2)
    lengths = F.sequence(F.lit(2), F.size("w") - 1)
    inside = F.flatten(F.transform(lengths, lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda at: F.slice("w", at, m))))
    covers = long.select(F.explode(inside).alias("w"), "f").groupBy("w").agg(F.max("f").alias("longest"))
    left = best.join(covers, "w", "left").filter(F.col("longest").isNull() | (100 * F.col("longest").cast("decimal(19,0)") < covered * wide("a")))
    spelt = left.select("w", "a", "cut", F.posexplode("w").alias("at", "id")).join(vocabulary, "id")
    spelt = spelt.groupBy("w", "a", "cut", "lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = spelt.join(totals, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the first of every share of a language, then of the language: no task sorts a whole hot language
    share = F.pmod(F.xxhash64("phrase"), F.lit(tasks(docs.sparkSession)))
    first = rows.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
