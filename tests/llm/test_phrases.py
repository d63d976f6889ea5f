import random
import re
from collections import Counter

import pytest

from gyrolake.llm import phrases as P

SCHEMA = "doc_id long, text string, lang string, phrase string, block string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    counts, totals = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            counts.update((lang, *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = {g: f for g, f in counts.items() if len(g) > 2 and f >= least}
    out = []
    for g, a in found.items():
        lang, w = g[0], g[1:]
        score, _, left, right = min((2000000 * a // (counts[lang, *w[:k]] + counts[lang, *w[k:]]), k, counts[lang, *w[:k]], counts[lang, *w[k:]]) for k in range(1, len(w)))
        inside = any(h[0] == lang and len(h) > len(g) and 100 * f >= 80 * a and any(h[i : i + len(w)] == w for i in range(1, len(h))) for h, f in found.items())
        if not inside:
            out.append((lang, " ".join(w), a, left, right, totals[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks = Counter()
    told = []
    for lang, phrase, *rest in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            told.append((lang, ranks[lang], phrase, *rest))
    return told


def texts():
    rng = random.Random(3)
    words = ["a", "B", "ab", "é", "É", "\x00", "x\x1fy", "c", "dd", " ", "the"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(words[: rng.choice((3, 11))]) + rng.choice([" ", "  ", "\t", " ", ". ", ",", "\n", "\r\n", " ; "]) for _ in range(rng.randrange(60)))
        rows.append((i, text, rng.choice(["en", "fr", None, "und", ""]), "clash", "clash"))
    rows += [(None, None, None, None, None), (7, "", "en", None, None), (8, " \n.,", "xx", None, None), (9, "a b a b a b a b a b " * 80, "en", None, None)]
    return rows + rows[:20]


@pytest.mark.parametrize("size", [1 << 20, 50])
def test_against_all_windows(spark, size):
    rows = texts()
    got = P.collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), least=4, top=25, size=size)
    found = sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0], r[1]))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert found == brute(rows, 4, 25) and len({r[0] for r in found}) >= 4


def test_overlaps_count_and_covered_phrases_go(spark):
    rows = [(1, "w w w w w w", "en", "", ""), (2, "p q r. p q r. p q. z", "en", "", "")]
    got = {r.phrase: r.a for r in P.collocations(spark.createDataFrame(rows, SCHEMA), least=2).collect()}
    assert got == {"w w w": 4, "w w w w": 3, "p q": 3, "p q r": 2}  # four of five "w w" lie in "w w w", every "q r" in "p q r"
    assert brute(rows, 2, 99) == [tuple(r) for r in P.collocations(spark.createDataFrame(rows, SCHEMA), least=2).orderBy("rank").collect()]


def test_nothing_frequent_and_no_rows(spark):
    assert P.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert P.collocations(spark.createDataFrame([(1, "one two", "en", "", "")], SCHEMA)).count() == 0


def test_blocks_are_cut_between_pieces(spark):
    long = "a b c d e f g h, " * 400 + "one piece " * 300
    blocks = P.to_blocks(spark.createDataFrame([(1, long, "en", "", "")], SCHEMA), "text", "lang", 100).collect()
    assert len(blocks) > 20 and sum(b.n_words for b in blocks) == 400 * 8 + 600
    assert all(b.numbers[-4:] == b"\0\0\0\0" for b in blocks)


def test_counted_lists_go_back_a_row_for_a_bucket_and_block(spark):
    """Not a row a list; what is not extended comes once a phrase, not once a block."""
    rows = [(block, 0, 4, [5, 6, 7], [1, 1, 2], [3, 3, 1]) for block in range(1, 7)] + [(2, 1, 9, [8], [8], [30])]
    dealt = spark.createDataFrame(rows, "block long, bucket int, number int, w1 array<long>, w2 array<long>, n array<int>").repartition(3)
    got = sorted((r.block, r.number, r.w1, r.w2, r.shares, r.f) for r in P.counted(dealt, ["w1", "w2"], 10).collect())
    assert got == sorted([(block, [4, 5], [5, 6], [1, 1], [1, 1], [18, 18] if block == 1 else []) for block in range(1, 7)] + [(2, [9], [8], [8], [1], [30])])
    last = sorted((r.w1, r.w2, r.f) for r in P.counted(dealt, ["w1", "w2"], 10, again=False).collect())
    assert last == [([5, 6], [1, 1], [18, 18]), ([8], [8], [30])]
