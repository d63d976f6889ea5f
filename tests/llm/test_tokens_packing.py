import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gyrolake.llm import queries
from gyrolake.llm.packing import pack, pack_histogram, slots_of
from gyrolake.llm.token_counts import count_tokens
from gyrolake.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["<|endoftext|> hi", "Ünïcödé's they'LL 12,3 naïve", "Σας ΣΑΣ", "é ﬁ", "　x\xa0y\x1cz", "İstanbul", "汉字 テスト", "don't!!'s 'tis '", "\x85a\x0bb", "", "ÀÉ×÷ß ẞ", "²³¼ ªº µ", "a" * 3000]


def test_encoder_matches_the_library():
    own, library = Encoder(PATH), Tokenizer.from_file(PATH)
    for text in ODD:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_chunks_of_any_script_match_the_library():
    rng = np.random.default_rng(4)
    own, library = Encoder(PATH), Tokenizer.from_file(PATH)
    alphabet = [*"abcXYZ019 \t\n\r.,'\"-", *"“”’–€…", *"äßÉñ", *"ΣσςΑΩЖщ", *"汉字テ한", "\u0301", "\u0327", "\xa0", "\u2028", "\u3000", "\x0b", "\x0c", "\x1c", "\x85", "\u200b", "\u200d", "😀", "ﬁ", "İ", "ǅ", "²"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 40)))
        assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text)
    assert own.split("a “b” c") == ["a", "“b”", "c"] and own.split("x <|endoftext|>") is None
    own.ids("z" * 1000)
    assert "z" * 1000 not in own.chunks


def test_counts(spark):
    rows = [(i, t, 1) for i, t in enumerate(ODD)] + [(None, None, 2), (3, ODD[3], 3), (3, ODD[3], 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    library = Tokenizer.from_file(PATH)
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows]
    assert sorted(map(tuple, count_tokens(docs, PATH).collect()), key=str) == sorted(want, key=str)
    assert count_tokens(docs.filter("false"), PATH).count() == 0
    whole = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in queries.op9_token_counts(spark, "/root/testdata/sf0.01").collect():
        n = len(library.encode(whole[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(whole[r.doc_id].encode()), n, n > 2048)


def test_histogram_packing():
    counts = {2048: 3, 1500: 4, 600: 9, 500: 4, 40: 30, 1: 7}
    patterns = pack_histogram(counts)
    packed = {}
    for lengths, many in patterns:
        assert sum(lengths) <= 2048 and many > 0
        for n in lengths:
            packed[n] = packed.get(n, 0) + many
    assert packed == counts
    covered = {}
    for length, first, after, *_ in slots_of(patterns):
        covered.setdefault(length, []).append((first, after))
    assert all(sum(b - a for a, b in v) == counts[n] for n, v in covered.items())
    assert pack_histogram({}) == []


def placed_right(pieces, rows, library, size):
    want = sorted((i, n) for i, n in ((i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows) for _ in range(-(-n // size)))
    assert sorted(((p.doc_id if p.doc_id is not None else -1), p.doc_tokens) for p in pieces) == [(i if i is not None else -1, n) for i, n in want]
    at = {}
    for p in pieces:
        at.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in at.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= size
    assert sorted(at) == list(range(len(at)))


def test_pack(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(i, "word salad " * (i % 13)) for i in range(50)] + [(7, None), (7, "again"), (7, "again"), (-1, "x " * 500)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, rank string")
    pieces = pack(docs, PATH, size=64, with_ids=True).collect()
    placed_right(pieces, rows, library, 64)
    for p in pieces:
        assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
    assert pack(docs.filter("false"), PATH).count() == 0


def test_pack_whole_table(spark):
    library = Tokenizer.from_file(PATH)
    whole = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    pieces = queries.op7_packing(spark, "/root/testdata/sf0.01").collect()
    placed_right(pieces, whole, library, 2048)
    texts = dict(whole)
    for p in pieces:
        ids = [*library.encode(texts[p.doc_id], add_special_tokens=False).ids, 1][p.start : p.start + p.length]
        assert len(ids) == p.length and zlib.crc32(np.array(ids, "<u4").tobytes()) == p.ids_crc32
    filled = sum(p.length for p in pieces)
    padded = {p.sequence_id: p.padded_tokens for p in pieces}
    assert filled / sum(padded.values()) > 0.97
