"""Exact token ids of a word-level BPE tokenizer, with per-worker caches.

The tokenizer normalises (NFC, lower case), splits at white space and punctuation and
merges inside each pre-token, so the ids of a text are those of its white-space chunks
joined. A chunk seen before costs one dictionary lookup. Chunks with characters for which
the rest is not certain here (other scripts, combining marks) go through the library, each
alone; only texts that hold a special token's string go through it whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Characters for which lower-casing, NFC and the classes of the two regex engines agree.
UNSURE = re.compile("[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]")
SURE_ASCII = bytes([9, 10, 13, *range(32, 127)])
PRETOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^\sa-z0-9à-öø-ÿß]+")
BLANK = re.compile("[\t\n\r\x20]+")
CACHE_ENTRIES = 1_000_000  # then a worker's cache starts anew
CACHE_CHARS = 64  # longer keys are not kept


def byte_chars() -> list[str]:
    """The printable character that byte-level BPE uses for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class _Cache(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(key) > CACHE_CHARS:
            return self.make(key)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[key] = self.make(key)
        return value


def unsure(text: str) -> bool:
    """Whether a text holds a character outside the sure ones."""
    return bool(text.encode().translate(None, SURE_ASCII)) if text.isascii() else UNSURE.search(text) is not None


class Encoder:
    """``ids(text)``: little-endian uint32 token ids as bytes, without added special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.model = self.library.model
        self.chars = byte_chars()
        self.pretokens = _Cache(self._merge)
        self.chunks = _Cache(self._chunk)

    def _merge(self, pretoken: str) -> bytes:
        shown = pretoken if pretoken.isascii() else "".join(map(self.chars.__getitem__, pretoken.encode()))
        return b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(shown))

    def _chunk(self, chunk: str) -> bytes:
        if unsure(chunk):
            return self.whole(chunk)
        return b"".join(map(self.pretokens.__getitem__, PRETOKENS.findall(chunk)))

    def split(self, text: str) -> list[str] | None:
        """The chunks whose ids make up the text's, sure ones in lower case; None for a text with a special token's string."""
        if any(s in text for s in self.specials):
            return None
        if not unsure(text):
            return text.lower().split()
        return [c if unsure(c) else c.lower() for c in BLANK.split(text) if c]

    def whole(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.library.encode(text, add_special_tokens=False).ids)

    def ids(self, text: str) -> bytes:
        chunks = self.split(text)
        return self.whole(text) if chunks is None else b"".join(map(self.chunks.__getitem__, chunks))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder in each Python worker and path; its caches last as long as the worker."""
    return Encoder(path)
