"""The main text of web pages, by two passes over their blocks.

A page is cut into blocks of text between block-level tags. The first pass decides on a block by
its share of function words, its length and its share of text inside links; what lies in a menu,
a form, a sidebar, a notice or another part that the markup names is no main text. Short blocks
stay open, as do blocks with few function words that are not ruled out. In the second pass an
open block takes the label of the nearest decided block, the distance being the characters
between them. The page's ends count as decided, and no main text; of two labels as near, no main
text counts.

Where the page marks its article (or, failing that, a part named as content), only that part is
main text. There every block that is not ruled out is open at worst, of two labels as near main
text counts, the ends decide nothing, and where no block is decided all are good. A page is one row and is read in one task; its work is in proportion to its length.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are with as be at by this from or an not have which you but all one they "
    "le la les de des du et un une en est que qui dans pour sur au aux par pas plus ce il elle avec ne se son sa "
    "der die das und ist von zu den mit sich nicht ein eine auf für dem im auch als an es wird aus bei nach wie "
    "el los las y una del al por con para su lo como más o pero sus ha este no".split()
)
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())  # their content is no markup
SIBLINGS = frozenset("p li dd dt option tr td th".split())  # a start tag ends the one before
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUT_TAGS = frozenset("head nav aside footer form script style textarea title xmp iframe noembed noframes noscript template svg button select label menu dialog object canvas audio video".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar tablist toolbar".split())
#: Words of class and id names.
OUT_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager header masthead footer foot sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion "
    "banner comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended teaser widget toolbar copyright legal".split()
)
CONTENT_NAMES = frozenset("article articlebody content post entry story main".split())

LONG = 70  # characters from which a block can be decided
GOOD_SHARE, BAD_SHARE = 0.3, 0.1  # of function words
LINK_SHARE = 0.5

_MARKUP = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*+(?:>|$)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|$)|</[^>]*+(?:>|$)",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    out: bool  # the markup rules it out
    area: int  # 2 in an article, 1 in a part named as content, else 0


@dataclass
class Element:
    tag: str
    out: bool
    area: int
    link: bool


def opened(tag: str, attrs: str, above: Element) -> Element:
    """The element of a start tag: what it is itself, and what it has from the elements above."""
    told = {}
    for m in _ATTR.finditer(attrs):
        told.setdefault((m[1] or m[5]).lower(), next((g for g in m.groups()[1:4] if g is not None), ""))
    names = {w.lower() for w in _NAME.findall(f"{told.get('class', '')} {told.get('id', '')}")}
    role = told.get("role", "").lower()
    hides = "hidden" in told or told.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", told.get("style", ""))
    out = bool(tag in OUT_TAGS or role in OUT_ROLES or hides) or (tag == "header" and not above.area)
    out = out or (tag not in ("html", "body") and bool(names & OUT_NAMES))
    article = tag in ("article", "main") or role in ("main", "article") or told.get("itemprop", "").lower() == "articlebody"
    area = 2 if article else 1 if names & CONTENT_NAMES and tag not in ("html", "body") else 0
    # a form around a whole page rules out its fields, not the article in it
    return Element(tag, out or (above.out and not (article and above.tag == "form")), max(area, above.area), above.link or tag == "a")


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, white space inside them made single, without empty ones."""
    stack, found = [Element("", False, 0, False)], []
    parts: list[str] = []
    links = at = 0

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            found.append(Block(text, min(links, len(text)), stack[-1].out, stack[-1].area))
        parts.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        text = entities.unescape(raw)
        parts.append(text)
        if stack[-1].link:
            links += len(" ".join(text.split()))

    while m := _MARKUP.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m["tag"] is None:
            continue
        tag, closing = m["tag"].lower(), bool(m["close"])
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK_TAGS or (tag in OUT_TAGS and tag not in RAW_TAGS):
            flush()
        if closing:
            last = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            # an inline end tag does not close blocks that were opened inside it
            if last and (tag in BLOCK_TAGS or not any(e.tag in BLOCK_TAGS for e in stack[last + 1 :])):
                if any(e.out != stack[last - 1].out for e in stack[last:]):
                    flush()
                del stack[last:]
            continue
        if tag in SIBLINGS and stack[-1].tag == tag:
            stack.pop()
        new = opened(tag, m["attrs"], stack[-1])
        if new.out != stack[-1].out:
            flush()
        if tag in RAW_TAGS:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
        if tag not in VOID_TAGS and not m["attrs"].endswith("/"):
            stack.append(new)
    add(page[at:])
    flush()
    return found


def decided(block: Block, inside: bool) -> bool | None:
    """The first pass: main text, not main text, or open. ``inside``: the block lies in the marked article."""
    if block.out or block.links > LINK_SHARE * len(block.text):
        return False
    words = _WORD.findall(block.text.lower())
    share = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if len(block.text) >= LONG and share >= GOOD_SHARE:
        return True
    if inside:
        return None
    if "©" in block.text or (len(block.text) >= LONG and share < BAD_SHARE):
        return False
    return None


def nearest(labels: list[bool | None], sizes: list[int], default: bool) -> list[bool]:
    """The second pass: open labels take the nearest decided one's, by the sizes between; ``default`` where both are as near, or none is decided.

    Unless the default is good, what lies before the first and after the last block is not.
    """
    away: list[dict[bool, float]] = [{} for _ in labels]
    for order in (range(len(labels)), range(len(labels) - 1, -1, -1)):
        label, between = (None if default else False), 0.0
        for k in order:
            if labels[k] is not None:
                label, between = labels[k], 0.0
            else:
                if label is not None:
                    away[k][label] = min(between, away[k].get(label, between))
                between += sizes[k]
    far = float("inf")
    return [label if label is not None else default if near.get(True, far) == near.get(False, far) else near.get(True, far) < near.get(False, far) for label, near in zip(labels, away, strict=True)]


def main_blocks(page: str | None) -> list[str]:
    """The texts of a page's main blocks."""
    every = blocks(page or "")
    area = max((b.area for b in every if not b.out), default=0)
    held = [b for b in every if b.area == area and not b.out] if area else every
    labels = nearest([decided(b, area > 0) for b in held], [len(b.text) for b in held], area > 0)
    return [b.text for b, good in zip(held, labels, strict=True) if good]


def _main_texts(pages: pd.Series) -> pd.Series:  # pandas_udf needs a session, so it is made in extract
    return pages.map(lambda page: " ".join(main_blocks(page)))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(row, text): every row of ``pages`` with the main text of its page.

    Null and empty pages, and pages without main text, have an empty text. Every row is read for
    itself, so repeated rows and null ids keep their rows, and an empty table gives none.
    """
    return pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.pandas_udf(_main_texts, "string")(F.col(f"`{html_col}`")).alias("text"))
