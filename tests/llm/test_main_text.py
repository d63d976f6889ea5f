import html
from html.parser import HTMLParser

import pytest

from gyrolake.llm import main_text as M
from gyrolake.llm import queries as Q

PROSE = "It is said that the old mill by the river was built in the year of the great flood, and that it has stood for all of that time."
MORE = "There was not one of them who did not know the way to the house, for it was on the road that led from the town to the sea."


def text(page):
    return " ".join(M.main_blocks(page))


CASES = {
    "plain divs": (f"<body><div>Home | News | Sport</div><div><p>{PROSE}</p><p>Yes.</p><p>{MORE}</p></div><div><a href=/a>About</a> <a href=/b>Contact us</a></div><p>© 2024 The Mill</p></body>", f"{PROSE} Yes. {MORE}"),
    "named parts": (f"<div class='site-header'>{MORE}</div><div id=main-content><h1>The mill</h1><p>{PROSE}</p></div><div class=sidebar>{MORE}</div><div id='footer'>{MORE}</div>", f"The mill {PROSE}"),
    "comments": (f"<article><h1>T</h1><p>{PROSE}</p><section class='comments'><p>{MORE}</p></section></article>", f"T {PROSE}"),
    "cookie notice": (f"<div class=cookie-consent role=dialog>{MORE}</div><main><p>{PROSE}</p></main>", PROSE),
    "form around all": (f"<form action=/x><input name=q><label>Search the site</label><article><p>{PROSE}</p></article><button>Go</button></form>", PROSE),
    "form in article": (f"<article><p>{PROSE}</p><form><p>{MORE}</p></form></article>", PROSE),
    "header in article": (f"<header>{MORE}</header><article><header><h1>Title</h1></header><p>{PROSE}</p><footer>{MORE}</footer></article>", f"Title {PROSE}"),
    "unclosed": (f"<nav><ul><li>A<li>B</ul></nav><article><p><b>Bold start<br><p>{PROSE}<p>End", f"Bold start {PROSE} End"),
    "script and comment": (f"<article><p>{PROSE}<script>if (a < b) x = '</p><p>no</p>';</script><!-- <p>no</p> --><style>p > a {{}}</style></p></article>", PROSE),
    "references": ("<article><p>Fish &amp; chips &lt;b&gt; &eacute;&#8212;&#x41;&nbsp;end &unknown; &amp</p></article>", "Fish & chips <b> é—A end &unknown; &"),
    "quotes in attributes": (f'<article><p title="a > b" data-x=\'c > d\'>{PROSE}</p></article>', PROSE),
    "inline": ("<article><p>Wo<b>rd</b>s and <a href=/x>a link</a>\n\t more</p></article>", "Words and a link more"),
    "menu in article": (f"<article><p>{PROSE}</p><ul><li><a href=/1>First other story</a></li><li><a href=/2>Second</a></li></ul></article>", PROSE),
    "hidden": (f"<article><p>{PROSE}</p><p hidden>{MORE}</p><div style='display: none'>{MORE}</div></article>", PROSE),
    "short article": ("<nav>x</nav><article>Auxpa.</article><footer>y</footer>", "Auxpa."),
    "no tags": (PROSE, PROSE),
    "cut in a tag": (f"<article><p>{PROSE}</p><p", PROSE),
    "nothing": ("", ""),
    "null": (None, ""),
    "only a menu": ("<nav><a href=/>Home</a></nav>", ""),
    "stray ends": (f"</div></p><article></b></i><p>{PROSE}</p></article></article></html>", PROSE),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    page, want = CASES[name]
    assert text(page) == want


def test_open_blocks_take_the_nearest_label():
    n, y, o = False, True, None
    assert M.nearest([y, o, n], [10, 5, 10], True) == [True, True, False] and M.nearest([y, o, n], [10, 5, 10], False) == [True, False, False]  # as near
    assert M.nearest([y, o, o, n], [9, 50, 2, 9], False) == [True, True, False, False]  # 50 characters lie between the third and the first
    assert M.nearest([o, y, o], [1, 9, 1], False) == [False, True, False] and M.nearest([o, y, o], [1, 9, 1], True) == [True, True, True]  # the ends
    assert M.nearest([o, o], [1, 1], False) == [False, False] and M.nearest([o], [1], True) == [True]
    assert M.nearest([n, o, o], [1, 5, 5], True) == [False, False, False] and M.nearest([], [], True) == []


def test_long_and_odd_pages_take_time_in_proportion():
    for page in ("<b>" * 50_000, "<p>a" * 50_000, "<a href='" * 30_000, "<!--" * 30_000, "<" * 100_000, "&" * 100_000, "<div>" * 3_000 + PROSE, '"' * 100_000 + "<x " * 10_000):
        M.main_blocks(page)
    assert text("<article><p>" + f"{PROSE} " * 5000 + "</p></article>") == " ".join([PROSE] * 5000)


class Article(HTMLParser):
    """The text of the article of the test tables, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.inside, self.parts = False, []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.parts.append(" " if tag in ("p", "br", "h1") else "")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.parts.append(" " if tag in ("p", "h1") else "")

    def handle_data(self, data):
        self.parts.append(data if self.inside else "")

    def handle_entityref(self, name):
        self.parts.append(html.unescape(f"&{name};") if self.inside else "")


def test_query_over_the_table(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in Q.op12_main_text(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        a = Article()
        a.feed(p.html.removesuffix("&am").removesuffix("&a"))
        want, found = " ".join("".join(a.parts).split()), got[p.page_id]
        assert found.url == p.url and found.n_chars == len(found.text)
        assert found.text == want or (not p.html.endswith("</html>") and found.text.startswith(want[:-30]))


def test_rows_stay_as_they_are(spark):
    rows = [(None, None, "t", "r"), (1, f"<p>{PROSE}</p>", "t", "r"), (1, f"<p>{PROSE}</p>", "t", "r")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, row string")
    assert sorted((r.row.page_id or 0, r.row.text, r.text) for r in M.extract(df).collect()) == [(0, "t", ""), (1, "t", PROSE), (1, "t", PROSE)]
    assert M.extract(df.limit(0)).count() == 0
