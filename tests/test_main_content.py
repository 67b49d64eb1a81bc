"""Main text of a page: plain markup is read by tokens, with the same result as by the parser."""

import random

from gleaner.operators import pages as P

PARTS = [
    "<div>", "<DIV class=x>", "</div>", "<main>", "</main >", "<p>", "</p>", "<nav>", "</nav>", "<body>", "</body>", "<footer>", "</footer>",
    "<script>", "</script>", "<script/>", "<script>var t=\"</p>\"</script>", "<style>a</s>b</ style>", "<style>", "</style\n>", "<script>a<!-- b</scrip>",
    "<br/>", "<br />", "<img alt='a>b'>", "<img alt=x/>", '<a href="x&amp;y"  b>', "<a href=x/y>", "</a>", "<a b = c>", '<a b="c"d>', "<a b='", '"', "'",
    "<!-- c -->", "<!---->", "<!-->", "<!--->", "<!--a--->", "<!-- a--b -->", "<!-- -- >", "<!doctype html>", "<!DOCTYPE a<b>", "<!x>", "<?php a>", "<![CDATA[x]]>",
    "< b", "<", ">", "</>", "</ p>", "</p x>", "<a\x0bb=c>", "<div a=b/ >", "<div-x>", "&amp", "&lt;", "&#60;", "&notit;", "a", "b c", " ", "\n", "\x0b", "\x00", "ſ", "<ſcript>", "</ſcript>",
]


def parsed(html):
    parser = P._MainText()
    parser.feed(html)
    return parser.result()


def test_tokens_and_parser_agree():
    draw = random.Random(7)
    for _ in range(20_000):
        html = "".join(draw.choices(PARTS, k=draw.randrange(1, 14)))
        assert P._main_text(html) == parsed(html), html


def test_plain_pages_skip_the_parser(monkeypatch):
    page = (
        '<!DOCTYPE html><html lang="en"><head><title>T</title><script>var t="</p>";</script><style>p{margin:0}</style></head><body><!-- n -->'
        '<nav><a href="/c">Reach us</a></nav><div class=x><p>Open &amp; free<br/>daily</p><form method="post"><input name="q"></form></div></body></html>'
    )
    assert not P._MainText().read_plain("a < b") and not P._MainText().read_plain("<script>a")
    monkeypatch.setattr(P._MainText, "feed", None)
    assert P._main_text(page) == "Open & free daily"
