"""Page jobs: one scan of the page table, one ``select``."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import fixed, html as H, text as T, urls as U
from gleaner.session import materialize


def filter_html(pages: DataFrame, content_types: Iterable[str] = fixed.HTML_CONTENT_TYPES) -> DataFrame:
    """Keep HTML and XML responses; a missing content type is not admitted."""
    cond = F.lit(False)
    for ct in content_types:
        cond = cond | F.col("content_type").contains(ct)
    return pages.filter(cond)


def clean_pages(
    pages: DataFrame,
    key: str = "page_id",
    html: str = "html",
    phrases: Iterable[str] = fixed.BOILERPLATE_LINES,
    stopwords: Mapping[str, Iterable[str]] | None = None,
) -> DataFrame:
    """(key, clean_text, language) of every page."""
    cleaned = pages.select(key, T.clean_text(html, phrases).alias("clean_text"))
    return cleaned.select(
        key,
        "clean_text",
        F.coalesce(T.detect_language("clean_text", stopwords), F.lit("unknown")).alias("language"),
    )


def parse_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page with all native parts: title, meta map, language, JSON-LD, microdata,
    canonical URL, form flag and next page. :func:`main_content` adds the main text."""
    return pages.select(
        key,
        url,
        H.page_title(html).alias("title"),
        H.page_meta(html).alias("meta"),
        H.page_lang(html).alias("language"),
        H.jsonld_blocks(html).alias("jsonld"),
        H.microdata(html).alias("microdata"),
        H.canonical_url(html, url).alias("canonical_url"),
        H.has_form(html).alias("has_form"),
        U.resolve_url(url, H.next_href(html)).alias("next_url"),
    )


def jsonld_table(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per JSON-LD object, in page order."""
    return pages.select(key, F.posexplode(H.jsonld_items(html)).alias("seq", "item"))


def microdata_table(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    return pages.select(key, F.posexplode(H.microdata(html)).alias("seq", "tag")).select(
        key, "seq", "tag.itemtype", "tag.properties"
    )


def meta_table(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    return pages.select(key, F.explode(H.page_meta(html)).alias("name", "content"))


def page_signals(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Form flag and absolute URL of the next page."""
    return pages.select(
        key,
        H.has_form(html).alias("has_form"),
        U.resolve_url(url, H.next_href(html)).alias("next_url"),
    )


#: pages that may be sent to every task to be left out
MOST_COPIES = 1_000_000


def first_by_canonical(pages: DataFrame, url: str = "url", html: str = "html", most: int = MOST_COPIES) -> DataFrame:
    """One page per canonical URL: the one whose own URL comes first, pages without a URL last.

    A URL stored more than once keeps its version of least hash, rows that repeat stay once. Pages with neither a
    URL nor a canonical link are one group. The choice is made on hashes of the rows, as a minimum combined on the
    map side. Up to ``most`` pages that are not chosen are left out by a broadcast of their hashes, so page sources
    are read twice and never shuffled; beyond that, pages meet the hashes in a join. Pages that repeat a chosen one
    are brought together, no others.
    """
    hashed = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in pages.schema]
    keyed = pages.withColumns({"canonical_url": H.canonical_url(html, url), "_h1": F.xxhash64(*hashed), "_h2": F.xxhash64(F.lit(1), *hashed)})
    row = [F.col(url).isNull().alias("_none"), F.col(url).alias("_url"), F.xxhash64(html).alias("_version"), F.col("_h1"), F.col("_h2")]
    rows = materialize(keyed.select("canonical_url", *row).groupBy("canonical_url", "_none", "_url", "_version", "_h1", "_h2").agg(F.count("*").alias("_n")), "canonical")
    best = rows.groupBy("canonical_url").agg(F.min(F.struct("_none", "_url", "_version", "_h1", "_h2")).alias("_best")).withColumnRenamed("canonical_url", "_c")
    judged = materialize(
        rows.join(best, F.col("canonical_url").eqNullSafe(F.col("_c")))
        .select("_h1", "_h2", "_n", ((F.col("_h1") == F.col("_best._h1")) & (F.col("_h2") == F.col("_best._h2"))).alias("_chosen"))
        .filter("NOT _chosen OR _n > 1"),
        "copies",
    )
    left_out, repeated = judged.filter("NOT _chosen").select("_h1", "_h2"), judged.filter("_chosen").select("_h1", "_h2")
    kept = keyed.join(F.broadcast(left_out) if left_out.count() <= most else left_out, ["_h1", "_h2"], "left_anti")
    n = repeated.count()
    if n:
        repeated = F.broadcast(repeated) if n <= most else repeated
        once = kept.join(repeated, ["_h1", "_h2"], "left_semi").groupBy("_h1", "_h2").agg(F.any_value(F.struct(*[f"`{c}`" for c in pages.columns], "canonical_url")).alias("_page"))
        once = once.select(*[F.col(f"_page.`{c}`").alias(c) for c in [*pages.columns, "canonical_url"]])
        kept = kept.join(repeated, ["_h1", "_h2"], "left_anti")
        return kept.select(*[F.col(f"`{c}`") for c in pages.columns], "canonical_url").union(once)
    return kept.select(*[F.col(f"`{c}`") for c in pages.columns], "canonical_url")


# Tokens of plain markup, which every HTML parser reads alike: text, script and style without what could be
# another end of them, end and start tags, doctypes and comments. Anything else is the lone "<" at the end.
_BLANK = r"[ \t\n\r\f]"
_TAG = r"[a-zA-Z][a-zA-Z0-9]*"
_ATTRIBUTES = (
    rf"(?:{_BLANK}+[a-zA-Z][a-zA-Z0-9_:.-]*(?:=(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>/=`]+(?=[ \t\n\r\f>])))?)*{_BLANK}*"
)
_TOKEN = re.compile(
    rf"(?P<text>[^<]+)|</(?P<end>{_TAG}){_BLANK}*>"
    rf"|<(?P<raw>[sS][cC][rR][iI][pP][tT]|[sS][tT][yY][lL][eE])(?={_BLANK}|>){_ATTRIBUTES}>(?P<content>[^<]*(?:<(?!/[\s\x00sS\u017f])[^<]*)*)</(?P<close>{_TAG}){_BLANK}*>"
    rf"|<(?P<tag>{_TAG}){_ATTRIBUTES}(?P<empty>/?)>|<![dD][oO][cC][tT][yY][pP][eE][^<>]*>|<!--(?!-?>)[^-]*(?:-[^-]+)*-->|(?P<other><)"
)


class _MainText(HTMLParser):
    """Text of the main element, else of the div with most text, else of the body.

    Pages need nesting here, which patterns cannot follow; this is the only per-row Python.
    """

    VOID = frozenset(
        "area base br col embed hr img input link meta param source track wbr".split()
    )
    CHROME = frozenset(fixed.CHROME_TAGS)

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.open: list[tuple[str, int]] = []
        self.held: Counter[str] = Counter()
        self.main: tuple[int, int] | None = None
        self.divs: list[tuple[int, int]] = []
        self.skip_from: int | None = None  # place of the outermost open furniture
        self.body_from = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.VOID:
            return
        if tag in self.CHROME and self.skip_from is None:
            self.skip_from = len(self.open)
        if tag == "body":
            self.body_from = len(self.pieces)
        self.open.append((tag, len(self.pieces)))
        self.held[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        """An element without content."""

    def handle_endtag(self, tag: str) -> None:
        """Close the element and all that is still open in it; furniture ends with its parent."""
        if not self.held[tag]:
            return
        while True:
            name, start = self.open.pop()
            self.held[name] -= 1
            if self.skip_from is None or len(self.open) < self.skip_from:
                self._closed(name, start)
            if self.skip_from is not None and len(self.open) <= self.skip_from:
                self.skip_from = None
            if name == tag:
                return

    def _closed(self, name: str, start: int) -> None:
        span = (start, len(self.pieces))
        if name == "div":
            self.divs.append(span)
        elif name == "main" and self.main is None:
            self.main = span

    def handle_data(self, data: str) -> None:
        stripped = data.strip()
        if stripped and self.skip_from is None:
            self.pieces.append(stripped)

    def read_plain(self, html: str) -> bool:
        """Take a page of plain markup, several times faster than :meth:`feed`; False if there is other markup."""
        for token in _TOKEN.finditer(html):
            kind = token.lastgroup
            if kind == "text":
                self.handle_data(unescape(token[0]))
            elif kind == "end":
                self.handle_endtag(token["end"].lower())
            elif kind == "empty":
                tag = token["tag"].lower()
                if not token["empty"]:
                    # raw text that is closed elsewhere
                    if tag in self.CDATA_CONTENT_ELEMENTS:
                        return False
                    self.handle_starttag(tag, [])
            elif kind == "close":
                tag = token["raw"].lower()
                if token["close"].lower() != tag:
                    return False
                self.handle_starttag(tag, [])
                self.handle_data(token["content"])
                self.handle_endtag(tag)
            elif kind == "other":
                return False
        return True

    def result(self) -> str:
        self.close()
        for name, start in self.open[: self.skip_from]:
            self._closed(name, start)
        if self.main:
            a, b = self.main
        elif self.divs:
            # sizes by prefix sums; the outermost, earliest div wins a tie
            sums = [0]
            for p in self.pieces:
                sums.append(sums[-1] + len(p))
            a, b = max(self.divs, key=lambda s: (sums[s[1]] - sums[s[0]], -s[0], s[1]))
        else:
            a, b = self.body_from, len(self.pieces)
        return " ".join(self.pieces[a:b])


def _main_text(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _MainText()
    if not parser.read_plain(html):
        parser = _MainText()
        parser.feed(html)
    return parser.result()


def main_content(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, main_text). Batches go through Arrow and only two columns leave the JVM."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "main_text": batch[html].map(_main_text)})

    key_type = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(run, f"{key} {key_type}, main_text string")
