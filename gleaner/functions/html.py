"""HTML structure as column expressions over the page source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import fixed
from gleaner.functions.common import (
    WS, blank_to_null, col, collapse, empty_strings, find_all, first_of, let, one_per_key, strip,
)
from gleaner.functions.text import html_to_text, html_unescape

# A tag or element that is never closed runs to the end of the page (a link to the next link), so
# every opening matches and no part of a page is read twice.
ANCHOR = r"(?is)<a[\s/]([^>]*+)(?:>(.*?)(?:</a\s*+>|(?=<a[\s/])|\z)|\z)"
ANCHOR_TAG = r"(?is)<a[\s/]([^>]*+)(?:>|\z)"
META_TAG = r"(?is)<meta[\s/]([^>]*+)(?:>|\z)"
LINK_TAG = r"(?is)<link[\s/]([^>]*+)(?:>|\z)"
TITLE = r"(?is)<title\b[^>]*+(?:>(.*?)(?:</title\s*+>|\z)|\z)"
H1 = r"(?is)<h1\b[^>]*+(?:>(.*?)(?:</h1\s*+>|\z)|\z)"
SCRIPT = r"(?is)<script\b[^>]*+(?:>.*?(?:</script\s*+>|\z)|\z)"
JSONLD_HEAD = r"(?is)^<script\b[^>]*?\btype\s*=\s*[\"']?application/ld\+json\b"
ITEMTYPE_TAG = r"(?is)<[a-z][a-z0-9]*+\s[^>]*?\bitemtype\s*=[^>]*+>"
ATTRIBUTE = r"(?s)([a-zA-Z_:@][a-zA-Z0-9_:.@-]*+)\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s\"'>]++)"
CHROME = r"(?is)<(" + "|".join(fixed.CHROME_TAGS) + r")\b[^>]*+(?:>.*?(?:</\1\s*+>|\z)|\z)"
FORM = r"(?i)<form\b"
FORM_TAG = r"(?is)<form([^>]*+)(?:>|\z)"
LOCATION = r"(?s)<loc(?:\s[^>]*+)?>((?:[^<]++|<!\[CDATA\[.*?(?:\]\]>|\z))*+)</loc\s*+>"
CDATA = r"(?s)<!\[CDATA\[(.*?)(?:\]\]>|\z)"


def _unquote(value: Column) -> Column:
    return F.regexp_replace(value, r"(?s)^([\"'])(.*)\1$", "$2")


def _raw_attribute(tag: Column, name: str) -> Column:
    """As it stands in the source; NULL if it is absent."""
    raw = F.regexp_extract(
        F.concat(F.lit(" "), tag),
        rf"(?is)[\s\"'/]{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)",
        1,
    )
    return _unquote(blank_to_null(raw))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute inside the text of a tag; NULL if it is absent."""
    return html_unescape(_raw_attribute(tag, name))


def attributes(tag: Column, *names: str) -> Column:
    """Values of several attributes of a tag, as an array in the order of the names."""
    return F.transform(F.array(*[_raw_attribute(tag, name) for name in names]), html_unescape)


def _element_text(inner: Column) -> Column:
    return collapse(html_to_text(inner))


def strip_chrome(html: Column | str) -> Column:
    """Source without navigation, forms, scripts and other page furniture."""
    return F.regexp_replace(col(html), CHROME, " ")


def anchors(html: Column | str, word: str | None = None) -> Column:
    """All links with text, in page order: array of (href, text).

    With ``word`` (in lower case) only those whose source may hold it: it is there as it is, or there are
    character references. Tags inside a text part words, so they hide none.
    """
    found = find_all(html, ANCHOR)
    if word:
        found = F.filter(found, lambda a: F.lower(a).contains(word) | a.contains("&"))
    named = F.transform(
        found,
        lambda a: F.struct(
            attribute(F.regexp_extract(a, ANCHOR_TAG, 1), "href").alias("href"),
            _element_text(F.regexp_extract(a, r"(?is)^[^>]*+>(.*?)(?:</a\s*+>)?\z", 1)).alias("text"),
        ),
    )
    return F.filter(named, lambda a: a["href"].isNotNull())


def hrefs(html: Column | str) -> Column:
    """Trimmed link targets in page order."""
    found = F.transform(find_all(html, ANCHOR_TAG, 1), lambda tag: strip(attribute(tag, "href")))
    return F.filter(found, lambda h: h.isNotNull())


def outlinks(html: Column | str) -> Column:
    """Distinct link targets that lead to another page."""
    return F.filter(
        F.array_distinct(hrefs(html)),
        lambda h: ~h.startswith("#") & ~F.lower(h).startswith("javascript:"),
    )


def _metas(html: Column | str) -> Column:
    """(name, property, content) of every meta tag, in order."""
    return F.transform(
        find_all(html, META_TAG, 1),
        lambda tag: let(
            attributes(tag, "name", "property", "content"),
            lambda v: F.struct(v[0].alias("name"), v[1].alias("property"), v[2].alias("content")),
        ),
    )


def meta_pairs(html: Column | str) -> Column:
    """(name or property in lower case, content) of every meta tag with content, in order."""
    pairs = F.transform(
        _metas(html),
        lambda m: F.struct(F.lower(F.coalesce(m["name"], m["property"], F.lit(""))).alias("key"), m["content"].alias("value")),
    )
    return F.filter(pairs, lambda p: F.coalesce(p["value"], F.lit("")) != "")


def page_meta(html: Column | str) -> Column:
    """Meta tags as a map; the last tag of a name wins."""
    return F.map_from_entries(one_per_key(meta_pairs(html), last=True))


def _meta_content(metas: Column, attr: str, name: str) -> Column:
    """Content of the first meta tag whose attribute ``attr`` equals ``name``."""
    return first_of(F.filter(metas, lambda m: F.coalesce(m[attr], F.lit("")) == name))["content"]


def meta_content(html: Column | str, attr: str, name: str) -> Column:
    return let(_metas(html), lambda m: _meta_content(m, attr, name))


def title_tag(html: Column | str) -> Column:
    return blank_to_null(_element_text(F.regexp_extract(col(html), TITLE, 1)))


def page_title(html: Column | str) -> Column:
    """Title element, else og:title, else meta title, else first heading, else ''."""
    html = col(html)
    heading = F.regexp_extract(strip_chrome(html), H1, 1)
    return F.coalesce(
        title_tag(html),
        let(
            _metas(html),
            lambda m: F.coalesce(
                blank_to_null(strip(_meta_content(m, "property", "og:title"))),
                blank_to_null(strip(_meta_content(m, "name", "title"))),
            ),
        ),
        blank_to_null(_element_text(heading)),
        F.lit(""),
    )


def page_lang(html: Column | str) -> Column:
    """Language declared on the html element, NULL if there is none."""
    return attribute(blank_to_null(F.regexp_extract(col(html), r"(?is)<html\s([^>]*+)>", 1)), "lang")


def jsonld_blocks(html: Column | str) -> Column:
    """Text of every JSON-LD script that parses."""
    html = col(html)
    scripts = F.filter(find_all(html, SCRIPT), lambda s: s.rlike(JSONLD_HEAD))
    blocks = F.transform(
        scripts, lambda s: strip(F.regexp_extract(s, r"(?is)^[^>]*+>(.*?)(?:</script\s*+>)?\z", 1))
    )
    parsed = F.filter(blocks, lambda b: F.try_parse_json(b).isNotNull())
    return F.when(F.lower(html).contains("ld+json"), parsed).otherwise(empty_strings())


def jsonld_items(html: Column | str) -> Column:
    """JSON-LD objects, with top-level arrays taken apart."""
    items = F.transform(
        jsonld_blocks(html),
        lambda b: F.when(b.startswith("["), F.from_json(b, "array<string>")).otherwise(F.array(b)),
    )
    return F.filter(F.flatten(items), lambda i: i.isNotNull())


def microdata(html: Column | str) -> Column:
    """Every tag that has an itemtype: array of (itemtype, properties)."""

    def properties(tag: Column) -> Column:
        names = F.transform(find_all(tag, ATTRIBUTE, 1), F.lower)
        values = F.transform(find_all(tag, ATTRIBUTE, 2), lambda v: html_unescape(_unquote(v)))
        return F.map_from_entries(one_per_key(F.arrays_zip(names.alias("key"), values.alias("value"))))

    return F.transform(
        _itemtype_tags(html),
        lambda tag: F.struct(attribute(tag, "itemtype").alias("itemtype"), properties(tag).alias("properties")),
    )


def itemtypes(html: Column | str) -> Column:
    """The itemtype of every tag that has one, without its other properties."""
    return F.transform(_itemtype_tags(html), lambda tag: attribute(tag, "itemtype"))


def _itemtype_tags(html: Column | str) -> Column:
    html = col(html)
    # most pages have none: a substring search is much cheaper than looking into every tag
    return F.when(F.lower(html).contains("itemtype"), find_all(html, ITEMTYPE_TAG)).otherwise(empty_strings())


def canonical_href(html: Column | str) -> Column:
    links = F.transform(find_all(html, LINK_TAG, 1), lambda tag: attributes(tag, "rel", "href"))
    return first_of(F.filter(links, lambda v: F.lower(F.coalesce(v[0], F.lit(""))) == "canonical"))[1]


def canonical_url(html: Column | str, final_url: Column | str) -> Column:
    return F.coalesce(blank_to_null(canonical_href(html)), col(final_url))


def has_form(html: Column | str) -> Column:
    return col(html).rlike(FORM)


def has_contact_form(html: Column | str) -> Column:
    """Whether a form tag has "contact" somewhere after "action="; a tag never closed runs to the end."""
    def after(tag: Column) -> Column:
        lowered = F.lower(tag)
        at = F.instr(lowered, "action=")
        return (at > 0) & (F.instr(F.substr(lowered, at + F.lit(7)), "contact") > 0)

    return F.exists(find_all(html, FORM_TAG, 1), after)


def next_href(html: Column | str) -> Column:
    """Target of the first link whose text holds "Next"."""
    return first_of(F.filter(anchors(html, "next"), lambda a: a["text"].contains("Next")))["href"]


def sitemap_locations(xml: Column | str) -> Column:
    """Contents of the location elements; CDATA sections stand for themselves, other text is decoded."""
    def address(inner: Column) -> Column:
        literal = F.regexp_replace(inner, CDATA, "$1")
        return strip(F.when(inner.contains("<![CDATA["), literal).otherwise(html_unescape(inner)))

    return F.filter(F.transform(find_all(xml, LOCATION, 1), address), lambda x: x != "")
