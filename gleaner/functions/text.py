"""Text cleaning as column expressions: no Python runs per row."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import fixed
from gleaner.functions.common import WORD, WS_CLASS, col, let, squeeze, strip

# One alternation finds whichever comes first, so "<!--" inside a script and "<script" inside a
# comment are both read the way a browser reads them. What is never closed runs to the end of the
# page, as in a browser; it also means that no opening is ever tried without success, so the scan
# stays linear.
HIDDEN = (
    r"(?is)<!--.*?(?:-->|\z)|<("
    + "|".join([*fixed.HIDDEN_TAGS, "template"])
    + r")\b[^>]*+(?:>.*?(?:</\1\s*+>|\z)|\z)"
)
# A run of tags with the blanks around it. Blanks count only from the start of their run, and the
# quantifiers are possessive, which keeps the match off the Java stack.
_TAG_REST = rf"[^>]*+(?:>|\z){WS_CLASS}*+"
TAG_RUN = (
    rf"(?:<(?=[a-zA-Z/!?])|(?={WS_CLASS})(?<!{WS_CLASS}){WS_CLASS}++<(?=[a-zA-Z/!?])){_TAG_REST}"
    rf"(?:<(?=[a-zA-Z/!?]){_TAG_REST})*+"
)

# names in the order they are tried: those that pages use most, then all others
_COMMON = ["amp", "lt", "gt", "quot", "nbsp", "apos", "copy", "middot", "mdash", "ndash", "hellip", "rsquo", "lsquo", "ldquo", "rdquo", "eacute"]
_NAMES = sorted((n[:-1] for n in html5 if n.endswith(";")), key=lambda n: (n not in _COMMON, n))
# one literal that the optimizer folds into a map; spelled as two thousand literals it would slow planning
_ENTITY_TEXT = "\x01".join(f"{name}\x02{html5[name + ';']}" for name in _NAMES)
# names that are also read without a semicolon, the longest first
_BARE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
# numbers 128 to 159 mean the characters of Windows-1252
_REMAPPED = {chr(i): bytes([i]).decode("cp1252", "ignore") for i in range(128, 160)}
_REMAP_FROM = "".join(k for k, v in _REMAPPED.items() if v)
_REMAP_TO = "".join(v for v in _REMAPPED.values() if v)
REFERENCE = rf"^(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[a-zA-Z][a-zA-Z0-9]*+;|(?:{_BARE}))"


def _char(code_point: Column) -> Column:
    """Character of a number; numbers that are none, or too large to be read, give U+FFFD."""
    ok = code_point.between(1, 0x10FFFF) & ~code_point.between(0xD800, 0xDFFF)
    encoded = F.unhex(F.lpad(F.hex(F.when(ok, code_point).otherwise(F.lit(0xFFFD))), 8, "0"))
    return F.translate(F.decode(encoded, "UTF-32"), _REMAP_FROM, _REMAP_TO)


def html_unescape(c: Column | str) -> Column:
    """Decode character references as HTML 5 does: all names, any number of digits, and without a
    semicolon where that is allowed. An unknown name with a semicolon is read up to the longest known
    name that needs none (``&notit;``)."""
    names = F.str_to_map(F.lit(_ENTITY_TEXT), F.lit("\x01"), F.lit("\x02"))

    # this tree stands wherever an attribute or a text is read: each part of it is there once
    def char(ref: Column) -> Column:
        body = F.rtrim(ref, F.lit(";"))
        number = F.when(ref.rlike("^#[0-9]"), F.substr(body, F.lit(2))).otherwise(F.conv(F.substr(body, F.lit(3)), 16, 10))
        return F.when(ref.startswith("#"), _char(number.try_cast("bigint"))).otherwise(F.try_element_at(names, body))

    def piece(s: Column, i: Column) -> Column:
        tried = F.array(F.regexp_extract(s, REFERENCE, 0), F.regexp_extract(s, rf"^(?:{_BARE})", 0))
        decoded = F.transform(tried, lambda ref: F.when(ref != "", F.concat(char(ref), F.substr(s, F.length(ref) + F.lit(1)))))
        # by far the most common one needs no pattern
        amp = F.when(s.startswith("amp;"), F.concat(F.lit("&"), F.substr(s, F.lit(5))))
        return F.when(i == 0, s).otherwise(F.coalesce(amp, F.get(F.filter(decoded, lambda d: d.isNotNull()), F.lit(0)), F.concat(F.lit("&"), s)))

    return let(
        col(c),
        lambda v: F.when(~v.contains("&"), v).otherwise(
            F.array_join(F.transform(F.split(v, "&", -1), piece), "")
        ),
    )


def html_to_text(c: Column | str) -> Column:
    """Visible text of an HTML document: hidden elements, comments and tags removed, character
    references decoded, text nodes joined by one blank. Line breaks inside a node are kept."""
    visible = F.regexp_replace(col(c), HIDDEN, "<!>")
    return html_unescape(F.trim(F.regexp_replace(visible, TAG_RUN, " ")))


def clean_whitespace(c: Column | str) -> Column:
    """One blank per run of white space, zero-width characters removed, trimmed."""
    return F.trim(F.translate(squeeze(c), "​‌‍﻿", ""))


def remove_boilerplate(c: Column | str, phrases: Iterable[str] = fixed.BOILERPLATE_LINES) -> Column:
    """Drop the lines that consist of a boilerplate phrase only; join the others with blanks."""
    return F.array_join(_content_lines(col(c), phrases), " ")


def _content_lines(c: Column, phrases: Iterable[str]) -> Column:
    wanted = [p.lower() for p in phrases]
    return F.filter(
        F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"),
        lambda line: ~F.lower(strip(line)).isin(wanted),
    )


def largest_block(c: Column | str) -> Column:
    """Longest block between blank lines; the first one if several are equally long."""
    return F.aggregate(
        F.split(col(c), r"\n{2,}"),
        F.lit(None).cast("string"),
        lambda best, block: F.when(
            best.isNull() | (F.length(block) > F.length(best)), block
        ).otherwise(best),
    )


def word_set(c: Column | str) -> Column:
    """Distinct lower-case words; contractions are split ("it's" holds "it", "don't" holds "do")."""
    lowered = F.lower(col(c))
    apart = F.regexp_replace(lowered, r"n?['\x{2019}](?:t|s|m|d|ll|re|ve)(?![\p{L}\p{N}_])", " ")
    return F.array_distinct(F.regexp_extract_all(apart, F.lit(rf"[{WORD}-]+"), F.lit(0)))


def detect_language(
    c: Column | str,
    stopwords: Mapping[str, Iterable[str]] | None = None,
    more_than: int = 3,
) -> Column:
    """Language with the most distinct stop words, if more than ``more_than`` occur, else NULL.

    With the default (English only) this is the test "more than three English stop words". Ties go
    to the language named first.
    """
    lexicon = stopwords or {"en": fixed.ENGLISH_STOPWORDS}

    def pick(words: Column) -> Column:
        counts = [
            F.struct(F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in ws]))).alias("n"),
                     F.lit(-i).alias("order"), F.lit(lang).alias("lang"))
            for i, (lang, ws) in enumerate(lexicon.items())
        ]
        best = counts[0] if len(counts) == 1 else F.greatest(*counts)
        return let(best, lambda b: F.when(b["n"] > more_than, b["lang"]))

    return let(word_set(c), pick)


def to_utf8(c: Column | str, binary: bool = False) -> Column:
    """Text from bytes, dropping what is not valid UTF-8. Text columns pass through."""
    if not binary:
        return col(c)
    return F.replace(F.make_valid_utf8(col(c).cast("string")), F.lit("�"), F.lit(""))


def clean_text(
    html: Column | str, phrases: Iterable[str] = fixed.BOILERPLATE_LINES
) -> Column:
    """HTML to clean text. Lines and blocks are judged while they still exist: boilerplate lines
    are dropped, the largest block is kept, and only then is white space collapsed."""
    wanted = [p.lower() for p in phrases]
    kept = F.filter(
        F.split(html_to_text(html), r"\r\n|[\n\r]"),
        lambda line: ~F.lower(strip(line)).isin(wanted),
    )
    return clean_whitespace(largest_block(F.array_join(kept, "\n")))
