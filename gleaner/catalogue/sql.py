"""Fragments of checking SQL. They restate an operation in the plainest form the checking engine
offers (its matcher is linear, so patterns need no guards) and call nothing of the engine."""

from __future__ import annotations

WS = r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def q(pattern: str) -> str:
    """SQL string literal."""
    return "'" + pattern.replace("'", "''") + "'"


def every(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {q(pattern)}, {group})"


def sub(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, {q(pattern)}, {q(by)}, 'g')"


def squeeze(text: str) -> str:
    return f"trim({sub(text, f'[{WS}]+', ' ')})"


def strip(text: str) -> str:
    return sub(text, rf"^[{WS}]+|[{WS}]+$")


def entities(text: str) -> str:
    for name, char in [("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("copy", "©"),
                       ("middot", "·"), ("mdash", "—"), ("hellip", "…"), ("#39", "'"), ("amp", "&")]:
        text = f"replace({text}, {q('&' + name + ';')}, {q(char)})"
    return text


HIDDEN = (
    r"(?is)<!--.*?-->"
    + "".join(rf"|<{t}\b[^>]*>.*?</{t}\s*>" for t in ("script", "style", "noscript", "iframe", "template"))
)
TAG_RUN = rf"[{WS}]*(?:<[a-zA-Z/!?][^>]*>[{WS}]*)+"


def text_of(html: str) -> str:
    return entities(f"trim({sub(sub(html, HIDDEN, '<!>'), TAG_RUN, ' ')})")


def attr(tag: str, name: str) -> str:
    raw = f"regexp_extract(' ' || {tag}, {q(rf'''(?is)[\s\"'/]{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)''')}, 1)"
    return f"nullif({entities(sub(raw, '^[\"\']|[\"\']$'))}, '')"


def any_of(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def first_of_lexicon(text: str, lexicon: dict[str, list[str]], default: str) -> str:
    whens = " ".join(f"WHEN {any_of(text, ws)} THEN {q(n)}" for n, ws in lexicon.items())
    return f"CASE {whens} ELSE {default} END"


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


# fixed values: patterns and word lists that the checks share with the engine
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+"
PHONE = rf"\+?\p{{Nd}}[\p{{Nd}}{WS}().-]{{7,}}\p{{Nd}}"
NAME_RUN = rf"a-zA-Z0-9&{WS}'-"
BUSINESS = (
    rf"([A-Z][{NAME_RUN}]+(?:Hotel|Resort|Tours?|Travel|Restaurant|Cafe|Agency|Lodge|Inn|Guesthouse|"
    r"Accommodation|Booking|Reservation))"
)
STREET_END = (
    "(?:Street|Avenue|Road|Boulevard|Lane|Drive|Place|Court|Way|Terrace|Close|Crescent|Grove|Square|Gardens|Heights|"
    "Manor|Villa|Apartment|Suite|Floor|Building|Center|Centre|Plaza|Mall|Complex|District|Area|Zone|City|Town|Village|"
    "County|State|Province|Country|Postal|Zip|Code)"
)
STREET = rf"[0-9]{{1,5}}[{WS}]+[A-Za-z0-9.,'{WS}-]+{STREET_END}"


def business_names(text: str) -> str:
    """List of cleaned names in order, not distinct."""
    x = "x"
    for suffix in (rf"Contact[{WS}]+Information", "About", "Home"):
        x = sub(x, rf"(?i)[{WS}]*[-\x{{2013}}][{WS}]*{suffix}[^\n]*")
    return f"list_filter(list_transform({every(text, BUSINESS, 1)}, lambda x: {squeeze(x)}), lambda x: length(x) > 3)"
