"""Contact extraction as column expressions.

The patterns are written for a backtracking matcher that meets hostile pages. Most of them have
the form "head, then any characters of a class, then a closing word". Tried at every offset, such
a pattern reads the same run of text again and again. Since everything between two possible heads
of one run belongs to the class, the first head of a run matches whenever a later one does, so one
try per run is enough. There are two ways to say so: ``_run_start`` (start of a run, or the end of
the previous match) with a possessive skip to the head, and, where heads are rare,
``_once_per_run``. Results are those of the plain pattern.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import fixed, html as H
from gleaner.functions.common import (
    WORD, WS, blank_to_null, col, collapse, contains_any, empty_strings, find_all, find_first,
    first_category, first_of, let, sorted_set, strip,
)


def _run_start(run: str) -> str:
    return rf"(?:\G|(?<![{run}]))"


# fixed value: an e-mail address (the domain may keep a trailing dot)
_LOCAL = "a-zA-Z0-9_.+-"
EMAIL_PLAIN = rf"[{_LOCAL}]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+"
EMAIL = rf"{_run_start(_LOCAL)}[{_LOCAL}]++@[a-zA-Z0-9-]++\.[a-zA-Z0-9.-]+"
EMAIL_OBFUSCATED = (
    rf"(?i){_run_start(_LOCAL)}([{_LOCAL}]++)[{WS}]*+\[at\][{WS}]*+([a-zA-Z0-9-]++)[{WS}]*+\[dot\][{WS}]*+([a-zA-Z0-9.-]+)"
)
# fixed value: a phone number
PHONE = rf"\+?\p{{Nd}}[\p{{Nd}}{WS}().-]{{7,}}\p{{Nd}}"
PHONE_OBFUSCATED = (
    rf"\+?\p{{Nd}}{{1,3}}[{WS}]*+\[space\][{WS}]*+\p{{Nd}}{{3,5}}[{WS}]*+\[space\][{WS}]*+\p{{Nd}}{{3,5}}"
)
_NAME_RUN = rf"a-zA-Z0-9&{WS}'-"
_ADDRESS_RUN = rf"A-Za-z0-9.,'{WS}-"


def extract_emails(text: Column | str, deobfuscate: bool = False) -> Column:
    """Distinct e-mail addresses, sorted."""
    return sorted_set(_emails(col(text), deobfuscate))


def _emails(text: Column, deobfuscate: bool = False) -> Column:
    plain = F.when(text.contains("@"), find_all(text, EMAIL)).otherwise(empty_strings())
    if not deobfuscate:
        return plain
    hidden = F.when(
        F.lower(text).contains("[at]"),
        F.transform(
            F.arrays_zip(
                find_all(text, EMAIL_OBFUSCATED, 1).alias("u"),
                find_all(text, EMAIL_OBFUSCATED, 2).alias("d"),
                find_all(text, EMAIL_OBFUSCATED, 3).alias("t"),
            ),
            lambda m: F.concat(m["u"], F.lit("@"), m["d"], F.lit("."), m["t"]),
        ),
    ).otherwise(empty_strings())
    return F.concat(plain, hidden)


def extract_phones(text: Column | str, deobfuscate: bool = False) -> Column:
    """Distinct phone numbers as written, sorted."""
    return sorted_set(_phones(col(text), deobfuscate))


def _phones(text: Column, deobfuscate: bool = False) -> Column:
    plain = find_all(text, PHONE)
    if not deobfuscate:
        return plain
    hidden = F.when(
        text.contains("[space]"),
        F.transform(
            find_all(text, PHONE_OBFUSCATED),
            lambda m: F.replace(F.replace(m, F.lit("[space]"), F.lit("")), F.lit(" "), F.lit("")),
        ),
    ).otherwise(empty_strings())
    return F.concat(plain, hidden)


def has_contact(text: Column | str) -> Column:
    """Whether a text holds an e-mail address or a phone number as written."""
    text = col(text)
    return (text.contains("@") & text.rlike(EMAIL)) | text.rlike(PHONE)


def social_links(html: Column | str, domains: Iterable[str] = fixed.SOCIAL_DOMAINS) -> Column:
    """Distinct link targets on social networks, sorted."""
    links = F.filter(
        F.transform(find_all(html, H.ANCHOR_TAG, 1), lambda tag: H.attribute(tag, "href")),
        lambda h: contains_any(h, domains),
    )
    return sorted_set(links)


def social_profiles(text: Column | str, hosts: Iterable[str] = fixed.SOCIAL_PROFILE_HOSTS) -> Column:
    """Distinct profile URLs in free text, sorted. The host dots match literally."""
    names = "|".join(h.replace(".", r"\.") for h in hosts)
    text = col(text)
    found = find_all(text, rf"https?://(?:www\.)?(?:{names})/[^{WS}'\"<>]+")
    return F.when(text.contains("://"), sorted_set(found)).otherwise(empty_strings())


def _ends_with_word(words: Iterable[str]) -> str:
    """One of the words. A greedy run before it gives back its characters one by one, and most of them begin no
    word: plain words are tried only at one of their first letters."""
    words = list(words)
    plain = words and all(re.fullmatch(r"[A-Za-z]{2,}\??", w) for w in words)
    heads = f"(?=[{''.join(sorted({w[0] for w in words}))}])" if plain else ""
    return f"{heads}(?:{'|'.join(words)})"


def _stem(word: str) -> str:
    return word.removesuffix("s?")


def business_names(text: Column | str, type_words: Iterable[str] = fixed.BUSINESS_WORDS) -> Column:
    """Distinct business names, sorted: a capitalised phrase that ends in a type word."""
    return sorted_set(_business_names(col(text), list(type_words)))


def _business_matches(text: Column, words: list[str]) -> Column:
    pattern = rf"{_run_start(_NAME_RUN)}[a-z0-9&{WS}'-]*+([A-Z][{_NAME_RUN}]+{_ends_with_word(words)})"
    return F.when(
        contains_any(text, [_stem(w) for w in words]), find_all(text, pattern, 1)
    ).otherwise(empty_strings())


def _business_names(text: Column, words: list[str]) -> Column:
    def clean(name: Column) -> Column:
        for suffix in (rf"Contact[{WS}]+Information", "About", "Home"):
            name = F.regexp_replace(name, rf"(?i)[{WS}]*[-\x{{2013}}][{WS}]*{suffix}[^\n]*", "")
        return collapse(name)

    return F.filter(F.transform(_business_matches(text, words), clean), lambda n: F.length(n) > 3)


def business_name(text: Column | str, type_words: Iterable[str] = fixed.BUSINESS_WORDS) -> Column:
    """Best business name of a text: the first match, else the title, the first heading, a phrase
    before "- Contact / About / Home", else a fixed default."""
    text = col(text)
    words = list(type_words)

    def tidy(names: Column) -> Column:
        flat = F.transform(
            names, lambda n: F.replace(F.replace(strip(n), F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" "))
        )
        return first_of(F.filter(flat, lambda n: F.length(n) > 3))

    label = (
        rf"{_run_start(_NAME_RUN)}[0-9&{WS}'-]*+([A-Za-z][{_NAME_RUN}]+)[{WS}]*"
        rf"[-\x{{2013}}][{WS}]*(?i:Contact|About|Home)"
    )
    labelled = F.when(
        text.rlike(rf"(?i)[-\x{{2013}}][{WS}]*(?:Contact|About|Home)"), find_all(text, label, 1)
    ).otherwise(empty_strings())
    titles = find_all(text, r"(?i)<title>([^<]+)</title>", 1)
    headings = find_all(text, r"(?i)<h1[^>]*>([^<]+)</h1>", 1)
    return F.coalesce(
        first_of(_business_names(text, words)),
        F.when(F.size(titles) > 0, F.coalesce(tidy(titles), F.lit(fixed.UNKNOWN_BUSINESS))),
        F.when(F.size(headings) > 0, F.coalesce(tidy(headings), F.lit(fixed.UNKNOWN_BUSINESS))),
        tidy(labelled),
        F.lit(fixed.UNKNOWN_BUSINESS),
    )


def _once_per_run(match: str, head: str, run: str) -> str:
    """``match``, or the whole rest of a run whose first head did not match (group 1 is empty)."""
    return rf"({match})|{head}[{run}]*+"


_STREET_HEAD = rf"[0-9]{{1,5}}[{WS}]"


def _street_pattern(words: Iterable[str], flags: str = "") -> str:
    body = rf"[0-9]{{1,5}}[{WS}]+[{_ADDRESS_RUN}]+{flags}{_ends_with_word(words)}"
    return _once_per_run(body, _STREET_HEAD, _ADDRESS_RUN)


def street_addresses(text: Column | str, street_words: Iterable[str] = fixed.STREET_WORDS) -> Column:
    """Distinct street addresses with their house number, sorted; short ones are dropped."""
    return sorted_set(_street_addresses(col(text), street_words))


def _street_addresses(text: Column, street_words: Iterable[str]) -> Column:
    found = F.when(
        text.rlike(_STREET_HEAD), find_all(text, _street_pattern(street_words), 1)
    ).otherwise(empty_strings())
    return F.filter(F.transform(found, collapse), lambda a: F.length(a) > 5)


def first_address(text: Column | str, street_words: Iterable[str] = fixed.STREET_WORDS) -> Column:
    """Labelled address, else street address, else address with a postal code; the first match of
    a form counts if it is longer than ten characters."""
    text = col(text)
    labelled = rf"(?i:Address)[:{WS}]*([^,\n]+(?:,[{WS}]*[^,\n]+)*+)"
    street = _street_pattern(street_words, "(?i)")
    postal = _once_per_run(
        rf"[0-9]{{1,5}}[{WS}]+[{_ADDRESS_RUN}]+,[{WS}]*[0-9]{{5}}[{WS}]+[A-Za-z{WS}]+,[{WS}]*[A-Za-z{WS}]+",
        _STREET_HEAD, _ADDRESS_RUN,
    )

    def long_enough(found: Column) -> Column:
        return let(collapse(found), lambda a: F.when(F.length(a) > 10, a))

    def first_match(pattern: str) -> Column:
        return long_enough(first_of(F.filter(find_all(text, pattern, 1), lambda m: m != "")))

    return F.coalesce(
        long_enough(F.regexp_extract(text, labelled, 1)),
        F.when(text.rlike(_STREET_HEAD), F.coalesce(first_match(street), first_match(postal))),
    )


_POSTAL_RUN = rf"{WORD} .,-"
POSTAL_ADDRESS_PLAIN = rf"\p{{Nd}}{{1,5}} [{_POSTAL_RUN}]+,? [{_POSTAL_RUN}]+,? [A-Z]{{2,}} ?\p{{Nd}}{{3,6}}"
# Commas and blanks are themselves in the class, so the two middle parts are "any text with an
# inner blank"; naming the first inner blank leaves a single part that can backtrack.
POSTAL_ADDRESS = _once_per_run(
    rf"\p{{Nd}}{{1,5}} [{_POSTAL_RUN}][{WORD}.,-]*+ [{_POSTAL_RUN}]+ [A-Z]{{2,}} ?\p{{Nd}}{{3,6}}",
    r"\p{Nd}{1,5} ", _POSTAL_RUN,
)


def physical_addresses(html: Column | str) -> Column:
    """Distinct addresses of a page, sorted: from JSON-LD, and by a house number to postal code
    pattern over the source."""
    html = col(html)

    def from_item(item: Column) -> Column:
        parts = [
            blank_to_null(F.get_json_object(item, f"$.address.{part}")) for part in fixed.ADDRESS_PARTS
        ]
        whole = F.get_json_object(item, "$.address")
        joined = F.when(whole.startswith("{"), F.concat_ws(", ", *parts)).otherwise(whole)
        return blank_to_null(F.when(_is_place(item), joined))

    structured = F.filter(
        F.transform(H.jsonld_blocks(html), from_item), lambda a: a.isNotNull()
    )
    by_pattern = F.filter(find_all(html, POSTAL_ADDRESS, 1), lambda a: a != "")
    return sorted_set(F.concat(structured, by_pattern))


def _is_place(item: Column) -> Column:
    kind = F.coalesce(F.get_json_object(item, "$['@type']"), F.lit(""))
    return item.startswith("{") & kind.isin(fixed.PLACE_TYPES_JSONLD)


def organization_name(html: Column | str) -> Column:
    """Name in JSON-LD, else page title, else og:site_name, else NULL."""
    html = col(html)
    names = F.transform(
        H.jsonld_blocks(html), lambda b: F.when(_is_place(b), F.get_json_object(b, "$.name"))
    )
    return F.coalesce(
        first_of(F.filter(names, lambda n: n.isNotNull())),
        H.title_tag(html),
        blank_to_null(strip(H.meta_content(html, "property", "og:site_name"))),
    )


def job_titles(text: Column | str, titles: Iterable[str] = fixed.JOB_TITLES) -> Column:
    """Distinct job titles as written, sorted."""
    pattern = rf"(?i)(?<![{WORD}])(?:{'|'.join(titles)})(?![{WORD}])"
    return sorted_set(F.transform(find_all(text, pattern), strip))


def first_website(text: Column | str) -> Column:
    """First http(s) origin in the text, NULL if there is none."""
    text = col(text)
    return F.when(text.contains("://"), find_first(text, r"https?://(?:www\.)?[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"))


# --- people --------------------------------------------------------------------------------
_PERSON = rf"[A-Z][a-zA-Z{WS}]+"


def _is_name(name: Column, barred: Iterable[str] = ("information",)) -> Column:
    ok = F.length(name) > 2
    for word in barred:
        ok = ok & ~F.lower(name).startswith(word)
    return ok


def role_person(text: Column | str) -> Column:
    """First name next to a role word ("Manager: ..." before "...: Manager"), or NULL."""
    text = col(text)
    spaced = F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" "))
    after = rf"(?:{'|'.join(fixed.ROLES_BEFORE_NAME)})[:{WS}]*({_PERSON})"
    # the first capital of a run of letters and blanks matches whenever a later one does
    before = (
        rf"{_run_start(rf'a-zA-Z{WS}')}[a-z{WS}]*+({_PERSON})[:{WS}]*(?:{'|'.join(fixed.ROLES_AFTER_NAME)})"
    )

    def first_name(pattern: str) -> Column:
        return first_of(F.filter(F.transform(find_all(spaced, pattern, 1), collapse), lambda n: _is_name(n)))

    return F.when(
        contains_any(text, fixed.ROLES_BEFORE_NAME), F.coalesce(first_name(after), first_name(before))
    )


def named_places(text: Column | str) -> Column:
    """Lines with the name each holds, and paragraphs with theirs. It does not depend on a contact, so it
    is computed once for a text."""
    text = col(text)
    labelled = rf"({_PERSON})[:{WS}]"
    lines = F.transform(
        F.split(text, "\n"),
        lambda l: F.struct(l.alias("part"), collapse(F.regexp_extract(l, labelled, 1)).alias("name")),
    )

    def names(p: Column) -> Column:
        return F.filter(
            F.transform(find_all(p, labelled, 1), collapse),
            lambda n: _is_name(n, ("information", "contact", "email", "phone")),
        )

    paragraphs = F.transform(
        F.split(text, "\n\n"), lambda p: F.struct(p.alias("part"), first_of(names(p)).alias("name"))
    )
    return F.struct(
        F.filter(lines, lambda l: _is_name(l["name"])).alias("lines"),
        F.filter(paragraphs, lambda p: p["name"].isNotNull()).alias("paragraphs"),
    )


def nearby_person(text: Column | str, contact: Column | str, places: Column | None = None) -> Column:
    """Name on the line of a contact, else in its paragraph, or NULL. ``places`` takes a computed
    :func:`named_places`."""
    contact = col(contact)

    def pick(found: Column) -> Column:
        return F.coalesce(*[
            first_of(F.filter(found[kind], lambda x: x["part"].contains(contact)))["name"] for kind in ("lines", "paragraphs")
        ])

    return pick(places) if places is not None else let(named_places(text), pick)


def contact_person(
    text: Column | str, contact: Column | str, by_role: Column | None = None, places: Column | None = None
) -> Column:
    """Name of the person behind a contact. ``by_role`` takes a computed :func:`role_person` and ``places``
    a computed :func:`named_places`, which do not depend on the contact."""
    by_role = role_person(text) if by_role is None else by_role
    return F.coalesce(by_role, nearby_person(text, contact, places), F.lit(fixed.UNKNOWN_CONTACT))


# --- pairs ---------------------------------------------------------------------------------
_EMAIL_PART = rf"[{_LOCAL}]++@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+"


def email_phone_pairs(text: Column | str) -> Column:
    """E-mail and phone that stand together: array of (email, phone).

    Three forms are looked for, in this order: "email: ..., phone: ...", the reverse, and the two
    next to each other. Only if none occurs, the i-th e-mail is paired with the i-th phone.
    """
    text = col(text)
    gap = rf"[^{_LOCAL}]*"
    # no e-mail and no phone holds the mark
    mark = "\x01"
    forms = [
        (rf"(?i:email)[:{WS}]*({_EMAIL_PART}){gap}(?i:phone)[:{WS}]*({PHONE})", f"$1{mark}$2"),
        (rf"(?i:phone)[:{WS}]*({PHONE}){gap}(?i:email)[:{WS}]*({_EMAIL_PART})", f"$2{mark}$1"),
        (rf"{_run_start(_LOCAL)}({_EMAIL_PART}){gap}({PHONE})", f"$1{mark}$2"),
    ]

    def zipped(emails: Column, phones: Column) -> Column:
        return F.transform(
            F.arrays_zip(emails.alias("email"), phones.alias("phone")),
            lambda p: F.struct(strip(p["email"]).alias("email"), strip(p["phone"]).alias("phone")),
        )

    def parted(pattern: str, parts: str) -> Column:
        """The text is searched once; a match, which alone matches as it did there, is taken apart."""
        split = F.transform(find_all(text, pattern), lambda m: F.split(F.regexp_replace(m, pattern, parts), mark))
        return F.transform(split, lambda p: F.struct(strip(p[0]).alias("email"), strip(p[1]).alias("phone")))

    adjacent = F.concat(*[parted(p, parts) for p, parts in forms])

    def by_position() -> Column:
        return F.filter(
            zipped(_emails(text), _phones(text)), lambda p: p["email"].isNotNull() & p["phone"].isNotNull()
        )

    pairs = let(adjacent, lambda a: F.when(F.size(a) > 0, a).otherwise(by_position()))
    none = F.array().cast("array<struct<email:string,phone:string>>")
    return F.when(text.contains("@"), pairs).otherwise(none)


def lead_type(text: Column | str, name: Column | str) -> Column:
    """Kind of business, judged by its name first and by the text second."""
    by_text = first_category(F.lower(col(text)), fixed.LEAD_TYPE_BY_TEXT, "unknown")
    return first_category(F.lower(col(name)), fixed.LEAD_TYPE_BY_NAME, by_text)
