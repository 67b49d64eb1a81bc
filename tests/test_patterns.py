"""Guarded patterns against the plain patterns they stand for, on texts made to be awkward."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from gleaner.functions import classify as K, contacts as C, html as H, text as T
from gleaner.operators import frontier as Q

# fixed values: the plain patterns
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE = r"\+?\d[\d\s().-]{7,}\d"
STREETS = (
    "Street|Avenue|Road|Boulevard|Lane|Drive|Place|Court|Way|Terrace|Close|Crescent|Grove|Square|Gardens|Heights|Manor|Villa|"
    "Apartment|Suite|Floor|Building|Center|Centre|Plaza|Mall|Complex|District|Area|Zone|City|Town|Village|County|State|"
    "Province|Country|Postal|Zip|Code"
)
STREET = rf"\d{{1,5}}\s+[A-Za-z0-9.,'\-\s]+(?:{STREETS})"
NAME = (
    r"[A-Z][a-zA-Z0-9&\s'-]+(?:Hotel|Resort|Tours?|Travel|Restaurant|Cafe|Agency|Lodge|Inn|Guesthouse|Accommodation|Booking|"
    r"Reservation)"
)
POSTAL = r"\d{1,5} [\w .,-]+,? [\w .,-]+,? [A-Z]{2,} ?\d{3,6}"
LABELLED = r"([A-Z][a-zA-Z0-9&\s'-]+)\s*[-–]\s*(?:Contact|About|Home)"
PIECES = [
    "a@b.co", "x_y+z@host.example.com", "@", "a@b", ".com_x", "+91 98765 43210", "(040) 1234-5678", "12", "123456", "7", "Main",
    "Street", "road", "Grand", "Hotel", "Inn", "inn", "Tours", "Manager", "Contact", ": ", " - ", "–", "About", "\n", "\n\n", " ", "  ",
    "\t", ",", ".", ";", "'", "&", "-", "email", "phone", "Email:", "PHONE:", "KA 560001", "MH", "Address:", "é", "Ünal", " ", " ",
    "Jean Dubois", "information", "_", "<", ">", "don't", "A1",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    made = ["".join(rng.choice(PIECES) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    return [*made, "", " ", "\n"]


def squeeze(s):
    return re.sub(r"\s+", " ", s).strip()


def check(one, texts, column, expected):
    got = one(column, texts)
    for t, g in zip(texts, got):
        assert g == expected(t), repr(t)


def test_emails(one, texts):
    check(one, texts, C._emails(F.col("t")), lambda t: re.findall(EMAIL, t))


def test_phones(one, texts):
    check(one, texts, C._phones(F.col("t")), lambda t: re.findall(PHONE, t))


def test_streets(one, texts):
    check(
        one, texts, C.street_addresses("t"),
        lambda t: sorted({s for s in (squeeze(m) for m in re.findall(STREET, t)) if len(s) > 5}),
    )


def test_business_names(one, texts):
    check(one, texts, C._business_matches(F.col("t"), C.fixed.BUSINESS_WORDS), lambda t: re.findall(NAME, t))


def test_postal_addresses(one, texts):
    found = F.filter(C.find_all("t", C.POSTAL_ADDRESS, 1), lambda a: a != "")
    check(one, texts, found, lambda t: re.findall(POSTAL, t))


@pytest.mark.parametrize("text, name", [
    ("Grand Hotel - Contact Information here", "Grand Hotel"),
    ("we like Palm  Tours", "Palm Tours"),
    ("Sea View Inn - About us. Hill Lodge", "Sea View Inn"),
    ("Ocean House - Contact", "Ocean House"),
    ("Ocean House – Home", "Ocean House"),
    ("Abc - About", "Unknown Business"),
    ("nothing here", "Unknown Business"),
    ("", "Unknown Business"),
])
def test_labelled_name(one, text, name):
    assert one(C.business_name("t"), [text]) == [name]


@pytest.mark.parametrize("text, pairs", [
    ("Email: a@b.co, Phone: +91 98765 43210", [("a@b.co", "+91 98765 43210")]),
    ("EMAIL a@b.co PHONE 12345 67890", [("a@b.co", "12345 67890")]),
    ("Phone: 040 1234-5678; email: a@b.co", [("a@b.co", "040 1234-5678")]),
    ("a@b.co 12345 67890", [("a@b.co", "12345 67890")]),
    # labelled both ways: first the pairs that begin with an e-mail, then those that begin with a phone
    (
        "Email: a@b.co Phone: 12345 67890 Email: c@d.org Phone: 99999 88888",
        [("a@b.co", "12345 67890"), ("c@d.org", "99999 88888"), ("c@d.org", "12345 67890")],
    ),
    # nothing stands together: in order of occurrence
    ("a@b.co or 12345 67890 or c@d.org", [("a@b.co", "12345 67890")]),
    ("call 12345 67890 then a@b.co", [("a@b.co", "12345 67890")]),
    ("write a@b.co. Call 12345 67890", [("a@b.co.", "12345 67890")]),
    ("no contact", []),
    ("", []),
])
def test_pairs(one, text, pairs):
    assert [tuple(p) for p in one(C.email_phone_pairs("t"), [text])[0]] == pairs


@pytest.mark.parametrize("text, address", [
    ("Address: 12 Main Street, Springfield\nmore", "12 Main Street, Springfield"),
    ("address 4 Hill Road", "4 Hill Road"),
    ("Address:\n77 Long Avenue, Bigtown", "77 Long Avenue, Bigtown"),
    ("Address: here. We sit at 12 Main Street now", "here. We sit at 12 Main Street now"),
    ("Address: short, 221 Baker  Street", "short, 221 Baker Street"),
    ("Address: short\n221 Baker  Street today", "221 Baker Street"),
    ("7 oak street", "7 oak street"),
    ("10 Rue X, 75001 Paris, France", "10 Rue X, 75001 Paris, France"),
    ("Address: short", None),
    ("at 5 a Lane", None),
    ("", None),
])
def test_first_address(one, text, address):
    assert one(C.first_address("t"), [text]) == [address]


@pytest.mark.parametrize("text, name", [
    ("Manager: Jean Dubois, a@b.co", "Jean Dubois"),
    ("Owner Ada Lane; a@b.co", "Ada Lane"),
    ("Jean Dubois, writes a@b.co", "Jean"),
    ("Ada Lane: a@b.co", "Ada Lane"),
    ("first line\nAda Lane: a@b.co\nlast", "Ada Lane"),
    ("x a@b.co\n(Ada Lane: head)", "Ada Lane"),
    ("nobody a@b.co", "Unknown Contact"),
    ("", "Unknown Contact"),
])
def test_contact_person(one, text, name):
    assert one(C.contact_person("t", F.lit("a@b.co")), [text]) == [name]


def test_whitespace(one, texts):
    check(
        one, [*texts, "a᠎b \x1c c\x85d"], T.clean_whitespace("t"),
        lambda t: re.sub("[​‌‍﻿]", "", re.sub(r"\s+", " ", t)).strip(),
    )


@pytest.mark.parametrize("text, words", [
    ("tour tour Hotel hotel hotel sea", ["hotel", "tour"]),
    ("beta alpha beta alpha gamma", ["beta", "alpha", "gamma"]),
    ("one two six", []),
    ("", []),
    ("don't école école", ["école"]),
    (" ".join(f"word{i}" for i in range(12)), [f"word{i}" for i in range(10)]),
])
def test_keywords(one, text, words):
    assert one(K.keywords("t"), [text]) == [words]
    assert one(K.keyword_runs("t"), [text]) == one(K.keyword_counts("t"), [text])


HOSTILE = {
    "letters": "a" * 200_000, "words": "Word " * 40_000, "digits": "1 " * 100_000, "heads": "12 Main " * 25_000, "blanks": " " * 200_000,
    "tags": "<b " * 60_000, "open": "<" * 200_000, "dashes": "A- " * 60_000, "commas": "Address a" + ", b" * 60_000, "at": "a@" * 100_000,
    "links": "<a href=x>" * 20_000, "comments": "<!-- x " * 30_000, "scripts": "<script x " * 20_000,
    "entities": "&amp;" * 40_000, "forms": "<form action=" * 15_000, "hashes": "&#0000064;" * 20_000, "postal": "12 a b " * 25_000,
}


@pytest.mark.parametrize("kind", list(HOSTILE))
def test_hostile_text_stays_linear(one, kind):
    start = time.monotonic()
    one(
        F.struct(
            C.extract_emails("t", True), C.extract_phones("t", True), C.business_name("t"), C.first_address("t"), C.street_addresses("t"),
            C.physical_addresses("t"), C.role_person("t"), C.job_titles("t"), C.email_phone_pairs("t"), T.html_to_text("t"),
            T.clean_whitespace("t"), H.outlinks("t"), H.anchors("t"), H.page_title("t"), H.jsonld_items("t"),
            H.has_contact_form("t"), H.page_meta("t"), H.microdata("t"), K.keyword_runs("t"), Q._robots_groups("t"),
        ),
        [HOSTILE[kind]],
    )
    assert time.monotonic() - start < 30


@pytest.mark.parametrize("column, piece", [
    (lambda: H.page_meta("t"), "<meta name=n{0} content=c>"), (lambda: H.page_meta("t"), "<meta name=same content=c{0}>"),
    (lambda: H.microdata("t"), "<p itemtype=x a{0}=b>"), (lambda: F.size(H.microdata("t")[0]["properties"]), " a{0}=b"),
    (lambda: Q._robots_groups("t"), "User-agent: a{0}\nDisallow: /{0}\n"), (lambda: Q._robots_groups("t"), "User-agent: a{0}\n"),
    (lambda: K.keyword_runs("t"), "word{0} "), (lambda: T.html_unescape("t"), "&amp;{0}&eacute;"), (lambda: H.page_title("t"), "<nav>{0}<p>"), (lambda: C.email_phone_pairs("t"), "a{0}@b.co "),
])
def test_time_grows_with_the_text(one, column, piece):
    """Four times the text, far less than sixteen times the time."""
    def seconds(n):
        text = "".join(piece.format(i) for i in range(n))
        start = time.monotonic()
        one(column(), [f"<p itemtype=x {text}>" if piece.startswith(" a") else text])
        return time.monotonic() - start

    seconds(10)
    small, large = min(seconds(4_000) for _ in range(2)), seconds(16_000)
    assert large < 8 * max(small, 0.5)


@pytest.mark.parametrize("source, text", [
    ("&#0000000064; &#x00000040;", "@ @"), ("info&commat;a&period;com", "info@a.com"), ("&copy 2020 &amp", "© 2020 &"), ("it&#146;s", "it’s"),
    ("&notit; &nosuch; &#x110000; &#99999999999999999999;", "¬it; &nosuch; \ufffd \ufffd"), ("a & b &; &#; &#x;", "a & b &; &#; &#x;"),
])
def test_character_references(one, source, text):
    assert one(T.html_unescape("t"), [source]) == [text]


@pytest.mark.parametrize("xml, found", [
    ("<loc> http://a/ </loc><loc x='1'>http://b/?c&amp;d</loc>", ["http://a/", "http://b/?c&d"]),
    ("<loc><![CDATA[http://a/?x&y]]></loc><loc></loc>", ["http://a/?x&y"]), ("<loc>open", []),
])
def test_sitemap_locations(one, xml, found):
    assert one(H.sitemap_locations("t"), [xml]) == [found]


@pytest.mark.parametrize("html, there", [
    ("<form action='/contact'>", True), ("<FORM method=post ACTION=/Contact-us", True), ("<form action=/a><p>contact", False),
    ("<form data-contact action=/a>", False), ("", False),
])
def test_contact_form(one, html, there):
    assert one(H.has_contact_form("t"), [html]) == [there]


@pytest.mark.parametrize("html, text", [
    ("<div><nav>menu</div><main>real text</main>", "real text"), ("<div><form><p>x</div><div>much more text</div>", "much more text"),
    ("<main>a<nav>m<nav>n</nav>o</nav>b</main>c", "a b"), ("<body>x<nav>m", "x"), ("<nav>m</nav></main>y<br/>z", "y z"), ("", ""),
])
def test_main_text(html, text):
    from gleaner.operators.pages import _main_text

    assert _main_text(html) == text
