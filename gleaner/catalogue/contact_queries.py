"""Contacts in texts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.catalogue import inputs as I, sql as S
from gleaner.catalogue.registry import query, table
from gleaner.functions import contacts as C, fixed, html as H
from gleaner.operators import contacts as X

# the given documents and the business notes, as one text table
TEXTS_SQL = f"SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + 1000000000 AS doc_id, text FROM ({I.NOTES_SQL}) n"
_T = f"({TEXTS_SQL}) t"
_PAGES = f"({I.ALL_PAGES_SQL}) p"
WS = S.WS


def texts(spark, sf):
    made = I.notes(spark, sf).select((F.col("doc_id") + 1000000000).alias("doc_id"), "text")
    return table(spark, sf, "documents").select("doc_id", "text").union(made)


def _rows(values: str, source: str = _T, key: str = "doc_id") -> str:
    return f"SELECT DISTINCT {key}, value FROM (SELECT {key}, unnest({values}) AS value FROM {source}) v"


def _exploded(df, values, key="doc_id"):
    return df.select(key, F.explode(values).alias("value"))


_OBFUSCATED = rf"(?i)([a-zA-Z0-9_.+-]+)[{WS}]*\[at\][{WS}]*([a-zA-Z0-9-]+)[{WS}]*\[dot\][{WS}]*([a-zA-Z0-9.-]+)"
_OBF_PHONE = rf"\+?[0-9]{{1,3}}[{WS}]*\[space\][{WS}]*[0-9]{{3,5}}[{WS}]*\[space\][{WS}]*[0-9]{{3,5}}"
_HIDDEN_EMAILS = f"list_transform({S.every('text', _OBFUSCATED)}, lambda x: regexp_replace(x, {S.q(_OBFUSCATED)}, '\\1@\\2.\\3'))"
_HIDDEN_PHONES = f"list_transform({S.every('text', _OBF_PHONE)}, lambda x: replace(replace(x, '[space]', ''), ' ', ''))"
_EMAILS = S.every("text", S.EMAIL)
_PHONES = S.every("text", S.PHONE)


@query("emails", _rows(_EMAILS))
def _(spark, sf):
    return _exploded(texts(spark, sf), C.extract_emails("text"))


@query("emails_deobfuscated", _rows(f"list_concat({_EMAILS}, {_HIDDEN_EMAILS})"))
def _(spark, sf):
    return _exploded(texts(spark, sf), C.extract_emails("text", deobfuscate=True))


@query("phones", _rows(_PHONES))
def _(spark, sf):
    return _exploded(texts(spark, sf), C.extract_phones("text"))


@query("phones_deobfuscated", _rows(f"list_concat({_PHONES}, {_HIDDEN_PHONES})"))
def _(spark, sf):
    return _exploded(texts(spark, sf), C.extract_phones("text", deobfuscate=True))


_HREFS = f"list_transform({S.every('html', r'(?is)<a[\s/]([^>]*)>', 1)}, lambda x: {S.attr('x', 'href')})"


@query(
    "social_links",
    _rows(f"list_filter({_HREFS}, lambda x: {S.any_of('x', fixed.SOCIAL_DOMAINS)})", _PAGES, "page_id"),
)
def _(spark, sf):
    return _exploded(I.all_pages(spark, sf), C.social_links("html"), "page_id")


_PROFILE = rf"""https?://(?:www\.)?(?:facebook\.com|instagram\.com|twitter\.com|linkedin\.com)/[^{WS}'"<>]+"""


@query("social_profiles", _rows(S.every("text", _PROFILE)))
def _(spark, sf):
    return _exploded(texts(spark, sf), C.social_profiles("text"))


# links of the business pages start with "/" or are not about contacts; all are of one site
_ANCHOR = r"(?is)<a[\s/]([^>]*)>(.*?)</a\s*>"
_CONTACT_LINKS = f"""SELECT DISTINCT url AS base_url, regexp_extract(url, '^https?://[^/]+', 0) || href AS contact_url FROM
    (SELECT url, {S.attr('a[1]', 'href')} AS href, lower({S.text_of('a[2]')}) AS label FROM
      (SELECT url, unnest(list_zip({S.every('html', _ANCHOR, 1)}, {S.every('html', _ANCHOR, 2)})) AS a FROM %s) x) y
    WHERE contains(lower(href), 'contact') OR contains(label, 'contact')"""


@query("contact_page_links", _CONTACT_LINKS % _PAGES)
def _(spark, sf):
    return X.contact_links(I.all_pages(spark, sf))


@query(
    "harvested_contacts",
    f"""WITH e AS ({_CONTACT_LINKS % f'({I.SITE_PAGES_SQL}) s'}),
    c AS (SELECT url, 'email' AS kind, unnest(list_concat({_EMAILS.replace('text', 'html')}, {_HIDDEN_EMAILS.replace('(text', '(html')})) AS value FROM ({I.SITE_PAGES_SQL}) s
      UNION ALL SELECT url, 'phone' AS kind, unnest(list_concat({_PHONES.replace('text', 'html')}, {_HIDDEN_PHONES.replace('(text', '(html')})) AS value FROM ({I.SITE_PAGES_SQL}) s)
    SELECT DISTINCT base_url, kind, value FROM e JOIN c ON e.contact_url = c.url""",
)
def _(spark, sf):
    return X.harvest_contacts(I.site_pages(spark, sf))


@query("business_names", _rows(S.business_names("text")))
def _(spark, sf):
    return _exploded(texts(spark, sf), C.business_names("text"))


_LABELLED = rf"(?i)([A-Z][{S.NAME_RUN}]+)[{WS}]*[-\x{{2013}}][{WS}]*(?:Contact|About|Home)"


def _tidy(names: str) -> str:
    return (
        f"list_filter(list_transform({names}, lambda x: replace(replace({S.strip('x')}, chr(10), ' '), '  ', ' ')), "
        "lambda x: length(x) > 3)[1]"
    )


def business_name(text: str) -> str:
    titles = S.every(text, "(?i)<title>([^<]+)</title>", 1)
    heads = S.every(text, "(?i)<h1[^>]*>([^<]+)</h1>", 1)
    return (
        f"coalesce({S.business_names(text)}[1], CASE WHEN len({titles}) > 0 THEN coalesce({_tidy(titles)}, 'Unknown Business') END, "
        f"CASE WHEN len({heads}) > 0 THEN coalesce({_tidy(heads)}, 'Unknown Business') END, "
        f"{_tidy(S.every(text, _LABELLED, 1))}, 'Unknown Business')"
    )


@query(
    "business_name_choice",
    f"SELECT 'text' AS part, doc_id AS id, {business_name('text')} AS name FROM {_T} UNION ALL "
    f"SELECT 'html' AS part, page_id AS id, {business_name('html')} AS name FROM {_PAGES}",
)
def _(spark, sf):
    from_text = texts(spark, sf).select(
        F.lit("text").alias("part"), F.col("doc_id").alias("id"), C.business_name("text").alias("name")
    )
    from_html = I.all_pages(spark, sf).select(
        F.lit("html").alias("part"), F.col("page_id").alias("id"), C.business_name("html").alias("name")
    )
    return from_text.union(from_html)


_STREETS = f"list_filter(list_transform({S.every('text', S.STREET)}, lambda x: {S.squeeze('x')}), lambda x: length(x) > 5)"


@query("street_addresses", _rows(_STREETS))
def _(spark, sf):
    return _exploded(texts(spark, sf), C.street_addresses("text"))


def first_address(text: str) -> str:
    forms = [
        rf"(?i)Address[:{WS}]*([^,\n]+(?:,[{WS}]*[^,\n]+)*)",
        rf"(?i)({S.STREET})",
        rf"(?i)([0-9]{{1,5}}[{WS}]+[A-Za-z0-9.,'{WS}-]+,[{WS}]*[0-9]{{5}}[{WS}]+[A-Za-z{WS}]+,[{WS}]*[A-Za-z{WS}]+)",
    ]
    tries = [S.squeeze(f"regexp_extract({text}, {S.q(f)}, 1)") for f in forms]
    return f"coalesce({', '.join(f'CASE WHEN length({t}) > 10 THEN {t} END' for t in tries)})"


@query("first_address", f"SELECT doc_id, coalesce({first_address('text')}, '') AS address FROM {_T}")
def _(spark, sf):
    return texts(spark, sf).select("doc_id", F.coalesce(C.first_address("text"), F.lit("")).alias("address"))


_LD = (
    r"(?is)<script\b[^>]*?\btype\s*=\s*[\"']?application/ld\+json\b[^>]*>(.*?)</script\s*>"
)
_LD_ROWS = f"""SELECT page_id, b FROM (SELECT page_id, unnest({S.every('html', _LD, 1)}) AS b FROM {_PAGES}) x
    WHERE json_valid(b) AND starts_with(b, '{{') AND json_extract_string(b, '$."@type"') IN ('Organization', 'LocalBusiness', 'Place', 'Hotel')"""
_ADDRESS_PARTS = ", ".join(
    f"nullif(json_extract_string(b, '$.address.{p}'), '')" for p in fixed.ADDRESS_PARTS
)
_POSTAL = r"[0-9]{1,5} [\p{L}\p{N}_ .,-]+,? [\p{L}\p{N}_ .,-]+,? [A-Z]{2,} ?[0-9]{3,6}"


@query(
    "physical_addresses",
    f"""SELECT DISTINCT page_id, value FROM (
      SELECT page_id, CASE WHEN json_type(b, '$.address') = 'OBJECT' THEN concat_ws(', ', {_ADDRESS_PARTS})
        ELSE json_extract_string(b, '$.address') END AS value FROM ({_LD_ROWS}) r
      UNION ALL SELECT page_id, unnest({S.every('html', _POSTAL)}) AS value FROM {_PAGES}) z WHERE coalesce(value, '') <> ''""",
)
def _(spark, sf):
    return _exploded(I.all_pages(spark, sf), C.physical_addresses("html"), "page_id")


_TITLE = f"nullif({S.squeeze(S.text_of(f'regexp_extract(html, {S.q(r"(?is)<title\b[^>]*>(.*?)</title\s*>")}, 1)'))}, '')"
_SITE = S.attr(
    f"list_filter({S.every('html', r'(?is)<meta[\s/]([^>]*)>', 1)}, lambda x: {S.attr('x', 'property')} = 'og:site_name')[1]",
    "content",
)


@query(
    "organization_name",
    f"""SELECT p.page_id, coalesce(json_extract_string(b, '$.name'), {_TITLE}, {_SITE}) AS name
    FROM {_PAGES} LEFT JOIN ({_LD_ROWS}) r ON p.page_id = r.page_id""",
)
def _(spark, sf):
    return I.all_pages(spark, sf).select("page_id", C.organization_name("html").alias("name"))


# the checking engine's word boundary is ASCII only, so other letters are masked first
_MASKED = S.sub("text", r"[\x{80}-\x{10FFFF}]", "_")
_JOBS = r"(?i)\b(?:CEO|Founder|Owner|Manager|Director|President|Principal|Partner|Head|Lead|Chairman|Chief [A-Za-z ]+|[A-Za-z]+ Officer)\b"


@query("job_titles", _rows(f"list_transform({S.every(_MASKED, _JOBS)}, lambda x: trim(x))"))
def _(spark, sf):
    # masked on both sides: punctuation beyond ASCII is no word character, a letter is
    masked = texts(spark, sf).withColumn("text", F.regexp_replace("text", r"[\x{80}-\x{10FFFF}]", "_"))
    return _exploded(masked, C.job_titles("text"))


@query(
    "contact_form_flag",
    f"SELECT page_id, regexp_matches(html, '(?i)<form[^>]*action=[^>]*contact') AS has_contact_form FROM {_PAGES}",
)
def _(spark, sf):
    return I.all_pages(spark, sf).select("page_id", H.has_contact_form("html").alias("has_contact_form"))


def first_website(text: str) -> str:
    return f"nullif(regexp_extract({text}, 'https?://(?:www\\.)?[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}', 0), '')"


@query("first_website", f"SELECT doc_id, coalesce({first_website('text')}, '') AS website FROM {_T}")
def _(spark, sf):
    return texts(spark, sf).select("doc_id", F.coalesce(C.first_website("text"), F.lit("")).alias("website"))


def _names(matches: str, barred: tuple[str, ...] = ("information",)) -> str:
    no = " ".join(f"AND NOT starts_with(lower(x), '{b}')" for b in barred)
    return f"list_filter(list_transform({matches}, lambda x: {S.squeeze('x')}), lambda x: length(x) > 2 {no})"


_PERSON = rf"[A-Z][a-zA-Z{WS}]+"


def contact_person(text: str, contact: str) -> str:
    spaced = f"replace(replace({text}, chr(10), ' '), '  ', ' ')"
    after = rf"(?:Manager|Contact|Director|Owner|Chef|Guide)[:{WS}]*({_PERSON})"
    before = rf"({_PERSON})[:{WS}]*(?:Manager|Contact|Director|Owner)"
    label = rf"({_PERSON})[:{WS}]"
    lines = f"list_filter(string_split({text}, chr(10)), lambda l: contains(l, {contact}))"
    on_line = _names(f"list_transform({lines}, lambda l: regexp_extract(l, {S.q(label)}, 1))")
    paragraphs = f"list_filter(string_split({text}, chr(10) || chr(10)), lambda l: contains(l, {contact}))"
    in_par = _names(
        f"flatten(list_transform({paragraphs}, lambda l: {S.every('l', label, 1)}))",
        ("information", "contact", "email", "phone"),
    )
    return (
        f"coalesce({_names(S.every(spaced, after, 1))}[1], {_names(S.every(spaced, before, 1))}[1], "
        f"{on_line}[1], {in_par}[1], 'Unknown Contact')"
    )


@query(
    "contact_person",
    f"""SELECT doc_id, contact, {contact_person('text', 'contact')} AS person FROM
    (SELECT DISTINCT doc_id, text, unnest({_EMAILS}) AS contact FROM {_T}) e""",
)
def _(spark, sf):
    return X.contact_people(texts(spark, sf))


_GAP = "[^a-zA-Z0-9_.+-]*"
_PAIR_FORMS = [
    (rf"(?i)email[:{WS}]*({S.EMAIL}){_GAP}phone[:{WS}]*({S.PHONE})", 1, 2),
    (rf"(?i)phone[:{WS}]*({S.PHONE}){_GAP}email[:{WS}]*({S.EMAIL})", 2, 1),
    (rf"(?i)({S.EMAIL}){_GAP}({S.PHONE})", 1, 2),
]


def _zip(emails: str, phones: str) -> str:
    return (
        f"list_transform(list_zip({emails}, {phones}), "
        f"lambda x: {{'email': {S.strip('x[1]')}, 'phone': {S.strip('x[2]')}}})"
    )


def pairs(text: str) -> str:
    near = "list_concat(" + ", ".join(
        _zip(S.every(text, f, e), S.every(text, f, p)) for f, e, p in _PAIR_FORMS
    ) + ")"
    zipped = f"list_filter({_zip(S.every(text, S.EMAIL), S.every(text, S.PHONE))}, lambda x: x.email IS NOT NULL AND x.phone IS NOT NULL)"
    return f"CASE WHEN len({near}) > 0 THEN {near} ELSE {zipped} END"


PAIR_ROWS_SQL = f"""SELECT doc_id, i - 1 AS seq, p.email AS email, p.phone AS phone FROM
    (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, {pairs('text')} AS ps FROM {_T}) a) b"""


@query("email_phone_pairs", PAIR_ROWS_SQL)
def _(spark, sf):
    out = X.contact_pairs(texts(spark, sf))
    return out.withColumn("seq", F.col("seq").cast("bigint"))


@query(
    "pattern_bundle",
    f"""SELECT doc_id, array_to_string(list_sort(list_distinct({_EMAILS})), '|') AS emails,
    array_to_string(list_sort(list_distinct({_PHONES})), '|') AS phones,
    array_to_string(list_sort(list_distinct({_STREETS})), '|') AS addresses,
    array_to_string(list_sort(list_distinct({S.business_names('text')})), '|') AS business_names,
    array_to_string(list_sort(list_distinct({S.every('text', _PROFILE)})), '|') AS social_profiles,
    regexp_matches(text, '(?i)<form[^>]*action=[^>]*contact') AS has_contact_form FROM {_T}""",
)
def _(spark, sf):
    out = X.extract_patterns(texts(spark, sf))
    arrays = ["emails", "phones", "addresses", "business_names", "social_profiles"]
    return out.select("doc_id", *[F.array_join(a, "|").alias(a) for a in arrays], "has_contact_form")


def _kind(kind: str, values: str) -> str:
    return f"SELECT DISTINCT doc_id, '{kind}' AS kind, unnest({values}) AS value FROM {_T}"


@query(
    "contact_table",
    " UNION ALL ".join([
        _kind("email", f"list_concat({_EMAILS}, {_HIDDEN_EMAILS})"),
        _kind("phone", f"list_concat({_PHONES}, {_HIDDEN_PHONES})"),
        _kind("business_name", S.business_names("text")),
        _kind("address", _STREETS),
        _kind("social_profile", S.every("text", _PROFILE)),
        _kind("job_title", f"list_transform({S.every(_MASKED, _JOBS)}, lambda x: trim(x))"),
    ]),
)
def _(spark, sf):
    return X.extract_contacts(texts(spark, sf))
