"""Contact jobs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import contacts as C, fixed, html as H, urls as U
from gleaner.functions.common import col, let
from gleaner.operators.skew import salted_join
from gleaner.session import materialize


def _tagged(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def extract_contacts(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    deobfuscate: bool = True,
    type_words: Iterable[str] = fixed.BUSINESS_WORDS,
) -> DataFrame:
    """Long table (key, kind, value) of everything found in a text, in one scan and no shuffle."""
    found = F.concat(
        _tagged("email", C.extract_emails(text, deobfuscate)),
        _tagged("phone", C.extract_phones(text, deobfuscate)),
        _tagged("business_name", C.business_names(text, type_words)),
        _tagged("address", C.street_addresses(text)),
        _tagged("social_profile", C.social_profiles(text)),
        _tagged("job_title", C.job_titles(text)),
    )
    return docs.select(key, F.explode(found).alias("c")).select(key, "c.kind", "c.value")


def extract_patterns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with all pattern arrays; empty arrays for empty text."""
    body = F.coalesce(col(text), F.lit(""))
    return docs.select(
        key,
        C.extract_emails(body).alias("emails"),
        C.extract_phones(body).alias("phones"),
        C.street_addresses(body).alias("addresses"),
        C.business_names(body).alias("business_names"),
        C.social_profiles(body).alias("social_profiles"),
        H.has_contact_form(body).alias("has_contact_form"),
    )


def contact_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct (base_url, contact_url): links whose target or text holds "contact"."""
    links = F.filter(
        H.anchors(html, "contact"),
        lambda a: F.lower(a["href"]).contains("contact") | F.lower(a["text"]).contains("contact"),
    )
    targets = F.array_distinct(F.transform(links, lambda a: a["href"]))
    return (
        pages.select(F.col(url).alias("base_url"), F.explode(targets).alias("href"))
        .select("base_url", U.resolve_url("base_url", "href").alias("contact_url"))
        .distinct()
    )


def harvest_contacts(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct (base_url, kind, value): e-mails and phones on the contact pages of each page.

    The linked pages are looked up in the same snapshot. Contacts are extracted before the join, so
    the join moves addresses and not page sources; the rows stay long, so a base with very many
    contacts never becomes one group. Edges are written once and joined from there: page sources are read
    twice, for links and for contacts.
    """
    edges = materialize(contact_links(pages, url, html), "contact-links")
    found = F.concat(
        _tagged("email", C.extract_emails(html, deobfuscate=True)),
        _tagged("phone", C.extract_phones(html, deobfuscate=True)),
    )
    on_page = (
        pages.select(F.col(url).alias("contact_url"), F.explode(found).alias("c"))
        .select("contact_url", "c.kind", "c.value")
    )
    # all pages of a large site may link to one contact page
    return salted_join(edges, on_page, "contact_url").select("base_url", "kind", "value").distinct()


def contact_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, seq, email, phone) of contacts that stand together, in order of discovery."""
    return docs.select(key, F.posexplode(C.email_phone_pairs(text)).alias("seq", "pair")).select(
        key, "seq", "pair.email", "pair.phone"
    )


def contact_people(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, contact, person) of every e-mail address of a text. What does not depend on the address, the name
    by role and the places of names, is looked for once in a text, and only where there is an address."""

    def people(emails: Column) -> Column:
        known = F.struct(C.role_person(text).alias("role"), C.named_places(text).alias("places"))
        found = let(known, lambda k: F.transform(
            emails,
            lambda e: F.struct(e.alias("contact"), C.contact_person(text, e, k["role"], k["places"]).alias("person")),
        ))
        return F.when(F.size(emails) > 0, found)

    return docs.select(key, F.inline(let(C.extract_emails(text), people)))
