"""One business from many leads: consolidation, mentions, and contacts that businesses share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import normalize as N, urls as U
from gleaner.operators.graph import components
from gleaner.operators.similarity import SHARE, similar_pairs
from gleaner.session import materialize

#: names that say nothing about the business
NAMELESS = ["", "unknownbusiness"]


def name_key(name: Column | str) -> Column:
    """Letters and digits of a name in lower case; NULL if it names nothing."""
    key = F.regexp_replace(F.lower(name), "[^\\p{L}\\p{N}]+", "")
    return F.when(~key.isin(NAMELESS), key)


def _keys(leads: DataFrame) -> DataFrame:
    """(id, key): what leads of one business have in common."""
    email, phone = F.nullif(N.normalize_email("email"), F.lit("")), F.nullif(N.normalize_phone("phone"), F.lit(""))
    keys = F.array(F.concat(F.lit("e:"), email), F.concat(F.lit("p:"), phone), F.concat(F.lit("n:"), name_key("business_name")))
    return leads.select("id", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("key")).filter("id IS NOT NULL")


def _ties(keys: DataFrame) -> DataFrame:
    """(a, b): every id tied to the least one with the same key."""
    least = keys.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", "first")
    return keys.join(least, "key").filter("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))


def _tied(leads: DataFrame, ties: DataFrame) -> DataFrame:
    found = components(ties).select(F.col("node").alias("id"), F.col("component").alias("_business"))
    return leads.join(found, "id", "left").withColumn("business_id", F.coalesce("_business", "id")).drop("_business")


def business_ids(leads: DataFrame) -> DataFrame:
    """``leads`` with ``business_id``: the least id among leads tied by e-mail, phone or name.

    A key ties its leads to the least of them, so a key of very many leads costs one row per lead and
    no pairs are formed.
    """
    return _tied(leads, _ties(_keys(leads)))


def name_blocks(leads: DataFrame) -> DataFrame:
    """(id, block, text): the name key of a lead in each block where a similar name means the same business:
    one address, one mail domain or one website."""
    blocks = F.array(
        F.concat(F.lit("a:"), F.nullif(F.lower(F.trim("address")), F.lit(""))),
        F.concat(F.lit("m:"), F.nullif(F.lower(F.substring_index("email", "@", -1)), F.lit(""))),
        F.concat(F.lit("w:"), F.when(F.col("website") != "", U.domain("website"))),
    )
    rows = leads.select("id", F.explode(F.filter(blocks, lambda b: b.isNotNull())).alias("block"), name_key("business_name").alias("text"))
    return rows.filter("id IS NOT NULL AND text IS NOT NULL")


def fuzzy_business_ids(leads: DataFrame, share: float = SHARE) -> DataFrame:
    """As :func:`business_ids`; leads with similar names in a block are tied as well.

    Names are similar within an edit distance of ``share`` of the longer one. Distinct names of a block are
    compared, through rare q-grams; a pair of names ties the least lead of the one with the least of the other,
    so neither a common name nor a block of very many leads becomes pairs of leads.
    """
    named = materialize(name_blocks(leads).groupBy("block", "text").agg(F.min("id").alias("id")), "names")
    pairs = similar_pairs(named, share)
    # merged: files of names are far smaller than the rows a broadcast of them would hold
    a, b = (named.select("block", F.col("text").alias(c), F.col("id").alias(f"id_{c}")).hint("merge") for c in "ab")
    similar = pairs.join(a, ["block", "a"]).join(b, ["block", "b"]).filter("id_a <> id_b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    return _tied(leads, _ties(_keys(leads)).union(similar))


def _values(known: DataFrame) -> DataFrame:
    """(business_id, field, value, n): how many leads of a business give a value."""
    fields = ["business_name", "email", "phone", "address", "website"]
    melted = known.select("business_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("v"))
    return melted.select("business_id", "v.*").filter("value <> ''").groupBy("business_id", "field", "value").agg(F.count("*").alias("n"))


def business_profiles(known: DataFrame) -> DataFrame:
    """One row per business: of each field the value that most leads give (the least one of equals), and counts."""
    values = _values(known)
    best = values.groupBy("business_id", "field").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("b"), F.count("*").alias("distinct"))

    def of(field: str, value: Column) -> Column:
        return F.max(F.when(F.col("field") == field, value))

    profile = best.groupBy("business_id").agg(
        *[of(f, F.col("b.value")).alias(f) for f in ("business_name", "email", "phone", "address", "website")],
        *[F.coalesce(of(f, F.col("distinct")), F.lit(0)).alias(f"n_{f}s") for f in ("email", "phone")],
    )
    size = known.groupBy("business_id").agg(F.count("*").alias("n_leads"))
    return size.join(profile, "business_id", "left").na.fill(0, ["n_emails", "n_phones"])


def business_mentions(known: DataFrame, source: str = "source_url") -> DataFrame:
    """(business_id, n_leads, n_domains): on how many sites a business is named."""
    each = known.select("business_id", F.when(F.col(source) != "", U.domain(source)).alias("domain")).groupBy("business_id", "domain").agg(F.count("*").alias("n"))
    return each.groupBy("business_id").agg(F.sum("n").alias("n_leads"), F.count("domain").alias("n_domains"))


def shared_contacts(known: DataFrame) -> DataFrame:
    """(business_id, kind, contact, shared_by): what a business shares with others.

    Businesses meet at the contact, with the number of businesses there; pairs of businesses are not
    written out, since a contact that n businesses share would give n * n of them.
    """
    contacts = F.array(
        F.struct(F.lit("mail domain").alias("kind"), F.lower(F.substring_index("email", "@", -1)).alias("contact")),
        F.struct(F.lit("website").alias("kind"), F.when(F.col("website") != "", U.domain("website")).alias("contact")),
        F.struct(F.lit("address").alias("kind"), F.lower("address").alias("contact")),
    )
    edges = known.select("business_id", F.explode(contacts).alias("c")).select("business_id", "c.*").filter("contact <> ''").distinct()
    counts = edges.groupBy("kind", "contact").agg(F.count("*").alias("shared_by")).filter("shared_by > 1")
    return edges.join(counts, ["kind", "contact"]).select("business_id", "kind", "contact", "shared_by")
