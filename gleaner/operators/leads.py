"""Building, normalising, scoring and checking leads."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions import classify as K, contacts as C, fixed, html as H, normalize as N, scoring as S
from gleaner.functions.common import WORD, blank_to_null, col, empty_strings, first_of, let, strip

LEAD_COLUMNS = [
    "business_name", "contact_person", "email", "phone", "address", "website", "lead_type",
    "confidence_score", "extraction_method", "created_at", "source_url",
]
SCORE_COLUMNS = ["completeness_score", "relevance_score", "freshness_score", "final_score", "scored_at"]


def _null() -> Column:
    return F.lit(None).cast("string")


# --- flat leads ----------------------------------------------------------------------------
def flat_leads(
    docs: DataFrame,
    now: str,
    text: str = "text",
    source_url: str = "source_url",
    type_words: Iterable[str] = fixed.BUSINESS_WORDS,
) -> DataFrame:
    """One lead per e-mail, phone and business name of a text: one scan and one ``explode``."""

    def lead(name: Column, email: Column, phone: Column, kind: str, confidence: float) -> Column:
        return F.struct(
            name.alias("business_name"), email.alias("email"), phone.alias("phone"),
            F.lit(kind).alias("lead_type"), F.lit(confidence).alias("confidence_score"),
        )

    unknown = F.lit(fixed.UNKNOWN_BUSINESS)
    body = F.coalesce(col(text), F.lit(""))
    rows = F.concat(
        F.transform(C.extract_emails(body), lambda e: lead(unknown, e, _null(), "email_contact", fixed.CONF_FLAT_EMAIL)),
        F.transform(C.extract_phones(body), lambda p: lead(unknown, _null(), p, "phone_contact", fixed.CONF_FLAT_PHONE)),
        F.transform(
            C.business_names(body, type_words),
            lambda n: lead(n, _null(), _null(), "business_name", fixed.CONF_FLAT_NAME),
        ),
    )
    return docs.select(F.col(source_url).alias("source_url"), F.explode(rows).alias("l")).select(
        "l.business_name",
        _null().alias("contact_person"),
        "l.email",
        "l.phone",
        _null().alias("address"),
        _null().alias("website"),
        "l.lead_type",
        "l.confidence_score",
        F.lit("pattern_extraction").alias("extraction_method"),
        S.as_timestamp(now).alias("created_at"),
        "source_url",
    )


# --- paired leads --------------------------------------------------------------------------
def _use_once(pairs: Column) -> Column:
    """Keep a pair only if neither its e-mail nor its phone was kept before, in order."""
    kept = F.array().cast("array<struct<email:string,phone:string>>")
    return F.aggregate(
        F.array_distinct(pairs),
        kept,
        lambda acc, p: F.when(
            F.exists(acc, lambda k: (k["email"] == p["email"]) | (k["phone"] == p["phone"])), acc
        ).otherwise(F.concat(acc, F.array(p))),
    )


def paired_leads(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source_url: str | None = None
) -> DataFrame:
    """One lead per e-mail/phone pair, then per e-mail and per phone left over.

    The rule is sequential inside a document and documents are rows, so it is a fold over an array
    and needs neither a shuffle nor an anti join. The text is dropped before the leads are
    exploded; it would be copied to each of them otherwise.
    """
    t = F.coalesce(col(text), F.lit(""))
    # most texts name no contact and give no row: nothing else is looked for in them
    named = C.has_contact(t)
    found = docs.select(
        key,
        F.when(named, t).otherwise("").alias("_text"),
        (F.col(source_url) if source_url else C.first_website(t)).alias("source_url"),
        F.when(named, C.business_name(t)).alias("business_name"),
        F.when(named, F.coalesce(first_of(C._street_addresses(t, fixed.STREET_WORDS)), C.first_address(t))).alias("address"),
        C.first_website(t).alias("website"),
        _use_once(C.email_phone_pairs(t)).alias("_pairs"),
        F.transform(C._emails(t), strip).alias("_emails"),
        F.transform(C._phones(t), strip).alias("_phones"),
    )

    def entry(email: Column, phone: Column, confidence: float) -> Column:
        return F.struct(
            email.alias("email"), phone.alias("phone"), F.lit(confidence).alias("confidence_score"),
            F.coalesce(email, phone).alias("contact"),
        )

    pairs = F.col("_pairs")
    rest_emails = F.array_except("_emails", F.transform(pairs, lambda p: p["email"]))
    rest_phones = F.array_except("_phones", F.transform(pairs, lambda p: p["phone"]))
    entries = F.concat(
        F.transform(pairs, lambda p: entry(p["email"], p["phone"], fixed.CONF_PAIR)),
        F.transform(rest_emails, lambda e: entry(e, _null(), fixed.CONF_EMAIL_ONLY)),
        F.transform(rest_phones, lambda p: entry(_null(), p, fixed.CONF_PHONE_ONLY)),
    )
    # names by role and the places of names are the same for all contacts of a text, so they are computed
    # outside the lambda
    with_person = let(
        F.struct(C.role_person("_text").alias("role"), C.named_places("_text").alias("places")),
        lambda known: F.transform(
            entries,
            lambda e: e.withField("contact_person", C.contact_person("_text", e["contact"], known["role"], known["places"])),
        ),
    )
    return (
        found.select(
            key, "source_url", "business_name", "address", "website",
            C.lead_type("_text", "business_name").alias("lead_type"),
            # exploded as an expression: for a column the optimizer infers "size > 0" and pushes that
            # filter, with the whole computation in it, down to the scan
            F.posexplode(with_person).alias("seq", "l"),
        )
        .select(
            key, "seq", "business_name", "l.contact_person", "l.email", "l.phone", "address", "website",
            "lead_type", "l.confidence_score", F.lit("pattern").alias("extraction_method"), "source_url",
        )
    )


# --- structured leads ----------------------------------------------------------------------
def structured_leads(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Leads from JSON-LD objects of five types and from microdata of five kinds."""
    def from_json_ld(item: Column) -> Column:
        def field(name: str) -> Column:
            return F.get_json_object(item, f"$['{name}']")

        return F.struct(
            F.lit("jsonld").alias("extraction_method"), field("@type").alias("lead_type"),
            field("name").alias("business_name"), field("email").alias("email"),
            field("telephone").alias("phone"), field("url").alias("website"),
        )

    def from_itemtype(itemtype: Column) -> Column:
        return F.struct(
            F.lit("microdata").alias("extraction_method"), F.lower(itemtype).alias("lead_type"),
            _null().alias("business_name"), _null().alias("email"), _null().alias("phone"),
            _null().alias("website"),
        )

    items = F.filter(
        F.transform(H.jsonld_items(html), from_json_ld),
        lambda l: F.coalesce(l["lead_type"].isin(fixed.LEAD_TYPES_JSONLD), F.lit(False)),
    )
    kinds = "|".join(fixed.LEAD_TYPES_MICRODATA)
    tags = F.filter(F.transform(H.itemtypes(html), from_itemtype), lambda l: l["lead_type"].rlike(kinds))
    return pages.select(
        key, F.col(url).alias("source_url"), F.posexplode(F.concat(items, tags)).alias("seq", "l")
    ).select(key, "source_url", "seq", "l.*")


# --- leads from stored model responses -----------------------------------------------------
MODEL_LEAD = (
    "struct<business_name:string,contact_person:string,email:string,phone:string,address:string,"
    "website:string,lead_type:string,confidence_score:double,extraction_method:string,created_at:string>"
)


def _model_objects(response: Column) -> Column:
    """JSON objects of a response as an array of strings; NULL if there is no usable JSON."""
    body = F.regexp_replace(strip(response), r"^`+(?:json)?\s*|\s*`+$", "")
    as_list = lambda j: (
        F.when(j.startswith("["), F.from_json(j, "array<string>")).when(j.startswith("{"), F.array(j))
    )

    def parsed(j: Column) -> Column:
        return F.when(F.try_parse_json(j).isNotNull(), as_list(j))

    # the whole body first; the shortest bracketed part only if the body is not JSON
    return let(
        body,
        lambda b: F.coalesce(
            parsed(b), parsed(blank_to_null(F.regexp_extract(b, r"(?s)(\[.*?\]|\{.*?\})", 1)))
        ),
    )


def parse_model_leads(
    responses: DataFrame, now: str, response: str = "response_text", source_url: str = "source_url"
) -> DataFrame:
    """Leads from stored model responses, defaults filled in. Items that are no objects are left out;
    :func:`model_rejects` lists the responses without usable JSON."""
    objects = F.filter(_model_objects(F.col(response)), lambda o: o.startswith("{"))
    rows = responses.select(
        F.col(source_url).alias("source_url"), F.posexplode(objects).alias("seq", "object")
    ).select("source_url", "seq", F.from_json("object", MODEL_LEAD).alias("l"))
    defaults = {
        "business_name": F.lit(fixed.UNKNOWN_BUSINESS),
        "lead_type": F.lit(fixed.MODEL_LEAD_TYPE),
        "confidence_score": F.lit(fixed.CONF_MODEL),
        "extraction_method": F.lit(fixed.MODEL_METHOD),
    }
    columns = [
        F.coalesce(F.col(f"l.{c}"), defaults[c]).alias(c) if c in defaults else F.col(f"l.{c}").alias(c)
        for c in LEAD_COLUMNS if c not in ("created_at", "source_url")
    ]
    created = F.coalesce(F.try_to_timestamp(F.col("l.created_at")), S.as_timestamp(now))
    return rows.select("seq", *columns, created.alias("created_at"), "source_url")


def model_rejects(
    responses: DataFrame, response: str = "response_text", source_url: str = "source_url"
) -> DataFrame:
    return responses.filter(_model_objects(F.col(response)).isNull()).select(source_url, response)


# --- normalising ---------------------------------------------------------------------------
def normalize_leads(
    leads: DataFrame,
    default_region: str = fixed.DEFAULT_REGION,
    regions: Sequence[tuple] = fixed.PHONE_REGIONS,
    ascii_names: bool = False,
) -> DataFrame:
    """Leads with normalised fields and ``reject_reason`` (NULL if the row is good).

    A field that was given but cannot be normalised becomes '' and is named in the reason.
    """
    out = leads
    if "business_name" in leads.columns:
        out = out.withColumn("business_name", N.normalize_business_name("business_name", ascii_names))
    if "address" in leads.columns:
        out = out.withColumn("address", N.normalize_address("address"))
    given = out.select("*", F.col("email").alias("_email"), F.col("phone").alias("_phone"))
    done = given.withColumn("email", N.normalize_email("email")).withColumn(
        "phone", N.normalize_phone("phone", default_region, regions)
    )
    reasons = F.concat_ws(
        ",",
        F.when((F.col("email") == "") & (F.col("_email") != ""), "email"),
        F.when((F.col("phone") == "") & (F.col("_phone") != ""), "phone"),
    )
    return done.withColumn("reject_reason", blank_to_null(reasons)).drop("_email", "_phone")


# --- scoring -------------------------------------------------------------------------------
def score_leads(
    leads: DataFrame,
    now: str | Column,
    keywords: Iterable[str] = fixed.TARGET_KEYWORDS,
    geo: str | None = None,
) -> DataFrame:
    """Leads with a ``scoring`` struct. ``now`` is explicit, so a rerun gives the same scores."""
    columns = {c: F.col(c) for c in leads.columns}
    stamp = S.as_timestamp(now)
    points = leads.select(
        "*",
        S.completeness(columns).alias("_c"),
        S.relevance(columns, keywords, geo).alias("_r"),
        S.freshness(columns, stamp).alias("_f"),
    )
    comp, rel, fresh = (S.to_score(F.col(c)) for c in ("_c", "_r", "_f"))
    scoring = F.struct(
        comp.alias("completeness_score"),
        rel.alias("relevance_score"),
        fresh.alias("freshness_score"),
        S.to_score(S.final(F.col("_c"), F.col("_r"), F.col("_f"))).alias("final_score"),
        F.struct(comp.alias("completeness"), rel.alias("relevance"), fresh.alias("freshness")).alias(
            "scoring_factors"
        ),
        stamp.alias("scored_at"),
    )
    return points.select(*leads.columns, scoring.alias("scoring"))


def flatten_leads(leads: DataFrame) -> DataFrame:
    """Scored leads as the fixed sixteen flat columns of an export."""
    return leads.select(*LEAD_COLUMNS, *[F.col(f"scoring.{c}").alias(c) for c in SCORE_COLUMNS])


# --- checks, filters, pages ----------------------------------------------------------------
_VALID_EMAIL = rf"^[{WORD}!#$%&'*+/=?^`{{|}}~-]+(?:\.[{WORD}!#$%&'*+/=?^`{{|}}~-]+)*@(?:[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}-]*[\p{{L}}\p{{N}}])?\.)+[\p{{L}}]{{2,}}$"
_VALID_URL = r"^(?i)https?://[^/?#\s:@]+(?::[0-9]{1,5})?(?:[/?#]\S*)?$"


def check_leads(leads: DataFrame) -> DataFrame:
    """All leads with ``reject_reason``: the first field that is malformed, NULL for good rows."""
    reason = F.when(F.col("email").isNotNull() & ~F.col("email").rlike(_VALID_EMAIL), "email").when(
        F.col("website").isNotNull() & ~F.col("website").rlike(_VALID_URL), "website"
    )
    if dict(leads.dtypes).get("created_at") == "string":
        stamp = F.col("created_at")
        reason = reason.when(stamp.isNotNull() & F.try_to_timestamp(stamp).isNull(), "created_at")
    return leads.withColumn("reject_reason", reason)


def validate_leads(leads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects): a malformed e-mail, website or timestamp drops the row, not the batch."""
    checked = check_leads(leads)
    return (
        checked.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        checked.filter(F.col("reject_reason").isNotNull()),
    )


def filter_leads(
    leads: DataFrame,
    lead_type: str | None = None,
    min_score: float = 0.0,
    max_score: float = 1.0,
    keyword: str | None = None,
    location: str | None = None,
) -> DataFrame:
    """Scored leads by type, score range, word in name, type or website, and place in the address."""
    out = leads.filter(F.col("scoring.final_score").between(min_score, max_score))
    if lead_type:
        out = out.filter(F.col("lead_type") == lead_type)
    if keyword:
        text = F.lower(F.concat_ws(" ", "business_name", "lead_type", "website"))
        out = out.filter(text.contains(keyword.lower()))
    if location:
        out = out.filter(F.lower("address").contains(location.lower()))
    return out


def classify_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", top_n: int = 10, **lexicons) -> DataFrame:
    """One classification record per document. Keywords are counted inside the row, so the whole
    record is one ``select`` without a shuffle."""
    return docs.select(
        key,
        K.content_type(text, lexicons.get("types", fixed.CONTENT_TYPES)).alias("type"),
        K.vertical(text, lexicons.get("verticals", fixed.VERTICALS)).alias("vertical"),
        K.intent(text, lexicons.get("intents", fixed.INTENTS)).alias("intent"),
        K.quality(text, lexicons.get("verticals", fixed.VERTICALS)).alias("quality_score"),
        K.is_spam(text, lexicons.get("spam", fixed.SPAM_PATTERNS)).alias("is_spam"),
        K.keywords(text, top_n).alias("keywords"),
    )


def keyword_table(docs: DataFrame, key: str = "doc_id", text: str = "text", top_n: int = 10) -> DataFrame:
    """(key, rank, keyword, n) of the most frequent words of each document."""
    return docs.select(
        key, F.posexplode(K.keyword_counts(text, top_n)).alias("p", "k")
    ).select(key, (F.col("p") + 1).alias("rank"), F.col("k.word").alias("keyword"), F.col("k.n").alias("n"))


def grouped_keywords(
    rows: DataFrame, group: str, order: str, text: str = "text", top_n: int = 10
) -> DataFrame:
    """(group, rank, keyword, n) over texts of several rows, such as the turns of a conversation.

    The texts of a group are never brought together: words are counted per group with partial sums
    below the shuffle, and only ``top_n`` words per group and task reach the ranking. Ties go to the
    word seen first by ``order``.
    """
    seen = rows.select(group, order, F.posexplode(K.words(text)).alias("at", "keyword"))
    counted = seen.groupBy(group, "keyword").agg(
        F.count("*").alias("n"), F.min(F.struct(order, "at")).alias("first")
    )
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), "first"))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= top_n).select(group, "rank", "keyword", "n")


def corpus_keywords(docs: DataFrame, text: str = "text") -> DataFrame:
    """(keyword, n_docs, n) over all documents, in one pass.

    Each document gives its words once for ``n`` and its distinct words once for ``n_docs``; sums
    are combined before the shuffle, so a word that is everywhere costs one row per task.
    """
    found = docs.select(K.words(text).alias("words"))
    marks = F.concat(
        F.transform("words", lambda w: F.struct(w.alias("keyword"), F.lit(1).alias("n"), F.lit(0).alias("d"))),
        F.transform(
            F.array_distinct("words"), lambda w: F.struct(w.alias("keyword"), F.lit(0).alias("n"), F.lit(1).alias("d"))
        ),
    )
    return (
        found.select(F.inline(marks))
        .groupBy("keyword")
        .agg(F.sum("d").alias("n_docs"), F.sum("n").alias("n"))
    )
