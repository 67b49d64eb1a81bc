"""HTML structure and sources of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.catalogue import inputs as I, sql as S
from gleaner.catalogue.registry import query, table
from gleaner.functions import fixed, html as H
from gleaner.operators import pages as P
from gleaner.session import checkpoint_dir, materialize
from gleaner.sources import readers, sinks
from gleaner.sources.schemas import PAGE

_ALL = f"({I.ALL_PAGES_SQL}) p"
_META = S.every("html", r"(?is)<meta[\s/]([^>]*)>", 1)
_CHROME = "(?is)" + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in fixed.CHROME_TAGS)
_NO_CHROME = S.sub("html", _CHROME, " ")


def _meta_by(attribute: str, name: str) -> str:
    hits = f"list_filter({_META}, lambda x: coalesce({S.attr('x', attribute)}, '') = {S.q(name)})"
    return f"{S.attr(f'{hits}[1]', 'content')}"


_TITLE_TAG = f"nullif({S.squeeze(S.text_of(f'regexp_extract(html, {S.q(r"(?is)<title\b[^>]*>(.*?)</title\s*>")}, 1)'))}, '')"
_H1 = S.squeeze(S.text_of(f"regexp_extract({_NO_CHROME}, {S.q(r'(?is)<h1\b[^>]*>(.*?)</h1\s*>')}, 1)"))
_TITLE = (
    f"coalesce({_TITLE_TAG}, nullif({S.strip(_meta_by('property', 'og:title'))}, ''), "
    f"nullif({S.strip(_meta_by('name', 'title'))}, ''), nullif({_H1}, ''), '')"
)
_LANG = S.attr(f"regexp_extract(html, {S.q(r'(?is)<html\s([^>]*)>')}, 1)", "lang")
_LINKS = S.every("html", r"(?is)<link[\s/]([^>]*)>", 1)
_CANONICAL = f"coalesce({S.attr(f'''list_filter({_LINKS}, lambda x: lower({S.attr('x', 'rel')}) = 'canonical')[1]''', 'href')}, url)"
_JSONLD = (
    f"list_filter({S.every('html', r'''(?is)<script\b[^>]*?\btype\s*=\s*[\"']?application/ld\+json\b[^>]*>(.*?)</script\s*>''', 1)}, "
    "lambda x: json_valid(x))"
)
_ITEMTYPE = r"(?is)<[a-z][a-z0-9]*\s[^>]*?\bitemtype\s*=[^>]*>"


# --- sources -------------------------------------------------------------------------------
@query(
    "page_scan",
    "SELECT url, coalesce(cast(NULL AS string), '') AS final_url, length(html) AS n_chars, 0 AS known_status FROM pages",
)
def _(spark, sf):
    pages = readers.read_pages(spark, f"{sf}/pages.parquet")
    return pages.select(
        "url", F.coalesce("final_url", F.lit("")).alias("final_url"), F.length("html").cast("bigint").alias("n_chars"),
        F.when(F.col("status_code").isNotNull(), 1).otherwise(0).alias("known_status"),
    )


_TYPE = """CASE page_id % 5 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'application/pdf'
 WHEN 2 THEN 'application/xhtml+xml' WHEN 3 THEN 'image/png' ELSE 'application/xml' END"""


@query(
    "content_type_admission",
    f"""SELECT page_id, content_type FROM (SELECT page_id, {_TYPE} AS content_type FROM pages) p
    WHERE content_type LIKE '%text/html%' OR content_type LIKE '%application/xhtml+xml%' OR content_type LIKE '%application/xml%'""",
)
def _(spark, sf):
    typed = table(spark, sf, "pages").select("page_id", F.expr(_TYPE).alias("content_type"))
    return P.filter_html(typed)


@query("archive_checksums", "SELECT page_id, sha256(html) AS sha256, octet_length(encode(html)) AS n_bytes FROM pages")
def _(spark, sf):
    out = sinks.archive_columns(table(spark, sf, "pages"))
    return out.select("page_id", "sha256", F.col("n_bytes").cast("bigint").alias("n_bytes"))


@query("archive_round_trip", "SELECT page_id, sha256(html) AS sha256 FROM pages")
def _(spark, sf):
    import uuid

    path = f"{checkpoint_dir(spark)}/archive-{uuid.uuid4().hex}"
    sinks.archive_pages(table(spark, sf, "pages"), path)
    stored = spark.read.parquet(path)
    return stored.filter(F.sha2(F.encode("html", "UTF-8"), 256) == F.col("sha256")).select("page_id", "sha256")


@query(
    "sitemap_urls",
    """SELECT regexp_extract(url, '//([^/]*)', 1) AS domain, unnest([url, url || '&a=1', url || '#b']) AS url FROM pages""",
)
def _(spark, sf):
    # one sitemap per page: locations in the usual surroundings, as CDATA, with attributes
    xml = F.concat(
        F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url>\n <loc> '),
        F.replace("url", F.lit("&"), F.lit("&amp;")),
        F.lit("\n</loc><lastmod>2024-01-01</lastmod></url><url><loc><![CDATA["), F.col("url"), F.lit("&a=1]]></loc></url><url><loc xml:lang='en'>"),
        F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("#b</loc></url></urlset>"),
    )
    maps = table(spark, sf, "pages").select(F.regexp_extract("url", "//([^/]*)", 1).alias("domain"), xml.alias("xml"))
    return readers.sitemap_urls(maps).select("domain", "url")


# --- structure -----------------------------------------------------------------------------
@query("page_title", f"SELECT page_id, {_TITLE} AS title FROM {_ALL}")
def _(spark, sf):
    return I.all_pages(spark, sf).select("page_id", H.page_title("html").alias("title"))


_META_ROWS = f"""SELECT page_id, lower(coalesce({S.attr('t', 'name')}, {S.attr('t', 'property')}, '')) AS name,
    {S.attr('t', 'content')} AS content, i FROM
    (SELECT page_id, unnest(m) AS t, generate_subscripts(m, 1) AS i FROM (SELECT page_id, {_META} AS m FROM {_ALL}) a) b"""


@query(
    "meta_tags",
    f"""SELECT page_id, name, content FROM (SELECT *, row_number() OVER (PARTITION BY page_id, name ORDER BY i DESC) AS rn
    FROM ({_META_ROWS}) c WHERE coalesce(content, '') <> '') d WHERE rn = 1""",
)
def _(spark, sf):
    return P.meta_table(I.all_pages(spark, sf))


@query("page_language", f"SELECT page_id, {_LANG} AS language FROM {_ALL}")
def _(spark, sf):
    return I.all_pages(spark, sf).select("page_id", H.page_lang("html").alias("language"))


_ITEMS = f"""SELECT page_id, url, unnest(CASE WHEN starts_with(b, '[') THEN json_extract_string(b, '$[*]') ELSE [b] END) AS item
    FROM (SELECT page_id, url, unnest({_JSONLD}) AS b FROM {_ALL}) x"""


@query(
    "jsonld_items",
    f"""SELECT page_id, json_extract_string(item, '$."@type"') AS type, json_extract_string(item, '$.name') AS name
    FROM ({_ITEMS}) y""",
)
def _(spark, sf):
    items = P.jsonld_table(I.all_pages(spark, sf))
    return items.select(
        "page_id", F.get_json_object("item", "$['@type']").alias("type"), F.get_json_object("item", "$.name").alias("name")
    )


@query(
    "microdata_tags",
    f"""SELECT page_id, {S.attr('t', 'itemtype')} AS itemtype, {S.attr('t', 'id')} AS id
    FROM (SELECT page_id, unnest({S.every('html', _ITEMTYPE)}) AS t FROM {_ALL}) x""",
)
def _(spark, sf):
    tags = P.microdata_table(I.all_pages(spark, sf))
    return tags.select("page_id", "itemtype", F.col("properties")["id"].alias("id"))


def _text_nodes(inner: str) -> str:
    return S.text_of(inner)


_DIVS = S.every(_NO_CHROME, r"(?is)<div\b[^>]*>(.*?)</div\s*>", 1)
_MAIN = f"regexp_extract({_NO_CHROME}, {S.q(r'(?is)<main\b[^>]*>(.*?)</main\s*>')}, 1)"


@query(
    # no div is nested in these pages, so plain patterns can follow them
    "main_content",
    f"""SELECT page_id, coalesce(nullif({S.text_of('m')}, ''), (SELECT {S.text_of('d')} FROM
      (SELECT unnest(ds) AS d, generate_subscripts(ds, 1) AS i) u ORDER BY length(replace({S.text_of('d')}, ' ', '')) DESC, i LIMIT 1))
      AS main_text FROM (SELECT page_id, {_MAIN} AS m, {_DIVS} AS ds FROM {_ALL}) x""",
)
def _(spark, sf):
    return P.main_content(I.all_pages(spark, sf))


@query("canonical_url", f"SELECT page_id, {_CANONICAL} AS canonical_url FROM {_ALL}")
def _(spark, sf):
    return I.all_pages(spark, sf).select("page_id", H.canonical_url("html", "url").alias("canonical_url"))


# all business pages of one kind and place share a canonical URL here, as copies of a page do
_SHARED = "regexp_replace(html, 'rel=\"canonical\" href=\"[^\"]*\"', concat('rel=\"canonical\" href=\"https://all.example.com/', page_id % 10, '\"'))"


@query(
    "pages_by_canonical",
    f"""SELECT canonical_url, min(url) AS url, count(*) AS n FROM
    (SELECT url, {_CANONICAL} AS canonical_url FROM (SELECT url, {_SHARED} AS html FROM {_ALL}) a) b GROUP BY canonical_url""",
)
def _(spark, sf):
    copies = I.all_pages(spark, sf).withColumn("html", F.expr(_SHARED))
    kept = P.first_by_canonical(copies).select("canonical_url", "url")
    n = copies.select(H.canonical_url("html", "url").alias("canonical_url")).groupBy("canonical_url").count()
    return kept.join(n, "canonical_url").withColumnRenamed("count", "n")


_ANCHORS = r"(?is)<a[\s/]([^>]*)>(.*?)</a\s*>"
_NEXT = f"""list_filter(list_zip({S.every('html', _ANCHORS, 1)}, {S.every('html', _ANCHORS, 2)}), lambda x: contains(x[2], 'Next'))[1][1]"""
# every page with a "Next" link lies in /dir/
_NEXT_URL = f"""CASE WHEN starts_with({S.attr(_NEXT, 'href')}, '../')
  THEN regexp_extract(url, '^https://[^/]+/', 0) || replace(replace({S.attr(_NEXT, 'href')}, '../', ''), './', '')
  ELSE regexp_extract(url, '^https://[^/]+/dir/', 0) || {S.attr(_NEXT, 'href')} END"""


@query(
    "page_signals",
    f"SELECT page_id, regexp_matches(html, '(?i)<form\\b') AS has_form, coalesce({_NEXT_URL}, '') AS next_url FROM {_ALL}",
)
def _(spark, sf):
    return P.page_signals(I.all_pages(spark, sf)).withColumn("next_url", F.coalesce("next_url", F.lit("")))


@query(
    "parse_pages",
    f"""SELECT page_id, url, {_TITLE} AS title, {_LANG} AS language, len({_JSONLD}) AS n_jsonld,
    len({S.every('html', _ITEMTYPE)}) AS n_microdata, {_CANONICAL} AS canonical_url,
    regexp_matches(html, '(?i)<form\\b') AS has_form, coalesce({_NEXT_URL}, '') AS next_url,
    coalesce((SELECT max(content) FROM (SELECT page_id AS pid, content, row_number() OVER (PARTITION BY page_id ORDER BY i DESC) AS rn
      FROM ({_META_ROWS}) c WHERE name = 'description' AND coalesce(content, '') <> '') d WHERE pid = p.page_id AND rn = 1), '') AS description
    FROM {_ALL}""",
)
def _(spark, sf):
    return P.parse_pages(I.all_pages(spark, sf)).select(
        "page_id", "url", "title", "language",
        F.size("jsonld").cast("bigint").alias("n_jsonld"), F.size("microdata").cast("bigint").alias("n_microdata"),
        "canonical_url", "has_form", F.coalesce("next_url", F.lit("")).alias("next_url"),
        F.coalesce(F.try_element_at("meta", F.lit("description")), F.lit("")).alias("description"),
    )
