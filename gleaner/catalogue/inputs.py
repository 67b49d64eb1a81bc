"""Inputs that the registered queries derive from the given tables.

The page table has no contact data, JSON-LD or forms, so business pages are spelled from the
``customer`` and ``nation`` rows. The expressions are plain SQL that Spark and the checking engine
read alike; both sides start from the same text and share nothing after that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.catalogue.registry import table

NOW = "2024-02-01 00:00:00"

#: businesses spelled by one task: a few seconds of work
PER_TASK = 10_000

_NAME = """concat('Grand ', replace(n_name, 'NATION_', 'Nation '), ' ', c_mktsegment, ' ',
  CASE c_custkey % 5 WHEN 0 THEN 'Hotel' WHEN 1 THEN 'Resort' WHEN 2 THEN 'Tours' WHEN 3 THEN 'Cafe' ELSE 'Partners' END)"""
_HOST = "concat('www.c', c_custkey, '.example.com')"
_PHONE = "concat('+91 98', lpad(cast(c_custkey % 100000000 AS string), 8, '0'))"

# base columns of a business
SHOP = {
    "k": "c_custkey",
    "name": _NAME,
    "host": _HOST,
    "place": "replace(n_name, 'NATION_', 'Nation ')",
    "phone": _PHONE,
    "acctbal": "c_acctbal",
    "seg": "c_mktsegment",
}

# a page of the business; every seventh page differs in what it declares
PAGE_HTML = """concat(
 '<!DOCTYPE html><html lang="', CASE k % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'fr' END, '"><head><meta charset="utf-8">',
 CASE k % 7 WHEN 0 THEN concat('<title> ', name, ' - Home &amp; more </title>')
            WHEN 1 THEN concat('<meta property="og:title" content="', name, ' og">')
            WHEN 2 THEN concat('<meta name="title" content="', name, ' meta">')
            WHEN 3 THEN '<title>  </title>'
            ELSE concat('<title>', name, '</title>') END,
 CASE WHEN k % 4 = 1 THEN '' ELSE concat('<link rel="canonical" href="https://', host, '/home">') END,
 '<meta name="Description" content="About ', name, '"><meta name="description" content="All about ', place, '">',
 '<meta property="og:site_name" content="', seg, ' group"><meta name="empty" content="">',
 '<script type="application/ld+json">',
 CASE k % 4 WHEN 0 THEN concat('{"@type":"Hotel","name":"', name, ' LD","telephone":"', phone, '","email":"ld', k, '@', host, '","url":"https://', host, '/","address":{"streetAddress":"', k % 900 + 10, ' Main Street","addressLocality":"', place, '","postalCode":"', k % 90000 + 10000, '"}}')
            WHEN 1 THEN concat('[{"@type":"Organization","name":"', name, ' Org","address":"', k % 900 + 10, ' Side Street"},{"@type":"Person","name":"P', k, '"}]')
            WHEN 2 THEN '{"@type":"Hotel","name":'
            ELSE concat('{"@type":"Place","name":"', name, ' Place","address":"Plaza ', k, '"}') END,
 '</script><style>p{margin:0}</style></head><body><nav><a href="/contact">Reach us</a> <a href="https://www.facebook.com/c', k, '">social</a></nav>',
 '<h1>', name, ' <b>welcome</b></h1>',
 '<div itemscope itemtype="https://schema.org/', CASE k % 3 WHEN 0 THEN 'LocalBusiness' WHEN 1 THEN 'Hotel' ELSE 'Event' END, '" id="d', k, '"><p>Open daily</p></div>',
 '<main><p>Mail: m', k, '@', host, ' or call ', phone, '</p></main>',
 CASE WHEN k % 2 = 0 THEN '<form method="post" action="/contact/send"><input name="q"></form>' ELSE '' END,
 CASE WHEN k % 3 = 0 THEN '<a href="../list/./p?x=1">Next page</a>' WHEN k % 3 = 1 THEN '<a href="p2">Next</a>' ELSE '<a href="#top">Top</a><a href="javascript:void(0)">x</a>' END,
 '<footer>12 Long Road, ', place, ' Park, KA ', k % 90000 + 10000, '</footer></body></html>')"""

# the page that "/contact" leads to
CONTACT_HTML = """concat('<html><body><p>desk', k, '@', host, ' and info [at] c', k, ' [dot] com</p><p>', phone, ' or +91 [space] ', k % 900 + 100, ' [space] 67890</p></body></html>')"""

# a text with contacts in seven arrangements
NOTE = """concat(
 name, ' - Contact Information', chr(10), 'Address: ', k % 900 + 10, ' Main Street, ', place, chr(10), chr(10),
 CASE k % 7
  WHEN 0 THEN concat('Manager: Jean Dubois, email: m', k, '@', host, ', phone: ', phone)
  WHEN 1 THEN concat('phone: ', phone, ' email: m', k, '@', host)
  WHEN 2 THEN concat('m', k, '@', host, ' ', phone)
  WHEN 3 THEN concat('m', k, '@', host, ' or again m', k, '@', host, '.')
  WHEN 4 THEN concat('call ', phone, ' today')
  WHEN 5 THEN concat('write a', k, '@', host, ' or b', k, '@', host, ' and call ', phone, ' or +1 555 010 ', k % 9000 + 1000)
  ELSE concat('a', k, '@', host, ' ', phone, ' x b', k, '@', host, ' ', phone) END, chr(10),
 'Anna Smith: desk', k, '@', host, chr(10),
 CASE k % 3 WHEN 0 THEN 'our CEO and the Chief Data Officer' WHEN 1 THEN 'ask the general manager' ELSE 'no one' END, chr(10),
 'see https://www.facebook.com/c', k, ' and http://', host, '/x, sales', k, ' [at] c', k, ' [dot] com, +91 [space] 12345 [space] ', k % 90000 + 10000, chr(10))"""

# SQL with the same rows as the functions below
SHOP_SQL = (
    "SELECT " + ", ".join(f"{e} AS {n}" for n, e in SHOP.items()) + " FROM customer JOIN nation ON c_nationkey = n_nationkey"
)
SHOP_PAGES_SQL = (
    f"SELECT k AS page_id, concat('https://', host, '/dir/home') AS url, {PAGE_HTML} AS html FROM ({SHOP_SQL}) s"
)
SITE_PAGES_SQL = (
    f"SELECT url, html FROM ({SHOP_PAGES_SQL}) p UNION ALL "
    f"SELECT concat('https://', host, '/contact') AS url, {CONTACT_HTML} AS html FROM ({SHOP_SQL}) s"
)
NOTES_SQL = f"SELECT k AS doc_id, {NOTE} AS text, name, host FROM ({SHOP_SQL}) s"
ALL_PAGES_SQL = f"SELECT page_id, url, html FROM pages UNION ALL SELECT page_id + 1000000000 AS page_id, url, html FROM ({SHOP_PAGES_SQL}) q"


def shops(spark: SparkSession, sf: str) -> DataFrame:
    """Base columns of the businesses, dealt over all tasks: a customer is a few bytes in the file, so very many
    come in one split, and each becomes a page or a text that takes long to search."""
    customers = table(spark, sf, "customer")
    joined = customers.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    # counted from the file's metadata; each of very many small tasks would write to all tasks of a later shuffle
    tasks = max(-(-customers.count() // PER_TASK), spark.sparkContext.defaultParallelism)
    dealt = joined.select("c_custkey", "c_acctbal", "c_mktsegment", "n_name").repartition(tasks)
    return dealt.select(*[F.expr(e).alias(n) for n, e in SHOP.items()])


def shop_pages(spark: SparkSession, sf: str) -> DataFrame:
    return shops(spark, sf).select(
        F.col("k").alias("page_id"), F.expr("concat('https://', host, '/dir/home')").alias("url"),
        F.expr(PAGE_HTML).alias("html"),
    )


def all_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The given pages and the business pages."""
    made = shop_pages(spark, sf).withColumn("page_id", F.col("page_id") + 1000000000)
    return table(spark, sf, "pages").select("page_id", "url", "html").union(made)


def site_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Business pages and the contact pages they link to."""
    contact = shops(spark, sf).select(
        F.expr("concat('https://', host, '/contact')").alias("url"), F.expr(CONTACT_HTML).alias("html")
    )
    return shop_pages(spark, sf).select("url", "html").union(contact)


def notes(spark: SparkSession, sf: str) -> DataFrame:
    return shops(spark, sf).select(F.col("k").alias("doc_id"), F.expr(NOTE).alias("text"), "name", "host")
