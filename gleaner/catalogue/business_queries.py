"""Businesses consolidated from leads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.catalogue.registry import query, table
from gleaner.operators import businesses as B

# leads spelled from customers by SQL that both engines read: names tie four, phones two, some e-mails two more
_LEADS = """SELECT concat('lead', lpad(cast(c_custkey AS string), 9, '0')) AS id,
    CASE WHEN c_custkey % 5 = 0 THEN 'Unknown Business' ELSE concat('Inn No. ', cast(floor(c_custkey / 4) AS bigint)) END AS business_name,
    CASE WHEN c_custkey % 8 IN (3, 4) THEN concat('Front', cast(floor(c_custkey / 8) AS bigint), '@inn.org')
         WHEN c_custkey % 7 = 0 THEN '' ELSE concat('u', c_custkey, '@m', c_custkey % 7, '.org') END AS email,
    CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE concat('+91 98', lpad(cast(cast(floor(c_custkey / 2) AS bigint) AS string), 8, '0')) END AS phone,
    concat(c_nationkey, ' Main Street') AS address,
    CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('https://site', c_custkey % 50, '.example/x') END AS website,
    concat('https://src', c_custkey % 11, '.example/', c_custkey) AS source_url FROM customer"""
_SQL = _LEADS.replace("AS string", "AS varchar")

_KNOWN = f"""WITH RECURSIVE leads AS ({_SQL}),
    keys AS (SELECT id, 'e' || lower(email) AS k FROM leads WHERE email <> '' UNION ALL SELECT id, 'p' || phone FROM leads WHERE phone IS NOT NULL
        UNION ALL SELECT id, 'n' || business_name FROM leads WHERE business_name <> 'Unknown Business'),
    ties AS (SELECT DISTINCT a.id AS a, b.id AS b FROM keys a JOIN keys b ON a.k = b.k AND a.id <> b.id),
    walk AS (SELECT id, id AS root FROM leads UNION SELECT t.b, w.root FROM walk w JOIN ties t ON t.a = w.id),
    known AS (SELECT l.*, r.business_id FROM leads l JOIN (SELECT id, min(root) AS business_id FROM walk GROUP BY id) r ON l.id = r.id)"""


def _known(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "customer").createOrReplaceTempView("_customer")
    return B.business_ids(spark.sql(_LEADS.replace("FROM customer", "FROM _customer")))


_BEST = """best AS (SELECT business_id, field, first(value ORDER BY n DESC, value) AS value, count(*) AS d FROM
        (SELECT business_id, field, value, count(*) AS n FROM (SELECT business_id, unnest(['business_name', 'email', 'phone', 'address', 'website']) AS field,
            unnest([business_name, email, phone, address, website]) AS value FROM known) m WHERE value <> '' GROUP BY ALL) c GROUP BY business_id, field)
    SELECT business_id, n_leads, max(CASE WHEN field = 'business_name' THEN value END) AS business_name, max(CASE WHEN field = 'email' THEN value END) AS email,
        max(CASE WHEN field = 'phone' THEN value END) AS phone, max(CASE WHEN field = 'address' THEN value END) AS address,
        max(CASE WHEN field = 'website' THEN value END) AS website, coalesce(max(CASE WHEN field = 'email' THEN d END), 0) AS n_emails,
        coalesce(max(CASE WHEN field = 'phone' THEN d END), 0) AS n_phones
    FROM best JOIN (SELECT business_id, count(*) AS n_leads FROM known GROUP BY business_id) s USING (business_id) GROUP BY business_id, n_leads"""


@query("business_profiles", f"{_KNOWN}, {_BEST}")
def _(spark, sf):
    return B.business_profiles(_known(spark, sf))


# names from a digest; of each four customers one has it as it is, one in capitals with a point, one with a letter
# changed and one with a letter less; only the mail domain, the address or the website brings these together
_SPELT = """SELECT concat('lead', lpad(cast(c_custkey AS string), 9, '0')) AS id,
    CASE c_custkey % 4 WHEN 0 THEN concat('Haus ', word) WHEN 1 THEN concat('HAUS. ', upper(word))
        WHEN 2 THEN concat('Haus ', substr(word, 1, 4), 'x', substr(word, 6)) ELSE concat('Haus ', substr(word, 1, 8), substr(word, 10)) END AS business_name,
    CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('u', c_custkey, '@m', cast(floor(c_custkey / 16) AS bigint) % 20, '.org') END AS email,
    CASE WHEN c_custkey % 9 = 0 THEN concat('+91 98', lpad(cast(cast(floor(c_custkey / 18) AS bigint) AS string), 8, '0')) END AS phone,
    concat(cast(floor(c_custkey / 8) AS bigint) % 30, ' Main Street') AS address,
    CASE WHEN c_custkey % 5 = 0 THEN concat('https://site', c_custkey % 10, '.example/x') END AS website,
    concat('https://src', c_custkey % 11, '.example/', c_custkey) AS source_url
    FROM (SELECT c_custkey, substr(md5(cast(cast(floor(c_custkey / 4) AS bigint) AS string)), 1, 14) AS word FROM customer) c"""
_SIMILAR = f"""WITH RECURSIVE leads AS ({_SPELT.replace('AS string', 'AS varchar')}),
    keys AS (SELECT id, 'e' || lower(email) AS k FROM leads WHERE email <> '' UNION ALL SELECT id, 'p' || phone FROM leads WHERE phone IS NOT NULL
        UNION ALL SELECT id, 'n' || regexp_replace(lower(business_name), '[^a-z0-9]+', '', 'g') FROM leads),
    blocks AS (SELECT id, 'a' || address AS block, regexp_replace(lower(business_name), '[^a-z0-9]+', '', 'g') AS t FROM leads
        UNION ALL SELECT id, 'm' || split_part(email, '@', 2), regexp_replace(lower(business_name), '[^a-z0-9]+', '', 'g') FROM leads WHERE email <> ''
        UNION ALL SELECT id, 'w' || website, regexp_replace(lower(business_name), '[^a-z0-9]+', '', 'g') FROM leads WHERE website IS NOT NULL),
    ties AS (SELECT DISTINCT a.id AS a, b.id AS b FROM keys a JOIN keys b ON a.k = b.k AND a.id <> b.id
        UNION SELECT a.id, b.id FROM blocks a JOIN blocks b ON a.block = b.block AND a.id <> b.id
            AND levenshtein(a.t, b.t) <= floor(0.15 * greatest(length(a.t), length(b.t)))),
    walk AS (SELECT id, id AS root FROM leads UNION SELECT t.b, w.root FROM walk w JOIN ties t ON t.a = w.id),
    known AS (SELECT l.*, r.business_id FROM leads l JOIN (SELECT id, min(root) AS business_id FROM walk GROUP BY id) r ON l.id = r.id)"""


@query("business_profiles_fuzzy", f"{_SIMILAR}, {_BEST}")
def _(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("_customer")
    return B.business_profiles(B.fuzzy_business_ids(spark.sql(_SPELT.replace("FROM customer", "FROM _customer"))))


@query(
    "business_mentions",
    f"""{_KNOWN} SELECT business_id, count(*) AS n_leads, count(DISTINCT regexp_extract(source_url, '//([^/]*)', 1)) AS n_domains FROM known GROUP BY business_id""",
)
def _(spark, sf):
    return B.business_mentions(_known(spark, sf))


@query(
    "shared_contacts",
    f"""{_KNOWN}, edges AS (SELECT DISTINCT business_id, kind, contact FROM (
        SELECT business_id, 'mail domain' AS kind, split_part(lower(email), '@', 2) AS contact FROM known WHERE email <> ''
        UNION ALL SELECT business_id, 'website', regexp_extract(website, '//([^/]*)', 1) FROM known WHERE website IS NOT NULL
        UNION ALL SELECT business_id, 'address', lower(address) FROM known) e)
    SELECT business_id, kind, contact, shared_by FROM (SELECT *, count(*) OVER (PARTITION BY kind, contact) AS shared_by FROM edges) c WHERE shared_by > 1""",
)
def _(spark, sf):
    return B.shared_contacts(_known(spark, sf))
