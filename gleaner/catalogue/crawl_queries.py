"""Links, crawl graph and frontier."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.catalogue import inputs as I, sql as S
from gleaner.catalogue.registry import query, table
from gleaner.functions import urls as U
from gleaner.operators import frontier as Q, links as X

_ALL = f"({I.ALL_PAGES_SQL}) p"
_HREF = f"""SELECT DISTINCT url, href FROM (SELECT url, {S.strip(S.attr('t', 'href'))} AS href FROM
    (SELECT url, unnest({S.every('html', r'(?is)<a[\s/]([^>]*)>', 1)}) AS t FROM {_ALL}) a) b
    WHERE href IS NOT NULL AND NOT starts_with(href, '#') AND NOT starts_with(lower(href), 'javascript:')"""
_ORIGIN = "regexp_extract(url, '^https?://[^/]+', 0)"
# the forms of links in these pages: absolute, from the root, "../list/./p", "p2" on a page in /dir/
_EDGES = f"""SELECT DISTINCT url AS src_url, CASE WHEN starts_with(href, 'http') THEN href WHEN starts_with(href, '/') THEN {_ORIGIN} || href
    WHEN starts_with(href, '../') THEN {_ORIGIN} || '/list/p?x=1' ELSE {_ORIGIN} || '/dir/' || href END AS dst_url FROM ({_HREF}) h"""
WORDS = ["the", "con", "list"]


@query("outlinks", _EDGES)
def _(spark, sf):
    return X.outlinks(I.all_pages(spark, sf))


# a page path is /xx/n, /xx/n/ or /xx/n.html; expected results follow from its folder
_FORMS = {
    "a/b": "d || 'a/b'", "./c": "d || 'c'", "../x": "up || 'x'", "../../../e/./f/../g": "o || '/e/g'", "?q=1": "o || p || '?q=1'",
    "#frag": "o || p || q || '#frag'", "//other.com/x": "s || '//other.com/x'", "mailto:x@y.z": "'mailto:x@y.z'", "http://z.w/?": "'http://z.w/' || CASE WHEN s = 'http:' THEN '' ELSE '?' END",
    "/abs//x": "o || '/abs//x'", "": "url", "g?y#s": "d || 'g?y#s'", ".": "d", "..": "up",
}


@query(
    "resolved_urls",
    f"""WITH u AS (SELECT DISTINCT url, regexp_extract(url, '^https?:', 0) AS s, {_ORIGIN} AS o, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS p,
      regexp_extract(url, '\\?[^#]*', 0) AS q FROM pages), f AS (SELECT *, o || regexp_extract(p, '^.*/', 0) AS d,
      o || regexp_replace(regexp_extract(p, '^.*/', 0), '[^/]+/$', '') AS up FROM u)
    """ + " UNION ALL ".join(f"SELECT url, '{h}' AS href, {e} AS resolved FROM f" for h, e in _FORMS.items()),
)
def _(spark, sf):
    forms = F.explode(F.array(*[F.lit(h) for h in _FORMS]))
    urls = table(spark, sf, "pages").select("url").distinct().select("url", forms.alias("href"))
    return urls.select("url", "href", U.resolve_url("url", "href").alias("resolved"))


@query("keyword_links", f"SELECT * FROM ({_EDGES}) e WHERE {S.any_of('lower(dst_url)', WORDS)}")
def _(spark, sf):
    return X.keyword_links(X.outlinks(I.all_pages(spark, sf)), WORDS)


@query("page_domains", f"SELECT page_id, coalesce(nullif(regexp_extract(url, '//([^/?#]*)', 1), ''), 'unknown') AS domain FROM {_ALL}")
def _(spark, sf):
    return I.all_pages(spark, sf).select("page_id", U.domain("url").alias("domain"))


@query(
    "same_domain_links",
    f"SELECT * FROM ({_EDGES}) e WHERE regexp_extract(src_url, '//([^/?#]*)', 1) = regexp_extract(dst_url, '//([^/?#]*)', 1)",
)
def _(spark, sf):
    return X.same_domain_links(X.outlinks(I.all_pages(spark, sf)))


# no link of the given pages leads to another of them, so pages are linked with their neighbours
_CHAIN = "SELECT a.url AS src_url, b.url AS dst_url FROM pages a JOIN pages b ON b.page_id = a.page_id + 1 OR b.page_id = a.page_id + 4"
_STATUS = "CASE WHEN page_id % 10 = 3 THEN 404 ELSE 200 END"


def _graph(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", F.expr(_STATUS).alias("status_code"))
    steps = pages.select(
        F.col("url").alias("src_url"), F.explode(F.array(F.col("page_id") + 1, F.col("page_id") + 4)).alias("page_id")
    )
    edges = steps.join(pages.select("page_id", F.col("url").alias("dst_url")), "page_id").select("src_url", "dst_url")
    return edges, pages


def _reach(depth: int, rule: str = "") -> str:
    return f"""WITH RECURSIVE e AS ({_CHAIN}), ok AS (SELECT url FROM pages WHERE {_STATUS} = 200),
    r(seed, url, depth) AS (SELECT url, url, 0 FROM pages UNION SELECT r.seed, e.dst_url, r.depth + 1 FROM r JOIN e ON r.url = e.src_url
      JOIN ok ON ok.url = e.dst_url WHERE r.depth < {depth} {rule})
    SELECT seed, url, min(depth) AS depth FROM r WHERE url <> seed GROUP BY seed, url"""


@query("reachable_depth2", _reach(2))
def _(spark, sf):
    edges, pages = _graph(spark, sf)
    return X.reachable(edges, pages, pages.select(F.col("url").alias("seed")), 2)


@query("reachable_depth3_in_domain", _reach(3, "AND contains(e.dst_url, 'example.net')"))
def _(spark, sf):
    edges, pages = _graph(spark, sf)
    return X.reachable(edges, pages, pages.select(F.col("url").alias("seed")), 3, "example.net")


# --- robots --------------------------------------------------------------------------------
_HOST = "regexp_extract(url, '//([^/?#]*)', 1)"
_ROBOTS = """CASE WHEN domain LIKE 'm.%' THEN '' ELSE concat('# rules', chr(10), 'Disallow: /ignored', chr(10), 'User-agent: other', chr(10), 'User-agent: NewsBot', chr(10),
  'Disallow: /', chr(10), chr(10), 'User-agent: *', chr(10), 'Allow: /en/1', chr(10), 'Disallow: /en/ # part', chr(10),
  CASE WHEN domain LIKE 'www.%' THEN concat('Disallow:', chr(10)) ELSE '' END, 'Disallow: /es/', chr(10), 'Sitemap: x') END"""


def _robots(spark, sf):
    hosts = table(spark, sf, "pages").select(F.expr(_HOST).alias("domain")).distinct()
    return hosts.select("domain", F.expr(_ROBOTS).alias("robots_txt"))


_WITH_RULES = f"(SELECT DISTINCT {_HOST} AS domain FROM pages) h"


@query(
    "robots_rules",
    f"""SELECT domain, agent, path, allow FROM {_WITH_RULES}, (VALUES ('other', '/', false, 0), ('newsbot', '/', false, 0), ('*', '/en/1', true, 0),
      ('*', '/en/', false, 0), ('*', '', true, 1), ('*', '/es/', false, 0)) r(agent, path, allow, www)
    WHERE domain NOT LIKE 'm.%' AND (www = 0 OR domain LIKE 'www.%')""",
)
def _(spark, sf):
    return Q.parse_robots(_robots(spark, sf)).select("domain", "agent", "path", "allow")


_PATH = "regexp_extract(url, '^https?://[^/]+(/.*)', 1)"
_ALLOWED = f"""CASE WHEN {_HOST} LIKE 'm.%' THEN true WHEN starts_with({_PATH}, '/en/1') THEN true WHEN starts_with({_PATH}, '/en/') THEN false
    WHEN {_HOST} LIKE 'www.%' THEN true WHEN starts_with({_PATH}, '/es/') THEN false ELSE true END"""


@query(
    "robots_gate",
    f"""SELECT page_id, '*' AS agent, {_ALLOWED} AS allowed FROM pages UNION ALL
    SELECT page_id, 'newsbot/2.1' AS agent, {_HOST} LIKE 'm.%' AS allowed FROM pages""",
)
def _(spark, sf):
    urls, robots = table(spark, sf, "pages").select("page_id", "url"), _robots(spark, sf)
    gates = [
        Q.robots_gate(urls, robots, agent).select("page_id", F.lit(agent).alias("agent"), "allowed")
        for agent in ("*", "newsbot/2.1")
    ]
    return gates[0].union(gates[1])


# --- frontier ------------------------------------------------------------------------------
# attempts from events: one URL per user and slot, on few sites
_URL = "concat('https://site', user_id % 13, '.example.org/', user_id, '/', event_id % 40)"
ATTEMPTS_SQL = (
    f"SELECT {_URL} AS url, concat('site', user_id % 13, '.example.org') AS domain, event_id % 5 AS priority, "
    "event_type <> 'error' AS ok, ts, event_id, event_type, value FROM events"
)


def attempts(spark, sf):
    return table(spark, sf, "events").select(
        F.expr(_URL).alias("url"), F.expr("concat('site', user_id % 13, '.example.org')").alias("domain"),
        F.expr("event_id % 5").alias("priority"), (F.col("event_type") != "error").alias("ok"),
        "ts", "event_id", "event_type", "value",
    )


@query(
    "frontier_admission",
    f"""SELECT url, min(priority) AS priority FROM ({ATTEMPTS_SQL}) a
    WHERE url NOT IN (SELECT url FROM ({ATTEMPTS_SQL}) v WHERE event_type = 'purchase')
      AND url NOT IN (SELECT url FROM ({ATTEMPTS_SQL}) v WHERE event_type = 'signup') GROUP BY url""",
)
def _(spark, sf):
    a = attempts(spark, sf)
    return Q.admit(a, a.filter("event_type = 'purchase'"), a.filter("event_type = 'signup'"))


_BUDGET = 30
_GATED = f"""SELECT url, any_value(domain) AS domain, min(priority) AS priority, NOT contains(url, '/1') AS allowed FROM ({ATTEMPTS_SQL}) a GROUP BY url"""
_DONE = f"SELECT domain, count(*) % 20 AS n_done FROM ({ATTEMPTS_SQL}) a WHERE event_type = 'signup' GROUP BY domain"


def _schedule_inputs(spark, sf):
    a = attempts(spark, sf)
    frontier = a.groupBy("url").agg(F.first("domain").alias("domain"), F.min("priority").alias("priority")).withColumn(
        "allowed", ~F.col("url").contains("/1")
    )
    done = a.filter("event_type = 'signup'").groupBy("domain").agg((F.count("*") % 20).alias("n_done"))
    return frontier, done


_RANKED = f"""SELECT g.*, coalesce(n_done, 0) AS n_done, row_number() OVER (PARTITION BY g.domain ORDER BY priority, url) AS rn
    FROM (SELECT * FROM ({_GATED}) x WHERE allowed) g LEFT JOIN ({_DONE}) d ON g.domain = d.domain"""


@query(
    "crawl_schedule",
    f"""SELECT url, domain, priority, CASE WHEN rn <= {_BUDGET} - n_done THEN 'scheduled' ELSE 'skipped' END AS status,
      CASE WHEN rn <= {_BUDGET} - n_done THEN rn ELSE -1 END AS position, CASE WHEN rn <= {_BUDGET} - n_done THEN (rn - 1) * 2.0::DOUBLE ELSE -1 END AS wait_seconds
    FROM ({_RANKED}) r UNION ALL SELECT url, domain, priority, 'skipped_robots', -1, -1 FROM ({_GATED}) x WHERE NOT allowed""",
)
def _(spark, sf):
    frontier, done = _schedule_inputs(spark, sf)
    out = Q.schedule(frontier, _BUDGET, done=done)
    return out.select(
        "url", "domain", "priority", "status", F.coalesce(F.col("position").cast("bigint"), F.lit(-1)).alias("position"),
        F.coalesce("wait_seconds", F.lit(-1.0)).alias("wait_seconds"),
    )


@query(
    "crawl_schedule_due",
    f"SELECT url, domain, rn AS position FROM ({_RANKED}) r WHERE rn <= {_BUDGET} - n_done",
)
def _(spark, sf):
    frontier, done = _schedule_inputs(spark, sf)
    out = Q.schedule(frontier, _BUDGET, done=done, keep_skipped=False)
    return out.select("url", "domain", F.col("position").cast("bigint").alias("position"))


CRAWL_STATUS_SQL = f"""SELECT url, CASE WHEN bool_or(ok) THEN 'done' WHEN count(*) FILTER (WHERE NOT ok) > 2 THEN 'failed' ELSE 'retrying' END AS status,
    count(*) FILTER (WHERE NOT ok) AS n_failures FROM ({ATTEMPTS_SQL}) a GROUP BY url"""


@query("crawl_status", CRAWL_STATUS_SQL)
def _(spark, sf):
    return Q.crawl_status(attempts(spark, sf))


_LATEST = f"SELECT url, arg_max(event_type, ts) AS status FROM ({ATTEMPTS_SQL}) a GROUP BY url"


@query("latest_status", _LATEST)
def _(spark, sf):
    return Q.latest_status(attempts(spark, sf).withColumnRenamed("event_type", "status"))


@query(
    "status_lookup",
    f"""SELECT a.url, coalesce(s.status, 'unknown') AS status FROM (SELECT DISTINCT url FROM ({ATTEMPTS_SQL}) x UNION ALL SELECT url FROM pages) a
    LEFT JOIN ({CRAWL_STATUS_SQL}) s ON a.url = s.url""",
)
def _(spark, sf):
    a = attempts(spark, sf)
    asked = a.select("url").distinct().union(table(spark, sf, "pages").select("url"))
    return Q.lookup_status(asked, Q.crawl_status(a))


@query("retrying_urls", f"SELECT url FROM ({CRAWL_STATUS_SQL}) s WHERE status = 'retrying'")
def _(spark, sf):
    return Q.urls_with_status(Q.crawl_status(attempts(spark, sf)), "retrying")


@query("status_counts", f"SELECT status, count(*) AS n_urls FROM ({CRAWL_STATUS_SQL}) s GROUP BY status")
def _(spark, sf):
    return Q.status_counts(Q.crawl_status(attempts(spark, sf)))
