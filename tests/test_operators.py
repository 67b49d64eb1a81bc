"""Hand-derived results for each rule and branch."""

import random
import time
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from gleaner.functions import classify as K, contacts as C, html as H, normalize as N, text as T, urls as U
from gleaner.operators import contacts as XC, frontier as Q, leads as L, links as XL, pages as P, reports as R, search as S, tables as X
from gleaner.operators.skew import hot_keys, salted_join

NOW = "2024-02-01 00:00:00"


def col1(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", column.alias("x"))
    return [r["x"] for r in sorted(rows.collect(), key=lambda r: r["i"])]


# --- text ----------------------------------------------------------------------------------
def test_html_to_text(spark):
    html = "<p> a\n b</p><script>x<!-- </script><!-- <script> --> <b>c &lt; d</b> 1 < 2 &#8364;&#x1F600;&nbsp;&bogus; &amp;lt;"
    assert col1(spark, T.html_to_text("t"), html, None, "") == ["a\n b c < d 1 < 2 €😀\xa0&bogus; &lt;", None, ""]


def test_unclosed_markup_runs_to_the_end(spark):
    assert col1(spark, T.html_to_text("t"), "a<b", "a<!-- b", "a <script>b") == ["a", "a", "a"]


def test_boilerplate_blocks_language(spark):
    assert col1(spark, T.remove_boilerplate("t"), "a\n Copyright \nb\r\nPRIVACY policy") == ["a b"]
    assert col1(spark, T.largest_block("t"), "ab\n\ncd\n\n\nxyz", "ab\n\ncd") == ["xyz", "ab"]
    assert col1(spark, T.detect_language("t"), "this is not the end", "this is the", "It's what we don't have") == ["en", None, "en"]
    assert col1(spark, T.clean_text("t"), "<p>x\n\nlonger block\nfooter</p>") == ["longer block"]


def test_bytes(spark):
    got = spark.range(1).select(T.to_utf8(F.expr("concat(unhex('FF'), encode('aé', 'UTF-8'), unhex('C3'))"), binary=True)).first()[0]
    assert got == "aé"


# --- html ----------------------------------------------------------------------------------
def test_title_cascade(spark):
    pages = [
        "<title> A &amp; B </title><h1>h</h1>", '<title> </title><meta property="og:title" content=" og ">', "<meta name='title' content='m'>",
        "<header><h1>no</h1></header><h1>yes <b>b</b></h1>", "<p>x</p>",
    ]
    assert col1(spark, H.page_title("t"), *pages) == ["A & B", "og", "m", "yes b", ""]


def test_meta_last_wins(spark):
    html = '<meta name="K" content="1"><meta property=k content="2"><meta name="e" content=""><meta charset="utf-8" content="3">'
    assert col1(spark, H.page_meta("t"), html) == [{"k": "2", "": "3"}]


def test_jsonld_and_microdata(spark):
    html = '<script type="application/ld+json">[{"a":1},{"b":[1]}]</script><script type=application/ld+json>{bad</script><script>{"c":1}</script><i itemscope itemtype="T" id=\'q\'>'
    assert col1(spark, H.jsonld_items("t"), html) == [['{"a":1}', '{"b":[1]}']]
    got = col1(spark, H.microdata("t"), html)[0][0]
    assert (got["itemtype"], got["properties"]) == ("T", {"itemtype": "T", "id": "q"})


def test_main_content(spark):
    pages = spark.createDataFrame([
        (1, "<body><nav>n</nav><main>a <p>b</p></main><div>much longer text</div></body>"),
        (2, "<body><div>x<div>long inner</div></div><div>short</div></body>"),
        (3, "<title>t</title><body>only <b>body</b><footer>f</footer></body>"),
        (4, "<div>open <div>never closed"),
        (5, None),
    ], "page_id long, html string")
    got = {r["page_id"]: r["main_text"] for r in P.main_content(pages).collect()}
    assert got == {1: "a b", 2: "x long inner", 3: "only body", 4: "open never closed", 5: None}


def test_urljoin(spark):
    rng = random.Random(3)
    bases = ["http://a.b/c/d;p?q#f", "https://h.org", "http://h.org/", "http://h.org/x/", "http://h.org/x//y"]
    parts = ["a", "..", ".", "b c", "é", "", "x.html", "...", "g;x=1"]
    hrefs = {"", "#", "?", "?a=b", "#z", "//n.et/p", "mailto:x@y", "http://z/", "HTTP://z/Q", "/", "/..", "../../../../g", "g:h", "./", "../"}
    for _ in range(300):
        path = "/".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))
        hrefs.add(rng.choice(["", "/"]) + path + rng.choice(["", "", "?q=1/..", "#s/../x"]))
    cases = [(b, h) for b in bases for h in sorted(hrefs) if not h.startswith("//") or h == "//n.et/p"]
    df = spark.createDataFrame(cases, "b string, h string")
    for r in df.select("b", "h", U.resolve_url("b", "h").alias("x")).collect():
        want = urljoin(r["b"], r["h"])
        assert r["x"] == want, (r, want)


def test_domain(spark):
    urls = ["http://a.b:8/x", "//h/y", "no url", "https://é.org?q", "mailto:x@y"]
    assert col1(spark, U.domain("t"), *urls) == ["a.b:8", "h", "unknown", "é.org", "unknown"]


# --- contacts ------------------------------------------------------------------------------
def test_contact_functions(spark):
    assert col1(spark, C.extract_emails("t", True), "mail a@b.com, a@b.com info [at] example [dot] com") == [["a@b.com", "info@example.com"]]
    assert col1(spark, C.extract_phones("t", True), "+91 [space] 12345 [space] 67890") == [["+911234567890"]]
    assert col1(spark, C.social_profiles("t"), "x https://www.facebook.com/x y") == [["https://www.facebook.com/x"]]
    assert col1(spark, C.street_addresses("t"), "at 12 Main Street today") == [["12 Main Street"]]
    assert col1(spark, C.job_titles("t"), "<b>our CEO</b>, Chief Data Officer; éowner") == [["CEO", "Chief Data Officer"]]
    assert col1(spark, C.lead_type("t", F.lit("The Inn")), "menu") == ["hotel"]
    assert col1(spark, C.lead_type("t", F.lit("x")), "our menu", "none") == ["restaurant", "unknown"]


@pytest.mark.parametrize("text, pair", [
    ("email: a@b.co, phone: +1 555 123 4567", ("a@b.co", "+1 555 123 4567")),
    ("phone: +1 555 123 4567 email: a@b.co", ("a@b.co", "+1 555 123 4567")),
    ("a@b.co +1 555 123 4567", ("a@b.co", "+1 555 123 4567")),
    ("a@b.co then call +1 555 123 4567", ("a@b.co", "+1 555 123 4567")),
])
def test_pairs(spark, text, pair):
    got = col1(spark, C.email_phone_pairs("t"), text)[0]
    assert {tuple(p) for p in got} == {pair}


def test_paired_leads(spark):
    docs = spark.createDataFrame([
        (1, "email: a@b.co, phone: +1 555 123 4567"),
        (2, "a@b.co +1 555 123 4567 x c@d.ee +1 555 123 4567 x e@f.gg"),
        (3, None),
        (4, "Anna Smith: lone@x.org\ncall +1 555 999 0000"),
    ], "doc_id long, text string")
    got = L.paired_leads(docs).collect()
    rows = sorted((r["doc_id"], r["email"] or "", r["phone"] or "", r["confidence_score"]) for r in got)
    assert rows == [
        (1, "a@b.co", "+1 555 123 4567", 0.8),
        (2, "a@b.co", "+1 555 123 4567", 0.8), (2, "c@d.ee", "", 0.6), (2, "e@f.gg", "", 0.6),
        (4, "lone@x.org", "+1 555 999 0000", 0.8),
    ]
    assert {r["contact_person"] for r in got if r["doc_id"] == 4} == {"Anna Smith"}
    assert {r["business_name"] for r in got} == {"Unknown Business"}


def test_people_are_those_of_each_contact(spark):
    texts = [
        "Manager: Jean Dubois, a@b.co or c@d.ee", "Anna Smith: lone@x.org\ncall Bob Ray: x@y.zz\n\nEve Kay: no one\nq@r.st", "x@y.zz x@y.zz",
        "Manager: Jean Dubois", "at @ home", "", None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = sorted(tuple(r) for r in XC.contact_people(docs).collect())
    assert got == [
        (0, "a@b.co", "Jean Dubois"), (0, "c@d.ee", "Jean Dubois"),
        (1, "lone@x.org", "Anna Smith"), (1, "q@r.st", "Eve Kay"), (1, "x@y.zz", "Bob Ray"),
        (2, "x@y.zz", "Unknown Contact"),
    ]


def test_names_are_looked_for_once_in_a_text(spark):
    """Four times the addresses in one text, far less than sixteen times the time."""
    def seconds(n):
        docs = spark.createDataFrame([(1, "Owner " + " ".join(f"a{i}@b.co" for i in range(n)))], "doc_id int, text string")
        start = time.monotonic()
        assert len(XC.contact_people(docs).collect()) == n
        return time.monotonic() - start

    seconds(10)
    small, large = min(seconds(3_000) for _ in range(2)), seconds(12_000)
    assert large < 8 * max(small, 0.5)


def test_every_lead_contact_is_in_its_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").cast("string").alias("source_url"), "text")
    leads = L.flat_leads(docs, NOW).join(docs, "source_url")
    assert leads.filter("not contains(text, coalesce(email, phone, text))").count() == 0


# --- normalisers ---------------------------------------------------------------------------
def test_normalisers(spark):
    assert col1(spark, N.normalize_email("t"), " A@B.COM ", "bad@", "a@b.com.", "") == ["a@b.com", "", "a@b.com", ""]
    assert col1(spark, N.normalize_business_name("t"), " joe's b-c & co ", "café übérall") == ["Joes B-C & Co", "Cafe Uberall"]
    assert col1(spark, N.normalize_currency("t"), "USD 1,250.50", "n/a", "1.2.3") == [1250.5, 0.0, 0.0]
    dates = ["2024-1-5", "05/02/2024", "13/25/2024", "12/25/2024", "05-02-2024", "Jan 5, 2024", "january 5, 2024", "soon", "2024-02-30"]
    want = ["2024-01-05", "2024-02-05", None, "2024-12-25", "2024-02-05", "2024-01-05", "2024-01-05", None, None]
    assert col1(spark, N.normalize_date("t"), *dates) == [w and f"{w}T00:00:00" for w in want]
    phones = ["+91 98765-43210", "98765 43210", "098765 43210", "0044 20 7946 0958", "919876543210", "+1 (212) 555-0100", "152.143.123.131", "+999 123", ""]
    assert col1(spark, N.normalize_phone("t"), *phones) == [
        "+919876543210", "+919876543210", "+919876543210", "+442079460958", "+919876543210", "+12125550100", "", "", "",
    ]


@pytest.mark.parametrize("fn", [N.normalize_email, N.normalize_address, T.clean_whitespace])
def test_idempotent(spark, fn):
    texts = [" A@B.C ", "x \t y  z", "", "​a b"]
    once = col1(spark, fn("t"), *texts)
    assert col1(spark, fn("t"), *once) == once


# --- classification and scores -------------------------------------------------------------
def test_classification(spark):
    assert col1(spark, K.content_type("t"), "a BLOG of hotels", "blog post", "score", "x") == ["business", "blog", "review", "other"]
    assert col1(spark, K.vertical("t"), "tour operator", "x") == ["tour operator", "other"]
    assert col1(spark, K.intent("t"), "book a guide", "how to", "x") == ["commercial", "informational", "unknown"]
    assert col1(spark, K.quality("t"), "hotel" + "x" * 995, "x" * 285, "") == [1.2, 0.29, 0.0]
    assert col1(spark, K.is_spam("t"), "FREE  gift", "gift") == [True, False]
    assert col1(spark, K.keywords("t", 2), "bbbb aaaa bbbb aaaa cccc") == [["bbbb", "aaaa"]]


def test_scores(spark):
    leads = spark.createDataFrame([
        (1, "Grand Hotel", "a@b.co", "1", "http://x", None, ["p"], 3, "2024-01-20", None, 6.0),
        (2, None, "", None, None, None, None, None, "2030-01-01", "2023-09-01T10:00:00+02:00", None),
        (3, "x", None, None, None, "never", [], 0, "bad", "", 5.0),
    ], "id int, business_name string, email string, phone string, website string, address string, social_profiles array<string>, "
       "review_count int, publish_date string, website_last_updated string, domain_age_years double")
    got = {r["id"]: r["scoring"] for r in L.score_leads(leads, NOW).collect()}
    assert [got[1][c] for c in ("completeness_score", "relevance_score", "freshness_score", "final_score")] == [0.7, 0.8, 0.6, 0.72]
    assert [got[2][c] for c in ("completeness_score", "relevance_score", "freshness_score", "final_score")] == [0.0, 0.0, 0.7, 0.14]
    assert [got[3][c] for c in ("completeness_score", "relevance_score", "freshness_score", "final_score")] == [0.3, 0.0, 0.0, 0.12]


def test_validation(spark):
    leads = spark.createDataFrame([
        (1, "a@b.co", "https://x.org/p"), (2, "a@b", None), (3, None, "ftp://x"), (4, "a..b@c.org", None), (5, None, None),
    ], "id int, email string, website string").withColumn("created_at", F.current_timestamp())
    good, bad = L.validate_leads(leads)
    assert sorted(r["id"] for r in good.collect()) == [1, 5]
    assert sorted((r["id"], r["reject_reason"]) for r in bad.collect()) == [(2, "email"), (3, "website"), (4, "email")]


# --- search --------------------------------------------------------------------------------
def test_first_seen_keeps_the_earliest(spark):
    rows = spark.createDataFrame([("u", 3, "c"), ("u", 1, "a"), ("v", 2, "b"), ("u", 2, "z")], "url string, seq int, title string")
    assert sorted(tuple(r) for r in S.first_seen(rows, ["url"], ["seq"]).collect()) == [("u", 1, "a"), ("v", 2, "b")]


def test_query_text(spark):
    got = spark.range(1).select(
        S.build_query(F.lit("base"), F.lit(None).cast("string"), exclude=[], target_groups=False, trip_types=False)
    ).first()[0]
    assert got == "base travel vacation journey holiday tour visit trip"


# --- links and frontier --------------------------------------------------------------------
def test_reachable(spark):
    edges = spark.createDataFrame(
        [("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "d"), ("b", "a"), ("a", "a")], "src_url string, dst_url string"
    )
    pages = spark.createDataFrame([("a", 200), ("b", 200), ("c", 200), ("d", 200), ("x", 404)], "url string, status_code int")
    seeds = spark.createDataFrame([("a",)], "seed string")
    got = {(r["url"], r["depth"]) for r in XL.reachable(edges, pages, seeds, 2).collect()}
    assert got == {("b", 1), ("c", 2)}
    assert {(r["url"], r["depth"]) for r in XL.reachable(edges, pages, seeds, 3).collect()} == {("b", 1), ("c", 2), ("d", 3)}
    assert XL.reachable(edges, pages, seeds, 0).count() == 0


def test_robots(spark):
    text = (
        "User-agent: *\nAllow: /a\nDisallow: /\nDisallow: /a/b\n\n# note\nUser-agent: Bot\nUser-agent: Two\nDisallow: /p\nDisallow:\n\n"
        "User-agent: norules\n\nUser-agent: *\nAllow: /\n"
    )
    robots = spark.createDataFrame([("h", text)], "domain string, robots_txt string")
    urls = spark.createDataFrame([("http://h/a/b",), ("http://h/c",), ("http://h/p?x",), ("http://other/",)], "url string")

    def gate(agent):
        return {r["url"]: r["allowed"] for r in Q.robots_gate(urls, robots, agent).collect()}

    assert gate("*") == {"http://h/a/b": True, "http://h/c": False, "http://h/p?x": False, "http://other/": True}
    assert gate("bot/1.0") == {"http://h/a/b": True, "http://h/c": True, "http://h/p?x": False, "http://other/": True}
    assert gate("norules") == gate("*")
    rules = Q.parse_robots(robots).collect()
    assert sorted((r["agent"], r["path"], r["allow"]) for r in rules if r["agent"] == "two") == [("two", "", True), ("two", "/p", False)]


def test_schedule_invariants(spark):
    rows = [(f"http://hot/{i:04d}", i % 3) for i in range(400)] + [(f"http://h{i}/", 0) for i in range(20)]
    frontier = spark.createDataFrame(rows, "url string, priority int")
    done = spark.createDataFrame([("hot", 90), ("h1", 500)], "domain string, n_done long")
    out = Q.schedule(frontier, 100, 2.0, done).collect()
    assert len(out) == len(rows) and len({r["url"] for r in out}) == len(rows)
    hot = sorted((r["position"], r["url"], r["wait_seconds"]) for r in out if r["domain"] == "hot" and r["status"] == "scheduled")
    assert [h[0] for h in hot] == list(range(1, 11)) and hot[0][1] == "http://hot/0000" and hot[-1][2] == 18.0
    assert [h[1] for h in hot] == [f"http://hot/{i:04d}" for i in range(0, 30, 3)]
    assert {r["status"] for r in out if r["domain"] == "h1"} == {"skipped"}


def test_status_fold(spark):
    rows = [("f", False)] * 3 + [("r", False)] * 2 + [("d", False), ("d", True)]
    got = {r["url"]: r["status"] for r in Q.crawl_status(spark.createDataFrame(rows, "url string, ok boolean")).collect()}
    assert got == {"f": "failed", "r": "retrying", "d": "done"}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_a_plain_join(spark, how):
    left = spark.range(500).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("k"), "id")
    right = spark.range(0, 30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = left.join(right, "k", how)
    for share in (0.0, 0.1, 1.0):  # every key hot, one key hot, none
        salted = salted_join(left, right, "k", how, salts=7, share=share).select(*plain.columns)
        assert sorted(map(tuple, salted.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_salted_join_takes_map_columns(spark):
    left = spark.range(20).select((F.col("id") % 2).alias("k"), "id", F.create_map(F.lit("a"), "id").alias("m"))
    right = spark.range(2).select(F.col("id").alias("k"))
    assert salted_join(left, right, "k", salts=3).count() == 20


def test_salted_join_keeps_null_keys(spark):
    left = spark.createDataFrame([(None, 1), (1, 2), (1, 3), (2, 4)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (None, "n")], "k int, w string")
    got = sorted(map(tuple, salted_join(left, right, "k", "left", share=0.3).select("v", "w").collect()))
    assert got == [(1, None), (2, "a"), (3, "a"), (4, None)]
    assert [r["k"] for r in hot_keys(left, "k", 0.5).collect()] == [1]


# --- tables --------------------------------------------------------------------------------
def test_tables_have_no_orphans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.concat(F.lit("http://d/"), "doc_id").alias("source_url"), "text")
    scored = L.score_leads(L.flat_leads(docs, NOW), NOW)
    lead, score = X.store_leads(scored)
    url, content = X.upsert_dims(scored, NOW)
    assert lead.join(content, lead["content_id"] == content["id"], "left_anti").count() == 0
    assert content.join(url, content["url_id"] == url["id"], "left_anti").count() == 0
    assert score.join(lead, score["lead_id"] == lead["id"], "left_anti").count() == 0
    assert lead.select("id").distinct().count() == lead.count() > 0
    assert X.lead_view(lead, content, url, score).filter("source_url is null or scoring.final_score not between 0 and 1").count() == 0
    again_url, again_content = X.upsert_dims(scored, NOW, url, content)
    assert again_url.count() == again_content.count() == 0


def test_missing_sources(spark):
    got = spark.createDataFrame([(None,), ("",), ("None",), ("u",)], "s string").select(X.source_of("s")).collect()
    assert [r[0] for r in got] == ["unknown", "unknown", "unknown", "u"]


# --- reports -------------------------------------------------------------------------------
def test_reports_guard_empty_input(spark):
    none = spark.createDataFrame([], "ts timestamp, pages int, leads int, api_calls int, api_cost double")
    assert R.throughput(none).first()["leads_per_hour"] == 0.0
    nothing = spark.createDataFrame([], "crawl_ok boolean, lead_ok boolean")
    assert tuple(R.success_rates(nothing).first()) == (0.0, 0.0)


def test_harvest(spark):
    pages = spark.createDataFrame([
        ("http://s/", '<a href="/about">x</a><a href="/team">Contact us</a>'), ("http://s/team", "a@b.co +1 555 123 4567"), ("http://s/about", "no@no.no"),
    ], "url string, html string")
    got = sorted(tuple(r) for r in XC.harvest_contacts(pages).collect())
    assert got == [("http://s/", "email", "a@b.co"), ("http://s/", "phone", "+1 555 123 4567")]


def test_jobs_run_by_priority_then_time(spark):
    jobs = spark.createDataFrame([("c", 1, 5), ("a", 0, 9), ("b", 0, 3), ("d", 1, 1)], "query string, priority int, timestamp int")
    assert [r["query"] for r in S.order_jobs(jobs).collect()] == ["b", "a", "d", "c"]


def test_lead_pages(spark):
    view = spark.range(10).select(F.col("id"), F.lit(0).alias("created_at"))
    assert [r["id"] for r in X.lead_page(view, 3, 2).collect()] == [2, 3, 4]
    assert X.lead_page(view, None, 4).count() == 6 and X.lead_page(view, 0).count() == 10


def test_robots_paths_are_decoded(spark):
    from gleaner.operators import frontier

    robots = spark.createDataFrame([("a.org", "User-agent: *\nDisallow: /caf%C3%A9\nDisallow: /a+b\nDisallow: /50%")], "domain string, robots_txt string")
    urls = spark.createDataFrame([(f"http://a.org{p}",) for p in ("/café/x", "/caf%c3%a9", "/cafe", "/a%2Bb", "/a b", "/50%off")], "url string")
    got = {r["url"].removeprefix("http://a.org"): r["allowed"] for r in frontier.robots_gate(urls, robots).collect()}
    assert got == {"/café/x": False, "/caf%c3%a9": False, "/cafe": True, "/a%2Bb": False, "/a b": True, "/50%off": False}


def test_one_page_by_canonical_with_null_urls_and_repeats(spark):
    link = "<link rel=canonical href=http://c/1>"
    rows = [
        (1, "http://b", link, {"a": "x"}), (2, None, link, {"a": "x"}), (3, "http://a", link, None), (3, "http://a", link, None),  # a url comes before none
        (4, None, "<link rel=canonical href=http://c/2>", None), (4, None, "<link rel=canonical href=http://c/2>", None),  # none has a url
        (5, None, "<p>one", {"b": "y", "c": "z"}), (6, None, None, None),  # neither url nor link
        (7, "http://d", "<p>same", {"b": "y"}), (8, "http://d", "<p>same", {"b": "y"}),  # differ elsewhere only
    ]
    got = P.first_by_canonical(spark.createDataFrame(rows, "page_id int, url string, html string, headers map<string,string>"))
    assert got.columns == ["page_id", "url", "html", "headers", "canonical_url"]
    found = sorted(((r["canonical_url"] or "", r["url"], r["page_id"]) for r in got.collect()))
    assert [f[:2] for f in found] == [("", None), ("http://c/1", "http://a"), ("http://c/2", None), ("http://d", "http://d")]
    assert found[0][2] in (5, 6) and [f[2] for f in found[1:3]] == [3, 4] and found[3][2] in (7, 8)


def test_hot_keys_come_from_a_sketch(spark):
    """Every key above the share, whatever stands beside them; no count of all keys."""
    n = 100_000
    key = F.when(F.col("id") % 10 < 3, "hot").when(F.col("id") % 10 == 3, F.concat(F.lit("warm"), F.col("id") % 40)).otherwise(F.concat(F.lit("k"), "id"))
    rows = spark.range(n).withColumn("key", F.when(F.col("id") % 97 > 0, key))
    got = {r["key"]: r["_salts"] for r in hot_keys(rows, "key").collect()}
    assert set(got) == {"hot"} | {f"warm{k}" for k in (3, 13, 23, 33)} and 290 <= got["hot"] <= 320
    plan = hot_keys(rows, "key")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    assert hot_keys(rows.limit(0), "key").collect() == []
