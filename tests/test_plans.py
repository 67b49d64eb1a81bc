"""Physical plans: one scan, no shuffle where none is needed, no products, limits before shuffles."""

import pytest
from pyspark.sql import functions as F

from gleaner.operators import contacts as XC, frontier as Q, leads as L, links as XL, pages as P, search as S
from gleaner.plans import lead_job

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("job", [
    lambda p, d: P.clean_pages(p), lambda p, d: P.parse_pages(p), lambda p, d: XC.extract_contacts(d), lambda p, d: XC.extract_patterns(d),
    lambda p, d: L.paired_leads(d), lambda p, d: XL.outlinks(p), lambda p, d: L.classify_documents(d), lambda p, d: L.structured_leads(p),
    lambda p, d: lead_job.scored_leads(p, "2024-01-01"), lambda p, d: P.main_content(p),
])
def test_row_local_jobs_scan_once_and_never_shuffle(pages, docs, job):
    text = plan(job(pages, docs))
    assert text.count("FileScan") == 1
    assert "Exchange" not in text


def test_python_runs_only_where_stated(pages, docs):
    for df in (P.parse_pages(pages), XC.extract_contacts(docs), L.paired_leads(docs), XL.outlinks(pages)):
        assert "Python" not in plan(df)
    assert "MapInPandas" in plan(P.main_content(pages))
    assert "BatchEvalPython" not in plan(L.classify_documents(docs))


def html_scans(df):
    return sum("html:" in part.split(">")[0] for part in plan(df).split("ReadSchema: struct<")[1:])


def test_page_sources_are_not_shuffled(spark, pages):
    """What is chosen or joined are hashes, addresses and contacts."""
    chosen = P.first_by_canonical(pages)
    assert html_scans(chosen) == 1 and "hashpartitioning" not in plan(chosen)
    linked = F.concat(F.lit("<link rel=canonical href=http://c/"), F.col("page_id") % 7, F.lit(">"), "html")
    copies = pages.withColumn("html", linked)
    near, far = (P.first_by_canonical(copies.union(copies.limit(3)), most=n) for n in (10**6, 0))
    assert near.count() == 7 and sorted(near.collect()) == sorted(far.collect())  # beyond the bound: a join, the same pages
    assert html_scans(XC.harvest_contacts(pages)) == 1


def test_analysed_plans_stay_small(pages):
    """A tree that decodes text is repeated with each use: its size bounds the time to plan."""
    text = P.parse_pages(pages)._jdf.queryExecution().analyzed().treeString()
    assert len(text) < 400_000


def test_page_source_is_not_read_without_need(pages):
    read = plan(pages.select("url").filter("url like 'http%'")).split("ReadSchema")[1]
    assert "html" not in read


def test_extracted_arrays_are_computed_once(docs):
    # an explode of a computed column would push a copy of its computation into a filter
    assert plan(L.paired_leads(docs)).count("(?i:email)") == 4


def test_each_form_of_a_pair_is_searched_once(spark, docs):
    # three forms, e-mails and phones
    assert plan(XC.contact_pairs(docs)).count("regexp_extract_all") == 5
    # a domain takes all digits that a phone can spare
    texts = ["a@b.co1234567890 \x01 c@d.ee.\x01+1 555 123 4567", "Phone: 555-123-4567.89, email: m@n.o1 email: a1@p.qq, PHONE 00 12 345 6789"]
    rows = XC.contact_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id", "seq").collect()
    assert [tuple(r) for r in rows] == [
        (0, 0, "a@b.co1", "234567890"), (0, 1, "c@d.ee.", "+1 555 123 4567"),
        (1, 0, "a1@p.qq", "00 12 345 6789"), (1, 1, "m@n.o1", "555-123-4567.89"),
    ]


def test_rankings_limit_before_the_shuffle(spark):
    hits = spark.range(100).select((F.col("id") % 3).alias("query"), F.col("id").alias("seq"))
    frontier = spark.range(100).select(F.concat(F.lit("http://h"), F.col("id") % 3, F.lit("/"), "id").alias("url"), F.lit(1).alias("priority"))
    for df in (S.cap_per_query(hits, 5), Q.schedule(frontier, 10, keep_skipped=False)):
        text = plan(df)
        assert text.count("WindowGroupLimit") == 2 and ", Partial" in text


def test_no_products(spark, pages):
    urls = pages.select("url")
    robots = spark.createDataFrame([("h", "User-agent: *\nDisallow: /")], "domain string, robots_txt string")
    frontier = urls.withColumn("priority", F.lit(1))
    for df in (Q.robots_gate(urls, robots), Q.schedule(frontier, 10), XC.harvest_contacts(pages)):
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_spelled_businesses_are_dealt_over_tasks(spark):
    """Customers of one split become pages and texts in many tasks."""
    from gleaner.catalogue import inputs as I

    for rows in (I.notes(spark, SF), I.shop_pages(spark, SF)):
        assert rows.select(F.spark_partition_id()).distinct().count() >= 4


def test_tasks_grow_with_the_businesses(spark, monkeypatch):
    """As many as the cluster has cores, more for many businesses, whatever a shuffle has."""
    from gleaner.catalogue import inputs as I

    cores, partitions = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.shuffle.partitions")
    customers = spark.read.parquet(f"{SF}/customer.parquet").count()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "50")
        assert I.shops(spark, SF).rdd.getNumPartitions() == cores
        monkeypatch.setattr(I, "PER_TASK", 5)
        assert I.shops(spark, SF).rdd.getNumPartitions() == max(-(-customers // 5), cores)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_texts_without_contacts_give_no_paired_lead(spark):
    texts = ["Grand Hotel, 12 Main Street", "Grand Hotel, 12 Main Street, a@b.org", "Grand Hotel +91 98000 00000", "at @ home", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert [(r["doc_id"], r["address"]) for r in L.paired_leads(docs).orderBy("doc_id").collect()] == [(1, "12 Main Street"), (2, None)]
    # names and addresses of a text are looked for behind the test for a contact
    assert "CASE WHEN ((Contains(" in plan(L.paired_leads(docs))



def test_words_at_the_end_of_a_run_are_tried_at_their_first_letters(spark, docs):
    text = plan(XC.extract_patterns(docs))
    assert "(?=[ABCGHILRT])(?:Hotel|" in text and "(?=[ABCDFGHLMPRSTVWZ])(?:Street|" in text
    # words that are patterns are tried everywhere
    assert XC.C._ends_with_word(["Inn|otel", "Cafe"]) == "(?:Inn|otel|Cafe)"
    rows = spark.createDataFrame([("Grand inn Motel, 12 Some way, 7 Elm STREET",)], "t string")
    names = rows.select(XC.C.business_names("t", ["Inns?", "Motel"]).alias("n"), XC.C.first_address("t").alias("a")).first()
    assert (names["n"], names["a"]) == (["Grand inn Motel"], "12 Some way, 7 Elm STREET")


def test_structured_leads_read_no_other_properties(spark, pages):
    assert "map_from_entries" in plan(P.microdata_table(pages)) and "map_from_entries" not in plan(L.structured_leads(pages))
    html = '<div itemscope itemtype="https://schema.org/Hotel" id="a" id="b"></div><p itemtype=x><i itemtype>&<b ITEMTYPE=\'LocalBusiness&amp;\'>'
    rows = L.structured_leads(spark.createDataFrame([(1, "u", html), (2, "u", None)], "page_id int, url string, html string")).collect()
    assert [(r["page_id"], r["lead_type"]) for r in rows] == [(1, "https://schema.org/hotel"), (1, "localbusiness&")]


def test_ampersands_need_no_pattern(spark):
    from gleaner.functions import text as T

    rows = spark.createDataFrame([("a &amp; b &amp;lt; &ampx; &amp &AMP; &amp;amp; & &am;p",)], "t string").select(T.html_unescape("t").alias("x"))
    assert rows.first()["x"] == "a & b &lt; &x; & & &amp; & &am;p"
    assert "amp;" in plan(rows).split("split(")[1][:400]
