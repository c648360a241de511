"""Readers, writers, incremental jobs and the whole campaign."""
import contextlib
import io
import json

from pyspark.sql import functions as F

from leadloom.config import Campaign, CreatorSearch, EmailRules, Product, Sender
from leadloom.functions import emails, grouping
from leadloom.operators import companies, contacts, discovery
from leadloom.plans import buyer, creator, delivery
from leadloom.sources import dimensions, readers, sinks
from leadloom.streaming import incremental

RESULT = ("arrival long, country string, profile string, keyword string, query string, task_idx int, title string, url string, "
          "content string, score double")


def page(title, body):
    return f"<html><head><title>{title}</title></head><body>{body}</body></html>"


def results(spark):
    rows = [(1, "Vietnam", "official", "k", "q1", 0, "Acme importer", "https://acme.vn/about", "cosmetics importer distributor vietnam", None),
            (2, "Vietnam", "local_market", "k", "q2", 1, "Acme skincare", "https://www.acme.vn/", "skincare wholesaler cosmetics importer vietnam", 0.9),
            (3, "Vietnam", "official", "k", "q1", 0, "Foo", "https://foo.vn/", "cosmetics factory oem vietnam", None),
            (4, "Vietnam", "official", "k", "q1", 0, "FB", "https://facebook.com/x", "cosmetics", None),
            (5, "Vietnam", "official", "k", "q1", 0, "Hold co", "https://hold.vn/", "cosmetics importer vietnam", None)]
    return spark.createDataFrame(rows, RESULT)


def test_campaign_end_to_end(spark, tmp_path):
    pages = spark.createDataFrame([
        ("https://acme.vn/", page("Acme Beauty", 'We are an importer and exclusive distributor of cosmetics and skincare based in Vietnam. '
                                                 'Address: 1 Hanoi, Vietnam. <a href="/lien-he">Contact</a>')),
        ("https://acme.vn/lien-he", page("Contact", "contact us sales@acme.vn tel 0912 345 678")),
        ("https://foo.vn/", page("Foo", "our factory cosmetics oem/odm vietnam info@foo.vn"))], "url string, html string")
    campaign = Campaign(products=("facial serum",), group="화장품·스킨케어", subcategories=("스킨케어",))
    tables = buyer.run(results(spark), pages, campaign, stage_dir=str(tmp_path))
    got = {r.company_name: r for r in tables.companies.collect()}
    assert got["Acme Beauty"].priority == "A" and got["Acme Beauty"].company_email == "sales@acme.vn"
    assert got["Acme Beauty"].collection_depth == "deep_contact" and got["Acme Beauty"].phone == "0912 345 678"
    assert got["Foo"].priority == "strategic"
    assert [r.company_email for r in tables.approved.collect()] == ["sales@acme.vn"]
    assert [r.domain for r in tables.holds.collect()] == ["hold.vn"]
    gate = delivery.run(tables.companies, sender=Sender(company_name="K"), product=Product(product_name="P"))
    assert [r.letter_status for r in gate["retained"].orderBy("company_email").collect()] == ["awaiting_input", "awaiting_review"]


def test_creator_search(spark):
    rows = [(1, 0, "q", "https://instagram.com/abc/", "Mai", "beauty creator skincare 🇻🇳 i'm mai 12.5K followers"),
            (2, 0, "q", "https://instagram.com/abc", "Mai", "beauty creator mai@x.vn"), (3, 0, "q", "https://instagram.com/p/xyz", "a", "b"),
            (4, 1, "q", "https://instagram.com/def", "Def", "beauty creator"), (5, 2, "q", "https://instagram.com/late", "Late", "beauty creator")]
    df = spark.createDataFrame(rows, "arrival long, task_idx int, query string, url string, title string, content string")
    out = creator.run(df, CreatorSearch(target_count=1), Sender(company_name="K"), Product(product_name="Serum"))
    # Two profiles are known after the second query, so the third is not counted.
    assert {r.handle for r in out.unique.collect()} == {"abc", "def"}
    assert out.top.first()["public_email"] == "mai@x.vn" and out.summary.first()["dm_drafts"] == 1


def test_incremental_pool_equals_batch(spark, tmp_path):
    data, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = results(spark)
    for i in range(1, 6):
        rows.where(F.col("arrival") == i).coalesce(1).write.mode("append").parquet(data)
    stream = spark.readStream.schema(RESULT).option("maxFilesPerTrigger", 2).parquet(data)
    for _ in range(2):
        incremental.incremental_pool(stream, out, str(tmp_path / "state")).awaitTermination()
    batch = discovery.pool_candidates(discovery.accepted(discovery.prefilter_results(rows)))
    keys = lambda df: sorted((r.country, r.domain) for r in df.collect())
    assert keys(spark.read.parquet(out)) == keys(batch)


def test_readers(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.json").write_text(json.dumps({"query": "q", "results": [{"title": "t", "url": "u", "content": "c"}]}), encoding="utf-8")
    (tmp_path / "s" / "b.json").write_text(json.dumps({"query": "r", "results": []}), encoding="utf-8")
    got = sorted((r.query, r.url) for r in readers.read_search_results(spark, str(tmp_path / "s")).collect() if r.query == "q" or r.url is None)
    assert got == [("q", "u"), ("r", None)]
    (tmp_path / "c.csv").write_text('﻿후보ID,표시명,핸들(가상),국가,팔로워,참여율\n1,"A, ""B""",@h,베트남,"48,000",3.2%\n2,,x,태국,1,1\n', encoding="utf-8")
    rows = readers.read_creators(spark, str(tmp_path / "c.csv")).collect()
    assert [(r.display_name, r.handle, r.followers, r.engagement) for r in rows] == [('A, "B"', "h", 48000, 3.2)]
    assert readers.read_creators(spark, str(tmp_path / "c.csv"), digits_only=False).first()["followers"] == 48


def test_reports_replace_only_their_run(spark, tmp_path):
    for run in ("r1", "r2", "r1"):
        sinks.write_report({"all": spark.range(3)}, str(tmp_path), run)
    assert spark.read.parquet(f"{tmp_path}/all").count() == 6


def test_dimensions(spark):
    assert dimensions.countries(spark).count() == 55
    assert dimensions.taxonomy(spark).count() == 145
    assert [r.country for r in dimensions.countries_in(spark, batch="03 south asia").collect()] == ["Philippines", "India"]
    row = dimensions.with_country_facts(spark.createDataFrame([("Narnia",)], "country string")).first()
    assert row.aliases == ["narnia"] and row.local_buyer == ["importer", "distributor"] and row.tld == ""


def test_run_progress(spark, tmp_path):
    for i in range(3):
        spark.range(4).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.run_progress(stream, str(tmp_path / "out"), str(tmp_path / "state"), "job").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.max("progress_done")).first()[0] == 12


def test_campaign_keeps_every_address(spark, tmp_path):
    pages = spark.createDataFrame([
        ("https://acme.vn/", page("Acme Beauty", 'We are an importer and exclusive distributor of cosmetics and skincare based in Vietnam. '
                                                 'Address: 1 Hanoi, Vietnam. info@acme.vn <a href="/lien-he">Contact</a>')),
        ("https://acme.vn/lien-he", page("Contact", "contact us sales@acme.vn or export@acme.vn, script jquery@3.6.0.min.js")),
        ("https://hold.vn/", page("", ""))], "url string, html string")
    campaign = Campaign(products=("facial serum",), group="화장품·스킨케어", subcategories=("스킨케어",), candidate_ceiling=None)
    tables = buyer.run(results(spark), pages, campaign, stage_dir=str(tmp_path))
    assert sorted(r.company_email for r in tables.contacts.where("company_name = 'Acme Beauty'").collect()) == ["export@acme.vn", "info@acme.vn", "sales@acme.vn"]
    assert {r.domain for r in tables.holds.collect()} == {"hold.vn"}  # a page without text is not readable


def test_address_shared_by_many_companies(spark):
    fields = ("record_id string, company_id string, company_name string, company_email string, email_source_url string, email_status string, email_domain_status string, "
              "email_grade string, email_purpose string, verification_score int, priority string, quality_decision string, industry_score int")
    rows = [(str(k), f"CMP-{k:04d}", "A", "sales@acme.vn", f"https://acme.vn/{k}", "official", "same_domain", "A", "b2b", None, "A", "qualified", 2) for k in range(500)]
    records = spark.createDataFrame(rows, fields)
    got = contacts.contact_list(records).collect()
    assert [(r.company_id, r.related_company_count, r.source_count) for r in got] == [("CMP-0000", 500, 500)]
    assert contacts.contact_owners(companies.contact_variants(records)).count() == 500


def test_first_k_spreads_a_hot_key_for_any_k(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("key"), F.col("id"), F.pmod(F.hash("id"), F.lit(1000)).alias("n"))
    found = grouping.first_k(rows, ["key"], ["n", "id"], 5000)
    want = [(r.n, r.id) for r in rows.orderBy("n", "id").limit(5000).collect()]
    assert [(r.n, r.id) for r in found.orderBy("place").collect()] == want
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        found.explain()
    assert "_salt" in shown.getvalue() and shown.getvalue().count("Window ") >= 2


def test_candidates_of_countries_in_the_given_order(spark):
    rows = [("Vietnam", "a.vn", 9, 1), ("Chile", "b.cl", 5, 2), ("France", "c.fr", 7, 3), ("Vietnam", "d.vn", 8, 4)]
    pool = spark.createDataFrame(rows, "country string, domain string, candidate_score int, arrival long").withColumn("discovery_source", F.array(F.lit("official")))
    assert [r.domain for r in discovery.top_candidates(pool, 5, 3, ("Vietnam", "France")).collect()] == ["a.vn", "d.vn", "c.fr"]
    assert discovery.top_candidates(pool, 5, None).count() == 4


def test_top_level_domains(spark, tmp_path):
    (tmp_path / "tlds.txt").write_text("# Version 1\nCOM\nVN\n\n", encoding="utf-8")
    listed = EmailRules(tlds=readers.read_tlds(spark, str(tmp_path / "tlds.txt")))
    assert listed.tlds == ("com", "vn")
    mails = ["sales@acme.vn", "a@b.co.uk", "bootstrap@5.min.js", "jquery@3.6.0.min.js", "user@host.local", "x@acme.com"]
    got = spark.createDataFrame([(m,) for m in mails], "m string").select("m", emails.normalize(F.col("m")).alias("shape"), emails.normalize(F.col("m"), listed).alias("list")).collect()
    assert [r.m for r in got if r.shape] == ["sales@acme.vn", "a@b.co.uk", "x@acme.com"] and [r.m for r in got if r.list] == ["sales@acme.vn", "x@acme.com"]


def test_shared_folder_is_the_one_the_session_names(spark):
    assert grouping.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_campaign_takes_directory_links_and_outside_contacts(spark, tmp_path):
    found = results(spark).union(spark.createDataFrame([(6, "Vietnam", "ecosystem", "k", "q3", 2, "Beauty expo exhibitor list", "https://expo.org/exhibitors",
                                                         "exhibitors cosmetics vietnam", None)], RESULT))
    pages = spark.createDataFrame([
        ("https://expo.org/exhibitors", page("Exhibitors", '<a href="https://www.newco.vn/x">NewCo</a> <a href="/own">own</a> <a href="https://facebook.com/z">f</a>')),
        ("https://newco.vn/", page("NewCo Beauty", "We are an importer and exclusive distributor of cosmetics and skincare based in Vietnam. Address: 2 Hanoi, Vietnam."))],
        "url string, html string")
    outside = spark.createDataFrame([("newco.vn", "buyer@newco.vn", "generic", 90, "A", "B", "Buyer", "https://src.example.org/1", "valid", 95, False)],
                                    "domain string, value string, type string, confidence int, first_name string, last_name string, position string, source_uri string, "
                                    "verify_status string, verify_score int, accept_all boolean")
    campaign = Campaign(products=("facial serum",), group="화장품·스킨케어", subcategories=("스킨케어",))
    tables = buyer.run(found, pages, campaign, stage_dir=str(tmp_path), external=outside)
    pool = {r.domain: r for r in tables.pool.collect()}
    assert pool["newco.vn"].discovery_url == "https://expo.org/exhibitors" and pool["newco.vn"].discovery_source == ["ecosystem"] and "facebook.com" not in pool
    assert [(r.company_email, r.email_status) for r in tables.contacts.collect()] == [("buyer@newco.vn", "verified")]


def test_records_of_one_row_group_are_dealt_to_several_tasks(spark, tmp_path):
    from leadloom.workload import tables

    spark.range(3).selectExpr("CAST(id AS INT) AS n_nationkey", "concat('N', id) AS n_name", "0 AS n_regionkey").coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(2000).selectExpr("id AS c_custkey", "'c' AS c_name", "CAST(id % 3 AS INT) AS c_nationkey", "CAST(id AS DOUBLE) AS c_acctbal",
                                 "'BUILDING' AS c_mktsegment").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(10).selectExpr("id AS s_suppkey", "'s' AS s_name", "0 AS s_nationkey", "1.0D AS s_acctbal").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would become one
    try:
        sizes = [r["count"] for r in tables.records(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 2010
    assert max(sizes) < 1000  # as read, one task held all customers
