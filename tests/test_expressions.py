"""Hand-computed cases of the expressions."""
import random

import pytest
from pyspark.sql import functions as F

from leadloom.config import EmailRules
from leadloom.functions import emails, ids, numbers, text as t, urls
from leadloom.operators import contacts, creators, names, pages
from leadloom.workload import tables as w


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_registrable_domains(spark):
    cases = {"https://shop.acme.com.vn/x": "acme.com.vn", "https://a.b.acme.net": "acme.net", "http://www.acme.vn:80/": "acme.vn"}
    for url, domain in cases.items():
        assert value(spark, urls.registrable_domain(F.lit(url))) == domain


def test_urls(spark):
    assert value(spark, urls.root_url(F.lit("http://Acme.vn/a?b#c"))) == "http://Acme.vn/"
    assert value(spark, urls.page_key(F.lit("https://acme.vn/a/#top"))) == "https://acme.vn/a"
    assert value(spark, urls.resolve(F.lit("https://acme.vn/a/b.html"), F.lit("../c?d"))) == "https://acme.vn/c?d"
    assert value(spark, urls.resolve(F.lit("https://acme.vn/a/"), F.lit("//x.com/y"))) == "https://x.com/y"
    assert value(spark, urls.under_any_host(F.lit("a.facebook.com"), ("facebook.com",)))
    assert not value(spark, urls.under_any_host(F.lit("notfacebook.com"), ("facebook.com",)))


def test_ids(spark):
    assert value(spark, ids.company_id(F.lit("acme.vn"))) == "CMP-E114DAB1C09F"


def test_handles(spark):
    cases = {"https://www.instagram.com/@Foo.Bar/": "foo.bar", "https://instagram.com/p/abc/": None,
             "https://instagram.com/reel/x": None, "https://example.com/foo": None}
    for url, handle in cases.items():
        assert value(spark, creators.profile_handle(F.lit(url))) == handle


def test_followers(spark):
    cases = {"12.5K followers": 12500, "1,200 followers": 1200, "no count": None, "1,234,567 followers": 234567,
             "12.345 followers": 12, "3M followers": 3_000_000, "950 팔로워": 950}
    for text, count in cases.items():
        assert value(spark, numbers.follower_count(F.lit(text))) == count
    labels = {1250: "1.2K", 12500: "12.5K", 999: "999", 2_500_000: "2.5M"}
    for count, label in labels.items():
        assert value(spark, numbers.follower_label(F.lit(count))) == label


def test_shares_add_up(spark):
    assert [value(spark, numbers.share(F.lit(10), 3, F.lit(i))) for i in range(3)] == [4, 3, 3]


def test_addresses(spark):
    assert value(spark, emails.decode_obfuscated(F.lit("mail sales [at] acme [dot] vn now"))) == "mail sales@acme.vn now"
    assert value(spark, emails.decode_obfuscated(F.lit("meet at noon (dot)"))) == "meet at noon (dot)"
    cases = {"Info%40Acme.vn": "info@acme.vn", "<a.b@acme.vn>": "a.b@acme.vn", "a.b@acme.vn.,": "a.b@acme.vn", ".a@acme.vn": None, "a..b@acme.vn": None,
             "a@acme": None, "x@sentry.io": None, "a@b@c.vn": None, "pic@2x.png": None, "mailto:q@acme.vn?subject=1": "q@acme.vn"}
    for raw, clean in cases.items():
        assert value(spark, emails.normalize(F.lit(raw))) == clean, raw
    assert value(spark, emails.normalize(F.lit("a@bücher.de"), idn=True)) == "a@xn--bcher-kva.de"
    assert value(spark, emails.normalize(F.lit("a@bücher.de"))) is None
    assert value(spark, emails.purpose(F.lit("three@acme.vn"))) == "recruiting"  # "hr" is inside "three"
    assert not value(spark, emails.is_sendable(F.lit("no-reply@acme.vn")))
    assert not value(spark, emails.is_sendable(F.lit("a@example.org"), EmailRules(blocked_parts=())))
    priorities = {"https://a.vn/partner": 5, "https://a.vn/lien-he": 4, "https://a.vn/about": 2, "https://a.vn/news/1": 0, "https://a.vn/x": 1}
    for url, priority in priorities.items():
        assert value(spark, emails.source_priority(F.lit(url))) == priority


def test_term_rules(spark):
    text = F.lit("importers of spas; d&b, oem/odm and nhà máysản")
    assert value(spark, t.term_hits(text, ("importer", "spa", "d&b", "oem/odm", "nhà máy"))) == ["d&b", "oem/odm", "nhà máy"]


def test_gate_never_changes_hits(spark):
    terms = ("law", "d&b", "e-magazine", "công ty", "oem", "research & innovation", "l'oréal")
    gate = t.Gate(terms)
    rows = [("law and order",), ("outlaw",), ("an e-magazine",), ("công ty oem",), ("research & innovation",), ("x",), ("l'oréal d&b",)]
    df = spark.createDataFrame(rows, "x string").withColumns(gate.columns(F.col("x")))
    for row in df.select(t.term_hits("x", terms).alias("a"), t.term_hits("x", terms, gate).alias("b")).collect():
        assert row.a == row.b


def test_entities(spark):
    assert value(spark, t.unescape(F.lit("&amp;lt; &#233;&#x41; &eacute;&bogus; &"))) == "&lt; éA é&bogus; &"
    assert value(spark, t.strip_markup(F.lit(" A &amp; <b>B</b>\n C "))) == "A & B C"
    assert value(spark, t.words(F.lit("Mặt-nạ  giấy, Đà!"))) == "mat na giay da"


def test_phones(spark):
    found = value(spark, pages.phone_candidates(F.lit("tax code 0312345678 and hotline 0912 345 678, also 0988-777-666")))
    assert found == ["0912 345 678", "0988-777-666"]
    fits = lambda raw, country, dial: value(spark, pages.clean_phone(F.lit(raw), F.lit(country), F.lit(dial)))
    assert fits("+84) 912 345 678", "Vietnam", "84") == "+84 912 345 678"
    assert fits("0412 345 678", "Vietnam", "84") is None
    assert fits("12345", "Vietnam", "84") is None


def test_formula_cells(spark):
    rows = [("=1+1",), ("+84",), ("-x",), ("@a",), ("ok",)]
    df = spark.createDataFrame(rows, "company_name string")
    for name in ("company_id", "company_email", "target_country", "email_status", "email_source_url", "delivery_status"):
        df = df.withColumn(name, F.lit("a"))
    assert [r.company_name for r in contacts.approval_columns(df).collect()] == ["'=1+1", "'+84", "'-x", "'@a", "ok"]


def test_name_reviews(spark):
    cases = {"": "name_missing", "Acme Facebook": "name_has_menu_text", "Công ty A Công ty B": "name_has_two_companies",
             "x" * 151: "name_too_long", "Máy giá rẻ": "name_has_marketing_text", "Công ty TNHH giá rẻ": None, "Acme": None}
    for name, reason in cases.items():
        assert value(spark, names.name_review_reason(F.lit(name))) == reason, name


def test_summary(spark):
    text = "Menu Home. We supply skincare and cosmetics to salons across the whole country. Please login to see prices of everything here. Our team ships twice a week to every large city."
    assert value(spark, pages.summarize_text(F.lit(text))) == (
        "We supply skincare and cosmetics to salons across the whole country. Our team ships twice a week to every large city.")


def test_words_are_swapped_as_by_one_replace_after_the_other(spark):
    rng, rows = random.Random(5), [None, "", " ", "des", "des des des des", "des  des", "\nnicht\n", "étion étion x", "Nicht des\tdes des. a.des"]
    some = ["des", "und", "nicht", "thble", "étion", "the", "x", "", "desx", "$1", "\\1", "les\n", "😀"]
    rows += [" ".join(rng.choices(some, k=rng.randrange(40))) for _ in range(200)]
    for phrases in (w.WORDS, w.PROFILE_WORDS, {"a": "b c", "ab": "$1", "a.b": "\\"}):
        texts = rows + [" ".join(rng.choices([*phrases, "y"], k=60)) for _ in range(40)] + ["a ab a.b axb a a ab"]
        got = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string").select(
            "k", t.swap_words(F.concat(F.lit(" "), "x", F.lit(" ")), phrases).alias("y")).collect()
        for r in got:
            want = None if texts[r.k] is None else f" {texts[r.k]} "
            for word, phrase in phrases.items():
                want = want and want.replace(f" {word} ", f" {phrase} ")
            assert r.y == want
    with pytest.raises(ValueError):
        t.swap_words(F.lit("a"), {"a": "b", "c": "the a"})
    # One pass: the plan of company texts does not replace word by word.
    plan = w.company_texts(spark, "/root/testdata/sf0.001").select("identity_text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("replace(") == 0


def test_bounded_terms_and_spaces_as_before(spark):
    rows = ["spa", "aspa spa", "spa9", "a spa.", "spaspa", "-spa-", "éspaé", "x spa-bar spa", "c++ c+", "ac++", "\t a \u3000 b\n\nc d  e\x85", "  ", "", "spa aspa"]
    old = lambda term: r"(?<![a-z0-9])" + t.literal_pattern(term) + r"(?![a-z0-9])"
    table = spark.createDataFrame([(r,) for r in rows], "x string")
    for term in ("spa", "c++", "spa-bar", "a"):
        for r in table.select("x", F.col("x").rlike(old(term)).alias("old"), F.col("x").rlike(t.bounded(term)).alias("new"), t.present(F.col("x"), F.lit(term)).alias("col")).collect():
            assert r.old == r.new == r.col, (r, term)
    assert all(r.a == r.b for r in table.select(t.squash(F.col("x")).alias("a"), F.trim(F.regexp_replace("x", r"(?U)\s+", " ")).alias("b")).collect())
