"""Order-dependent jobs against plain loops on random rows, and one case per rule of the ladders."""
import random

import pytest
from pyspark.sql import functions as F

from leadloom.config import Campaign, CreatorSearch, Product, ResultRules, Sender
from leadloom.operators import companies, creators, discovery, grading, names, pages, planning
from leadloom.functions import grouping

RESULT = ("arrival long, country string, profile string, keyword string, query string, task_idx int, title string, url string, "
          "content string, score double")


def result(arrival, url, title="Acme", content="cosmetics importer vietnam", profile="official", score=None):
    return (arrival, "Vietnam", profile, "k", "q", 0, title, url, content, score)


@pytest.mark.parametrize("url,title,content,reason", [
    ("https://shop.facebook.com/a.pdf", "x", "cosmetics", "blocked_host"),
    ("https://tradewheel.com/x", "x", "cosmetics", "blocked_host"),
    ("https://vtv.vn/x", "x", "cosmetics", "directory_or_media"),
    ("https://acme.vn/a.pdf", "x", "cosmetics", "document_file"),
    ("https://acme.vn/news/1", "x", "cosmetics", "non_company_path"),
    ("https://acme.vn/", "Job offers", "cosmetics", "non_company_title"),
    ("https://acme.vn/", "x", "nothing here", "no_evidence"),
    ("https://acme.vn/", "x", "cosmetics magazine university", "content_page"),
    ("https://acme.vn/", "x", "cosmetics importer", None),
])
def test_reject_reasons(spark, url, title, content, reason):
    df = spark.createDataFrame([result(1, url, title, content)], RESULT)
    assert discovery.prefilter_results(df).first()["reject_reason"] == reason


def test_candidate_score(spark):
    # cosmetic + cosmetics: 6; importer: 3; country 3; .vn 4; official 3; provider score 0.5 -> half to even 2
    df = spark.createDataFrame([result(1, "https://acme.vn/", score=0.5)], RESULT)
    assert discovery.prefilter_results(df).first()["candidate_score"] == 6 + 3 + 3 + 4 + 3 + 2


def test_pool_matches_loop(spark):
    rng = random.Random(5)
    profiles = ("official", "local_market", "ecosystem")
    rows = [(i, "V", rng.choice("abc") + ".vn", f"https://{rng.choice('abc')}.vn/{rng.randint(0, 9)}", rng.choice(profiles), rng.randint(0, 5))
            for i in range(300)]
    df = spark.createDataFrame(rows, "arrival long, country string, domain string, url string, profile string, candidate_score int")
    df = df.withColumns({c: F.lit("") for c in ("keyword", "query", "title", "content")})
    pool: dict = {}
    for i, country, domain, url, profile, score in rows:
        seen = pool.get((country, domain))
        if seen is None:
            pool[(country, domain)] = [score, i, [profile], [url]]
            continue
        if profile not in seen[2]:
            seen[2].append(profile)
        if url not in seen[3] and len(seen[3]) < 6:
            seen[3].append(url)
        if score > seen[0]:
            seen[0], seen[1] = score, i
    got = {(r.country, r.domain): [r.candidate_score, r.arrival, r.discovery_source, r.alternate_urls]
           for r in discovery.pool_candidates(df).collect()}
    assert got == pool


def test_creator_merge_matches_loop(spark):
    rng = random.Random(9)
    rows = [(i, f"h{rng.randint(0, 25)}", rng.randint(0, 6), f"m{i}@x.vn" if rng.random() < 0.4 else None) for i in range(400)]
    rows += [(1000 + i, "hot", rng.randint(0, 9), f"m{i}@x.vn" if rng.random() < 0.1 else None) for i in range(300)]
    best: dict = {}
    for arrival, handle, score, mail in rows:
        kept = best.get(handle)
        if kept is None or score > kept[1]:
            best[handle] = [arrival, score, mail]
        elif mail and not kept[2]:
            kept[2] = mail
    df = spark.createDataFrame(rows, "arrival long, handle string, score int, public_email string")
    got = {r.handle: [r.arrival, r.score, r.public_email] for r in creators.dedup_creators(df).collect()}
    assert got == best


def test_stop_rule_matches_loop(spark):
    rng = random.Random(3)
    for target, base in ((6, 3), (50, 2), (1, 1)):
        tasks = [(c, i) for c in "AB" for i in range(12)]
        found = [(c, i, f"d{rng.randint(0, 30)}") for c, i in tasks for _ in range(rng.randint(0, 4))]
        want = {}
        for country in "AB":
            known: set = set()
            for i in range(12):
                if i >= base and len(known) >= target:
                    break
                known |= {d for c, t, d in found if c == country and t == i}
                want[country] = i + 1
        stops = planning.stop_points(spark.createDataFrame(tasks, "country string, task_idx long"),
                                     spark.createDataFrame(found, "country string, task_idx long, domain string"), target, base)
        assert {r.country: r.needed_tasks for r in stops.collect()} == want


def test_budget_matches_loop(spark):
    need = {"A": 7, "B": 2, "C": 9, "D": 9}
    cap, used, want = 18, 0, {}
    for country in sorted(need):
        want[country] = min(need[country], -(-cap // len(need)), cap - used)
        used += want[country]
    df = spark.createDataFrame(list(need.items()), "country string, needed_tasks long")
    assert {r.country: r.allowed_tasks for r in planning.apply_budget(df, cap).collect()} == want


def test_task_order_matches_loop(spark):
    for count in (1, 2, 4, 7):
        words = [f"w{i}" for i in range(count)]
        for mode, profiles in (("balanced", ("official", "local_market")), ("maximum", ("official", "local_market", "ecosystem"))):
            order = [(profiles[i % len(profiles)], x) for i, x in enumerate(words)]
            order += [(p, x) for p in profiles for x in words if (p, x) not in order]
            df = spark.createDataFrame([(i, x, count, "m") for i, x in enumerate(words)], "position int, keyword string, keyword_count int, major string")
            got = planning.plan_queries(df, Campaign(search_mode=mode)).orderBy("task_idx").collect()
            assert [(r.profile, r.keyword) for r in got] == order
            assert [r.task_idx for r in got] == list(range(len(order)))


def test_keyword_plan(spark):
    groups = spark.createDataFrame([("산업기계·부품", "industrial", ["filling machines"]), ("x", "cosmetics", ["Skin-care", "skincare", "세럼"]),
                                    ("y", "health_food", ["홍삼"])], "major string, industry string, products array<string>")
    got = {}
    for r in planning.plan_keywords(groups).orderBy("position").collect():
        got.setdefault((r.major, r.phase), []).append(r.keyword)
    assert got[("산업기계·부품", "base")] == ["filling machines equipment distributor"]
    assert got[("x", "base")][:2] == ["Skin-care importer", "skincare products distributor"]
    assert got[("y", "base")][0] == "red ginseng supplements supplement importer"
    assert len(got[("y", "expansion")]) == 3
    bad = spark.createDataFrame([("nope", ["a"], ["p"]), ("식품·음료", ["음료"], ["주스"]), ("식품·음료", ["음료"], ["fruit juice"])],
                                "major string, subcategories array<string>, products array<string>")
    assert [r.reason for r in planning.invalid_groups(bad).collect()] == ["choose_group_and_subcategory", "use_english_products"]


def test_sequential_numbers_all_rows(spark):
    df = spark.range(500).withColumn("k", (F.col("id") * 7) % 500)
    got = grouping.sequential(df, ["k"]).orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, 501)) and [r.k for r in got] == list(range(500))


# ------------------------------------------------------------------ grades

CASES = [
    ("Acme", "https://acme.vn", "importer and exclusive distributor of cosmetics and skincare. address: hanoi, vietnam", "official_site", "A"),
    ("Acme", "https://acme.vn", "wholesale cosmetics skincare beauty vietnam", "official_site", "B"),
    ("Spa Lan", "https://lan.vn", "beauty clinic cosmetics", "official_site", "C"),
    ("Lan", "https://lan.vn", "cosmetics skincare", "official_site", "C"),
    ("Foo", "https://foo.vn", "our factory makes cosmetics", "manufacturer", "strategic"),
    ("Foo", "https://foo.com", "our factory makes cosmetics", "manufacturer", "reference"),
    ("Foo", "https://foo.com", "wholesale cosmetics distributor", "official_site", "other_country"),
    ("Foo", "https://foo.vn", "distributor of steel", "official_site", "excluded"),
    ("Foo Capital", "https://foo.vn", "cosmetics importer", "investment", "excluded"),
    ("Foo", "https://foo.vn", "law firm lawyers cosmetics", "legal", "excluded"),
    ("Foo", "https://foo.vn", "online casino cosmetics", "spam", "excluded"),
    ("Foo Travel", "https://foo.vn", "cosmetics importer", "tourism", "excluded"),
    ("Foo", "https://foo.vn", "freight forwarding customs broker cosmetics", "logistics", "excluded"),
    ("Foo", "https://foo.vn", "cleanroom for drug makers beauty", "cleanroom", "excluded"),
    ("Foo Soft", "https://foo.vn", "cosmetics importer", "software", "excluded"),
    ("Foo", "https://foo.vn", "call center services cosmetics", "outsourcing", "excluded"),
    ("Foo Association", "https://foo.vn", "cosmetics importer", "ecosystem", "reference"),
    ("Foo", "https://foo.vn", "newspaper cosmetics", "media", "excluded"),
    ("Foo", "https://foo.vn", "our brands brand portfolio cosmetics", "brand_owner", "reference"),
    ("Foo", "https://foo.vn", "news magazine beauty", "media", "excluded"),
    ("Foo", "https://foo.vn", "business consulting beauty", "agency", "excluded"),
    ("Foo", "https://foo.vn", "beauty equipment", "equipment", "excluded"),
    ("Foo", "https://foo.vn", "cosmetic packaging beauty wholesale", "packaging", "reference"),
    ("Foo", "https://foo.vn", "we export cosmetics", "export_seller", "strategic"),
    ("Foo", "https://foo.vn", "marketplace lead finder cosmetics importer", "platform", "excluded"),
    ("Spring Trade Fair", "https://foo.vn", "cosmetics importer", "ecosystem", "excluded"),
    ("Foo", "https://foo.vn", "shopping cart add to cart authorized dealer cosmetics skincare", "official_site", "B"),
    ("Foo", "https://foo.vn", "our factory, we are not a distributor of cosmetics", "manufacturer", "strategic"),
]


def test_site_classes_and_grades(spark):
    rows = [(i, name, site, "Vietnam", text) for i, (name, site, text, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, company_name string, website string, target_country string, identity_text string")
    got = {r.id: (r.site_type, r.priority) for r in grading.assess_companies(df, Campaign()).collect()}
    wrong = [(CASES[i], got[i]) for i in got if got[i] != CASES[i][3:]]
    assert not wrong


def test_products(spark):
    df = spark.createDataFrame([(1, "Máy MẶT NẠ GIẤY, sheet-mask!"), (2, "sheets")], "doc_id int, text string")
    got = grading.match_products(df, ["sheet masks", "sunscreen"], country="Vietnam").collect()
    assert [(r.doc_id, r.product, r.aliases) for r in got] == [(1, "sheet masks", ["sheet mask", "mặt nạ giấy"])]


def test_local_phrases_count_in_their_country_only(spark):
    rows = [(1, "A", "https://a.vn", "Vietnam", "bán kem chống nắng"), (2, "A", "https://a.fr", "France", "bán kem chống nắng")]
    df = spark.createDataFrame(rows, "id int, company_name string, website string, target_country string, identity_text string")
    campaign = Campaign(industry="household", group="화장품·스킨케어", subcategories=("스킨케어",), products=("sunscreen",), countries=("France", "Vietnam"))
    got = {r.id: r.industry_assessments[0] for r in grading.assess_companies(df, campaign).collect()}
    assert got[1].product_alias_hits == {"sunscreen": ["kem chống nắng"]} and got[1].matched_subcategories == ["스킨케어"]
    assert got[2].product_hits == []


# ------------------------------------------------------------------ pages and names

HTML = """<html><head><title>A &amp; B | Trang chủ</title><meta property="og:site_name" content="Acme > Co">
<script type="application/ld+json">{"@graph":[{"@type":["Store"],"name":"N","legalName":"Acme LLC"}]}</script></head>
<body><!-- c@x.vn --><a href="../lien-he">Contact <b>us</b></a><a href="mailto:Sales%40acme.vn?x=1">m</a>
<a href=https://other.com/x>o</a><a href="mailto:i@bücher.de"></a><a href="https://facebook.com/a">f</a> a [at] acme [dot] vn <svg><text>hid</text></svg></body></html>"""


def test_page_extraction(spark):
    page = pages.extract_pages(spark.createDataFrame([("https://acme.vn/a/b/", HTML)], "url string, html string"))
    row = page.first()
    assert row.text == "A & B | Trang chủ Contact us m o f a [at] acme [dot] vn"
    assert (row.title, row.site_name, row.jsonld_name) == ("A & B | Trang chủ", "Acme > Co", "Acme LLC")
    assert row.emails == ["a@acme.vn", "i@xn--bcher-kva.de", "sales@acme.vn"] and row.links == ["https://acme.vn/a/lien-he"]
    assert [r.root_url for r in pages.external_company_links(page).collect()] == ["https://other.com/"]


@pytest.mark.parametrize("site,title,jsonld,text,host,name", [
    ("", "Acme Beauty | Home", "", "", "acme.vn", "Acme Beauty"),
    ("", "Home", "", "", "big-acme.vn", "BIG Acme"),
    ("acme.vn", "Welcome", "", "", "acme.vn", "Acme"),
    ("", "Shop đẹp - Công ty TNHH Thương Mại - Kỹ Thuật Acme", "", "", "acme.vn", "Công ty TNHH Thương Mại - Kỹ Thuật Acme"),
    ("", "Mỹ phẩm", "", "được phân phối bởi Công ty TNHH Sao Mai Hotline 09", "x.vn", "Công ty TNHH Sao Mai"),
    ("", "Welcome", "", "footer Công ty Cổ phần Biển Xanh địa chỉ Hà Nội", "x.vn", "Công ty Cổ phần Biển Xanh"),
    ("", "anything", "", "", "peroma.vn", "Peroma"),
])
def test_company_names(spark, site, title, jsonld, text, host, name):
    df = spark.createDataFrame([(host, jsonld, site, title, text)], "host string, jsonld_name string, site_name string, title string, text string")
    assert names.elect_company_name(df).first()["company_name"] == name


# ------------------------------------------------------------------ creators


def creator_rows(spark, *bios):
    rows = [(i, 0, "q", f"https://instagram.com/user{i}/", f"User{i}", bio) for i, bio in enumerate(bios)]
    return spark.createDataFrame(rows, "arrival long, task_idx int, query string, url string, title string, content string")


def test_creator_grades(spark):
    search = CreatorSearch(country="Vietnam", category="beauty", keywords=("beauty",))
    base = "i'm a beauty creator and blogger, skincare and makeup. 12K followers. collab"
    bios = (base + " 🇻🇳", base + " 🇳🇱", "fashion magazine vietnam beauty", "beauty 90K followers")
    gated = creators.gate_creators(creators.read_profiles(creator_rows(spark, *bios), search), search)
    reasons = {r.handle: r.reject_reason for r in gated.collect()}
    assert reasons == {"user0": None, "user1": None, "user2": "business_account", "user3": None}
    scored = {r.handle: r for r in creators.score_creators(gated, search).collect()}
    assert scored["user0"].grade == "A" and scored["user0"].location_status == "match"
    assert scored["user1"].score == scored["user0"].score - 35 and scored["user1"].grade != "A"
    assert scored["user3"].profile_type == "media_suspect"


def test_drafts_ask_for_missing_input(spark):
    df = spark.createDataFrame([("h", "H", "beauty", "Vietnam", None)], "handle string, display_name string, category string, country string, public_email string")
    assert creators.draft_outreach(df, Sender(), Product()).first()["outreach_status"] == "input_needed"


# ------------------------------------------------------------------ merging companies


def test_merge_matches_loop(spark):
    rng = random.Random(11)
    grades = ["A", "B", "C", "strategic", "excluded"]
    rows = []
    for i in range(250):
        host = rng.choice(["", *[f"h{j}.com" for j in range(12)]])
        mail = rng.choice([None, f"a@m{rng.randint(0, 3)}.com"])
        rows.append((f"r{i}", i, f"CMP-{rng.randint(0, 40)}", f"Name {rng.randint(0, 4)}", rng.choice(["X", "Y"]), f"https://{host}/" if host else "",
                     rng.choice(grades), rng.randint(0, 3), rng.randint(0, 100), mail))
    fields = ("record_id", "arrival", "company_id", "company_name", "target_country", "website", "priority", "country_score", "relevance_score", "company_email")
    rank = companies.GRADE_RANK
    ordered = sorted(rows, key=lambda r: r[1])
    ordered.sort(key=lambda r: (rank[r[6]], r[4] != "", r[7], r[8], r[9] is not None, 0, r[2], r[4]), reverse=True)
    by_host, by_alias, owner = {}, {}, {}
    for r in ordered:
        host = r[5][8:-1]
        alias = (r[4].lower(), r[3].lower().replace(" ", ""), r[9].split("@")[1] if r[9] else "")
        found = (by_host.get(host) if host else None) or (by_alias.get(alias) if alias[2] else None)
        if found:
            owner[r[0]] = found
            if host:
                by_host[host] = found
            continue
        owner[r[0]] = r[0]
        if host:
            by_host[host] = r[0]
        if alias[2]:
            by_alias[alias] = r[0]
    df = spark.createDataFrame(rows, "record_id string, arrival long, company_id string, company_name string, target_country string, website string, "
                                     "priority string, country_score int, relevance_score int, company_email string")
    df = df.withColumns({"verified_country": F.col("target_country"), "candidate_score": F.lit(0)})
    assert len(fields) == 10
    got = {r.record_id: r.owner_id for r in companies.assign_owners(df).collect()}
    assert got == owner


# ------------------------------------------------------------------ queries without a SQL form


def test_phones_match_search_in_python(spark):
    import re
    from leadloom.functions import vocabulary as v
    rng = random.Random(2)
    words = ["tel", "hotline", "tax code", "registration no", "abc", "xyz", "liên hệ", "mã số thuế"]
    texts = []
    for _ in range(60):
        parts = [rng.choice(words) if rng.random() < 0.5 else "".join(rng.choice("0123456789") for _ in range(rng.randint(3, 14)))
                 + rng.choice(["", " 22", "-333", ".44 "]) for _ in range(rng.randint(1, 60))]
        texts.append(" ".join(parts))

    def expected(text):
        ranked = []
        for match in re.finditer(r"(?:\+?\d[\d\s().-]{7,}\d)", text):
            before, after = text[max(0, match.start() - 100):match.start()].lower(), text[match.end():match.end() + 100].lower()
            last = lambda terms: max(before.rfind(x) for x in terms)
            first = lambda terms: min((after.find(x) for x in terms if x in after), default=-1)
            phone, other, phone_after, other_after = last(v.PHONE_HINTS), last(v.NON_PHONE_HINTS), first(v.PHONE_HINTS), first(v.NON_PHONE_HINTS)
            if other > phone or (other_after >= 0 and (phone_after < 0 or other_after < phone_after)):
                continue
            ranked.append((0 if phone >= 0 or phone_after >= 0 else 1, match.start(), match.group().strip()))
        return list(dict.fromkeys(raw for _, _, raw in sorted(ranked)))[:10]

    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.phones for r in df.select("id", pages.phone_candidates(F.col("text")).alias("phones")).collect()}
    assert got == {i: expected(x) for i, x in enumerate(texts)}


def test_expansion_matches_loop(spark):
    from leadloom.functions import catalog
    for products in (["a"], ["a", "b c"], ["importer x", "y", "z", "q", "r", "s"]):
        roles, more = catalog.BUYER_ROLES["food"], catalog.EXPANSION_ROLES["food"]
        base = list(dict.fromkeys(f"{products[i % len(products)]} {roles[i % 5]}" for i in range(max(len(products), 5))))[:10]
        seen, want = {k.lower() for k in base}, []
        for offset in range(3):
            for i, product in enumerate(products):
                keyword = f"{product} {more[(i + offset) % 3]}"
                if keyword.lower() not in seen and len(want) < 3:
                    seen.add(keyword.lower())
                    want.append(keyword)
        df = spark.createDataFrame([("m", "food", products)], "major string, industry string, products array<string>")
        got = planning.plan_keywords(df).where("phase = 'expansion'").orderBy("position").collect()
        assert [r.keyword for r in got] == want


def test_backfill_and_refill(spark):
    from leadloom.sources.dimensions import with_country_facts
    campaign = Campaign(products=("shampoo",), countries=("Vietnam", "Narnia"), search_mode="balanced")
    facts = with_country_facts(spark.createDataFrame([("Vietnam", 0), ("Narnia", 1)], "country string, country_idx int"))
    keywords = spark.createDataFrame([(0, "k1")], "position long, keyword string")
    rows = planning.backfill_queries(facts, keywords, campaign).orderBy("country", "position").collect()
    vietnam = [r.query for r in rows if r.country == "Vietnam"]
    assert vietnam[0] == "Vietnam shampoo nhà nhập khẩu nhà phân phối phân phối"
    assert vietnam[1] == "site:.vn shampoo nhà nhập khẩu nhà phân phối"
    assert vietnam[2] == "Vietnam shampoo importer distributor wholesaler company" and vietnam[-1] == "Vietnam k1 official website contact"
    assert len(vietnam) == 12 and len([r for r in rows if r.country == "Narnia"]) == 11
    tail = planning.exclusions()
    plan = [(r.country, r.query) for r in planning.refill_queries(
        facts, keywords, spark.createDataFrame([(0, "shampoo")], "position long, product string"), campaign).orderBy("section", "place", "country_idx").collect()]
    assert plan[0] == ("Vietnam", f"Vietnam dầu gội nhà phân phối {tail}")
    assert plan[1] == ("Vietnam", f"Vietnam k1 company {tail}") and plan[2] == ("Narnia", f"Narnia k1 company {tail}")
    assert plan[-1] == ("Narnia", f"Narnia shampoo importer distributor {tail}") and len(plan) == len(set(plan))


def test_page_text_matches_the_standard_parser(spark):
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "noscript", "svg", "template")

        def handle_endtag(self, tag):
            if tag in ("script", "style", "noscript", "svg", "template"):
                self.hidden = max(0, self.hidden - 1)

        def handle_data(self, data):
            if not self.hidden:
                self.words += data.split()

    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("url", "html")
    read = {r.url: r.text for r in pages.extract_pages(table).select("url", "text").collect()}
    for row in table.collect():
        reader = Reader()
        reader.feed(row.html)
        reader.close()
        assert read[row.url] == " ".join(reader.words)


def test_hot_key_plans_reduce_before_the_shuffle(spark):
    rows = [(i, "V", "hot.vn", f"https://hot.vn/{i}", "official", i % 7) for i in range(2000)]
    df = spark.createDataFrame(rows, "arrival long, country string, domain string, url string, profile string, candidate_score int")
    df = df.withColumns({c: F.lit("") for c in ("keyword", "query", "title", "content")})
    pool = discovery.pool_candidates(df)
    plan = pool._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "partial_min_by" in plan
    assert pool.first()["hits"] == 2000
