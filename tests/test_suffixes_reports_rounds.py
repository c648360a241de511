"""Public-suffix rules, reports published as one, and rounds over several industries."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from leadloom.config import Campaign
from leadloom.operators import contacts, pages, suffixes
from leadloom.plans import rounds
from leadloom.sources import readers, sinks

RULES = ["com", "uk", "co.uk", "*.ck", "!www.ck", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "// a comment", "", "blog.com"]


def by_rules(host: str) -> str:
    """The registrable domain as the list's algorithm has it."""
    labels, best = host.split("."), (False, 1)
    for rule in RULES:
        if not rule or rule.startswith("//"):
            continue
        exception, parts = rule.startswith("!"), rule.lstrip("!").split(".")
        tail = labels[-len(parts):]
        if len(tail) == len(parts) and all(p in ("*", x) for p, x in zip(parts, tail)):
            best = max(best, (exception, len(parts) - exception))
    return ".".join(labels[-(best[1] + 1):])


def test_suffix_rules_equal_the_algorithm(spark, tmp_path):
    hosts = ["a.com", "com", "x.a.com", "a.co.uk", "b.a.co.uk", "co.uk", "b.test.ck", "test.ck", "www.ck", "a.www.ck", "c.kobe.kawasaki.jp", "kobe.kawasaki.jp",
             "city.kawasaki.jp", "a.city.kawasaki.jp", "kawasaki.jp", "a.b.unknown", "unknown", "me.blog.com", "blog.com", "localhost"]
    rules = spark.createDataFrame([(r,) for r in [*RULES, "CO.UK "]], "rule string")
    frame = spark.createDataFrame([(h,) for h in hosts] * 2 + [("",), (None,)], "host string").withColumn("registrable", F.lit("x"))
    got = suffixes.with_registrable(frame, rules)
    assert got.count() == 2 * len(hosts) + 2 and got.columns == ["host", "registrable", "domain"]
    assert {r.host: r.domain for r in got.collect()} == {h: by_rules(h) for h in hosts} | {"": "", None: None}
    (tmp_path / "list.dat").write_text("// names\ncom\nco.uk  // not read\n\n*.ck\n", encoding="utf-8")
    assert sorted(r.rule for r in readers.read_suffix_rules(spark, str(tmp_path / "list.dat")).collect()) == ["*.ck", "co.uk", "com"]
    urls = spark.createDataFrame([("https://b.a.co.uk/1",), ("https://c.a.co.uk/2",), ("https://me.blog.com/",)], "url string")
    assert {r.domain: r.hosts for r in pages.host_rollup(urls, rules).collect()} == {"a.co.uk": 2, "me.blog.com": 1}


def test_a_report_is_published_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path)
    assert readers.read_report(spark, path, "r") == {}
    first = sinks.publish_report({"a": spark.range(3), "b": spark.range(2).withColumn("x", F.lit("y"))}, path, "r")
    assert {r.section: r.rows for r in first.collect()} == {"a": 3, "b": 2}
    broken = spark.range(4).select(F.when(F.col("id") > 2, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        sinks.publish_report({"a": spark.range(9), "b": broken}, path, "r")
    kept = readers.read_report(spark, path, "r")
    assert kept["a"].count() == 3 and kept["b"].columns == ["id", "x"] and sorted(kept) == ["a", "b"]
    sinks.publish_report({"a": spark.range(0)}, path, "r")
    sinks.publish_report({"c": spark.range(1)}, path, "other")
    assert sorted(readers.read_report(spark, path, "r")) == ["a"] and readers.read_report(spark, path, "r")["a"].count() == 0 and kept["a"].count() == 3
    with pytest.raises(ValueError):
        sinks.publish_report({}, path, "r")


def model(queues, countries, campaign, budget, base):
    """The rounds as a loop over industries and their queues of (country, qualified, address)."""
    n, order = len(countries), list(queues)
    used, exhausted, log = dict.fromkeys(order, 0), set(), []
    left = budget
    for k, m in enumerate(order):
        used[m] = min(len(queues[m]), max(0, min(base * n, budget - k * base * n)))
        if min(base * n, budget - k * base * n) > 0 and not queues[m]:
            exhausted.add(m)
    while True:
        log.append({m: (used[m], m in exhausted) for m in order})
        done = [x for m in order for x in queues[m][:used[m]]]
        mail, left = [x for x in done if x[2]], budget - sum(used.values())
        per = {c: sum(x[0] == c for x in mail) for c in countries}
        goals = len(done) >= campaign.candidate_limit and len(mail) >= campaign.email_target and min(per.values()) >= campaign.target_per_country and sum(x[1] for x in done) >= campaign.qualified_target
        choices = [m for m in order if m not in exhausted]
        if goals or left <= 0 or not choices:
            return log
        m = max(choices, key=lambda j: (sum(x[2] for x in queues[j][:used[j]]) / max(1, used[j]), j))
        now = min(len(queues[m]), used[m] + min(3 * n, left))
        if now == used[m]:
            exhausted.add(m)
        used[m] = now


@pytest.mark.parametrize(("budget", "limit"), [(60, 1000), (200, 40), (7, 1000)])
def test_rounds_equal_the_loop(spark, tmp_path, budget, limit):
    countries = ("France", "Spain")
    campaign = Campaign(countries=countries, candidate_limit=limit, email_target=8, target_per_country=4, qualified_target=6)
    queues = {m: [(countries[(k + s) % 2], (k * s) % 3 == 0, (k * 7 + s) % (2 + s) == 0) for k in range(size)] for s, (m, size) in enumerate((("a", 12), ("b", 60), ("c", 25), ("d", 0)), 1)}
    rows = [(m, k + 1, c, int(q), int(a)) for m, queue in queues.items() for k, (c, q, a) in enumerate(queue)]
    queue = spark.createDataFrame(rows, "major string, place long, country string, qualified int, address int").cache()
    majors = spark.createDataFrame([(m, k) for k, m in enumerate(queues)], "major string, position long")
    calls = []

    def execute(grants, turn):
        calls.append(turn)
        ran = queue.join(grants, "major").where("place > before AND place <= before + granted")
        found = ran.groupBy("major").agg(F.count("*").alias("queries"), F.sum("address").alias("sendable"), F.count("*").alias("analysed"), F.sum("qualified").alias("qualified"))
        return found, ran.groupBy("country", "major").agg(F.sum("address").alias("addresses"))

    got = {}
    for r in rounds.run_rounds(spark, majors, execute, str(tmp_path), campaign, budget, base_queries=2).collect():
        got.setdefault(r["round"], {})[r.major] = (r.queries, r.exhausted)
    want = model(queues, countries, campaign, budget, 2)
    assert [got[k] for k in sorted(got)] == want
    # Rounds that are stored are not run again.
    before = len(calls)
    assert rounds.run_rounds(spark, majors, execute, str(tmp_path), campaign, budget, base_queries=2).count() == len(want) * 4 and len(calls) == before


def test_a_known_doubt_about_a_company_keeps_it_from_approval(spark):
    fields = ("company_name string, company_email string, email_source_url string, email_status string, email_domain_status string, email_purpose string, priority string, quality_decision string, "
              "verified_country string, target_country string, industry_score int, buyer_role_score int, related_company_count long, identity_review_reason string")
    rows = [("Acme", "sales@acme.vn", "https://acme.vn", "official", "same_domain", "b2b", "A", "qualified", "Vietnam", "Vietnam", 2, 2, 1, reason) for reason in ("two_legal_names", "", " ", None)]
    frame = spark.createDataFrame(rows, fields)
    got = sorted((r.identity_review_reason or "", r.review_reasons, r.delivery_status) for r in contacts.review_contacts(frame).collect())
    assert got[-1] == ("two_legal_names", ["two_legal_names"], "needs_review") and all(r[1:] == ([], "approved") for r in got[:3])
    assert {r.delivery_status for r in contacts.review_contacts(frame.drop("identity_review_reason")).collect()} == {"approved"}


def test_report_set_reviews_contacts_once(spark, monkeypatch):
    from leadloom.workload import queries

    rows = [(f"a{k}@x.com", f"C{k}", f"Acme {k}", "France", "France", "official", "https://x.com/", "qualified", "importer",
             [] if k else ["company_fit"], "approved" if k else "needs_review") for k in range(3)]
    reviewed = spark.createDataFrame(rows, "company_email string, company_id string, company_name string, target_country string, verified_country string, "
                                     "email_status string, email_source_url string, quality_decision string, buyer_type string, review_reasons array<string>, delivery_status string")
    times, kept = [], ("mailing", "approved", "review", "letters", "evidence", "exclusions")
    monkeypatch.setattr(queries, "_reviewed", lambda *args: times.append(1) or reviewed)
    monkeypatch.setattr(queries, "_REPORT", {name: queries._REPORT[name] for name in kept})
    monkeypatch.setitem(queries.QUERIES, "evidence_log", lambda *args: spark.sql("SELECT 'call' AS kind, 1 AS rows, 2 AS results"))
    monkeypatch.setitem(queries.QUERIES, "exclusion_reasons", lambda *args: spark.sql("SELECT 'media' AS reason, 1 AS companies"))
    got = queries.report_set(spark, "").groupBy("section").count().collect()
    assert times == [1]
    assert {r.section: r["count"] for r in got} == {"mailing": 3, "approved": 2, "review": 1, "letters": 3, "evidence": 1, "exclusions": 1}
