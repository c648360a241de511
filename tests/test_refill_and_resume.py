"""Goals looked at between batches, ledgers of keys, and runs that go on after an interruption."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from leadloom.config import Campaign
from leadloom.plans import buyer
from leadloom.sources import stages
from leadloom.streaming import refill
from leadloom.streaming.ledger import KeyLedger

RESULT = "arrival long, country string, profile string, keyword string, query string, task_idx int, title string, url string, content string, score double"


def page(title, body):
    return f"<html><head><title>{title}</title></head><body>{body}</body></html>"


def results(spark, n=6):
    rows = [(k, "Vietnam" if k % 2 else "France", "official", "k", f"q{k}", 0, f"Acme {k} importer", f"https://acme{k}.vn/about",
             "cosmetics importer distributor vietnam france", None) for k in range(n)]
    return spark.createDataFrame(rows, RESULT)


def planned(spark, rows, folder):
    frame = spark.createDataFrame(rows, "place long, country string, keyword string, query string")
    frame.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(frame.schema).parquet(folder)


def model(batches, sites, campaign, cap, per_country):
    """The rounds as loops: per query the new sites of its country; the state is looked at once per batch."""
    n = len(campaign.countries)
    state, ran, known, log = {c: [0, 0, 0, 0] for c in campaign.countries}, set(), set(), []
    for batch in batches:
        total = sum(s[2] for s in state.values())
        met = {c for c, s in state.items() if s[0] >= -(-campaign.candidate_limit // n) and s[1] >= -(-campaign.qualified_target // n) and s[2] >= campaign.target_per_country and total >= campaign.email_target}
        left, calls, chosen = cap - sum(s[3] for s in state.values()), {c: s[3] for c, s in state.items()}, []
        for place, country, query in sorted(batch):
            if country in met or query in ran or calls[country] >= per_country or left <= 0:
                continue
            ran.add(query)
            calls[country] += 1
            left -= 1
            chosen.append((country, query))
        for country, query in chosen:
            state[country][3] += 1
            for site, good, mail in sites.get(query, ()):
                if (country, site) not in known:
                    known.add((country, site))
                    state[country][0] += 1
                    state[country][1] += good
                    state[country][2] += mail
        log.append({c: tuple(s) for c, s in state.items() if any(s)})
    return log


def test_refill_stops_a_country_whose_goals_are_met(spark, tmp_path):
    campaign = Campaign(countries=("France", "Vietnam"), candidate_limit=6, target_per_country=3, qualified_target=2, email_target=4, max_queries=14)
    hits, sites, batches, place = [], {}, [[], [], [], []], 0
    for b in range(4):
        for country in campaign.countries:
            for k in range(2 if country == "France" else 3):
                query = f"{country} {b} {k}" if (b, k) != (2, 0) else f"{country} 0 0"  # one query is planned again
                batches[b].append((place, country, query))
                place += 1
                found = [(f"{country[0].lower()}{j}.vn", j % 2, 1) for j in range(b * 2 + k, b * 2 + k + 2)] if country == "France" or b > 1 else []
                sites.setdefault(query, found)
    sites = {q: s for q, s in sites.items()}
    for query, found in sites.items():
        hits += [(len(hits), query.split()[0], "official", "k", query, 0, "Acme importer", f"https://{site}/about", "cosmetics importer distributor", None) for site, _, _ in found]
    frame = spark.createDataFrame(hits, RESULT)

    def analyse(pool, batch_id):
        number = F.regexp_extract("domain", r"(\d+)", 1).cast("int")
        return pool.select("country", "domain", (number % 2 == 1).alias("qualified"), F.lit(1).alias("addresses"))

    out, log = str(tmp_path / "out"), []
    for b, batch in enumerate(batches):
        stream = planned(spark, [(p, c, "k", q) for p, c, q in batch], str(tmp_path / "plan"))
        refill.refill(stream, frame, analyse, out, str(tmp_path / "state"), campaign, 14).awaitTermination()
        rows = spark.read.schema(refill.TOTALS).parquet(f"{out}/totals/batch_id={b}").collect()
        log.append({r.country: (r.analysed, r.qualified, r.addresses, r.calls) for r in rows})
    want = model(batches, sites, campaign, 14, 7)
    assert log == want
    france = [state["France"][3] for state in log]
    assert france[1] == france[2] == france[3] and log[-1]["Vietnam"][3] == 7  # met after the second batch; at its share of the calls
    # A batch that runs again leaves the same tables.
    again = refill.after(refill.totals_before(spark, out, 1), spark.read.parquet(f"{out}/queries/batch_id=1"), spark.read.parquet(f"{out}/records/batch_id=1"))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in spark.read.schema(refill.TOTALS).parquet(f"{out}/totals/batch_id=1").collect()}


def test_refill_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "place long, country string, keyword string, query string")
    campaign = Campaign(countries=("France",), max_queries=3)
    assert refill.admitted_queries(empty, spark.createDataFrame([], refill.TOTALS), campaign, 3, 3).count() == 0
    some = spark.createDataFrame([(1, "France", "k", "a"), (2, "France", "k", "a"), (3, "Elsewhere", "k", "a"), (4, None, "k", "b")], empty.schema)
    got = refill.admitted_queries(some, spark.createDataFrame([], refill.TOTALS), campaign, 3, 3)
    assert sorted((r.place, r.query) for r in got.collect()) == [(1, "a"), (4, "b")]


def test_ledger_reads_only_touched_buckets(spark, tmp_path):
    ledger = KeyLedger(str(tmp_path / "keys"), "key string", buckets=8, fold=3)
    keys = lambda values: spark.createDataFrame([(v,) for v in values], "key string")
    seen: set[str] = set()
    for b in range(10):
        batch = [f"k{j}" for j in range(b * 5, b * 5 + 9)] + ([None] if b > 4 else [])
        fresh = {r.key for r in ledger.unseen(keys(batch), b).collect()}
        assert fresh - {None} == set(batch) - seen - {None}
        ledger.add(keys(batch), b)
        seen |= set(batch)
        # What a batch leaves is the same when it runs again.
        ledger.add(keys(batch), b)
    one = ledger.touched(keys(["k1"]))
    assert len(one) == 1
    read = ledger.seen(spark, 10, one)
    assert {r.key for r in read.collect()} == {k for k in seen if ledger.touched(keys([k])) == one}
    folders = {f.split("/keys/")[1].split("/key_bucket")[0] for f in read.inputFiles()}
    assert folders <= {"folded/upto=9", "batches/batch_id=9"}  # one folded folder and those since
    assert all(f"key_bucket={one[0]}/" in f for f in read.inputFiles() if "__HIVE" not in f and read.count() and f"key_bucket={one[0]}" in f)
    for b in range(3):  # a fold holds each key once, in one file per bucket
        assert len(list((tmp_path / "keys" / "folded" / "upto=9").glob("key_bucket=*/*.parquet"))) <= 9


def test_ledger_is_listed_and_joined_without_the_driver(spark, tmp_path):
    ledger = KeyLedger(str(tmp_path / "keys"), "key string", fold=2)
    keys = lambda low, high: spark.range(low, high).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    for b in range(5):
        fresh = ledger.unseen(keys(b * 400, b * 400 + 1000), b)
        assert fresh.count() == (1000 if b == 0 else 400)
        ledger.add(keys(b * 400, b * 400 + 1000), b)
    assert "Broadcast" not in fresh._jdf.queryExecution().simpleString()
    # More folders than this Spark lists by a job with a task for each.
    most = int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.threshold"))
    for folder in (tmp_path / "keys" / "batches" / "batch_id=4", tmp_path / "keys" / "folded" / "upto=4"):
        assert 1 < len(list(folder.glob("key_bucket=*"))) <= most
    read = ledger.seen(spark, 5, ledger.touched(keys(0, 1)))
    assert read.count() == read.where("key = 'k0'").count() + read.where("key != 'k0'").count() < 100
    assert ledger.seen(spark, 5).distinct().count() == 2600
    # A ledger that goes on with another fold finds the marks of the one before.
    assert KeyLedger(ledger.path, "key string", fold=5).unseen(keys(0, 3000), 5).count() == 400


PAGES = [(f"https://acme{k}.vn/", page(f"Acme {k}", f'We are an importer and exclusive distributor of cosmetics and skincare based in Vietnam. sales@acme{k}.vn <a href="/contact">Contact</a>')) for k in range(6)]


def content(tables):
    return {name: sorted(map(str, getattr(tables, name).collect())) for name in ("candidates", "records", "companies", "addresses", "contacts", "approved", "holds")}


def test_run_killed_after_a_stage_goes_on(spark, tmp_path, monkeypatch):
    campaign = Campaign(products=("facial serum",), group="화장품·스킨케어", subcategories=("스킨케어",), countries=("Vietnam", "France"))
    pages, found = spark.createDataFrame(PAGES, "url string, html string"), results(spark)
    want = content(buyer.run(found, pages, campaign, stage_dir=str(tmp_path / "whole")))
    real = stages.Stages.keep

    def killed(self, df, name):
        out = real(self, df, name)
        if name == "provisional":
            raise KeyboardInterrupt(name)
        return out

    monkeypatch.setattr(stages.Stages, "keep", killed)
    with pytest.raises(KeyboardInterrupt):
        buyer.run(found, pages, campaign, stage_dir=str(tmp_path / "cut"), inputs="v1")
    runs = []
    monkeypatch.setattr(stages.Stages, "keep", lambda self, df, name: (runs.append(self), real(self, df, name))[1])
    # No page is read again: there is none.
    got = content(buyer.run(found, pages.where(F.lit(False)), campaign, stage_dir=str(tmp_path / "cut"), inputs="v1"))
    assert got == want and runs[-1].found == ["candidates", "page_extract", "provisional"] and runs[-1].made == ["visited", "records", "owned"]
    # Other settings or other inputs start over.
    buyer.run(found, pages, campaign, stage_dir=str(tmp_path / "cut"), inputs="v2")
    assert runs[-1].found == [] and len(runs[-1].made) == 6


def test_stage_without_its_commit_is_made_again(spark, tmp_path):
    held = stages.Stages(spark, str(tmp_path), "f")
    assert held.keep(spark.range(3), "a").count() == 3 and stages.Stages(spark, str(tmp_path), "f").keep(spark.range(5), "a").count() == 3
    held._commit("a", "started")  # killed while writing
    assert stages.Stages(spark, str(tmp_path), "f").keep(spark.range(5), "a").count() == 5
    assert stages.Stages(spark, str(tmp_path), "g").keep(spark.range(6), "a").count() == 6
    spark.range(4).write.parquet(str(tmp_path / "in"))
    first = stages.mark(spark.read.parquet(str(tmp_path / "in")))
    assert first == stages.mark(spark.read.parquet(str(tmp_path / "in"))) and stages.mark(spark.range(4)) == stages.mark(spark.range(4)) != stages.mark(spark.range(5))
    spark.range(4).write.mode("overwrite").parquet(str(tmp_path / "in"))
    assert first != stages.mark(spark.read.parquet(str(tmp_path / "in")))


def test_records_of_an_earlier_run_are_not_analysed_again(spark, tmp_path):
    campaign = Campaign(products=("facial serum",), group="화장품·스킨케어", subcategories=("스킨케어",), countries=("Vietnam", "France"))
    pages, found = spark.createDataFrame(PAGES, "url string, html string"), results(spark)
    first = buyer.run(found.where("arrival < 3"), pages, campaign, stage_dir=str(tmp_path / "one"))
    second = buyer.run(found, pages, campaign, stage_dir=str(tmp_path / "two"), previous=first.records)
    whole = buyer.run(found, pages, campaign, stage_dir=str(tmp_path / "all"))
    assert sorted(r.domain for r in second.candidates.collect()) == ["acme3.vn", "acme4.vn", "acme5.vn"]
    for name in ("companies", "contacts"):
        pick = lambda tables: sorted((r.company_id, r.company_email, r.priority) for r in getattr(tables, name).collect())
        assert pick(second) == pick(whole)
