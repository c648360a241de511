"""Counts, coverage and shortfalls of a run, and the tables of its report."""
from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leadloom.config import GRADE_ORDER, Campaign
from leadloom.functions import catalog, grouping, text as t, urls
from leadloom.sources.dimensions import country_name_ko


def _count(cond: Column) -> Column:
    return F.count_if(cond)


def _has(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


# ------------------------------------------------------------------ search

def reject_report(filtered: DataFrame) -> DataFrame:
    """Rejected results by reason, most frequent first."""
    return (filtered.where(F.col("reject_reason").isNotNull()).groupBy("reject_reason")
            .agg(F.count("*").alias("results")).orderBy(F.desc("results"), "reject_reason"))


def keyword_stats(filtered: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """Calls, results, accepted and rejected per country and keyword, and per keyword over all countries.

    Rows over all countries have ``country`` NULL. Without ``tasks`` a call is a distinct query.
    """
    facts = filtered.groupBy("country", "keyword").agg(
        F.count("*").alias("raw_results"), _count(F.col("reject_reason").isNull()).alias("accepted_results"),
        _count(F.col("reject_reason").isNotNull()).alias("rejected_results"),
        F.count_distinct("query").alias("calls"))
    if tasks is not None:
        calls = tasks.groupBy("country", "keyword").agg(F.count("*").alias("_calls"))
        facts = calls.join(facts, ["country", "keyword"], "full_outer").select(
            "country", "keyword", F.coalesce("_calls", F.lit(0)).alias("calls"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("raw_results", "accepted_results", "rejected_results")])
    return facts.groupingSets([["country", "keyword"], ["keyword"]], "country", "keyword").agg(
        *[F.sum(c).alias(c) for c in ("calls", "raw_results", "accepted_results", "rejected_results")])


def keyword_coverage(planned: DataFrame, stats: DataFrame) -> DataFrame:
    """Planned keywords per country with their counters, or `not_run`. ``planned``: country, keyword, position."""
    per_country = stats.where(F.col("country").isNotNull())
    numbers = ("calls", "raw_results", "accepted_results", "rejected_results")
    return planned.join(per_country, ["country", "keyword"], "left").select(
        "country", "keyword", "position", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers],
        F.when(F.col("calls").isNull(), "not_run").otherwise("run").alias("state"))


def query_log_report(log: DataFrame) -> DataFrame:
    """Calls, results, credits, cache reuse and errors per provider, and in total (provider NULL)."""
    return log.groupingSets([["provider"], []], "provider").agg(
        F.count("*").alias("calls"), F.sum("result_count").alias("results"),
        F.sum(F.coalesce(F.col("credits").try_cast("long"), F.lit(0))).alias("credits"),
        _count(F.col("http_status") == "CACHE").alias("cache_reused"), _count(_has("error")).alias("errors"),
        F.round(F.avg("response_time"), 6).alias("mean_response_time"))


# ------------------------------------------------------------------ companies

def grade_counts(companies: DataFrame) -> DataFrame:
    """Companies per priority in report order, and in total."""
    return (companies.groupingSets([["priority"], []], "priority").agg(F.count("*").alias("companies"))
            .orderBy(grade_position(F.col("priority"))))


def grade_position(priority: Column) -> Column:
    position = F.lit(9)
    for i, name in enumerate(GRADE_ORDER):
        position = F.when(priority == name, i).otherwise(position)
    return position


def exclusion_reasons(companies: DataFrame) -> DataFrame:
    """Reasons of companies that are not qualified, most frequent first."""
    return (companies.where(F.col("quality_decision") != "qualified")
            .select(F.explode("exclusion_reasons").alias("reason")).withColumn("reason", F.trim("reason"))
            .where(F.col("reason") != "").groupBy("reason").agg(F.count("*").alias("companies"))
            .orderBy(F.desc("companies"), "reason"))


def _decisions() -> list[Column]:
    d, p = F.col("quality_decision"), F.col("priority")
    return [F.count("*").alias("records"), _count(d == "qualified").alias("qualified"),
            *[_count(p == g).alias(f"tier_{g.lower()}") for g in "ABC"], _count(p == "strategic").alias("strategic"),
            _count(d == "reference").alias("reference"), _count(d == "other_country").alias("other_country"),
            _count(d == "excluded").alias("excluded"), _count(_has("company_email")).alias("emails_found"),
            _count((d == "qualified") & _has("company_email")).alias("qualified_emails_found")]


def country_summary(companies: DataFrame, approved: DataFrame, holds: DataFrame, countries: DataFrame) -> DataFrame:
    """Measures per selected country; a country without rows is listed with zeros."""
    facts = companies.groupBy(F.col("target_country").alias("country")).agg(*_decisions())
    mail = approved.groupBy(F.col("target_country").alias("country")).agg(F.count("*").alias("sendable"))
    held = holds.groupBy(F.col("target_country").alias("country")).agg(F.count("*").alias("access_holds"))
    joined = countries.select("country").join(facts, "country", "left").join(mail, "country", "left").join(held, "country", "left")
    return joined.select("country", *[F.coalesce(c, F.lit(0)).alias(c) for c in joined.columns if c != "country"])


def run_summary(companies: DataFrame, approved: DataFrame, holds: DataFrame, campaign: Campaign,
                credits: int = 0, elapsed_seconds: float = 0.0) -> DataFrame:
    """One row with the counts, goals, shortfalls and efficiency of a run."""
    depth = F.col("collection_depth")
    facts = companies.agg(
        *_decisions(), _count(~_has("company_email")).alias("missing_email"),
        _count(_has("company_email") & (F.col("email_grade") == "unfit")).alias("blocked_email_purpose"),
        _count(depth == "homepage_only").alias("homepage_only"),
        _count(depth == "homepage_complete").alias("homepage_complete"),
        _count(depth == "deep_contact").alias("deep_contact_review"))
    mail = approved.agg(F.struct(F.count("*").alias("sendable"), F.count_distinct("company_id").alias("mailing_companies")))
    held = holds.agg(F.count("*"))
    goal = campaign.qualified_target or campaign.target_per_country * len(campaign.countries)
    c, calls = F.col, max(credits, 1)
    wide = facts.select("*", mail.scalar().alias("_m"), held.scalar().alias("access_holds")).select(
        "*", "_m.sendable", "_m.mailing_companies").drop("_m")
    reached = wide.withColumns({
        "usable_list": c("tier_a") + c("tier_b") + c("tier_c") + c("strategic") + c("reference"),
        "customer_list": c("tier_a") + c("tier_b") + c("tier_c") + c("strategic"),
        "qualified_target": F.lit(goal), "qualified_target_met": c("qualified") >= goal,
        "target_met": c("records") >= campaign.candidate_limit, "email_target_met": c("sendable") >= campaign.email_target,
        "qualified_shortfall": F.greatest(F.lit(0), F.lit(goal) - c("qualified")),
        "candidate_shortfall": F.greatest(F.lit(0), F.lit(campaign.candidate_limit) - c("records")),
        "email_shortfall": F.greatest(F.lit(0), F.lit(campaign.email_target) - c("sendable")),
        "candidates_per_call": F.bround(c("records") / calls, 2), "sendable_per_call": F.bround(c("sendable") / calls, 2),
        "seconds_per_company": F.bround(F.lit(float(elapsed_seconds)) / F.greatest(c("records"), F.lit(1)), 2),
    })
    met = c("target_met") & c("email_target_met") & c("qualified_target_met")
    return reached.withColumn("collection_status", F.when(met, "goals_met").otherwise("goals_missed"))


def target_shortfall(companies: DataFrame, approved: DataFrame, countries: DataFrame, campaign: Campaign) -> DataFrame:
    """What each country still lacks: analysed domains, approved addresses, qualified companies."""
    n = len(campaign.countries)
    goals = {"analysed": -(-campaign.candidate_limit // n), "addresses": campaign.target_per_country,
             "qualified": -(-(campaign.qualified_target or campaign.target_per_country * n) // n)}
    facts = companies.groupBy(F.col("target_country").alias("country")).agg(
        F.count_distinct(urls.registrable_domain("website")).alias("analysed"),
        _count(F.col("quality_decision") == "qualified").alias("qualified"))
    mail = approved.groupBy(F.col("target_country").alias("country")).agg(F.count("*").alias("addresses"))
    rows = countries.select("country").join(facts, "country", "left").join(mail, "country", "left")
    have = {name: F.coalesce(name, F.lit(0)) for name in goals}
    lack = {name: F.greatest(F.lit(0), F.lit(goal) - have[name]) for name, goal in goals.items()}
    return rows.select("country", *[have[x].alias(x) for x in goals], *[lack[x].alias(f"{x}_shortfall") for x in goals],
                       reduce(lambda a, b: a | b, [lack[x] > 0 for x in goals]).alias("needs_work"))


# ------------------------------------------------------------------ industries and subcategories

def industry_verdicts(companies: DataFrame) -> DataFrame:
    """One row per company and industry verdict."""
    rows = companies.select("company_id", "company_name", "brand_name", F.explode("industry_assessments").alias("_a"))
    a = F.col("_a")
    phrases = F.transform(F.map_entries(a.product_alias_hits),
                          lambda e: F.concat(e["key"], F.lit(": "), F.array_join(e["value"], ", ")))
    return rows.select(
        "company_id", "company_name", "brand_name", a.major.alias("major"),
        F.array_join(a.subcategories, ", ").alias("subcategories"), a.target_country.alias("target_country"),
        a.priority.alias("priority"), a.quality_decision.alias("quality_decision"),
        F.array_join(a.product_hits, ", ").alias("product_hits"), a.product_evidence_status.alias("product_evidence_status"),
        a.evidence.alias("evidence"), a.source_url.alias("source_url"),
        F.array_join(a.matched_subcategories, ", ").alias("matched_subcategories"),
        F.array_join(phrases, "; ").alias("product_phrases"))


def _product_rules(groups, countries) -> Column:
    """Folded phrases of all selected products, with the countries where they count."""
    rows = []
    for major, subcategory, product in groups:
        everywhere = catalog.product_aliases(product)
        rows += [dict(major=major, subcategory=subcategory, product=product, country=None, words=f" {t.fold_python(a)} ")
                 for a in everywhere]
        if "Vietnam" in countries:
            rows += [dict(major=major, subcategory=subcategory, product=product, country="Vietnam", words=f" {t.fold_python(a)} ")
                     for a in catalog.product_aliases(product, "Vietnam") if a not in everywhere]
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)),
                       "array<struct<major:string,subcategory:string,product:string,country:string,words:string>>")


def subcategory_coverage(spark: SparkSession, groups, countries, stats: DataFrame, assessments: DataFrame,
                         approved: DataFrame) -> DataFrame:
    """Search and product evidence per group, subcategory and country.

    ``groups`` lists the selected (major, subcategory, product); products outside the catalogue go under
    a subcategory of their own. ``stats``: country, keyword, calls. ``assessments``: company_id, major,
    target_country, product_hits, priority, quality_decision. ``approved``: company_id, target_country.
    A company counts with its verdict for that country.
    """
    groups, countries = list(groups), list(countries)
    keys = ["major", "subcategory", "country"]
    padded = F.concat(F.lit(" "), t.words(F.col("keyword")), F.lit(" "))
    hits = stats.where(F.col("country").isin(*countries)).withColumn("_words", padded).withColumn(
        "_r", F.explode(F.filter(_product_rules(groups, countries), lambda r: F.col("_words").contains(r["words"])
                                 & (r["country"].isNull() | (r["country"] == F.col("country"))))))
    named = hits.select("country", "keyword", "calls", "_r.major", "_r.subcategory", "_r.product")
    # A keyword counts once per subcategory, however many of its products it names.
    calls = (named.groupBy(*keys, "keyword").agg(F.max("calls").alias("calls"))
             .groupBy(*keys).agg(F.sum("calls").alias("search_calls")))
    searched = named.where(F.col("calls") > 0).groupBy(*keys).agg(F.count_distinct("product").alias("searched_products"))
    pairs = F.from_json(F.lit(json.dumps([dict(major=m, subcategory=s, product=p) for m, s, p in groups], ensure_ascii=False)),
                        "array<struct<major:string,subcategory:string,product:string>>")
    covered = F.array_distinct(F.transform(
        F.filter(pairs, lambda g: (g["major"] == F.col("major")) & F.array_contains("product_hits", g["product"])),
        lambda g: g["subcategory"]))
    matched = assessments.where(F.col("target_country").isin(*countries)).select(
        "company_id", "major", F.col("target_country").alias("country"), "priority", "quality_decision",
        F.explode(covered).alias("subcategory"))
    per_company = matched.groupBy(*keys, "company_id").agg(
        F.max((F.col("priority").isin("A", "B") & (F.col("quality_decision") == "qualified")).cast("int")).alias("_good"))
    companies = per_company.groupBy(*keys).agg(F.count("*").alias("companies_with_product"))
    mail = (approved.select("company_id", F.col("target_country").alias("country"))
            .join(per_company.where(F.col("_good") == 1), ["company_id", "country"]).groupBy(*keys)
            .agg(F.count_distinct("company_id").alias("mailing_companies"), F.count("*").alias("addresses")))
    selected: dict[tuple, int] = {}
    for major, subcategory, _ in groups:
        selected[(major, subcategory)] = selected.get((major, subcategory), 0) + 1
    grid = spark.createDataFrame([(m, s, c, n) for (m, s), n in selected.items() for c in countries],
                                 "major string, subcategory string, country string, selected_products long")
    joined = reduce(lambda df, part: df.join(part, keys, "left"), [searched, calls, companies, mail], grid)
    numbers = ["searched_products", "search_calls", "companies_with_product", "mailing_companies", "addresses"]
    full = joined.select(*keys, "selected_products", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers])
    return full.withColumn("search_state", F.when(F.col("selected_products") == 0, "no_product_selected")
                           .when(F.col("searched_products") < F.col("selected_products"), "products_not_searched")
                           .when(F.col("companies_with_product") == 0, "no_product_evidence").otherwise("product_evidence"))


def subcategory_groups(major: str, subcategories, products, unassigned: str = "unassigned") -> list[tuple]:
    """(major, subcategory, product) of a selection; products of no subcategory get their own row."""
    table: dict[str, set] = {s: set() for s in subcategories}
    for group, _, subcategory, _, phrase in catalog.taxonomy_rows():
        if group == major and subcategory in table:
            table[subcategory].add(t.fold_python(phrase))
    rows = [(major, s, p) for s in subcategories for p in products if t.fold_python(p) in table[s]]
    placed = {p for _, _, p in rows}
    return rows + [(major, unassigned, p) for p in products if p not in placed]


def product_evidence_order(assessments: DataFrame, groups) -> DataFrame:
    """Evidence per selected product: verdicts of its subcategory that name any of its products, least first."""
    pairs = F.from_json(F.lit(json.dumps([dict(major=m, subcategory=s, product=p) for m, s, p in groups], ensure_ascii=False)),
                        "array<struct<major:string,subcategory:string,product:string>>")
    named = F.array_distinct(F.transform(
        F.filter(pairs, lambda g: (g["major"] == F.col("major")) & F.array_contains("product_hits", g["product"])),
        lambda g: g["subcategory"]))
    counts = assessments.select(F.explode(named).alias("subcategory")).groupBy("subcategory").agg(F.count("*").alias("verdicts"))
    rows = assessments.sparkSession.createDataFrame(
        [(m, s, p, i) for i, (m, s, p) in enumerate(groups)], "major string, subcategory string, product string, position int")
    return (rows.join(counts, "subcategory", "left")
            .groupBy("product").agg(F.min(F.coalesce("verdicts", F.lit(0))).alias("evidence"), F.min("position").alias("position"))
            .orderBy("evidence", "position"))


def merge_runs(facts: list[DataFrame], keys, numbers) -> DataFrame:
    """Counters of several runs added up. Long facts replace nested counters, so merging is one sum."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts)
    return every.groupBy(*keys).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in numbers])


def union_records(runs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)


def industry_summary(companies: DataFrame, approved: DataFrame, queries: DataFrame) -> DataFrame:
    """Measures per industry group and its yield: approved addresses per executed query."""
    facts = companies.groupBy("major").agg(*_decisions())
    mail = approved.groupBy("major").agg(F.count("*").alias("sendable"))
    calls = queries.groupBy("major").agg(F.count("*").alias("queries"))
    rows = facts.join(mail, "major", "full_outer").join(calls, "major", "full_outer")
    filled = rows.select("major", *[F.coalesce(c, F.lit(0)).alias(c) for c in rows.columns if c != "major"])
    return filled.withColumn("yield", F.col("sendable") / F.greatest(F.col("queries"), F.lit(1)))


def next_industry(summary: DataFrame) -> DataFrame:
    """Industry group that gets the next queries: the one with the best yield."""
    return summary.agg(F.max_by("major", F.struct("yield", "major")).alias("major"), F.max("yield").alias("yield"))


# ------------------------------------------------------------------ creators

def creator_summary(top: DataFrame, results: DataFrame, gated: DataFrame) -> DataFrame:
    """One row of counts of a creator search."""
    drafted = F.col("outreach_status") == "drafted" if "outreach_status" in top.columns else F.lit(False)
    best = top.agg(F.count("*").alias("records"), *[_count(F.col("grade") == g).alias(f"tier_{g.lower()}") for g in "ABC"],
                   _count(F.col("public_email").isNotNull()).alias("public_emails"), _count(drafted).alias("dm_drafts"))
    raw = results.agg(F.count("*"))
    unique = gated.where(F.col("reject_reason").isNull()).agg(F.count_distinct("handle"))
    return best.select("*", raw.scalar().alias("raw_results"), unique.scalar().alias("unique_profiles"))


# ------------------------------------------------------------------ report tables

def all_companies(companies: DataFrame, holds: DataFrame) -> DataFrame:
    """Analysed companies and holds in one list."""
    return companies.unionByName(holds, allowMissingColumns=True)


def report_order() -> list[Column]:
    return [grade_position(F.col("priority")), F.coalesce("relevance_score", F.lit(0)).desc(), F.lower("company_name")]


def report_sections(companies: DataFrame) -> dict[str, DataFrame]:
    """Row selections of the report."""
    p, d = F.col("priority"), F.col("quality_decision")
    return {"customer": companies.where(p.isin("A", "B", "C", "strategic")), "all": companies,
            "other_country": companies.where(d == "other_country"), "reference": companies.where(d == "reference"),
            "excluded": companies.where(d == "excluded")}


def numbered(companies: DataFrame, *ties: str) -> DataFrame:
    """Companies in report order with their row number."""
    return grouping.sequential(companies, [*report_order(), *map(F.col, ties)], "row_number")


def contacts_with_letters(contacts: DataFrame, letters: DataFrame) -> DataFrame:
    """Contacts with the state of their letter, or the state they wait in."""
    drafts = letters.groupBy("company_id").agg(
        F.min(F.struct("recipient", "subject_en", "review_status")).alias("_l"))
    waiting = (F.when(F.col("quality_decision") == "other_country", "after_country_check")
               .when(F.col("quality_decision") == "reference", "after_company_check"))
    return contacts.join(drafts, "company_id", "left").withColumns({
        "letter_status": F.coalesce(waiting, "_l.review_status", F.lit("awaiting_input")),
        "letter_subject": F.col("_l.subject_en"), "recipient": F.col("_l.recipient")}).drop("_l")


def contact_totals(contacts: DataFrame) -> DataFrame:
    d = F.col("quality_decision")
    return contacts.agg(F.count("*").alias("addresses"), F.count_distinct("company_id").alias("companies"),
                        _count(d == "reference").alias("reference_addresses"),
                        _count((d == "other_country") | ~_has("verified_country")).alias("country_to_check"))


def evidence_log(stats: DataFrame, rejects: DataFrame, reasons: DataFrame, log: DataFrame,
                 expansions: DataFrame | None = None, diagnosis: DataFrame | None = None) -> DataFrame:
    """Keywords, expansions, reject reasons, quality reasons, calls and the diagnosis in one table."""
    def rows(df: DataFrame, kind: str, stage, subject: str, count: str, status=None, detail=None) -> DataFrame:
        text = lambda c: F.lit(None).cast("string") if c is None else c
        return df.select(F.lit(kind).alias("kind"), text(stage).cast("string").alias("stage"),
                         F.col(subject).cast("string").alias("subject"), F.col(count).cast("long").alias("results"),
                         text(status).cast("string").alias("http_status"), text(detail).cast("string").alias("detail"))

    note = F.concat(F.lit("accepted "), "accepted_results", F.lit(", rejected "), "rejected_results", F.lit(", calls "), "calls")
    parts = [rows(stats.where(F.col("country").isNotNull()), "keyword", country_name_ko(F.col("country")), "keyword",
                  "raw_results", None, note),
             rows(rejects, "reject_reason", F.lit("search_result"), "reject_reason", "results"),
             rows(reasons, "quality_reason", F.lit("official_site"), "reason", "companies"),
             rows(log, "call", F.col("provider"), "query", "result_count", F.col("http_status"), F.col("error"))]
    if expansions is not None:
        parts.append(rows(expansions, "expansion", F.col("country"), "keyword", "calls"))
    if diagnosis is not None:
        parts.append(rows(diagnosis, "diagnosis", F.col("provider"), "query", "result_count", F.col("http_status"), F.col("error")))
    return reduce(DataFrame.unionByName, parts)


def newest_runs(history: DataFrame, n: int = 20) -> DataFrame:
    return history.orderBy(F.desc("updated_at"), F.desc("job_id")).limit(n)
