"""Buyer campaign: search results and pages in, graded companies, contacts and reports out.

Tables that several later steps read (page extracts, provisional grades, records) are stored once, in
``stage_dir``, where an interrupted run finds them again, or as reliable checkpoints. The rest is lazy.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from leadloom.config import Campaign, EmailRules, GradeRules, ResultRules
from leadloom.functions import emails, grouping, ids, text as t, urls
from leadloom.operators import companies as co, contacts as ct, discovery, grading, names, pages as pg
from leadloom.sources.dimensions import with_country_facts
from leadloom.sources.stages import Stages, fingerprint

# Sites of these classes are settled by their home page.
SETTLED_SITES = ("platform", "spam", "tourism", "investment", "legal", "logistics", "cleanroom", "software", "media",
                 "agency", "equipment", "clinical_research", "outsourcing")
SETTLED_DECISIONS = ("other_country", "reference", "excluded")


@dataclass
class BuyerTables:
    filtered: DataFrame
    pool: DataFrame
    candidates: DataFrame
    records: DataFrame
    companies: DataFrame
    addresses: DataFrame
    contacts: DataFrame
    approved: DataFrame
    holds: DataFrame


def _keep(stages: Stages | None, df: DataFrame, name: str) -> DataFrame:
    return grouping.durable(df) if stages is None else stages.keep(df, name)


def directory_links(sources: DataFrame, pages: DataFrame, email_rules: EmailRules = EmailRules()) -> DataFrame:
    """Companies that the pages of exhibition and association results link to, with the result that led there."""
    asked = sources.withColumn("_k", urls.page_key("url"))
    keyed = pages.withColumn("_k", urls.page_key("url"))
    read = pg.extract_pages(keyed.join(asked.select("_k").distinct(), "_k", "left_semi").drop("_k"), email_rules)
    found = pg.external_company_links(read).select(urls.page_key("source_url").alias("_k"), "root_url", "source_url")
    return asked.select("_k", "country", "keyword", "query", "content", "arrival").join(found, "_k").drop("_k")


def discover(results: DataFrame, campaign: Campaign, rules: ResultRules, pages: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(filtered results, pool, chosen candidates). With ``pages``, companies linked from directory results join the pool."""
    companies, sources = discovery.split_ecosystem_sources(results, rules)
    filtered = discovery.prefilter_results(companies, rules)
    pool = discovery.pool_candidates(discovery.accepted(filtered))
    if pages is not None:
        pool = discovery.add_directory_links(pool, directory_links(sources, pages))
    overall = None if campaign.candidate_ceiling is None else campaign.discovery_limit
    return filtered, pool, discovery.top_candidates(pool, campaign.per_country_limit, overall, campaign.countries)


def _home_pages(extracted: DataFrame) -> DataFrame:
    """Page nearest to the root of each domain."""
    fields = ["url", "host", "title", "site_name", "jsonld_name", "text", "emails", "phones", "anchors"]
    depth = F.length(urls.path("url"))
    return extracted.groupBy("domain").agg(grouping.best_row(fields, depth, F.col("url")).alias("_h")).select("domain", "_h.*")


def provisional_grades(candidates: DataFrame, home: DataFrame, campaign: Campaign, rules: GradeRules) -> DataFrame:
    named = names.with_brand_name(names.elect_company_name(home))
    rows = candidates.select("country", "domain", "keyword", "query", "discovery_source", "discovery_url", "candidate_score",
                             "arrival").join(named, "domain")
    shaped = rows.withColumnRenamed("country", "target_country").withColumns({
        "website": urls.root_url("url"), "home_url": F.col("url"), "identity_text": F.col("text")})
    return grading.assess_companies(shaped, campaign, rules)


def needs_deep_review() -> Column:
    open_site = ~F.col("site_type").isin(*SETTLED_SITES) & ~F.col("quality_decision").isin(*SETTLED_DECISIONS)
    second_chance = (F.col("site_type") == "official_site") & (F.col("country_score") > 0) & (F.col("candidate_score") >= 10)
    return open_site | second_chance


def visited_pages(provisional: DataFrame, home: DataFrame, extracted: DataFrame, campaign: Campaign,
                  rules: EmailRules) -> DataFrame:
    """Contact pages read per domain, in order, until an own address and an identity page are known."""
    own_home = F.exists("emails", lambda e: urls.mail_domain(e) == F.col("domain"))
    use = emails.purpose(F.coalesce(F.get("emails", F.lit(0)), F.lit("")), rules)
    open_domains = provisional.where(needs_deep_review()).groupBy("domain").agg(
        F.max(F.when(F.col("quality_decision") == "qualified", "qualified")).alias("quality_decision"))
    budget = open_domains.join(home.select("domain", own_home.alias("has_official_email"), use.alias("email_purpose")), "domain")
    links = extracted.select("domain", F.posexplode(F.transform("links", urls.page_key)).alias("position", "url"))
    wanted = pg.pages_to_visit(budget, links, campaign.max_pages_per_company)
    page = F.struct(F.col("place"), F.col("url").alias("url"), F.col("source_priority"), "text", "emails", "phones")
    texts = extracted.select("domain", urls.page_key("url").alias("url"), "text", "emails", "phones")
    # At most `max_pages_per_company - 1` pages per domain are collected.
    read = (wanted.join(texts, ["domain", "url"]).join(budget.select("domain", "has_official_email"), "domain")
            .groupBy("domain", "has_official_email").agg(F.array_sort(F.collect_list(page)).alias("_pages")))

    def enough(upto):
        seen = F.filter("_pages", lambda p: p["place"] <= upto)
        own = F.exists(seen, lambda p: F.exists(p["emails"], lambda e: urls.mail_domain(e) == F.col("domain")))
        return (F.col("has_official_email") | own) & F.exists(seen, lambda p: p["source_priority"] >= 2)

    stop = F.array_min(F.transform(F.filter("_pages", lambda p: enough(p["place"])), lambda p: p["place"]))
    return read.select("domain", F.filter("_pages", lambda p: p["place"] <= F.coalesce(stop, p["place"])).alias("visits"))


def read_sites(candidates: DataFrame, pages: DataFrame, campaign: Campaign, email_rules: EmailRules = EmailRules(),
               stages: Stages | None = None) -> DataFrame:
    """Page extracts of the candidates' sites, stored. Pages without text are left out: such a site counts as not readable."""
    keyed = pages.withColumn("_d", urls.registrable_domain("url"))
    wanted = candidates.select(F.col("domain").alias("_d")).distinct()
    if campaign.candidate_ceiling is not None:  # a stated number of domains: the pages need not be shuffled to meet them
        wanted = F.broadcast(wanted)
    extracted = _keep(stages, pg.extract_pages(keyed.join(wanted, "_d", "left_semi").drop("_d"), email_rules), "page_extract")
    return extracted.where(F.trim("text") != "")


def analyse(candidates: DataFrame, pages: DataFrame, campaign: Campaign, email_rules: EmailRules = EmailRules(),
            grade_rules: GradeRules = GradeRules(), stages: Stages | None = None, extracted: DataFrame | None = None) -> DataFrame:
    """One graded record per candidate with a readable site; `email_candidates` holds every address of its visited pages."""
    if extracted is None:
        extracted = read_sites(candidates, pages, campaign, email_rules, stages)
    home = _home_pages(extracted)
    provisional = _keep(stages, provisional_grades(candidates, home, campaign, grade_rules), "provisional")
    visits = visited_pages(provisional, home, extracted, campaign, email_rules)
    deep = _keep(stages, home.join(visits, "domain", "left"), "visited")
    identity = F.concat_ws(" ", F.col("text"), F.transform(
        F.filter("visits", lambda p: p["source_priority"] >= 2), lambda p: p["text"]))
    found = F.concat(
        F.transform("emails", lambda e: F.struct(e.alias("email"), F.col("url").alias("email_source_url"))),
        F.coalesce(F.flatten(F.transform("visits", lambda p: F.transform(p["emails"], lambda e: F.struct(
            e.alias("email"), p["url"].alias("email_source_url"))))), F.array().cast(
                "array<struct<email:string,email_source_url:string>>")))
    rows = deep.select("domain", F.explode(found).alias("_f")).select("domain", "_f.*").withColumn(
        "source_priority", emails.source_priority(F.col("email_source_url")))
    best = rows.groupBy("domain", "email").agg(grouping.best_row(
        ["email_source_url", "source_priority"], -F.col("source_priority"), F.col("email_source_url")).alias("_s")).select(
            "domain", "email", "_s.*")
    chosen = co.choose_contact(best, email_rules)
    view = co.address_view(F.col("email"), F.col("email_source_url"), F.col("domain"), email_rules)
    # The addresses of at most `max_pages_per_company` pages.
    every = best.select("domain", F.struct(*[value.alias(name) for name, value in view.items()]).cast(co.ADDRESS).alias("_a")).groupBy(
        "domain").agg(F.sort_array(F.collect_list("_a")).alias("email_candidates"))
    shown = deep.select(
        "domain", identity.alias("identity_text"), F.col("text").alias("home_text"),
        F.when(F.size("phones") > 0, F.col("phones")).otherwise(
            F.coalesce(F.flatten(F.transform("visits", lambda p: p["phones"])), F.col("phones"))).alias("phones"),
        F.coalesce(F.size("visits"), F.lit(0)).alias("_read"), F.col("visits").isNotNull().alias("_deep"))
    kept = provisional.select("domain", "target_country", "company_name", "brand_name", "website", "home_url", "keyword",
                              "query", "discovery_source", "discovery_url", "candidate_score", "arrival",
                              needs_deep_review().alias("_open"))
    final = grading.assess_companies(kept.join(shown, "domain").withColumnsRenamed(
        {"_open": "open_site", "_read": "pages_read"}), campaign, grade_rules)
    dial = with_country_facts(final, "target_country")
    cleaned = F.filter(F.transform("phones", lambda p: pg.clean_phone(p, F.col("target_country"), F.col("dial"))),
                       lambda p: p.isNotNull())
    record = dial.join(chosen, "domain", "left").join(every, "domain", "left").withColumns({
        "company_id": ids.company_id(F.col("domain")), "phone": F.get(cleaned, F.lit(0)),
        "record_id": F.concat_ws("|", "domain", "target_country"),
        "business_description": F.left(t.squash(F.col("home_text")), F.lit(500)),
        "company_source_url": F.col("home_url"), "email_status": F.coalesce("email_status", F.lit("none")),
        "email_domain_status": F.coalesce("email_domain_status", F.lit("none")),
        "email_grade": F.when(F.col("priority") == "excluded", "excluded").otherwise(F.coalesce("email_grade", F.lit("D"))),
        "collection_depth": F.when(~F.col("open_site"), "homepage_only").when(F.col("pages_read") > 0, "deep_contact")
        .otherwise("homepage_complete")})
    return record.drop("identity_text", "home_text", "phones", "continent", "tld", "dial", "aliases", "local_buyer",
                       "product_matches", "open_site", "pages_read", "has_official_email", "_deep")


def run(results: DataFrame, pages: DataFrame, campaign: Campaign, rules: ResultRules | None = None,
        email_rules: EmailRules = EmailRules(), grade_rules: GradeRules = GradeRules(),
        stage_dir: str | None = None, external: DataFrame | None = None, previous: DataFrame | None = None,
        inputs: str | None = None) -> BuyerTables:
    """All tables of a campaign. ``external`` fills qualified companies without an address from outside contacts
    (`companies.enrich_contacts`).

    With ``stage_dir``, a run that was interrupted goes on from its finished stages if settings and inputs are the same; ``inputs`` names the
    inputs where the caller knows them by a version, else their files or rows are compared. ``previous``: records of an
    earlier run, whose (domain, country) pairs are not analysed again and which join the new records.
    """
    rules = rules or ResultRules(industry_terms=campaign.industry_terms())
    tables = [inputs] if inputs is not None else [df for df in (results, pages, external, previous) if df is not None]
    known = (external is not None, previous is not None)
    mark = "" if stage_dir is None else fingerprint(campaign, rules, email_rules, grade_rules, known, *tables)
    stages = Stages(results.sparkSession, stage_dir, mark)
    filtered, pool, chosen = discover(results, campaign, rules, pages)
    if previous is not None:
        chosen = discovery.pending_candidates(chosen, previous.select(F.concat_ws("|", "domain", "target_country").alias("key")))
    candidates = stages.keep(chosen, "candidates")
    extracted = read_sites(candidates, pages, campaign, email_rules, stages)
    records = analyse(candidates, pages, campaign, email_rules, grade_rules, stages, extracted)
    if external is not None and campaign.include_external:
        records = co.enrich_contacts(records, external, email_rules)
    if previous is not None:
        records = previous.unionByName(records)
    records = stages.keep(records, "records")
    owned = stages.keep(co.assign_owners(records, email_rules), "owned")
    merged = co.merge_owned(owned, records.columns, email_rules)
    addresses = co.company_addresses(owned, email_rules)
    contacts = ct.review_contacts(company_contacts(merged, addresses, email_rules), campaign.include_external, email_rules)
    holds = discovery.hold_failed_candidates(candidates, extracted, campaign, rules)
    return BuyerTables(filtered, pool, candidates, records, merged, addresses, contacts,
                       contacts.where(F.col("delivery_status") == "approved"), holds)


def company_contacts(merged: DataFrame, addresses: DataFrame, rules: EmailRules = EmailRules()) -> DataFrame:
    """The contact list of merged companies: one row per address, with every address of each company."""
    companies = merged.drop(*co.EMAIL_FIELDS)
    variants = companies.join(addresses.drop("mentions"), "owner_id").withColumn("position", F.lit(0))
    return ct.listed_contacts(variants, True, True, True, rules)
