"""Evidence scores, site class and grade of companies, from the text of their pages.

Input columns: company_name, website, target_country, identity_text, and optionally discovery_url.
Each step adds columns; steps are separate projections, so Spark evaluates each signal once.
"""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from leadloom.config import Campaign, GradeRules
from leadloom.functions import catalog, grouping, numbers, text as t, urls, vocabulary as v
from leadloom.sources.dimensions import with_country_facts


def _every_term() -> list[str]:
    listed: list[str] = []
    for name, value in vars(v).items():
        if name.isupper() and isinstance(value, (tuple, dict)):
            for part in value.values() if isinstance(value, dict) else [value]:
                listed += [x for x in part if isinstance(x, str)] if isinstance(part, tuple) else []
    return listed


GATE = t.Gate(_every_term())


def _hits(text: str, terms) -> Column:
    return t.term_hits(text, terms, GATE)


def _count(text: str, terms) -> Column:
    return t.term_count(text, terms, GATE)


def _has(text: str, terms) -> Column:
    return t.has_term(text, terms, GATE)


def _group(patterns) -> str:
    return "(?:" + t.either(t.literal_pattern(p) for p in patterns) + ")"


def _near(identity: Column, before: str, alias: Column, after: str) -> Column:
    """The alias, taken literally, between two patterns."""
    return F.rlike(identity, F.concat(F.lit("(?U)" + before + r"\Q"), alias, F.lit(r"\E" + after)))


def _tidy(value: Column) -> Column:
    return t.squash(F.lower(F.coalesce(value, F.lit(""))))


def prepare(companies: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Normalised text columns and the facts of the target country."""
    discovery = F.col("discovery_url") if "discovery_url" in companies.columns else F.lit("")
    rows = with_country_facts(companies, "target_country", facts).withColumns({
        "_identity": _tidy(F.col("identity_text")),
        "_name": F.lower(F.coalesce("company_name", F.lit(""))),
        "_host": urls.host("website"),
        "_site_path": urls.path("website"),
        "_discovery_path": urls.path(discovery),
    })
    named = grouping.settle(rows.withColumns({
        "_named": F.concat_ws(" ", "_name", "_identity"), "_domain": urls.registrable(F.col("_host"))}), "_identity", "_named")
    return grouping.settle(named.withColumns(GATE.columns(F.col("_named"))), "_seen", "_marks")


# ------------------------------------------------------------------ country evidence

def score_country(prepared: DataFrame, markers=v.LOCAL_LANGUAGE_MARKERS, cities=v.CITY_MARKERS) -> DataFrame:
    """Country score 0-3, its evidence codes, and the verified country where the evidence is strong."""
    identity, country = F.col("_identity"), F.col("target_country")
    hits = prepared.withColumn("_aliases", F.filter("aliases", lambda a: (a != "") & identity.contains(a)))
    dial_number = F.concat(F.lit(r"(?U)\b\Q"), F.col("dial"), F.lit(r"\E[ .()-]?\d{7,12}\b"))
    places = _group(v.PRESENCE_TERMS)

    def by_country(table: dict, value) -> Column:
        chosen = F.lit(None)
        for name, listed in table.items():
            chosen = F.when(country == name, value(listed)).otherwise(chosen)
        return chosen

    market_before = (r"(?:based|located|headquartered|office|operations?|distributor|importer|retailer|stores?)"
                     r"\s+(?:in|across)\s+")
    market_after = r"(?:ese)?\s+(?:market|company|distributor|importer|retailer|stores?|operations?)\b"
    signals = hits.withColumns({
        "_tld": urls.under_tld(F.col("_host"), F.col("tld")),
        "_dial": (F.col("dial") != "") & (identity.contains(F.concat(F.lit("+"), F.col("dial")))
                                          | F.rlike(identity, dial_number)),
        "_address": F.exists("_aliases", lambda a: _near(
            identity, _group(v.LOCATION_HINTS) + r"[^.;|]{0,120}\b", a, r"\b")),
        "_presence": F.exists("_aliases", lambda a: _near(identity, "", a, r"[^.;|]{0,100}" + places)
                              | _near(identity, places + r"[^.;|]{0,100}", a, "")),
        "_business": F.exists("_aliases", lambda a: _near(
            identity, "", a, r"[^.;|]{0,80}" + _group(v.LOCAL_BUSINESS_TERMS))),
        "_language": F.coalesce(by_country(markers, lambda x: _count("_identity", x) >= 2), F.lit(False)),
        "_market": F.exists("_aliases", lambda a: _near(identity, market_before, a, r"\b")
                            | _near(identity, r"\b", a, market_after)),
        "_city": F.coalesce(by_country(cities, lambda x: t.has_substring("_identity", x)), F.lit(False))
        & identity.rlike(rf"(?U)\b{_group(v.CITY_CONTACT_WORDS)}\b"),
    })
    hard = F.col("_tld") | F.col("_dial") | F.col("_address") | F.col("_city") | F.col("_market")
    strong = signals.withColumns({"_hard_country": hard, "_strong_country": hard | F.col("_language")})
    weighted = [("tld", "_tld", 2), ("address", "_address", 2), ("city_contact", "_city", 2), ("dial_code", "_dial", 2),
                ("presence", "_presence", 1), ("local_business", "_business", 1), ("local_language", "_language", 2),
                ("market_sentence", "_market", 2)]

    def counts(column: str, weight: int) -> Column:
        return F.col(column) & F.col("_strong_country") if weight == 1 else F.col(column)

    points = sum((F.when(counts(c, w), w).otherwise(0) for _, c, w in weighted), F.lit(0))
    evidence = F.array_compact(F.array(*[F.when(counts(c, w), F.lit(code)) for code, c, w in weighted]))
    scored = strong.withColumns({
        "country_score": F.least(F.lit(3), points).cast("int"),
        "country_evidence": evidence,
        "verified_country": F.when(F.col("_strong_country"), country),
        "_country_named": (F.size("_aliases") > 0) | F.col("_strong_country"),
    })
    return grouping.settle(scored, "country_score")


# ------------------------------------------------------------------ products

def product_matches(text: Column, products, country: Column | str = "") -> Column:
    """(product, alias) pairs whose words occur in the text; accents and punctuation do not matter.

    Local phrases of a country only count where ``country``, a name or a column, is that country.
    """
    place = F.lit(country) if isinstance(country, str) else country
    rows = []
    for product in products:
        everywhere = catalog.product_aliases(product)
        local = [a for a in catalog.product_aliases(product, "Vietnam") if a not in everywhere]
        rows += [{"product": product, "alias": a, "words": f" {t.fold_python(a)} ", "country": where}
                 for aliases, where in ((everywhere, None), (local, "Vietnam")) for a in aliases if t.fold_python(a)]
    rules = F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)),
                        "array<struct<product: string, alias: string, words: string, country: string>>")
    padded = F.concat(F.lit(" "), t.words(text), F.lit(" "))
    return t.let(padded, lambda body: F.filter(
        rules, lambda r: body.contains(r["words"]) & (r["country"].isNull() | (r["country"] == place))))


def match_products(docs: DataFrame, products, text: str = "text", key: str = "doc_id", country: str = "") -> DataFrame:
    """One row per document and product, with the phrases found."""
    found = docs.select(key, product_matches(F.col(text), products, country).alias("_m"))
    names = F.array_distinct(F.transform("_m", lambda r: r["product"]))
    return (found.select(key, "_m", F.explode(names).alias("product"))
            .select(key, "product", F.transform(F.filter("_m", lambda r: r["product"] == F.col("product")),
                                                lambda r: r["alias"]).alias("aliases")))


# ------------------------------------------------------------------ industry and role evidence

def buyer_type(identity, name) -> Column:
    chosen = F.when(_has(name, v.CLINIC_NAME_TERMS), "clinic_salon")
    for label, terms in v.BUYER_TYPE_TERMS.items():
        chosen = chosen.when(_has(identity, terms), label)
    return chosen.otherwise("unknown")


def _without(hits: Column, terms) -> Column:
    return F.array_except(hits, t.strings(terms))


def _score(hits: Column) -> Column:
    return F.when(F.size(hits) == 0, 0).when(F.size(hits) == 1, 2).otherwise(3)


def score_roles(scored: DataFrame, campaign: Campaign) -> DataFrame:
    """Industry and buyer-role hits and scores, with the exceptions for masks, denials, shops and clinics."""
    identity, named = "_identity", "_named"
    beauty = campaign.industry in v.BEAUTY_INDUSTRIES
    role_terms = v.BUYER_IDENTITY_TERMS + v.SUPPLIER_TERMS + v.EXTRA_IMPORT_TERMS
    first = scored.withColumns({
        "product_matches": product_matches(F.col(identity), campaign.products, F.col("target_country")),
        "_term_hits": _hits(identity, campaign.industry_terms()),
        "_role_terms": _hits(named, role_terms),
        "_local_roles": F.filter("local_buyer", lambda term: t.present(F.col(named), F.lower(term))),
        "_typed": buyer_type(identity, "_name"),
        "_denied": _has(named, v.NOT_DISTRIBUTOR_TERMS),
        "_garment": _has(named, v.GARMENT_TERMS) if beauty else F.lit(False),
        "_own_store": _count(identity, v.OWN_STORE_TERMS),
        "_dealer_path": t.has_substring("_discovery_path", v.DEALER_PATHS),
        "_multibrand_terms": _count(identity, v.MULTIBRAND_TERMS),
        "_own_brand": _count(identity, v.OWN_BRAND_TERMS),
    })
    matched = F.transform("product_matches", lambda m: m["product"])
    second = first.withColumns({
        "_industry": F.array_distinct(F.concat("_term_hits", matched)),
        "_roles": F.array_distinct(F.concat("_role_terms", "_local_roles")),
        "_multibrand": F.col("_multibrand_terms") + F.col("_dealer_path").cast("int"),
    })
    only_masks = (F.size("_industry") > 0) & (F.size(_without(F.col("_industry"), v.MASK_WORDS)) == 0)
    third = second.withColumns({
        "industry_hits": F.when(F.col("_garment") & only_masks, t.strings([])).otherwise(F.col("_industry")),
        "_stated_roles": F.when(F.col("_denied"), _without(F.col("_roles"), v.GENERIC_DISTRIBUTION_TERMS))
        .otherwise(F.col("_roles")),
        "_stated_type": F.when(F.col("_denied") & (F.col("_typed") == "distributor"), "unknown")
        .otherwise(F.col("_typed")),
    })
    no_role = F.size("_stated_roles") == 0
    shop = (no_role & (F.size("industry_hits") > 0) & ((F.col("_own_store") >= 2) | F.col("_dealer_path"))
            & (F.col("_multibrand") >= 1) & (F.col("_own_brand") == 0))
    fourth = third.withColumns({
        "_shop": shop,
        "buyer_type": F.when(shop & (F.col("_stated_type") == "unknown"), "retail_chain").otherwise(F.col("_stated_type")),
    })
    roles = (F.when(F.col("_shop"), F.array(F.lit("multibrand_retail")))
             .when((F.size("_stated_roles") == 0) & (F.col("buyer_type") == "clinic_salon"),
                   F.array(F.lit("clinic_or_salon"))).otherwise(F.col("_stated_roles")))
    return grouping.settle(fourth.withColumn("role_hits", roles).withColumns({
        "industry_score": _score(F.col("industry_hits")), "buyer_role_score": _score(F.col("role_hits"))}), "buyer_role_score")


# ------------------------------------------------------------------ site class

def classify_site(scored: DataFrame, campaign: Campaign) -> DataFrame:
    """Site class by an ordered list of identities, with the signals that the grade needs."""
    identity, named, name = "_identity", "_named", "_name"
    beauty = campaign.industry in v.BEAUTY_INDUSTRIES
    host = F.col("_domain")

    def many(column: str, terms, least: int) -> Column:
        return _count(column, terms) >= least

    services = F.lit(None).cast("string")
    for label, terms in reversed(v.SERVICE_IDENTITIES.items()):
        services = F.when(_has(named, terms), label).otherwise(services)
    segments = rf"(?:^|/){_group(v.EXHIBITION_PATH_SEGMENTS)}(?:/|$)"
    software_words = rf"(?<![a-z0-9]){_group(v.SOFTWARE_NAME_WORDS)}(?![a-z0-9])"
    signals = scored.withColumns({
        "_company": (F.col("industry_score") > 0) & (F.col("buyer_role_score") > 0),
        "_platform": urls.under_any_host(host, v.BLOCKED_HOSTS) | host.isin(*v.DIRECTORY_HOSTS)
        | many(identity, v.PLATFORM_TERMS, 2) | many(identity, v.DIRECTORY_IDENTITY_TERMS, 2)
        | (_has(named, v.AGENT_SEARCH_TERMS) & many(identity, v.LISTING_ACTION_TERMS, 2)),
        "_spam": _has(named, v.SPAM_TERMS),
        "_tourism_terms": many(named, v.TOURISM_TERMS, 2),
        "_tourism_name": _has(name, v.TOURISM_NAME_TERMS),
        "_investment": _has(name, v.INVESTMENT_NAME_TERMS) | many(named, v.INVESTMENT_TERMS, 2),
        "_legal": _has(name, v.LEGAL_NAME_TERMS) | many(named, v.LEGAL_TERMS, 2),
        "_logistics_terms": _count(named, v.LOGISTICS_TERMS),
        "_explicit_logistics": _count(named, v.EXPLICIT_LOGISTICS_TERMS),
        "_record_importer": _has(named, v.RECORD_IMPORTER_TERMS),
        "_fulfillment": _has(named, v.FULFILLMENT_TERMS),
        "_cosmetic_product": _has(identity, v.COSMETIC_PRODUCT_TERMS),
        "_cleanroom": _has(named, v.CLEANROOM_TERMS),
        "_cleanroom_strong": many(named, v.STRONG_CLEANROOM_TERMS, 2),
        "_software": F.col(name).rlike(software_words) | many(named, v.SOFTWARE_TERMS, 2)
        | _has(name, v.SOFTWARE_NAME_TERMS)
        | (_has(identity, v.SOFTWARE_CONTEXT_TERMS) & many(identity, v.SOFTWARE_FEATURE_TERMS, 2)),
        "_service": services,
        "_exhibition": _has(named, v.EXHIBITION_TERMS),
        "_ecosystem_name": _has(name, v.EXHIBITION_NAME_TERMS) | F.col("_site_path").rlike(segments),
        "_known_media": host.isin(*v.MEDIA_HOSTS),
        "_media_identity": _has(named, v.MEDIA_IDENTITY_TERMS),
        "_strong_media": _count(named, v.STRONG_MEDIA_TERMS),
        "_weak_media": _count(named, v.WEAK_MEDIA_TERMS),
        "_market_research": _has(named, ("market research",)),
        "_content": _count(identity, v.CONTENT_TERMS),
        "_agency_terms": _count(named, v.AGENCY_TERMS),
        "_packaging": _has(identity, v.PACKAGING_TERMS) if beauty else F.lit(False),
        "_maker_terms": _count(named, v.MANUFACTURER_TERMS),
        "_maker_name": _has(name, v.MANUFACTURER_NAME_TERMS),
        "_own_factory": _has(named, v.OWN_FACTORY_TERMS),
        "_contract_maker": _has(named, v.CONTRACT_MAKER_TERMS),
        "_brand_terms": _count(named, v.BRAND_OWNER_TERMS),
        "_import_name": _has(name, v.IMPORT_NAME_TERMS),
        "_import_terms": _has(identity, v.INBOUND_IMPORT_TERMS),
        "_own_import": _has(identity, v.OWN_IMPORT_TERMS),
        "_equipment_terms": _has(named, v.EQUIPMENT_TERMS),
        "_strong_distribution": _has(named, v.STRONG_DISTRIBUTION_TERMS),
        "_export_terms": _has(named, v.EXPORT_SELLER_TERMS),
        "_clinic_trade": _has(identity, v.CLINIC_TRADE_TERMS),
    })
    c = F.col
    maker = ((c("_maker_name") & (c("_maker_terms") >= 1)) | c("_own_factory")
             | ((c("_maker_terms") >= 3) & c("_contract_maker")))
    known_media = c("_known_media") | c("_media_identity")
    media = (known_media | (c("_strong_media") >= 2) | (c("_market_research") & (c("buyer_role_score") == 0))
             | ((c("_weak_media") >= 2) & ~c("_company")))
    logistics = ((c("_explicit_logistics") >= 2) | (c("_record_importer") & ~c("_cosmetic_product"))
                 | (c("_fulfillment") & ~c("_cosmetic_product")) | ((c("_logistics_terms") >= 2) & ~c("_company")))
    merged = signals.withColumns({"_maker": maker, "_authoritative": known_media}).withColumns({
        "_inbound": (c("_import_name") | c("_import_terms"))
        & ~(c("_denied") & c("_maker") & ~(c("_import_name") | c("_own_import"))),
        # Fair pages carry news, and makers carry blogs: neither is a medium unless it says so.
        "_content_source": (media | ((c("_content") >= 2) & ~c("_company"))) & ~c("_exhibition")
        & ~(c("_maker") & ~c("_authoritative")),
        "_logistics": logistics & ~(c("_maker") & (c("_maker_name") | c("_own_factory"))),
        "_tourism": (c("_tourism_terms") & ~c("_company")) | (c("_tourism_name") & (c("buyer_type") != "clinic_salon")),
        "_ecosystem": c("_exhibition") | c("_ecosystem_name"),
        "_agency": (c("_agency_terms") >= 2) | ((c("_agency_terms") >= 1) & ~c("_company")),
        "_cleanroom_service": (c("_cleanroom") & (F.size("product_matches") == 0)
                               & (~c("_cosmetic_product") | c("_cleanroom_strong"))) if beauty else F.lit(False),
        "_equipment": (c("_equipment_terms") & ~c("_cosmetic_product") & (c("buyer_type") != "clinic_salon"))
        if beauty and campaign.group != catalog.EQUIPMENT_GROUP else F.lit(False),
        "_own_brand_store": (c("_own_brand") > 0) & (c("_own_store") >= 2) & ~c("_strong_distribution"),
    })
    denied_maker = c("_denied") & c("_maker") & ~c("_inbound")
    known_owner = host.isin(*v.BRAND_OWNER_HOSTS) | F.trim(F.col(name)).isin(*v.BRAND_OWNER_NAMES)
    decided = merged.withColumns({
        "_distribution": c("_strong_distribution") & ~denied_maker,
        "_brand_owner": ((known_owner | (c("_brand_terms") >= 2)) & ~c("_inbound") & (c("_multibrand") == 0))
        if beauty else F.lit(False),
        "_export_seller": c("_export_terms") & ~c("_inbound"),
        "role_hits": F.when(denied_maker, _without(c("role_hits"), v.MAKER_IGNORED_ROLE_TERMS)).otherwise(c("role_hits")),
        "buyer_type": F.when(denied_maker, "manufacturer").otherwise(c("buyer_type")),
    }).withColumn("buyer_role_score", _score(c("role_hits")))
    ladder = [("platform", "_platform"), ("spam", "_spam"), ("tourism", "_tourism"), ("investment", "_investment"),
              ("legal", "_legal"), ("logistics", "_logistics"), ("cleanroom", "_cleanroom_service"),
              ("software", "_software"), (None, "_service"), ("ecosystem", "_ecosystem"),
              ("media", "_authoritative"), ("manufacturer", "_maker"), ("brand_owner", "_brand_owner"),
              ("media", "_content_source"), ("agency", "_agency"), ("equipment", "_equipment"),
              ("packaging", "_packaging"), ("export_seller", "_export_seller")]
    site = F.lit("official_site")
    for label, column in reversed(ladder):
        site = (F.coalesce(c(column), site) if label is None else F.when(c(column), label).otherwise(site))
    return grouping.settle(decided.withColumn("site_type", site), "site_type")


# ------------------------------------------------------------------ grade

def _reasons(*pairs) -> Column:
    return F.array_distinct(F.array_compact(F.array(*[F.when(cond, value) for value, cond in pairs])))


def grade_companies(classified: DataFrame, rules: GradeRules = GradeRules()) -> DataFrame:
    """Relevance, reasons, decision, priority and the reason of the grade."""
    c = F.col
    country, industry, role = c("country_score"), c("industry_score"), c("buyer_role_score")
    three = F.lit(3.0)
    relevance = numbers.half_even(country / three * 30 + industry / three * 35 + role / three * 35)
    hybrid = c("_inbound") | c("_distribution")
    strategic = ((country > 0) & (industry > 0) & (c("_maker") | c("_export_seller")) & ~hybrid
                 & ~(c("_ecosystem") | c("_packaging") | c("_brand_owner") | c("_own_brand_store")))
    base = classified.withColumns({"relevance_score": relevance, "_hybrid": hybrid, "_strategic": strategic})
    lit = F.lit
    listed = base.withColumns({
        "hard_reasons": _reasons(
            (lit("platform"), c("_platform")), (lit("spam"), c("_spam")), (lit("tourism"), c("_tourism")),
            (lit("investment"), c("_investment")), (lit("legal"), c("_legal")), (lit("logistics"), c("_logistics")),
            (lit("software"), c("_software")), (c("_service"), c("_service").isNotNull() & ~c("_distribution")),
            (lit("cleanroom"), c("_cleanroom_service")), (lit("equipment"), c("_equipment")),
            (lit("media"), c("_content_source")), (lit("agency"), c("_agency"))),
        "reference_reasons": _reasons(
            (lit("ecosystem"), c("_ecosystem")), (lit("packaging"), c("_packaging")),
            (lit("manufacturer"), c("_maker") & ~c("_hybrid") & ~c("_strategic")),
            (lit("brand_owner"), c("_brand_owner")),
            (lit("export_seller"), c("_export_seller") & ~c("_hybrid") & ~c("_strategic")),
            (lit("own_brand_store"), c("_own_brand_store"))),
        "review_reasons": _reasons(
            (lit("country_evidence"), country == 0), (lit("buyer_role_evidence"), role == 0),
            (lit("low_relevance"), c("relevance_score") < rules.review_below)),
    })
    final = ("platform", "investment", "legal", "logistics", "software", "cleanroom", "media", "agency")
    overridden = (F.size("reference_reasons") > 0) & ~F.arrays_overlap("hard_reasons", t.strings(final))
    excluded = ((F.size("hard_reasons") > 0) & ~overridden) | (industry == 0)
    importer = (c("buyer_type").isin("importer", "distributor") & (c("relevance_score") >= rules.importer_from)
                & c("_inbound") & c("_distribution") & (industry >= 2) & c("_hard_country"))
    clinic = (c("buyer_type") == "clinic_salon") & ~c("_clinic_trade")
    buyer = (c("buyer_type").isin("wholesaler", "retail_chain", "clinic_salon", "distributor")
             | (c("relevance_score") >= rules.buyer_from))
    ladder = [("excluded", excluded), ("strategic", c("_strategic")), ("reference", F.size("reference_reasons") > 0),
              ("other_country", country == 0), ("review", F.size("review_reasons") > 0), ("importer", importer),
              ("clinic", clinic), ("buyer", buyer)]
    step = F.lit("weak_role")
    for label, cond in reversed(ladder):
        step = F.when(cond, label).otherwise(step)
    graded = grouping.settle(listed.withColumn("grade_step", step), "grade_step")
    at = c("grade_step")
    missing = _reasons(
        (lit("country"), country < 3), (lit("industry"), industry < 3), (lit("buyer_role"), role < 3),
        (lit("explicit_import"), ~c("_inbound")), (lit("strong_distribution"), ~c("_distribution")))
    excluded_reasons = _reasons((lit("no_country_evidence"), country == 0),
                                (c("site_type"), F.size("hard_reasons") > 0),
                                (lit("industry_unrelated"), industry == 0))
    none = t.strings([])
    return graded.withColumns({
        "quality_decision": F.when(at.isin("importer", "buyer"), "qualified").when(
            at.isin("review", "clinic", "weak_role"), "review").otherwise(at),
        "priority": F.when(at == "importer", "A").when(at == "buyer", "B").when(
            at.isin("review", "clinic", "weak_role"), "C").otherwise(at),
        "exclusion_reasons": F.when(at == "excluded", excluded_reasons)
        .when(at == "strategic", F.array(F.when(c("_maker"), "local_maker").otherwise("local_exporter")))
        .when(at == "reference", c("reference_reasons"))
        .when(at == "other_country", F.array(lit("no_country_evidence")))
        .when(at == "review", c("review_reasons"))
        .when(at == "clinic", F.array(lit("clinic_product_trade_unproven")))
        .when(at == "weak_role", F.array(lit("core_role_unproven"))).otherwise(none),
        "grade_missing": F.when(at == "buyer", missing).otherwise(none),
        "secondary_buyer_type": F.when(c("_maker") & c("_hybrid"), "manufacturer"),
        "decision_evidence": F.array_compact(F.array(
            F.when(c("_country_named"), F.concat(lit("country: "), F.array_join("country_evidence", ", "))),
            F.when(F.size("industry_hits") > 0, F.concat(lit("industry: "), F.array_join(F.slice("industry_hits", 1, 3), ", "))),
            F.when(F.size("role_hits") > 0, F.concat(lit("role: "), F.array_join(F.slice("role_hits", 1, 3), ", "))))),
    })


def exclude_organisers(graded: DataFrame) -> DataFrame:
    """The owner of a fair is excluded whatever its pages say about exhibitors."""
    fair = (F.col("_name").rlike(rf"\b(?:{t.either(v.FAIR_NAME_PATTERNS)})\b")
            | (F.size(t.substring_hits("_identity", v.FAIR_NAVIGATION_TERMS)) >= 2))
    return graded.withColumn("_fair", fair).withColumns({
        "site_type": F.when(F.col("_fair"), "ecosystem").otherwise(F.col("site_type")),
        "quality_decision": F.when(F.col("_fair"), "excluded").otherwise(F.col("quality_decision")),
        "priority": F.when(F.col("_fair"), "excluded").otherwise(F.col("priority")),
        "exclusion_reasons": F.when(F.col("_fair"), F.array(F.lit("event_organiser"))).otherwise(F.col("exclusion_reasons")),
    })


def assess_industry(graded: DataFrame, campaign: Campaign) -> DataFrame:
    """Add the verdict of this campaign's industry group as one entry of `industry_assessments`."""
    listed = {s: [p for p in campaign.products if t.fold_python(p) in {t.fold_python(x) for x in phrases}]
              for s, phrases in _subcategory_phrases(campaign.group, campaign.subcategories).items()}
    found = F.array_distinct(F.transform("product_matches", lambda m: m["product"]))
    aliases = F.map_from_arrays(found, F.transform(found, lambda p: F.transform(
        F.filter("product_matches", lambda m: m["product"] == p), lambda m: m["alias"])))
    covered = _reasons(*[(F.lit(s), F.arrays_overlap(found, t.strings(products)))
                         for s, products in listed.items() if products])
    verdict = F.struct(
        F.lit(campaign.group).alias("major"), t.strings(campaign.subcategories).alias("subcategories"),
        F.col("target_country").alias("target_country"), F.col("priority").alias("priority"),
        F.col("quality_decision").alias("quality_decision"), found.alias("product_hits"),
        aliases.alias("product_alias_hits"), covered.alias("matched_subcategories"),
        F.when(F.size(found) > 0, "product_named").otherwise("product_unproven").alias("product_evidence_status"),
        F.array_join("decision_evidence", " | ").alias("evidence"), F.col("website").alias("source_url"))
    related = (F.col("industry_score") > 0) & (F.col("quality_decision") != "excluded")
    return graded.withColumns({"industry_assessments": F.array(verdict),
                               "matched_industry": F.when(related, F.lit(campaign.group))})


def _subcategory_phrases(group: str, subcategories) -> dict[str, list[str]]:
    phrases: dict[str, list[str]] = {s: [] for s in subcategories}
    for major, _, subcategory, _, product in catalog.taxonomy_rows():
        if major == group and subcategory in phrases:
            phrases[subcategory].append(product)
    return phrases


def drop_working_columns(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def assess_companies(companies: DataFrame, campaign: Campaign, rules: GradeRules = GradeRules(),
                     facts: DataFrame | None = None) -> DataFrame:
    """All grading steps in order."""
    classified = classify_site(score_roles(score_country(prepare(companies, facts)), campaign), campaign)
    graded = exclude_organisers(grade_companies(classified, rules))
    return drop_working_columns(assess_industry(graded, campaign)).drop(
        "aliases", "local_buyer", "dial", "tld", "continent")
