"""Evidence, site class and grade in SQL, built from the same term lists, as a check of the Spark jobs."""
from __future__ import annotations

import re

from leadloom.config import Campaign
from leadloom.functions import catalog, vocabulary as v

CAMPAIGN = Campaign(industry="cosmetics", group="화장품·스킨케어", subcategories=("스킨케어", "헤어·바디"),
                    products=("facial serum", "sheet masks", "shampoo"), countries=("Vietnam", "France"))
COUNTRIES = [catalog.country_facts(c) for c in ("Vietnam", "France", "Germany", "Spain")]


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pattern(term: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", term)


def one(column: str, term: str) -> str:
    term = term.lower()
    plain = f"contains({column}, {quote(term)})"
    if not term.isascii():
        return plain
    return f"({plain} AND regexp_matches({column}, {quote('(^|[^a-z0-9])' + pattern(term) + '([^a-z0-9]|$)')}))"


def has(column: str, terms) -> str:
    return "(" + " OR ".join(one(column, x) for x in terms) + ")"


def count(column: str, terms) -> str:
    terms = list(terms)
    return "(" + " + ".join(f"CAST({one(column, x)} AS BIGINT)" for x in terms) + ")" if terms else "0"


def contains_any(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains({column}, {quote(x.lower())})" for x in terms) + ")"


def by_country(column: str, build) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {quote(f['country'])} THEN {build(f)}" for f in COUNTRIES) + " END"


def _group(terms) -> str:
    return "(" + "|".join(pattern(x) for x in terms) + ")"


def _near(facts, before: str, after: str) -> str:
    """Any alias of the country between two patterns."""
    return "(" + " OR ".join(
        f"(contains(identity, {quote(a)}) AND regexp_matches(identity, {quote(before + pattern(a) + after)}))" for a in facts["aliases"]) + ")"


def _listed(table: dict, build) -> str:
    return by_country("target_country", lambda f: build(table[f["country"]]) if f["country"] in table else "false")


_PLACES = _group(v.PRESENCE_TERMS)
COUNTRY = f"""signals AS (SELECT *, lower(company_name) AS nm, trim(regexp_replace(lower(identity_text), '\\s+', ' ', 'g')) AS identity,
    lower(company_name) || ' ' || trim(regexp_replace(lower(identity_text), '\\s+', ' ', 'g')) AS named FROM texts),
evidence AS (SELECT *,
    {by_country('target_country', lambda f: f"website LIKE '%.{f['tld']}/'")} AS tld,
    {by_country('target_country', lambda f: f"(contains(identity, '+{f['dial']}') OR regexp_matches(identity, '\\b{f['dial']}[ .()-]?[0-9]{{7,12}}\\b'))")} AS dial,
    {by_country('target_country', lambda f: _near(f, _group(v.LOCATION_HINTS) + '[^.;|]{0,120}' + chr(92) + 'b', chr(92) + 'b'))} AS address,
    {by_country('target_country', lambda f: '(' + _near(f, '', '[^.;|]{0,100}' + _PLACES) + ' OR ' + _near(f, _PLACES + '[^.;|]{0,100}', '') + ')')} AS presence,
    {by_country('target_country', lambda f: _near(f, '', '[^.;|]{0,80}' + _group(v.LOCAL_BUSINESS_TERMS)))} AS business,
    {_listed(v.LOCAL_LANGUAGE_MARKERS, lambda x: count('identity', x) + ' >= 2')} AS lang_ok,
    {by_country('target_country', lambda f: '(' + _near(f, '(based|located|headquartered|office|operations?|distributor|importer|retailer|stores?)\\s+(in|across)\\s+', chr(92) + 'b')
      + ' OR ' + _near(f, chr(92) + 'b', '(ese)?\\s+(market|company|distributor|importer|retailer|stores?|operations?)' + chr(92) + 'b') + ')')} AS market,
    {_listed(v.CITY_MARKERS, lambda x: contains_any('identity', x))} AND regexp_matches(identity, {quote(chr(92) + 'b' + _group(v.CITY_CONTACT_WORDS) + chr(92) + 'b')}) AS city,
    {by_country('target_country', lambda f: contains_any('identity', f['aliases']))} AS alias_hit FROM signals),
judged AS (SELECT *, tld OR dial OR address OR city OR market AS hard_country, tld OR dial OR address OR city OR market OR lang_ok AS strong_country FROM evidence),
located AS (SELECT *, CAST(least(3, 2 * tld::INT + 2 * dial::INT + 2 * address::INT + 2 * city::INT + (presence AND strong_country)::INT
      + (business AND strong_country)::INT + 2 * lang_ok::INT + 2 * market::INT) AS BIGINT) AS country_score,
    array_to_string(list_filter([CASE WHEN tld THEN 'tld' END, CASE WHEN address THEN 'address' END, CASE WHEN city THEN 'city_contact' END,
      CASE WHEN dial THEN 'dial_code' END, CASE WHEN presence AND strong_country THEN 'presence' END,
      CASE WHEN business AND strong_country THEN 'local_business' END, CASE WHEN lang_ok THEN 'local_language' END,
      CASE WHEN market THEN 'market_sentence' END], lambda x: x IS NOT NULL), '|') AS country_evidence,
    CASE WHEN strong_country THEN target_country END AS verified_country FROM judged)"""

_FIXED = list(dict.fromkeys(v.BUYER_IDENTITY_TERMS + v.SUPPLIER_TERMS + v.EXTRA_IMPORT_TERMS))


def _roles(skip) -> str:
    fixed = count("named", [x for x in _FIXED if x not in skip])
    local = by_country("target_country", lambda f: count("named", [x for x in f["local_buyer"] if x not in _FIXED and x not in skip]))
    return f"({fixed} + {local})"


def _score(column: str) -> str:
    return f"CAST(CASE WHEN {column} = 0 THEN 0 WHEN {column} = 1 THEN 2 ELSE 3 END AS BIGINT)"


_TYPES = " ".join(f"WHEN {has('identity', terms)} THEN {quote(label)}" for label, terms in v.BUYER_TYPE_TERMS.items())
_GENERIC = set(v.GENERIC_DISTRIBUTION_TERMS)
ROLES = f"""counted AS (SELECT *, {count('identity', CAMPAIGN.industry_terms())} AS industry_hits, {_roles(())} AS all_roles, {_roles(_GENERIC)} AS plain_roles,
    {_roles(_GENERIC | set(v.MAKER_IGNORED_ROLE_TERMS))} AS maker_roles,
    CASE WHEN {has('nm', v.CLINIC_NAME_TERMS)} THEN 'clinic_salon' {_TYPES} ELSE 'unknown' END AS typed,
    {has('named', v.NOT_DISTRIBUTOR_TERMS)} AS denied, {count('identity', v.OWN_STORE_TERMS)} AS own_store,
    {count('identity', v.MULTIBRAND_TERMS)} AS multibrand, {count('identity', v.OWN_BRAND_TERMS)} AS own_brand FROM located),
stated AS (SELECT *, CASE WHEN denied THEN plain_roles ELSE all_roles END AS stated_roles,
    CASE WHEN denied AND typed = 'distributor' THEN 'unknown' ELSE typed END AS stated_type FROM counted),
shops AS (SELECT *, stated_roles = 0 AND industry_hits > 0 AND own_store >= 2 AND multibrand >= 1 AND own_brand = 0 AS shop FROM stated),
typed_roles AS (SELECT *, CASE WHEN shop AND stated_type = 'unknown' THEN 'retail_chain' ELSE stated_type END AS buyer_type,
    shop OR (stated_roles = 0 AND stated_type = 'clinic_salon') AS single_role FROM shops),
roles AS (SELECT *, CASE WHEN single_role THEN 1 ELSE stated_roles END AS role_hits, {_score('industry_hits')} AS industry_score,
    {_score('(CASE WHEN single_role THEN 1 ELSE stated_roles END)')} AS buyer_role_score FROM typed_roles)"""

_SERVICE = "CASE " + " ".join(f"WHEN {has('named', terms)} THEN {quote(label)}" for label, terms in v.SERVICE_IDENTITIES.items()) + " END"
SITES = f"""site_signals AS (SELECT *, industry_score > 0 AND buyer_role_score > 0 AS company,
    {count('identity', v.PLATFORM_TERMS)} >= 2 OR {count('identity', v.DIRECTORY_IDENTITY_TERMS)} >= 2
      OR ({has('named', v.AGENT_SEARCH_TERMS)} AND {count('identity', v.LISTING_ACTION_TERMS)} >= 2) AS platform,
    {has('named', v.SPAM_TERMS)} AS spam, {count('named', v.TOURISM_TERMS)} >= 2 AS tourism_terms, {has('nm', v.TOURISM_NAME_TERMS)} AS tourism_name,
    {has('nm', v.INVESTMENT_NAME_TERMS)} OR {count('named', v.INVESTMENT_TERMS)} >= 2 AS investment,
    {has('nm', v.LEGAL_NAME_TERMS)} OR {count('named', v.LEGAL_TERMS)} >= 2 AS legal,
    {count('named', v.LOGISTICS_TERMS)} AS logistics_terms, {count('named', v.EXPLICIT_LOGISTICS_TERMS)} AS explicit_logistics,
    {has('named', v.RECORD_IMPORTER_TERMS)} AS record_importer, {has('named', v.FULFILLMENT_TERMS)} AS fulfillment,
    {has('identity', v.COSMETIC_PRODUCT_TERMS)} AS cosmetic, {has('named', v.CLEANROOM_TERMS)} AS cleanroom,
    {count('named', v.STRONG_CLEANROOM_TERMS)} >= 2 AS cleanroom_strong,
    {has('nm', v.SOFTWARE_NAME_WORDS)} OR {count('named', v.SOFTWARE_TERMS)} >= 2 OR {has('nm', v.SOFTWARE_NAME_TERMS)}
      OR ({has('identity', v.SOFTWARE_CONTEXT_TERMS)} AND {count('identity', v.SOFTWARE_FEATURE_TERMS)} >= 2) AS software,
    {_SERVICE} AS service, {has('named', v.EXHIBITION_TERMS)} AS exhibition, {has('nm', v.EXHIBITION_NAME_TERMS)} AS ecosystem_name,
    {has('named', v.MEDIA_IDENTITY_TERMS)} AS media_identity, {count('named', v.STRONG_MEDIA_TERMS)} AS strong_media,
    {count('named', v.WEAK_MEDIA_TERMS)} AS weak_media, {has('named', ['market research'])} AS market_research,
    {count('identity', v.CONTENT_TERMS)} AS content, {count('named', v.AGENCY_TERMS)} AS agency_terms, {has('identity', v.PACKAGING_TERMS)} AS packaging,
    {count('named', v.MANUFACTURER_TERMS)} AS maker_terms, {has('nm', v.MANUFACTURER_NAME_TERMS)} AS maker_name, {has('named', v.OWN_FACTORY_TERMS)} AS own_factory,
    {has('named', v.CONTRACT_MAKER_TERMS)} AS contract_maker, {count('named', v.BRAND_OWNER_TERMS)} AS brand_terms,
    {has('nm', v.IMPORT_NAME_TERMS)} AS import_name, {has('identity', v.INBOUND_IMPORT_TERMS)} AS import_terms, {has('identity', v.OWN_IMPORT_TERMS)} AS own_import,
    {has('named', v.EQUIPMENT_TERMS)} AS equipment_terms, {has('named', v.STRONG_DISTRIBUTION_TERMS)} AS strong_distribution,
    {has('named', v.EXPORT_SELLER_TERMS)} AS export_terms, {has('identity', v.CLINIC_TRADE_TERMS)} AS clinic_trade FROM roles),
makers AS (SELECT *, (maker_name AND maker_terms >= 1) OR own_factory OR (maker_terms >= 3 AND contract_maker) AS maker FROM site_signals),
merged AS (SELECT *, (import_name OR import_terms) AND NOT (denied AND maker AND NOT (import_name OR own_import)) AS inbound,
    (media_identity OR strong_media >= 2 OR (market_research AND buyer_role_score = 0) OR (weak_media >= 2 AND NOT company)
      OR (content >= 2 AND NOT company)) AND NOT exhibition AND NOT (maker AND NOT media_identity) AS content_source,
    (explicit_logistics >= 2 OR (record_importer AND NOT cosmetic) OR (fulfillment AND NOT cosmetic) OR (logistics_terms >= 2 AND NOT company))
      AND NOT (maker AND (maker_name OR own_factory)) AS logistics,
    (tourism_terms AND NOT company) OR (tourism_name AND buyer_type <> 'clinic_salon') AS tourism, exhibition OR ecosystem_name AS ecosystem,
    agency_terms >= 2 OR (agency_terms >= 1 AND NOT company) AS agency, cleanroom AND (NOT cosmetic OR cleanroom_strong) AS cleanroom_service,
    equipment_terms AND NOT cosmetic AND buyer_type <> 'clinic_salon' AS equipment, own_brand > 0 AND own_store >= 2 AND NOT strong_distribution AS own_brand_store FROM makers),
decided AS (SELECT * EXCLUDE (buyer_type, buyer_role_score), denied AND maker AND NOT inbound AS denied_maker,
    strong_distribution AND NOT (denied AND maker AND NOT inbound) AS distribution,
    (trim(nm) IN ({', '.join(quote(x) for x in v.BRAND_OWNER_NAMES)}) OR brand_terms >= 2) AND NOT inbound AND multibrand = 0 AS brand_owner,
    export_terms AND NOT inbound AS export_seller, CASE WHEN denied AND maker AND NOT inbound THEN 'manufacturer' ELSE buyer_type END AS buyer_type,
    {_score('(CASE WHEN denied AND maker AND NOT inbound AND NOT single_role THEN maker_roles ELSE role_hits END)')} AS buyer_role_score FROM merged),
classes AS (SELECT *, CASE WHEN platform THEN 'platform' WHEN spam THEN 'spam' WHEN tourism THEN 'tourism' WHEN investment THEN 'investment' WHEN legal THEN 'legal'
    WHEN logistics THEN 'logistics' WHEN cleanroom_service THEN 'cleanroom' WHEN software THEN 'software' WHEN service IS NOT NULL THEN service
    WHEN ecosystem THEN 'ecosystem' WHEN media_identity THEN 'media' WHEN maker THEN 'manufacturer' WHEN brand_owner THEN 'brand_owner'
    WHEN content_source THEN 'media' WHEN agency THEN 'agency' WHEN equipment THEN 'equipment' WHEN packaging THEN 'packaging'
    WHEN export_seller THEN 'export_seller' ELSE 'official_site' END AS site_type FROM decided)"""


def _list(*pairs) -> str:
    items = ", ".join(f"CASE WHEN {cond} THEN {value if value in ('service', 'site_type') else quote(value)} END" for value, cond in pairs)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


GRADES = f"""graded AS (SELECT *, CAST(round_even(country_score / 3.0::DOUBLE * 30 + industry_score / 3.0::DOUBLE * 35 + buyer_role_score / 3.0::DOUBLE * 35, 0) AS BIGINT) AS relevance_score,
    inbound OR distribution AS hybrid FROM classes),
strategies AS (SELECT *, country_score > 0 AND industry_score > 0 AND (maker OR export_seller) AND NOT hybrid
    AND NOT (ecosystem OR packaging OR brand_owner OR own_brand_store) AS strategic FROM graded),
listed AS (SELECT *, {_list(('platform', 'platform'), ('spam', 'spam'), ('tourism', 'tourism'), ('investment', 'investment'), ('legal', 'legal'), ('logistics', 'logistics'),
      ('software', 'software'), ('service', 'service IS NOT NULL AND NOT distribution'), ('cleanroom', 'cleanroom_service'), ('equipment', 'equipment'),
      ('media', 'content_source'), ('agency', 'agency'))} AS hard,
    {_list(('ecosystem', 'ecosystem'), ('packaging', 'packaging'), ('manufacturer', 'maker AND NOT hybrid AND NOT strategic'), ('brand_owner', 'brand_owner'),
      ('export_seller', 'export_seller AND NOT hybrid AND NOT strategic'), ('own_brand_store', 'own_brand_store'))} AS reference,
    {_list(('country_evidence', 'country_score = 0'), ('buyer_role_evidence', 'buyer_role_score = 0'), ('low_relevance', 'relevance_score < 65'))} AS review FROM strategies),
stepped AS (SELECT *, CASE
    WHEN (len(hard) > 0 AND NOT (len(reference) > 0 AND NOT list_has_any(hard, ['platform', 'investment', 'legal', 'logistics', 'software', 'cleanroom', 'media', 'agency'])))
      OR industry_score = 0 THEN 'excluded'
    WHEN strategic THEN 'strategic' WHEN len(reference) > 0 THEN 'reference' WHEN country_score = 0 THEN 'other_country' WHEN len(review) > 0 THEN 'review'
    WHEN buyer_type IN ('importer', 'distributor') AND relevance_score >= 75 AND inbound AND distribution AND industry_score >= 2 AND hard_country THEN 'importer'
    WHEN buyer_type = 'clinic_salon' AND NOT clinic_trade THEN 'clinic'
    WHEN buyer_type IN ('wholesaler', 'retail_chain', 'clinic_salon', 'distributor') OR relevance_score >= 70 THEN 'buyer' ELSE 'weak_role' END AS step,
    regexp_matches(nm, {quote(chr(92) + 'b(' + '|'.join(v.FAIR_NAME_PATTERNS) + ')' + chr(92) + 'b')})
      OR {' + '.join(f"contains(identity, {quote(x)})::INT" for x in v.FAIR_NAVIGATION_TERMS)} >= 2 AS fair FROM listed),
final AS (SELECT * EXCLUDE (site_type, strategic), CASE WHEN fair THEN 'ecosystem' ELSE site_type END AS site_type,
    CASE WHEN fair THEN 'excluded' WHEN step IN ('importer', 'buyer') THEN 'qualified' WHEN step IN ('review', 'clinic', 'weak_role') THEN 'review' ELSE step END AS quality_decision,
    CASE WHEN fair THEN 'excluded' WHEN step = 'importer' THEN 'A' WHEN step = 'buyer' THEN 'B' WHEN step IN ('review', 'clinic', 'weak_role') THEN 'C' ELSE step END AS priority,
    array_to_string(CASE WHEN fair THEN ['event_organiser'] WHEN step = 'excluded' THEN excluded_for WHEN step = 'strategic' THEN [CASE WHEN maker THEN 'local_maker' ELSE 'local_exporter' END]
      WHEN step = 'reference' THEN reference WHEN step = 'other_country' THEN ['no_country_evidence'] WHEN step = 'review' THEN review
      WHEN step = 'clinic' THEN ['clinic_product_trade_unproven'] WHEN step = 'weak_role' THEN ['core_role_unproven'] ELSE [] END, '|') AS exclusion_reasons
  FROM (SELECT *, {_list(('no_country_evidence', 'country_score = 0'), ('site_type', 'len(hard) > 0'), ('industry_unrelated', 'industry_score = 0'))} AS excluded_for FROM stepped))"""
