"""Every job bound to the given tables, with the same question in SQL where SQL can ask it."""
from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from leadloom.config import Campaign, CreatorSearch, EmailRules, Product, Sender
from leadloom.functions import catalog, grouping, numbers, text as t, urls, vocabulary
from leadloom.operators import companies as co, contacts as ct, creators as cr, discovery as di, grading as gr
from leadloom.operators import names as nm, pages as pg, planning as pl, reports as rp
from leadloom.plans import buyer, rounds
from leadloom.sources import dimensions, readers, sinks, stages
from leadloom.streaming import incremental, refill
from leadloom.workload import tables as w, verdict_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return register


def flat(df: DataFrame, *columns) -> DataFrame:
    """Plain columns for comparison: whole numbers as long, lists joined by ``|``."""
    df = df.select(*columns) if columns else df
    out: list[Column] = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        out.append(c.alias(field.name))
    return df.select(*out)


def scratch(spark: SparkSession) -> str:
    """New folder for tables a query writes, in the shared folder of the cluster where one is named."""
    return f"{grouping.shared_dir(spark)}/leadloom-{os.urandom(6).hex()}"


RULES = w.RULES
NO_BLOCK = EmailRules(blocked_parts=(), placeholder_hosts=("invalid.example",))
CAMPAIGN = Campaign(industry="cosmetics", group="화장품·스킨케어", subcategories=("스킨케어", "헤어·바디"),
                    products=("facial serum", "sheet masks", "shampoo"), countries=("Vietnam", "France"))

# ------------------------------------------------------------------ pages and hosts


@query("""WITH p AS (SELECT url, split_part(regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\\.', ''), ':', 1) AS host,
    lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)) AS pth FROM pages)
  SELECT regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS domain, count(*) AS pages, count(DISTINCT host) AS hosts,
    count(DISTINCT pth) AS paths, min(url) AS first_url, max(url) AS last_url FROM p GROUP BY 1""")
def host_rollup(spark, sf):
    return pg.host_rollup(w.table(spark, sf, "pages"))


@query(f"""WITH k AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS page_key FROM pages)
  SELECT page_key, min(url) AS url FROM k GROUP BY page_key""")
def page_dedup(spark, sf):
    return pg.dedup_pages(w.table(spark, sf, "pages").select("url")).select("page_key", "url")


@query(f"""WITH h AS (SELECT page_id, url, {w.HOST} AS host FROM pages),
  listed AS (SELECT DISTINCT host FROM h WHERE url LIKE 'http://%'),
  bad AS (SELECT DISTINCT h.host FROM (SELECT DISTINCT host FROM h) h JOIN listed l ON h.host = l.host OR h.host LIKE '%.' || l.host)
  SELECT page_id, url FROM h WHERE host NOT IN (SELECT host FROM bad)""")
def blocked_hosts_dropped(spark, sf):
    pages = w.table(spark, sf, "pages").select("page_id", "url")
    blocked = pages.where(F.col("url").startswith("http://")).select(urls.host("url").alias("host")).distinct()
    return di.drop_blocked_hosts(pages, blocked, mode="host")


_ENTITIES = [("&middot;", "·"), ("&copy;", "©"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def _plain_sql(column: str) -> str:
    for entity, text in _ENTITIES:
        column = f"replace({column}, {w.quote(entity)}, {w.quote(text)})"
    return f"trim(regexp_replace({column}, '\\s+', ' ', 'g'))"


@query(f"""WITH v AS (SELECT url, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
      '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g') AS h FROM pages)
  SELECT url, {_plain_sql("regexp_replace(h, '(?s)<[!/?a-zA-Z][^>]*>', ' ', 'g')")} AS text,
    {_plain_sql("regexp_extract(h, '(?s)<title>(.*?)</title>', 1)")} AS title FROM v""")
def page_texts(spark, sf):
    return pg.extract_pages(readers.read_pages(spark, f"{sf}/pages.parquet").select("url", "html")).select("url", "text", "title")


@query(f"""WITH v AS (SELECT url, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs,
      regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS labels FROM pages),
  e AS (SELECT url, unnest(range(len(hrefs))) AS position, hrefs, labels FROM v)
  SELECT url, position, hrefs[position + 1] AS href, labels[position + 1] AS label,
    regexp_extract(url, '^(https?://[^/]+)', 1) || hrefs[position + 1] AS target_url, true AS same_host FROM e""")
def page_links(spark, sf):
    return flat(pg.link_edges(pg.extract_pages(w.table(spark, sf, "pages").select("url", "html"))))


_DOC_URL = {"en": "/contact/", "fr": "/about/", "de": "/news/", "es": "/partner/"}


def _documents_as_pages(spark, sf) -> DataFrame:
    """Documents as extracted pages of their source; pages add their own text."""
    docs = w.table(spark, sf, "documents")
    no_links = F.array().cast(pg.LINK)
    url = F.concat(F.lit("https://"), "source", F.lit(".com"), w.by_value(F.col("lang"), _DOC_URL), F.col("doc_id").cast("string"))
    return docs.select(url.alias("url"), "text", no_links.alias("anchors")).withColumns({
        "host": urls.host("url"), "domain": urls.registrable_domain("url"),
        "emails": pg.page_emails(F.col("text"), F.col("anchors"), NO_BLOCK), "phones": pg.phone_candidates(F.col("text"))})


_HARVEST = f"""docs AS (SELECT 'https://' || source || '.com' || {w.sql_case('lang', _DOC_URL)} || doc_id AS url, source || '.com' AS domain, text, lang FROM documents),
found AS (SELECT url, domain, lang, unnest(list_distinct(list_transform(
      regexp_extract_all(text, '(?i)[A-Z0-9.!#$%&''*+/=?^_`{{|}}~-]+@[^\\s<>()\\[\\]{{}}",;:!?/=\\\\'']+'),
      lambda x: lower(regexp_replace(regexp_replace(x, '^[ \\t<>"'']+', ''), '[.,;:]+$', ''))))) AS email FROM docs),
harvest AS (SELECT url, domain, email, CASE lang WHEN 'en' THEN 4 WHEN 'fr' THEN 2 WHEN 'de' THEN 0 ELSE 5 END AS source_priority FROM found
  WHERE regexp_matches(email, '^[a-z0-9!#$%&''*+/=?^_`{{|}}~-]+(\\.[a-z0-9!#$%&''*+/=?^_`{{|}}~-]+)*@[a-z0-9]([a-z0-9-]*[a-z0-9])?(\\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)*\\.([a-z]{{2,24}}|xn--[a-z0-9-]+)$')
    AND length(split_part(email, '@', 1)) <= 64 AND length(email) <= 254
    AND NOT regexp_matches(email, '\\.(local|localhost|internal|invalid|test|example|js|css|json|html|png|jpg|jpeg|gif|svg|webp|pdf|min|bundle)$'))"""


@query(f"WITH {_HARVEST} SELECT url, domain, email, CAST(source_priority AS BIGINT) AS source_priority FROM harvest")
def email_harvest(spark, sf):
    rows = pg.harvest_emails(_documents_as_pages(spark, sf), NO_BLOCK)
    return flat(rows, "url", "domain", "email", "source_priority")


@query(f"""WITH {_HARVEST}, ranked AS (SELECT *, row_number() OVER (PARTITION BY domain, email ORDER BY source_priority DESC, url) AS r,
    count(*) OVER (PARTITION BY domain, email) AS mentions FROM harvest)
  SELECT domain, email, url AS email_source_url, CAST(source_priority AS BIGINT) AS source_priority, mentions FROM ranked WHERE r = 1""")
def email_best_source(spark, sf):
    return flat(pg.best_sources(pg.harvest_emails(_documents_as_pages(spark, sf), NO_BLOCK)))


_US = next(r for r in catalog.country_rows() if r["country"] == "United States")


def _hint_sql(column: str, terms, last: bool) -> str:
    """Start of the last or first of any term in ``column``, from 1; 0 when none occurs."""
    listed = f"[{', '.join(map(w.quote, terms))}]"
    if last:
        return f"list_max(list_transform({listed}, lambda h: CASE WHEN instr(reverse({column}), reverse(h)) > 0 THEN length({column}) - instr(reverse({column}), reverse(h)) - length(h) + 2 ELSE 0 END))"
    return f"coalesce(list_min(list_filter(list_transform({listed}, lambda h: instr({column}, h)), lambda x: x > 0)), 0)"


_PHONE_SQL = r"\+?[0-9][0-9\s().-]{7,}[0-9]"


@query(f"""WITH v AS (SELECT url, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
      '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g') AS h FROM pages),
  src AS (SELECT url, regexp_extract({w.HOST}, '([^.]+\\.[^.]+)$', 1) AS domain, {_plain_sql("regexp_replace(h, '(?s)<[!/?a-zA-Z][^>]*>', ' ', 'g')")} AS text FROM v
    UNION ALL SELECT 'https://' || source || '.com' || {w.sql_case('lang', _DOC_URL)} || doc_id, source || '.com', text FROM documents),
  n AS (SELECT row_number() OVER () AS k, *, regexp_extract_all(text, '{_PHONE_SQL}') AS ms, regexp_split_to_array(text, '{_PHONE_SQL}') AS gs FROM src WHERE regexp_matches(text, '{_PHONE_SQL}')),
  e AS (SELECT k, url, domain, text, ms, list_transform(ms, lambda m: length(m)) AS ml, list_transform(gs, lambda g: length(g)) AS gl, unnest(range(1, len(ms) + 1)) AS i FROM n),
  f AS (SELECT *, ms[i] AS raw, CAST(list_sum(gl[1:i]) + coalesce(list_sum(ml[1:i - 1]), 0) AS BIGINT) AS b FROM e),
  c AS (SELECT *, lower(substr(text, CAST(greatest(1, b - 99) AS BIGINT), CAST(least(100, b) AS BIGINT))) AS before, lower(substr(text, CAST(b + length(raw) + 1 AS BIGINT), 100)) AS rest FROM f),
  j AS (SELECT *, {_hint_sql('before', vocabulary.PHONE_HINTS, True)} AS pb, {_hint_sql('before', vocabulary.NON_PHONE_HINTS, True)} AS ob,
      {_hint_sql('rest', vocabulary.PHONE_HINTS, False)} AS pa, {_hint_sql('rest', vocabulary.NON_PHONE_HINTS, False)} AS oa FROM c),
  r AS (SELECT k, url, domain, raw, min(CASE WHEN pb > 0 OR pa > 0 THEN 0 ELSE 1 END * 1000000000 + i) AS place FROM j WHERE NOT (ob > pb OR (oa > 0 AND (pa = 0 OR oa < pa))) GROUP BY k, url, domain, raw),
  p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY place) - 1 AS position FROM r QUALIFY position < 10),
  t AS (SELECT *, regexp_replace(regexp_replace(trim(trim(regexp_replace(raw, '\\s+', ' ', 'g')), ' .-()'), '^\\+([0-9]+)\\)\\s*', '+\\1 '), '^([0-9]+)\\)\\s*', '\\1 ') AS value FROM p)
  SELECT url, domain, 'United States' AS country, position, raw AS raw_phone, CASE WHEN length(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN 9 AND 15
    AND (starts_with(value, '+{_US["dial"]}') OR starts_with(regexp_replace(value, '[^0-9]', '', 'g'), '{_US["dial"]}') OR starts_with(regexp_replace(value, '[^0-9]', '', 'g'), '0')) THEN value END AS phone FROM t""")
def phone_harvest(spark, sf):
    pages = pg.extract_pages(w.table(spark, sf, "pages").select("url", "html", F.lit("United States").alias("country")))
    docs = _documents_as_pages(spark, sf).withColumn("country", F.lit("United States"))
    return flat(pg.harvest_phones(pages.select("url", "domain", "country", "phones").unionByName(
        docs.select("url", "domain", "country", "phones"))))


@query()
def company_names(spark, sf):
    pages = pg.extract_pages(w.table(spark, sf, "pages").select("url", "html"))
    return nm.with_brand_name(nm.elect_company_name(pages.select("url", "host", "title", "site_name", "jsonld_name", "text"))).select(
        "url", "host", "company_name", "brand_name")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), e AS (SELECT doc_id, ls, unnest(range(len(ls))) AS line FROM l),
  n AS (SELECT doc_id, line, trim(regexp_replace(ls[line + 1], '\\s+', ' ', 'g')) AS name FROM e)
  SELECT doc_id, line, CASE WHEN name = '' THEN 'name_missing'
    WHEN length(name) > 150 OR len(list_filter(string_split(name, ' '), lambda x: x <> '')) > 25 THEN 'name_too_long' END AS reason FROM n""")
def name_review(spark, sf):
    """Every line of every text as a company name."""
    lines = w.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "name"))
    return flat(lines.select("doc_id", "line", nm.name_review_reason(F.col("name")).alias("reason")))


@query(f"""WITH d AS (SELECT doc_id, trim(trim(regexp_replace(regexp_replace(text, '(?s)<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), ' ·|-') AS x FROM documents),
  s AS (SELECT doc_id, string_split(regexp_replace(x, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM d),
  u AS (SELECT doc_id, ss, list_filter(ss, lambda y: length(y) >= 35 AND NOT regexp_matches(y, '(?i){'|'.join(vocabulary.SUMMARY_SKIPPED)}')) AS us FROM s)
  SELECT doc_id, left(array_to_string(CASE WHEN len(us) > 0 THEN us[1:2] ELSE ss[1:2] END, ' '), 360) AS summary FROM u""")
def description_summaries(spark, sf):
    return w.table(spark, sf, "documents").select("doc_id", pg.summarize_text(F.col("text")).alias("summary"))


@query(f"""WITH {w.RECORDS}, c AS (SELECT DISTINCT website AS domain, quality_decision, k % 2 = 0 AS own, k % 3 AS m FROM records WHERE website <> '' AND record_id LIKE '1-%'),
  budget AS (SELECT domain, max(CASE WHEN own AND quality_decision = 'reference' AND m = 0 THEN 1 WHEN own AND quality_decision = 'reference' THEN 0 ELSE 3 END) AS b FROM c GROUP BY domain),
  links AS (SELECT website AS domain, email_source_url AS url, min(arrival) AS position FROM records WHERE email_source_url IS NOT NULL AND website <> '' GROUP BY ALL),
  ranked AS (SELECT *, {w.SOURCE_RANK.replace('email_source_url', 'url')} AS source_priority FROM links
    QUALIFY row_number() OVER (PARTITION BY domain ORDER BY {w.SOURCE_RANK.replace('email_source_url', 'url')} DESC, position, url) <= 3),
  placed AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY source_priority DESC, position, url) AS place FROM ranked)
  SELECT p.domain, url, place, CAST(source_priority AS BIGINT) AS source_priority, CAST(b AS BIGINT) AS page_budget
  FROM placed p JOIN budget USING (domain) WHERE place <= b""")
def pages_to_visit(spark, sf):
    """Links of all records with a site; suppliers stand for the companies that have a budget, customers only add links."""
    rows = w.records(spark, sf).where(F.col("website") != "").withColumn("k", F.split_part("record_id", F.lit("-"), F.lit(2)).cast("long"))
    links = rows.where(F.col("email_source_url").isNotNull()).select(
        F.col("website").alias("domain"), F.col("email_source_url").alias("url"), F.col("arrival").alias("position"))
    own, general = F.col("k") % 2 == 0, F.col("k") % 3 == 0
    settled = own & (F.col("quality_decision") == "reference")
    order = F.when(settled & general, 1).when(settled, 0).otherwise(3)
    companies = (rows.where(F.col("record_id").startswith("1-")).groupBy("website").agg(F.max_by(F.struct(
        F.when(F.col("quality_decision") == "reference", "qualified").otherwise("review").alias("quality_decision"),
        own.alias("has_official_email"), F.when(general, "general").otherwise("b2b_sales").alias("email_purpose")), order).alias("c"))
        .select(F.col("website").alias("domain"), "c.*"))
    return flat(pg.pages_to_visit(companies, links), "domain", "url", "place", "source_priority", "page_budget")


# ------------------------------------------------------------------ search results


def _filtered(spark, sf) -> DataFrame:
    return di.prefilter_results(w.hits(spark, sf), RULES)


@query(f"""WITH {w.FILTERED} SELECT arrival, domain, reject_reason,
    CASE WHEN reject_reason IS NULL THEN points END AS candidate_score FROM filtered""")
def search_prefilter(spark, sf):
    return flat(_filtered(spark, sf), "arrival", "domain", "reject_reason", "candidate_score")


@query(f"WITH {w.FILTERED} SELECT reject_reason, count(*) AS results FROM filtered WHERE reject_reason IS NOT NULL GROUP BY 1")
def reject_reasons(spark, sf):
    return rp.reject_report(_filtered(spark, sf))


_STATS = """stats AS (SELECT country, keyword, count(DISTINCT query) AS calls, count(*) AS raw_results,
    count(*) FILTER (WHERE reject_reason IS NULL) AS accepted_results,
    count(*) FILTER (WHERE reject_reason IS NOT NULL) AS rejected_results FROM filtered GROUP BY 1, 2)"""


@query(f"""WITH {w.FILTERED}, {_STATS} SELECT country, keyword, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(raw_results) AS BIGINT) AS raw_results,
    CAST(sum(accepted_results) AS BIGINT) AS accepted_results, CAST(sum(rejected_results) AS BIGINT) AS rejected_results
  FROM stats GROUP BY GROUPING SETS ((country, keyword), (keyword))""")
def keyword_counters(spark, sf):
    return rp.keyword_stats(_filtered(spark, sf))


@query(f"""WITH {w.FILTERED}, {_STATS}, planned AS (SELECT n_name AS country, source AS keyword, count(*) AS position FROM documents
      JOIN nation ON n_nationkey = doc_id % 25 GROUP BY 1, 2
    UNION ALL SELECT country, keyword, 0 FROM hits WHERE url LIKE 'http:%' GROUP BY 1, 2)
  SELECT country, keyword, position, coalesce(calls, 0) AS calls, coalesce(raw_results, 0) AS raw_results,
    coalesce(accepted_results, 0) AS accepted_results, coalesce(rejected_results, 0) AS rejected_results,
    CASE WHEN calls IS NULL THEN 'not_run' ELSE 'run' END AS state FROM planned LEFT JOIN stats USING (country, keyword)""")
def keyword_coverage(spark, sf):
    nations = w.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("_k"), F.col("n_name").alias("country"))
    named = (w.table(spark, sf, "documents").withColumn("_k", F.col("doc_id") % 25).join(F.broadcast(nations), "_k")  # 25 nations
             .groupBy("country", F.col("source").alias("keyword")).agg(F.count("*").alias("position")))
    seen = (w.hits(spark, sf).where(F.col("url").startswith("http:")).select("country", "keyword").distinct()
            .withColumn("position", F.lit(0).cast("long")))
    return rp.keyword_coverage(named.unionByName(seen), rp.keyword_stats(_filtered(spark, sf)))


@query(f"""WITH {w.POOL} SELECT country, domain, url, keyword, query, candidate_score, arrival, discovery_source, alternate_urls, hits FROM pool""")
def candidate_pool(spark, sf):
    pool = di.pool_candidates(di.accepted(_filtered(spark, sf)))
    return flat(pool, "country", "domain", "url", "keyword", "query", "candidate_score", "arrival", "discovery_source", "alternate_urls", "hits")


@query(f"""WITH {w.POOL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY candidate_score DESC,
      contains(discovery_source, 'official') DESC, arrival, domain) AS country_rank FROM pool)
  SELECT country, domain, candidate_score, country_rank FROM ranked WHERE country_rank <= 12 ORDER BY country, country_rank LIMIT 40""")
def top_candidates(spark, sf):
    pool = di.pool_candidates(di.accepted(_filtered(spark, sf)))
    return flat(di.top_candidates(pool, 12, 40), "country", "domain", "candidate_score", "country_rank")


@query(f"""WITH {w.POOL}, done AS (SELECT DISTINCT domain || '|' || country AS key FROM filtered WHERE profile = 'local_market'
    UNION SELECT DISTINCT domain FROM filtered WHERE reject_reason = 'non_company_path')
  SELECT country, domain, candidate_score FROM pool WHERE domain || '|' || country NOT IN (SELECT key FROM done)
    AND domain NOT IN (SELECT key FROM done)""")
def pending_candidates(spark, sf):
    filtered = _filtered(spark, sf)
    pairs = filtered.where(F.col("profile") == "local_market").select(F.concat_ws("|", "domain", "country").alias("key"))
    old = filtered.where(F.col("reject_reason") == "non_company_path").select(F.col("domain").alias("key"))
    pool = di.pool_candidates(di.accepted(filtered))
    return flat(di.pending_candidates(pool, pairs.unionByName(old)), "country", "domain", "candidate_score")


@query(f"""WITH {w.HITS}, p AS (SELECT arrival, lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)) AS pth, lower(title) AS tl,
      lower(title || ' ' || content) AS txt FROM hits)
  SELECT arrival, {w.contains_any('txt', RULES.industry_terms)} AND ({w.count_contains('txt', ('ungen', 'blend', 'thinha'))} >= 2
    OR {w.contains_any('pth', ('/fr/', '/de/9'))} OR {w.contains_any('tl', ('###', 'queque'))}) AS is_ecosystem_source FROM p""")
def ecosystem_sources(spark, sf):
    hits = w.hits(spark, sf).withColumn("profile", F.lit("ecosystem"))
    return di.mark_ecosystem_sources(hits, RULES, ("ungen", "blend", "thinha"), ("/fr/", "/de/9"), ("###", "queque")).select(
        "arrival", "is_ecosystem_source")


@query(f"""WITH {w.COMPANY_TEXTS}, c AS (SELECT doc_id, lower(identity_text) AS about, target_country, website FROM texts),
  readable AS (SELECT DISTINCT 'src' || page_id AS s FROM pages WHERE contains(html, '</html>'))
  SELECT doc_id FROM c WHERE regexp_extract(website, 'www\\.(src[0-9]+)', 1) NOT IN (SELECT s FROM readable)
    AND NOT ({{platform}} AND NOT {{strong}}) AND {{industry}} AND {{buyer}}
    AND (({{alias}}) OR regexp_matches(website, '\\.(vn|fr|es)/$'))""".format(
        platform=verdict_sql.contains_any("about", verdict_sql.v.PLATFORM_TERMS), strong=verdict_sql.contains_any("about", verdict_sql.v.STRONG_BUYER_TERMS),
        industry=verdict_sql.has("about", CAMPAIGN.industry_terms()),
        buyer=verdict_sql.has("about", dict.fromkeys(verdict_sql.v.BUYER_TERMS + verdict_sql.v.STRONG_BUYER_TERMS)),
        alias=verdict_sql.by_country("target_country", lambda f: verdict_sql.has("about", f["aliases"]))))
def access_holds(spark, sf):
    texts = w.company_texts(spark, sf)
    candidates = texts.select(
        "doc_id", F.col("target_country").alias("country"), urls.registrable_domain("website").alias("domain"),
        F.col("website").alias("url"), F.col("website").alias("root_url"), F.col("identity_text").alias("description"),
        F.lit("").alias("title"), F.col("doc_id").cast("string").alias("keyword"), F.lit("").alias("query"),
        F.array(F.lit("official")).alias("discovery_source"), F.col("website").alias("discovery_url"), F.lit(1).alias("candidate_score"))
    readable = w.table(spark, sf, "pages").where(F.col("html").contains("</html>")).select(  # pages that were read to their end
        F.explode(F.array(*[F.concat(F.lit("src"), F.col("page_id").cast("string"), F.lit(x)) for x in (".vn", ".fr", ".com", ".es")])).alias("domain"))
    return di.hold_failed_candidates(candidates, readable, CAMPAIGN).select(F.col("original_keyword").cast("long").alias("doc_id"))


@query("""SELECT source AS website, lang AS target_country, arg_max(n_chars, doc_id) AS n_chars, max(doc_id) AS arrival, min(doc_id) AS first_arrival
  FROM documents GROUP BY 1, 2""")
def latest_holds(spark, sf):
    docs = w.table(spark, sf, "documents").select(F.col("source").alias("website"), F.col("lang").alias("target_country"),
                                                  "n_chars", F.col("doc_id").alias("arrival"))
    return di.latest_holds(docs)


# ------------------------------------------------------------------ evidence, classes and grades


def _texts(spark, sf) -> DataFrame:
    return w.company_texts(spark, sf)


def _graded(spark, sf) -> DataFrame:
    return gr.assess_companies(_texts(spark, sf), CAMPAIGN)


@query(f"WITH {w.COMPANY_TEXTS}, {verdict_sql.COUNTRY} SELECT doc_id, country_score, country_evidence, verified_country FROM located")
def country_evidence(spark, sf):
    return flat(gr.score_country(gr.prepare(_texts(spark, sf))), "doc_id", "country_score", "country_evidence", "verified_country")


@query(f"WITH {w.COMPANY_TEXTS}, {verdict_sql.COUNTRY}, {verdict_sql.ROLES} SELECT doc_id, industry_score, buyer_role_score, buyer_type FROM roles")
def role_evidence(spark, sf):
    scored = gr.score_roles(gr.score_country(gr.prepare(_texts(spark, sf))), CAMPAIGN)
    return flat(scored, "doc_id", "industry_score", "buyer_role_score", "buyer_type")


@query(f"WITH {w.COMPANY_TEXTS}, {verdict_sql.COUNTRY}, {verdict_sql.ROLES}, {verdict_sql.SITES} SELECT doc_id, site_type, buyer_type FROM classes")
def site_classes(spark, sf):
    scored = gr.score_roles(gr.score_country(gr.prepare(_texts(spark, sf))), CAMPAIGN)
    return flat(gr.classify_site(scored, CAMPAIGN), "doc_id", "site_type", "buyer_type")


@query(f"""WITH {w.COMPANY_TEXTS}, {verdict_sql.COUNTRY}, {verdict_sql.ROLES}, {verdict_sql.SITES}, {verdict_sql.GRADES}
  SELECT doc_id, site_type, relevance_score, quality_decision, priority, exclusion_reasons FROM final""")
def company_grades(spark, sf):
    return flat(_graded(spark, sf), "doc_id", "site_type", "relevance_score", "quality_decision", "priority", "exclusion_reasons")


@query(f"""WITH {w.COMPANY_TEXTS}, {verdict_sql.COUNTRY}, {verdict_sql.ROLES}, {verdict_sql.SITES}, {verdict_sql.GRADES}
  SELECT doc_id, company_name, '화장품·스킨케어' AS major, priority, quality_decision,
    'product_unproven' AS product_evidence_status, '' AS product_hits FROM final""")
def industry_verdicts(spark, sf):
    graded = _graded(spark, sf).withColumns({"company_id": F.col("doc_id").cast("string"), "brand_name": F.lit("")})
    return rp.industry_verdicts(graded).select(
        F.col("company_id").cast("long").alias("doc_id"), "company_name", "major", "priority", "quality_decision",
        "product_evidence_status", "product_hits")


PHRASES = ("Thanédble", "and the", "de la", "und der", "nicht", "the of masks", "ñóiell", "est à")
_FOLDED = [(p, t.fold_python(a)) for p in PHRASES for a in ([p, p[:-1]] if p.endswith("masks") else [p])]
_WORDS_SQL = "' ' || trim(regexp_replace(strip_accents(replace(lower({c}), 'đ', 'd')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) || ' '"


@query(f"""WITH d AS (SELECT doc_id, {_WORDS_SQL.format(c='text')} AS x FROM documents), p AS (SELECT * FROM (VALUES
    {', '.join(f"({w.quote(p)}, {w.quote(f' {a} ')}, {w.quote(a)})" for p, a in _FOLDED)}) AS p(product, a, alias))
  SELECT doc_id, product, CAST(count(*) AS BIGINT) AS aliases FROM d JOIN p ON contains(x, a) GROUP BY ALL""")
def product_matches(spark, sf):
    found = gr.match_products(w.table(spark, sf, "documents"), PHRASES)
    return found.select("doc_id", "product", F.size("aliases").cast("long").alias("aliases"))


# ------------------------------------------------------------------ company records


@query(f"WITH {w.OWNERS} SELECT record_id, owner_id FROM owned")
def company_owners(spark, sf):
    return co.assign_owners(w.records(spark, sf)).select("record_id", "owner_id")


@query(f"""WITH {w.OWNERS}, g AS (SELECT owner_id, count(*) AS merged_records, string_agg(DISTINCT target_country, '|' ORDER BY target_country) AS discovered_countries,
    arg_min(CASE WHEN quality_decision <> 'excluded' OR record_id = owner_id THEN coalesce(company_email, extra) END,
            CASE WHEN quality_decision <> 'excluded' OR record_id = owner_id THEN r END) AS offered FROM owned GROUP BY 1)
  SELECT g.owner_id, o.company_id, o.priority, o.target_country, o.website, o.candidate_score,
    coalesce(o.company_email, g.offered) AS company_email, g.discovered_countries, g.merged_records
  FROM g JOIN owned o ON o.record_id = g.owner_id""")
def merged_companies(spark, sf):
    return flat(co.dedup_companies(w.records(spark, sf)), "owner_id", "company_id", "priority", "target_country", "website",
                "candidate_score", "company_email", "discovered_countries", "merged_records")


@query(f"""WITH {w.OWNERS} SELECT DISTINCT owner_id, target_country, verified_country, country_score, quality_decision, priority FROM owned""")
def company_assessments(spark, sf):
    return flat(co.company_assessments(co.assign_owners(w.records(spark, sf))))


@query(f"""WITH {w.VARIANTS} SELECT record_id, company_email, email_source_url, email_status, email_grade, position,
    CAST(source_priority AS BIGINT) AS source_priority FROM placed""")
def contact_variants(spark, sf):
    return flat(co.contact_variants(w.records(spark, sf)), "record_id", "company_email", "email_source_url", "email_status",
                "email_grade", "position", "source_priority")


_LOCALS = ("sales", "info", "hr", "export", "support", "partner", "no-reply")


def _sources(spark, sf) -> DataFrame:
    """Addresses of customers as harvested addresses of shops."""
    k = F.col("c_custkey")
    shop = F.concat(F.lit("shop"), F.floor(k / 6).cast("string"), F.lit(".com"))
    mail = F.concat(w.by_value(k % 7, dict(enumerate(_LOCALS))), F.lit("@"), F.when(k % 5 < 2, F.lit("group.net")).otherwise(shop))
    priority = w.by_value(k % 4, {0: 5, 1: 4, 2: 1, 3: 0})
    return w.table(spark, sf, "customer").select(shop.alias("domain"), mail.alias("email"), priority.cast("int").alias("source_priority"),
                                                 F.concat(F.lit("https://"), shop, F.lit("/p"), k.cast("string")).alias("email_source_url"))


_CHOICE_USE = """CASE l WHEN 'sales' THEN 'b2b_sales' WHEN 'info' THEN 'general' WHEN 'hr' THEN 'recruiting' WHEN 'export' THEN 'b2b_sales'
  WHEN 'support' THEN 'customer_service' WHEN 'partner' THEN 'b2b_partnership' ELSE 'unknown' END"""


@query(f"""WITH s AS (SELECT 'shop' || (c_custkey // 6) || '.com' AS domain, CASE c_custkey % 7 {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_LOCALS))} END AS l,
      CASE WHEN c_custkey % 5 < 2 THEN 'group.net' ELSE 'shop' || (c_custkey // 6) || '.com' END AS h,
      CASE c_custkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 1 ELSE 0 END AS p FROM customer),
  r AS (SELECT *, {_CHOICE_USE} AS use, row_number() OVER (PARTITION BY domain, h = domain ORDER BY (l = 'no-reply'),
      CASE WHEN l IN ('sales', 'export', 'partner') THEN 0 WHEN l = 'info' THEN 2 ELSE 3 END, -p, l || '@' || h) AS n FROM s),
  b AS (SELECT domain, max(CASE WHEN h = domain THEN l || '@' || h END) AS official, max(CASE WHEN h = domain THEN use END) AS official_use,
      max(CASE WHEN h <> domain THEN l || '@' || h END) AS related, max(CASE WHEN h <> domain THEN use END) AS related_use,
      max(CASE WHEN h <> domain THEN p END) AS related_p FROM r WHERE n = 1 GROUP BY 1),
  c AS (SELECT *, CASE WHEN official IS NULL OR coalesce(related_p >= 5 AND related_use LIKE 'b2b%' AND official_use NOT LIKE 'b2b%', false)
      THEN related ELSE official END AS company_email FROM b)
  SELECT domain, company_email, CASE WHEN company_email = official THEN official_use ELSE related_use END AS email_purpose,
    CASE WHEN company_email LIKE 'no-reply%' THEN 'unfit' WHEN company_email = official THEN 'A' ELSE 'B' END AS email_grade,
    CASE WHEN company_email = official THEN 'same_domain' ELSE 'cross_domain' END AS email_domain_status,
    official IS NOT NULL AS has_official_email FROM c""")
def chosen_contacts(spark, sf):
    return co.choose_contact(_sources(spark, sf)).select(
        "domain", "company_email", "email_purpose", "email_grade", "email_domain_status", "has_official_email")


@query(f"""WITH {w.RECORDS}, r AS (SELECT *, CAST(relevance_score AS VARCHAR) || '.com' AS domain FROM records),
  x AS (SELECT CAST(s_suppkey % 101 AS VARCHAR) || '.com' AS domain, 'team' || s_suppkey || '@mail.com' AS value,
      s_suppkey % 2 = 0 AS generic, s_suppkey % 90 AS confidence,
      CASE s_suppkey % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'invalid' WHEN 2 THEN 'risky' END AS st FROM supplier),
  best AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY domain ORDER BY generic DESC, confidence DESC, value) = 1)
  SELECT record_id, CASE WHEN f THEN value ELSE company_email END AS company_email,
    CASE WHEN f THEN CASE st WHEN 'valid' THEN 'verified' WHEN 'invalid' THEN 'external' WHEN 'risky' THEN 'needs_check' ELSE 'external' END ELSE email_status END AS email_status,
    CASE WHEN f THEN CASE st WHEN 'invalid' THEN 'excluded' WHEN 'risky' THEN 'C' ELSE 'B' END ELSE email_grade END AS email_grade
  FROM (SELECT r.*, value, st, coalesce(quality_decision = 'qualified' AND company_email IS NULL AND value IS NOT NULL, false) AS f FROM r LEFT JOIN best USING (domain))""")
def enriched_contacts(spark, sf):
    """Every record, enriched where it is a qualified company without an address and its site has an outside contact."""
    companies = w.records(spark, sf).withColumn(
        "domain", F.concat(F.col("relevance_score").cast("string"), F.lit(".com")))
    k = F.col("s_suppkey")
    external = w.table(spark, sf, "supplier").select(
        F.concat((k % 101).cast("string"), F.lit(".com")).alias("domain"), F.concat(F.lit("team"), k.cast("string"), F.lit("@mail.com")).alias("value"),
        F.when(k % 2 == 0, "generic").otherwise("personal").alias("type"), (k % 90).cast("int").alias("confidence"),
        F.lit("Kim").alias("first_name"), F.lit(None).cast("string").alias("last_name"), F.lit("Buyer").alias("position"),
        F.lit("https://x.com/").alias("source_uri"), w.by_value(k % 4, {0: "valid", 1: "invalid", 2: "risky"}).alias("verify_status"),
        F.lit(None).cast("int").alias("verify_score"), F.lit(False).alias("accept_all"))
    return co.enrich_contacts(companies, external).select("record_id", "company_email", "email_status", "email_grade")


# ------------------------------------------------------------------ contacts

_ELIGIBLE = """ok AS (SELECT r.company_id, r.company_name, r.priority, r.quality_decision, r.target_country, r.verified_country, r.industry_score,
    r.buyer_role_score, p.* EXCLUDE (record_id), r.arrival FROM placed p JOIN records r USING (record_id)
  WHERE (priority IN ('A', 'B', 'C', 'strategic') OR (quality_decision = 'other_country' AND industry_score > 0)
      OR (quality_decision = 'reference' AND industry_score > 0 AND p.email_status = 'official'))
    AND p.email_status IN ('official', 'verified', 'external', 'needs_check') AND quality_decision <> 'excluded')"""
_LIST_RANK = "CASE priority WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2 WHEN 'strategic' THEN 3 WHEN 'other_country' THEN 4 WHEN 'reference' THEN 5 ELSE 9 END"
_CONTACTS = w.VARIANTS + f""",
{_ELIGIBLE},
first AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY company_email ORDER BY {_LIST_RANK}, company_id, position, arrival) = 1),
counts AS (SELECT company_email, count(DISTINCT email_source_url) AS source_count FROM ok GROUP BY 1),
owners AS (SELECT DISTINCT placed.company_email, company_id FROM placed JOIN records USING (record_id)),
related AS (SELECT company_email, count(*) AS related_company_count FROM owners GROUP BY 1),
contacts AS (SELECT * FROM first JOIN counts USING (company_email) LEFT JOIN related USING (company_email))"""


def _unique_records(spark, sf) -> DataFrame:
    """Records with one row per company id, so that the owner of an address is unique."""
    rows = w.records(spark, sf)
    return rows.withColumn("company_id", F.concat(F.lit("CMP-"), "record_id"))


_UNIQUE = _CONTACTS.replace("'CMP-' || (k // 2) AS company_id", "'CMP-' || o || '-' || k AS company_id")


@query(f"WITH {_UNIQUE} SELECT company_email, company_id, email_source_url, priority, source_count, related_company_count FROM contacts")
def contact_list(spark, sf):
    return flat(ct.contact_list(_unique_records(spark, sf), True, True, True), "company_email", "company_id", "email_source_url", "priority",
                "source_count", "related_company_count")


@query(f"WITH {_UNIQUE} SELECT company_email, company_id FROM owners")
def contact_owners(spark, sf):
    return ct.contact_owners(co.contact_variants(_unique_records(spark, sf)))


@query(f"WITH {_UNIQUE} SELECT DISTINCT company_email, email_source_url FROM ok")
def contact_sources(spark, sf):
    return ct.contact_sources(_unique_records(spark, sf), include_other_country=True, include_reference=True)


_REVIEW = _UNIQUE + f""",
purposed AS (SELECT *, coalesce(purpose, {w.PURPOSE}) AS use FROM contacts),
reviewed AS (SELECT *, array_to_string(list_filter([
    CASE WHEN NOT (priority IN ('A', 'B') AND quality_decision = 'qualified') THEN 'company_fit' END,
    CASE WHEN verified_country IS NULL OR verified_country <> target_country THEN 'target_country' END,
    CASE WHEN industry_score = 0 OR buyer_role_score = 0 THEN 'product_or_role' END,
    CASE WHEN email_status NOT IN ('official', 'verified', 'external') OR email_source_url IS NULL THEN 'address_source' END,
    CASE WHEN email_domain_status NOT IN ('same_domain', 'public_mailbox') THEN 'address_owner' END,
    CASE WHEN related_company_count > 1 THEN 'shared_address' END,
    CASE use WHEN 'recruiting' THEN 'recruiting_address' WHEN 'leasing' THEN 'leasing_address' WHEN 'legal' THEN 'legal_address' END], lambda x: x IS NOT NULL), '|') AS review_reasons
  FROM purposed)"""


def _reviewed(spark, sf) -> DataFrame:
    return ct.review_contacts(ct.contact_list(_unique_records(spark, sf), True, True, True))


@query(f"""WITH {_REVIEW} SELECT company_email, company_id, review_reasons,
    CASE WHEN review_reasons = '' THEN 'approved' ELSE 'needs_review' END AS delivery_status FROM reviewed""")
def contact_review(spark, sf, reviewed=None):
    return flat(reviewed or _reviewed(spark, sf), "company_email", "company_id", "review_reasons", "delivery_status")


@query(f"WITH {_REVIEW} SELECT company_id, company_name, company_email, target_country, email_status, email_source_url, 'approved' AS delivery_status FROM reviewed WHERE review_reasons = ''")
def approved_export(spark, sf, reviewed=None):
    """Writes the approval file and reads it back."""
    out = scratch(spark)
    sinks.export_approved((reviewed or _reviewed(spark, sf)).where(F.col("delivery_status") == "approved"), f"{out}/approved")
    return spark.read.csv(f"{out}/approved", header=True)


@query(f"""WITH {_REVIEW} SELECT count(*) AS addresses, count(DISTINCT company_id) AS companies,
    count(*) FILTER (WHERE quality_decision = 'reference') AS reference_addresses,
    count(*) FILTER (WHERE quality_decision = 'other_country' OR verified_country IS NULL) AS country_to_check FROM reviewed""")
def contact_totals(spark, sf):
    return rp.contact_totals(_reviewed(spark, sf))


SENDER = Sender(company_name="Hana Trade", contact_name="Kim", contact_title="Manager", email="kim@hana.kr", website="https://hana.kr", brand_name="Hana")
PRODUCT = Product(product_name="Glow Serum", category="skincare", description="A light serum.", differentiator="vegan; small bottle",
                  catalog_url="https://hana.kr/c", selling_points="Fast absorbing.")
_LETTER_TAIL = ("We are Hana Trade. We would like to introduce Glow Serum, a skincare product.\n\nA light serum.\n\nThe product information provided to us "
                "highlights:\n- vegan\n- small bottle\n\nProduct information: https://hana.kr/c\n\nWe believe this product may be relevant to your portfolio. "
                "Would you be open to receiving a short product introduction or catalog for your review?\n\nBest regards,\nKim\nManager\nHana Trade\n"
                "https://hana.kr\nkim@hana.kr\n\nIf this is not relevant to your business, please let us know and we will not follow up.")


@query(f"""WITH {_REVIEW} SELECT company_id, company_email AS recipient_email, 'Introducing Glow Serum – skincare for ' || company_name AS subject_en,
    'Hello Business Development Team,' || chr(10) || chr(10) || 'We noticed that ' || company_name || ' works with importer in ' ||
    coalesce(verified_country, target_country) || '.' || chr(10) || chr(10) || {w.quote(_LETTER_TAIL)} AS body_en FROM reviewed""")
def letters(spark, sf, reviewed=None):
    return ct.draft_letters(reviewed or _reviewed(spark, sf), SENDER, PRODUCT).select("company_id", "recipient_email", "subject_en", "body_en")


@query(f"""WITH {_REVIEW}, l AS (SELECT DISTINCT company_id FROM reviewed WHERE review_reasons = '')
  SELECT company_email, company_id, CASE WHEN quality_decision = 'other_country' THEN 'after_country_check'
    WHEN quality_decision = 'reference' THEN 'after_company_check' WHEN company_id IN (SELECT company_id FROM l) THEN 'awaiting_review'
    ELSE 'awaiting_input' END AS letter_status FROM reviewed""")
def letter_status(spark, sf, reviewed=None):
    reviewed = reviewed or _reviewed(spark, sf)
    drafts = ct.draft_letters(reviewed.where(F.col("delivery_status") == "approved"), SENDER, PRODUCT)
    return rp.contacts_with_letters(reviewed, drafts).select("company_email", "company_id", "letter_status")


# ------------------------------------------------------------------ reports


@query(f"WITH {w.RECORDS} SELECT priority, count(*) AS companies FROM records GROUP BY GROUPING SETS ((priority), ())")
def grade_counts(spark, sf):
    return rp.grade_counts(w.records(spark, sf))


@query(f"""WITH {w.RECORDS}, r AS (SELECT trim(unnest(string_split(reasons, ';'))) AS reason FROM records WHERE quality_decision <> 'qualified')
  SELECT reason, count(*) AS companies FROM r WHERE reason <> '' GROUP BY 1""")
def exclusion_reasons(spark, sf):
    return rp.exclusion_reasons(w.records(spark, sf))


_MEASURES = """count(*) AS records, count(*) FILTER (WHERE quality_decision = 'qualified') AS qualified, count(*) FILTER (WHERE priority = 'A') AS tier_a,
    count(*) FILTER (WHERE priority = 'B') AS tier_b, count(*) FILTER (WHERE priority = 'C') AS tier_c,
    count(*) FILTER (WHERE priority = 'strategic') AS strategic, count(*) FILTER (WHERE quality_decision = 'reference') AS reference,
    count(*) FILTER (WHERE quality_decision = 'other_country') AS other_country, count(*) FILTER (WHERE quality_decision = 'excluded') AS excluded,
    count(company_email) AS emails_found, count(company_email) FILTER (WHERE quality_decision = 'qualified') AS qualified_emails_found"""
_COUNTRY_FACTS = f"""facts AS (SELECT target_country AS country, {_MEASURES} FROM records WHERE website <> '' GROUP BY 1),
  mail AS (SELECT target_country AS country, count(*) AS sendable FROM records WHERE email_status = 'official' AND priority = 'A' GROUP BY 1),
  held AS (SELECT target_country AS country, count(*) AS access_holds FROM records WHERE website = '' GROUP BY 1)"""
_NUMBERS = ("records", "qualified", "tier_a", "tier_b", "tier_c", "strategic", "reference", "other_country", "excluded", "emails_found",
            "qualified_emails_found")


def _analysed(df: DataFrame) -> DataFrame:
    """Companies with a site were analysed; those without one are access holds."""
    return df.where(F.col("website") != "")


def _mail(df: DataFrame) -> DataFrame:
    return df.where((F.col("email_status") == "official") & (F.col("priority") == "A"))


@query(f"""WITH {w.RECORDS}, {_COUNTRY_FACTS} SELECT n_name AS country, {', '.join(f'coalesce({x}, 0) AS {x}' for x in _NUMBERS)},
    coalesce(sendable, 0) AS sendable, coalesce(access_holds, 0) AS access_holds
  FROM nation LEFT JOIN facts ON n_name = facts.country LEFT JOIN mail ON n_name = mail.country LEFT JOIN held ON n_name = held.country""")
def country_summary(spark, sf):
    rows = w.records(spark, sf)
    countries = w.table(spark, sf, "nation").select(F.col("n_name").alias("country"))
    return rp.country_summary(_analysed(rows), _mail(rows), rows.where(F.col("website") == ""), countries)


@query(f"""WITH {w.RECORDS}, facts AS (SELECT {_MEASURES}, count(*) FILTER (WHERE company_email IS NULL) AS missing_email,
      count(*) FILTER (WHERE collection_depth = 'homepage_only') AS homepage_only, count(*) FILTER (WHERE collection_depth = 'deep_contact') AS deep_contact_review FROM records),
  m AS (SELECT count(*) AS sendable, count(DISTINCT company_id) AS mailing_companies FROM records WHERE email_status = 'official' AND priority = 'A'),
  h AS (SELECT count(*) AS access_holds FROM records WHERE website = '')
  SELECT {', '.join(_NUMBERS)}, missing_email, homepage_only, deep_contact_review, sendable, mailing_companies, access_holds,
    tier_a + tier_b + tier_c + strategic AS customer_list, greatest(0, 2500 - records) AS candidate_shortfall,
    greatest(0, 900 - sendable) AS email_shortfall, round_even(CAST(records AS DOUBLE) / 7, 2) AS candidates_per_call,
    CASE WHEN records >= 2500 AND sendable >= 900 AND qualified >= 20 THEN 'goals_met' ELSE 'goals_missed' END AS collection_status
  FROM facts, m, h""")
def run_summary(spark, sf):
    rows = w.records(spark, sf)
    campaign = Campaign(countries=("Vietnam", "France"), candidate_limit=2500, email_target=900, target_per_country=10)
    summary = rp.run_summary(rows, _mail(rows), rows.where(F.col("website") == ""), campaign, credits=7)
    return flat(summary, *_NUMBERS, "missing_email", "homepage_only", "deep_contact_review", "sendable", "mailing_companies", "access_holds",
                "customer_list", "candidate_shortfall", "email_shortfall", "candidates_per_call", "collection_status")


@query(f"""WITH {w.RECORDS}, f AS (SELECT target_country AS country, count(DISTINCT root) FILTER (WHERE website <> '') + CASE WHEN count(*) FILTER (WHERE website = '') > 0 THEN 1 ELSE 0 END AS analysed,
      count(*) FILTER (WHERE quality_decision = 'qualified') AS qualified FROM records GROUP BY 1),
  m AS (SELECT target_country AS country, count(*) AS addresses FROM records WHERE email_status = 'official' AND priority = 'A' GROUP BY 1),
  j AS (SELECT n_name AS country, coalesce(analysed, 0) AS analysed, coalesce(addresses, 0) AS addresses, coalesce(qualified, 0) AS qualified
    FROM nation LEFT JOIN f ON n_name = f.country LEFT JOIN m ON n_name = m.country)
  SELECT *, greatest(0, 40 - analysed) AS analysed_shortfall, greatest(0, 12 - addresses) AS addresses_shortfall,
    greatest(0, 25 - qualified) AS qualified_shortfall, analysed < 40 OR addresses < 12 OR qualified < 25 AS needs_work FROM j""")
def target_shortfall(spark, sf):
    rows = w.records(spark, sf)
    countries = w.table(spark, sf, "nation").select(F.col("n_name").alias("country"))
    campaign = Campaign(countries=("Vietnam", "France"), candidate_limit=80, target_per_country=12, qualified_target=50)
    return flat(rp.target_shortfall(rows, _mail(rows), countries, campaign))


_GRADE_POSITION = "CASE priority WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2 WHEN 'strategic' THEN 3 WHEN 'other_country' THEN 4 WHEN 'reference' THEN 5 WHEN 'hold' THEN 6 ELSE 7 END"


@query(f"""WITH {w.RECORDS}, a AS (SELECT record_id, priority, relevance_score, company_name FROM records
    UNION ALL SELECT 'h-' || record_id, 'hold', NULL, company_name FROM records WHERE website = '')
  SELECT record_id, priority, row_number() OVER (ORDER BY {_GRADE_POSITION}, coalesce(relevance_score, 0) DESC, lower(company_name), record_id) AS row_number FROM a""")
def report_rows(spark, sf):
    rows = w.records(spark, sf)
    holds = rows.where(F.col("website") == "").select(
        F.concat(F.lit("h-"), "record_id").alias("record_id"), F.lit("hold").alias("priority"), "company_name")
    return rp.numbered(rp.all_companies(rows, holds), "record_id").select("record_id", "priority", "row_number")


@query(f"""WITH {w.RECORDS} SELECT 'customer' AS section, count(*) AS companies FROM records WHERE priority IN ('A', 'B', 'C', 'strategic')
  UNION ALL SELECT 'all', count(*) FROM records UNION ALL SELECT 'other_country', count(*) FROM records WHERE quality_decision = 'other_country'
  UNION ALL SELECT 'reference', count(*) FROM records WHERE quality_decision = 'reference'
  UNION ALL SELECT 'excluded', count(*) FROM records WHERE quality_decision = 'excluded'""")
def report_sections(spark, sf):
    """Writes all sections as a report and counts what was stored."""
    out = scratch(spark)
    sections = rp.report_sections(w.records(spark, sf))
    sinks.write_report(sections, out, "run-1")
    parts = [spark.read.parquet(f"{out}/{name}").agg(F.count("*").alias("companies")).select(F.lit(name).alias("section"), "companies")
             for name in sections]
    return rp.union_records(parts)


def _log(spark, sf) -> DataFrame:
    """Events as calls to search providers."""
    k = F.get_json_object("props", "$.k")
    return w.table(spark, sf, "events").select(
        F.concat(F.lit("provider"), (F.col("user_id") % 3).cast("string")).alias("provider"), F.col("user_id").cast("string").alias("query"),
        F.col("event_type").alias("country"), F.when(F.col("event_type") == "view", "CACHE").when(F.col("event_type") == "error", "500").otherwise("200").alias("http_status"),
        k.cast("int").alias("result_count"), F.col("value").alias("response_time"),
        F.when(F.col("event_type") == "signup", "").otherwise(F.lit("1")).alias("credits"),
        F.when(F.col("event_type") == "error", "failed").otherwise("").alias("error"))


@query("""SELECT 'provider' || (user_id % 3) AS provider, count(*) AS calls, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS results,
    count(*) FILTER (WHERE event_type <> 'signup') AS credits, count(*) FILTER (WHERE event_type = 'view') AS cache_reused,
    count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY GROUPING SETS ((1), ())""")
def query_log(spark, sf):
    return rp.query_log_report(_log(spark, sf)).drop("mean_response_time")


@query(f"""WITH {w.FILTERED}, {_STATS}, {w.PARTIES}, r AS (SELECT CASE k % 4 WHEN 0 THEN 'low_relevance' WHEN 1 THEN 'media; agency' WHEN 2 THEN '' ELSE 'legal;media' END AS reasons,
      {w.sql_case('priority', w.DECISIONS)} AS d FROM parties),
  q AS (SELECT reason, count(*) AS n FROM (SELECT trim(unnest(string_split(reasons, ';'))) AS reason FROM r WHERE d <> 'qualified') WHERE reason <> '' GROUP BY 1)
  SELECT kind, count(*) AS rows, CAST(sum(results) AS BIGINT) AS results FROM (
    SELECT 'keyword' AS kind, raw_results AS results FROM stats
    UNION ALL SELECT 'reject_reason', count(*) FROM filtered WHERE reject_reason IS NOT NULL GROUP BY reject_reason
    UNION ALL SELECT 'quality_reason', n FROM q
    UNION ALL SELECT 'call', CAST(json_extract_string(props, '$.k') AS BIGINT) FROM events) GROUP BY 1""")
def evidence_log(spark, sf):
    filtered = _filtered(spark, sf)
    log = rp.evidence_log(rp.keyword_stats(filtered), rp.reject_report(filtered), rp.exclusion_reasons(w.records(spark, sf)), _log(spark, sf))
    return log.groupBy("kind").agg(F.count("*").alias("rows"), F.sum("results").alias("results"))


@query(f"""WITH {w.RECORDS}, s AS (SELECT country_score AS g, CAST(count(*) AS BIGINT) AS a, CAST(sum(relevance_score) AS BIGINT) AS b FROM records GROUP BY 1),
  u AS (SELECT industry_score AS g, CAST(count(*) AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM records GROUP BY 1)
  SELECT g AS industry, CAST(sum(a) AS BIGINT) AS calls, CAST(sum(coalesce(b, 0)) AS BIGINT) AS results FROM (SELECT * FROM s UNION ALL SELECT * FROM u) GROUP BY 1""")
def merged_runs(spark, sf):
    rows = w.records(spark, sf)
    one = rows.groupBy(F.col("country_score").alias("industry")).agg(F.count("*").alias("calls"), F.sum("relevance_score").alias("results"))
    two = rows.groupBy(F.col("industry_score").alias("industry")).agg(F.count("*").alias("calls"))
    return flat(rp.merge_runs([one, two], ["industry"], ["calls", "results"]))


_MAJORS = {0: "cosmetics", 1: "food", 2: "medical"}


@query(f"""WITH {w.RECORDS}, m AS (SELECT *, CASE k % 3 WHEN 0 THEN 'cosmetics' WHEN 1 THEN 'food' ELSE 'medical' END AS major FROM records),
  f AS (SELECT major, {_MEASURES}, count(*) FILTER (WHERE email_status = 'official' AND priority = 'A') AS sendable FROM m GROUP BY 1),
  q AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'cosmetics' WHEN 1 THEN 'food' ELSE 'medical' END AS major, count(*) AS queries FROM documents GROUP BY 1)
  SELECT major, records, qualified, sendable, queries, round(sendable / queries, 9) AS yield_ratio FROM f JOIN q USING (major)""")
def industry_summary(spark, sf):
    rows = w.records(spark, sf).withColumn("major", w.by_value(F.split_part("record_id", F.lit("-"), F.lit(2)).cast("long") % 3, _MAJORS))
    queries = w.table(spark, sf, "documents").select(w.by_value(F.col("doc_id") % 3, _MAJORS).alias("major"))
    return rp.industry_summary(rows, _mail(rows), queries).select(
        "major", "records", "qualified", "sendable", "queries", F.round("yield", 9).alias("yield_ratio"))


@query(f"""WITH {w.RECORDS}, f AS (SELECT CASE k % 3 WHEN 0 THEN 'cosmetics' WHEN 1 THEN 'food' ELSE 'medical' END AS major,
      count(*) FILTER (WHERE email_status = 'official' AND priority = 'A') AS sendable FROM records GROUP BY 1),
  q AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'cosmetics' WHEN 1 THEN 'food' ELSE 'medical' END AS major, count(*) AS queries FROM documents GROUP BY 1)
  SELECT major FROM f JOIN q USING (major) ORDER BY sendable / queries DESC, major DESC LIMIT 1""")
def next_industry(spark, sf):
    rows = w.records(spark, sf).withColumn("major", w.by_value(F.split_part("record_id", F.lit("-"), F.lit(2)).cast("long") % 3, _MAJORS))
    queries = w.table(spark, sf, "documents").select(w.by_value(F.col("doc_id") % 3, _MAJORS).alias("major"))
    return rp.next_industry(rp.industry_summary(rows, _mail(rows), queries)).select("major")


GROUPS = [("words", "english", "and the"), ("words", "english", "thble masks"), ("words", "german", "und der"), ("words", "spanish", "de la"),
          ("words", "rare", "zzzz qqqq")]
_GROUP_ALIASES = [(s, p, f" {t.fold_python(a)} ") for _, s, p in GROUPS for a in ([p, p[:-1]] if p.endswith("masks") else [p])]
_COVER_COUNTRIES = ("United Kingdom", "France", "Germany", "Spain")


def _assessments(spark, sf) -> DataFrame:
    """Documents as companies with a verdict per country and the products their text names."""
    products = [p for _, _, p in GROUPS]
    found = gr.product_matches(F.col("text"), products)
    return w.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("company_id"), F.lit("words").alias("major"),
        w.by_value(F.col("lang"), w.LANG_COUNTRIES).alias("target_country"),
        F.array_distinct(F.transform(found, lambda m: m["product"])).alias("product_hits"),
        w.by_value(F.col("doc_id") % 3, {0: "A", 1: "B", 2: "C"}).alias("priority"),
        F.when(F.col("doc_id") % 3 == 2, "review").otherwise("qualified").alias("quality_decision"))


_GROUPS_SQL = ", ".join(f"({w.quote(s)}, {w.quote(p)}, {w.quote(a)})" for s, p, a in _GROUP_ALIASES)
_ASSESS_SQL = f"""g AS (SELECT * FROM (VALUES {_GROUPS_SQL}) AS g(subcategory, product, a)),
  d AS (SELECT doc_id, {w.sql_case('lang', w.LANG_COUNTRIES)} AS country, {_WORDS_SQL.format(c='text')} AS x FROM documents),
  named AS (SELECT DISTINCT doc_id, country, subcategory, product FROM d JOIN g ON contains(x, a))"""


@query(f"""WITH {_ASSESS_SQL}, {w.HITS}, kw AS (SELECT country, title AS keyword, count(*) AS calls FROM hits GROUP BY ALL),
  kx AS (SELECT *, {_WORDS_SQL.format(c='keyword')} AS x FROM kw), kn AS (SELECT DISTINCT country, keyword, calls, subcategory, product FROM kx JOIN g ON contains(x, a)),
  s AS (SELECT subcategory, country, count(DISTINCT product) AS searched_products FROM kn GROUP BY ALL),
  c AS (SELECT subcategory, country, CAST(sum(calls) AS BIGINT) AS search_calls FROM (SELECT DISTINCT subcategory, country, keyword, calls FROM kn) GROUP BY ALL),
  m AS (SELECT subcategory, country, count(DISTINCT doc_id) AS companies_with_product FROM named GROUP BY ALL),
  ap AS (SELECT doc_id, country FROM d UNION ALL SELECT doc_id, country FROM d),
  e AS (SELECT subcategory, n.country, count(DISTINCT n.doc_id) AS mailing_companies, count(*) AS addresses
    FROM (SELECT DISTINCT doc_id, country, subcategory FROM named WHERE doc_id % 3 < 2) n JOIN ap ON n.doc_id = ap.doc_id AND n.country = ap.country GROUP BY ALL),
  grid AS (SELECT subcategory, country, count(DISTINCT product) AS selected_products FROM g,
    (SELECT unnest(['United Kingdom', 'France', 'Germany', 'Spain']) AS country) GROUP BY ALL),
  f AS (SELECT grid.subcategory, grid.country, selected_products, coalesce(searched_products, 0) AS searched_products, coalesce(search_calls, 0) AS search_calls,
      coalesce(companies_with_product, 0) AS companies_with_product, coalesce(mailing_companies, 0) AS mailing_companies, coalesce(addresses, 0) AS addresses
    FROM grid LEFT JOIN s USING (subcategory, country) LEFT JOIN c USING (subcategory, country) LEFT JOIN m USING (subcategory, country) LEFT JOIN e USING (subcategory, country))
  SELECT *, CASE WHEN searched_products < selected_products THEN 'products_not_searched' WHEN companies_with_product = 0 THEN 'no_product_evidence' ELSE 'product_evidence' END AS search_state FROM f""")
def subcategory_coverage(spark, sf):
    stats = w.hits(spark, sf).groupBy("country", F.col("title").alias("keyword")).agg(F.count("*").alias("calls"))
    docs = w.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("company_id"),
                                                  w.by_value(F.col("lang"), w.LANG_COUNTRIES).alias("target_country"), "doc_id")
    approved = docs.unionByName(docs).drop("doc_id")  # two addresses each
    return flat(rp.subcategory_coverage(spark, GROUPS, _COVER_COUNTRIES, stats, _assessments(spark, sf), approved).drop("major"))


@query(f"""WITH {_ASSESS_SQL}, v AS (SELECT subcategory, count(DISTINCT doc_id) AS verdicts FROM named GROUP BY 1)
  SELECT product, coalesce(verdicts, 0) AS evidence FROM (SELECT DISTINCT subcategory, product FROM g) LEFT JOIN v USING (subcategory)""")
def product_evidence_order(spark, sf):
    return flat(rp.product_evidence_order(_assessments(spark, sf), GROUPS), "product", "evidence")


# ------------------------------------------------------------------ plans


def _groups(spark, sf) -> DataFrame:
    """Brands and types as product groups: all their product names by part key, ten to a group, which is the most a plan takes."""
    parts = w.table(spark, sf, "part").groupBy("p_brand", "p_type", "p_name").agg(F.min("p_partkey").alias("first"))
    at = F.row_number().over(Window.partitionBy("p_brand", "p_type").orderBy("first", "p_name")) - 1
    placed = parts.select("p_brand", "p_type", F.floor(at / 10).alias("_part"), F.struct(at.alias("at"), "p_name").alias("_n"))
    groups = placed.groupBy("p_brand", "p_type", "_part").agg(F.sort_array(F.collect_list("_n")).alias("_n"))
    return groups.select(F.concat_ws(" ", "p_brand", "p_type", F.col("_part").cast("string")).alias("major"),
                         F.when(F.col("p_type") == "SMALL", "food").otherwise("cosmetics").alias("industry"), F.transform("_n", lambda n: n["p_name"]).alias("products"))


_ROLES = {"food": ("food importer", "food distributor", "food wholesaler", "supermarket chain", "grocery retailer"),
          "cosmetics": ("importer", "distributor", "beauty wholesaler", "cosmetics retail chain", "aesthetic clinic beauty salon")}
_ROLE_LIST = "CASE industry WHEN 'food' THEN {} ELSE {} END".format(*["[" + ", ".join(w.quote(x) for x in _ROLES[i]) + "]" for i in ("food", "cosmetics")])
_PLAN = f"""named AS (SELECT p_brand || ' ' || p_type AS brand, p_type, p_name, min(p_partkey) AS a FROM part GROUP BY ALL),
  names AS (SELECT *, brand || ' ' || ((row_number() OVER (PARTITION BY brand ORDER BY a, p_name) - 1) // 10) AS major FROM named),
  groups AS (SELECT major, CASE WHEN p_type = 'SMALL' THEN 'food' ELSE 'cosmetics' END AS industry, list(p_name ORDER BY a, p_name) AS products FROM names GROUP BY ALL),
  steps AS (SELECT major, products, {_ROLE_LIST} AS roles, unnest(range(greatest(len(products), 5))) AS n FROM groups),
  pairs AS (SELECT major, len(products) AS size, n, products[n % len(products) + 1] || ' ' || roles[n % 5 + 1] AS keyword FROM steps),
  firsts AS (SELECT major, size, keyword, min(n) AS n FROM pairs GROUP BY ALL),
  plan AS (SELECT major, keyword, row_number() OVER (PARTITION BY major ORDER BY n) - 1 AS position FROM firsts
    QUALIFY row_number() OVER (PARTITION BY major ORDER BY n) <= least(12, greatest(5, size)))"""


@query(f"WITH {_PLAN} SELECT major, keyword, position FROM plan")
def keyword_plan(spark, sf):
    planned = pl.plan_keywords(_groups(spark, sf))
    return flat(planned.where(F.col("phase") == "base"), "major", "keyword", "position")


_MORE_LIST = "CASE industry " + " ".join(f"WHEN {w.quote(i)} THEN [{', '.join(w.quote(x) for x in catalog.EXPANSION_ROLES.get(i, catalog.DEFAULT_EXPANSION_ROLES))}]" for i in ("food", "cosmetics")) + " END"


@query(f"""WITH {_PLAN}, used AS (SELECT major, lower(keyword) AS keyword FROM firsts QUALIFY row_number() OVER (PARTITION BY major ORDER BY n) <= 10),
  more AS (SELECT major, products, {_MORE_LIST} AS more FROM groups),
  every AS (SELECT major, products, more, unnest(range(len(products) * len(more))) AS n FROM more),
  said AS (SELECT major, n, products[n % len(products) + 1] || ' ' || more[(n % len(products) + n // len(products)) % len(more) + 1] AS keyword FROM every),
  fresh AS (SELECT major, keyword, min(n) AS n FROM said WHERE NOT EXISTS (SELECT 1 FROM used WHERE used.major = said.major AND used.keyword = lower(said.keyword)) GROUP BY ALL),
  base AS (SELECT major, count(*) AS size FROM plan GROUP BY 1)
  SELECT major, keyword, size + row_number() OVER (PARTITION BY major ORDER BY n) - 1 AS position FROM fresh JOIN base USING (major)
  QUALIFY row_number() OVER (PARTITION BY major ORDER BY n) <= 3""")
def expansion_keywords(spark, sf):
    planned = pl.plan_keywords(_groups(spark, sf))
    return flat(planned.where(F.col("phase") == "expansion"), "major", "keyword", "position")


_EXCLUDED = pl.exclusions()
_QUERY_TEXT = """CASE profile WHEN 'official' THEN country || ' ' || keyword || ' company ' WHEN 'ecosystem' THEN country || ' ' || keyword || ' exhibitor association '
  ELSE country || ' ' || keyword || ' ' || CASE WHEN NOT contains(lower(keyword), 'import') AND regexp_matches(lower(keyword), 'distribut|wholesale|retail|clinic|salon|spa')
    THEN CASE country WHEN 'Vietnam' THEN 'nhà phân phối' ELSE 'distributeur' END ELSE CASE country WHEN 'Vietnam' THEN 'nhà nhập khẩu' ELSE 'importateur' END END || ' ' END"""


@query(f"""WITH {_PLAN}, c AS (SELECT * FROM (VALUES ('Vietnam'), ('France')) AS c(country)), p AS (SELECT * FROM (VALUES ('official', 0), ('local_market', 1), ('ecosystem', 2)) AS p(profile, q)),
  every AS (SELECT major, country, profile, q, keyword, position, CASE WHEN position % 3 = q THEN 0 ELSE 1 END AS pass FROM plan, c, p)
  SELECT major, country, row_number() OVER (PARTITION BY major, country ORDER BY pass, CASE WHEN pass = 0 THEN 0 ELSE q END, position) - 1 AS task_idx,
    profile, keyword, {_QUERY_TEXT} || {w.quote(_EXCLUDED)} AS query FROM every""")
def query_plan(spark, sf):
    planned = pl.plan_keywords(_groups(spark, sf)).where(F.col("phase") == "base").withColumn("keyword_count", F.col("base_keyword_count"))
    campaign = Campaign(countries=("Vietnam", "France"), search_mode="maximum")
    return flat(pl.plan_queries(planned, campaign), "major", "country", "task_idx", "profile", "keyword", "query")


@query(f"""WITH {_PLAN}, c AS (SELECT * FROM (VALUES ('Vietnam'), ('France')) AS c(country)), q AS (SELECT DISTINCT country || ' ' || keyword || ' company ' || {w.quote(_EXCLUDED)} AS query, major
    FROM plan, c) SELECT q.query, q.major FROM q WHERE query NOT IN (SELECT query FROM q WHERE major LIKE '%SMALL')""")
def unused_queries(spark, sf):
    planned = pl.plan_keywords(_groups(spark, sf)).where(F.col("phase") == "base").withColumn("keyword_count", F.col("base_keyword_count"))
    queries = pl.plan_queries(planned, Campaign(countries=("Vietnam", "France"), search_mode="precision"))
    done = queries.where(F.col("major").endswith("SMALL"))
    return pl.unused_queries(queries, done).select("query", "major").distinct()


_STOP = w.TASKS + """,
  firsts AS (SELECT country, domain, min(task_idx) AS t FROM found GROUP BY ALL),
  kth AS (SELECT country, t AS last FROM firsts QUALIFY row_number() OVER (PARTITION BY country ORDER BY t, domain) = 150),
  planned AS (SELECT country, count(*) AS planned_tasks FROM tasks GROUP BY 1),
  stops AS (SELECT country, planned_tasks, last IS NOT NULL AS target_reached, least(planned_tasks, CASE WHEN last IS NULL THEN planned_tasks ELSE greatest(5, last + 1) END) AS needed_tasks
    FROM planned LEFT JOIN kth USING (country))"""


@query(f"WITH {_STOP} SELECT * FROM stops")
def stop_points(spark, sf):
    return flat(pl.stop_points(w.tasks(spark, sf), w.found_domains(spark, sf), 150, 5))


@query(f"""WITH {_STOP}, part AS (SELECT *, least(needed_tasks, ceil(20000 / (SELECT count(*) FROM stops))) AS p FROM stops),
  spent AS (SELECT *, sum(p) OVER (ORDER BY country) AS s FROM part),
  allowed AS (SELECT country, CAST(greatest(0, least(p, 20000 - (s - p))) AS BIGINT) AS n FROM spent)
  SELECT country, task_idx FROM tasks JOIN allowed USING (country) WHERE task_idx < n""")
def executed_tasks(spark, sf):
    return pl.executed_tasks(w.tasks(spark, sf), w.found_domains(spark, sf), 150, 5, cap=20000)


@query("""WITH g AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 AS i FROM (SELECT DISTINCT p_brand, p_size FROM part)),
  t AS (SELECT p_brand, count(*) AS total FROM part GROUP BY 1)
  SELECT p_brand, i AS idx, total // 7 + CASE WHEN i < total % 7 THEN 1 ELSE 0 END AS goal FROM g JOIN t USING (p_brand) WHERE i < 7""")
def goal_shares(spark, sf):
    totals = w.table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("total"))
    rows = totals.select("p_brand", "total", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("idx"))
    sizes = w.table(spark, sf, "part").groupBy("p_brand").agg(F.count_distinct("p_size").alias("sizes"))
    return flat(rows.join(sizes, "p_brand").where(F.col("idx") < F.col("sizes")).select(
        "p_brand", "idx", numbers.share(F.col("total"), 7, F.col("idx")).alias("goal")))


def _creator_campaigns(spark, sf) -> DataFrame:
    """A campaign has seven queries, two a keyword, so it takes the first four keywords: that limit is the feature."""
    nations = w.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("_k"), F.initcap("n_name").alias("country"))
    names = (w.table(spark, sf, "part").withColumn("_k", F.col("p_partkey") % 25).groupBy("_k", "p_name").agg(F.min("p_partkey").alias("a")))
    lists = grouping.first_k_array(names, ["_k"], ["a", "p_name"], 4, "p_name", "keywords")
    return lists.join(F.broadcast(nations), "_k").select("country", F.lit("beauty").alias("category"), "keywords")  # 25 nations


@query("""WITH k AS (SELECT p_partkey % 25 AS nk, p_name, min(p_partkey) AS a FROM part GROUP BY ALL),
  l AS (SELECT nk, list(p_name ORDER BY a, p_name)[1:4] AS ks FROM k GROUP BY 1),
  c AS (SELECT array_to_string(list_transform(string_split(n_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS country, ks FROM l JOIN nation ON nk = n_nationkey),
  s AS (SELECT *, unnest(range(len(ks))) AS i, CASE country WHEN 'Vietnam' THEN ['Việt Nam', 'Vietnam', 'beauty blogger Vietnam', 'KOC Vietnam']
      WHEN 'Indonesia' THEN ['Indonesia', 'Indonesian creator', 'beauty blogger Indonesia'] WHEN 'Japan' THEN ['Japan', 'Japanese creator', '美容インフルエンサー']
      WHEN 'United States' THEN ['United States', 'US creator'] ELSE [country] END AS loc FROM c),
  q AS (SELECT country, 2 * i AS position, 'site:instagram.com ' || loc[i % len(loc) + 1] || ' "' || ks[i + 1] || '" influencer creator' AS query FROM s
    UNION ALL SELECT country, 2 * i + 1, 'site:instagram.com ' || country || ' "' || ks[i + 1] || '" blogger reviewer KOC KOL' FROM s
    UNION ALL SELECT country, 2 * len(ks), 'site:instagram.com ' || country || ' "beauty" "content creator"' FROM c)
  SELECT country, position, query FROM q WHERE position < 7""")
def creator_queries(spark, sf):
    return flat(pl.creator_queries(_creator_campaigns(spark, sf), 7), "country", "position", "query")


def _type_keywords(spark, sf) -> DataFrame:
    """Part types as keywords, by their first part."""
    types = w.table(spark, sf, "part").groupBy("p_type").agg(F.min("p_partkey").alias("a"))
    return grouping.sequential(types, ["a", "p_type"], "place").select(
        (F.col("place") - 1).cast("long").alias("position"), F.concat(F.lower("p_type"), F.lit(" importer")).alias("keyword"))


def _brand_products(spark, sf) -> DataFrame:
    """Products of the campaign in turn over the brands, by the number of parts of each brand."""
    brands = w.table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    ranked = grouping.sequential(brands, ["n", "p_brand"], "place")
    names = F.array(*[F.lit(p) for p in CAMPAIGN.products])
    return ranked.select((F.col("place") - 1).cast("long").alias("position"), F.when(F.col("place") <= len(CAMPAIGN.products), F.get(names, F.col("place") - 1)).otherwise(
        F.lower("p_brand")).alias("product"))


_LOCAL_SQL = ", ".join(f"({w.quote(r['country'])}, {w.quote(r['tld'])}, [{', '.join(w.quote(x) for x in r['local_buyer'])}])" for r in catalog.country_rows())
_COUNTRIES_SQL = f"""lf AS (SELECT * FROM (VALUES {_LOCAL_SQL}) AS f(country, tld, local)),
  n AS (SELECT array_to_string(list_transform(string_split(n_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS country, n_nationkey AS idx FROM nation),
  c AS (SELECT n.country, n.idx, coalesce(tld, '') AS tld, coalesce(local, ['importer', 'distributor']) AS local FROM n LEFT JOIN lf USING (country)),
  ty AS (SELECT p_type, min(p_partkey) AS a FROM part GROUP BY 1),
  kw AS (SELECT row_number() OVER (ORDER BY a, p_type) - 1 AS position, lower(p_type) || ' importer' AS keyword FROM ty)"""


@query(f"""WITH {_COUNTRIES_SQL},
  h AS (SELECT * FROM (VALUES (0, 'facial serum'), (1, 'sheet masks'), (2, 'shampoo')) AS h(j, hint)),
  r AS (SELECT * FROM (VALUES (0, 'importer'), (1, 'exclusive distributor'), (2, 'wholesale distributor'), (3, 'retail chain'), (4, 'beauty supplier'), (5, 'aesthetic clinic'), (6, 'beauty salon')) AS r(j, role)),
  q AS (SELECT country, 2 * j AS pos, country || ' ' || hint || ' ' || array_to_string(local[1:3], ' ') AS query FROM c, h
    UNION ALL SELECT country, 2 * j + 1, 'site:.' || tld || ' ' || hint || ' ' || array_to_string(local[1:2], ' ') FROM c, h WHERE tld <> ''
    UNION ALL SELECT country, 6 + 2 * j, country || ' ' || hint || ' importer distributor wholesaler company' FROM c, h
    UNION ALL SELECT country, 7 + 2 * j, country || ' ' || hint || ' retail chain clinic salon supplier' FROM c, h
    UNION ALL SELECT country, 12 + j, country || ' facial serum ' || role || ' official website contact' FROM c, r
    UNION ALL SELECT country, 19 + position, country || ' ' || keyword || ' official website contact' FROM c, kw),
  u AS (SELECT country, query, min(pos) AS pos FROM q GROUP BY ALL),
  k AS (SELECT country, row_number() OVER (PARTITION BY country ORDER BY pos, query) - 1 AS position, query FROM u)
  SELECT country, position, query FROM k WHERE position < 25""")
def backfill_queries(spark, sf):
    nations = w.table(spark, sf, "nation").select(F.initcap("n_name").alias("country"))
    facts = dimensions.with_country_facts(nations)
    return flat(pl.backfill_queries(facts, _type_keywords(spark, sf), replace(CAMPAIGN, search_mode="maximum")))


_TAIL = pl.exclusions()


@query(f"""WITH {_COUNTRIES_SQL},
  br AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1),
  br2 AS (SELECT row_number() OVER (ORDER BY n, p_brand) - 1 AS position, p_brand FROM br),
  pr AS (SELECT position, coalesce((['facial serum', 'sheet masks', 'shampoo'])[position + 1], lower(p_brand)) AS product FROM br2),
  vi AS (SELECT * FROM (VALUES {', '.join(f'({w.quote(k)}, {w.quote(x[0])})' for k, x in catalog.VIETNAMESE_PRODUCTS.items())}) AS v(name, phrase)),
  pf AS (SELECT * FROM (VALUES (0, 'official'), (1, 'local_market')) AS p(turn, profile)),
  ask AS (SELECT country, idx, local, position, keyword, turn, trim(country || ' ' || keyword || ' ' || CASE profile WHEN 'local_market' THEN
      local[CASE WHEN regexp_matches(keyword, 'distribut|wholesale|retail|clinic|salon|spa') AND NOT contains(keyword, 'import') THEN least(2, len(local)) ELSE 1 END] ELSE 'company' END || ' ' || {w.quote(_TAIL)}) AS query FROM c, kw, pf),
  q AS (SELECT country, idx, 0 AS section, position AS place, phrase || ' nhà phân phối' AS keyword, country || ' ' || phrase || ' nhà phân phối ' || {w.quote(_TAIL)} AS query FROM c, pr JOIN vi ON lower(product) = name WHERE country = 'Vietnam'
    UNION ALL SELECT country, idx, 1, position, keyword, query FROM ask WHERE turn = position % 2
    UNION ALL SELECT country, idx, 2, turn * 1099511627776 + position, keyword, query FROM ask
    UNION ALL SELECT country, idx, 3, position, product || ' ' || array_to_string(local[1:2], ' '), country || ' ' || product || ' ' || array_to_string(local[1:2], ' ') || ' ' || {w.quote(_TAIL)} FROM c, pr)
  SELECT country, CAST(idx AS BIGINT) AS country_idx, CAST(section AS BIGINT) AS section, CAST(place AS BIGINT) AS place, keyword, query FROM q
  QUALIFY row_number() OVER (PARTITION BY country, query ORDER BY section, place, idx, keyword) = 1""")
def refill_queries(spark, sf):
    nations = w.table(spark, sf, "nation").select(F.initcap("n_name").alias("country"), F.col("n_nationkey").alias("country_idx"))
    facts = dimensions.with_country_facts(nations)
    return flat(pl.refill_queries(facts, _type_keywords(spark, sf), _brand_products(spark, sf), CAMPAIGN))


# ------------------------------------------------------------------ creators

SEARCH = CreatorSearch(country="Vietnam", category="beauty", keywords=("beauty", "skincare"), min_followers=13000)


def _gated(spark, sf) -> DataFrame:
    return cr.gate_creators(cr.read_profiles(w.profiles(spark, sf), SEARCH), SEARCH)


_GATED = w.PROFILES + f""",
looked AS (SELECT *, lower(body) AS low, {w.count_contains('lower(body)', verdict_sql.v.CREATOR_TERMS)} AS creator,
    {w.count_contains('lower(body)', verdict_sql.v.BUSINESS_ACCOUNT_TERMS + verdict_sql.v.MEDIA_ACCOUNT_TERMS)} AS business,
    {w.count_contains('lower(body)', SEARCH.category_terms)} AS category, {w.count_contains('lower(body)', verdict_sql.v.COLLAB_TERMS)} AS collab,
    {w.contains_any('lower(body)', verdict_sql.v.FIRST_PERSON_TERMS)} AS personal,
    regexp_extract(body, '(?i)([0-9]{{1,3}}(?:[.,][0-9]{{1,3}})?|[0-9]{{1,9}})\\s*([kmb]?)\\s*(?:followers?)', 1) AS fraw,
    regexp_extract(body, '(?i)([0-9]{{1,3}}(?:[.,][0-9]{{1,3}})?|[0-9]{{1,9}})\\s*([kmb]?)\\s*(?:followers?)', 2) AS fsuf FROM plain),
counted AS (SELECT *, CASE WHEN fraw = '' THEN NULL WHEN fsuf = 'k' THEN CAST(trunc(CAST(replace(fraw, ',', '.') AS DOUBLE) * 1000) AS BIGINT)
    ELSE CAST(trunc(CAST(replace(fraw, ',', '') AS DOUBLE)) AS BIGINT) END AS followers, business > 0 AND creator = 0 AS is_business FROM looked),
gated AS (SELECT *, CASE WHEN handle IS NULL THEN 'not_a_profile' WHEN is_business THEN 'business_account'
    WHEN followers < 13000 THEN 'below_follower_range' END AS reject_reason FROM counted)"""


@query(f"WITH {_GATED} SELECT arrival, handle, followers, reject_reason FROM gated")
def creator_gate(spark, sf):
    return flat(_gated(spark, sf), "arrival", "handle", "followers", "reject_reason")


_SCORED = _GATED + """,
placed AS (SELECT *, CASE WHEN contains(body, '🇻🇳') THEN 'match' WHEN contains(low, 'hanoi') THEN 'match' WHEN contains(body, '🇩🇪') THEN 'mismatch'
      WHEN contains(low, 'tokyo') THEN 'mismatch' ELSE 'unknown' END AS location_status,
    CASE WHEN contains(body, '🇻🇳') THEN 'flag' WHEN contains(low, 'hanoi') THEN 'city: hanoi' WHEN contains(body, '🇩🇪') THEN 'flag: Germany'
      WHEN contains(low, 'tokyo') THEN 'city: tokyo' END AS location_evidence,
    nullif(regexp_extract(low, '(?:^|[^\\w.+-])([a-z0-9][a-z0-9._%+-]{0,63}@shop\\.vn)(?:[^\\w.-]|$)', 1), '') AS public_email,
    coalesce(followers >= 50000, false) AND NOT personal AS suspect FROM gated WHERE reject_reason IS NULL),
scored AS (SELECT *, CAST(greatest(0, least(100, 15 + CASE WHEN creator > 0 THEN least(30, 15 + creator * 5) ELSE 0 END + least(20, category * 7)
    + CASE location_status WHEN 'match' THEN 10 WHEN 'mismatch' THEN -25 ELSE 0 END + CASE WHEN followers IS NOT NULL THEN 10 ELSE 0 END
    + CASE WHEN public_email IS NOT NULL THEN 15 ELSE 0 END + least(10, collab * 5) - CASE WHEN suspect THEN 15 ELSE 0 END)) AS BIGINT) AS score FROM placed),
graded AS (SELECT *, CASE WHEN score >= 70 AND location_status <> 'mismatch' THEN 'A' WHEN score >= 50 THEN 'B' ELSE 'C' END AS grade,
    CASE WHEN suspect THEN 'media_suspect' WHEN creator > 0 THEN 'creator' ELSE 'creator_candidate' END AS profile_type FROM scored)"""


@query(f"WITH {_SCORED} SELECT arrival, handle, location_status, location_evidence, public_email, followers, score, grade, profile_type FROM graded")
def creator_scores(spark, sf):
    return flat(cr.score_creators(_gated(spark, sf), SEARCH), "arrival", "handle", "location_status", "location_evidence", "public_email",
                "followers", "score", "grade", "profile_type")


_UNIQUE_CREATORS = _SCORED + """,
winners AS (SELECT * FROM graded QUALIFY row_number() OVER (PARTITION BY handle ORDER BY score DESC, arrival) = 1),
sightings AS (SELECT handle, count(*) AS sightings, min(arrival) AS first_arrival FROM graded GROUP BY 1),
unique_creators AS (SELECT w.* EXCLUDE (public_email), s.sightings, s.first_arrival, coalesce(w.public_email, (SELECT arg_min(g.public_email, g.arrival) FROM graded g
    WHERE g.handle = w.handle AND g.arrival > w.arrival AND g.public_email IS NOT NULL)) AS public_email FROM winners w JOIN sightings s USING (handle))"""


def _unique_creators(spark, sf) -> DataFrame:
    return cr.dedup_creators(cr.score_creators(_gated(spark, sf), SEARCH))


@query(f"WITH {_UNIQUE_CREATORS} SELECT handle, arrival, score, grade, public_email, sightings, first_arrival FROM unique_creators")
def creator_merge(spark, sf):
    return flat(_unique_creators(spark, sf), "handle", "arrival", "score", "grade", "public_email", "sightings", "first_arrival")


@query(f"""WITH {_UNIQUE_CREATORS} SELECT row_number() OVER (ORDER BY score DESC, coalesce(followers, -1) DESC, first_arrival) AS rank, handle, score, followers
  FROM unique_creators ORDER BY rank LIMIT 25""")
def creator_ranking(spark, sf):
    return flat(cr.top_creators(_unique_creators(spark, sf), 25), "rank", "handle", "score", "followers")


@query(f"""WITH {_UNIQUE_CREATORS}, t AS (SELECT * FROM unique_creators ORDER BY score DESC, coalesce(followers, -1) DESC, first_arrival LIMIT 25)
  SELECT count(*) AS records, count(*) FILTER (WHERE grade = 'A') AS tier_a, count(*) FILTER (WHERE grade = 'B') AS tier_b, count(*) FILTER (WHERE grade = 'C') AS tier_c,
    count(public_email) AS public_emails, 0 AS dm_drafts, (SELECT count(*) FROM raw) AS raw_results, (SELECT count(DISTINCT handle) FROM graded) AS unique_profiles FROM t""")
def creator_summary(spark, sf):
    gated = _gated(spark, sf)
    top = cr.top_creators(cr.dedup_creators(cr.score_creators(gated, SEARCH)), 25)
    return flat(rp.creator_summary(top, w.profiles(spark, sf), gated))


@query(f"""WITH {_UNIQUE_CREATORS}, u AS (SELECT 'user.' || (user_id % 60) AS handle, arg_max(event_type, event_id) AS e FROM events GROUP BY 1)
  SELECT handle, CASE e WHEN 'click' THEN 'sent' WHEN 'purchase' THEN 'replied' ELSE 'draft' END AS dm_status,
    CASE e WHEN 'click' THEN 'no_email' ELSE 'not_sent' END AS email_contact_status FROM unique_creators LEFT JOIN u USING (handle)""")
def creator_status(spark, sf):
    kind = F.col("event_type")
    updates = w.table(spark, sf, "events").select(
        F.concat(F.lit("user."), (F.col("user_id") % 60).cast("string")).alias("handle"), F.col("event_id").alias("updated_at"),
        F.when(kind == "click", "sent").when(kind == "purchase", "replied").otherwise("bad").alias("dm_status"),
        F.when(kind == "click", "no_email").alias("email_contact_status"))
    return cr.apply_contact_status(_unique_creators(spark, sf), updates).select("handle", "dm_status", "email_contact_status")


@query("""SELECT profile_type, count(*) AS rows FROM (WITH """ + _UNIQUE_CREATORS + """ SELECT profile_type FROM unique_creators) GROUP BY 1""")
def creator_facets(spark, sf):
    return cr.facet_values(_unique_creators(spark, sf), "profile_type")


@query(f"WITH {_UNIQUE_CREATORS} SELECT handle, followers FROM unique_creators")
def creator_browse(spark, sf):
    return flat(cr.filter_creators(_unique_creators(spark, sf), "Vietnam", "beauty"), "handle", "followers")


_DM = ("'Hi Profile ' || (arrival // 100) || ' •,' || chr(10) || chr(10) || 'I found your public Instagram profile while researching beauty creators in Vietnam. "
       "I''m Kim from Hana (Hana Trade). We would like to introduce Glow Serum, a Korean skincare. Fast absorbing.' || chr(10) || chr(10) || "
       "'Would you be open to receiving a short product introduction and discussing a possible collaboration?' || chr(10) || chr(10) || 'Best,' || chr(10) || 'Kim' || chr(10) || 'https://hana.kr'")


@query(f"""WITH {_UNIQUE_CREATORS} SELECT handle, {_DM} AS dm_draft, 'Collaboration inquiry from Hana — Glow Serum' AS email_subject, 'drafted' AS outreach_status FROM unique_creators""")
def creator_drafts(spark, sf):
    drafts = cr.draft_outreach(_unique_creators(spark, sf), SENDER, PRODUCT)
    return drafts.select("handle", "dm_draft", "email_subject", "outreach_status")


_INVITE = ("'Subject: Collaboration inquiry - Serum from [회사명]' || chr(10) || chr(10) || 'Hello Creator ' || c_custkey || ',' || chr(10) || chr(10) || "
           "'My name is Kim from [회사명], a Korean company that makes Serum.' || chr(10) || chr(10) || 'I came across your ' || "
           "CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'lifestyle and home goods' ELSE '[카테고리 영문명]' END || ' content (@c_' || c_custkey || "
           "') and thought it could be a good fit for your audience in Vietnam.' || chr(10) || chr(10) || 'We would like to send you a free sample and a one-page product sheet, "
           "with no obligation. If you are interested, just reply to this email and I will share the details.' || chr(10) || chr(10) || "
           "'If we work together, we will follow the advertising disclosure rules that apply in Vietnam.' || chr(10) || chr(10) || "
           "'If you would prefer not to hear from us, reply with \"unsubscribe\" and we will not contact you again.' || chr(10) || chr(10) || "
           "'Best regards,' || chr(10) || 'Kim' || chr(10) || '[회사명]' || chr(10) || '[회신 이메일]'")


@query(f"""SELECT 'c_' || c_custkey AS handle, {_INVITE} AS invitation,
    CASE c_mktsegment WHEN 'HOUSEHOLD' THEN '[회사명]|[회신 이메일]' ELSE '[회사명]|[카테고리 영문명]|[회신 이메일]' END AS missing_inputs,
    CASE WHEN c_acctbal < 0 THEN 'no_email|unverified_status|check_sending_rules' ELSE 'unverified_status|check_sending_rules' END AS cautions FROM customer""")
def creator_invitations(spark, sf):
    k = F.col("c_custkey").cast("string")
    rows = w.table(spark, sf, "customer").select(
        F.concat(F.lit("c_"), k).alias("handle"), F.concat(F.lit("Creator "), k).alias("display_name"), F.lit("베트남").alias("country"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "생활용품").otherwise(F.col("c_mktsegment")).alias("category"),
        F.lit("unmarked").alias("record_kind"), F.lit("").alias("account_type"), F.lit("").alias("status"),
        F.when(F.col("c_acctbal") >= 0, F.concat(k, F.lit("@x.vn"))).alias("email"))
    return flat(cr.draft_invitations(rows, product="Serum", sender="Kim"), "handle", "invitation", "missing_inputs", "cautions")


_FACTS_SQL = ", ".join(f"({w.quote(r['country'])}, {w.quote(r['continent'])}, {w.quote(r['tld'])}, {w.quote(r['name_ko'])})" for r in catalog.country_rows())


@query(f"""WITH f AS (SELECT * FROM (VALUES {_FACTS_SQL}) AS f(country, continent, tld, ko)),
  c AS (SELECT array_to_string(list_transform(string_split(n_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS country FROM customer JOIN nation ON c_nationkey = n_nationkey)
  SELECT c.country, coalesce(continent, 'custom') AS continent, coalesce(tld, '') AS tld, coalesce(ko, c.country) AS country_ko, count(*) AS customers
  FROM c LEFT JOIN f USING (country) GROUP BY ALL""")
def country_lookup(spark, sf):
    nations = w.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.initcap("n_name").alias("country"))
    rows = w.table(spark, sf, "customer").join(F.broadcast(nations), "c_nationkey").groupBy("country").agg(F.count("*").alias("customers"))  # 25 nations
    return dimensions.with_country_facts(rows).select(
        "country", "continent", "tld", dimensions.country_name_ko(F.col("country")).alias("country_ko"), "customers")


# ------------------------------------------------------------------ sources and increments


@query(f"""WITH {w.HITS} SELECT keyword, country, count(*) AS results, min(url) AS first_url FROM hits GROUP BY 1, 2""")
def saved_searches(spark, sf):
    """Stores search responses as JSON, one per query, and reads them back as rows."""
    out = scratch(spark)
    hits = w.hits(spark, sf).select("query", "country", "profile", "keyword", F.lit(0).alias("task_idx"), F.lit("r1").alias("request_id"),
                                    F.array(F.struct("title", "url", "content", F.lit(None).cast("string").alias("description"), "score")).alias("results"))
    hits.write.mode("overwrite").option("ignoreNullFields", False).json(f"{out}/responses")
    saved = readers.read_search_results(spark, f"{out}/responses", multi_line=False)
    return saved.groupBy("keyword", "country").agg(F.count("url").alias("results"), F.min("url").alias("first_url"))


@query("""SELECT 'Creator ' || c_custkey AS display_name, 'c_' || c_custkey AS handle, c_mktsegment AS category, CAST(floor(abs(c_acctbal) * 10) AS BIGINT) AS followers,
    (c_custkey % 50) / 10.0 AS engagement FROM customer""")
def creator_upload(spark, sf):
    """Stores customers as a creator file with the uploaded header names and reads it back."""
    out = scratch(spark)
    k = F.col("c_custkey").cast("string")
    w.table(spark, sf, "customer").select(
        F.concat(F.lit("Creator "), k).alias("표시명"), F.concat(F.lit("@c_"), k).alias("핸들(가상)"), F.lit("베트남").alias("국가"),
        F.col("c_mktsegment").alias("카테고리"), F.format_number(F.floor(F.abs("c_acctbal") * 10), 0).alias("팔로워"),
        F.concat(F.format_string("%.1f", (F.col("c_custkey") % 50) / 10.0), F.lit("%")).alias("참여율")).write.mode("overwrite").csv(
            f"{out}/creators", header=True)
    return readers.read_creators(spark, f"{out}/creators").select("display_name", "handle", "category", "followers", "engagement")


@query("""SELECT job_id, updated_at, progress_done FROM (SELECT CAST(user_id AS VARCHAR) AS job_id, max(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS updated_at,
    arg_max(event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || lpad(CAST(event_id AS VARCHAR), 12, '0')) AS progress_done FROM events GROUP BY 1) ORDER BY updated_at DESC, job_id DESC LIMIT 20""")
def newest_runs(spark, sf):
    """Stores run states and lists the latest state of the newest runs."""
    out = scratch(spark)
    states = w.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("job_id"), F.lit("running").alias("status"),
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("updated_at"),
        F.col("event_id").alias("progress_done"))
    sinks.append_run_status(states, f"{out}/status")
    latest = rp.newest_runs(readers.read_run_history(spark, f"{out}/status", multi_line=False))
    return latest.select("job_id", F.left("updated_at", F.lit(19)).alias("updated_at"), "progress_done")


@query(f"WITH {w.POOL} SELECT country, domain, candidate_score FROM pool")
def incremental_pool(spark, sf):
    """Streams all search results in one available-now run; a second run admits nothing new."""
    out = scratch(spark)
    w.hits(spark, sf).write.mode("overwrite").parquet(f"{out}/results")
    stream = spark.readStream.schema(spark.read.parquet(f"{out}/results").schema).parquet(f"{out}/results")
    for _ in range(2):
        incremental.incremental_pool(stream, f"{out}/pool", f"{out}/state", RULES).awaitTermination()
    return flat(spark.read.parquet(f"{out}/pool"), "country", "domain", "candidate_score")


@query("""SELECT DISTINCT regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS page_key FROM pages""")
def incremental_pages(spark, sf):
    """Streams the page table twice under two names; each page is kept once."""
    out = scratch(spark)
    pages = w.table(spark, sf, "pages")
    for part in ("a", "b"):
        pages.write.mode("overwrite").parquet(f"{out}/in/part={part}")
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in/*")
    incremental.incremental_pages(stream, f"{out}/pages", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/pages").select("page_key")


# ------------------------------------------------------------------ refill and resume

_REFILL = Campaign(countries=("United Kingdom", "France", "Germany", "Spain"), candidate_limit=64, target_per_country=20, qualified_target=12,
                   email_target=60, max_queries=60)
_ROUNDS = 3


def _refill_plan(spark, sf) -> DataFrame:
    """Every (keyword, country) query once, at the place of its first result, dealt to three rounds by its place."""
    found = w.hits(spark, sf).where("country IS NOT NULL").groupBy("country", "keyword", "query").agg(F.min("arrival").alias("place"))
    return found.withColumn("round", F.col("place") % _ROUNDS)


def _refill_sql() -> str:
    """The same rounds one after another: state, queries that run, new pairs, next state."""
    n = len(_REFILL.countries)
    site, qualified, mail = -(-_REFILL.candidate_limit // n), -(-_REFILL.qualified_target // n), _REFILL.target_per_country
    steps = [w.FILTERED, """plan AS (SELECT country, keyword, query, min(arrival) AS place, min(arrival) % 3 AS round FROM hits WHERE country IS NOT NULL GROUP BY country, keyword, query)""",
             "t0 AS (SELECT country, 0 AS analysed, 0 AS qualified, 0 AS addresses, 0 AS calls FROM plan WHERE false)", "k0 AS (SELECT country, domain FROM filtered WHERE false)"]
    for r in range(_ROUNDS):
        steps += [
            f"m{r} AS (SELECT country FROM t{r} WHERE analysed >= {site} AND qualified >= {qualified} AND addresses >= {mail} AND (SELECT sum(addresses) FROM t{r}) >= {_REFILL.email_target})",
            f"""q{r} AS (SELECT p.country, p.query, p.place FROM (SELECT plan.*, row_number() OVER (PARTITION BY plan.country ORDER BY place) + coalesce(calls, 0) AS turn FROM plan LEFT JOIN t{r} USING (country)
                WHERE round = {r} AND plan.country NOT IN (SELECT country FROM m{r})) p WHERE turn <= {-(-_REFILL.max_queries // n)}
                QUALIFY row_number() OVER (ORDER BY place) <= {_REFILL.max_queries} - (SELECT coalesce(sum(calls), 0) FROM t{r}))""",
            f"""p{r} AS (SELECT f.country, f.domain, max(points) AS score, count(*) AS hits FROM filtered f JOIN q{r} USING (query) WHERE reject_reason IS NULL
                AND NOT EXISTS (SELECT 1 FROM k{r} k WHERE k.country = f.country AND k.domain = f.domain) GROUP BY f.country, f.domain)""",
            f"k{r + 1} AS (SELECT * FROM k{r} UNION ALL SELECT country, domain FROM p{r})",
            f"""t{r + 1} AS (SELECT country, sum(analysed) AS analysed, sum(qualified) AS qualified, sum(addresses) AS addresses, sum(calls) AS calls FROM (
                SELECT * FROM t{r} UNION ALL SELECT country, 0, 0, 0, count(*) FROM q{r} GROUP BY country
                UNION ALL SELECT country, count(*), count_if(score >= 8), sum(least(hits, 2)), 0 FROM p{r} GROUP BY country) GROUP BY country)"""]
    whole = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("analysed", "qualified", "addresses", "calls"))
    rounds = " UNION ALL ".join(f"SELECT CAST({r} AS BIGINT) AS round, country, {whole} FROM t{r + 1}" for r in range(_ROUNDS))
    return f"WITH {', '.join(steps)} {rounds}"


@query(_refill_sql())
def refill_rounds(spark, sf):
    """Three batches of planned queries under goals per country, and the state after each of them.

    Sites with a score of 8 or more count as qualified, up to two results of a site as its approved addresses.
    """
    out, plan = scratch(spark), _refill_plan(spark, sf)
    hits = w.hits(spark, sf).where("country IS NOT NULL")

    def analyse(pool: DataFrame, batch_id: int) -> DataFrame:
        return pool.select("country", "domain", (F.col("candidate_score") >= 8).alias("qualified"), F.least("hits", F.lit(2)).alias("addresses"))

    for k in range(_ROUNDS):  # one micro-batch each: what has come since the last
        batch = plan.where(F.col("round") == k).select("place", "country", "keyword", "query")
        batch.write.mode("append").parquet(f"{out}/plan")
        stream = spark.readStream.schema(batch.schema).parquet(f"{out}/plan")
        refill.refill(stream, hits, analyse, f"{out}/refill", f"{out}/state", _REFILL, _REFILL.max_queries, RULES).awaitTermination()
    totals = spark.read.schema(f"{refill.TOTALS}, batch_id long").parquet(f"{out}/refill/totals")
    return flat(totals.withColumnRenamed("batch_id", "round"), "round", "country", "analysed", "qualified", "addresses", "calls")


_SITES = w.FILTERED.replace(f"{w.HOST} AS host", f"regexp_extract({w.HOST}, '([^.]+\\.[^.]+)$', 1) AS host")
_RESUMED = Campaign(industry="cosmetics", countries=("United Kingdom", "France", "Germany", "Spain"), candidate_ceiling=None)


@query(f"""WITH {_SITES}, ok AS (SELECT * FROM filtered WHERE reject_reason IS NULL AND country IS NOT NULL),
  done AS (SELECT DISTINCT country, domain FROM ok WHERE keyword < 'm' AND points >= 11),
  pool AS (SELECT country, domain, max(points) AS score FROM ok GROUP BY country, domain),
  n AS (SELECT regexp_extract({w.HOST}, '([^.]+\\.[^.]+)$', 1) AS domain, count(*) AS pages FROM pages GROUP BY 1)
  SELECT country, domain, CAST(score AS BIGINT) AS candidate_score, pages FROM pool JOIN n USING (domain) WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.country = pool.country AND d.domain = pool.domain)""")
def resumed_campaign(spark, sf):
    """The reading of a campaign's sites, with some pairs done before; then started once more without any pages, as after an
    interruption: the stages are there, so no page is read again. Whole runs that go on are tested in `tests`."""
    out = scratch(spark)
    rules = replace(RULES, host_key="registrable")
    hits = w.hits(spark, sf).where("country IS NOT NULL")
    pages = w.table(spark, sf, "pages").select("url", "html")
    _, _, chosen = buyer.discover(hits, _RESUMED, rules)
    done = di.accepted(di.prefilter_results(hits, rules)).where("keyword < 'm' AND candidate_score >= 11")
    for again in (pages, pages.where(F.lit(False))):
        stored = stages.Stages(spark, out, "all")
        candidates = stored.keep(di.pending_candidates(chosen, done.select(F.concat_ws("|", "domain", "country").alias("key"))), "candidates")
        extracted = buyer.read_sites(candidates, again, _RESUMED, stages=stored)
    read = extracted.groupBy("domain").agg(F.count("*").alias("pages"))
    return flat(candidates.join(read, "domain"), "country", "domain", "candidate_score", "pages")


# ------------------------------------------------------------------ suffix rules, lists, report sets, rounds

_SUFFIXES = ("com", "example.com", "org", "*.org", "!example.org", "// comment", "")


@query(f"""WITH h AS (SELECT url, {w.HOST} AS host FROM pages), l AS (SELECT *, string_split(host, '.') AS ls FROM h WHERE host <> ''),
  n AS (SELECT *, CASE WHEN host = 'example.org' OR host LIKE '%.example.org' THEN 1 WHEN host = 'example.com' OR host LIKE '%.example.com' THEN 2
      WHEN host LIKE '%.org' THEN 2 ELSE 1 END AS k FROM l)
  SELECT array_to_string(ls[greatest(1, len(ls) - k):], '.') AS domain, count(*) AS pages, count(DISTINCT host) AS hosts FROM n GROUP BY 1""")
def suffix_domains(spark, sf):
    """Pages per registrable domain under a list of suffix rules with a wildcard and an exception."""
    rules = spark.createDataFrame([(r,) for r in _SUFFIXES], "rule string")
    return pg.host_rollup(w.table(spark, sf, "pages"), rules).select("domain", "pages", "hosts")


@query(f"WITH {_HARVEST} SELECT url, domain, email FROM harvest WHERE regexp_matches(email, '\\.(com|org|de)$')")
def email_harvest_listed(spark, sf):
    """Addresses under a list of top-level domains: others, however shaped, are no addresses."""
    rules = replace(NO_BLOCK, tlds=("com", "org", "de"))
    docs = _documents_as_pages(spark, sf).withColumn("emails", pg.page_emails(F.col("text"), F.col("anchors"), rules))
    return flat(pg.harvest_emails(docs, rules), "url", "domain", "email")


#: Section -> the query whose rows it holds, and the columns that are compared.
_REPORT = {"companies": ("report_rows", ("record_id", "priority", "row_number")), "mailing": ("letter_status", ("company_email", "company_id", "letter_status")),
           "approved": ("approved_export", ("company_id", "company_name", "company_email", "target_country", "email_status", "email_source_url", "delivery_status")),
           "review": ("contact_review", ("company_email", "company_id", "review_reasons", "delivery_status")), "letters": ("letters", ("company_id", "recipient_email", "subject_en", "body_en")),
           "countries": ("country_summary", ("country", *_NUMBERS)), "verdicts": ("industry_verdicts", ("doc_id", "major", "priority", "quality_decision")),
           "subcategories": ("subcategory_coverage", ("subcategory", "country", "selected_products", "searched_products", "search_calls", "search_state")),
           "evidence": ("evidence_log", ("kind", "rows", "results")), "exclusions": ("exclusion_reasons", ("reason", "companies"))}

_OF_REVIEWED = ("letter_status", "approved_export", "contact_review", "letters")


def _report_sql() -> str:
    def section(name: str) -> str:
        source, columns = _REPORT[name]
        kept = " WHERE review_reasons <> ''" if name == "review" else ""
        items = ", '|', ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in columns)
        return f"SELECT {w.quote(name)} AS section, concat({items}) AS item FROM ({SQL[source]}) AS s{kept}"
    return " UNION ALL ".join(map(section, _REPORT))


@query(_report_sql())
def report_set(spark, sf):
    """All sections of a report, published as one and read back; an attempt that broke off before is not seen."""
    out, tables = scratch(spark), {}
    # Four sections, one of them twice, start from the reviewed contacts.
    reviewed = grouping.durable(_reviewed(spark, sf))
    for name, (source, columns) in _REPORT.items():
        rows = QUERIES[source](spark, sf, reviewed) if source in _OF_REVIEWED else QUERIES[source](spark, sf)
        tables[name] = (rows.where(F.col("review_reasons") != "") if name == "review" else rows).select(*columns)
    sinks.publish_report({name: tables[name] for name in ("exclusions", "evidence")}, out, "run-1")
    sinks.publish_report(tables, out, "run-1")
    found = readers.read_report(spark, out, "run-1")
    item = lambda columns: F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])
    return rp.union_records([found[name].select(F.lit(name).alias("section"), item(columns).alias("item")) for name, (_, columns) in _REPORT.items()])


_ROUND_COUNTRIES = ("United Kingdom", "France", "Germany", "Spain")
_ROUND = Campaign(countries=_ROUND_COUNTRIES, candidate_limit=180, email_target=50, target_per_country=5, qualified_target=80)
_ROUND_BUDGET = 240


def _round_queue(spark, sf) -> DataFrame:
    """Documents as queries of three industries in the order of their ids: one site each, qualified or not, with an address or not."""
    docs = w.table(spark, sf, "documents").select(
        F.col("doc_id"), w.by_value(F.col("doc_id") % 3, _MAJORS).alias("major"), w.by_value(F.col("lang"), w.LANG_COUNTRIES).alias("country"),
        (F.col("doc_id") % 2 == 0).cast("int").alias("qualified"), ((F.col("doc_id") % 3 + 2) * F.length("text") % 7 < 2).cast("int").alias("address"))
    numbered = [grouping.sequential(docs.where(F.col("major") == m), ["doc_id"], "place") for m in _MAJORS.values()]
    return rp.union_records(numbered)


_ROUND_SQL = f"""RECURSIVE d AS (SELECT doc_id, doc_id % 3 AS m, {w.sql_case('lang', w.LANG_COUNTRIES)} AS country, CAST(doc_id % 2 = 0 AS INTEGER) AS qualified,
    CAST((doc_id % 3 + 2) * length(text) % 7 < 2 AS INTEGER) AS address, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) AS place FROM documents),
  c AS MATERIALIZED (SELECT m, place, sum(qualified) OVER w AS q, sum(address) OVER w AS a, {', '.join(f"sum(CASE WHEN country = {w.quote(x)} THEN address ELSE 0 END) OVER w AS a{k}" for k, x in enumerate(_ROUND_COUNTRIES))}
    FROM d WINDOW w AS (PARTITION BY m ORDER BY place ROWS UNBOUNDED PRECEDING)
    UNION ALL SELECT m, 0, 0, 0, 0, 0, 0, 0 FROM range(3) AS r(m)),
  n AS MATERIALIZED (SELECT m, max(place) AS n FROM c GROUP BY m),
  s AS (
    SELECT 0 AS round, CAST(least(20, n0.n) AS BIGINT) AS u0, CAST(least(20, n1.n) AS BIGINT) AS u1, CAST(least(20, n2.n) AS BIGINT) AS u2, false AS x0, false AS x1, false AS x2
    FROM n n0, n n1, n n2 WHERE n0.m = 0 AND n1.m = 1 AND n2.m = 2
    UNION ALL
    SELECT round + 1, CASE WHEN pick = 0 THEN least(u0 + grant_, n0) ELSE u0 END, CASE WHEN pick = 1 THEN least(u1 + grant_, n1) ELSE u1 END, CASE WHEN pick = 2 THEN least(u2 + grant_, n2) ELSE u2 END,
      x0 OR (pick = 0 AND u0 = n0), x1 OR (pick = 1 AND u1 = n1), x2 OR (pick = 2 AND u2 = n2)
    FROM (
      SELECT s.*, least(12, {_ROUND_BUDGET} - (u0 + u1 + u2)) AS grant_, n0.n AS n0, n1.n AS n1, n2.n AS n2,
        list_max(list_filter([CASE WHEN NOT x0 THEN struct_pack(y := CAST(c0.a AS DOUBLE) / greatest(u0, 1), name := 'cosmetics', k := 0) END, CASE WHEN NOT x1 THEN struct_pack(y := CAST(c1.a AS DOUBLE) / greatest(u1, 1), name := 'food', k := 1) END,
          CASE WHEN NOT x2 THEN struct_pack(y := CAST(c2.a AS DOUBLE) / greatest(u2, 1), name := 'medical', k := 2) END], lambda z: z IS NOT NULL)).k AS pick
      FROM s JOIN c c0 ON c0.m = 0 AND c0.place = u0 JOIN c c1 ON c1.m = 1 AND c1.place = u1 JOIN c c2 ON c2.m = 2 AND c2.place = u2, n n0, n n1, n n2
      WHERE n0.m = 0 AND n1.m = 1 AND n2.m = 2 AND u0 + u1 + u2 < {_ROUND_BUDGET} AND NOT (x0 AND x1 AND x2)
        AND NOT (u0 + u1 + u2 >= {_ROUND.candidate_limit} AND c0.a + c1.a + c2.a >= {_ROUND.email_target} AND c0.q + c1.q + c2.q >= {_ROUND.qualified_target}
          AND {' AND '.join(f'c0.a{k} + c1.a{k} + c2.a{k} >= {_ROUND.target_per_country}' for k in range(4))})) WHERE pick IS NOT NULL),
  r AS (SELECT round, unnest([0, 1, 2]) AS m, unnest([u0, u1, u2]) AS u, unnest([x0, x1, x2]) AS x FROM s)"""


@query(f"""WITH {_ROUND_SQL} SELECT CAST(round AS BIGINT) AS round, (['cosmetics', 'food', 'medical'])[r.m + 1] AS major, CAST(u AS BIGINT) AS queries, CAST(a AS BIGINT) AS sendable,
    CAST(u AS BIGINT) AS analysed, CAST(q AS BIGINT) AS qualified, x AS exhausted FROM r JOIN c ON c.m = r.m AND c.place = u""")
def campaign_rounds(spark, sf):
    """Base round of three industries, then rounds for the one with the best yield until the goals are met or the budget is spent."""
    queue = grouping.durable(_round_queue(spark, sf))
    majors = spark.createDataFrame([(m, k) for k, m in _MAJORS.items()], "major string, position long")

    def execute(grants: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
        ran = queue.join(F.broadcast(grants), "major").where((F.col("place") > F.col("before")) & (F.col("place") <= F.col("before") + F.col("granted")))  # one row per industry
        found = ran.groupBy("major").agg(F.count("*").alias("queries"), F.sum("address").alias("sendable"), F.count("*").alias("analysed"), F.sum("qualified").alias("qualified"))
        return found, ran.where("country IS NOT NULL").groupBy("country", "major").agg(F.sum("address").alias("addresses"))

    states = rounds.run_rounds(spark, majors, execute, f"{scratch(spark)}/rounds", _ROUND, _ROUND_BUDGET)
    return flat(states, "round", "major", "queries", "sendable", "analysed", "qualified", "exhausted")


@query(f"""WITH {w.OWNERS}{w.VARIANTS[len(w.RECORDS):]},
  mine AS (SELECT o.owner_id, o.r, p.* EXCLUDE (record_id) FROM owned o JOIN placed p USING (record_id) WHERE o.quality_decision <> 'excluded' OR o.record_id = o.owner_id),
  addresses AS (SELECT * FROM mine QUALIFY row_number() OVER (PARTITION BY owner_id, company_email ORDER BY source_priority DESC, r, position) = 1),
  companies AS (SELECT * FROM owned QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY r) = 1),
  listed AS (SELECT a.company_email, a.email_source_url, a.email_status, c.company_id, c.priority, c.quality_decision, c.industry_score FROM addresses a JOIN companies c USING (owner_id)),
  ok AS (SELECT * FROM listed WHERE (priority IN ('A', 'B', 'C', 'strategic') OR (quality_decision = 'other_country' AND industry_score > 0)
      OR (quality_decision = 'reference' AND industry_score > 0 AND email_status = 'official')) AND email_status IN ('official', 'verified', 'external', 'needs_check') AND quality_decision <> 'excluded'),
  first AS (SELECT company_email, company_id, priority FROM ok QUALIFY row_number() OVER (PARTITION BY company_email ORDER BY {_LIST_RANK}, company_id) = 1),
  n AS (SELECT company_email, count(DISTINCT email_source_url) AS source_count FROM ok GROUP BY 1),
  m AS (SELECT company_email, count(DISTINCT company_id) AS related_company_count FROM listed GROUP BY 1)
  SELECT company_email, company_id, priority, source_count, related_company_count FROM first JOIN n USING (company_email) JOIN m USING (company_email)""")
def campaign_contacts(spark, sf):
    """The contact list of a campaign: records merged into companies, with every address of each company."""
    records = w.records(spark, sf)
    owned = co.assign_owners(records)
    contacts = buyer.company_contacts(co.merge_owned(owned, records.columns), co.company_addresses(owned))
    return flat(contacts, "company_email", "company_id", "priority", "source_count", "related_company_count")
