"""The given tables read as rows of this domain, in Spark and in SQL side by side.

Every function returns a DataFrame derived from the tables in ``sf``; the constant with the matching
name holds the same rows as SQL common table expressions.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leadloom.config import ResultRules
from leadloom.functions import text as t


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ------------------------------------------------------------------ pages as search results

LANG_COUNTRIES = {"en": "United Kingdom", "fr": "France", "de": "Germany", "es": "Spain"}


def by_value(column: Column, mapping: dict, default=None) -> Column:
    chosen = F.lit(default)
    for key, value in mapping.items():
        chosen = F.when(column == key, F.lit(value)).otherwise(chosen)
    return chosen


def sql_case(column: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {quote(k)} THEN {quote(x) if isinstance(x, str) else x}" for k, x in mapping.items())
    return f"CASE {column} {whens} ELSE {default} END"


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """Search results: one per page; the first host label is the keyword, the page language the country."""
    pages = table(spark, sf, "pages")
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    lang = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    country = by_value(lang, LANG_COUNTRIES)
    keyword = F.split_part(host, F.lit("."), F.lit(1))
    return pages.select(
        F.col("page_id").alias("arrival"), country.alias("country"), keyword.alias("keyword"),
        F.concat_ws(" ", keyword, country).alias("query"),
        F.when(F.col("url").startswith("https"), "official").otherwise("local_market").alias("profile"),
        F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), "url",
        F.regexp_replace("html", "(?s)<[^>]*>", " ").alias("content"), ((F.col("page_id") % 10) / 10.0).alias("score"))


HITS = f"""hits AS (
  SELECT page_id AS arrival, country, keyword, keyword || ' ' || country AS query,
    CASE WHEN url LIKE 'https%' THEN 'official' ELSE 'local_market' END AS profile, title, url, content, score
  FROM (SELECT page_id, url, {sql_case("regexp_extract(html, '<html lang=\"([a-z]+)\"', 1)", LANG_COUNTRIES)} AS country,
      split_part(regexp_extract(url, '^https?://([^/]+)', 1), '.', 1) AS keyword,
      regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
      regexp_replace(html, '(?s)<[^>]*>', ' ', 'g') AS content, (page_id % 10) / 10.0 AS score FROM pages))"""

RULES = ResultRules(
    industry_terms=("ouble", "stand", "ciónes", "eaux"), buyer_terms=("ingth", "keit", "elle ", "distributeur"),
    content_terms=("blend", "hereed", "thinha", "ungen", "queque"),
    blocked_hosts=("spam-farm.example.org", "therou.example.com"), source_hosts=("ththhe.example.com", "ththed.example.org"),
    path_terms=("/en/1", "/es/2"), title_terms=("erre", "öber", "%%%"), host_key="host")

HOST = "regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\\.', '')"


def contains_any(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains({column}, {quote(x.lower())})" for x in terms) + ")"


def count_contains(column: str, terms) -> str:
    return "(" + " + ".join(f"CAST(contains({column}, {quote(x.lower())}) AS BIGINT)" for x in terms) + ")"


ALIASES = {"United Kingdom": ("united kingdom", "uk", "british", "england", "london"), "France": ("france", "french", "paris"),
           "Germany": ("germany", "german", "deutschland"), "Spain": ("spain", "spanish", "españa")}
LOCAL = {"United Kingdom": ("importer", "distributor"), "France": ("importateur", "distributeur", "grossiste", "revendeur", "marques distribuées"),
         "Germany": ("importeur", "vertrieb", "großhandel", "händler", "warenimport"), "Spain": ("importador", "distribuidor")}


def _per_country(table_: dict, build) -> str:
    return "CASE country " + " ".join(f"WHEN {quote(c)} THEN {build(x)}" for c, x in table_.items()) + " END"


def _buyer_hits() -> str:
    fixed = count_contains("txt", RULES.buyer_terms)
    extra = {c: [x for x in words if x not in RULES.buyer_terms] for c, words in LOCAL.items()}
    return f"({fixed} + {_per_country(extra, lambda words: count_contains('txt', words))})"


FILTERED = HITS + f""",
prepared AS (SELECT *, {HOST} AS host, lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)) AS pth,
    lower(title) AS low_title, lower(title || ' ' || content || ' ' || url) AS txt FROM hits),
counted AS (SELECT *, {count_contains('txt', RULES.industry_terms)} AS ind, {_buyer_hits()} AS buy,
    {count_contains('txt', RULES.content_terms)} AS con, {_per_country(ALIASES, lambda a: contains_any('txt', a))} AS chit,
    CASE WHEN host IN ('spam-farm.example.org', 'therou.example.com') OR host LIKE '%.spam-farm.example.org'
           OR host LIKE '%.therou.example.com' THEN 'blocked_host'
         WHEN host IN ('ththhe.example.com', 'ththed.example.org') THEN 'directory_or_media'
         WHEN regexp_matches(pth, '\\.(pdf|docx?|xlsx?|pptx?)($|[?#])') THEN 'document_file'
         WHEN {contains_any('pth', RULES.path_terms)} THEN 'non_company_path'
         WHEN {contains_any('low_title', RULES.title_terms)} THEN 'non_company_title' END AS early FROM prepared),
filtered AS (SELECT arrival, country, keyword, query, profile, title, url, content, host AS domain,
    coalesce(early, CASE WHEN ind = 0 AND buy = 0 THEN 'no_evidence'
      WHEN con >= 2 AND NOT (ind > 0 AND buy > 0) THEN 'content_page' END) AS reject_reason,
    greatest(0, least(8, 3 * ind) + least(8, 3 * buy) + CASE WHEN chit THEN 3 ELSE 0 END
      - CASE WHEN chit THEN 0 ELSE 3 END - CASE WHEN ind = 0 THEN 4 ELSE 0 END - CASE WHEN buy = 0 THEN 4 ELSE 0 END
      + CAST(round_even(score * 5, 0) AS BIGINT) + CASE WHEN profile = 'official' THEN 3 ELSE 2 END - 3 * con) AS points
  FROM counted)"""

POOL = FILTERED + """,
ok AS (SELECT * FROM filtered WHERE reject_reason IS NULL),
best AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY country, domain ORDER BY points DESC, arrival) = 1),
urls_seen AS (SELECT country, domain, url, min(arrival) AS a FROM ok GROUP BY ALL),
urls_kept AS (SELECT country, domain, string_agg(url, '|' ORDER BY a, url) AS alternate_urls FROM (
    SELECT * FROM urls_seen QUALIFY row_number() OVER (PARTITION BY country, domain ORDER BY a, url) <= 6) GROUP BY ALL),
sources AS (SELECT country, domain, string_agg(profile, '|' ORDER BY a) AS discovery_source, sum(n) AS hits FROM (
    SELECT country, domain, profile, min(arrival) AS a, count(*) AS n FROM ok GROUP BY ALL) GROUP BY ALL),
pool AS (SELECT b.country, b.domain, b.url, b.keyword, b.query, b.points AS candidate_score, b.arrival,
    s.discovery_source, u.alternate_urls, CAST(s.hits AS BIGINT) AS hits
  FROM best b JOIN urls_kept u USING (country, domain) JOIN sources s USING (country, domain))"""


# ------------------------------------------------------------------ documents as company texts

WORDS = {
    "thble": "importer", "thtion": "exclusive distributor", "thing": "cosmetics", "attion": "skincare",
    "eriner": "our factory", "erble": "wholesale", "ertion": "based in france", "oning": "contact germany",
    "ering": "magazine", "ontion": "law firm lawyers", "retion": "beauty clinic", "antion": "made in japan",
    "onble": "freight forwarding customs broker", "reing": "travel guide tourism board", "aning": "not a distributor",
    "heble": "nhà nhập khẩu", "nicht": "kontakt", "edble": "impressum unternehmen", "inble": "association trade exhibition",
    "anble": "our brands brand portfolio", "reble": "booking software pos software", "ention": "cosmetic packaging",
    "ingre": "beauty equipment", "heing": "add to cart shop now", "estion": "authorized dealer", "queque": "société",
    "étion": "distributeur", "edtion": "cleanroom", "hation": "venture capital investment fund",
    "oution": "business consulting company registration", "intion": "online casino", "ating": "marketplace supplier database",
    "hetion": "nail", "des": "importateur", "und": "office in germany", "les": "paris store", "haing": "our brand",
}
NAMES = {"src0": "Alpha Trading", "src1": "Beta Law", "src2": "Gamma Capital", "src3": "Delta Clinic", "src4": "Blue Factory",
         "src5": "Zeta Tours", "src6": "Eta Importer", "src7": "Theta Software", "src8": "Iota Association",
         "src9": "Industrial Spring Fair", "src10": "Kappa Foods", "src11": "L'Oréal"}
DOC_COUNTRIES = {"en": "Vietnam", "fr": "France", "de": "Germany", "es": "Spain"}
DOC_TLDS = {"en": ".vn", "fr": ".fr", "de": ".com", "es": ".es"}


def company_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as company pages; frequent words stand for terms of this domain."""
    docs = table(spark, sf, "documents")
    text = t.swap_words(F.concat(F.lit(" "), F.lower("text"), F.lit(" ")), WORDS)
    return docs.select(
        "doc_id", F.coalesce(by_value(F.col("source"), NAMES), F.concat(F.lit("Company "), "source")).alias("company_name"),
        by_value(F.col("lang"), DOC_COUNTRIES).alias("target_country"),
        F.concat(F.lit("https://www."), "source", by_value(F.col("lang"), DOC_TLDS), F.lit("/")).alias("website"),
        text.alias("identity_text"), F.lit("").alias("discovery_url"))


def _replaced() -> str:
    text = "' ' || lower(text) || ' '"
    for word, phrase in WORDS.items():
        text = f"replace({text}, {quote(f' {word} ')}, {quote(f' {phrase} ')})"
    return text


COMPANY_TEXTS = f"""texts AS (SELECT doc_id, coalesce({sql_case('source', NAMES)}, 'Company ' || source) AS company_name,
    {sql_case('lang', DOC_COUNTRIES)} AS target_country,
    'https://www.' || source || {sql_case('lang', DOC_TLDS)} || '/' AS website, {_replaced()} AS identity_text FROM documents)"""


# ------------------------------------------------------------------ customers and suppliers as company records

SEGMENTS = {"AUTOMOBILE": "A", "BUILDING": "B", "FURNITURE": "C", "HOUSEHOLD": "strategic", "MACHINERY": "excluded"}
DECISIONS = {"A": "qualified", "B": "qualified", "C": "review", "strategic": "strategic", "excluded": "excluded",
             "reference": "reference", "other_country": "other_country"}


def _parties(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("k"), F.col("c_name").alias("nm"), F.col("c_nationkey").alias("nk"),
        F.col("c_acctbal").alias("bal"), by_value(F.col("c_mktsegment"), SEGMENTS).alias("priority"), F.lit(0).alias("o"))
    suppliers = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("k"), F.col("s_name").alias("nm"), F.col("s_nationkey").alias("nk"),
        F.col("s_acctbal").alias("bal"), F.when(F.col("s_acctbal") > 5000, "reference").otherwise("other_country").alias("priority"),
        F.lit(1).alias("o"))
    # A file of one row group is one task, however long; the rows are few bytes here and grow tenfold in `records`.
    rows = customers.unionByName(suppliers)
    return rows.repartition(*rows.columns)


PARTIES = f"""parties AS (
  SELECT c_custkey AS k, c_name AS nm, c_nationkey AS nk, c_acctbal AS bal, {sql_case('c_mktsegment', SEGMENTS)} AS priority, 0 AS o FROM customer
  UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal,
    CASE WHEN s_acctbal > 5000 THEN 'reference' ELSE 'other_country' END, 1 FROM supplier)"""

PURPOSES = ("sales", "info", "hr", "export", "support", "noreply", "legal")


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Company records with shared sites, names and addresses."""
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("nation"))
    p = _parties(spark, sf).join(F.broadcast(nations), "nk")  # 25 nations
    k = F.col("k")
    local = by_value(k % 7, dict(enumerate(PURPOSES)))
    site = F.concat(F.lit("shop"), F.floor(k / 5).cast("string"), F.lit(".com"))
    mail = F.when(k % 4 == 3, None).otherwise(F.concat(local, F.floor(k / 8).cast("string"), F.lit("@"),
                                              F.when(k % 3 == 0, F.lit("gmail.com")).otherwise(site)))
    page = by_value(k % 5, {0: "/contact", 1: "/about", 2: "/partner", 3: "/news/1", 4: "/"})
    extra = F.concat(F.lit("desk"), F.floor(k / 6).cast("string"), F.lit("@"), site)
    address = lambda email, url: F.struct(
        email.alias("company_email"), url.alias("email_source_url"), F.lit("official").alias("email_status"),
        F.lit("same_domain").alias("email_domain_status"), F.lit("A").alias("email_grade"),
        F.lit("general").alias("email_purpose"), F.lit(None).cast("int").alias("verification_score"))
    root = F.concat(F.lit("https://www."), site)
    website = F.when(k % 11 == 0, F.lit("")).otherwise(F.concat(root, F.lit("/")))
    return p.select(
        F.concat(F.col("o").cast("string"), F.lit("-"), k.cast("string")).alias("record_id"),
        (k * 2 + F.col("o")).alias("arrival"), F.concat(F.lit("CMP-"), F.floor(k / 2).cast("string")).alias("company_id"),
        F.concat(F.lit("Trade House "), (k % 37).cast("string")).alias("company_name"), F.lit("").alias("brand_name"),
        F.col("nation").alias("target_country"), F.when(F.col("bal") > 0, F.col("nation")).alias("verified_country"),
        website.alias("website"), "priority", by_value(F.col("priority"), DECISIONS).alias("quality_decision"),
        (k % 4).cast("int").alias("country_score"), (k % 3).cast("int").alias("industry_score"),
        ((k + 1) % 4).cast("int").alias("buyer_role_score"), F.floor(F.abs("bal") % 101).cast("int").alias("relevance_score"),
        (k % 23).cast("int").alias("candidate_score"), F.lit("importer").alias("buyer_type"),
        by_value(k % 3, {0: "homepage_only", 1: "homepage_complete", 2: "deep_contact"}).alias("collection_depth"),
        F.split(by_value(k % 4, {0: "low_relevance", 1: "media; agency", 2: "", 3: "legal;media"}), ";").alias("exclusion_reasons"),
        mail.alias("company_email"), F.when(mail.isNotNull(), F.concat(root, page)).alias("email_source_url"),
        F.when(mail.isNull(), "none").when(k % 9 == 4, "external").otherwise("official").alias("email_status"),
        F.when(mail.isNull(), "none").when(k % 3 == 0, "public_mailbox").otherwise("same_domain").alias("email_domain_status"),
        F.when(mail.isNull(), "D").otherwise("A").alias("email_grade"), F.lit(None).cast("string").alias("email_purpose"),
        F.lit(None).cast("int").alias("verification_score"),
        F.array(address(extra, F.concat(root, F.lit("/contact"))),
                address(mail, F.concat(root, F.lit("/partner/list")))).alias("email_candidates"))


_LOCAL = "CASE k % 7 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(PURPOSES)) + " END"
RECORDS = PARTIES + f""",
base AS (SELECT *, 'shop' || (k // 5) || '.com' AS site, 'https://www.shop' || (k // 5) || '.com' AS root FROM parties JOIN nation ON nk = n_nationkey),
mailed AS (SELECT *, CASE WHEN k % 4 = 3 THEN NULL ELSE {_LOCAL} || (k // 8) || '@' ||
    CASE WHEN k % 3 = 0 THEN 'gmail.com' ELSE site END END AS mail FROM base),
records AS (SELECT o || '-' || k AS record_id, k * 2 + o AS arrival, 'CMP-' || (k // 2) AS company_id,
    'Trade House ' || (k % 37) AS company_name, n_name AS target_country, CASE WHEN bal > 0 THEN n_name END AS verified_country,
    CASE WHEN k % 11 = 0 THEN '' ELSE root || '/' END AS website, priority, {sql_case('priority', DECISIONS)} AS quality_decision,
    k % 4 AS country_score, k % 3 AS industry_score, (k + 1) % 4 AS buyer_role_score,
    CAST(floor(abs(bal) % 101) AS BIGINT) AS relevance_score, k % 23 AS candidate_score,
    CASE k % 3 WHEN 0 THEN 'homepage_only' WHEN 1 THEN 'homepage_complete' ELSE 'deep_contact' END AS collection_depth,
    CASE k % 4 WHEN 0 THEN 'low_relevance' WHEN 1 THEN 'media; agency' WHEN 2 THEN '' ELSE 'legal;media' END AS reasons,
    mail AS company_email, CASE WHEN mail IS NOT NULL THEN root || CASE k % 5 WHEN 0 THEN '/contact' WHEN 1 THEN '/about'
      WHEN 2 THEN '/partner' WHEN 3 THEN '/news/1' ELSE '/' END END AS email_source_url,
    CASE WHEN mail IS NULL THEN 'none' WHEN k % 9 = 4 THEN 'external' ELSE 'official' END AS email_status,
    CASE WHEN mail IS NULL THEN 'none' WHEN k % 3 = 0 THEN 'public_mailbox' ELSE 'same_domain' END AS email_domain_status,
    CASE WHEN mail IS NULL THEN 'D' ELSE 'A' END AS email_grade, 'desk' || (k // 6) || '@' || site AS extra, root, k FROM mailed)"""

# Priority of a source page, as in the engine but only for the paths that occur here.
SOURCE_RANK = """CASE WHEN contains(email_source_url, '/partner') THEN 5 WHEN contains(email_source_url, '/contact') THEN 4
  WHEN contains(email_source_url, '/about') THEN 2 WHEN contains(email_source_url, '/news') THEN 0 ELSE 1 END"""

VARIANTS = RECORDS + f""",
every AS (
  SELECT record_id, 0 AS pos, company_email AS e, email_source_url, email_status, email_domain_status, email_grade, NULL AS purpose FROM records WHERE company_email IS NOT NULL
  UNION ALL SELECT record_id, 1, extra, root || '/contact', 'official', 'same_domain', 'A', 'general' FROM records
  UNION ALL SELECT record_id, 2, company_email, root || '/partner/list', 'official', 'same_domain', 'A', 'general' FROM records WHERE company_email IS NOT NULL),
variants AS (SELECT record_id, e AS company_email, email_source_url, email_status, email_domain_status, email_grade, purpose,
    {SOURCE_RANK} AS source_priority, min(pos) OVER (PARTITION BY record_id, e) AS pos0 FROM every
  QUALIFY row_number() OVER (PARTITION BY record_id, e ORDER BY {SOURCE_RANK} DESC, pos) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY pos0) - 1 AS position FROM variants)"""

PURPOSE = """CASE WHEN contains(split_part(company_email, '@', 1), 'hr') THEN 'recruiting' WHEN contains(split_part(company_email, '@', 1), 'sales') THEN 'b2b_sales'
  WHEN contains(split_part(company_email, '@', 1), 'export') THEN 'b2b_sales' WHEN contains(split_part(company_email, '@', 1), 'info') THEN 'general'
  WHEN contains(split_part(company_email, '@', 1), 'support') THEN 'customer_service' WHEN contains(split_part(company_email, '@', 1), 'legal') THEN 'legal' ELSE 'unknown' END"""

# Total order of records, largest first.
RANK = """CASE priority WHEN 'A' THEN 7 WHEN 'B' THEN 6 WHEN 'strategic' THEN 5 WHEN 'C' THEN 4 WHEN 'other_country' THEN 3
    WHEN 'reference' THEN 2 WHEN 'excluded' THEN 0 ELSE 1 END DESC, verified_country IS NOT NULL DESC, country_score DESC,
  relevance_score DESC, company_email IS NOT NULL DESC, candidate_score DESC, company_id DESC, target_country DESC, arrival"""

OWNERS = RECORDS + f""",
ranked AS (SELECT *, row_number() OVER (ORDER BY {RANK}) AS r,
    CASE WHEN website = '' THEN '#' || record_id ELSE root END AS host_key, lower(replace(company_name, ' ', '')) AS nkey,
    CASE WHEN company_email IS NULL THEN '' ELSE split_part(company_email, '@', 2) END AS mhost FROM records),
led AS (SELECT *, first_value(record_id) OVER (PARTITION BY host_key ORDER BY r) AS head FROM ranked),
heads AS (SELECT *, CASE WHEN mhost <> '' THEN first_value(record_id) OVER (PARTITION BY mhost <> '', lower(target_country), nkey, mhost ORDER BY r)
    ELSE record_id END AS owner_id FROM led WHERE record_id = head),
owned AS (SELECT l.*, h.owner_id FROM led l JOIN heads h ON l.head = h.record_id)"""


# ------------------------------------------------------------------ orders as executed searches

def tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Each order is a planned query of the customer's nation; orders run in order of their key."""
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"))
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return (table(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .join(F.broadcast(nations), "c_nationkey")  # 25 nations
            .select("country", F.col("o_orderkey").cast("long").alias("task_idx")))


def found_domains(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of an order are the domains its query found."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task_idx"), F.col("l_partkey").cast("string").alias("domain"))
    return lines.join(tasks(spark, sf), "task_idx")


TASKS = """tasks AS (SELECT n_name AS country, o_orderkey AS task_idx FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey),
found AS (SELECT country, task_idx, CAST(l_partkey AS VARCHAR) AS domain FROM lineitem JOIN tasks ON l_orderkey = task_idx)"""


# ------------------------------------------------------------------ conversations as profile search results

PROFILE_WORDS = {"the": "beauty creator", "of": "skincare", "and": "i'm", "is": "12.5k followers", "la": "tokyo",
                 "de": "hanoi", "und": "official store", "der": "🇩🇪", "that": "collab", "le": "85,000 followers",
                 "to": "mai@shop.vn", "nicht": "wholesale", "for": "🇻🇳"}


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of a conversation are sightings of one profile."""
    text = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    for word, phrase in PROFILE_WORDS.items():
        text = F.replace(text, F.lit(f" {word} "), F.lit(f" {phrase} "))
    conv, turn = F.col("conv_id"), F.col("turn")
    url = (F.when((conv + turn) % 13 == 0, F.concat(F.lit("https://www.instagram.com/p/"), conv.cast("string")))
           .otherwise(F.concat(F.lit("https://www.instagram.com/User."), F.floor(conv / 3).cast("string"), F.lit("/"))))
    return table(spark, sf, "conversations").select(
        (conv * 100 + turn).alias("arrival"), turn.cast("int").alias("task_idx"), F.concat(F.lit("beauty "), "role").alias("query"),
        url.alias("url"), F.concat(F.lit("Profile "), conv.cast("string"), F.lit(" • Instagram")).alias("title"), text.alias("content"))


def _profile_text() -> str:
    text = "' ' || lower(text) || ' '"
    for word, phrase in PROFILE_WORDS.items():
        text = f"replace({text}, {quote(f' {word} ')}, {quote(f' {phrase} ')})"
    return text


PROFILES = f"""raw AS (SELECT conv_id * 100 + turn AS arrival, 'beauty ' || role AS query,
    CASE WHEN (conv_id + turn) % 13 = 0 THEN NULL ELSE 'user.' || (conv_id // 3) END AS handle,
    'Profile ' || conv_id || ' • Instagram' AS title, {_profile_text()} AS content FROM conversations),
plain AS (SELECT *, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS bio,
    title || ' ' || trim(regexp_replace(content, '\\s+', ' ', 'g')) || ' ' || coalesce(handle, '') AS body FROM raw)"""
