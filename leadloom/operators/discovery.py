"""From search results to a ranked pool of company domains."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from leadloom.config import DISCOVERY_SOURCES, ECOSYSTEM, LOCAL_MARKET, OFFICIAL, Campaign, ResultRules
from leadloom.functions import grouping, ids, numbers, text as t, urls, vocabulary as v
from leadloom.sources.dimensions import with_country_facts

DOCUMENT_PATH = r"\.(pdf|docx?|xlsx?|pptx?)(?:$|[?#])"


def host_key(host: Column, mode: str) -> Column:
    return urls.registrable(host) if mode == "registrable" else host


def prefilter_results(results: DataFrame, rules: ResultRules = ResultRules(),
                      country_facts: DataFrame | None = None) -> DataFrame:
    """Give every search result a `reject_reason`, or a `candidate_score` when it is accepted.

    The first reason that applies wins. Terms are only searched where no cheaper reason applied.
    """
    base = with_country_facts(results, facts=country_facts).withColumns({
        "host": urls.host("url"),
        "url_path": urls.path("url"),
        "lower_title": F.lower(F.coalesce("title", F.lit(""))),
        "lower_text": F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")),
                                          F.coalesce("url", F.lit("")))),
    }).withColumn("domain", host_key(F.col("host"), rules.host_key))
    path, text = F.col("url_path"), F.col("lower_text")
    early = (
        F.when((F.col("host") == "") | urls.under_any_host(F.col("domain"), rules.blocked_hosts), "blocked_host")
        .when(F.col("domain").isin(*rules.source_hosts), "directory_or_media")
        .when(path.rlike(DOCUMENT_PATH), "document_file")
        .when(t.has_substring("url_path", rules.path_terms), "non_company_path")
        .when(t.has_substring("lower_title", rules.title_terms), "non_company_title"))
    local_hits = F.filter(F.transform("local_buyer", F.lower), lambda term: text.contains(term))
    open_row = F.col("early_reason").isNull()
    counted = base.withColumn("early_reason", early).withColumns({
        "industry_hits": F.when(open_row, F.size(t.substring_hits("lower_text", rules.industry_terms))),
        "buyer_hits": F.when(open_row, F.size(F.array_distinct(
            F.concat(t.substring_hits("lower_text", rules.buyer_terms), local_hits)))),
        "content_hits": F.when(open_row, F.size(t.substring_hits("lower_text", rules.content_terms))),
        "country_hit": F.when(open_row, F.exists("aliases", lambda a: (a != "") & text.contains(a))),
    })
    counted = grouping.settle(counted, "early_reason")
    industry, buyer, content = F.col("industry_hits"), F.col("buyer_hits"), F.col("content_hits")
    late = (F.when((industry == 0) & (buyer == 0), "no_evidence")
            .when((content >= 2) & ~((industry > 0) & (buyer > 0)), "content_page"))
    reason = F.coalesce("early_reason", late)
    tld_hit = urls.under_tld(F.col("host"), F.col("tld"))
    suffix = F.substring_index("host", ".", -1)
    foreign = ((F.col("tld") != "") & F.col("host").contains(".") & suffix.isin(*rules.country_tlds)
               & (suffix != F.col("tld")))
    country_hit = F.col("country_hit")
    points = (
        F.least(F.lit(8), 3 * industry) + F.least(F.lit(8), 3 * buyer) + F.when(country_hit, 3).otherwise(0)
        + F.when(tld_hit, 4).otherwise(0) - F.when(foreign, 8).otherwise(0)
        - F.when(country_hit | tld_hit, 0).otherwise(3)
        - F.when(industry == 0, 4).otherwise(0) - F.when(buyer == 0, 4).otherwise(0)
        + numbers.half_even(F.coalesce("score", F.lit(0.0)) * 5)
        + F.when(F.col("profile") == OFFICIAL, 3).when(F.col("profile") == LOCAL_MARKET, 2).otherwise(1)
        - 3 * content)
    return (counted.withColumn("reject_reason", reason)
            .withColumn("candidate_score", F.when(F.col("reject_reason").isNull(), F.greatest(points, F.lit(0))))
            .select(*results.columns, "host", "domain", "industry_hits", "buyer_hits", "content_hits",
                    "reject_reason", "candidate_score"))


def accepted(filtered: DataFrame) -> DataFrame:
    return filtered.where(F.col("reject_reason").isNull())


def mark_ecosystem_sources(results: DataFrame, rules: ResultRules = ResultRules(), terms=v.ECOSYSTEM_TERMS,
                           paths=v.ECOSYSTEM_PATHS, titles=v.ECOSYSTEM_TITLES) -> DataFrame:
    """Flag exhibition and association pages, whose links are read instead of the page itself."""
    title = F.lower(F.coalesce("title", F.lit("")))
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))
    in_industry = t.has_substring(text, rules.industry_terms)
    many = F.size(t.substring_hits(text, terms)) >= 2
    source = many | t.has_substring(urls.path("url"), paths) | t.has_substring(title, titles)
    return results.withColumn("is_ecosystem_source",
                              F.when(F.col("profile") == ECOSYSTEM, in_industry & source).otherwise(F.lit(False)))


def split_ecosystem_sources(results: DataFrame, rules: ResultRules = ResultRules()) -> tuple[DataFrame, DataFrame]:
    """(company results, source pages)."""
    marked = mark_ecosystem_sources(results, rules)
    flag = F.col("is_ecosystem_source")
    return marked.where(~flag).drop("is_ecosystem_source"), marked.where(flag).drop("is_ecosystem_source")


def drop_blocked_hosts(df: DataFrame, blocked, url: str = "url", mode: str = "registrable") -> DataFrame:
    """Remove rows whose host, or a parent domain of it, is blocked.

    ``blocked`` is a list, or a DataFrame with a column ``host`` of any size.
    """
    keyed = df.withColumn("_host", host_key(urls.host(url), mode))
    if not isinstance(blocked, DataFrame):
        return keyed.where(~urls.under_any_host(F.col("_host"), blocked)).drop("_host")
    labels = F.split("_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(
        F.slice(labels, n, F.size(labels)), "."))
    # Hosts are reduced to one row each first: a host with a third of all pages costs one row here.
    listed = (keyed.select("_host").distinct().withColumn("_suffix", F.explode(suffixes))
              .join(blocked.select(F.col("host").alias("_suffix")), "_suffix", "left_semi").select("_host").distinct())
    return keyed.join(listed, "_host", "left_anti").drop("_host")


def pool_candidates(accepted_results: DataFrame, alternates: int = 6) -> DataFrame:
    """One row per country and domain: the best-scored result, earliest on a tie.

    `discovery_source` lists the profiles and `alternate_urls` the first URLs, in arrival order.
    """
    keys = ["country", "domain"]
    carried = ["arrival", "url", "keyword", "query", "title", "content", "candidate_score"]
    # Step 1 folds copies of one URL, so the later steps see one row per URL.
    first_seen = {f"_first_{p}": F.min(F.when(F.col("profile") == p, F.col("arrival"))) for p in DISCOVERY_SOURCES}
    per_url = accepted_results.groupBy(*keys, "url").agg(
        grouping.best_row(carried, -F.col("candidate_score"), F.col("arrival")).alias("_best"),
        F.min("arrival").alias("first_arrival"), F.count("*").alias("_hits"),
        *[value.alias(name) for name, value in first_seen.items()])
    pool = per_url.groupBy(*keys).agg(
        F.min_by("_best", F.struct(-F.col("_best.candidate_score"), F.col("_best.arrival"))).alias("_best"),
        F.sum("_hits").alias("hits"), *[F.min(name).alias(name) for name in first_seen])
    urls_kept = grouping.first_k_array(per_url, keys, ["first_arrival", "url"], alternates, "url", "alternate_urls")
    seen = F.array(*[F.struct(F.col(f"_first_{p}").alias("at"), F.lit(p).alias("source")) for p in DISCOVERY_SOURCES])
    sources = F.transform(F.array_sort(F.filter(seen, lambda s: s["at"].isNotNull())), lambda s: s["source"])
    best = F.col("_best")
    return pool.join(urls_kept, keys).select(
        *keys, best.url.alias("url"), urls.root_url(best.url).alias("root_url"), best.keyword.alias("keyword"),
        best.query.alias("query"), best.title.alias("title"), best.content.alias("description"),
        sources.alias("discovery_source"), best.url.alias("discovery_url"),
        best.candidate_score.alias("candidate_score"), best.arrival.alias("arrival"), "alternate_urls", "hits")


def add_directory_links(pool: DataFrame, links: DataFrame) -> DataFrame:
    """Add companies linked from ecosystem pages: known domains gain the source, new ones score 4.

    ``links``: country, root_url, source_url, keyword, query, content, arrival.
    """
    keys = ["country", "domain"]
    found = links.withColumn("domain", urls.registrable_domain("root_url")).groupBy(*keys).agg(
        grouping.best_row(["arrival", "root_url", "source_url", "keyword", "query", "content"],
                          F.col("arrival"), F.col("root_url")).alias("_link"))
    link = F.col("_link")
    both = pool.join(found, keys, "full_outer")
    known = F.col("url").isNotNull()
    with_source = F.when(link.isNull(), F.col("discovery_source")).otherwise(
        F.array_distinct(F.concat(F.coalesce("discovery_source", F.array().cast("array<string>")),
                                  F.array(F.lit(ECOSYSTEM)))))

    def pick(name: str, value) -> Column:
        return F.when(known, F.col(name)).otherwise(value).alias(name)

    return both.select(
        *keys, pick("url", link.root_url), pick("root_url", link.root_url), pick("keyword", link.keyword),
        pick("query", link.query), pick("title", F.lit("")), pick("description", link.content),
        with_source.alias("discovery_source"), pick("discovery_url", link.source_url),
        pick("candidate_score", F.lit(4)), pick("arrival", link.arrival),
        pick("alternate_urls", F.array(link.root_url)), F.coalesce("hits", F.lit(0)).alias("hits"))


def top_candidates(pool: DataFrame, per_country: int, overall: int | None, countries: Sequence[str] = ()) -> DataFrame:
    """Best candidates of each country by score, official ones first on a tie, then the overall limit.

    Countries come in the order of ``countries``, others after them by name. ``overall`` None takes all.
    """
    official = F.array_contains("discovery_source", OFFICIAL)
    order = [F.col("candidate_score").desc(), official.desc(), F.col("arrival"), F.col("domain")]
    ranked = grouping.first_k(pool, ["country"], order, per_country, ["domain"]).withColumnRenamed("place", "country_rank")
    if overall is None:
        return ranked
    place = F.array_position(t.strings(list(countries)), F.col("country"))
    return ranked.orderBy(F.when(place > 0, place).otherwise(len(countries) + 1), "country", "country_rank").limit(overall)


def pending_candidates(candidates: DataFrame, completed: DataFrame) -> DataFrame:
    """Candidates not yet analysed. A completed key is ``domain|country``, or an old bare ``domain``."""
    done = completed.select(F.col("key").alias("_key")).distinct()
    pair = F.concat_ws("|", "domain", "country")
    return (candidates.join(done, pair == F.col("_key"), "left_anti")
            .join(done.where(~F.col("_key").contains("|")), F.col("domain") == F.col("_key"), "left_anti"))


def hold_failed_candidates(candidates: DataFrame, pages: DataFrame, campaign: Campaign,
                           rules: ResultRules = ResultRules(), reason: str = "site_not_readable",
                           country_facts: DataFrame | None = None) -> DataFrame:
    """Candidates without a readable page that still look like an official company."""
    failed = candidates.join(pages.select("domain").distinct(), "domain", "left_anti")
    rows = with_country_facts(failed, facts=country_facts).withColumns({
        "_title": F.lower(F.coalesce("title", F.lit(""))),
        "_about": F.lower(F.coalesce("description", F.lit(""))),
        "_path": urls.path("url"),
    })
    rows = grouping.settle(rows, "_about")
    about = F.col("_about")
    platform_only = t.has_substring("_about", v.PLATFORM_TERMS) & ~t.has_substring("_about", v.STRONG_BUYER_TERMS)
    located = (F.exists("aliases", lambda a: t.present(about, a))
               | urls.under_tld(F.col("domain"), F.col("tld")))
    eligible = ((F.col("domain") != "") & ~urls.under_any_host(F.col("domain"), rules.blocked_hosts)
                & ~t.has_substring(F.col("_title"), rules.title_terms)
                & ~t.has_substring(F.col("_path"), rules.path_terms) & ~platform_only
                & t.has_term("_about", campaign.industry_terms()) & t.has_term("_about", rules.buyer_terms) & located)
    return rows.where(eligible).select(
        ids.company_id(F.col("domain")).alias("company_id"), "domain", F.col("country").alias("target_country"),
        F.col("root_url").alias("website"), F.col("description").alias("business_description"),
        F.col("keyword").alias("original_keyword"), F.col("query").alias("search_query"), "title",
        "discovery_source", "discovery_url", "candidate_score", F.lit("hold").alias("priority"),
        F.lit("on_hold").alias("quality_decision"), F.lit("not_readable").alias("site_type"),
        F.lit("hold").alias("email_grade"), F.lit("none").alias("email_status"),
        F.lit("not_read").alias("collection_depth"), F.lit(reason).alias("exclusion_reason"))


def latest_holds(holds: DataFrame) -> DataFrame:
    """Last hold of each website and country; `first_arrival` keeps the order of first appearance."""
    keys = ["website", "target_country"]
    others = [c for c in holds.columns if c not in keys]
    return (holds.groupBy(*keys)
            .agg(grouping.best_row(others, -F.col("arrival")).alias("_last"), F.min("arrival").alias("first_arrival"))
            .select(*keys, "_last.*", "first_arrival"))
