"""Keyword and query plans, budgets and stopping rules."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leadloom.config import BACKFILL_CAP, ECOSYSTEM, LOCAL_MARKET, SEARCH_PROFILES, Campaign
from leadloom.functions import catalog, grouping, text as t, vocabulary as v


def resolve_industry(name: Column, event_industry: Column | None = None) -> Column:
    """Industry code of a typed name; an event is searched by the industry of its guests. NULL when unset."""
    codes = F.create_map(*[F.lit(x) for pair in catalog.INDUSTRY_CODES.items() for x in pair])
    known = set(catalog.INDUSTRY_CODES.values()) | set(catalog.SUGGESTED_PRODUCTS)
    code = lambda c: F.coalesce(F.try_element_at(codes, F.trim(c)), F.when(F.trim(c).isin(*known), F.trim(c)), F.trim(c))
    direct = code(name)
    if event_industry is None:
        return F.when(direct != "event_buyers", direct)
    guests = F.nullif(code(event_industry), F.lit("event_buyers"))
    return F.when(direct == "event_buyers", F.nullif(guests, F.lit(""))).otherwise(direct)


def _by_industry(industry: Column, table: dict, default) -> Column:
    chosen = t.strings(default)
    for name, values in table.items():
        chosen = F.when(industry == name, t.strings(values)).otherwise(chosen)
    return chosen


def suggested_products(industry: Column) -> Column:
    """Products proposed when a group names none."""
    base = F.coalesce(F.nullif(industry, F.lit("")), F.lit("products"))
    generic = F.array(base, F.concat(base, F.lit(" products")), F.concat(F.lit("Korean "), base),
                      F.concat(F.lit("professional "), base), F.concat(F.lit("premium "), base))
    tables = catalog.SUGGESTED_PRODUCTS | catalog.PRESET_PRODUCTS
    known = industry.isin(*tables)
    return F.when(known, F.slice(_by_industry(industry, tables, ()), 1, 5)).otherwise(generic)


def product_terms(products: Column, industry: Column, limit: int = 10) -> Column:
    """English search terms of a product list: spellings merged, Korean names translated, first ``limit``.

    A Korean name that is not known becomes the first term of the industry.
    """
    korean = F.create_map(*[F.lit(x) for pair in catalog.KOREAN_PRODUCTS.items() for x in pair])
    spelling = F.create_map(*[F.lit(x) for pair in catalog.PRODUCT_SPELLINGS.items() for x in pair])
    fallback = F.coalesce(F.get(_by_industry(industry, catalog.SUGGESTED_PRODUCTS, ()), F.lit(0)), F.lit("products"))
    given = F.filter(F.transform(products, F.trim), lambda p: p != "")
    listed = F.when(F.size(given) > 0, given).otherwise(suggested_products(industry))

    def term(value: Column) -> Column:
        plain = t.squash(F.replace(F.lower(value), F.lit("-"), F.lit(" ")))
        key = F.coalesce(F.try_element_at(spelling, plain), plain)
        translated = F.coalesce(F.try_element_at(korean, key), F.try_element_at(korean, value))
        hangul = value.rlike(r"[가-힣]")
        word = F.coalesce(translated, F.when(hangul, fallback), value)
        return F.struct(F.coalesce(translated, F.when(hangul, F.lower(fallback)), key).alias("key"), word.alias("word"))

    def first_of_each(terms: Column) -> Column:
        keys = F.array_distinct(F.transform(terms, lambda x: x["key"]))
        return F.transform(keys, lambda k: F.get(F.filter(terms, lambda x: x["key"] == k), F.lit(0))["word"])

    return F.slice(t.let(F.transform(listed, term), first_of_each), 1, limit)


def _rotate(products: Column, roles: Column, shift: Column | int = 0) -> Column:
    """One keyword per position: products and roles are both repeated round."""
    at = lambda values, n: F.get(values, F.pmod(n, F.size(values)))
    steps = F.sequence(F.lit(0), F.greatest(F.size(products), F.size(roles)) - 1)
    return F.transform(steps, lambda n: F.concat_ws(" ", at(products, n), at(roles, n + shift)))


def plan_keywords(groups: DataFrame, expansion_limit: int = 3, translate: bool = True) -> DataFrame:
    """Base and expansion keywords of each product group, one row per keyword in plan order.

    ``groups``: major, industry, products array. With ``translate=False`` an unknown Korean name is
    refused by `invalid_groups` instead of being replaced. All list work happens inside the row.
    """
    industry = F.col("industry")
    terms = groups.withColumns({
        "_products": product_terms(F.col("products"), industry) if translate else F.col("products"),
        "_roles": _by_industry(industry, catalog.BUYER_ROLES, catalog.DEFAULT_ROLES),
        "_more": _by_industry(industry, catalog.EXPANSION_ROLES, catalog.DEFAULT_EXPANSION_ROLES),
    })
    wide = lambda top: F.slice(F.array_distinct(_rotate(F.col("_products"), F.col("_roles"))), 1, top)
    steps = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_more") - 1), lambda offset: F.transform(
        "_products", lambda p, i: F.concat_ws(" ", p, F.get("_more", F.pmod(i + offset, F.size("_more")))))))
    key = lambda k: t.squash(F.lower(k))
    used = F.transform(wide(10), key)
    fresh = F.filter(F.array_distinct(steps), lambda k: ~F.array_contains(used, key(k)))
    machinery, packaging = F.col("major") == catalog.MACHINERY_GROUP, F.col("major") == catalog.PACKAGING_GROUP
    products, three = F.col("_products"), F.slice("_products", 1, 3)
    pair = lambda values, roles, shift: F.transform(values, lambda p, i: F.concat_ws(" ", p, F.get(
        t.strings(roles), F.pmod(i + shift, F.lit(len(roles))))))
    base = (F.when(machinery, pair(products, catalog.MACHINERY_ROLES, 0))
            .when(packaging, pair(products, catalog.PACKAGING_ROLES, 0))
            .otherwise(F.slice(F.array_distinct(_rotate(products, F.col("_roles"))), 1,
                               F.least(F.lit(12), F.greatest(F.lit(5), F.size(products))))))
    more = (F.when(machinery, pair(three, catalog.MACHINERY_ROLES, 1))
            .when(packaging, F.transform(three, lambda p: F.concat_ws(" ", p, F.lit(catalog.PACKAGING_EXPANSION_ROLE))))
            .otherwise(F.slice(fresh, 1, expansion_limit)))
    planned = terms.withColumns({"_base": base, "_expansion": more})
    both = F.concat(F.transform("_base", lambda k: F.struct(k.alias("keyword"), F.lit("base").alias("phase"))),
                    F.transform("_expansion", lambda k: F.struct(k.alias("keyword"), F.lit("expansion").alias("phase"))))
    return (planned.select("major", "industry", F.size("_base").alias("base_keyword_count"), F.posexplode(both).alias("position", "_k"))
            .select("major", "industry", "position", "_k.keyword", "_k.phase", "base_keyword_count"))


def invalid_groups(groups: DataFrame) -> DataFrame:
    """Groups that cannot be planned, with the reason: unknown group or subcategory, 0 or more than
    10 products, untranslated Korean names. ``groups``: major, subcategories, products."""
    known: dict[str, set] = {}
    for major, _, subcategory, _, _ in catalog.taxonomy_rows():
        known.setdefault(major, set()).add(subcategory)
    listed = F.lit(None)
    for major, subcategories in known.items():
        listed = F.when(F.col("major") == major, t.strings(sorted(subcategories))).otherwise(listed)
    count = F.size("products")
    reason = (F.when(listed.isNull() | (F.size("subcategories") == 0), "choose_group_and_subcategory")
              .when(F.size(F.array_except("subcategories", listed)) > 0, "unknown_subcategory")
              .when((count == 0) | (count > 10), "one_to_ten_products")
              .when(F.exists("products", lambda p: p.rlike(r"[가-힣]")), "use_english_products"))
    return groups.withColumn("reason", reason).where(F.col("reason").isNotNull())


# ------------------------------------------------------------------ queries

def exclusions(terms=v.QUERY_EXCLUSIONS) -> str:
    return " ".join(f'-"{term}"' if " " in term else f"-{term}" for term in terms)


def search_query(country: Column, keyword: Column, profile: Column, local_buyer: Column,
                 excluded: str | None = None) -> Column:
    """Text of one query: official company, local buyer word, or exhibitor lists."""
    low = F.lower(keyword)
    channel = low.rlike("distribut|wholesale|retail|clinic|salon|spa") & ~low.contains("import")
    at = F.least(F.when(channel, 1).otherwise(0), F.size(local_buyer) - 1)
    local = F.coalesce(F.get(local_buyer, at), F.lit("distributor"))
    tail = F.when(profile == LOCAL_MARKET, local).when(profile == ECOSYSTEM, "exhibitor association").otherwise("company")
    return t.squash(F.concat_ws(" ", country, keyword, tail, F.lit(exclusions() if excluded is None else excluded)))


def plan_queries(keywords: DataFrame, campaign: Campaign, keys=("major",)) -> DataFrame:
    """All queries of a campaign in running order, one row per country, keyword and profile.

    Every keyword first runs once, with the profiles taking turns; then the remaining profile and
    keyword pairs follow profile by profile. The place of a query follows from its two indexes, so no
    sort or window is needed. ``keywords``: position (dense from 0), keyword, keyword_count.
    """
    profiles = SEARCH_PROFILES.get(campaign.search_mode, SEARCH_PROFILES["balanced"])
    p_count = len(profiles)
    facts = [catalog.country_facts(c) for c in campaign.countries]
    country = F.explode(F.array(*[F.struct(F.lit(f["country"]).alias("country"), t.strings(f["local_buyer"]).alias("local_buyer"),
                                           F.lit(i).alias("country_idx")) for i, f in enumerate(facts)]))
    profile = F.explode(F.array(*[F.struct(F.lit(name).alias("profile"), F.lit(i).alias("idx"))
                                  for i, name in enumerate(profiles)]))
    rows = keywords.withColumn("_c", country).withColumn("_p", profile)
    k, n, p = F.col("position"), F.col("keyword_count"), F.col("_p.idx")
    if campaign.adaptive:
        turn = F.pmod(k, F.lit(p_count)) == p
        # Pairs of the first pass that would stand before this pair in the second pass.
        earlier = F.lit(0)
        for q in range(p_count):
            earlier = earlier + F.when(F.lit(q) < p, F.floor((n - q + p_count - 1) / p_count)).otherwise(0)
        same = F.greatest(F.lit(0), F.ceil((k - p) / p_count))
        index = F.when(turn, k).otherwise(n + p * n + k - earlier - same)
    else:
        index = p * n + k
    return rows.select(
        *keys, F.col("_c.country").alias("country"), F.col("_c.country_idx").alias("country_idx"),
        index.cast("int").alias("task_idx"), F.col("_p.profile").alias("profile"), "keyword",
        search_query(F.col("_c.country"), F.col("keyword"), F.col("_p.profile"), F.col("_c.local_buyer")).alias("query"))


RECOVERY_ROLES = ("importer", "exclusive distributor", "wholesale distributor", "retail chain", "beauty supplier",
                  "aesthetic clinic", "beauty salon")


def backfill_queries(countries: DataFrame, keywords: DataFrame, campaign: Campaign) -> DataFrame:
    """Queries that run only when a country stays short, distinct, in order, up to the cap of the mode.

    ``countries``: country, tld, local_buyer; ``keywords``: position, keyword. Every country takes every keyword in turn.
    """
    hints = [p for p in campaign.products if p] or [campaign.industry]
    country, tld, local = F.col("country"), F.col("tld"), F.col("local_buyer")
    words = lambda n: F.array_join(F.slice(local, 1, n), " ")
    texts: list[Column] = []
    for hint in hints[:3]:
        texts.append(F.when(F.size(local) > 0, F.concat_ws(" ", country, F.lit(hint), words(3))))
        texts.append(F.when((F.size(local) > 0) & (tld != ""), F.concat(F.lit("site:."), tld, F.lit(f" {hint} "), words(2))))
    for hint in hints[:5]:
        texts.append(F.concat_ws(" ", country, F.lit(f"{hint} importer distributor wholesaler company")))
        texts.append(F.concat_ws(" ", country, F.lit(f"{hint} retail chain clinic salon supplier")))
    texts += [F.concat_ws(" ", country, F.lit(f"{hints[0]} {role} official website contact")) for role in RECOVERY_ROLES]
    first = countries.select("country", F.posexplode(F.array(*texts)).alias("_at", "query")).where(F.col("query").isNotNull())
    last = countries.select("country").crossJoin(keywords).select(
        "country", (F.col("position") + len(texts)).cast("int").alias("_at"), F.concat_ws(" ", "country", "keyword", F.lit("official website contact")).alias("query"))
    once = first.union(last).groupBy("country", "query").agg(F.min("_at").alias("_at"))
    kept = grouping.first_k(once, ["country"], ["_at", "query"], BACKFILL_CAP.get(campaign.search_mode, 18))
    return kept.select("country", (F.col("place") - 1).alias("position"), "query")


def refill_queries(countries: DataFrame, keywords: DataFrame, products: DataFrame, campaign: Campaign) -> DataFrame:
    """Queries for goals missed after the first analysis, in the order of section, place and country: 0 local product
    phrases, 1 every keyword with its turn of the profiles, 2 all profiles, 3 products with local buyer words.

    ``products``: position, product, least evidence first (`product_evidence_order`); ``keywords``: position, keyword;
    ``countries``: country, country_idx, local_buyer. Every country takes every keyword and product.
    """
    profiles = SEARCH_PROFILES.get(campaign.search_mode, SEARCH_PROFILES["balanced"])
    country, local, tail = F.col("country"), F.col("local_buyer"), F.lit(exclusions())
    spark = countries.sparkSession
    turns = F.broadcast(spark.createDataFrame(list(enumerate(profiles)), "_turn int, _profile string"))  # three at most
    phrases = F.broadcast(spark.createDataFrame([(name, words[0]) for name, words in catalog.VIETNAMESE_PRODUCTS.items()], "_name string, _phrase string"))
    asked = countries.crossJoin(keywords.crossJoin(turns))
    text = search_query(country, F.col("keyword"), F.col("_profile"), local)
    own_turn = F.col("_turn") == F.pmod("position", F.lit(len(profiles)))
    offered = countries.crossJoin(products)
    words = F.coalesce(F.nullif(F.array_join(F.slice(local, 1, 2), " "), F.lit("")), F.lit("importer distributor"))

    def rows(source: DataFrame, section: int, place: Column, keyword: Column, query: Column | None = None) -> DataFrame:
        query = F.concat(country, F.lit(" "), keyword, F.lit(" "), tail) if query is None else query
        return source.select("country", "country_idx", F.lit(section).alias("section"), place.cast("long").alias("place"), keyword.alias("keyword"), query.alias("query"))

    local_names = offered.where(country == "Vietnam").join(phrases, F.lower("product") == F.col("_name"))
    position = F.col("position")
    every = (rows(local_names, 0, position, F.concat("_phrase", F.lit(" nhà phân phối")))
             .union(rows(asked.where(own_turn), 1, position, F.col("keyword"), text))
             .union(rows(asked, 2, F.shiftleft(F.col("_turn").cast("long"), 40) + position, F.col("keyword"), text))
             .union(rows(offered, 3, position, F.concat_ws(" ", "product", words))))
    # One row per query text, at its first place.
    first = every.groupBy("country", "query").agg(F.min(F.struct("section", "place", "country_idx", "keyword")).alias("_f"))
    return first.select("country", "_f.country_idx", "_f.section", "_f.place", "_f.keyword", "query")


def unused_queries(planned: DataFrame, executed: DataFrame) -> DataFrame:
    return planned.join(executed.select("query").distinct(), "query", "left_anti")


def creator_queries(keywords: DataFrame, max_queries: int = 8) -> DataFrame:
    """Profile searches of each creator campaign. ``keywords``: country, category, keywords array."""
    country = F.col("country")
    local = F.array(country)
    for name, values in v.CREATOR_LOCAL_TERMS.items():
        local = F.when(country == name, t.strings(values)).otherwise(local)
    clean = F.array_distinct(F.filter(F.transform("keywords", F.trim), lambda k: k != ""))
    base = keywords.withColumns({"_local": local, "_clean": clean})
    pairs = F.flatten(F.transform("_clean", lambda k, i: F.array(
        F.concat(F.lit("site:instagram.com "), F.get("_local", F.pmod(i, F.size("_local"))), F.lit(' "'), k,
                 F.lit('" influencer creator')),
        F.concat(F.lit("site:instagram.com "), country, F.lit(' "'), k, F.lit('" blogger reviewer KOC KOL')))))
    last = F.concat(F.lit("site:instagram.com "), country, F.lit(' "'), F.col("category"), F.lit('" "content creator"'))
    queries = F.slice(F.array_distinct(F.concat(pairs, F.array(last))), 1, max(1, max_queries))
    return base.select("country", "category", F.posexplode(queries).alias("position", "query"))


# ------------------------------------------------------------------ stopping and budgets

def stop_points(tasks: DataFrame, found: DataFrame, target: int, base_count: int) -> DataFrame:
    """Tasks each country needs: all, or those up to the one after which ``target`` domains are known.

    The answer only depends on the ``target`` domains seen first, so each map task passes on at most
    that many rows per country.
    """
    first_seen = found.groupBy("country", "domain").agg(F.min("task_idx").alias("task_idx"))
    reached = (grouping.first_k(first_seen, ["country"], ["task_idx", "domain"], target).groupBy("country")
               .agg(F.count("*").alias("_n"), F.max("task_idx").alias("_last")).where(F.col("_n") == target))
    planned = tasks.groupBy("country").agg(F.count("*").alias("planned_tasks"))
    stop = F.when(F.col("_last").isNotNull(), F.greatest(F.lit(base_count), F.col("_last") + 1))
    return planned.join(reached, "country", "left").select(
        "country", "planned_tasks", F.col("_last").isNotNull().alias("target_reached"),
        F.least("planned_tasks", F.coalesce(stop, F.col("planned_tasks"))).cast("long").alias("needed_tasks"))


def apply_budget(stops: DataFrame, cap: int, order: str = "country") -> DataFrame:
    """Share a query budget: each country gets at most an equal part, earlier countries spend first."""
    if not cap:
        return stops.withColumn("allowed_tasks", F.col("needed_tasks"))
    # One row per country: these two windows never grow with the data.
    countries = F.count("*").over(Window.partitionBy(F.lit(1)))
    part = F.least("needed_tasks", F.ceil(F.lit(cap) / F.col("_n")))
    limited = stops.withColumn("_n", countries).withColumn("_part", part)
    spent = F.sum("_part").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return limited.withColumn("allowed_tasks", F.greatest(F.lit(0), F.least(
        F.col("_part"), F.lit(cap) - (spent - F.col("_part")))).cast("long")).drop("_n", "_part")


def executed_tasks(tasks: DataFrame, found: DataFrame, target: int, base_count: int = 5, cap: int = 0) -> DataFrame:
    """Planned tasks that run under the stopping rule and the budget."""
    limits = apply_budget(stop_points(tasks, found, target, base_count), cap).select("country", "allowed_tasks")
    return (tasks.join(F.broadcast(limits), "country")  # one row per country
            .where(F.col("task_idx") < F.col("allowed_tasks")).drop("allowed_tasks"))
