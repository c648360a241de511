"""Page corpus jobs: text, names, links, addresses and phones, all with built-in expressions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadloom.config import EmailRules
from leadloom.functions import emails, grouping, text as t, urls, vocabulary as v
from leadloom.operators.suffixes import with_registrable
from leadloom.sources.dimensions import with_country_facts

# Attributes of a tag; quoted values may hold a closing bracket.
_ATTRS = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+"
_RAW_BLOCKS = r"(?is)<(script|style)(?=[\s/>])" + _ATTRS + r">.*?(?:</\1\s*>|\z)"
_HIDDEN_BLOCKS = r"(?is)<(noscript|svg|template)(?=[\s/>])" + _ATTRS + r"(?<!/)>.*?(?:</\1\s*>|\z)"
_COMMENTS = r"(?s)<!--.*?(?:-->|\z)"
_TAG = r"(?s)<[!/?a-zA-Z]" + _ATTRS + r">"
_LINK_FILES = r"\.(pdf|docx?|xlsx?|pptx?|jpe?g|png|gif|svg|zip)(?:$|[?#])"
LINK = "array<struct<href: string, label: string>>"

PHONE = r"\+?[0-9][0-9(?U:\s)().-]{7,}[0-9]"


def dedup_pages(pages: DataFrame, order: str | None = None) -> DataFrame:
    """One row per page key: the first by ``order``, or by URL."""
    keyed = pages.withColumn("page_key", urls.page_key("url"))
    first = [F.col(order)] if order else []
    return (keyed.groupBy("page_key")
            .agg(grouping.best_row(pages.columns, *first, F.col("url")).alias("_page"))
            .select("page_key", "_page.*"))


def host_rollup(pages: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Per registrable domain: pages, hosts, distinct paths, first and last URL.

    ``suffixes`` (column ``rule``): public-suffix rules; without them the fixed two-part suffixes count.
    """
    parts = pages.select(
        urls.registrable_domain("url").alias("domain"), urls.host("url").alias("host"),
        urls.path("url").alias("path"), "url")
    if suffixes is not None:
        parts = with_registrable(parts, suffixes)
    return parts.groupBy("domain").agg(
        F.count("*").alias("pages"), F.count_distinct("host").alias("hosts"),
        F.count_distinct("path").alias("paths"), F.min("url").alias("first_url"), F.max("url").alias("last_url"))


def _visible(html: Column) -> Column:
    no_comments = F.regexp_replace(html, _COMMENTS, "")
    return F.regexp_replace(F.regexp_replace(no_comments, _RAW_BLOCKS, ""), _HIDDEN_BLOCKS, "")


def _plain(markup: Column) -> Column:
    return t.squash(t.unescape(F.regexp_replace(markup, _TAG, " ")))


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"(?is)(?:^|\s){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    value = F.concat(*[F.regexp_extract(tag, pattern, group) for group in (1, 2, 3)])
    return t.unescape(value)


def _links(visible: Column) -> Column:
    """(href, label) of each anchor that is closed before the next one opens."""
    def one(piece: Column) -> Column:
        attrs = F.regexp_extract(piece, r"(?s)^(" + _ATTRS + r")>", 1)
        body = F.regexp_extract(piece, r"(?is)^" + _ATTRS + r">(.*?)</a\s*>", 1)
        closed = piece.rlike(r"(?is)^" + _ATTRS + r">.*?</a\s*>")
        return F.struct(F.when(closed, _attribute(attrs, "href")).otherwise("").alias("href"),
                        _plain(body).alias("label"))
    pieces = F.split(visible, r"(?i)<a(?=[\s>])")
    anchors = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), one)
    return F.filter(anchors, lambda link: link["href"] != "")


def _site_name(visible: Column) -> Column:
    """Content of the last site-name meta tag that is not empty."""
    tags = F.regexp_extract_all(visible, F.lit(r"(?is)<meta(?=[\s/])(" + _ATTRS + r")>"), F.lit(1))

    def label(tag: Column) -> Column:
        prop = _attribute(tag, "property")
        return F.lower(F.when(prop != "", prop).otherwise(_attribute(tag, "name")))

    named = F.filter(tags, lambda tag: label(tag).isin("og:site_name", "application-name")
                     & (_attribute(tag, "content") != ""))
    last = F.coalesce(_attribute(F.get(named, F.size(named) - 1), "content"), F.lit(""))
    return F.when(visible.rlike("(?i)og:site_name|application-name"), last).otherwise("")


def _structured_name(html: Column) -> Column:
    """Legal name, or name, of the first organisation in the JSON-LD blocks."""
    blocks = F.regexp_extract_all(
        html, F.lit(r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    node = "struct<`@type`: string, name: string, legalName: string>"
    kinds = r'(?:^|")(?:' + t.either(v.ORGANISATION_TYPES) + r')(?:"|$)'

    def nodes(block: Column) -> Column:
        body = F.trim(t.unescape(block))
        graph = F.from_json(body, f"struct<`@graph`: array<{node}>>")["@graph"]
        return F.coalesce(graph, F.from_json(body, f"array<{node}>"), F.array().cast(f"array<{node}>"))

    found = F.filter(F.flatten(F.transform(blocks, nodes)),
                     lambda n: n["@type"].rlike(kinds) & (F.coalesce(n["name"], F.lit("")) != ""))
    best = F.get(found, F.lit(0))
    legal = F.when(best["legalName"] != "", best["legalName"])
    return F.when(html.contains("ld+json"), F.trim(F.coalesce(legal, best["name"]))).otherwise(F.lit(None))


def extract_pages(pages: DataFrame, rules: EmailRules = EmailRules()) -> DataFrame:
    """Visible text, title, names, links, addresses and phones of each page. `html` is not carried on."""
    kept = [c for c in pages.columns if c != "html"]
    shown = pages.select(*kept, _visible(F.coalesce("html", F.lit(""))).alias("_shown"),
                         _structured_name(F.coalesce("html", F.lit(""))).alias("jsonld_name"))
    read = shown.select(
        *kept, "jsonld_name", _plain(F.col("_shown")).alias("text"),
        _plain(F.array_join(F.regexp_extract_all(
            "_shown", F.lit(r"(?is)<title(?=[\s>])" + _ATTRS + r">(.*?)</title\s*>"), F.lit(1)), " ")).alias("title"),
        _site_name(F.col("_shown")).alias("site_name"), _links(F.col("_shown")).alias("anchors"))
    return grouping.settle(read, "text").withColumns({
        "host": urls.host("url"),
        "domain": urls.registrable_domain("url"),
        "emails": page_emails(F.col("text"), F.col("anchors"), rules),
        "phones": phone_candidates(F.col("text")),
        "links": contact_links(F.col("url"), F.col("anchors")),
    })


def contact_links(url: Column, anchors: Column) -> Column:
    """Same-host links whose address or label names a contact page."""
    absolute = F.transform(anchors, lambda a: F.struct(
        urls.resolve(url, a["href"]).alias("url"), F.lower(F.concat_ws(" ", a["href"], a["label"])).alias("label")))
    own = F.filter(absolute, lambda a: (urls.host(a["url"]) == urls.host(url))
                   & t.has_substring(a["label"], v.CONTACT_LINK_HINTS))
    return F.array_distinct(F.transform(own, lambda a: a["url"]))


def link_edges(extracted: DataFrame) -> DataFrame:
    """One row per anchor of a page, in page order, with the address it leads to."""
    rows = extracted.select("url", "host", F.posexplode("anchors").alias("position", "_a"))
    target = urls.resolve(F.col("url"), F.col("_a.href"))
    return rows.select("url", "position", F.col("_a.href").alias("href"), F.col("_a.label").alias("label"),
                       target.alias("target_url"), (urls.host(target) == F.col("host")).alias("same_host"))


def external_company_links(pages: DataFrame, limit: int = 10,
                           blocked: tuple[str, ...] = v.BLOCKED_HOSTS) -> DataFrame:
    """First distinct companies linked from a directory page, in page order."""
    own = urls.registrable_domain("url")
    absolute = F.transform("anchors", lambda a: F.struct(
        urls.resolve(F.col("url"), a["href"]).alias("url"),
        F.lower(F.concat_ws(" ", a["href"], a["label"])).alias("label")))
    company = F.filter(absolute, lambda a: t.let(urls.registrable_domain(a["url"]), lambda d: (
        urls.scheme(a["url"]).isin("http", "https") & (d != "") & (d != own)
        & ~urls.under_any_host(d, blocked) & ~urls.path(a["url"]).rlike(_LINK_FILES)
        & ~t.has_substring(a["label"], v.SKIPPED_LINK_LABELS))))
    roots = F.slice(F.array_distinct(F.transform(company, lambda a: urls.root_url(a["url"]))), 1, limit)
    return (pages.select(F.col("url").alias("source_url"), F.posexplode(roots).alias("position", "root_url"))
            .withColumn("domain", urls.registrable_domain("root_url")))


# ------------------------------------------------------------------ addresses

def page_emails(text: Column, anchors: Column, rules: EmailRules = EmailRules()) -> Column:
    """Valid addresses of a page in the text, in readable disguise, and in mailto links."""
    # Most texts hold no address at all; the byte search for the sign is much cheaper than the pattern.
    in_text = t.let(emails.decode_obfuscated(text, rules), lambda body: F.when(
        body.contains("@"), F.regexp_extract_all(body, F.lit(emails.ADDRESS), F.lit(0))).otherwise(t.strings([])))
    mailto = F.filter(anchors, lambda a: F.lower(a["href"]).startswith("mailto:"))
    raw = F.concat(in_text, F.transform(mailto, lambda a: a["href"]))
    valid = F.transform(F.array_distinct(raw), lambda found: emails.normalize(found, rules, idn=True))
    return F.array_sort(F.array_distinct(F.array_compact(valid)))


def harvest_emails(extracted: DataFrame, rules: EmailRules = EmailRules(), tlds: DataFrame | None = None) -> DataFrame:
    """One row per page and address, with the priority of the page as a source.

    ``tlds`` (column ``tld``) is a full list of top-level domains; ``rules.tlds`` is checked wherever an address is read.
    """
    rows = extracted.select("url", "host", "domain", F.explode("emails").alias("email"))
    if tlds is not None:
        known = tlds.select(F.lower("tld").alias("_tld")).distinct()  # broadcast by its size in bytes, or not
        rows = rows.join(known, F.substring_index("email", ".", -1) == F.col("_tld"), "left_semi")
    return rows.withColumns({"source_priority": emails.source_priority(F.col("url")),
                             "email_purpose": emails.purpose(F.col("email"), rules)})


def best_sources(harvested: DataFrame, keys=("domain",), order: str = "url") -> DataFrame:
    """Best page per company and address: a later page replaces an earlier one only by priority."""
    return (harvested.groupBy(*keys, "email")
            .agg(grouping.best_row(["url", "source_priority"], -F.col("source_priority"), F.col(order)).alias("_s"),
                 F.count("*").alias("mentions"))
            .select(*keys, "email", F.col("_s.url").alias("email_source_url"),
                    F.col("_s.source_priority").alias("source_priority"), "mentions"))


# ------------------------------------------------------------------ phones

def phone_candidates(text: Column, limit: int = 10) -> Column:
    """Phone-like numbers of a text, those near a phone word first.

    A number is dropped when the word nearest to it, before or after, is a tax or registration word.
    The 100 characters around a number are rebuilt from the pieces between numbers; a number has
    at least nine characters, so twelve pieces always cover them.
    """
    start, end = "\u0001", "\u0002"
    clean = F.translate(text, start + end, "")
    marked = F.regexp_replace(clean, f"({PHONE})", f"{start}$1{end}")
    pieces = F.split(marked, start)

    def describe(parts: Column) -> Column:
        return t.let(F.transform(parts, lambda p: F.replace(p, F.lit(end), F.lit(""))),
                     lambda plain: around(parts, plain))

    def around(parts: Column, plain: Column) -> Column:
        def one(index: Column) -> Column:
            piece = F.get(parts, index)
            before = F.array_join(F.slice(plain, F.greatest(index - 11, F.lit(1)), F.least(index, F.lit(12))), "")
            rest = F.concat(F.element_at(F.split(piece, end), 2), F.array_join(F.slice(plain, index + 2, 12), ""))
            return F.struct(F.trim(F.element_at(F.split(piece, end), 1)).alias("raw"), index.alias("at"),
                            F.lower(F.right(before, F.lit(100))).alias("before"),
                            F.lower(F.left(rest, F.lit(100))).alias("after"))

        return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), one))

    found = t.let(pieces, describe)
    # One plain entry with the distances of the nearest words on both sides.
    judged = F.transform(found, lambda p: F.struct(
        p["raw"], p["at"], _last_position(p["before"], v.PHONE_HINTS).alias("phone_before"),
        _last_position(p["before"], v.NON_PHONE_HINTS).alias("other_before"),
        _first_position(p["after"], v.PHONE_HINTS).alias("phone_after"),
        _first_position(p["after"], v.NON_PHONE_HINTS).alias("other_after")))
    kept = F.filter(judged, lambda p: ~((p["other_before"] > p["phone_before"]) | (
        (p["other_after"] > 0) & ((p["phone_after"] == 0) | (p["other_after"] < p["phone_after"])))))
    ranked = F.array_sort(F.transform(kept, lambda p: F.struct(
        F.when((p["phone_before"] > 0) | (p["phone_after"] > 0), 0).otherwise(1).alias("rank"), p["at"], p["raw"])))
    numbers = F.slice(F.array_distinct(F.transform(ranked, lambda p: p["raw"])), 1, limit)
    return F.when(clean.rlike(PHONE), F.coalesce(numbers, F.array().cast("array<string>"))).otherwise(
        F.array().cast("array<string>"))


def _last_position(text: Column, terms) -> Column:
    """Start of the last occurrence of any term, from 1; 0 when none occurs."""
    backwards = F.reverse(text)

    def start(term: Column) -> Column:
        at = F.position(F.reverse(term), backwards)
        return F.when(at > 0, F.length(text) - at - F.length(term) + 2).otherwise(0)

    return F.array_max(F.transform(t.strings(terms), start))


def _first_position(text: Column, terms) -> Column:
    """Start of the first occurrence of any term, from 1; 0 when none occurs."""
    starts = F.filter(F.transform(t.strings(terms), lambda term: F.position(term, text)), lambda at: at > 0)
    return F.coalesce(F.array_min(starts), F.lit(0))


def clean_phone(raw: Column, country: Column, dial: Column) -> Column:
    """Number as printed when its length and dial code fit the country, else NULL."""
    value = t.strip_chars(t.squash(raw), " .-()")
    value = F.regexp_replace(F.regexp_replace(value, r"^\+([0-9]+)\)\s*", "+$1 "), r"^([0-9]+)\)\s*", "$1 ")
    digits = F.regexp_replace(value, r"[^0-9]", "")
    vietnam = (country == "Vietnam") & digits.startswith("0") & ~F.substring(digits, 1, 2).isin(*v.VIETNAM_PHONE_STARTS)
    fits = ((dial == "") | value.startswith(F.concat(F.lit("+"), dial)) | digits.startswith(dial)
            | digits.startswith("0"))
    return F.when(F.length(digits).between(9, 15) & ~vietnam & fits, value)


def harvest_phones(extracted: DataFrame, country: str = "country", facts: DataFrame | None = None) -> DataFrame:
    """One row per page and candidate number, with the cleaned form where it fits the country."""
    rows = with_country_facts(extracted.select("url", "domain", country, "phones"), country, facts)
    listed = rows.select("url", "domain", country, "dial", F.posexplode("phones").alias("position", "raw_phone"))
    return listed.withColumn("phone", clean_phone(F.col("raw_phone"), F.col(country), F.col("dial"))).drop("dial")


# ------------------------------------------------------------------ visits and summaries

def pages_to_visit(companies: DataFrame, links: DataFrame, max_pages: int = 4) -> DataFrame:
    """Contact pages of each company by source priority, within its page budget.

    ``companies``: domain, quality_decision, has_official_email, email_purpose. ``links``: domain, url,
    position. A qualified company with its own general address gets one page, with any other own
    address none, every other company ``max_pages - 1``.
    """
    settled = F.col("has_official_email") & (F.col("quality_decision") == "qualified")
    budget = (F.when(settled & (F.col("email_purpose") == "general"), 1).when(settled, 0)
              .otherwise(max(0, max_pages - 1)))
    first = links.groupBy("domain", "url").agg(F.min("position").alias("position"))
    ranked = grouping.first_k(first.withColumn("source_priority", emails.source_priority(F.col("url"))), ["domain"],
                              [F.col("source_priority").desc(), F.col("position"), F.col("url")], max(1, max_pages - 1), ["url"])
    wanted = companies.select("domain", budget.alias("page_budget")).where(F.col("page_budget") > 0)
    return ranked.join(wanted, "domain").where(F.col("place") <= F.col("page_budget"))


def usual_contact_urls(pages: DataFrame) -> DataFrame:
    """Addresses where contact pages usually are, for each site root."""
    paths = t.strings(v.USUAL_CONTACT_PATHS)
    return pages.select("domain", F.posexplode(F.transform(
        paths, lambda p: F.concat(urls.root_url("url"), p))).alias("position", "url"))


def summarize_text(value: Column, length: int = 360) -> Column:
    """Description without menu and form phrases: the first two useful sentences."""
    text = t.strip_markup(value)
    text = F.regexp_replace(text, "(?iU)[\"“”]\\s*đóng\\s*[\"“”]", " ")
    text = F.regexp_replace(text, r"(?iU)\bđóng\b\s+(?=see\s+more\b)", " ")
    capitals = r"[A-ZÀ-ỸĐ][A-ZÀ-ỸĐ0-9&/+\-]*"
    text = F.regexp_replace(text, rf"(?U)\bĐóng\b(?=\s+{capitals}(?:\s+{capitals}){{0,4}})", " ")
    text = F.regexp_replace(text, rf"(?iU)(?<!\w)(?:{t.either(v.SUMMARY_UI_PATTERNS)})(?!\w)", " ")
    text = F.regexp_replace(text, rf"(?iU)\b(?:{t.either(v.SUMMARY_MENU_PATTERNS)})\b", " ")
    text = t.strip_chars(t.squash(text), " ·|-")
    skipped = rf"(?i){t.either(v.SUMMARY_SKIPPED)}"

    def pick(sentences: Column) -> Column:
        useful = F.filter(sentences, lambda s: (F.length(s) >= 35) & ~s.rlike(skipped))
        return F.when(F.size(useful) > 0, useful).otherwise(sentences)

    chosen = t.let(F.split(text, r"(?<=[.!?])\s+"), pick)
    return F.left(F.array_join(F.slice(chosen, 1, 2), " "), F.lit(length))
