"""Company and brand names from the labels and text of a site."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadloom.functions import text as t, urls, vocabulary as v

_NOISE = rf"(?iU)\s+(?:{t.either(v.NAME_NOISE)})\b.*$"
_LEGAL = rf"\b(?:{t.either(v.LEGAL_PREFIXES)})\b"
_STRONG = rf"\b(?:{t.either(v.LEGAL_PREFIXES)})\s+(?:{t.either(v.LEGAL_FORMS)})\b"
_HOME = r"(?iU)(?:\s*\btrang chủ\b)+\s*$"
_HOST_SHAPED = r"(?i)^(?:https?://)?(?:www\.)?[a-z0-9-]+(?:\.[a-z0-9-]+){1,3}/?$"
_STOPS = rf"(?isU)\s*(?:{t.either(v.LEGAL_SPAN_STOPS)}).*$"


def _word_count(value: Column) -> Column:
    return F.size(F.filter(F.split(value, " "), lambda w: w != ""))


def without_noise(value: Column) -> Column:
    """Label, already free of markup, without menu and social words appended to it."""
    return t.strip_chars(t.squash(F.regexp_replace(value, _NOISE, "")), " .,:;|-")


def _sized(value: Column) -> Column:
    return F.length(value).between(8, 150) & _word_count(value).between(2, 25)


def _usable(part: Column) -> Column:
    rejected = t.let(t.strip_chars(t.squash(F.lower(part)), " -|:·"), lambda normal: (
        (normal == "") | normal.isin(*v.GENERIC_NAMES) | t.has_substring(normal, v.THEME_NAME_PARTS)
        | t.has_term(normal, v.MENU_NAME_TERMS)))
    legal = part.rlike(rf"(?iU)^{_LEGAL}")
    short = F.when(legal, (F.length(part) <= 150) & (_word_count(part) <= 25)).otherwise(
        (F.length(part) <= 90) & (_word_count(part) <= 9))
    return ~rejected & short


def _split_all(parts: Column) -> Column:
    for separator in v.TITLE_SEPARATORS:
        pattern = t.literal_pattern(separator)
        parts = F.flatten(F.transform(parts, lambda p: F.split(p, pattern)))
    return parts


def _legal_spans(body: Column) -> Column:
    """(span, operator) of each legal name in the text. Pieces between names rebuild the 220
    characters after and the 120 characters before; a piece has at least seven characters."""
    marked = F.regexp_replace(F.translate(body, "\u0001", ""), rf"(?iU)({_LEGAL})", "\u0001$1")

    def around(pieces: Column) -> Column:
        def one(index: Column) -> Column:
            # The name ends where another legal name starts.
            span = F.left(F.array_join(F.slice(pieces, index + 1, 32), ""), F.lit(220))
            cut = F.regexp_replace(span, rf"(?isU)(?<=^.{{7,219}}){_STRONG}.*$", "")
            name = without_noise(t.strip_chars(F.regexp_replace(cut, _STOPS, ""), " .,:;|-"))
            before = F.array_join(F.slice(pieces, F.greatest(index - 17, F.lit(1)), F.least(index, F.lit(18))), "")
            context = F.lower(F.right(before, F.lit(120)))
            return F.struct(name.alias("name"), t.has_substring(context, v.OPERATOR_TERMS).alias("operator"))
        return F.filter(F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), one), lambda s: _sized(s["name"]))

    return F.when(body.rlike(rf"(?iU){_LEGAL}"), t.let(F.split(marked, "\u0001"), around))


def _longest(names: Column) -> Column:
    """Name with most words, then most characters, earliest on a tie."""
    ranked = F.array_sort(F.transform(names, lambda n, i: F.struct(
        (-_word_count(n)).alias("words"), (-F.length(n)).alias("length"), i.alias("at"), n.alias("name"))))
    return F.get(ranked, F.lit(0))["name"]


def _from_host(label: Column) -> Column:
    words = F.split(F.replace(label, F.lit("-"), F.lit(" ")), r"\s+")
    return F.array_join(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.when(
        F.length(w) <= 3, F.upper(w)).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2)))))), " ")


def elect_company_name(sites: DataFrame) -> DataFrame:
    """Add `company_name`: the best supported name of each site.

    Input columns: host, jsonld_name, site_name, title, text. Preference: the operating company named
    in the text, a longer form of the legal name in the labels, the legal name in the labels, a legal
    label confirmed by domain or text, the only legal name of the text, a label that holds the domain
    name, a short label, any label, the host.
    """
    none = t.strings([])
    labels = F.filter(F.transform(F.array("jsonld_name", "site_name", "title"), lambda x: without_noise(t.strip_markup(x))),
                      lambda x: (x != "") & ~x.rlike(_HOST_SHAPED))
    one = sites.withColumns({
        "_labels": labels, "_body": t.strip_markup(F.col("text")),
        "_label": F.substring_index(urls.registrable(F.col("host")), ".", 1),
    }).withColumn("_token", t.identity_token(F.col("_label")))
    tails = F.transform(F.filter("_labels", lambda x: x.rlike(rf"(?iU){_STRONG}")), lambda x: t.strip_chars(
        without_noise(F.regexp_replace(F.regexp_extract(x, rf"(?iU)^.*({_STRONG}.*)$", 1),
                                       r"\s+(?:\||::)\s+.*$", "")), " .,:;|"))
    parts = F.filter(F.transform(F.filter(_split_all(F.col("_labels")), lambda p: F.trim(p) != ""),
                                 lambda p: F.trim(F.regexp_replace(p, _HOME, ""))), _usable)
    two = one.withColumns({
        "_strong": F.filter(tails, _sized), "_parts": parts,
        "_spans": F.coalesce(_legal_spans(F.col("_body")), F.array().cast("array<struct<name:string,operator:boolean>>")),
    })
    body_names = F.filter(F.transform("_spans", lambda s: s["name"]), _usable)
    legal = F.filter("_parts", lambda p: p.rlike(rf"(?iU)^{_LEGAL}"))
    three = two.withColumns({
        "_operators": F.transform(F.filter("_spans", lambda s: s["operator"]), lambda s: s["name"]),
        "_body_names": body_names, "_legal": legal,
        "_matched": F.filter("_parts", lambda p: (F.col("_token") != "") & t.identity_token(p).contains(F.col("_token"))),
        "_concise": F.filter("_parts", lambda p: _word_count(p).between(1, 7) & (F.length(p) <= 70)),
    })

    def extends(candidate: Column, metas: str) -> Column:
        return F.exists(metas, lambda m: t.let(t.identity_token(m), lambda token: (F.length(token) >= 8)
                                               & t.identity_token(candidate).startswith(token)))

    body_token = F.when(F.size("_legal") > 0, t.identity_token(F.coalesce("text", F.lit(""))))
    four = three.withColumn("_body_token", body_token).withColumns({
        "_confirmed": F.filter("_legal", lambda p: F.array_contains("_matched", p)
                               | F.coalesce(F.col("_body_token").contains(t.identity_token(p)) & (F.col("_body_token") != ""), F.lit(False))),
        "_expanded": F.filter("_body_names", lambda n: extends(n, "_legal") & extends(n, "_strong")),
        "_only": F.filter("_body_names", lambda n: n.rlike(rf"(?iU)^{_STRONG}")),
    })

    def first_filled(*arrays: str) -> Column:
        chosen = none
        for name in reversed(arrays):
            chosen = F.when(F.size(name) > 0, F.col(name)).otherwise(chosen)
        return chosen

    preferred = first_filled("_operators", "_expanded", "_strong", "_confirmed")
    five = four.withColumn("_preferred", F.when(
        (F.size(preferred) == 0) & (F.size("_only") == 1), F.col("_only")).otherwise(preferred))
    plain = F.get(first_filled("_matched", "_concise", "_parts"), F.lit(0))
    fixed = F.lit(None).cast("string")
    for token, name in v.DOMAIN_NAMES.items():
        fixed = F.when(F.col("_token") == token, name).otherwise(fixed)
    chosen = F.coalesce(fixed, F.nullif(_longest(F.col("_preferred")), F.lit("")), F.nullif(plain, F.lit("")),
                        _from_host(F.col("_label")))
    named = five.withColumn("company_name", F.left(without_noise(chosen), F.lit(160)))
    return named.select(*sites.columns, "company_name")


def with_brand_name(named: DataFrame) -> DataFrame:
    """Add `brand_name` where the site shows a short consumer brand that is not the company name."""
    def brand(raw: str) -> Column:
        text = t.strip_markup(F.col(raw))
        for separator in v.TITLE_SEPARATORS:
            text = F.trim(F.regexp_replace(text, t.literal_pattern(separator) + ".*$", ""))
        return t.strip_chars(F.regexp_replace(text, _HOME, ""), " .,:;|-")

    def accepted(text: Column) -> Column:
        key, company = t.name_key(text), F.col("_company_key")
        fits = ((text != "") & (F.length(text) <= 80) & (_word_count(text) <= 9)
                & ~F.lower(text).isin(*v.GENERIC_BRANDS) & ~text.rlike(rf"(?iU)^\s*{_LEGAL}"))
        return F.when(fits & (key != "") & ~company.contains(key) & ~key.contains(company), text)

    keyed = named.withColumns({"_company_key": t.name_key(F.col("company_name")),
                               "_site_brand": brand("site_name"), "_title_brand": brand("title")})
    chosen = F.coalesce(accepted(F.col("_site_brand")), accepted(F.col("_title_brand")))
    return keyed.withColumn("brand_name", chosen).drop("_company_key", "_site_brand", "_title_brand")


def name_review_reason(name: Column) -> Column:
    """Why a company name needs a look before any letter is sent; NULL when it is clean."""
    def judge(text: Column) -> Column:
        marketing = t.has_substring(F.lower(text), v.MARKETING_WORDS)
        formal = text.rlike(rf"(?iU)^\s*(?:{t.either(v.LEGAL_PREFIXES)})\s+(?:{t.either(v.LEGAL_FORMS)})")
        return (F.when(text == "", "name_missing")
                .when(F.concat(F.lit(" "), text).rlike(_NOISE), "name_has_menu_text")
                .when(F.size(F.regexp_extract_all(text, F.lit(rf"(?iU){_LEGAL}"), F.lit(0))) > 1, "name_has_two_companies")
                .when((F.length(text) > 150) | (_word_count(text) > 25), "name_too_long")
                .when(marketing & ~formal, "name_has_marketing_text"))
    return t.let(t.strip_markup(name), judge)
