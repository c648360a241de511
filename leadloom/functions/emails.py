"""E-mail address expressions. Addresses are checked by shape only; no mailbox is ever contacted."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from leadloom.config import EmailRules
from leadloom.functions import text as t, urls, vocabulary as v

ADDRESS = r"(?i)[A-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[^\s<>()\[\]{}\"',;:!?/=\\]+"
_LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
_HOST = rf"^{_LABEL}(?:\.{_LABEL})+$"


def percent_decode(value: Column) -> Column:
    def decode(text: Column) -> Column:
        plain = F.replace(text, F.lit("+"), F.lit("%2B"))
        return F.when(text.contains("%"), F.coalesce(F.try_url_decode(plain), text)).otherwise(text)
    return t.let(value, decode)


def tidy(raw: Column) -> Column:
    """Address as written, without wrapping: references, ``mailto:``, quotes and trailing points."""
    value = F.trim(t.unescape(percent_decode(F.coalesce(raw, F.lit("")))))
    value = F.regexp_replace(value, r"(?i)^mailto:([^?]*).*$", "$1")
    value = t.strip_chars(value, " \t\r\n<>\"'")
    return F.lower(F.regexp_replace(value, r"[.,;:]+$", ""))


def is_valid(email: Column, rules: EmailRules) -> Column:
    """Shape of a lower-case address: parts, lengths, host labels, top-level domain, blocked parts."""
    local, host = F.substring_index(email, "@", 1), F.substring_index(email, "@", -1)
    return (email.rlike(rf"^{ADDRESS[4:]}$".replace("A-Z", "a-z"))
            & (F.length(email) - F.length(F.replace(email, F.lit("@"))) == 1)
            & (F.length(local) <= 64) & (F.length(email) <= 254)
            & ~local.rlike(r"^\.|\.$|\.\.")
            & host.rlike(_HOST) & is_tld(F.substring_index(host, ".", -1), rules)
            & ~t.has_substring(email, rules.blocked_parts))


def is_tld(label: Column, rules: EmailRules) -> Column:
    if rules.tlds:
        return label.isin(*rules.tlds)
    return label.rlike(rules.tld_pattern) & ~label.isin(*rules.no_tlds)


def ascii_host(email: Column) -> Column:
    """Address whose host is in its ASCII form, by the converter of the Java runtime."""
    host = F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), F.substring_index(email, "@", -1))
    return F.when(email.rlike(r"@.*[^\x00-\x7F]"), F.concat(F.substring_index(email, "@", 1), F.lit("@"), F.lower(host))).otherwise(email)


def normalize(raw: Column, rules: EmailRules = EmailRules(), idn: bool = False) -> Column:
    """Lower-case valid address, or NULL. ``idn`` also accepts hosts with non-ASCII letters."""
    address = ascii_host(tidy(raw)) if idn else tidy(raw)
    return t.let(address, lambda email: F.when(is_valid(email, rules), email))


def decode_obfuscated(value: Column, rules: EmailRules = EmailRules()) -> Column:
    """Turn ``name [at] host [dot] tld`` into an address, only for whole address-shaped spans."""
    at = r"(?:\s*\[\s*at\s*\]\s*|\s*\(\s*at\s*\)\s*|\s*\[골뱅이\]\s*)"
    dot = r"(?:\s*\[\s*dot\s*\]\s*|\s*\(\s*dot\s*\)\s*|\s*\[점\]\s*|\.)"
    span = rf"(?i)[A-Z0-9._%+-]+{at}[A-Z0-9-]+(?:{dot}[A-Z0-9-]+)+"

    def swap(done: Column, found: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(found, f"(?i){at}", "@"), f"(?i){dot}", ".")
        return F.replace(done, found, F.coalesce(normalize(plain, rules), found))

    spans = F.array_distinct(F.regexp_extract_all(value, F.lit(span), F.lit(0)))
    marked = value.rlike(r"(?i)[\[(]\s*(?:at|골뱅이)\s*[\])]")
    return F.when(marked, F.aggregate(spans, value, swap)).otherwise(value)


def local_part(email: Column) -> Column:
    return F.lower(F.substring_index(F.coalesce(email, F.lit("")), "@", 1))


def purpose(email: Column, rules: EmailRules = EmailRules()) -> Column:
    """Purpose by the first rule whose token occurs in the local part."""
    return t.first_substring(local_part(email), rules.purposes, "unknown")


def is_sendable(email: Column, rules: EmailRules = EmailRules(), normalized: bool = False) -> Column:
    """Valid, not a placeholder and not an auto-reply sender. ``normalized`` addresses are known to be valid."""
    local = F.trim(local_part(email))
    host = F.trim(F.lower(F.substring_index(F.coalesce(email, F.lit("")), "@", -1)))
    compact = F.regexp_replace(local, r"[^a-z0-9]+", "")
    valid = email.isNotNull() if normalized else normalize(email, rules).isNotNull()
    return ((local != "") & ~host.isin(*rules.placeholder_hosts) & ~compact.isin(*rules.autoreply_locals) & valid)


def source_priority(url: Column) -> Column:
    """5 partner page, 4 contact page, 2 about page, 0 article, 1 anything else."""
    where = urls.path_and_query(url)
    return t.let(where, lambda p: F.when(t.has_substring(p, v.PARTNER_PATHS), 5)
                 .when(t.has_substring(p, v.CONTACT_PATHS), 4)
                 .when(t.has_substring(p, v.ABOUT_PATHS), 2)
                 .when(t.has_substring(p, v.ARTICLE_PATHS), 0).otherwise(1))


def role_rank(email: Column, rules: EmailRules = EmailRules()) -> Column:
    """0 export or sales desk, 1 other trade role, 2 general desk, 3 the rest."""
    use = purpose(email, rules)
    return (F.when(t.has_substring(local_part(email), v.SALES_LOCAL_TOKENS), 0)
            .when(use.startswith("b2b"), 1).when(use == "general", 2).otherwise(3))


def preference(email: Column, source_rank: Column, rules: EmailRules = EmailRules()) -> Column:
    """Ordering of valid addresses of one company, best first."""
    return F.struct(F.when(is_sendable(email, rules, True), 0).otherwise(1).alias("blocked"),
                    role_rank(email, rules).alias("role"), (-source_rank).alias("source"), email.alias("email"))


def domain_relation(email: Column, company_domain: Column) -> Column:
    mail_host = F.substring_index(email, "@", -1)
    return (F.when(email.isNull(), "none")
            .when(urls.mail_domain(email) == company_domain, "same_domain")
            .when(mail_host.isin(*v.FREE_MAIL_HOSTS), "public_mailbox").otherwise("cross_domain"))
