"""URL expressions. Patterns are lenient, so one malformed URL never fails a job."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from leadloom.functions.vocabulary import TWO_PART_SUFFIXES

_AUTHORITY = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
_PATH = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"


def scheme(url) -> Column:
    return F.lower(F.regexp_extract(_text(url), r"^\s*([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority(url) -> Column:
    return F.regexp_extract(_text(url), _AUTHORITY, 1)


def host(url) -> Column:
    """Lower-case host without ``www.``; empty when the URL has none."""
    bare = F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":[0-9]*$", "")
    return F.regexp_replace(F.lower(bare), r"^www\.", "")


def path(url) -> Column:
    return F.lower(F.regexp_extract(_text(url), _PATH, 1))


def path_and_query(url) -> Column:
    query = F.regexp_extract(_text(url), r"\?([^#]*)", 1)
    return F.concat(path(url), F.lit(" "), F.lower(query))


def registrable(host_col) -> Column:
    """Name a company registers: two labels, or three under a two-part suffix."""
    two = F.substring_index(host_col, ".", -2)
    return F.when(two.isin(*TWO_PART_SUFFIXES), F.substring_index(host_col, ".", -3)).otherwise(two)


def registrable_domain(url) -> Column:
    return registrable(host(url))


def mail_domain(email) -> Column:
    bare = F.regexp_replace(F.lower(F.substring_index(email, "@", -1)), r"^www\.", "")
    return registrable(bare)


def root_url(url) -> Column:
    """``scheme://authority/``; a URL without a scheme is taken as https."""
    full = F.when(_text(url).rlike(r"^\s*[A-Za-z][A-Za-z0-9+.-]*:"), _text(url)).otherwise(
        F.concat(F.lit("https://"), _text(url)))
    return F.concat(F.regexp_extract(full, r"^\s*([A-Za-z][A-Za-z0-9+.-]*):", 1), F.lit("://"),
                    authority(full), F.lit("/"))


def page_key(url) -> Column:
    """URL without fragment and trailing slashes: one page is kept once per key."""
    bare = F.regexp_replace(F.regexp_replace(_text(url), r"#.*$", ""), r"/+$", "")
    return F.when(bare == "", _text(url)).otherwise(bare)


def under_any_host(host_col: Column, hosts) -> Column:
    """True when the host or one of its parent domains is listed."""
    by_labels: dict[int, list[str]] = {}
    for name in hosts:
        by_labels.setdefault(name.count(".") + 1, []).append(name)
    hit = F.lit(False)
    for labels, names in sorted(by_labels.items()):
        hit = hit | F.substring_index(host_col, ".", -labels).isin(*names)
    return hit


def under_tld(host_col: Column, tld: Column) -> Column:
    return (tld != "") & host_col.endswith(F.concat(F.lit("."), tld))


def resolve(base, href) -> Column:
    """Absolute form of a link found on the page ``base``."""
    base, href = _text(base), F.trim(_text(href))
    root = F.concat(scheme(base), F.lit("://"), authority(base))
    base_path = F.regexp_extract(base, _PATH, 1)
    folder = F.regexp_replace(base_path, r"[^/]*$", "")
    no_fragment = F.regexp_replace(base, r"#.*$", "")
    no_query = F.regexp_replace(no_fragment, r"\?.*$", "")
    joined = (
        F.when(href == "", base)
        .when(href.startswith("?"), F.concat(no_query, href))
        .when(href.startswith("#"), F.concat(no_fragment, href))
        .when(href.startswith("/"), F.concat(root, _clean_path(href)))
        .otherwise(F.concat(root, _clean_path(
            F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), href)))))
    return (F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
            .otherwise(joined))


def _clean_path(full: Column) -> Column:
    """Drop ``.`` and ``..`` segments; query and fragment stay as they are."""
    return F.element_at(F.transform(F.array(full), _without_dots), 1)


def _without_dots(full: Column) -> Column:
    head = F.regexp_extract(full, r"^([^?#]*)", 1)
    tail = F.regexp_extract(full, r"^[^?#]*(.*)$", 1)
    start = F.array().cast("array<string>")
    kept = F.aggregate(
        F.split(F.regexp_replace(head, r"(^|/)(\.\.?)$", "$1$2/"), "/"), start,
        lambda done, part: F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
        .when(part == ".", done).otherwise(F.array_append(done, part)))
    return F.concat(F.when(head.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(kept, "/")).otherwise(head), tail)


def _text(value) -> Column:
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))
