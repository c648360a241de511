"""Settings of the jobs. Defaults are the values a campaign uses when nothing is changed."""
from __future__ import annotations

from dataclasses import dataclass, field

from leadloom.functions import catalog, vocabulary as v

OFFICIAL, LOCAL_MARKET, ECOSYSTEM, BACKFILL, SHORTFALL = (
    "official", "local_market", "ecosystem", "backfill", "shortfall")
DISCOVERY_SOURCES = (OFFICIAL, LOCAL_MARKET, ECOSYSTEM, BACKFILL, SHORTFALL)

# Search profiles, oversampling and the cap of backfill queries by search mode.
SEARCH_PROFILES = {"precision": (OFFICIAL,), "balanced": (OFFICIAL, LOCAL_MARKET),
                   "maximum": (OFFICIAL, LOCAL_MARKET, ECOSYSTEM)}
OVERSAMPLE = {"precision": 1.8, "balanced": 2.5, "maximum": 3.0}
BACKFILL_CAP = {"precision": 12, "balanced": 18, "maximum": 25}

GRADE_ORDER = ("A", "B", "C", "strategic", "other_country", "reference", "hold", "excluded")
MAILING_PRIORITIES = ("A", "B", "C", "strategic")
MAILING_STATUSES = ("official", "verified", "external", "needs_check")


@dataclass(frozen=True)
class Campaign:
    """What a buyer campaign looks for, and its goals."""
    industry: str = "cosmetics"
    group: str = ""
    subcategories: tuple[str, ...] = ()
    products: tuple[str, ...] = ()
    countries: tuple[str, ...] = ("Vietnam",)
    search_mode: str = "balanced"
    candidate_limit: int = 80
    # Most candidates of a run before the pages are read; None takes all.
    candidate_ceiling: int | None = 300
    email_target: int = 20
    target_per_country: int = 10
    qualified_target: int = 0
    max_queries: int = 0
    base_keyword_count: int = 5
    adaptive: bool = True
    saving: bool = False
    max_pages_per_company: int = 4
    include_external: bool = True

    def industry_terms(self) -> tuple[str, ...]:
        """Words of the industry, then the products and their aliases."""
        terms = list(v.INDUSTRY_TERMS.get(self.industry, ()))
        region = self.countries[0] if self.countries else ""
        for product in (p.strip().lower() for p in self.products if p.strip()):
            if product not in v.GENERIC_PRODUCT_WORDS:
                terms.append(product)
            terms.extend(catalog.product_aliases(product, region))
        return tuple(dict.fromkeys(terms))

    @property
    def final_per_country(self) -> int:
        return max(5, -(-self.candidate_limit // len(self.countries)))

    @property
    def discovery_limit(self) -> int:
        wanted = max(self.candidate_limit, int(self.candidate_limit * OVERSAMPLE.get(self.search_mode, 2.0) + 0.999))
        return wanted if self.candidate_ceiling is None else min(self.candidate_ceiling, wanted)

    @property
    def per_country_limit(self) -> int:
        return max(self.final_per_country, -(-self.discovery_limit // len(self.countries)))

    @property
    def search_target(self) -> int:
        """Domains after which further queries of a country are skipped."""
        return self.final_per_country if self.saving else self.per_country_limit


@dataclass(frozen=True)
class ResultRules:
    """Lists and weights of the search-result filter."""
    industry_terms: tuple[str, ...] = v.INDUSTRY_TERMS["cosmetics"]
    buyer_terms: tuple[str, ...] = tuple(dict.fromkeys(v.BUYER_TERMS + v.STRONG_BUYER_TERMS))
    content_terms: tuple[str, ...] = v.CONTENT_TERMS
    blocked_hosts: tuple[str, ...] = v.BLOCKED_HOSTS
    source_hosts: tuple[str, ...] = v.DIRECTORY_HOSTS + v.MEDIA_HOSTS
    path_terms: tuple[str, ...] = v.NON_COMPANY_PATHS
    title_terms: tuple[str, ...] = v.NON_COMPANY_TITLE_TERMS
    country_tlds: tuple[str, ...] = v.COUNTRY_TLDS
    # "registrable" pools by the name a company registers, "host" by the whole host.
    host_key: str = "registrable"


@dataclass(frozen=True)
class EmailRules:
    blocked_parts: tuple[str, ...] = v.BLOCKED_EMAIL_PARTS
    purposes: tuple[tuple[str, str], ...] = v.EMAIL_PURPOSES
    autoreply_locals: tuple[str, ...] = v.AUTOREPLY_LOCALS
    placeholder_hosts: tuple[str, ...] = v.PLACEHOLDER_MAIL_HOSTS
    # Top-level domains. A full list (`sources.readers.read_tlds`) is checked wherever an address is read; without one the
    # shape counts, less endings of files and names that are kept for local use.
    tlds: tuple[str, ...] = ()
    tld_pattern: str = r"^(?:[a-z]{2,24}|xn--[a-z0-9-]{1,59})$"
    no_tlds: tuple[str, ...] = v.NO_TLDS


@dataclass(frozen=True)
class CreatorSearch:
    """What a creator search looks for."""
    country: str = "Vietnam"
    category: str = "beauty"
    keywords: tuple[str, ...] = ("beauty", "skincare")
    target_count: int = 20
    min_followers: int = 0
    max_followers: int = 0
    max_queries: int = 8
    include_business: bool = False

    @property
    def category_terms(self) -> tuple[str, ...]:
        named = v.CREATOR_CATEGORIES.get(self.category, v.DEFAULT_CREATOR_KEYWORDS)
        return tuple(dict.fromkeys(self.keywords + named))


@dataclass(frozen=True)
class CreatorTerms:
    creator: tuple[str, ...] = v.CREATOR_TERMS
    collab: tuple[str, ...] = v.COLLAB_TERMS
    business: tuple[str, ...] = v.BUSINESS_ACCOUNT_TERMS + v.MEDIA_ACCOUNT_TERMS
    first_person: tuple[str, ...] = v.FIRST_PERSON_TERMS
    login: tuple[str, ...] = v.LOGIN_PAGE_TERMS
    flags: tuple[tuple[str, str], ...] = v.FLAG_COUNTRIES
    cities: tuple[tuple[str, str], ...] = v.CITY_COUNTRIES
    media_followers: int = 50_000
    # Weights of the score.
    base: int = 15
    grade_a: int = 70
    grade_b: int = 50


@dataclass(frozen=True)
class GradeRules:
    review_below: int = 65
    importer_from: int = 75
    buyer_from: int = 70


@dataclass(frozen=True)
class Sender:
    company_name: str = ""
    contact_name: str = ""
    contact_title: str = ""
    email: str = ""
    website: str = ""
    brand_name: str = ""


@dataclass(frozen=True)
class Product:
    product_name: str = ""
    category: str = ""
    description: str = ""
    differentiator: str = ""
    catalog_url: str = ""
    features: tuple[str, ...] = field(default_factory=tuple)
    attachment_name: str = ""
    selling_points: str = ""
    collaboration_offer: str = ""
