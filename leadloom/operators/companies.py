"""Company records: chosen address, outside contacts, merging of repeated companies."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadloom.config import EmailRules
from leadloom.functions import emails, grouping, text as t, urls

GRADE_RANK = {"A": 7, "B": 6, "strategic": 5, "C": 4, "other_country": 3, "reference": 2, "excluded": 0}
EMAIL_FIELDS = ("company_email", "email_source_url", "email_status", "email_domain_status", "email_grade",
                "email_purpose", "verification_score")
ADDRESS = ("struct<company_email: string, email_source_url: string, email_status: string, "
           "email_domain_status: string, email_grade: string, email_purpose: string, verification_score: int>")


def address_view(email: Column, source_url: Column, company_domain: Column, rules: EmailRules = EmailRules()) -> dict:
    """Fields of one address found on the company's own pages."""
    same = urls.mail_domain(email) == company_domain
    return {
        "company_email": email, "email_source_url": source_url,
        "email_status": F.when(email.isNull(), "none").otherwise("official"),
        "email_domain_status": emails.domain_relation(email, company_domain),
        "email_grade": F.when(email.isNull(), "D").when(~emails.is_sendable(email, rules), "unfit")
        .when(same, "A").otherwise("B"),
        "email_purpose": F.when(email.isNotNull(), emails.purpose(email, rules)),
        "verification_score": F.lit(None).cast("int"),
    }


def choose_contact(sources: DataFrame, rules: EmailRules = EmailRules()) -> DataFrame:
    """Best address of each company domain.

    Own-domain addresses come first; a trade address published on a partner page wins over an own
    address without a trade role. ``sources``: domain, email, email_source_url, source_priority.
    """
    ranked = sources.withColumns({
        "_order": emails.preference(F.col("email"), F.col("source_priority"), rules),
        "_own": urls.mail_domain(F.col("email")) == F.col("domain"),
        "_use": emails.purpose(F.col("email"), rules),
    })
    fields = F.struct("email", "email_source_url", "source_priority", F.col("_use").alias("use"))
    best = ranked.groupBy("domain").agg(
        F.min_by(fields, F.when(F.col("_own"), F.col("_order"))).alias("_official"),
        F.min_by(fields, F.when(~F.col("_own"), F.col("_order"))).alias("_related"),
        F.count("*").alias("address_count"))
    official, related = F.col("_official"), F.col("_related")
    partner_wins = F.coalesce((related.source_priority >= 5) & related.use.startswith("b2b")
                              & ~official.use.startswith("b2b"), F.lit(False))
    picked = best.withColumn("_pick", F.when(official.isNull() | partner_wins, related).otherwise(official))
    view = address_view(F.col("_pick.email"), F.col("_pick.email_source_url"), F.col("domain"), rules)
    return picked.select("domain", *[value.alias(name) for name, value in view.items()],
                         official.isNotNull().alias("has_official_email"), "address_count")


def enrich_contacts(companies: DataFrame, external: DataFrame, rules: EmailRules = EmailRules()) -> DataFrame:
    """Fill qualified companies without an address from a table of outside contacts.

    The best contact of a domain is a general address with the highest confidence. Its check result
    sets status and grade.
    """
    usable = external.withColumn("_email", emails.normalize(F.col("value"), rules)).where(
        F.col("_email").isNotNull() & emails.is_sendable(F.col("_email"), rules, True))
    order = [F.when(F.col("type") == "generic", 0).otherwise(1), -F.coalesce("confidence", F.lit(0)), F.col("_email")]
    fields = ["_email", "confidence", "first_name", "last_name", "position", "source_uri", "verify_status",
              "verify_score", "accept_all"]
    best = usable.groupBy("domain").agg(grouping.best_row(fields, *order).alias("_x"))
    joined = companies.join(best, "domain", "left")
    x = F.col("_x")
    take = (F.col("quality_decision") == "qualified") & F.col("company_email").isNull() & x.isNotNull()
    good = x.verify_status.isin("valid", "deliverable")
    bad = x.verify_status.isin("invalid", "undeliverable")
    risky = F.coalesce(x.accept_all, F.lit(False)) | x.verify_status.isin("accept_all", "risky")
    checked = x.verify_status.isNotNull()

    def filled(name: str, value: Column) -> Column:
        return F.when(take, value).otherwise(F.col(name))

    return joined.withColumns({
        "company_email": filled("company_email", x["_email"]),
        "contact_name": F.when(take, F.concat_ws(" ", x.first_name, x.last_name)),
        "contact_title": F.when(take, x.position),
        "email_source_url": filled("email_source_url", x.source_uri),
        "email_purpose": filled("email_purpose", emails.purpose(x["_email"], rules)),
        "email_domain_status": filled("email_domain_status", F.lit("external_source")),
        "email_status": filled("email_status", F.when(good, "verified").when(bad, "external").when(
            checked & F.coalesce(risky, F.lit(False)), "needs_check").otherwise("external")),
        "email_grade": filled("email_grade", F.when(bad, "excluded").when(
            ~good & checked & F.coalesce(risky, F.lit(False)), "C").otherwise("B")),
        "verification_score": filled("verification_score", F.coalesce(
            F.nullif(x.verify_score, F.lit(0)), F.coalesce(x.confidence, F.lit(0))).cast("int")),
        "contact_note": F.when(take & bad, "address_failed_check").when(
            take & ~F.coalesce(good, F.lit(False)) & F.coalesce(risky, F.lit(False)), "delivery_uncertain"),
    }).drop("_x")


# ------------------------------------------------------------------ address variants

def address_variants(record_addresses: Column, primary: Column, rules: EmailRules = EmailRules()) -> Column:
    """Distinct valid addresses of one record with the best source each; the primary one comes first.

    Further addresses must carry a source of their own. An earlier entry wins on equal source priority.
    """
    extras = F.filter(F.coalesce(record_addresses, F.array().cast(f"array<{ADDRESS}>")),
                      lambda a: F.coalesce(a["email_source_url"], F.lit("")) != "")
    every = F.transform(F.concat(F.array(primary.cast(ADDRESS)), extras), lambda a, i: F.struct(
        emails.normalize(a["company_email"], rules).alias("email"),
        (-emails.source_priority(a["email_source_url"])).alias("rank"), i.alias("position"), a.alias("address")))
    valid = F.filter(every, lambda a: a["email"].isNotNull())

    def pick(rows: Column) -> Column:
        names = F.array_distinct(F.transform(rows, lambda r: r["email"]))
        return F.transform(names, lambda e, i: t.let(F.get(F.array_sort(F.transform(F.filter(
            rows, lambda r: r["email"] == e), lambda r: F.struct(r["rank"], r["position"], r["address"]))), F.lit(0)),
            lambda best: F.struct(i.alias("position"), e.alias("email"), (-best["rank"]).alias("source_priority"),
                                  best["address"].alias("address"))))

    return t.let(valid, pick)


def contact_variants(records: DataFrame, rules: EmailRules = EmailRules()) -> DataFrame:
    """One row per record and address; the address fields replace the record's primary ones."""
    primary = F.struct(*[F.col(c) for c in EMAIL_FIELDS])
    extras = F.col("email_candidates") if "email_candidates" in records.columns else F.lit(None).cast(f"array<{ADDRESS}>")
    rows = records.withColumn("_v", F.explode(address_variants(extras, primary, rules)))
    kept = [c for c in records.columns if c not in EMAIL_FIELDS and c != "email_candidates"]
    fields = [F.col(f"_v.address.{c}").alias(c) for c in EMAIL_FIELDS if c != "company_email"]
    return rows.select(*kept, F.col("_v.email").alias("company_email"), *fields,
                       F.col("_v.position").alias("position"), F.col("_v.source_priority").alias("source_priority"))


# ------------------------------------------------------------------ merging repeated companies

def record_rank(rules: EmailRules = EmailRules()) -> Column:
    """Total order of records; the largest survives a merge."""
    grade = F.lit(1)
    for name, value in GRADE_RANK.items():
        grade = F.when(F.col("priority") == name, value).otherwise(grade)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    return F.struct(grade.alias("grade"), (text("verified_country") != "").alias("verified"),
                    number("country_score").alias("country"), number("relevance_score").alias("relevance"),
                    emails.normalize(F.col("company_email"), rules).isNotNull().alias("mail"),
                    number("candidate_score").alias("score"), text("company_id").alias("id"),
                    text("target_country").alias("target"), (-F.col("arrival")).alias("earlier"))


def assign_owners(records: DataFrame, rules: EmailRules = EmailRules()) -> DataFrame:
    """Add `owner_id`: the `record_id` of the record each one merges into, and `record_rank`.

    First the best record of each host leads it; records without a host lead themselves. Then the best
    leader per country, name and mail domain owns the other leaders. Both steps are aggregations, so
    a host with a third of all records is reduced before the shuffle. Only keys and ranks travel.
    """
    mail = F.col("company_email")
    alias = F.struct(F.lower(F.coalesce("target_country", F.lit(""))).alias("country"),
                     t.name_key(F.col("company_name")).alias("name"),
                     urls.mail_domain(F.coalesce(mail, F.lit(""))).alias("mail"))
    host = urls.host("website")
    keyed = records.withColumns({
        "record_rank": record_rank(rules),
        # A record without a host gets a key of its own; one shared empty key would be a huge group.
        "_host_key": F.when(host == "", F.concat(F.lit("#"), F.col("record_id").cast("string"))).otherwise(host),
        "_alias": alias,
    })
    leaders = keyed.groupBy("_host_key").agg(
        F.max_by(F.struct("record_id", "_alias"), "record_rank").alias("_lead"), F.max("record_rank").alias("_rank"))
    usable = (F.col("_lead._alias.name") != "") & (F.col("_lead._alias.mail") != "")
    owners = (leaders.where(usable).groupBy(F.col("_lead._alias").alias("_a"))
              .agg(F.max_by("_lead.record_id", "_rank").alias("_owner")))
    led = leaders.join(owners, usable & (F.col("_lead._alias") == F.col("_a")), "left").select(
        "_host_key", F.coalesce("_owner", "_lead.record_id").alias("owner_id"))
    return keyed.join(led, "_host_key").drop("_host_key", "_alias")


def dedup_companies(records: DataFrame, rules: EmailRules = EmailRules()) -> DataFrame:
    """One row per company: the best record, all countries it was found for, and a recovered address.

    Lists that can grow without bound stay in their own tables: `company_addresses`,
    `company_assessments`.
    """
    owned = assign_owners(records, rules)
    return merge_owned(owned, records.columns, rules)


def merge_owned(owned: DataFrame, columns, rules: EmailRules = EmailRules()) -> DataFrame:
    primary = F.struct(*[F.col(c) for c in EMAIL_FIELDS])
    extras = F.col("email_candidates") if "email_candidates" in columns else F.lit(None).cast(f"array<{ADDRESS}>")
    sendable = F.filter(address_variants(extras, primary, rules), lambda a: emails.is_sendable(a["email"], rules, True))
    offered = F.when((F.col("quality_decision") != "excluded") | (F.col("record_id") == F.col("owner_id")),
                     F.get(sendable, F.lit(0)))
    ranked = owned.withColumn("_offered", offered)
    fields = [c for c in columns if c not in ("email_candidates", "industry_assessments")]
    merged = ranked.groupBy("owner_id").agg(
        F.max_by(F.struct(*fields), "record_rank").alias("_best"),
        F.max_by("_offered", F.when(F.col("_offered").isNotNull(), F.col("record_rank"))).alias("_recovered"),
        # At most one entry per known country.
        F.sort_array(F.collect_set(F.nullif("target_country", F.lit("")))).alias("discovered_countries"),
        F.count("*").alias("merged_records"))
    best, found = F.col("_best"), F.col("_recovered")
    recover = emails.normalize(best.company_email, rules).isNull() & found.isNotNull()

    def field(name: str) -> Column:
        if name not in EMAIL_FIELDS:
            return best[name].alias(name)
        value = found.email if name == "company_email" else found.address[name]
        return F.when(recover, value).otherwise(best[name]).alias(name)

    return merged.select("owner_id", *[field(c) for c in fields], "discovered_countries", "merged_records")


def company_addresses(owned: DataFrame, rules: EmailRules = EmailRules()) -> DataFrame:
    """One row per merged company and address with its best source. Excluded records add none."""
    allowed = owned.where((F.col("quality_decision") != "excluded") | (F.col("record_id") == F.col("owner_id")))
    rows = contact_variants(allowed, rules)
    fields = [c for c in EMAIL_FIELDS if c != "company_email"] + ["source_priority"]
    return (rows.groupBy("owner_id", "company_email")
            .agg(F.max_by(F.struct(*fields), F.struct("source_priority", "record_rank", -F.col("position"))).alias("_s"),
                 F.count("*").alias("mentions"))
            .select("owner_id", "company_email", "_s.*", "mentions"))


def company_assessments(owned: DataFrame) -> DataFrame:
    """Distinct country verdicts of each merged company."""
    fields = ["target_country", "verified_country", "country_score", "quality_decision", "priority"]
    return owned.select("owner_id", *fields).distinct()
