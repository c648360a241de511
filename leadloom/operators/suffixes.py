"""Registrable domains under public-suffix rules.

Rules are rows of one column ``rule``: a suffix (``co.uk``), a wildcard for one more label (``*.ck``) or an exception from one
(``!www.ck``). A host's labels give its suffixes, which meet the rules in an equi-join; an exception wins over all, then the longest match; a
host that no rule meets has a suffix of one label. Hosts are reduced to one row each first, so a host with a third of all pages
costs one row.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def suffix_rules(rules: DataFrame) -> DataFrame:
    """``suffix`` to meet, ``extra`` labels that the public suffix has beyond it, and whether it is an ``exception``."""
    rule = F.lower(F.trim("rule"))
    kept = rules.select(rule.alias("rule")).where((F.col("rule") != "") & ~F.col("rule").startswith("//")).distinct()
    return kept.select(
        F.regexp_replace("rule", r"^(\*\.|!)", "").alias("suffix"),
        F.when(F.col("rule").startswith("*."), 1).when(F.col("rule").startswith("!"), -1).otherwise(0).alias("extra"),
        F.col("rule").startswith("!").alias("exception"))


def registrable_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host``, its ``public_suffix`` and its ``registrable`` domain (the host itself where it is a suffix) for every distinct host."""
    once = hosts.select("host").where(F.col("host") != "").distinct().withColumn("labels", F.split("host", r"\."))
    # One row per label, so a host makes few rows.
    parts = once.select("host", "labels", F.posexplode("labels").alias("at", "label"))
    parts = parts.select("host", F.size("labels").alias("n"), (F.size("labels") - F.col("at")).alias("length"),
                         F.array_join(F.slice("labels", F.col("at") + 1, F.size("labels")), ".").alias("suffix"))
    met = parts.join(suffix_rules(rules), "suffix").where(F.col("length") + F.col("extra") <= F.col("n"))
    best = met.groupBy("host").agg(F.max(F.when(F.col("exception"), F.col("length") + F.col("extra"))).alias("excepted"),
                                   F.max(F.when(~F.col("exception"), F.col("length") + F.col("extra"))).alias("longest"))
    size = F.coalesce("excepted", "longest", F.lit(1))
    last = lambda n: F.array_join(F.slice("labels", F.greatest(F.size("labels") - n + 1, F.lit(1)), F.size("labels")), ".")
    return once.join(best, "host", "left").select("host", last(size).alias("public_suffix"), last(size + 1).alias("registrable"))


def with_registrable(df: DataFrame, rules: DataFrame, host: str = "host", name: str = "domain") -> DataFrame:
    """``df`` with the registrable domain of its column ``host``; an empty or missing host keeps itself."""
    # Counted per host before the join, which planner and adaptive execution size by bytes and split where a host is hot.
    found = registrable_hosts(df.select(F.col(host).alias("host")), rules).select(F.col("host").alias("_host"), F.col("registrable").alias("_registrable"))
    return df.join(found, F.col(host) == F.col("_host"), "left").withColumn(name, F.coalesce("_registrable", host)).drop("_host", "_registrable")
