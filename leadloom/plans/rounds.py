"""A campaign over several industries: who gets the next queries, round after round.

The state of a round is one row per industry (``major``, ``queries``, ``sendable``, ``analysed``, ``qualified``, ``exhausted``) and one row per
country and industry of approved addresses, both stored under the round's number. A round grants the industry with the best yield three queries a
country, or what the budget has left; an industry that cannot use its grant is exhausted. The rounds end when all goals are met, the budget is spent or all
industries are exhausted. Only the one row of a grant reaches the driver.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadloom.config import Campaign
from leadloom.sources.stages import stored

STATE = "major string, queries long, sendable long, analysed long, qualified long, exhausted boolean"
MAIL = "country string, major string, addresses long"
GRANT = "major string, before long, granted long"
_SUMS = ["queries", "sendable", "analysed", "qualified"]


def base_grants(majors: DataFrame, base_queries: int, countries: int, budget: int) -> DataFrame:
    """What each industry may use before anyone uses the reserve, in the order of ``position`` as long as the budget lasts. ``majors``: major, position."""
    part = max(1, base_queries) * countries
    granted = F.greatest(F.lit(0), F.least(F.lit(part), F.lit(budget) - F.col("position") * part))
    return majors.select("major", F.lit(0).cast("long").alias("before"), granted.cast("long").alias("granted")).where("granted > 0")


def next_grant(state: DataFrame, mail: DataFrame, campaign: Campaign, budget: int) -> DataFrame:
    """One row (``major``, ``before``, ``granted``) for the next round, or none if the campaign is over."""
    n = len(campaign.countries)
    # One row per industry, and one per country and industry: all of these are single rows or smaller than the campaign's settings.
    sums = state.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"all_{c}") for c in _SUMS])
    enough = mail.where(F.col("country").isin(*campaign.countries)).groupBy("country").agg(F.sum("addresses").alias("a")).where(F.col("a") >= campaign.target_per_country).agg(
        F.count("*").alias("enough"))
    left = F.lit(budget) - F.col("all_queries")
    met = ((F.col("all_analysed") >= campaign.candidate_limit) & (F.col("all_sendable") >= campaign.email_target) & (F.col("enough") >= n)
           & (F.col("all_qualified") >= (campaign.qualified_target or campaign.target_per_country * n)))
    best = state.where(~F.col("exhausted")).agg(F.max_by(F.struct("major", "queries"), F.struct((F.col("sendable") / F.greatest("queries", F.lit(1))).alias("y"), F.col("major"))).alias("b"))
    rows = best.select("b", sums.select("all_queries").scalar().alias("all_queries"), sums.select("all_sendable").scalar().alias("all_sendable"),
                       sums.select("all_analysed").scalar().alias("all_analysed"), sums.select("all_qualified").scalar().alias("all_qualified"), enough.scalar().alias("enough"))
    rows = rows.where(F.col("b").isNotNull() & (left > 0) & ~met)
    return rows.select("b.major", F.col("b.queries").alias("before"), F.least(F.lit(3 * n), left).cast("long").alias("granted"))


def run_rounds(spark: SparkSession, majors: DataFrame, execute: Callable[[DataFrame, int], tuple[DataFrame, DataFrame]], out: str, campaign: Campaign, budget: int,
               base_queries: int = 5) -> DataFrame:
    """Run all rounds and return the state after each (``round`` 0 is the base round of all industries).

    ``execute`` is given the grants of a round and returns what they brought: per ``major`` the ``queries`` used and the new ``sendable``, ``analysed``
    and ``qualified``; and new approved ``addresses`` per ``country`` and ``major``. Rounds that ``out`` holds are not run again.
    """
    def store(df: DataFrame, name: str, turn: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}/round={turn}")
        return spark.read.schema(df.schema).parquet(f"{out}/{name}/round={turn}")

    done = stored(spark, "round int", f"{out}/state").agg(F.coalesce(F.max("round"), F.lit(-1))).first()[0]
    turn = done + 1
    while True:
        if turn:
            state, mail = (stored(spark, schema, f"{out}/{name}/round={turn - 1}") for name, schema in (("state", STATE), ("mail", MAIL)))
            grants = next_grant(state, mail, campaign, budget)
        else:
            nothing = [F.lit(0).cast("long").alias(c) for c in _SUMS]
            state, mail = majors.select("major", *nothing, F.lit(False).alias("exhausted")), spark.createDataFrame([], MAIL)
            grants = base_grants(majors, base_queries, len(campaign.countries), budget)
        grants = store(grants, "grants", turn)
        if grants.isEmpty():
            break
        found, addresses = execute(grants, turn)
        found = found.select("major", *[F.col(c).cast("long").alias(f"new_{c}") for c in _SUMS])
        both = state.join(found, "major", "left").join(grants.select("major", "granted"), "major", "left")
        used_up = F.col("granted").isNotNull() & (F.coalesce("new_queries", F.lit(0)) == 0)
        both = both.select("major", *[(F.col(c) + F.coalesce(f"new_{c}", F.lit(0))).alias(c) for c in _SUMS], (F.col("exhausted") | used_up).alias("exhausted"))
        store(mail.unionByName(addresses.select("country", "major", F.col("addresses").cast("long").alias("addresses"))).groupBy("country", "major").agg(F.sum("addresses").alias("addresses")), "mail", turn)
        store(both, "state", turn)  # last: a round counts once its state is there
        turn += 1
    return spark.read.schema(f"{STATE}, round int").parquet(f"{out}/state")
