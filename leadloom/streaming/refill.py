"""Refill of a campaign: planned queries run batch by batch until the goals are met.

Before each batch the goals are looked at again. A country needs no more queries once it has enough analysed sites, approved addresses and
qualified companies and all countries together have enough addresses. Of the others, queries that ran before are left out, each country
takes its first ones up to its share of the calls, and all together up to the calls that are left. The results of the queries that
run are admitted for new (country, domain) pairs only and analysed.

The state between batches is one row per country (``totals``), written last under the batch's number, and two ledgers of keys. A
batch that runs again after a failure starts from the same state and leaves the same tables.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from leadloom.config import Campaign, ResultRules
from leadloom.operators.discovery import accepted, pool_candidates, prefilter_results
from leadloom.sources.stages import stored
from leadloom.streaming.ledger import KeyLedger

TOTALS = "country string, analysed long, qualified long, addresses long, calls long"
_SUMS = ["analysed", "qualified", "addresses", "calls"]


def totals_before(spark: SparkSession, out: str, batch_id: int, start: DataFrame | None = None) -> DataFrame:
    """State of each country before a batch: what the batch before it left, or ``start``, or nothing."""
    if batch_id:
        return stored(spark, TOTALS, f"{out}/totals/batch_id={batch_id - 1}")
    return spark.createDataFrame([], TOTALS) if start is None else start.select("country", *[F.col(c).cast("long").alias(c) for c in _SUMS])


def call_limit(campaign: Campaign, planned: int) -> tuple[int, int]:
    """Calls of the whole refill and of one country; without a stated number, all that are planned."""
    cap = campaign.max_queries or planned
    return cap, -(-cap // max(1, len(campaign.countries)))


def met(campaign: Campaign, all_addresses: int) -> Column:
    """Whether the country of a row of totals has all it needs."""
    n = max(1, len(campaign.countries))
    qualified = -(-(campaign.qualified_target or campaign.target_per_country * n) // n)
    here = ((F.col("analysed") >= -(-campaign.candidate_limit // n)) & (F.col("addresses") >= campaign.target_per_country) & (F.col("qualified") >= qualified))
    return here & F.lit(all_addresses >= campaign.email_target)


def admitted_queries(planned: DataFrame, totals: DataFrame, campaign: Campaign, cap: int, per_country: int) -> DataFrame:
    """The queries of a batch that run, by ``place``, under the goals and the calls left. ``planned``: place, country, keyword, query."""
    sums = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("addresses", "calls")]).first()
    # One row per country of the campaign.
    state = F.broadcast(totals.select("country", met(campaign, sums.addresses).alias("_met"), F.col("calls").alias("_calls")))
    once = planned.groupBy("country", "query").agg(F.min_by(F.struct("place", "keyword"), "place").alias("_q")).select("country", "query", "_q.*")
    first = once.groupBy("query").agg(F.min("place").alias("place"))
    rows = once.join(first, ["query", "place"]).join(state, "country", "left").where(~F.coalesce("_met", F.lit(False)))
    turn = F.row_number().over(Window.partitionBy("country").orderBy("place"))
    rows = rows.withColumn("_turn", turn).where(F.col("_turn") + F.coalesce("_calls", F.lit(0)) <= per_country)
    return rows.orderBy("place").limit(max(0, cap - sums.calls)).select("place", "country", "keyword", "query")


def after(totals: DataFrame, queries: DataFrame, records: DataFrame) -> DataFrame:
    """The totals with a batch's calls and outcomes added."""
    calls = queries.groupBy("country").agg(*[F.lit(0).cast("long").alias(c) for c in _SUMS[:3]], F.count("*").alias("calls"))
    found = records.groupBy("country").agg(F.count_distinct("domain").alias("analysed"), F.count_if("qualified").alias("qualified"),
                                           F.coalesce(F.sum("addresses"), F.lit(0)).alias("addresses"), F.lit(0).cast("long").alias("calls"))
    return totals.unionByName(calls).unionByName(found).groupBy("country").agg(*[F.sum(c).alias(c) for c in _SUMS])


def refill(planned: DataFrame, results: DataFrame, analyse: Callable[[DataFrame, int], DataFrame], out: str, checkpoint: str, campaign: Campaign,
           planned_count: int, rules: ResultRules = ResultRules(), country_facts: DataFrame | None = None, start: DataFrame | None = None,
           completed: DataFrame | None = None) -> StreamingQuery:
    """Run the stream of ``planned`` queries (place, country, keyword, query) batch by batch.

    ``results`` holds the saved results by ``query``. ``analyse`` is given a batch's new candidates and returns one row per site
    that could be analysed: country, domain, qualified, and its number of approved ``addresses``. ``completed`` has the (country, domain) pairs
    from before the refill. Tables under ``out``, by batch: ``queries``, ``pool``, ``records``, ``totals``.
    """
    cap, per_country = call_limit(campaign, planned_count)
    ran, known = KeyLedger(f"{out}/ran", "query string"), KeyLedger(f"{out}/known", "country string, domain string")

    def store(df: DataFrame, name: str, batch_id: int) -> DataFrame:
        path = f"{out}/{name}/batch_id={batch_id}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def each(batch: DataFrame, batch_id: int) -> None:
        totals = totals_before(batch.sparkSession, out, batch_id, start)
        queries = store(admitted_queries(ran.unseen(batch, batch_id), totals, campaign, cap, per_country), "queries", batch_id)
        ran.add(queries, batch_id)
        hits = prefilter_results(results.join(queries.select("query"), "query", "left_semi"), rules, country_facts)
        fresh = known.unseen(accepted(hits), batch_id)
        if completed is not None:
            fresh = fresh.join(completed.select("country", "domain").distinct(), ["country", "domain"], "left_anti")
        pool = store(pool_candidates(fresh), "pool", batch_id)
        known.add(pool, batch_id)
        records = store(analyse(pool, batch_id).select("country", "domain", F.col("qualified").cast("boolean").alias("qualified"), F.col("addresses").cast("long").alias("addresses")), "records", batch_id)
        store(after(totals, queries, records), "totals", batch_id)

    return planned.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
