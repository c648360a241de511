"""Incremental jobs on Structured Streaming.

Each batch writes under its own batch number and overwrites only that number, so a batch that runs
again after a failure leaves the same tables.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from leadloom.config import ResultRules
from leadloom.functions import urls
from leadloom.operators.discovery import accepted, pool_candidates, prefilter_results
from leadloom.sources.stages import stored
from leadloom.streaming.ledger import KeyLedger


def _stored(spark: SparkSession, path: str, schema: str, before: int) -> DataFrame:
    """Rows that earlier batches wrote; empty before the first one."""
    return stored(spark, f"{schema}, batch_id long", path).where(F.col("batch_id") < before).drop("batch_id")


def _store(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def _start(stream: DataFrame, each: Callable, checkpoint: str) -> StreamingQuery:
    return (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def incremental_pool(results: DataFrame, out: str, checkpoint: str, rules: ResultRules = ResultRules(),
                     country_facts: DataFrame | None = None,
                     analyse: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Admit only new country and domain pairs of each batch of search results.

    ``out`` holds the admitted candidates, ``out``.keys the ledger of their keys for later batches. ``analyse`` is
    called with the admitted candidates of each batch. Queries that follow the goals are run by `refill.refill`.
    """
    known = KeyLedger(f"{out.rstrip('/')}.keys", "country string, domain string")

    def each(batch: DataFrame, batch_id: int) -> None:
        fresh = known.unseen(accepted(prefilter_results(batch, rules, country_facts)), batch_id)
        _store(pool_candidates(fresh), out, batch_id)
        admitted = batch.sparkSession.read.parquet(f"{out}/batch_id={batch_id}")
        known.add(admitted, batch_id)
        if analyse is not None:
            analyse(admitted, batch_id)

    return _start(results, each, checkpoint)


def incremental_pages(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep each page once per run. The ledger of page keys (``out``.keys) is a table on disk, not operator state."""
    known = KeyLedger(f"{out.rstrip('/')}.keys", "page_key string")

    def each(batch: DataFrame, batch_id: int) -> None:
        keyed = known.unseen(batch.withColumn("page_key", urls.page_key("url")), batch_id)
        once = (keyed.groupBy("page_key").agg(F.min_by(F.struct(*batch.columns), "url").alias("_p"))
                .select("page_key", "_p.*"))
        _store(once, out, batch_id)
        known.add(batch.sparkSession.read.parquet(f"{out}/batch_id={batch_id}"), batch_id)

    return _start(pages, each, checkpoint)


def stateful_pages(pages: DataFrame, time: str | None = None, within: str = "1 day") -> DataFrame:
    """Streaming form with operator state. With a time column the state is dropped after ``within``."""
    keyed = pages.withColumn("page_key", urls.page_key("url"))
    if time is None:
        return keyed.dropDuplicates(["page_key"])
    return keyed.withWatermark(time, within).dropDuplicatesWithinWatermark(["page_key"])


def run_progress(batches: DataFrame, out: str, checkpoint: str, job_id: str) -> StreamingQuery:
    """Append one status row per batch; the latest row of a run is its state (`read_run_history`)."""
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _stored(spark, out, "progress_done long", batch_id).agg(F.coalesce(F.max("progress_done"), F.lit(0)))
        row = batch.agg(F.count("*").alias("_n")).select(
            F.lit(job_id).alias("job_id"), F.lit("running").alias("status"),
            F.current_timestamp().cast("string").alias("updated_at"), (before.scalar() + F.col("_n")).alias("progress_done"))
        _store(row, out, batch_id)

    return _start(batches, each, checkpoint)
