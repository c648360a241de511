"""Creator search: results in, ranked profiles with drafts out."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from leadloom.config import CreatorSearch, CreatorTerms, Product, Sender
from leadloom.operators import creators as cr, planning, reports


@dataclass
class CreatorTables:
    gated: DataFrame
    unique: DataFrame
    top: DataFrame
    summary: DataFrame


def run(results: DataFrame, search: CreatorSearch, sender: Sender = Sender(), product: Product = Product(),
        terms: CreatorTerms = CreatorTerms()) -> CreatorTables:
    """Queries stop once twice the wanted number of profiles is known; only executed queries count.

    ``results``: arrival, task_idx, query, url, title, content.
    """
    profiles = cr.gate_creators(cr.read_profiles(results, search, terms), search)
    tasks = results.select(F.lit(search.country).alias("country"), "task_idx").distinct()
    found = profiles.where(F.col("reject_reason").isNull()).select("country", "task_idx", F.col("handle").alias("domain"))
    limits = planning.stop_points(tasks, found, search.target_count * 2, 1).select("country", "needed_tasks")
    # One row per country.
    gated = profiles.join(F.broadcast(limits), "country").where(F.col("task_idx") < F.col("needed_tasks")).drop("needed_tasks")
    unique = cr.dedup_creators(cr.score_creators(gated, search, terms))
    top = cr.draft_outreach(cr.top_creators(unique, search.target_count), sender, product)
    return CreatorTables(gated, unique, top, reports.creator_summary(top, results, gated))
