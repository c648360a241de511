"""Readers of saved search responses, page corpora, creator files and run history."""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from leadloom.functions.vocabulary import CREATOR_HEADERS
from leadloom.sources.sinks import REPORT_MANIFEST
from leadloom.sources.stages import stored

SEARCH_RESPONSE = ("query string, country string, profile string, keyword string, task_idx int, request_id string, "
                   "results array<struct<title: string, url: string, content: string, description: string, score: double>>")
RUN_STATUS = ("job_id string, status string, created_at string, updated_at string, progress_done long, "
              "progress_total long, records long, sendable long, filename string, message string")


def read_search_results(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per result of every saved response; a response without results keeps one empty row.

    ``multi_line`` reads one response per file; without it each line is a response, and files can be split.
    """
    saved = spark.read.schema(SEARCH_RESPONSE).json(path, multiLine=multi_line)
    rows = saved.select("*", F.input_file_name().alias("source_file"),
                        F.posexplode_outer("results").alias("position", "_r")).drop("results")
    return rows.select("query", "country", "profile", "keyword", "task_idx", "request_id", "source_file", "position",
                       F.col("_r.title").alias("title"), F.col("_r.url").alias("url"),
                       F.coalesce("_r.content", "_r.description").alias("content"), F.col("_r.score").alias("score"))


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Page corpus with `url` and `html`. Pages are read whole."""
    pages = spark.read.format(fmt).load(path)
    return pages.where(F.coalesce("html", F.lit("")) != "")


def read_suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """Public-suffix rules, one a line with ``//`` comments, as `suffixes.with_registrable` takes them."""
    rows = spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\S*)", 1).alias("rule"))
    return rows.where((F.col("rule") != "") & ~F.col("rule").startswith("//"))


def read_report(spark: SparkSession, path: str, run_id: str) -> dict[str, DataFrame]:
    """The sections of a run's report as `sinks.publish_report` last published it, all of one attempt."""
    rows = stored(spark, REPORT_MANIFEST, f"{path.rstrip('/')}/manifests/{run_id}").collect()  # one per section
    return {r.section: spark.read.schema(T.StructType.fromJson(json.loads(r.schema))).parquet(f"{path.rstrip('/')}/data/{r.attempt}/{r.section}") for r in rows}


def read_tlds(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Top-level domains of a root-zone list, one a line, as `EmailRules.tlds` takes them. The list has a few thousand lines."""
    lines = spark.read.text(path).select(F.lower(F.trim("value")).alias("tld")).where("tld != '' AND NOT startswith(tld, '#')")
    return tuple(sorted(r.tld for r in lines.distinct().collect()))


def _number(value: Column, digits_only: bool) -> Column:
    """Follower count: ``48,000`` is 48000 when only digits count, and 48 when the leading number counts."""
    if digits_only:
        return F.nullif(F.regexp_replace(value, r"[^0-9]", ""), F.lit("")).try_cast("long")
    return F.regexp_extract(value, r"^\s*(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double").cast("long")


def read_creators(spark: SparkSession, path: str, headers: dict = CREATOR_HEADERS, digits_only: bool = True,
                  max_rows: int | None = None) -> DataFrame:
    """Creator list from CSV files with any of the known header spellings.

    Quoted fields may hold line breaks. Rows without a name or handle are dropped. ``max_rows`` limits
    one upload to its first rows.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=True,
                         ignoreTrailingWhiteSpace=True)
    present = {name.replace("﻿", "").strip(): name for name in raw.columns}
    if max_rows is not None:
        raw = raw.limit(max_rows)

    def field(name: str) -> Column:
        found = [F.nullif(F.trim(F.col(f"`{present[h]}`")), F.lit("")) for h in headers.get(name, ()) if h in present]
        return (F.coalesce(*found) if found else F.lit(None).cast("string")).alias(name)

    missing = [name for name in ("display_name", "handle", "country") if not any(h in present for h in headers[name])]
    if missing:
        raise ValueError(f"required columns are missing: {', '.join(missing)}")
    rows = raw.select(*[field(name) for name in headers])
    percent = F.regexp_extract(F.replace(F.coalesce("engagement", F.lit("")), F.lit("%"), F.lit("")),
                               r"^\s*(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return rows.where(F.col("display_name").isNotNull() & F.col("handle").isNotNull()).withColumns({
        "handle": F.regexp_replace("handle", "^@", ""),
        "followers": _number(F.coalesce("followers", F.lit("")), digits_only), "engagement": percent,
        "record_kind": F.coalesce("record_kind", F.lit("unmarked"))})


def read_run_history(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Latest state of each run from its status files, or from lines of states."""
    states = spark.read.schema(RUN_STATUS).json(path, multiLine=multi_line)
    fields = [c for c in states.columns if c != "job_id"]
    return (states.where(F.col("job_id").isNotNull()).groupBy("job_id")
            .agg(F.max_by(F.struct(*fields), "updated_at").alias("_s")).select("job_id", "_s.*"))
