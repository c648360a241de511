"""One query ``opN_<name>`` per operator, over whole tables, with SQL where SQL can ask the same."""
from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leadloom.llm import (
    bpe, brown, common, contamination, conversations, extract, language, lines, oracles, quality, resampling, rules, secrets, simhash, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Tasks import this package. Where it is not installed, workers find it beside the driver's copy.
            spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return register


@query()
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"))


@query()
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(common.table(spark, sf_dir, "documents"))


@query()
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))


@query(oracles.SECRETS)
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(common.table(spark, sf_dir, "documents"))


@query()
def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(common.table(spark, sf_dir, "documents"))


@query()
def op8_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(common.table(spark, sf_dir, "documents"))


@query()
def op3_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(common.table(spark, sf_dir, "pages"))


@query(oracles.CONTAMINATION)
def op4_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


@query()
def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.dedup_passages(common.table(spark, sf_dir, "documents"))
    return rows.select("row.doc_id", "row.text", "n_lines", "n_removed")


@query(oracles.CONVERSATIONS)
def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(conversations.damaged(conversations.turns(common.table(spark, sf_dir, "conversations"))))


@query(oracles.RESAMPLING)
def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


@query()
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))
