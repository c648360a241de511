"""Small tables with the awkward rows: nulls, empty and long texts, ties, repeats, clashing column names."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(doc_id, text, lang) rows with columns whose names the operators use inside."""
    full = [(i, t, lang, "src1", None if t is None else len(t)) for i, t, lang in rows]
    frame = spark.createDataFrame(full, SCHEMA)
    return frame.selectExpr("*", "doc_id AS id", "7L AS key", "text AS row", "'x' AS words", "'y' AS lines", "3L AS bits", "'z' AS chunks", "1 AS rows", "2L AS found")


def awkward(spark: SparkSession, texts: list[str]) -> DataFrame:
    """The texts as documents 10, 11, ... with a null text, an empty one, blanks, a null id, a repeated row and a very long text."""
    rows = [(10 + k, t, "en") for k, t in enumerate(texts)]
    rows += [(1, None, None), (2, "", "en"), (3, " \t\n ", "en"), (None, texts[0], "en"), (10, texts[0], "en"), (4, " ".join(f"w{k}" for k in range(60_000)), "en"), (5, "x" * 300_000, "en")]
    return documents(spark, rows)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
