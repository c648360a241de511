"""Stored stages of a run that can go on after an interruption.

A stage is a table in the run's folder with a commit row of its own: first ``started``, and ``done`` once all files are in place, with a
fingerprint of what the stage was made from. A run with the same fingerprint reads finished stages and makes only the others; a run with
another one (other settings, other input files or rows) makes all of them again.
"""
from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from leadloom.functions import grouping

_COMMIT = "stage string, state string, fingerprint string"


def stored(spark: SparkSession, schema: str, *paths: str, base: str | None = None) -> DataFrame:
    """Rows under these paths; none where the first path does not exist yet."""
    reader = spark.read.schema(schema)
    try:
        return (reader.option("basePath", base) if base else reader).parquet(*paths)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def mark(df: DataFrame) -> str:
    """What tells an input from another: its files with sizes and times; or, for a table that is not read from files, its rows in any order."""
    try:
        parts = df.select("_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_modification_time").cast("string").alias("at")).distinct()
    except AnalysisException:
        parts = df
    each = F.xxhash64(*[F.col(f"`{c}`") for c in parts.columns])
    row = parts.agg(F.count("*").alias("n"), F.bit_xor(each).alias("x"), F.sum(F.pmod(each, F.lit(1 << 31))).alias("s")).first()
    return f"{df.schema.json()} {row.n} {row.x} {row.s}"


def fingerprint(*parts: object) -> str:
    """Of settings (by their representation) and of tables (by their marks)."""
    told = [mark(p) if isinstance(p, DataFrame) else repr(p) for p in parts]
    return hashlib.sha256("\n".join(told).encode()).hexdigest()


class Stages:
    """The stages of one run in ``folder``. Without a folder, tables are kept in reliable checkpoints and a new run starts over."""

    def __init__(self, spark: SparkSession, folder: str | None, fingerprint: str = ""):
        self.spark, self.folder, self.fingerprint = spark, folder and folder.rstrip("/"), fingerprint
        #: Names of the stages this run has made, and of those it found finished.
        self.made: list[str] = []
        self.found: list[str] = []

    def finished(self, name: str) -> bool:
        if self.folder is None:
            return False
        row = stored(self.spark, _COMMIT, f"{self.folder}/commits/{name}").first()
        return row is not None and (row.state, row.fingerprint) == ("done", self.fingerprint)

    def _commit(self, name: str, state: str) -> None:
        row = self.spark.createDataFrame([(name, state, self.fingerprint)], _COMMIT)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/{name}")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Store a table that is read more than once, unless an earlier attempt has finished it, and go on from the stored copy."""
        if self.folder is None:
            self.made.append(name)
            return grouping.durable(df)
        if self.finished(name):
            self.found.append(name)
        else:
            self._commit(name, "started")
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
            self._commit(name, "done")
            self.made.append(name)
        return self.spark.read.parquet(f"{self.folder}/{name}")
