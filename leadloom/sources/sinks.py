"""Writers of report tables and of the approval file."""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, functions as F

from leadloom.operators.contacts import approval_columns


REPORT_MANIFEST = "run_id string, section string, attempt string, rows long, schema string"


def write_report(tables: dict[str, DataFrame], path: str, run_id: str, fmt: str = "parquet") -> None:
    """One folder per report section, one partition per run; writing a run again replaces only that run."""
    for name, table in tables.items():
        (table.withColumn("run_id", F.lit(run_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy("run_id")
         .format(fmt).save(f"{path}/{name}"))


def publish_report(tables: dict[str, DataFrame], path: str, run_id: str) -> DataFrame:
    """Write all sections of a report as one: readers (`readers.read_report`) see all of them or the report before.

    The sections go to a folder of this attempt. Only when each is complete is the run's manifest written over, one row per section
    with its attempt, number of rows as counted while writing, and schema. An attempt that fails leaves the manifest as it was.
    """
    if not tables:
        raise ValueError("a report has at least one section")
    spark, attempt = next(iter(tables.values())).sparkSession, f"{run_id}-{os.urandom(8).hex()}"
    rows = []
    for name, table in tables.items():
        counted = Observation()
        folder = f"{path.rstrip('/')}/data/{attempt}/{name}"
        table.observe(counted, F.count(F.lit(1)).alias("n")).write.parquet(folder)
        rows.append((run_id, name, attempt, counted.get["n"], spark.read.parquet(folder).schema.json()))
    manifest = spark.createDataFrame(rows, REPORT_MANIFEST)
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/manifests/{run_id}")
    return manifest


def export_approved(approved: DataFrame, path: str) -> None:
    """Approval file as CSV, safe to open in a spreadsheet. Spark writes UTF-8 without a byte order mark."""
    approval_columns(approved).write.mode("overwrite").csv(path, header=True)


def append_run_status(status: DataFrame, path: str) -> None:
    """Add one state of a run. States are only appended; readers take the latest per run."""
    status.write.mode("append").json(path)
