"""Group-wise helpers that stay safe when one key holds a large part of all rows.

Every helper reduces rows inside the map tasks before anything is shuffled, so no task ever
receives a whole hot group.
"""
from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def best_row(columns, *order: Column) -> Column:
    """Aggregate: the row with the smallest order values, as a struct. Partial results are one row."""
    return F.min_by(F.struct(*columns), F.struct(*order))


def first_k(df: DataFrame, keys, order, k: int, spread=None, salts: int = 64) -> DataFrame:
    """First ``k`` rows of each group, with their place in ``place``.

    Rows are ranked inside (key, salt) first, so a key with a third of all rows is spread over ``salts`` groups and
    hands on ``salts * k`` rows at most, for any ``k``. The salt is a hash of the columns ``spread`` (default: ``order``,
    if that is a list of names), which should tell rows of a group apart.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    salt = F.pmod(F.xxhash64(*(spread or order)), F.lit(salts))
    inner = Window.partitionBy(*keys, "_salt").orderBy(*columns)
    few = df.withColumn("_salt", salt).withColumn("_inner", F.row_number().over(inner)).where(F.col("_inner") <= k)
    window = Window.partitionBy(*keys).orderBy(*columns)
    return few.drop("_salt", "_inner").withColumn("place", F.row_number().over(window)).where(F.col("place") <= k)


def first_k_array(df: DataFrame, keys, order, k: int, value: str, name: str) -> DataFrame:
    """One row per group with its first ``k`` values in order."""
    pairs = F.sort_array(F.collect_list(F.struct("place", value)))
    return (first_k(df, keys, order, k).groupBy(*keys)
            .agg(F.transform(pairs, lambda pair: pair[value]).alias(name)))


def sequential(df: DataFrame, order, name: str = "rank") -> DataFrame:
    """Number all rows 1..n in the given order without a single-task window.

    The sorted rows are range partitioned; each row is numbered inside its partition and shifted by
    the size of the partitions before it. The sorted rows are written once, because the numbers and
    the sizes must come from the same sort.
    """
    spread = F.monotonically_increasing_id()
    sorted_rows = durable(df.orderBy(*order).withColumn("_place", spread))
    part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = sorted_rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    # One row per partition of the sort: bounded by the number of shuffle partitions.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    numbered = sorted_rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return (numbered.withColumn(name, (F.col("_offset") + place + 1).cast("long"))
            .drop("_part", "_place", "_offset"))


def settle(df: DataFrame, *columns: str) -> DataFrame:
    """Keep Spark from moving later filters below costly columns.

    A filter on a derived column is normally pushed down with the whole expression copied into it, so
    long text expressions would run once per use. The partition id makes the step non-deterministic
    for the optimizer; values do not change.
    """
    here = F.spark_partition_id() >= 0
    return df.withColumns({c: F.when(here, F.col(c)) for c in columns})


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage in reliable storage, so a lost executor costs a re-read and not a re-run."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in spark.checkpoint.dir.

    A session on one machine that names none gets a folder of its own there; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="leadloom-")
