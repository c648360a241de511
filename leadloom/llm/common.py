"""What the operators of this subpackage share: tables, row keys, shared stages, word rules."""
from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word, fixed by the contracts: a run of anything but space, tab, newline, vertical tab, form feed, return.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` as long and ``text`` (null: empty) alone, so that further columns cannot clash with any name used later."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def bucket(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def bucket_of(doc_id: int | None, parts: int) -> int | None:
    """``bucket`` for one id in a task."""
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % parts


def text_key(text: Column) -> Column:
    """With the id, the key of a row: rows that agree in both are one document and get the same decision."""
    return F.xxhash64(text)


def stage(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, in the shared folder the cluster names in spark.checkpoint.dir.

    Only where that is unset, as in a local session, a folder of its own is made.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="leadloom-llm-"))
    return df.checkpoint(eager=True)


def narrow_stage(df: DataFrame, per_task: int = 1 << 16) -> DataFrame:
    """``stage`` for rows of a few numbers: ``per_task`` rows are read by one task, however many partitions wrote them.

    A round over a small table otherwise runs a task, with its buffers and its shuffle files, for every partition of the step before.
    """
    seen = Observation()
    stored = stage(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return stored.coalesce(seen.get.get("n", 0) // per_task + 1)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str]]:
    """(doc_id, text) of Arrow batches in the form of ``texts``, a slice at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist())


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Arrow batches of row tuples; at least an empty one is not needed by Spark."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(column, type=field.type) for column, field in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(column, type=field.type) for column, field in zip(zip(*held), schema)], schema=schema)
