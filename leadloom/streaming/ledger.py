"""Keys that earlier batches have seen, in buckets by their hash.

A batch reads only the buckets that its own keys fall into. Buckets lie side by side, sorted, in ``FOLDERS`` folders at most: more than that
Spark lists with a task for each, whose answers all go to the driver. Every ``fold`` batches the folders since the last fold become one,
so a batch lists one folded folder and at most ``fold`` others, however many batches there were. Each folder
belongs to one batch number and is overwritten as a whole, and a fold counts once its mark is written: a batch that runs again
after a failure reads and writes the same.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leadloom.sources.stages import stored

#: Folder and bucket of a key: a filter on the folder chooses files, one on the bucket chooses parts of sorted files.
_FOLDER, _BUCKET = "key_bucket", "bucket_of_key"
FOLDERS = 32


class KeyLedger:
    """``keys``: name and type of each key column, as a schema string. The number of buckets belongs to the stored ledger."""

    def __init__(self, path: str, keys: str, buckets: int = 256, fold: int = 16):
        self.path, self.schema, self.buckets, self.fold = path.rstrip("/"), keys, buckets, fold
        self.keys = [part.split()[0] for part in keys.split(",")]
        self._stored = f"{keys}, {_BUCKET} int, {_FOLDER} int"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _folder(self, bucket):
        """Folder of a bucket, a number or a column."""
        return bucket if self.buckets <= FOLDERS else bucket % FOLDERS

    def _folded(self, spark: SparkSession, batch_id: int) -> int:
        """The batch before which all keys are in one folder; 0 if there is none."""
        due = batch_id // self.fold * self.fold
        if not due or stored(spark, "upto long", f"{self.path}/marks/of={due}").first() is not None:
            return due
        # The fold was another one in an earlier run.
        marks = stored(spark, "upto long", f"{self.path}/marks").where(F.col("upto") <= batch_id)
        return marks.agg(F.coalesce(F.max("upto"), F.lit(0)).alias("upto")).first().upto

    def seen(self, spark: SparkSession, batch_id: int, buckets: list[int] | None = None) -> DataFrame:
        """Keys of the batches before this one, of all buckets or of these."""
        upto, schema = self._folded(spark, batch_id), self._stored
        folders = [f"{self.path}/folded/upto={upto}"] if upto else []
        folders += [f"{self.path}/batches/batch_id={b}" for b in range(upto, batch_id)]
        rows = [stored(spark, schema, folder) for folder in folders]
        found = spark.createDataFrame([], schema) if not rows else rows[0]
        for more in rows[1:]:
            found = found.union(more)
        if buckets is not None:
            found = found.where(F.col(_FOLDER).isin(sorted({self._folder(b) for b in buckets})) & F.col(_BUCKET).isin(buckets))
        return found.select(*self.keys)

    def touched(self, batch: DataFrame) -> list[int]:
        """Buckets of a batch's keys; at most ``buckets`` numbers."""
        return sorted(r.b for r in batch.select(self._bucket().alias("b")).distinct().collect())

    def unseen(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Rows of ``batch`` whose keys no earlier batch has."""
        # Merged: as a broadcast all keys of these buckets would go to the driver in every batch.
        seen = self.seen(batch.sparkSession, batch_id, self.touched(batch)).hint("merge")
        return batch.join(seen, self.keys, "left_anti")

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """The batch's new keys; every ``fold`` batches also one folder of all keys so far."""
        spark = rows.sparkSession
        self._write(rows.select(*self.keys).distinct(), f"{self.path}/batches/batch_id={batch_id}")
        if (batch_id + 1) % self.fold == 0:
            upto = batch_id + 1
            self._write(self.seen(spark, batch_id).union(stored(spark, self._stored, f"{self.path}/batches/batch_id={batch_id}").select(*self.keys)),
                        f"{self.path}/folded/upto={upto}")
            spark.createDataFrame([(upto,)], "upto long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/of={upto}")

    def _write(self, keys: DataFrame, folder: str) -> None:
        rows = keys.withColumn(_BUCKET, self._bucket()).withColumn(_FOLDER, self._folder(F.col(_BUCKET)).cast("int"))
        rows.repartition(_FOLDER, _BUCKET).sortWithinPartitions(_FOLDER, _BUCKET).write.mode("overwrite").partitionBy(_FOLDER).parquet(folder)
