"""Importance resampling towards a target distribution, over hashed n-gram features.

A text's words are its runs of letters a-z (A-Z lower-cased), digits and characters beyond ASCII; features are all runs of 1 to ``longest``
words joined by one space, repeats counted. A feature's bucket is the crc32 of its bytes modulo ``buckets``. A block of texts collects
its distinct features, groups their bytes by equal length into two-dimensional uint8 arrays, updates the crc of all rows column by column, and
scatters the buckets back to the places of the features. Tasks add up bucket counts before anything is shuffled: at most ``buckets`` rows each.

A bucket's gain compares the target's share with the corpus's, both smoothed by one. A document's weight is the floored mean gain of its
features, its score the weight plus Gumbel noise from a hash of its id, so the highest scores are a sample without replacement
in proportion to their weights. Ranks come from range-partitioned rows and the sizes of the partitions before them, not from one window.

Null and empty texts have no features, weight 0 and no rank. A null id hashes as the empty text and comes last among equals. Repeated rows
are documents of their own with ranks of their own; rows that agree in score and id come by their number of features. Without target texts
the gains follow the corpus alone. Further columns are ignored; an empty table stays empty.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.functions import grouping
from leadloom.llm import common

BUCKETS = 10_000
_WORD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A or 0x30 <= c <= 0x39 else 0x20 for c in range(256))
#: Characters of text that share a block.
BLOCK = 2_000_000


def _steps() -> np.ndarray:
    """What one byte does to a crc: eight shifts by the reversed polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (table & np.uint32(1)))
    return table


_STEPS = _steps()


def crc32_of(rows: np.ndarray) -> np.ndarray:
    """The crc32 of every row of a two-dimensional uint8 array, all rows a column at a time."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crc = _STEPS[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)


def buckets_of(distinct: list[bytes], buckets: int) -> np.ndarray:
    """The bucket of every feature, in their order: one matrix for each length."""
    sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
    order = np.argsort(sizes, kind="stable")
    found = np.empty(len(distinct), np.int64)
    for places in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(distinct) else ():
        size = int(sizes[places[0]])
        for at in range(0, len(places), max(1, (1 << 22) // max(1, size))):  # bounded matrices
            some = places[at:at + max(1, (1 << 22) // max(1, size))]
            matrix = np.frombuffer(b"".join([distinct[k] for k in some]), np.uint8).reshape(len(some), size)
            found[some] = crc32_of(matrix) % np.uint32(buckets)
    return found


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD).split(b" ")


def features_of(text: str, longest: int) -> tuple[int, list[bytes]]:
    """Number of words, and the features with repeats."""
    words = [w for w in words_of(text) if w]
    found = list(words)
    for n in range(2, longest + 1):
        found += [b" ".join(run) for run in zip(*(words[k:] for k in range(n)))]
    return len(words), found


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    held, size = [], 0
    for row in common.rows_of(batches):
        held.append(row)
        size += len(row[1])
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def bucketed(batches: Iterator[pa.RecordBatch], longest: int, buckets: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, number of words, bucket of every feature) of every row."""
    for block in _blocks(batches):
        place: dict[bytes, int] = {}
        texts = []
        for doc_id, text in block:
            n_words, found = features_of(text, longest)
            texts.append((doc_id, n_words, np.fromiter((place.setdefault(f, len(place)) for f in found), np.int64, len(found))))
        of = buckets_of(list(place), buckets)
        for doc_id, n_words, places in texts:
            yield doc_id, n_words, of[places]


COUNTS = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])
WEIGHED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64())])


def counts(docs: DataFrame, id_col: str, longest: int, buckets: int) -> DataFrame:
    """``bucket`` and its number ``n`` of features in all texts, for buckets that have any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, _, found in bucketed(batches, longest, buckets):
            total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], schema=COUNTS)
    return common.texts(docs, id_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, target_id: str = "item_id", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket; ``buckets`` rows of counts at most reach the driver."""
    own, wanted = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for held, found in ((own, counts(docs, "doc_id", longest, buckets)), (wanted, counts(target, target_id, longest, buckets))):
        for r in found.collect():
            held[r["bucket"]] = r["n"]
    s_all, t_all = float(own.sum() + buckets), float(wanted.sum() + buckets)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(own.tolist(), wanted.tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, from the first 32 bits of the sha256 of ``seed:doc_id``."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = 1, seed: int = 2024) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight`` and ``score`` of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for doc_id, n_words, found in bucketed(batches, longest, len(gain)):
                weight = int(gain[found].sum()) // len(found) if len(found) else 0
                yield doc_id, n_words, len(found), weight, weight + noise(doc_id, seed)
        return common.batches_of(each(), WEIGHED)
    return common.texts(docs).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, least_words: int = 20, percent: int = 10) -> DataFrame:
    """``rows`` of ``weighed`` with ``rank``: 1, 2, 3 ... for the ``percent`` of documents of ``least_words`` words or more that score highest, else null."""
    rows = common.stage(rows)
    long_enough = rows.where(F.col("n_words") >= least_words)
    drawn = percent * long_enough.count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.desc("weight")]
    numbered = grouping.sequential(long_enough, order)
    numbered = numbered.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    short = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return numbered.unionByName(short).select("doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, target_id: str = "item_id", longest: int = 1, buckets: int = BUCKETS, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """Every row's ``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank``."""
    return ranked(weighed(docs, gains(docs, target, target_id, longest, buckets), longest, seed), least_words, percent)


def drawn(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, with their columns, whose id is drawn."""
    ids = resample(docs, target, **settings).where("rank is not null").select(F.col("doc_id").alias("drawn_id")).distinct()
    return docs.join(ids, docs["doc_id"].cast("long") == ids["drawn_id"], "left_semi")
