"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent letter n-grams (1 to 3, words padded with a space), counted over all training
texts. A text's own most frequent n-grams are compared to each profile by the out-of-place distance: the sum of the rank
differences, with ``profile_size`` for an n-gram that the profile lacks. The nearest language wins, ties by its name.

Null texts and texts without a letter are ``und`` with score 0. Rows without an id are never held out. Repeated rows agree,
further columns are ignored, and an empty or unlabelled training set predicts ``und`` for all rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm import common

UNKNOWN = "und"
_BITS = 21  # of a code point


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """All n-grams of the lower-cased letter runs, packed into 63 bits; empty if there is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, dtype=np.int64)
    codes, letter = np.concatenate(([32], np.where(letter, codes, 32), [32])), np.concatenate(([False], letter, [False]))
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # one space after each run
    kept[0] = True
    codes = codes[kept]
    inner = codes != 32
    pairs = (codes[:-1] << _BITS) | codes[1:]
    triples = ((pairs[:-1] << _BITS) | codes[2:])[inner[1:-1]]
    return np.concatenate((codes[inner], pairs, triples))


def counted(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(packed, return_counts=True)


def top(packed: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in rank order; ties by n-gram."""
    values, counts = counted(packed)
    if len(values) > size:  # all n-grams that tie with the last one are still ranked below
        kept = counts >= np.partition(counts, -size)[-size]
        values, counts = values[kept], counts[kept]
    return values[np.argsort(-counts, kind="stable")[:size]]


COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch], chars: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[np.ndarray]] = {}
    sizes: dict[str, int] = {}

    def out(lang: str) -> pa.RecordBatch:
        values, counts = counted(np.concatenate(held.pop(lang)))
        sizes.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(values)), pa.array(values), pa.array(counts.astype(np.int64))], schema=COUNTS)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = grams(text.as_py())
            held.setdefault(lang, []).append(found)
            sizes[lang] = sizes.get(lang, 0) + len(found)
            if sizes[lang] >= chars:
                yield out(lang)
    for lang in list(held):
        yield out(lang)


def learn(docs: DataFrame, profile_size: int = 400, lang_col: str = "lang") -> DataFrame:
    """``lang``, ``gram`` and ``place`` (from 0) of each language's profile, counted over all rows with a language and a text."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col("text").isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    totals = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    return totals.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < profile_size).select("lang", "gram", "place")


class Profiles:
    """The profiles as one matrix of ranks: a row per language, a column per n-gram of any profile."""

    def __init__(self, rows: pd.DataFrame, profile_size: int):
        self.size = profile_size
        self.langs = sorted(rows["lang"].unique())
        self.grams = np.unique(rows["gram"].to_numpy(np.int64))
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), profile_size, dtype=np.int64)
        for row, lang in enumerate(self.langs):
            own = rows[rows["lang"] == lang]
            self.ranks[row, np.searchsorted(self.grams, own["gram"].to_numpy(np.int64))] = own["place"].to_numpy(np.int64)

    def nearest(self, text: str, compared: int) -> tuple[str, float]:
        packed = grams(text)
        if not len(packed) or not self.langs:
            return UNKNOWN, 0.0
        own = top(packed, compared)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        ranks = self.ranks[:, np.where(self.grams[at] == own, at, len(self.grams))]
        places = np.arange(len(own))
        apart = np.where(ranks == self.size, self.size, np.abs(ranks - places)).sum(axis=1)
        best = int(apart.argmin())
        return self.langs[best], 1.0 - float(apart[best]) / (self.size * len(own))


PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, profile_size: int = 400, compared: int = 300, parts: int = 3, held: int = 1) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` (1 less the share of the largest possible distance) of every row.

    Learns from the rows whose id's crc32 modulo ``parts`` is not ``held``. The model is ``profile_size`` rows per language.
    """
    training = docs.where(F.coalesce(common.bucket(F.col("doc_id").cast("long"), parts) != held, F.lit(True)))
    profiles = Profiles(learn(training, profile_size).toPandas(), profile_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return common.batches_of(((i, common.bucket_of(i, parts) == held, *profiles.nearest(t, compared)) for i, t in common.rows_of(batches)), PREDICTED)
    return common.texts(docs).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
