"""Quality classifier: hashed word n-grams, logistic regression trained with follow-the-regularised-leader updates.

Features of a text are the words and word pairs, the shapes of words (letters and digits folded, punctuation kept) in runs of one to
three, and whether a word repeats the one before it; each is hashed to one of ``2**bits`` weights and counts by its share in the
text, so a score does not depend on the length. A score is the logistic of a sparse dot product.

The model is fitted on at most ``max_rows`` labelled rows, the first in the order of a hash of their ids (a documented bound; the
fit is one task over that bounded sample). Scoring takes every row. Null texts count as empty and get the score of the bias;
rows without an id are never held out; ids with several labels take the lowest; null labels are left out. Without any label every
score is 0.5. Repeated rows agree and further columns are ignored.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm import common

_FOLD = bytes(0x61 if c >= 0x80 or 0x61 <= c <= 0x7A else 0x41 if 0x41 <= c <= 0x5A else 0x30 if 0x30 <= c <= 0x39 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_shapes: dict[bytes, int] = {}


def _shape(folded: bytes) -> int:
    """Hash of a folded word with runs of one character shortened to two."""
    found = _shapes.get(folded)
    if found is None:
        short = bytearray()
        for c in folded:
            if len(short) < 2 or short[-1] != c or short[-2] != c:
                short.append(c)
        found = zlib.crc32(bytes(short))
        if len(_shapes) < 100_000:
            _shapes[folded] = found
    return found


def _slots(hashes: np.ndarray, kind: int, bits: int) -> np.ndarray:
    return ((hashes + np.uint64(kind)) * _MIX) >> np.uint64(64 - bits)


def features(text: str, bits: int) -> list[np.ndarray]:
    """Weight slots of each kind of n-gram, with repeats; slot 0 is kept for the bias."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return []
    word = np.array([zlib.crc32(w) for w in raw.lower().split()], dtype=np.uint64)
    shape = np.array([_shape(w) for w in raw.translate(_FOLD).split()], dtype=np.uint64)
    two, three = shape[:-1] * np.uint64(31) + shape[1:], None
    kinds = [(word, 1), (shape, 2)]
    if len(words) > 1:
        kinds += [(word[:-1] * np.uint64(0x100000001B3) ^ word[1:], 3), (two, 4), ((word[1:] == word[:-1]).astype(np.uint64), 5)]
    if len(words) > 2:
        three = two[:-1] * np.uint64(31) + shape[2:]
        kinds.append((three, 6))
    return [np.maximum(_slots(h, k, bits), 1).astype(np.int64) for h, k in kinds]


def sparse(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and shares of a text, with the bias in slot 0."""
    slots, shares = [np.zeros(1, dtype=np.int64)], [np.ones(1)]
    for kind in features(text, bits):
        found, counts = np.unique(kind, return_counts=True)
        slots.append(found)
        shares.append(counts / len(kind))
    return np.concatenate(slots), np.concatenate(shares)


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for logistic loss."""

    def __init__(self, bits: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, shares: np.ndarray, label: int) -> None:
        w = self.weights(at)
        gap = 1.0 / (1.0 + np.exp(-np.clip(w @ shares, -35, 35))) - label
        g = gap * shares
        then = self.n[at] + g * g
        np.add.at(self.z, at, g - (np.sqrt(then) - np.sqrt(self.n[at])) / self.alpha * w)
        np.add.at(self.n, at, g * g)


EXAMPLES = pa.schema([("place", pa.int64()), ("label", pa.int64()), ("slots", pa.list_(pa.int32())), ("shares", pa.list_(pa.float32()))])


def train(docs: DataFrame, labels: DataFrame, bits: int = 18, max_rows: int = 8000, epochs: int = 3, parts: int = 5, held: int = 0) -> np.ndarray:
    """Weights as 32-bit floats. Learns from labelled rows whose id's crc32 modulo ``parts`` is not ``held``."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("label")).where("doc_id is not null and label is not null")
    chosen = (known.where(common.bucket(F.col("doc_id"), parts) != held).groupBy("doc_id").agg(F.min("label").alias("label"))
              .withColumn("place", F.xxhash64("doc_id")).orderBy("place").limit(max_rows))
    rows = common.texts(docs).join(F.broadcast(chosen), "doc_id").select("place", "label", "text")  # at most max_rows ids

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in batches:
                for place, label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    slots, shares = sparse(text.as_py(), bits)
                    yield place, label, slots.astype(np.int32), shares.astype(np.float32)
        return common.batches_of(each(), EXAMPLES, 128)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, examples = Ftrl(bits), []
        for batch in batches:
            for k in range(batch.num_rows):
                examples.append((batch.column(1)[k].as_py(), batch.column(2)[k].values.to_numpy().astype(np.int64), batch.column(3)[k].values.to_numpy().astype(np.float64)))
        for _ in range(epochs if examples else 0):
            for label, slots, shares in examples:
                model.learn(slots, shares, label)
        packed = model.weights(slice(None)).astype("<f4").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["weights"])

    shown = rows.mapInArrow(vectors, "place long, label long, slots array<int>, shares array<float>")
    found = shown.repartition(1).sortWithinPartitions("place", "label").mapInArrow(fit, "weights binary").first()
    return np.frombuffer(bytes(found.weights), "<f4") if found else np.zeros(1 << bits, dtype="<f4")


def score(text: str, weights: np.ndarray) -> float:
    bits = len(weights).bit_length() - 1
    total = float(weights[0]) + sum(float(weights[kind].sum(dtype=np.float64)) / len(kind) for kind in features(text, bits))
    return float(1.0 / (1.0 + np.exp(-np.clip(total, -35.0, 35.0))))


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def scores(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3, parts: int = 5, held: int = 0) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for doc_id, text in common.rows_of(batches):
                found = score(text, weights)
                yield doc_id, common.bucket_of(doc_id, parts) == held, found, int(found >= threshold)
        return common.batches_of(each(), SCORED)
    return common.texts(docs).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, whole and with their columns, whose text scores ``threshold`` or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            good = [score(cell.as_py() or "", weights) >= threshold for cell in column]
            yield batch.filter(pa.array(good, pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
