"""Toxic passages by maximum-scoring segments of token log-odds, and a document score by extreme-value calibration.

A word's score is the log-odds of toxic against clean texts that hold it, with Dirichlet priors in a chain: the prior of a word is the
posterior of its first six characters, theirs that of the first five, and so on to the share of toxic texts, so inflected forms that were
never seen share what their stem has shown. ``drift`` is taken off every word; the k-th time that a text repeats a word with a score above the
drift, it counts one k-th. One linear scan (Ruzzo and Tompa) then finds all maximal segments of a text. The best segments of clean texts follow
an extreme-value law, whose two parameters are fitted by maximum likelihood; a segment of score S in n words is expected
``K n exp(-lambda S)`` times by chance, and one with an expectation of ``most_expected`` or less is a toxic passage. A text's evidence is that of its
best r segments together (the sum statistic of such laws), for the r that is least likely by chance, and a logistic curve over the evidence is
the score.

The model is fitted on at most ``max_rows`` labelled rows, the first in the order of a hash of their ids (a documented bound). Equal
texts count once; three quarters of them give the words' counts, the rest the extreme-value law and the curve. Scoring takes every row and
whole texts. Null texts count as empty and get the score of no evidence; rows without an id are never held out; ids with several labels take the
lowest; null labels are left out. Without toxic and clean labels every score is 0.5. Repeated rows agree and further columns are ignored.
"""
from __future__ import annotations

import collections
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm import common

_LETTERS = re.compile(r"[^\W\d_]+")
_WORD = re.compile(r"\S+")
STEMS = (6, 5, 4, 3)


@dataclass
class Model:
    """Log-odds of words (with a closing ``$``) and stems that differ from their prior's, and the fitted curves."""

    odds: dict[str, float] = field(default_factory=dict)
    drift: float = 1.0
    rate: float = 1.0  # lambda
    scale: float = 0.1  # K
    offset: float = 0.0
    slope: float = 0.0
    most_expected: float = 0.01


def chain(word: str) -> list[str]:
    """A word and its stems, longest first."""
    return [word + "$", *(word[:k] for k in STEMS if len(word) > k)]


class Scorer:
    """Scores of words and segments of texts under a model."""

    def __init__(self, model: Model, remembered: int = 200_000):
        self.model, self.remembered, self.known = model, remembered, {}

    def _word(self, raw: str) -> float:
        best = None
        for part in _LETTERS.findall(raw.lower()):
            here = next((self.model.odds[node] for node in chain(part) if node in self.model.odds), 0.0)
            best = here if best is None or here > best else best
        if len(self.known) >= self.remembered:
            self.known.clear()
        found = self.known[raw] = best or 0.0
        return found

    def values(self, words: list[str]) -> np.ndarray:
        """What each word adds to a segment."""
        known, word = self.known, self._word
        values = np.array([known[w] if w in known else word(w) for w in words])
        seen = collections.Counter()
        for k in np.flatnonzero(values > self.model.drift).tolist():
            seen[words[k].lower()] += 1
            values[k] /= seen[words[k].lower()]
        return values - self.model.drift

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and (first word, word after the last, score) of every maximal segment."""
        words = text.split()
        return len(words), maximal(self.values(words)) if words else []

    def evidence(self, n_words: int, scores: list[float]) -> float:
        """Minus the logarithm of the chance of such segments in a clean text of that length, roughly."""
        model = self.model
        base = math.log(model.scale * max(1, n_words))
        best, total = min(0.0, -base), 0.0
        for r, score in enumerate(sorted(scores, reverse=True), 1):
            step = model.rate * score - base
            if r > 1 and step <= 0:
                break
            total += step
            found = total if r == 1 else total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r)
            best = found if r == 1 else max(best, found)
        return max(-30.0, min(60.0, best))

    def expected(self, n_words: int, score: float) -> float:
        return self.model.scale * n_words * math.exp(-self.model.rate * score)

    def score(self, text: str) -> tuple[float, int]:
        """Score of a text and its number of toxic passages."""
        n_words, found = self.segments(text)
        at = self.model.offset + self.model.slope * self.evidence(n_words, [s for _, _, s in found])
        return 1.0 / (1.0 + math.exp(-at)), sum(self.expected(n_words, s) <= self.model.most_expected for _, _, s in found)

    def passages(self, text: str) -> list[tuple[int, int, int, float, float]]:
        """(start, stop, number of words, score, expected number) of every toxic passage, in code points."""
        n_words, found = self.segments(text)
        found = [(a, b, s, e) for a, b, s in found if (e := self.expected(n_words, s)) <= self.model.most_expected]
        if not found:
            return []
        places = [m.span() for m in _WORD.finditer(text)]
        return [(places[a][0], places[b - 1][1], b - a, s, e) for a, b, s, e in found]


def maximal(values: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences, in order: (first, after the last, score). Linear in the number of values."""
    sums = np.concatenate([[0.0], np.cumsum(values)])
    # Of each: first, after the last, sum before, sum after, and the nearest candidate to the left with a smaller sum before (-1: none).
    held: list[tuple[int, int, float, float, int]] = []
    for k in np.flatnonzero(values > 0).tolist():
        first, before, after = k, float(sums[k]), float(sums[k + 1])
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= before:
                j = held[j][4]
            if j < 0 or held[j][3] >= after:
                held.append((first, k + 1, before, after, j))
                break
            first, before = held[j][0], held[j][2]
            del held[j:]
    return [(a, b, after - before) for a, b, before, after, _ in held]


SAMPLE = "place long, label long, text string"
NODES = pa.schema([("node", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
SEGMENTS = pa.schema([("label", pa.int64()), ("n_words", pa.int64()), ("scores", pa.list_(pa.float64()))])


def sample(docs: DataFrame, labels: DataFrame, max_rows: int, parts: int, held: int) -> DataFrame:
    """``place``, ``label`` and ``text`` of the distinct texts of at most ``max_rows`` labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("long").alias("label")).where("doc_id is not null and label is not null")
    chosen = (known.where(common.bucket(F.col("doc_id"), parts) != held).groupBy("doc_id").agg(F.min("label").alias("label"))
              .withColumn("place", F.xxhash64("doc_id")).orderBy("place").limit(max_rows))
    rows = common.texts(docs).join(F.broadcast(chosen), "doc_id")  # at most max_rows ids
    return rows.groupBy("text").agg(F.min("place").alias("place"), F.min("label").alias("label")).select("place", "label", "text")


def counted(rows: DataFrame, flush: int = 200_000) -> DataFrame:
    """``node``, and the number of ``toxic`` and ``clean`` texts that hold it, for every word and stem."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            both: tuple[collections.Counter, collections.Counter] = collections.Counter(), collections.Counter()
            for batch in batches:
                for label, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                    words = {part for raw in set(text.as_py().lower().split()) for part in _LETTERS.findall(raw)}
                    both[label > 0].update({node for word in words for node in chain(word)})
                    if len(both[0]) + len(both[1]) > flush:
                        yield from ((node, both[1][node], both[0][node]) for node in both[0].keys() | both[1].keys())
                        both = collections.Counter(), collections.Counter()
            yield from ((node, both[1][node], both[0][node]) for node in both[0].keys() | both[1].keys())
        return common.batches_of(each(), NODES)
    return rows.mapInArrow(run, "node string, toxic long, clean long").groupBy("node").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def odds(counts: dict[str, tuple[int, int]], toxic: int, clean: int, prior: float, nearest: float) -> dict[str, float]:
    """Log-odds of the nodes, against the share of toxic texts, that differ by ``nearest`` or more from what their stem says."""
    root = toxic / (toxic + clean)
    shares, found = {}, {}
    for node in sorted(counts, key=lambda n: (n[-1] == "$", len(n))):
        stems = chain(node[:-1])[1:] if node[-1] == "$" else [node[:k] for k in STEMS if k < len(node)]
        up = next((shares[s] for s in stems if s in shares), root)
        a, b = counts[node]
        share = shares[node] = (a + prior * up) / (a + b + prior)
        here = math.log(share / (1 - share)) - math.log(root / (1 - root))
        if abs(here - next((found[s] for s in stems if s in found), 0.0)) >= nearest:
            found[node] = here
    return found


def extreme_value(best: list[tuple[int, float]]) -> tuple[float, float]:
    """Maximum-likelihood rate and scale of P(best segment <= x in n words) = exp(-scale n exp(-rate x)), from (n, best) of clean texts."""
    if len(best) < 20:
        return 1.0, 0.1
    n, s = np.array([b[0] for b in best], float), np.array([b[1] for b in best], float)

    def slope(rate: float) -> float:
        weight = n * np.exp(-rate * s)
        return 1.0 / rate - s.mean() + (weight * s).sum() / weight.sum()

    low, high = 0.05, 5.0
    if slope(high) > 0:
        low = high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if slope(middle) > 0 else (low, middle)
    return low, float(len(best) / (n * np.exp(-low * s)).sum())


def logistic(points: list[tuple[float, int]], toxic: int, clean: int) -> tuple[float, float]:
    """Offset and slope of the curve, by Newton steps; drawn towards the odds of the classes and a slope of one by the weight of one text."""
    x, y = np.array([p[0] for p in points] or [0.0]), np.array([p[1] for p in points] or [0], float)
    ones = max(1, int(y.sum()))
    y = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2)) if points else y  # targets short of certainty
    at = start = np.array([math.log((toxic + 1) / (clean + 1)), 1.0])
    shape = np.stack([np.ones_like(x), x])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(at @ shape, -35, 35)))
        step = np.linalg.solve((shape * (p * (1 - p))) @ shape.T + 0.1 * np.eye(2), shape @ (p - y) * bool(points) + 0.1 * (at - start))
        at = at - np.clip(step, -1, 1)
    return float(at[0]), max(0.0, float(at[1]))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000, parts: int = 3, held: int = 1, drift: float = 1.0, prior: float = 2.0, least_texts: int = 3, nearest: float = 0.05) -> Model:
    """The model; a word or stem needs ``least_texts`` texts of the sample to have a score of its own."""
    rows = common.stage(sample(docs, labels, max_rows, parts, held))
    learn, check = rows.where(F.pmod("place", F.lit(4)) > 0), rows.where(F.pmod("place", F.lit(4)) == 0)
    totals = {r["toxic"]: r["n"] for r in learn.groupBy((F.col("label") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(True, 0), totals.get(False, 0)
    if not toxic or not clean:
        return Model(drift=drift)
    # Words of a bounded sample.
    table = counted(learn).where(F.col("toxic") + F.col("clean") >= least_texts).toArrow()
    counts = {node: (a, b) for node, a, b in zip(*(c.to_pylist() for c in table.columns))}
    model = Model(odds(counts, toxic, clean, prior, nearest), drift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            scorer = Scorer(model)
            for batch in batches:
                for label, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                    n_words, found = scorer.segments(text.as_py())
                    yield label, n_words, [s for _, _, s in found]
        return common.batches_of(each(), SEGMENTS, 256)

    seen = [(r["label"], r["n_words"], r["scores"]) for r in check.mapInArrow(run, "label long, n_words long, scores array<double>").collect()]
    model.rate, model.scale = extreme_value([(n, max(s, default=0.0)) for label, n, s in seen if label <= 0 and n])
    scorer = Scorer(model)
    model.offset, model.slope = logistic([(scorer.evidence(n, s), int(label > 0)) for label, n, s in seen], toxic, clean)
    return model


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_passages", pa.int64())])
PASSAGES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64()), ("expected", pa.float64()), ("passage", pa.string())])


def scores(docs: DataFrame, model: Model, threshold: float = 0.7, parts: int = 3, held: int = 1) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` and the number of toxic passages of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            scorer = Scorer(model)
            for doc_id, text in common.rows_of(batches):
                found, n = scorer.score(text)
                yield doc_id, common.bucket_of(doc_id, parts) == held, found, int(found >= threshold), n
        return common.batches_of(each(), SCORED)
    return common.texts(docs).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_passages long")


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """Every toxic passage: its document, span in code points, number of words, score, number expected by chance, and text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            scorer = Scorer(model)
            for doc_id, text in common.rows_of(batches):
                for start, stop, n, score, expected in scorer.passages(text):
                    yield doc_id, start, stop, n, score, expected, text[start:stop]
        return common.batches_of(each(), PASSAGES, 256)
    return common.texts(docs).mapInArrow(run, "doc_id long, start long, stop long, n_words long, score double, expected double, passage string")
