"""Language-model scores by a Brown class bigram model.

Exchange clustering assigns words to classes; a text's probability is the product of class transitions and word emissions.
The units that are exchanged are the (at most) ``vocabulary`` most frequent words and, for all other words, the ``endings`` groups of their
last letters, so every word has a class and the model's size does not grow with the corpus. Word counts do: they are summed
over all training texts with a shuffle, and the counts of words outside the ``frequent`` most frequent ones (a bounded table that
tasks hold) reach the texts by a join.

An exchange sweep gathers each unit's left and right class counts in tasks that own the unit's whole context, and then moves one
unit after the other to the class that gains most likelihood. Smoothing: transitions are mixed with the class frequencies;
emissions add ``added`` to each count and keep one share per class for words never seen.

Null texts count as empty: one end token. Rows without an id are training rows. Repeated rows agree and count repeatedly.
Further columns are ignored. With no training row every token is unknown and all counts are zero.
"""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm import common

ADDED = 0.1
COUNTS = pa.schema([("word", pa.binary()), ("n", pa.int64())])
PAIRS = pa.schema([("left", pa.int32()), ("right", pa.int32()), ("n", pa.int64())])
ROWS = pa.schema([("unit", pa.int32()), ("side", pa.int32()), ("counts", pa.list_(pa.int64()))])


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_counts(training: DataFrame, held: int = 300_000) -> DataFrame:
    """``word`` and ``n`` over all training texts; a task keeps at most about ``held`` words before it hands them on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            counts: Counter[bytes] = Counter()
            for _, text in common.rows_of(batches):
                counts.update(words_of(text))
                if len(counts) > held:
                    yield from counts.items()
                    counts = Counter()
            yield from counts.items()
        return common.batches_of(each(), COUNTS, 16_384)
    return training.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words above a count that at most ``most`` words reach, in descending order.

    The count is one of eight steps per doubling, found from a histogram of a few hundred rows, so no task hands over more words.
    """
    step = F.floor(F.log2("n") * 8)
    seen, lowest = 0, None
    for row in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):  # 8 * 63 rows at most
        seen += row["count"]
        if seen > most:
            break
        lowest = row.step
    rows = [] if lowest is None else counts.where(step >= lowest).collect()
    return sorted(((bytes(r.word), r.n) for r in rows), key=lambda x: (-x[1], x[0]))


class Units:
    """Unit 0 is the end of a text, then the most frequent words, then the groups of word endings."""

    def __init__(self, vocabulary: list[bytes], endings: int):
        self.of = {w: k + 1 for k, w in enumerate(vocabulary)}
        self.first_ending, self.endings = len(vocabulary) + 1, endings
        self.size = self.first_ending + endings

    def unit(self, word: bytes) -> int:
        found = self.of.get(word)
        return self.first_ending + zlib.crc32(word.rstrip(b".,;:!?")[-3:]) % self.endings if found is None else found


def unit_totals(counts: DataFrame, units: Units) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each unit."""
    size = units.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, distinct = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            at = np.fromiter(map(units.unit, batch.column(0).to_pylist()), np.int64, batch.num_rows)
            np.add.at(tokens, at, batch.column(1).to_numpy())
            np.add.at(distinct, at, 1)
        at = np.flatnonzero(distinct)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(tokens[at]), pa.array(distinct[at])], names=["unit", "tokens", "words"])

    rows = counts.mapInArrow(run, "unit long, tokens long, words long").groupBy("unit").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect()
    tokens, distinct = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for row in rows:  # one per unit
        tokens[row.unit], distinct[row.unit] = row.tokens, row.words
    return tokens, distinct


class Coder:
    """Unit ids of texts, with the ids of words met before kept in a bounded memory."""

    def __init__(self, units: Units, remembered: int = 300_000):
        self.units, self.remembered, self.known = units, remembered, dict(units.of)

    def codes(self, words: list[bytes]) -> list[int]:
        known = self.known
        out = [known.get(w, -1) for w in words]
        if -1 in out:
            if len(known) > self.remembered:
                known = self.known = dict(self.units.of)
            for k, code in enumerate(out):
                if code < 0:
                    w = words[k]
                    out[k] = known[w] = self.units.unit(w)
        return out


def contexts(training: DataFrame, units: Units) -> DataFrame:
    """``unit``, ``side``, ``other`` and ``n``: which units stand beside each unit, dealt out by unit."""
    size = units.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen, held = Coder(units), np.zeros(size * size, np.int64), []

        def add() -> None:
            chain = np.array(held, dtype=np.int64)
            np.add(seen, np.bincount(chain[:-1] * size + chain[1:], minlength=size * size), out=seen)

        for _, text in common.rows_of(batches):
            if not held:
                held.append(0)
            held.extend(coder.codes(words_of(text)))
            held.append(0)  # the end of one text stands before the next one
            if len(held) > 500_000:
                add()
                held = []
        if held:
            add()
        found = np.flatnonzero(seen)
        for at in range(0, len(found), 65_536):
            part = found[at:at + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array((part // size).astype(np.int32)), pa.array((part % size).astype(np.int32)), pa.array(seen[part])], schema=PAIRS)

    pairs = training.mapInArrow(run, "left int, right int, n long").groupBy("left", "right").agg(F.sum("n").alias("n"))
    sides = F.explode(F.array(F.struct(F.col("left").alias("unit"), F.lit(0).alias("side"), F.col("right").alias("other")),
                              F.struct(F.col("right").alias("unit"), F.lit(1).alias("side"), F.col("left").alias("other"))))
    rows = pairs.select(sides.alias("at"), "n").select("at.unit", "at.side", "at.other", "n")
    return common.stage(rows.repartition("unit"))


def class_counts(beside: DataFrame, of: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Right and left class counts of each unit, without the unit's own pairs with itself in a row of their own."""
    size = len(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 * size, classes + 1), np.int64)
        for batch in batches:
            unit, side, other, n = (batch.column(k).to_numpy().astype(np.int64) for k in range(4))
            column = np.where(unit == other, classes, of[other])
            np.add.at(total, (unit * 2 + side, column), n)
        for row in np.flatnonzero(total.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([row // 2], pa.int32()), pa.array([row % 2], pa.int32()), pa.array([total[row]], pa.list_(pa.int64()))], schema=ROWS)

    out = np.zeros((2, size, classes + 1), np.int64)
    for row in beside.mapInArrow(run, "unit int, side int, counts array<long>").toLocalIterator():  # two rows per unit
        out[row.side, row.unit] += np.array(row.counts, np.int64)
    return out[0], out[1]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def transitions(right: np.ndarray, of: np.ndarray, classes: int) -> np.ndarray:
    """Class by class pair counts from the units' right class counts."""
    table = np.zeros((classes, classes), np.int64)
    np.add.at(table, of, right[:, :classes])
    np.add.at(table, (of, of), right[:, classes])
    return table


def exchange(right: np.ndarray, left: np.ndarray, of: np.ndarray, classes: int) -> int:
    """One sweep over the units in order; changes ``of`` and returns the number of moves. The end unit keeps class 0 for itself."""
    table, moved, every = transitions(right, of, classes), 0, np.arange(classes)
    for unit in range(1, len(of)):
        go, come, own = right[unit, :classes], left[unit, :classes], right[unit, classes]
        if not go.any() and not come.any():
            continue
        now = of[unit]
        table[now] -= go
        table[:, now] -= come
        table[now, now] -= own
        rows = _xlogx(table + go) - _xlogx(table)
        columns = (_xlogx(table.T + come) - _xlogx(table.T))
        rows[every, every] = columns[every, every] = 0
        middle = table[every, every]
        gain = rows.sum(axis=1) + columns.sum(axis=1) + _xlogx(middle + go + come + own) - _xlogx(middle)
        out_of, into = table.sum(axis=1), table.sum(axis=0)
        gain -= _xlogx(out_of + go.sum() + own) - _xlogx(out_of) + _xlogx(into + come.sum() + own) - _xlogx(into)
        gain[0] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= gain[now] + 1e-9:
            best = now
        moved += best != now
        of[unit] = best
        table[best] += go
        table[:, best] += come
        table[best, best] += own
    return moved


class Model:
    """Classes, logarithms of transitions, and what emissions need."""

    def __init__(self, units: Units, of: np.ndarray, table: np.ndarray, tokens: np.ndarray, words: np.ndarray, ends: int, frequent: dict[bytes, int], mixed: float = 5.0):
        self.units, self.of, self.frequent = units, of, frequent
        self.train_tokens = int(tokens.sum()) + ends
        self.base_log = float(np.log10(self.train_tokens + ADDED * (int(words.sum()) + (ends > 0) + 1)))
        classes = len(table)
        in_class = np.bincount(of, tokens, classes)
        distinct = np.bincount(of, words, classes)
        self.class_log = np.log10(in_class + ADDED * (distinct + 1))
        share = (table.sum(axis=0) + 1.0) / (table.sum() + classes)
        self.move_log = np.log10((table + mixed * share) / (table.sum(axis=1, keepdims=True) + mixed))
        self.end_log = float(np.log10((ends + ADDED)) - self.base_log)


TEXTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_part", pa.float64()), ("score_part", pa.float64()),
                   ("rest", pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32()), ("of", pa.int32())])))])


def _text_parts(model: Model, ends: int) -> Iterator:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, frequent, of = Coder(model.units), model.frequent, model.of

        def each():
            for doc_id, text in common.rows_of(batches):
                words = words_of(text)
                codes = coder.codes(words)
                chain = of[np.array([0, *codes, 0], dtype=np.int64)]
                moves = float(model.move_log[chain[:-1], chain[1:]].sum())
                found = np.array([frequent.get(w, 0) for w in words], dtype=np.int64)
                known = found > 0
                logs = np.log10(found[known] + ADDED)
                base = float(logs.sum()) - model.base_log * int(known.sum()) + model.end_log
                emitted = float(logs.sum() - model.class_log[chain[1:-1][known]].sum())
                rest = Counter(w for w, n in zip(words, found.tolist()) if not n)
                yield (doc_id, len(words) + 1, int(known.sum()) + (ends > 0), base, moves + emitted,
                       [{"word": w, "n": n, "of": int(of[coder.codes([w])[0]])} for w, n in rest.items()])
        return common.batches_of(each(), TEXTS, 256)
    return run


def fit(training: DataFrame, vocabulary: int = 1024, endings: int = 256, classes: int = 48, sweeps: int = 6, frequent: int = 65_536) -> tuple[Model, DataFrame, int]:
    """The model, the counts of all training words, and the number of training texts."""
    counts = common.stage(word_counts(training))
    ends = training.count()
    first = most_frequent(counts, frequent)
    units = Units([w for w, _ in first[:vocabulary]], endings)
    tokens, words = unit_totals(counts, units)
    beside = contexts(training, units)
    of = 1 + np.arange(units.size) % (classes - 1)  # frequent words start apart from each other
    of[0] = 0
    right = left = None
    for _ in range(sweeps):
        right, left = class_counts(beside, of, classes)
        if not exchange(right, left, of, classes):
            break
    right, _ = class_counts(beside, of, classes)
    return Model(units, of, transitions(right, of, classes), tokens, words, ends, dict(first)), counts, ends


def score(docs: DataFrame, parts: int = 10, held: int = 0, **sizes: int) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and ``perplexity`` of every row."""
    rows = common.texts(docs)
    out = common.bucket(F.col("doc_id"), parts) == held
    model, counts, ends = fit(rows.where(~F.coalesce(out, F.lit(False))), **sizes)
    parts_of = common.stage(rows.mapInArrow(_text_parts(model, ends), "doc_id long, n_tokens long, n_known long, base_part double, score_part double, rest array<struct<word: binary, n: int, of: int>>")
                            .withColumn("row", F.monotonically_increasing_id()))
    each = parts_of.select("row", F.explode("rest").alias("w")).select("row", "w.word", F.col("w.n").alias("times"), F.col("w.of").alias("of"))
    found = each.join(counts, "word", "left")
    logs = F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADDED))
    class_log = F.get(F.array(*[F.lit(float(x)) for x in model.class_log]), F.col("of"))
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
                                    F.sum(F.col("times") * (logs - F.lit(model.base_log))).alias("more_base"),
                                    F.sum(F.col("times") * (logs - class_log)).alias("more_score"))
    joined = parts_of.drop("rest").join(sums, "row", "left")
    total = F.col("score_part") + F.coalesce("more_score", F.lit(0.0))
    return joined.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
                         F.lit(model.train_tokens).cast("long").alias("train_tokens"), (F.col("base_part") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
                         total.alias("score"), F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"))
