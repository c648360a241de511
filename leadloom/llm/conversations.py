"""Conversation structure repair over a suffix-shared automaton of role and fault signatures.

A conversation's rows become a signature with one character a row: the role's initial (s, u, a, or x for any other), in capitals if the
text is truncated, or d if the row must go (blank, or its role and text stood earlier). Signatures are distinct over all conversations and
sorted from their ends, so those with a common suffix are neighbours. The automaton is minimised from the end along that order: a node is
one distinct suffix, the nodes that the next signature shares are kept, and only new ones are made. Each node holds, for every state of the
grammar ``(s?(ua)+)?``, the cost to go and the first edit of the cheapest way. In one state every kind of edit leads to one state, so the smallest initial among the cheapest edits starts the
ASCII-least audit, and no audit is stored in a node. Solutions are joined back to the conversations by their signature.

Edits: keep 0, rerole 1 (to user or assistant), delete 2 (required for blank and duplicate rows), insert an empty turn 5; a truncated row
that is not deleted adds 5.

Rows are taken by turn (nulls first), then role, then a hash of the text. Null conversation ids are one conversation; a null role or text
is one space; an empty text is blank; a row with another role than the three can only be deleted or reroled. Repeated rows are duplicates.
A conversation without rows after the damage has zeros, an empty audit and the hash of nothing. Further columns are ignored; an empty table
stays empty. An answer is one row with an audit as long as its conversation, and its hash runs over the texts in order, so a conversation
is read by one task as a sorted stream; the task holds a few texts and some bytes a row of it.
"""
from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm import common

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a. The turn that each one asks for, and where each initial leads.
_WANTS = "uuau"
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_FORCED = tuple(_NEXT[q][_WANTS[q]] for q in range(4))
_FULL = r"[^\x20\x09-\x0D]"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"

SIGNED = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("signature", pa.string())])
SOLVED = pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
REPAIRED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]
REPORT = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` without nulls in the last two, and ``present``: true."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"), F.lit(True).alias("present"))


def damaged(rows: DataFrame) -> DataFrame:
    """``turns`` with the faults that the crc32 of ``conv_id:turn`` modulo 20 puts in; a dropped row stays as one that is not ``present``."""
    named = F.concat(_text("conv_id"), F.lit(":"), _text("turn"))
    code = F.crc32(F.encode(named, "UTF-8")) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(code == 4, "user").otherwise(F.col("role"))
    one = F.struct("conv_id", "turn", role.alias("role"), text.alias("text"), (code != 0).alias("present"))
    return rows.select(F.explode(F.when(code == 3, F.array(one, one)).otherwise(F.array(one))).alias("r")).select("r.*")


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``digest``, the hash of the text that orders rows of one turn and role."""
    return rows.withColumn("digest", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))


def faults(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``digest``, ``present``, ``fault`` (blank, duplicate, truncated or null) and ``again`` of every row, in partitions by conversation."""
    narrow = _placed(rows).select("conv_id", "turn", "role", "digest", "present", F.rlike("text", F.lit(_FULL)).alias("full"), F.rlike("text", F.lit(_ENDED)).alias("ended")).repartition("conv_id")
    # The window finds its rows where they are: partitions by conversation are partitions by anything finer.
    again = F.row_number().over(Window.partitionBy("conv_id", "present", "role", "digest").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(~F.col("full"), "blank").when(F.col("again"), "duplicate").when(~F.col("ended"), "truncated")
    return narrow.withColumn("again", again).select("conv_id", "turn", "role", "digest", "present", fault.alias("fault"), "again")


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 32):  # few texts at a time
            yield from zip(*(column.to_pylist() for column in batch.slice(at, 32).columns))


def signatures(rows: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, the counts of the report and the ``signature``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            last, held = None, None
            for conv, turn, role, present, fault in _streams(batches):
                if held is None or conv != last:
                    if held is not None:
                        yield last, *held.row()
                    last, held = conv, _Signature()
                if present:
                    held.add(turn, role[:1], fault)
            if held is not None:
                yield last, *held.row()
        return common.batches_of(each(), SIGNED, 1024)

    # Of equal rows of one turn, the one that is no duplicate comes first.
    ordered = faults(rows).sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest", "again")
    return ordered.select("conv_id", "turn", "role", "present", "fault").mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string")


class _Signature:
    """Counts and signature of one conversation, row by row in order."""

    def __init__(self) -> None:
        self.first = self.last = None
        self.distinct, self.illegal, self.before, self.marks = 0, 0, None, bytearray()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}

    def add(self, turn: int | None, initial: str, fault: str | None) -> None:
        if turn is not None and (self.first is None or turn != self.last):
            self.first, self.last = turn if self.first is None else self.first, turn
            self.distinct += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if fault is not None:
            self.counts[fault] += 1
        mark = initial if initial in _ROLES else "x"
        self.marks += ("d" if fault in ("blank", "duplicate") else mark.upper() if fault else mark).encode()

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return gaps, *self.counts.values(), self.illegal, self.marks.decode()


class Automaton:
    """The nodes of the suffixes of the signature at hand: four costs to go and four first edits each, the end's first."""

    def __init__(self) -> None:
        self.spelled = ""  # the current signature from its end
        self.costs, self.edits = array("q"), bytearray()
        self.made = 0
        self._node([0, 2 * INSERT, INSERT, 0], [" ", "I", "I", " "])

    def _node(self, costs: list[int], edits: list[str]) -> None:
        self.costs.extend(costs)
        self.edits += "".join(edits).encode()
        self.made += 1

    def _push(self, mark: str) -> None:
        after = self.costs[-4:]
        role, broken = mark.lower(), TRUNCATED * mark.isupper()
        costs, edits = [DELETE + c for c in after], ["D"] * 4
        if mark != "d":
            for q in range(4):
                to = _NEXT[q].get(role)
                if to is not None and KEEP + broken + after[to] < costs[q]:
                    costs[q], edits[q] = KEEP + broken + after[to], "K"
                if REROLE + broken + after[_FORCED[q]] < costs[q]:
                    costs[q], edits[q] = REROLE + broken + after[_FORCED[q]], "R"
        for _ in range(3):  # inserted turns lead to other states of the same node; three reach the farthest
            for q in range(4):
                cost = INSERT + costs[_FORCED[q]]
                if cost < costs[q] or (cost == costs[q] and edits[q] in "KR"):
                    costs[q], edits[q] = cost, "I"
        self._node(costs, edits)

    def solve(self, signature: str) -> tuple[int, str]:
        """Cost and audit. Nodes of the suffix shared with the signature before are kept."""
        spelled, shared = signature[::-1], 0
        for mine, other in zip(spelled, self.spelled):
            if mine != other:
                break
            shared += 1
        del self.costs[4 * (shared + 1):], self.edits[4 * (shared + 1):]
        for mark in spelled[shared:]:
            self._push(mark)
        self.spelled = spelled
        audit, q, at = bytearray(), 0, len(spelled)
        while (edit := self.edits[4 * at + q]) != 0x20:
            audit.append(edit)
            if edit == 0x4B:  # K
                q = _NEXT[q][spelled[at - 1].lower()]
            elif edit != 0x44:  # R, I
                q = _FORCED[q]
            at -= edit != 0x49
        return self.costs[4 * len(spelled)], audit.decode()


def solutions(signed: DataFrame) -> DataFrame:
    """``signature``, ``cost`` and ``audit`` of every distinct signature, each automaton node made once in the range of suffixes that a task has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        return common.batches_of(((s, *automaton.solve(s)) for (s,) in _streams(batches)), SOLVED, 1024)

    distinct = signed.select("signature").distinct().withColumn("spelled", F.reverse("signature"))
    return distinct.repartitionByRange("spelled").sortWithinPartitions("spelled").select("signature").mapInArrow(run, "signature string, cost long, audit string")


def solved(rows: DataFrame) -> DataFrame:
    """The rows of ``signatures`` with ``cost`` and ``audit``."""
    signed = common.stage(signatures(rows))
    return signed.join(solutions(signed), "signature")


class _Editor:
    """Applies an audit to the rows of a conversation as they come."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._forced(), "", "I"

    def _forced(self) -> str:
        role, self.state = _ROLES[_WANTS[self.state]], _FORCED[self.state]
        return role

    def edit(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _NEXT[self.state][role[:1]]
            yield role, text, edit
        elif edit == "R":
            yield self._forced(), text, edit


def _told(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Each conversation's answer, then its rows in order, in one partition."""
    present = _placed(rows).where("present").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text")
    answers = answers.select("conv_id", F.lit(0).alias("kind"), "audit", "cost", *_COUNTS)
    both = answers.unionByName(present, allowMissingColumns=True).repartition("conv_id")
    both = both.sortWithinPartitions(F.asc_nulls_first("conv_id"), "kind", F.asc_nulls_first("turn"), "role", "digest")
    return both.select("conv_id", "kind", "role", "text", "audit", "cost", *_COUNTS)


def repaired(rows: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """The repaired conversations: ``conv_id``, ``place`` (from 1), ``role``, ``text`` and the ``edit`` that gave the row (K, R or I)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            editor, conv, place = None, None, 0
            for here, kind, role, text, audit, *_ in _streams(batches):
                if kind == 0:
                    for out in editor.inserted() if editor else ():
                        place += 1
                        yield conv, place, *out
                    editor, conv, place = _Editor(audit), here, 0
                    continue
                for out in editor.edit(role, text):
                    place += 1
                    yield conv, place, *out
            for out in editor.inserted() if editor else ():
                place += 1
                yield conv, place, *out
        return common.batches_of(each(), REPAIRED, 256)
    return _told(rows, solved(rows) if answers is None else answers).mapInArrow(run, "conv_id long, place long, role string, text string, edit string")


def report(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows``: its counts, ``cost``, ``audit`` and the sha256 of the repaired ``role:text`` lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            held = None
            for conv, kind, role, text, audit, cost, *counts in _streams(batches):
                if kind == 0:
                    if held is not None:
                        yield held.row()
                    held = _Digest(conv, audit, cost, counts)
                else:
                    held.take(held.editor.edit(role, text))
            if held is not None:
                yield held.row()
        return common.batches_of(each(), REPORT, 256)

    columns = ", ".join(["conv_id long", *[f"{c} long" for c in _COUNTS], "cost long", "audit string", "repaired_sha256 string"])
    return _told(rows, solved(rows)).mapInArrow(run, columns)


class _Digest:
    """The report row of one conversation, hashed line by line."""

    def __init__(self, conv: int | None, audit: str, cost: int, counts: list[int]) -> None:
        self.conv, self.cost, self.counts = conv, cost, counts
        self.editor, self.hash, self.gap = _Editor(audit), hashlib.sha256(), ""

    def take(self, lines: Iterable[tuple[str, str, str]]) -> None:
        for role, text, _ in lines:
            self.hash.update(f"{self.gap}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.gap = "\n"

    def row(self) -> tuple:
        self.take(self.editor.inserted())
        return self.conv, *self.counts, self.cost, self.editor.audit, self.hash.hexdigest()
