"""Byte-pair encoding and decoding of whole texts by a pair occurrence index.

The distinct pieces of a block of texts are laid out as one chain of symbols. An index maps each mergeable pair to
all its positions; the ranks that occur are taken in ascending order from a heap, every position of the pair is merged,
and the lists of the two pairs that each merge creates are updated. A piece seen before in the same task process is
looked up. Work and memory follow the number of distinct pieces, not the square of a piece's length.

Null texts count as empty (no ids). Repeated rows give repeated results, further columns are ignored, an empty table gives
an empty table. The special token's string inside a text is that token, as in the public library's plain use.
"""
from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from leadloom.llm import common

#: Fixed value: the pattern that splits a text before the merges of byte-level vocabularies.
PIECES = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
          r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_SHIFT = 1 << 20


def _byte_symbols() -> dict[str, int]:
    """Printable Latin-1 characters stand for themselves, the other bytes for characters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class PairIndexBpe:
    """Vocabulary and merges of a byte-level tokenizer file, with a bounded memory of pieces already encoded."""

    def __init__(self, path: str, remembered: int = 600_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        symbols, vocab = _byte_symbols(), spec["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(symbols[c] for c in token) for token, i in vocab.items()}
        self.first = np.zeros(256, dtype=np.int64)
        for char, byte in symbols.items():
            self.first[byte] = vocab[char]
        self.ranks: dict[int, int] = {}
        self.pairs: list[tuple[int, int, int]] = []  # by rank: left, right and merged symbol
        made: dict[int, int] = {}
        for rank, (left, right) in enumerate(spec["model"]["merges"]):
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            # A rank never undercuts the merge that made its parts: only then are ranks of all pieces safe to apply in one ascent.
            if made.get(a, -1) >= rank or made.get(b, -1) >= rank or c in made:
                raise ValueError("merges are not in the order in which their symbols are made")
            made[c] = rank
            self.ranks[a * _SHIFT + b] = rank
            self.pairs.append((a, b, c))
        self.first_ranks = np.array([[self.ranks.get(a * _SHIFT + b, -1) for b in self.first.tolist()] for a in self.first.tolist()])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._pieces = regex.compile(PIECES)
        self.known: dict[str, bytes] = {}
        self.remembered = remembered

    def split(self, text: str) -> list[str]:
        """Pieces of the text; special tokens are pieces of their own."""
        if self._cut is None or not any(s in text for s in self.special):
            return self._pieces.findall(text)
        out: list[str] = []
        for part in self._cut.split(text):
            out.extend([part] if part in self.special else self._pieces.findall(part))
        return out

    def learn(self, pieces: set[str]) -> None:
        """Encodes the pieces together and keeps their ids, packed as little-endian 32-bit integers."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > self.remembered:
            self.known.clear()
            new = list(pieces)
        plain = [p for p in new if p not in self.special]
        self.known.update((p, np.array([self.special[p]], "<u4").tobytes()) for p in new if p in self.special)
        self.known.update(zip(plain, self._merge([p.encode() for p in plain])))

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        size = sum(map(len, pieces)) + len(pieces)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1)
        raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        laid = self.first[raw]
        laid[ends - 1] = -1  # between pieces
        # The index of the first pairs: ranks in ascending order, the positions of each in ascending order.
        ranks = np.where((laid[:-1] >= 0) & (laid[1:] >= 0), self.first_ranks[raw[:-1], raw[1:]], -1)
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        found, cuts = np.unique(ranks[at], return_index=True)
        where = {r: p.tolist() for r, p in zip(found.tolist(), np.split(at, cuts[1:]))} if len(found) else {}
        active = list(where)  # ascending, so already a heap
        symbol = laid.tolist()
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        rank_of, push, pop, pairs = self.ranks.get, heapq.heappush, heapq.heappop, self.pairs
        while active:
            rank = pop(active)
            left, right, merged = pairs[rank]
            high = merged * _SHIFT
            spots = where.pop(rank)
            spots.sort()
            for at in spots:
                then = after[at]
                if symbol[at] != left or symbol[then] != right:
                    continue  # an overlapping occurrence took one of the two
                symbol[at], symbol[then] = merged, -2
                behind = after[at] = after[then]
                before[behind] = at
                new = rank_of(high + symbol[behind])
                if new is not None:
                    if new in where:
                        where[new].append(at)
                    else:
                        where[new] = [at]
                        push(active, new)
                ahead = before[at]
                if ahead >= 0:
                    new = rank_of(symbol[ahead] * _SHIFT + merged)
                    if new is not None:
                        if new in where:
                            where[new].append(ahead)
                        else:
                            where[new] = [ahead]
                            push(active, new)
        left_over = np.array(symbol, dtype=np.int64)
        keep = left_over >= 0
        counts = np.concatenate(([0], np.cumsum(keep)))[np.concatenate(([0], ends))] * 4
        packed = left_over[keep].astype("<u4").tobytes()
        bounds = counts.tolist()
        return [packed[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        split = [self.split(t) for t in texts]
        wanted = set().union(*split)
        self.learn(wanted)
        known = self.known
        return [b"".join([known[p] for p in pieces]) for pieces in split]

    def decode(self, packed: bytes) -> str:
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(packed, "<u4").tolist()]).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def load(path: str) -> PairIndexBpe:
    return PairIndexBpe(path)


CODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
TOKENS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def _blocks(rows: Iterator[tuple], chars: int = 1 << 21) -> Iterator[list[tuple]]:
    """Runs of texts with about two million characters: the partition's pair index is built for one run at a time."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def _coded(path: str) -> Iterator:
    def run(batches):
        model = load(path)

        def rows():
            for block in _blocks(common.rows_of(batches)):
                for (doc_id, _), packed in zip(block, model.encode([t for _, t in block])):
                    yield (doc_id, len(packed) // 4, hashlib.sha256(packed).hexdigest(),
                           hashlib.sha256(model.decode(packed).encode()).hexdigest())
        return common.batches_of(rows(), CODED)
    return run


def _tokens(path: str) -> Iterator:
    def run(batches):
        model = load(path)

        def rows():
            for block in _blocks(common.rows_of(batches)):
                for (doc_id, _), packed in zip(block, model.encode([t for _, t in block])):
                    yield doc_id, np.frombuffer(packed, "<u4").astype(np.int32), model.decode(packed)
        return common.batches_of(rows(), TOKENS, 256)
    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` and the text ``decoded`` from them, of every row."""
    return common.texts(docs).mapInArrow(_tokens(path), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, and the SHA-256 of the packed ids and of the decoded text, of every row."""
    return common.texts(docs).mapInArrow(_coded(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
