"""Repeated chunks and passages of lines against a version that looks at every pair of neighbouring lines."""
from __future__ import annotations

import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from leadloom.llm import common, lines
from tests.llm import cases

LAST = (1 << 63) - 1


def hashes(spark, found: set[str]) -> dict[str, int]:
    rows = spark.createDataFrame([(x,) for x in sorted(found)], "line string").select("line", F.xxhash64("line").alias("h")).collect()
    return {r.line: r.h & 0xFFFFF for r in rows}


def chunk_starts(low: list[int]) -> list[int]:
    rolling = [((low[k - 1] if k else 0) * 65_599 + h) % 1_048_573 for k, h in enumerate(low)]
    if len(low) <= 3:
        return [0]
    return [0] + [k for k in range(2, len(low)) if rolling[k - 1] < rolling[k - 2] and rolling[k - 1] <= rolling[k]]


def naive_passages(spark, rows: list[tuple[int | None, str | None]]) -> dict:
    """(id, text) -> (text left, lines gone), by comparing the lines themselves."""
    full = lambda line: re.search(r"[^\x20\x09-\x0D]", line)
    words = lambda some: len(re.findall(r"[^\x20\x09-\x0D]+", "\n".join(some)))
    texts = {(LAST if i is None else i, t or ""): t for i, t in rows}
    own = {key: key[1].split("\n") for key in texts}
    low = hashes(spark, {line for ls in own.values() for line in ls})
    units = {}
    for key, ls in own.items():
        at = [k for k, line in enumerate(ls) if full(line)]
        found = [(a, b, False, ("pair", ls[a], ls[b])) for a, b in zip(at, at[1:])] + [(a, a, False, ("one", ls[a])) for a in at if words([ls[a]]) > 50]
        starts = chunk_starts([low[x] for x in ls])
        for a, b in zip(starts, [*starts[1:], len(ls)]):
            if sum(1 for line in ls[a:b] if full(line)) >= 2:
                found.append((a, b - 1, True, ("chunk", *ls[a:b])))
        units[key] = found
    times, first = Counter(u[3] for of in units.values() for u in of), {}
    for key, of in units.items():
        for u in of:
            first[u[3]] = min(first.get(u[3], LAST), key[0])
    out = {}
    for key, of in units.items():
        seen, again = set(), []
        for u in sorted(of, key=lambda u: u[0]):
            if times[u[3]] > 1 and (first[u[3]] != key[0] or u[3] in seen):
                again.append(u)
            seen.add(u[3])
        covered = sorted({k for a, b, _, _ in again for k in range(a, b + 1)})
        gone, run = {k for a, b, whole, _ in again if whole for k in range(a, b + 1)}, []
        for k in [*covered, None]:
            if run and k != run[-1] + 1:
                gone |= set(run) if words([own[key][j] for j in run]) > 50 else set()
                run = []
            run.append(k)
        left = [line for k, line in enumerate(own[key]) if k not in gone]
        if gone and not any(map(full, left)):
            left, gone = [], set(range(len(own[key])))
        out[key] = ("\n".join(left) if gone else texts[key], len(gone))
    return out


def invented(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(n))


def test_passages_equal_brute_force(spark):
    rng = random.Random(12)
    shared = [[invented(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 9))] for _ in range(12)] + [[invented(rng, 60)], ["Share", "", "Print"], [invented(rng, 51), "  ", invented(rng, 3)]]
    rows = []
    for k in range(140):
        ls = [invented(rng, rng.randint(1, 15)) for _ in range(rng.randint(0, 6))]
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(shared)
            part = part[rng.randint(0, len(part) - 1):] if rng.random() < 0.3 else part
            at = rng.randint(0, len(ls))
            ls[at:at] = part + ([""] if rng.random() < 0.4 else [])
        if k % 11 == 0:
            ls += [rng.choice(["same line again", ""])] * rng.randint(2, 60)
        rows.append((1000 - k, "\n".join(ls), "en"))
    rows += [(7, None, None), (8, "", "en"), (9, "\n \n", "en"), (None, rows[3][1], "en"), (None, "\n".join(shared[0]), "en"), rows[5], (rows[6][0], rows[7][1], "en"), (1, rows[20][1] + "\n" + rows[20][1], "en")]
    want = naive_passages(spark, [r[:2] for r in rows])
    frame = cases.documents(spark, rows).selectExpr("*", "1 AS pos", "2 AS h", "3 AS start", "'x' AS runs", "'y' AS lines2", "4 AS of", "5 AS of_key", "6 AS u").repartition(5)
    got = lines.dedup_passages(frame).select("row.*", "n_lines", "n_removed").collect()
    assert len(got) == len(rows) and lines.dedup_passages(frame).selectExpr("row.*").columns == frame.columns
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id and want[(LAST if i is None else i, t or "")] == (r.text, r.n_removed))
        assert r.n_lines == len((text or "").split("\n"))
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted((i or -1, want[(LAST if i is None else i, t or "")][0] or "") for i, t, _ in rows)
    assert sum(n > 0 for _, n in want.values()) > 60 and sum(n == 0 for _, n in want.values()) > 20


def test_many_lines_take_linear_time(spark):
    lines.dedup_passages(cases.documents(spark, [(1, "a\nb", "en")])).collect()
    taken = []
    for n in (2_500, 20_000):
        text = "\n".join(f"line {k} of {k * 7 % 1009}" for k in range(n))
        frame = cases.documents(spark, [(1, text, "en"), (2, text, "en"), (3, "\n".join(["x y"] * n), "en")])
        began = time.time()
        got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_passages(frame).select("row.doc_id", "row.text", "n_removed").collect()}
        taken.append(time.time() - began)
        assert got[1] == (text, 0) and got[2] == ("", n)
    assert taken[1] < 4 * taken[0] + 5  # eight times the lines


def test_lines_that_share_their_hashes_only_stay(spark):
    told = spark.createDataFrame([(1, 1, "a"), (2, 2, "a"), (3, 3, "b")], "id long, key long, line string")
    assert lines.unequal(told).count() == 0
    real = lines._names
    lines._names = lambda line: (F.length(line).cast("long").alias("h"), F.lit(0).cast("long").alias("c"))
    try:
        assert {(r["of"], r.of_key) for r in lines.unequal(told).collect()} == {(1, 1), (2, 2), (3, 3)}
    finally:
        lines._names = real
    assert common.WORD
