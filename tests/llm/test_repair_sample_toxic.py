"""Conversation repair, importance resampling and toxicity against brute force, on small tables with awkward rows."""
from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import conversations, oracles, resampling, toxicity
from tests.llm import cases

# Conversations

LEADS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NAMES = {"u": "user", "a": "assistant"}


def cheapest(rows: list[tuple[str, str, bool, bool]], most_inserts: int = 3) -> tuple[int, str, list[str]]:
    """Every way to edit (role, text, must go, truncated) rows, by trying all; the least cost, then the least audit."""
    found = []

    def go(at: int, state: int, cost: int, audit: str, out: list[str], run: int) -> None:
        if found and cost > found[0][0]:
            return
        if at == len(rows) and state in (0, 3):
            found[:] = [min([*found, (cost, audit, out)], key=lambda x: x[:2])]
        for initial in "ua":
            if run < most_inserts and initial in LEADS[state]:
                go(at, LEADS[state][initial], cost + 5, audit + "I", [*out, f"{NAMES[initial]}:"], run + 1)
        if at < len(rows):
            role, text, must, broken = rows[at]
            go(at + 1, state, cost + 2, audit + "D", out, 0)
            if not must:
                if role[:1] in LEADS[state]:
                    go(at + 1, LEADS[state][role[:1]], cost + 5 * broken, audit + "K", [*out, f"{role}:{text}"], 0)
                for initial in "ua":
                    if initial in LEADS[state]:
                        go(at + 1, LEADS[state][initial], cost + 1 + 5 * broken, audit + "R", [*out, f"{NAMES[initial]}:{text}"], 0)

    go(0, 0, 0, "", [], 0)
    return found[0]


def test_automaton_equals_all_edits():
    rng = random.Random(3)
    signatures = ["".join(x) for n in range(4) for x in itertools.product("suaxSUAXd", repeat=n)]
    signatures += ["".join(rng.choices("suaUAd", k=rng.randint(4, 7))) for _ in range(150)]
    signatures.sort(key=lambda s: s[::-1])
    automaton = conversations.Automaton()
    for signature in signatures:
        rows = [(m.lower(), "", m == "d", m.isupper()) for m in signature]
        assert automaton.solve(signature) == cheapest(rows)[:2]
    nodes = {s[k:] for s in signatures for k in range(len(s) + 1)}
    assert automaton.made == len(nodes)  # one node for each distinct suffix


def expected_report(rows: list[tuple]) -> dict:
    """The report of damaged conversations, row by row."""
    out = {}
    for conv in {r[0] for r in rows}:
        held = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            code = zlib.crc32(name.encode()) % 20
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            held += [] if code == 0 else [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        turns = [r[0] for r in held if r[0] is not None]
        seen, marked, counts = set(), [], [0, 0, 0]
        for _, role, text in held:
            full = text.strip(" \t\n\v\f\r")
            kind = 0 if not full else 1 if (role, text) in seen else 2 if full[-1] not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, kind in (0, 1), kind == 2))
            if kind is not None:
                counts[kind] += 1
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, lines = cheapest(marked)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


CONVERSATION = "conv_id long, turn long, role string, text string"


def some_conversations() -> list[tuple]:
    rng, rows = random.Random(8), []
    for conv in [*range(90), None]:
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]) if conv != 5 else "user"
            text = rng.choice(["Yes.", "no", "Why? \t", "", " \n", None, "a.b", f"Text {rng.randint(0, 99)}!", "end. "])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    rows += [rows[0], rows[0], (300, -4, "user", "Hm."), (300, -1, "assistant", "Hm."), (301, None, "user", "One."), (301, None, "user", "Two.")]
    rows += [(400 + k, t, "user", "x") for k in range(40) for t in [k] if zlib.crc32(f"{400 + k}:{t}".encode()) % 20 == 0]  # nothing is left of these
    rows.append((500, 0, "user", "long " * 60_000 + "."))
    return rows


def test_report_equals_row_by_row(spark):
    rows = some_conversations()
    table = spark.createDataFrame(rows, CONVERSATION).selectExpr("*", "1 AS kind", "'x' AS audit", "'y' AS digest", "false AS present", "'z' AS r", "7 AS signature").repartition(5)
    found = conversations.report(conversations.damaged(conversations.turns(table))).collect()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found}
    assert len(found) == len(got) and got == expected_report(rows)
    assert any(v[-1] == hashlib.sha256(b"").hexdigest() and v[:-1] == (0,) * 6 + ("",) for v in got.values())


def test_repaired_rows_follow_the_grammar(spark):
    rows = conversations.damaged(conversations.turns(spark.createDataFrame(some_conversations(), CONVERSATION)))
    kept, lines = conversations.repaired(rows).collect(), {}
    for r in sorted(kept, key=lambda r: r.place):
        lines.setdefault(r.conv_id, []).append(r)
    told = {r.conv_id: r for r in conversations.report(rows).collect()}
    for conv, of in lines.items():
        assert re.fullmatch("s?(ua)+", "".join(r.role[:1] for r in of)) and [r.place for r in of] == list(range(1, len(of) + 1))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in of).encode()).hexdigest() == told[conv].repaired_sha256
    assert conversations.report(conversations.damaged(conversations.turns(spark.createDataFrame([], CONVERSATION)))).count() == 0


def test_conversations_in_sql(spark, tmp_path):
    # Text orders of equal turns are tested row by row; SQL gets rows whose turns tell them apart.
    rows = list({(r[0], r[1]): r for r in some_conversations()}.values())
    spark.createDataFrame(rows, CONVERSATION).write.parquet(str(tmp_path / "c"))
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
        names = [d[0] for d in con.execute(oracles.CONVERSATIONS).description]
        sql = {r[0]: r[1:] for r in con.execute(oracles.CONVERSATIONS).fetchall()}
    assert names == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sql == expected_report(rows)


# Resampling

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text: str | None, longest: int) -> tuple[int, list[str]]:
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[k:k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def resampled(docs: list[tuple], target: list[str | None], longest: int, buckets: int, percent: int) -> list[tuple]:
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own, wanted = np.zeros(buckets), np.zeros(buckets)
    for text in (t for _, t in docs):
        for f in runs(text, longest)[1]:
            own[bucket(f)] += 1
    for text in target:
        for f in runs(text, longest)[1]:
            wanted[bucket(f)] += 1
    out = []
    for doc_id, text in docs:
        n_words, features = runs(text, longest)
        gain = [math.floor(1000 * math.log((wanted[b] + 1) * (own.sum() + buckets) / ((own[b] + 1) * (wanted.sum() + buckets)))) for b in map(bucket, features)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    long = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1], -r[2]))
    for k, r in enumerate(long[:percent * len(long) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_crc_matrices_equal_zlib():
    rng = random.Random(1)
    features = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 2, 7, 40, 41]))) for _ in range(3000)] + [b"x" * 100_000]
    assert resampling.buckets_of(features, 10_000).tolist() == [zlib.crc32(f) % 10_000 for f in features]
    assert resampling.buckets_of([], 10).tolist() == []


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10_000, 10), (2, 500, 37)])
def test_resampling_equals_brute_force(spark, longest, buckets, percent):
    rng = random.Random(4)
    words = ["the", "THE", "Café", "λόγος", "x9", "a-b", "don't", "日本", "zero\x00byte", "under_score", "no\xa0break"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(150)]
    frame = cases.awkward(spark, texts)
    docs = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    target = [" ".join(rng.choices(words[:4], k=30)) for _ in range(5)] + [None, ""]
    items = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    found = resampling.resample(frame.repartition(4), items, longest=longest, buckets=buckets, percent=percent)
    assert sorted((tuple(r) for r in found.collect()), key=str) == resampled(docs, target, longest, buckets, percent)
    ids = {r.doc_id for r in found.where("rank IS NOT NULL").collect()}
    taken = resampling.drawn(frame, items, longest=longest, buckets=buckets, percent=percent)
    assert taken.columns == frame.columns and {r.doc_id for r in taken.collect()} == ids - {None}


def test_resampling_of_nothing(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(cases.empty(spark), items).count() == 0
    frame = cases.documents(spark, [(k, f"word{k} " * 25, "en") for k in range(10)] + [(None, None, None)])
    assert sorted(r.rank for r in resampling.resample(frame, items).collect() if r.rank is not None) == [1]


# Toxicity


def segments_by_definition(values: list[float]) -> list[tuple[int, int]]:
    """The segment of the highest sum, then the same left and right of it; the shortest of equals, from the left."""
    best, span = 0.0, None
    for a in range(len(values)):
        total = 0.0
        for b in range(a, len(values)):
            total += values[b]
            if total > best or (span and total == best and b + 1 - a < span[1] - span[0]):
                best, span = total, (a, b + 1)
    if span is None:
        return []
    a, b = span
    return segments_by_definition(values[:a]) + [span] + [(b + x, b + y) for x, y in segments_by_definition(values[b:])]


def test_maximal_segments_equal_their_definition():
    rng = random.Random(2)
    for _ in range(400):
        values = [rng.choice([-3, -2, -1, 1, 2, 5]) + rng.random() for _ in range(rng.randint(0, 25))]
        assert [(a, b) for a, b, _ in toxicity.maximal(np.array(values))] == segments_by_definition(values)
    many = np.where(np.arange(300_000) % 2, -1.001, 1.0)
    assert len(toxicity.maximal(many)) == 150_000  # in linear time


def test_extreme_value_law_is_recovered():
    rng = np.random.default_rng(5)
    n = rng.integers(20, 2000, 4000)
    best = (np.log(0.2 * n) - np.log(-np.log(rng.random(4000)))) / 0.8
    rate, scale = toxicity.extreme_value(list(zip(n.tolist(), best.tolist())))
    assert abs(rate - 0.8) < 0.05 and abs(scale / 0.2 - 1) < 0.25


def test_odds_pass_from_stem_to_word():
    counts = {"vile$": (30, 0), "vil": (30, 0), "lowlan": (9, 1), "lowl": (9, 1), "low": (10, 30), "lowla": (9, 1), "the$": (50, 450)}
    found = toxicity.odds(counts, 100, 900, 2.0, 0.05)
    assert found["vile$"] > 4 and found["lowl"] > 2 > found["low"] and "the$" not in found
    scorer = toxicity.Scorer(toxicity.Model(found))
    assert scorer._word("Vile!!") == found["vile$"] and scorer._word("lowlanders") == found["lowlan"] and scorer._word("12") == 0.0 == scorer._word("unseen")


def invented(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices(["ka", "lo", "mi", "ne", "ru", "ta", "vo"], k=rng.randint(2, 4))) for _ in range(n)]


def test_toxicity(spark):
    rng, rows, labels = random.Random(6), [], []
    for k in range(900):
        words, bad = invented(rng, rng.randint(30, 200)), k % 6 == 0
        for _ in range(rng.randint(3, 6) if bad else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(["Scoundrel!", "vermin", "grubli" + rng.choice(["sch", "en", "ung", "heit", "ei", "ern"]) + ","]))
        rows.append((1000 + k, " ".join(words), "en"))
        labels.append((1000 + k, 1, int(bad)))
    rows += [(1, None, None), (2, "", "en"), (None, rows[0][1], "en"), rows[0], (3, "kalo " * 40_000, "en"), (4, "x" * 300_000, "en"), (5, "12 !!", "en")]
    labels += [(None, 1, 1), (9999, 0, 1), (1001, 1, None), (1002, 1, 1), (1002, 1, 0)]
    frame = cases.documents(spark, rows).repartition(3)
    model = toxicity.train(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'t' AS text", "5 AS place"))
    found = toxicity.scores(frame, model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    held = [r for r in found if r.doc_id is not None and r.doc_id >= 1000 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(r.held_out for r in held) and not any(r.held_out for r in found if r.doc_id is None)
    bad = [r for r in held if (r.doc_id - 1000) % 6 == 0]
    assert sum(r.predicted for r in bad) >= 0.95 * len(bad) and sum(r.predicted for r in held) <= len(bad) + 2
    assert not any(r.predicted for r in found if r.doc_id in (1, 2, 3, 4, 5))
    assert {r.score for r in found if r.doc_id in (1, 2)} == {toxicity.Scorer(model).score("")[0]}
    texts, spans = dict(r[:2] for r in rows), toxicity.passages(frame, model).collect()
    assert spans and all(texts[r.doc_id][r.start:r.stop] == r.passage and r.expected <= model.most_expected for r in spans if r.doc_id is not None)
    assert all(re.search("(?i)scoundrel|vermin|grubli", r.passage) for r in spans if r.doc_id in {b.doc_id for b in bad})
    assert sum(r.n_passages for r in found) == len(spans)


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    frame = cases.awkward(spark, ["one two three"])
    assert {r.score for r in toxicity.scores(frame, toxicity.train(frame, none)).collect()} == {0.5}
    only = spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.scores(frame, toxicity.train(frame, only)).collect()} == {0.5}
    assert toxicity.scores(cases.empty(spark), toxicity.train(cases.empty(spark), only)).count() == 0
    assert toxicity.passages(frame, toxicity.Model()).where(F.col("doc_id") > 0).count() == 0
