"""Tests of whole jobs: what a bound or an edge used to leave out."""
from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from leadloom.llm import copies, lines
from tests.llm import cases

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne", "ro") for b in ("ta", "su", "vi", "do") for c in ("n", "r", "s", "l", "m")]


# ------------------------------------------------------------------ near copies in the pipeline

def grams(text):
    words = text.lower().split()
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)} or {tuple(words)}


def alike(x, y):
    return len(grams(x) & grams(y)) >= 0.8 * len(grams(x) | grams(y))


def grouped(rows):
    """Smallest id that each id reaches over pairs at similarity 0.8 or more."""
    least, changed = {i: i for i in rows}, True
    links = [(i, j) for i in rows for j in rows if i != j and alike(rows[i], rows[j])]
    while changed:
        changed = False
        for i, j in links:
            if least[j] < least[i]:
                least[i], changed = least[j], True
    return least


def test_one_of_each_equals_brute_force_over_all_pairs(spark):
    rng = random.Random(21)
    rows = {}
    for k in range(25):
        words = rng.choices(WORDS, k=200)
        rows[100 - k] = " ".join(words)
        for copy in range(4):  # a chain of edits: its ends are far apart
            for at in rng.sample(range(200), 3 + k % 4):
                words[at] = rng.choice(WORDS) + "x"
            rows[200 + 10 * k + copy] = " ".join(words)
    base = rng.choices(WORDS, k=120)
    rows |= {600 + k: " ".join(base[:60] + rng.choices(WORDS, k=2 + k % 9) + base[60:]) for k in range(30)}
    rows |= {700: "", 701: " \n", 702: "Two words", 703: "two  WORDS", 704: "other pair"}
    want = grouped(rows)
    docs = cases.documents(spark, [(i, t, "en") for i, t in rows.items()] + [(None, rows[100], "en"), (705, None, "en"), (100, rows[100], "en")])
    for exact in (True, False):
        got = {r.doc_id: r.group_id for r in copies.groups(docs, exact=exact).collect() if r.doc_id is not None}
        assert got == want | {705: 700}
    kept = [r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect()]
    assert sorted(i for i in kept if i is not None) == sorted([i for i, root in want.items() if i == root] + ([100] if want[100] == 100 else [])) and kept.count(None) == 1
    linked = [(i, j) for i in rows for j in rows if i < j and rows[i] != rows[j] and alike(rows[i], rows[j])]
    assert len(linked) > 100 and copies.groups(cases.empty(spark)).count() == 0
    # With no rounds, only links to leaders; the exact path finds the rest.
    assert {r.doc_id: r.group_id for r in copies.groups(docs, exact=True, rounds=0).collect() if r.doc_id is not None} == want | {705: 700}


def test_one_of_each_asks_fingerprints_first(spark, monkeypatch):
    from leadloom.llm import simhash
    rng, asked = random.Random(24), []
    base = rng.choices(WORDS, k=400)
    rows = {1: " ".join(base), 2: " ".join(base + ["end"]), 3: " ".join(rng.choices(WORDS, k=400)), 4: " ".join(base[:399])}
    docs = cases.documents(spark, [(i, t, "en") for i, t in rows.items()])
    nodes = copies.nodes_of(docs).collect()
    assert {r.doc_id: r.bits for r in nodes} == {i: simhash.fingerprint(t) for i, t in rows.items()}
    table = spark.createDataFrame([(k, b) for k, b in enumerate((0, 1, 3, 7, 0, 63, 1 << 40, -1))], "node long, bits long")
    got = {(r.a, r.b) for r in copies.fingerprint_pairs(table).collect()}
    assert got == {(0, k) for k in range(1, 7)}
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda prints, radius=3: asked.append(radius) or links(prints, radius))
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect()) == [1, 3] and asked == [3]


# ------------------------------------------------------------------ lines

def made(rng, n, k=30):
    return [" ".join(rng.choices(WORDS, k=k)) for _ in range(n)]


def deduplicated(spark, rows):
    docs = cases.documents(spark, [(i, t, "en") for i, t in rows.items()])
    return {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_passages(docs).select("row.*", "n_removed").collect()}


def test_passages_go_to_their_first_and_last_line(spark):
    rng, rows, hosts = random.Random(22), {}, {}
    for n in (2, 3, 4, 6, 10):
        for k in range(8):
            passage = made(rng, n)
            for copy in range(3):
                before, after = made(rng, 3, 8), made(rng, 3, 8)
                i = 1000 * n + 10 * k + copy
                blank = [""] if k % 2 else []
                rows[i] = "\n".join(before + [x for line in passage for x in [line, *blank]] + after)
                hosts[i] = (rows[i], 0) if copy == 0 else ("\n".join(before + blank + after), n + (n - 1) * len(blank))
    got = deduplicated(spark, rows)
    assert got == hosts


def test_one_long_line_is_a_passage(spark):
    rng = random.Random(23)
    long, short = made(rng, 1, 51)[0], made(rng, 1, 50)[0]
    rows = {1: f"a b\n{long}\nc d", 2: f"e f\n{long}\ng h", 3: f"i j\n{short}\nk l", 4: f"m n\n{short}\no p", 7: long, 8: f"{long}\n\n"}
    got = deduplicated(spark, rows)
    assert got[1] == (rows[1], 0) and got[2] == ("e f\ng h", 1) and got[7] == ("", 1) and got[8] == ("", 3)
    assert [got[k] for k in (3, 4)] == [(rows[k], 0) for k in (3, 4)]  # 50 words are not over 50


def test_every_line_stays_somewhere(spark):
    rng = random.Random(24)
    pool = made(rng, 12, 20)
    rows = {k: "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 30))) for k in range(40)}
    got = deduplicated(spark, rows)
    assert {line for t, _ in got.values() for line in t.split("\n") if line} == {line for t in rows.values() for line in t.split("\n")}
    assert sum(n for _, n in got.values()) > 200 and lines.dedup_passages(cases.empty(spark)).count() == 0
    body = "\n".join(f"line {k} of it" for k in range(9))
    got = lines.dedup_passages(cases.awkward(spark, [body, body]).withColumn("hash", F.lit("h"))).select("row.*", "n_removed").collect()
    assert [r.text for r in got if r.doc_id == 10] == [body, body] and [(r.text, r.n_removed) for r in got if r.doc_id in (11, None)] == [("", 9), ("", 9)]


def test_runs_of_one_line_leave_one(spark):
    hot = "one line that comes again"
    rows = {5: "\n".join(["first"] + [hot] * 40 + ["last"]), 6: "\n".join(["other"] + [hot] * 25 + ["end"])}
    got = deduplicated(spark, rows)
    assert got[5] == (f"first\n{hot}\nlast", 39) and got[6] == ("other\nend", 25)
