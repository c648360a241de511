"""Operators that work text by text in tasks: tokens, languages, pages, quality, language model."""
from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from leadloom.llm import bpe, brown, extract, language, quality
from tests.llm import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENGLISH = "The cat and the dog sat in the house and it was good. That is what they said to the man with the hat."
FRENCH = "Le chat et le chien sont dans la maison et c'est bon. Voilà ce que les gens ont dit à l'homme avec le chapeau."


@pytest.fixture(scope="module")
def model():
    return bpe.load(PATH)


def test_bpe_equals_the_library_on_odd_texts(model):
    library, rng = Tokenizer.from_file(PATH), random.Random(5)
    parts = ["a", "ab", " ", "  ", "\n", "\x1c", "\x85", " ", "é", "日本", "😀", "'s", "'S", "<|endoftext|>", "12", "²", "‍", "!", "aaaa", "\t", "\xa0", "\x00", "ſ", "don't", "<|end"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(800)] + ["", "ab" * 20_000, " " * 3000]
    for text, packed in zip(texts, model.encode(texts)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert model.decode(packed) == library.decode(ids, skip_special_tokens=False) == text


def test_bpe_forgets_and_learns_again(model):
    small = bpe.PairIndexBpe(PATH, remembered=5)
    assert [small.encode([t])[0] for t in ("one two three", "four five six seven", "one two")] == [model.encode([t])[0] for t in ("one two three", "four five six seven", "one two")]


def test_bpe_table(spark, model):
    rows = bpe.digests(cases.awkward(spark, [ENGLISH, FRENCH]), PATH).collect()
    assert len(rows) == 9
    for r in rows:
        text = {10: ENGLISH, None: ENGLISH, 11: FRENCH, 1: "", 2: "", 3: " \t\n "}.get(r.doc_id)
        if text is not None:
            packed = model.encode([text])[0]
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.digests(cases.empty(spark), PATH).count() == 0
    assert all(r.decoded == (ENGLISH if r.doc_id in (10, None) else r.decoded) for r in bpe.encode(cases.awkward(spark, [ENGLISH]), PATH).collect())


def test_language(spark):
    rng, rows = random.Random(1), []
    for k in range(120):
        lang, words = (("en", ENGLISH), ("fr", FRENCH))[k % 2]
        rows.append((k, " ".join(rng.sample(words.split(), 14)).upper() if k % 5 == 0 else " ".join(rng.sample(words.split(), 14)), lang))
    rows += [(500, None, "en"), (501, "", None), (502, "12 34 !!", "fr"), (None, FRENCH, None), (503, ENGLISH, "xx" if zlib.crc32(b"503") % 3 == 1 else None), (0, rows[0][1], "en")]
    got = language.identify(cases.documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert [(by_id[i].lang_pred, by_id[i].score) for i in (500, 501, 502)] == [("und", 0.0)] * 3
    assert by_id[None].lang_pred == "fr" and not by_id[None].held_out
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    right = [by_id[i].lang_pred == lang for i, _, lang in rows[:120]]
    assert sum(right) / len(right) > 0.97 and all(0 <= r.score <= 1 for r in got)
    nothing = language.identify(cases.documents(spark, [(1, ENGLISH, None)])).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]
    assert language.identify(cases.empty(spark)).count() == 0


def test_out_of_place_distance_by_hand():
    packed = language.grams("Ab a!")
    plain = collections.Counter([(97,), (98,), (97,), (32, 97), (97, 98), (98, 32), (32, 97), (97, 32), (32, 97, 98), (97, 98, 32), (32, 97, 32)])

    def pack(gram):
        out = 0
        for c in gram:
            out = out << 21 | c
        return out
    assert collections.Counter(packed.tolist()) == collections.Counter({pack(g): n for g, n in plain.items()})
    import pandas as pd
    profiles = language.Profiles(pd.DataFrame({"lang": ["p", "p", "q"], "gram": [97, 98, pack((32, 97))], "place": [0, 1, 0]}), 5)
    own = language.top(packed, 4).tolist()
    far = {lang: sum(abs(k - at[g]) if g in at else 5 for k, g in enumerate(own)) for lang, at in (("p", {97: 0, 98: 1}), ("q", {pack((32, 97)): 0}))}
    best = min(sorted(far), key=far.get)
    assert profiles.nearest("Ab a!", 4) == (best, pytest.approx(1 - far[best] / (5 * len(own))))


def test_quality(spark):
    rng, rows, labels = random.Random(2), [], []
    words = ENGLISH.split() + FRENCH.split()
    for k in range(400):
        good = k % 4 != 0
        text = " ".join(rng.choices(words, k=40)) if good else rng.choice([" ".join(w.upper() + "!!" for w in rng.choices(words, k=30)), " ".join([rng.choice(words)] * 40), " | ".join(rng.choices(words, k=20))])
        rows.append((k, text, "en"))
        labels.append((k, int(good), 0))
    labels += [(3, None, 0), (None, 1, 0), (7, 1, 1), (9999, 0, 0)]
    rows += [(900, None, None), (901, "", "en"), (None, words[0], "en"), (5, rows[5][1], "en")]
    docs, marks = cases.documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality long, toxic long")
    weights = quality.train(docs, marks, bits=14, max_rows=300)
    got = quality.scores(docs, weights).collect()
    assert len(got) == len(rows)
    held = [(r.predicted, labels[r.doc_id][1]) for r in got if r.held_out and r.doc_id < 400]
    assert len(held) > 40 and sum(p == q for p, q in held) / len(held) > 0.97
    by_id = {r.doc_id: r for r in got}
    assert by_id[900].score == by_id[901].score and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    dense = np.zeros(1 << 14)
    slots, shares = quality.sparse(rows[1][1], 14)
    np.add.at(dense, slots, shares)
    assert by_id[1].score == pytest.approx(1 / (1 + math.exp(-float(dense @ weights))), abs=1e-5)
    kept = {r.doc_id for r in quality.accepted(docs, weights).collect()}
    assert kept == {r.doc_id for r in got if r.predicted}
    assert {r.score for r in quality.scores(docs, quality.train(docs, marks.where("false"), bits=14)).collect()} == {0.5}
    assert quality.scores(cases.empty(spark), weights).count() == 0


def test_pages(spark):
    page = ('<html><head><title>No</title></head><body><nav><a href="a>b">Menu one two three</a></nav><div class="ad-box">Buy this now please</div>'
            '<article><header><h1>Head &amp; line</h1></header><p>One <b>two</b>\n three&nbsp;four<br>five<p>Six <a href=x>seven</a> &lt;8&gt;</p><script>var t="</p>"</script>'
            '<form><p>Mail me</p></form><ul><li>nine<li>ten eleven</ul></article><section class="comments"><p>I say a lot of words here as a reader of it</p></section><footer>foot words</footer>')
    rest = ('<body><div id="top-menu">a b c d e f</div><div class="story"><p>Alpha beta gamma delta</p><p>Epsilon zeta</p></div><aside>side of it</aside><!-- open comment <p>lost</p>')
    rows = [(1, "u", page), (2, "v", rest), (3, None, None), (4, "w", ""), (None, "x", "a &lt; b"), (1, "u", page), (5, "y", "<p>" * 3000 + "deep"), (6, "z", "<script>x"), (7, "q", "<p>" + "w " * 100_000)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'k' AS kind", "'t' AS text", "1L AS n_chars")
    got = {(r.page_id, r.url): r for r in extract.extract(table).collect()}
    assert got[1, "u"].text == "Head & line\n\nOne two three four five\n\nSix seven <8>\n\nnine\n\nten eleven"
    assert got[2, "v"].text == "Alpha beta gamma delta\n\nEpsilon zeta"
    assert [got[k].text for k in ((3, None), (4, "w"), (None, "x"), (5, "y"), (6, "z"))] == ["", "", "a < b", "deep", ""]
    assert all(r.n_chars == len(r.text) for r in got.values()) and got[7, "q"].n_chars == 199_999
    assert extract.extract(table).count() == len(rows) and extract.extract(table.where("false")).count() == 0


def counted(kinds):
    counts = np.zeros((2, 1 << extract.BITS), np.float32)
    for kind, both in kinds.items():
        counts[:, extract.slot(kind)] = both
    return counts


def test_unseen_kinds_weigh_as_their_classes_or_name():
    scorer = extract.Scorer(counted({"div": (10, 2), "div.menu": (0, 50), "div.body": (20, 0), "div.body.wide": (0, 5)}))
    low = scorer.weight("div.menu", "div")
    assert low < -150 and scorer.weight("div.body", "div") == scorer.weight("div.body.x9", "div") == scorer.weight("div.x", "div") == -0.1
    assert scorer.weight("div.menu.x1", "div") == low and scorer.weight("div.body.wide", "div") < -150 and scorer.weight("section.new", "section") == -0.1


def test_a_page_does_not_depend_on_the_kinds_of_others(spark):
    page = '<body><div class="x1">menu one two three four</div><article><p>Alpha beta gamma delta epsilon zeta eta</p></article></body>'
    plain = '<body><div class="x1">menu one two three four</div><div class="t"><p>Alpha beta gamma delta epsilon zeta eta</p></div></body>'
    few = [(k, "u", page) for k in range(6)] + [(100, "u", plain)]
    many = few + [(1000 + k, "u", f'<body><div class="c{k} d{k}">a</div><div class="c{k} d{k}">a</div><article><p class="e{k}">b</p></article></body>') for k in range(3000)]
    texts = []
    for rows in (few, many):
        frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
        texts.append({r.page_id: r.text for r in extract.extract(frame).where("page_id < 1000").collect()})
    assert texts[0] == texts[1] and texts[0][100] == "Alpha beta gamma delta epsilon zeta eta" == texts[0][0]


def test_empty_elements_of_other_languages_hide_nothing():
    scorer = extract.Scorer(counted({}))
    assert scorer.text('<p>one two three <svg/> four</p><p>five <math class="m"/> six</p><p>seven <svg viewBox="0"><path d=""/>hidden</svg> eight</p>') == "one two three four\n\nfive six\n\nseven eight"
    # A list item that marks the article and is not closed ends with the next one.
    inside = [(value, mark) for what, value, _, _, mark in extract.read('<ul><li role="main">a<li>b</ul>c') if what == "text"]
    assert inside == [("a", True), ("b", False), ("c", False)]


def test_best_region_equals_all_regions():
    rng, scorer = random.Random(4), extract.Scorer(counted({"div": (1, 9), "p": (9, 0)}), steep=10.0)
    for _ in range(200):
        page = "".join(rng.choice(["<p>", "</p>", "<div>", "</div>", "one two ", "three "]) for _ in range(30))
        pieces, before = [], 0.0
        for what, value, name, silent, _ in extract.read(page):
            if what == "text":
                pieces.append((before, value))
                before = 0.0
            else:
                before += scorer.weight(value, name)
        sums = [sum(len(v.split()) for _, v in pieces[a:b]) + sum(c for c, _ in pieces[a + 1:b]) for a in range(len(pieces)) for b in range(a + 1, len(pieces) + 1)]
        best = max(sums, default=0)
        regions = [" ".join("".join(v for _, v in pieces[a:b]).split()) for a in range(len(pieces)) for b in range(a + 1, len(pieces) + 1)
                   if abs(sum(len(v.split()) for _, v in pieces[a:b]) + sum(c for c, _ in pieces[a + 1:b]) - best) < 1e-9]
        assert not pieces or " ".join(scorer.text(page).split()) in regions


def test_brown(spark):
    rng, rows = random.Random(3), []
    one, two = [f"red{k}" for k in range(40)], [f"blue{k}" for k in range(40)]
    for k in range(300):
        rows.append((k, " ".join(rng.choices(one if k % 2 else two, k=30)), "en"))
    rows += [(1000, None, None), (1001, "", "en"), (None, "red1 RED2 unseen", "en"), (1002, " \n ", "en"), (0, rows[0][1], "en"), (1003, "never seen words", "en")]
    got = brown.score(cases.documents(spark, rows), vocabulary=60, endings=16, classes=6, sweeps=5, frequent=200).collect()
    assert len(got) == len(rows)
    counts, ends = collections.Counter(), 0
    for i, t, _ in rows:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            counts.update((t or "").encode().lower().split())
            ends += 1
    total, distinct = sum(counts.values()) + ends, len(counts) + 1
    for r in got:
        words = next((t or "").encode().lower().split() for i, t, _ in rows if i == r.doc_id)
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words) + math.log10((ends + 0.1) / (total + 0.1 * (distinct + 1)))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words) + 1, sum(counts[w] > 0 for w in words) + 1, total)
        assert r.base_score == pytest.approx(base)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 5 * len(held)  # about one bit a word
    assert brown.score(cases.empty(spark), vocabulary=5, endings=2, classes=3, frequent=3).count() == 0


def test_brown_probabilities_sum_to_one(spark):
    docs = cases.documents(spark, [(k, t, "en") for k, t in enumerate(["a b a c", "b b d", "a d e", "c"] * 3)])
    rows = brown.common.texts(docs)
    model, counts, ends = brown.fit(rows, vocabulary=3, endings=2, classes=4, sweeps=3, frequent=3)
    of_word = {bytes(r.word): r.n for r in counts.collect()}
    for before in range(len(model.move_log)):
        moves = 10 ** model.move_log[before]
        assert moves.sum() == pytest.approx(1)
        for to in range(1, len(moves)):
            own = [n for w, n in of_word.items() if model.of[model.units.unit(w)] == to]
            assert (sum(n + 0.1 for n in own) + 0.1) / 10 ** model.class_log[to] == pytest.approx(1)


def test_most_frequent_words_stay_within_the_bound(spark):
    counts = spark.createDataFrame([(bytearray(f"w{k:03d}".encode()), n) for k, n in enumerate([1000, 900, 500, 40, 40] + [3] * 50 + [1] * 100)], "word binary, n long")
    found = brown.most_frequent(counts, 20)
    assert found == [(b"w000", 1000), (b"w001", 900), (b"w002", 500), (b"w003", 40), (b"w004", 40)]
    assert brown.most_frequent(counts, 0) == [] and len(brown.most_frequent(counts, 1000)) == 155 and brown.most_frequent(counts.where("false"), 5) == []


def test_exchange_raises_the_likelihood():
    rng, size, classes = np.random.default_rng(7), 30, 5
    table = np.zeros((size, size), np.int64)
    for _ in range(4000):
        kind = rng.integers(2)
        a, b = 1 + 2 * rng.integers(14, size=2) + kind
        table[a, b] += 1

    def sums(of):
        right, left = np.zeros((size, classes + 1), np.int64), np.zeros((size, classes + 1), np.int64)
        for a in range(size):
            for b in range(size):
                right[a, classes if a == b else of[b]] += table[a, b]
                left[b, classes if a == b else of[a]] += table[a, b]
        return right, left

    def likelihood(of):
        pairs = brown.transitions(sums(of)[0], of, classes)
        return float(brown._xlogx(pairs).sum() - brown._xlogx(pairs.sum(axis=1)).sum() - brown._xlogx(pairs.sum(axis=0)).sum())

    of = 1 + np.arange(size) // 7 % (classes - 1)
    of[0] = 0
    start = likelihood(of)
    for _ in range(4):
        brown.exchange(*sums(of), of, classes)
    assert likelihood(of) > start and of[0] == 0 and (of[1:] > 0).all()
