"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule looks at one statistic of a text and votes 1 (good), -1 (poor) or 0 (abstains). Texts are counted by their pattern of
votes (at most 3 to the number of rules, whatever the size of the corpus); expectation-maximisation over these counts estimates the
share of good texts and how often each rule votes each way, or abstains, in both classes, from Dirichlet priors that say what a rule is for.
The posterior of a text is the sum of its votes' log-odds, abstentions included, and it passes when that reaches ``threshold``. So no
rule has a veto: a fault that also good texts often have is outvoted, and two faults that are weak alone add up.

All statistics are DataFrame expressions over the row, so nothing is shuffled but the vote patterns. Words are runs of anything
but the six ASCII white-space characters. Null texts count as empty: no words, base rule failed, not kept. Repeated rows agree,
rows without an id are scored like others, further columns are ignored, an empty table stays empty.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm import common

#: Frequent function words of the languages in use.
FUNCTION_WORDS = ("the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "with", "le", "la", "les", "de", "des", "et", "un", "une", "du",
                  "que", "est", "dans", "der", "die", "das", "und", "den", "von", "zu", "ist", "mit", "el", "los", "las", "en", "y", "del", "se", "por", "con", "una")


_BLANK = " \t\n\x0b\x0c\r"


def _words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(_BLANK))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, common.WORD_GAP))


def _count(text: Column, chars: str) -> Column:
    """Characters of the text that are among ``chars``."""
    rest = text
    for char in chars:
        rest = F.replace(rest, F.lit(char), F.lit(""))
    return (F.length(text) - F.length(rest)).cast("long")


def _windows() -> Column:
    """Three-word windows of ``words`` with their places."""
    spots = F.sequence(F.lit(0), F.col("n_words").cast("int") - 3)
    return F.transform(spots, lambda i: F.struct(F.concat_ws(" ", *[F.get(F.col("words"), i + k) for k in range(3)]).alias("w"), i.alias("i")))


def _repeated_starts() -> Column:
    """Places of the windows in ``ordered`` that equal a neighbour, in ascending order."""
    def repeated(x: Column, k: Column) -> Column:
        same = [F.get(F.col("ordered"), k + step)["w"] == x["w"] for step in (1, -1)]
        return F.coalesce(same[0], F.lit(False)) | F.coalesce(same[1], F.lit(False))
    return F.sort_array(F.transform(F.filter("ordered", repeated), lambda x: x["i"]))


def _covered() -> Column:
    """Words in the windows at ``starts``: three each, less those that the next window covers as well."""
    own = F.transform(F.col("starts"), lambda s, k: F.least(F.lit(3), F.coalesce(F.get(F.col("starts"), k + 1) - s, F.lit(3))))
    return F.aggregate(own, F.lit(0), lambda a, x: a + x)


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id``, the contract's counts, and the figures that the rules look at, of every row."""
    words = F.col("words")
    rows = common.texts(docs).select("doc_id", "text", _words(F.col("text")).alias("words"))
    rows = rows.select("*", F.size("words").cast("long").alias("n_words"), F.split("text", "\n").alias("lines"))
    # Hashes show cheaply that a text has no repeated window; only the others are sorted.
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    windows = F.greatest(F.col("n_words") - 2, F.lit(0)).cast("int")
    rows = rows.select("*", (F.size(F.array_distinct(F.slice(hashes, F.lit(1), windows))) < windows).alias("repeats"))
    rows = rows.select("*", F.when(F.col("repeats"), F.sort_array(_windows())).alias("ordered"))
    rows = rows.select("*", F.when(F.col("repeats"), _repeated_starts()).alias("starts"))
    rows = rows.select("*", F.filter("lines", lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))).alias("full"))
    return rows.select(
        "doc_id", "n_words", F.length(F.array_join(words, "")).cast("long").alias("word_chars"), _count(F.col("text"), "#*$%&|<>").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("repeats"), _covered()).otherwise(0).cast("long").alias("n_repeat_words"), F.size("full").cast("long").alias("n_lines"),
        (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))).cast("long").alias("n_capitals"),
        _count(F.col("text"), "!").alias("n_shouts"),
        F.size(F.array_intersect(words, F.array(*map(F.lit, FUNCTION_WORDS)))).cast("long").alias("n_function_words"))


def fault(share: Column, limit: float) -> Column:
    """-1 from ``limit`` on. The lack of one fault is no sign of quality, so the rule abstains below."""
    return F.when(share >= limit, -1).otherwise(0)


def rules() -> dict[str, Column]:
    """The votes by rule; a text without words makes each abstain but the one on length."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    some = F.col("n_words") > 0
    votes = {
        "symbols": fault(F.col("n_symbols") / words, 0.10),
        "many_symbols": fault(F.col("n_symbols") / words, 0.50),
        "capitals": fault(F.col("n_capitals") / chars, 0.30),
        "shouts": fault(F.col("n_shouts") / words, 0.10),
        "repeats": fault(F.col("n_repeat_words") / words, 0.40),
        "dup_lines": fault(F.col("n_dup_lines") / lines, 0.50),
        "word_length": F.when((F.col("word_chars") / words).between(3.0, 9.0), 1).when((F.col("word_chars") / words < 2.0) | (F.col("word_chars") / words > 12.0), -1).otherwise(0),
        "function_words": F.when(F.col("n_function_words") >= 3, 1).otherwise(0),  # other languages abstain
    }
    return {name: F.when(some, v).otherwise(0) for name, v in votes.items()} | {"length": F.when(F.col("n_words") >= 50, 1).when(F.col("n_words") < 15, -1).otherwise(0)}


#: What is believed of a rule before any text is seen: the chances of the votes -1, 0 and 1 in good and in poor texts. Faults are rare in good
#: texts and each shows in a part of the poor ones only.
FAULT = ((0.002, 0.998, 0.0), (0.20, 0.80, 0.0))
PRIORS = {"word_length": ((0.02, 0.08, 0.90), (0.15, 0.25, 0.60)), "function_words": ((0.0, 0.4, 0.6), (0.0, 0.6, 0.4)), "length": ((0.1, 0.2, 0.7), (0.2, 0.2, 0.6))}
GOOD = 0.9


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], names: list[str], strength: float = 0.05, least: float = 20.0, rounds: int = 500) -> tuple[float, dict[str, dict[int, float]]]:
    """Log-odds of a good text, and what each vote of each rule (0: abstention) adds to them, from counts of vote patterns.

    Votes are taken to be independent in each class. The priors weigh as much as a share ``strength`` of the texts, alike at every size, and
    ``least`` texts at the least; a vote that a rule never gives has no say.
    """
    total = sum(n for _, n in patterns)
    held = max(least, strength * total)
    believed = [PRIORS.get(name, FAULT) for name in names]
    chances, good = [list(map(list, b)) for b in believed], GOOD

    def odds(k: int, vote: int) -> float:
        of_good, of_poor = chances[k][0][vote + 1], chances[k][1][vote + 1]
        return math.log(max(of_good, 1e-9) / max(of_poor, 1e-9)) if of_good or of_poor else 0.0

    for _ in range(rounds):
        share = [1 / (1 + math.exp(-max(-500.0, min(500.0, math.log(good / (1 - good)) + sum(odds(k, v) for k, v in enumerate(p)))))) for p, _ in patterns]
        then = (sum(s * n for s, (_, n) in zip(share, patterns)) + held * GOOD) / (total + held)
        for k in range(len(names)):
            for c in (0, 1):
                seen = [held * x for x in believed[k][c]]
                for s, (p, n) in zip(share, patterns):
                    seen[p[k] + 1] += n * (1 - s if c else s)
                chances[k][c] = [x / sum(seen) for x in seen]
        moved, good = abs(then - good), then
        if moved < 1e-10:
            break
    return math.log(good / (1 - good)), {name: {v: odds(k, v) for v in (-1, 0, 1)} for k, name in enumerate(names)}


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id``, the statistics, ``base_failed``, ``posterior`` and ``kept`` of every row.

    The statistics and votes, without the texts, are stored once: both the vote counts and the result read them.
    """
    votes = rules()
    voted = common.stage(statistics(docs).select("*", *[v.alias(f"vote_{name}") for name, v in votes.items()]))
    names = [f"vote_{name}" for name in votes]
    counted = voted.groupBy(*names).count().collect()  # at most 3 to the number of rules
    patterns = sorted((tuple(r[n] for n in names), r["count"]) for r in counted)
    start, odds = expectation_maximisation(patterns, list(votes))
    odds = {f"vote_{name}": of for name, of in odds.items()}
    total = sum((F.when(F.col(n) == 1, odds[n][1]).when(F.col(n) == -1, odds[n][-1]).otherwise(odds[n][0]) for n in names), F.lit(start))
    posterior = 1 / (1 + F.exp(-total))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                        (~failed & (posterior >= threshold)).alias("kept"), posterior.alias("posterior"), *names)
