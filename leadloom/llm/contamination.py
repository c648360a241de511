"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle check.

Words are lower-cased runs of letters and digits. A window has as many words as a benchmark item. Windows are laid at every place where
a five-word shingle of the document occurs in an item, shifted by the shingle's place in that item; a window without any
such shingle has similarity zero with every item, so none is lost. Each distinct window gets a fingerprint of 64 bits, the
weighted majority over its shingles' hashes. Fingerprints are cut into five blocks: two that differ in at most ``radius`` = 19 bits
agree up to 3 bits in one block, so the ball of radius 3 around each block of an item meets every such window in an equi-join
with the window's length and block. Full distances are checked, and candidates are verified by the weighted
Jaccard similarity of the shingle multisets (weight: occurrences), 0.8 or more. A pair at similarity 0.8 differs in 9 to 10 bits on average.

The low bits of the items' shingle hashes, at most ``2**bits`` of them however large the benchmark, are broadcast and tell in the
scanning tasks which document shingles can be in the benchmark at all; what passes is joined by the whole hash. Equal windows are one row for fingerprints and checks, so a passage in a third of
all documents is checked once. Only DataFrame expressions are used.

Null and empty texts and items match nothing. Items of fewer than five words are one shingle. Rows that share an id are each
searched and reported together; rows without an id are reported with a null id. Repeated rows agree and are reported once. Further columns are
ignored; an empty table on either side gives no row. Ties take the smallest place.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm import common
from leadloom.llm.simhash import ball

SIZE = 5
_BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    inner = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"^[^\p{L}\p{N}]+", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.filter(F.split(inner, r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def shingles(words: str, size: int = SIZE) -> Column:
    """Space-joined shingles of a column of words in order; fewer words are one shingle, none give none."""
    several = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.array_join(F.slice(words, i + 1, size), " "))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).when(F.size(words) < size, F.array(F.array_join(words, " "))).otherwise(several)


def _hashed(words: str, size: int) -> Column:
    """Hash of the ``size`` words from each place on."""
    return F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(F.col(words), i + k) for k in range(1, size)]))


def items_of(benchmark: DataFrame) -> DataFrame:
    """``item_id``, ``words`` and ``n_words`` of the items that have words."""
    return (benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text")).alias("words"))
            .withColumn("n_words", F.size("words")).where("n_words > 0").distinct())


def windows(docs: DataFrame, items: DataFrame, bits: int = 21, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """``id``, ``at``, ``n_words`` and ``body`` of the item-sized windows of all rows that share a shingle with an item."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), common.text_key(text).alias("key"), text.alias("text"))
    low, laid = (1 << bits) - 1, None
    for size in sorted({min(SIZE, r.n) for r in items.select(F.least("n_words", F.lit(SIZE)).alias("n")).distinct().collect()}):  # five values at most
        some = items.where(F.col("n_words") >= SIZE if size == SIZE else F.col("n_words") == size)
        anchors = some.select("n_words", F.posexplode(F.slice(_hashed("words", size), F.lit(1), F.col("n_words") - (size - 1))).alias("off", "h")).distinct()
        slots = anchors.select(F.col("h").bitwiseAND(low).alias("slot")).distinct()  # at most 2**bits longs
        split = rows.select("id", "key", words_of(F.col("text")).alias("words"))
        hashes = F.slice(_hashed("words", size), F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(0)))
        hits = split.select("id", "key", F.size("words").alias("size"), F.posexplode(hashes).alias("at", "h"))
        hits = hits.join(F.broadcast(slots), F.col("h").bitwiseAND(low) == F.col("slot"), "left_semi")
        begin = F.greatest(F.least(F.col("at") - F.col("off"), F.col("size") - F.col("n_words")), F.lit(0))
        own = hits.join(anchors, "h").select("id", "key", begin.alias("begin"), "n_words").distinct()
        laid = own if laid is None else laid.union(own)
    if laid is None:
        return None
    laid = laid.groupBy(F.col("id").alias("of"), F.col("key").alias("of_key")).agg(F.collect_set(F.struct("begin", "n_words")).alias("laid"))
    joined = rows.join(laid, F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key"))).select("id", words_of(F.col("text")).alias("words"), "laid")
    return joined.select("id", "words", F.explode("laid").alias("w")).select(
        "id", F.col("w.begin").alias("at"), F.col("w.n_words").alias("n_words"), F.array_join(F.slice("words", F.col("w.begin") + 1, F.col("w.n_words")), " ").alias("body"))


def fingerprints(bodies: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``bits`` of rows with ``words``: bit by bit the weighted majority over the shingles' hashes."""
    each = bodies.select(*keys, F.explode(shingles("words")).alias("s")).select(*keys, F.xxhash64("s").alias("h"))
    votes = [F.sum(F.getbit("h", F.lit(b)).cast("int") * 2 - 1).alias(f"v{b}") for b in range(64)]
    counted = each.groupBy(*keys).agg(*votes)
    bits = F.lit(0).cast("long")
    for b in range(64):
        bits = bits.bitwiseOR(F.when(F.col(f"v{b}") > 0, F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
    return counted.select(*keys, bits.alias("bits"))


def _block(bits: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(bits, first).bitwiseAND((1 << width) - 1)


def candidates(bodies: DataFrame, items: DataFrame, radius: int = 19) -> DataFrame:
    """``body``, ``n_words`` and ``item_id`` whose fingerprints differ in at most ``radius`` bits (``bodies``: distinct windows)."""
    near = radius // len(_BLOCKS)
    of_windows = fingerprints(bodies.withColumn("words", F.split("body", " ")), ["body", "n_words"])
    of_items = fingerprints(items, ["item_id", "n_words"]).withColumnRenamed("bits", "item_bits")
    table = of_windows.select("body", "n_words", "bits", F.explode(F.array(*[F.struct(F.lit(k).alias("block"), _block(F.col("bits"), *at).alias("value")) for k, at in enumerate(_BLOCKS)])).alias("b"))
    probes = None
    for k, at in enumerate(_BLOCKS):
        masks = F.array(*[F.lit(m).cast("long") for m in ball(at[1], near)])
        own = of_items.select("item_id", "n_words", "item_bits", F.lit(k).alias("block"), F.explode(masks).alias("mask")).select(
            "item_id", "n_words", "item_bits", "block", _block(F.col("item_bits"), *at).bitwiseXOR(F.col("mask")).alias("value"))
        probes = own if probes is None else probes.union(own)
    met = table.select("body", "n_words", "bits", "b.block", "b.value").join(probes, ["n_words", "block", "value"])
    return met.where(F.bit_count(F.col("bits").bitwiseXOR(F.col("item_bits"))) <= radius).select("body", "n_words", "item_id").distinct()


def compared(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """``body``, ``n_words``, ``item_id`` and ``similarity``, the weighted Jaccard similarity of the shingle multisets, of all pairs.

    A pair is one row of two passages of an item's size, so nothing is joined by shingle.
    """
    rows = pairs.join(items.select("item_id", F.col("words").alias("item_words")), "item_id").withColumn("words", F.split("body", " "))
    rows = rows.select("body", "n_words", "item_id", shingles("words").alias("own"), shingles("item_words").alias("theirs"))
    times = lambda side, s: F.size(F.filter(side, lambda x: x == s))
    both = F.aggregate(F.array_intersect("own", "theirs"), F.lit(0), lambda total, s: total + F.least(times("own", s), times("theirs", s)))
    return rows.select("body", "n_words", "item_id", (both / (F.size("own") + F.size("theirs") - both)).alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, radius: int = 19, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``item_id``, ``similarity``, ``first_word`` and ``n_words`` of the best window of each document and item it holds."""
    items = common.stage(items_of(benchmark))
    found = windows(docs, items, id_col=id_col, text_col=text_col)
    if found is None:
        empty = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("false")
        return empty.select("doc_id", F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("n_words"))
    found = common.stage(found)
    near = compared(candidates(found.select("body", "n_words").distinct(), items, radius), items)
    # The best window leaves each task: highest similarity, then the smallest place. Only then is the similarity asked for.
    best = found.join(near, ["body", "n_words"]).groupBy("id", "item_id").agg(F.max(F.struct("similarity", (-F.col("at")).alias("back"), "n_words")).alias("b"))
    return best.where(F.col("b.similarity") >= least).select(F.col("id").alias("doc_id"), "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.back")).cast("long").alias("first_word"), F.col("b.n_words").cast("long").alias("n_words"))
