"""Near-duplicate documents by SimHash fingerprints and multi-index hashing.

Words are lower-cased (A-Z only), three-word shingles with repeats are hashed with XXH64 (seed 42), and a fingerprint bit is set
where more than half of the hashes have it. Two fingerprints link at ``radius`` or fewer differing bits. They are found by
segments: with two 32-bit halves and a radius of 3, one half differs in at most one bit, so each fingerprint asks for the
33 values of a half's ball of radius 1 in a table of halves, and full distances are checked. Equal fingerprints are one
node of the graph, so a group of copies costs one node. Components come from alternating large-star and small-star steps.

Null texts count as empty; empty texts have fingerprint zero and link like any other. A component's id is its smallest id;
null ids never become one (null if a component has no other). Repeated rows are kept and agree. An empty table stays empty.
"""
from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm import common

SEED = 42
PRINTS = pa.schema([("doc_id", pa.int64()), ("bits", pa.int64())])


def fingerprint(text: str, size: int = 3) -> int:
    """The 64 bits as a signed integer."""
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(s) for s in zip(*(words[k:] for k in range(size)))] if len(words) >= size else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    set_in = np.zeros(64, dtype=np.int64)
    for at in range(0, len(shingles), 1 << 16):  # a very long text takes bounded memory
        hashes = np.array([digest(s, SEED) for s in shingles[at:at + (1 << 16)]], dtype=">u8")
        set_in += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_in * 2 > len(shingles)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``bits`` of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return common.batches_of(((i, fingerprint(t)) for i, t in common.rows_of(batches)), PRINTS)
    return common.texts(docs).mapInArrow(run, "doc_id long, bits long")


def half(bits: Column, segment: int) -> Column:
    return F.shiftright(bits, 32 * segment).bitwiseAND(0xFFFFFFFF)


def ball(width: int, radius: int) -> list[int]:
    """Masks with at most ``radius`` of ``width`` bits."""
    return [sum(1 << b for b in chosen) for n in range(radius + 1) for chosen in itertools.combinations(range(width), n)]


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs ``a`` < ``b`` of distinct fingerprints at 1 to ``radius`` differing bits, once each (``prints``: distinct ``bits``)."""
    masks = F.array(*[F.lit(m).cast("long") for m in ball(32, radius // 2)])
    entries = prints.select("bits", F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), half(F.col("bits"), s).alias("value"))
                                                        for s in (0, 1)])).alias("at")).select(F.col("bits").alias("b"), "at.segment", "at.value")
    probes = (entries.select(F.col("b").alias("a"), "segment", "value", F.explode(masks).alias("mask"))
              .select("a", "segment", F.col("value").bitwiseXOR(F.col("mask")).alias("value")))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return probes.join(entries, ["segment", "value"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def _both_ways(pairs: DataFrame) -> DataFrame:
    """The pairs ``u``, ``v`` in either direction, with ``first`` 1 as they are and 0 the other way; one scan, not a union of two."""
    as_is, turned = F.struct("u", "v", F.lit(1).alias("first")), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0).alias("first"))
    return pairs.select(F.inline(F.array(as_is, turned)))


def _settled(pairs: DataFrame) -> bool:
    """Whether all pairs, larger node first, are stars: each first node has one pair and is no second node. A round would change nothing."""
    return _both_ways(pairs).groupBy("u").agg(F.sum("first").alias("n"), F.min("first").alias("only")).where("n > 1 OR (n = 1 AND only = 0)").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the smallest node it reaches) for every node of the edges ``a`` - ``b``.

    Large-star joins each node's larger neighbours to its smallest one, small-star its smaller neighbours; both keep
    components and need no task to hold one. A round's edges are cut off in shared storage. Edges that are stars already take no round.
    """
    pairs = common.narrow_stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    for _ in range(max_rounds):
        if _settled(pairs):
            break
        both = _both_ways(pairs).select("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # Each other neighbour and the node itself, with the smallest.
        ends = F.array_distinct(F.array(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")), F.col("u")))
        small = large.join(least, "u").select(F.explode(ends).alias("u"), F.col("m").alias("v")).distinct()
        # A round makes no more pairs than it reads, so as many tasks write them: on local disks each stored part starts a process.
        pairs = common.narrow_stage(small.coalesce(pairs.rdd.getNumPartitions()))
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.explode(F.array("u", "v")).alias("node"), F.col("v").alias("root")).distinct()


def near_duplicates(docs: DataFrame, radius: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row of ``docs``."""
    prints = common.stage(fingerprints(docs))
    nodes = prints.groupBy("bits").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("bits"), radius))
    nodes = nodes.join(roots, nodes["bits"] == roots["node"], "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
    ids = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(ids, "root").select("bits", "component_id")
    return prints.join(named, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def distinct_documents(docs: DataFrame, radius: int = 3) -> DataFrame:
    """The rows of ``docs``, with their columns, that stand for their component: those with its smallest id, and rows without an id."""
    others = near_duplicates(docs, radius).where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("other")).distinct()
    return docs.join(others, docs["doc_id"].cast("long") == others["other"], "left_anti")
