"""Secret scan with corpus-wide ownership frequency.

Base candidates of a text are key assignments, access keys and long hexadecimal runs. The method adds long mixed tokens
(``token``: 20 or more characters with a lower-case and an upper-case letter and a digit) outside base spans. All candidate values are hashed, and
the hashes are counted over the whole corpus by distinct repositories and distinct owners: a value seen at more than
``max_owners`` owners or ``max_repositories`` repositories is a widely copied example, the others look like live credentials of
their owner. Copied tokens are not reported; base spans always stay, with the number of live ones beside them.

Spans are code points with exclusive ends. A match's place is the sum of the gaps and matches before it, so no code outside
DataFrame expressions is needed. Null texts count as empty (no spans, the hash of the empty string). A null owner or repository
counts as one unnamed one. Repeated rows agree and count once for ownership; further columns are ignored; an empty table stays empty.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm import common

#: The patterns of the base kinds, in the order in which they are listed. Runs below the least length never match.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "token")
#: Matches whose places are summed up in one step.
BLOCK = 128
_SPAN = "array<struct<start: int, rank: int, kind: string, stop: int, value: string>>"


def spans(text: Column, kind: str, pattern: str, least: int, value_group: int = 0) -> Column:
    """Matches of the pattern, leftmost and not overlapping, whose value has ``least`` characters, as structs in text order."""
    found, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    parts = F.zip_with(gaps, F.transform(F.arrays_zip(found.alias("m"), values.alias("v")), lambda x: x), lambda gap, x: F.struct(gap.alias("gap"), x["m"].alias("m"), x["v"].alias("v")))
    matched = F.filter(parts, lambda x: x["m"].isNotNull())
    # Running sums in blocks: an array that grows by one is copied each time, so it stays short.
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(matched), F.lit(1)), F.lit(BLOCK)), lambda s: F.slice(matched, s, F.lit(BLOCK)))
    sizes = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x["gap"] + F.length(x["m"])))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    before = F.aggregate(sizes, none, lambda held, n: F.struct((held["at"] + n).alias("at"), F.concat(held["out"], F.array(held["at"])).alias("out")))["out"]

    def step(held: Column, x: Column) -> Column:
        begin, stop = held["at"] + x["gap"], held["at"] + x["gap"] + F.length(x["m"])
        one = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), stop.alias("stop"), x["v"].alias("value"))
        return F.struct(stop.alias("at"), F.when(F.length(x["v"]) >= least, F.concat(held["out"], F.array(one))).otherwise(held["out"]).cast(_SPAN).alias("out"))

    empty = F.array().cast(_SPAN)
    return F.flatten(F.zip_with(blocks, before, lambda block, at: F.aggregate(block, F.struct(at.alias("at"), empty.alias("out")), step)["out"]))


def candidates(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """``doc_id``, ``key``, ``owner``, ``repository``, ``base`` and ``added`` spans of every row; cheap byte searches come before the patterns."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
                       F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repository]).alias("repository"))
    small = F.lower(text)
    words = ("password", "passwd", "secret", "token", "apikey", "api_key")
    any_word = F.contains(small, F.lit(words[0]))
    for word in words[1:]:
        any_word = any_word | F.contains(small, F.lit(word))
    empty = F.array().cast(_SPAN)
    rows = rows.select("doc_id", common.text_key(text).alias("key"), "owner", "repository",
                       F.when(any_word, spans(text, "assign", ASSIGN, 12, 2)).otherwise(empty).alias("assign"),
                       F.when(F.contains(text, F.lit("AKIA")), spans(text, "access", ACCESS, 18)).otherwise(empty).alias("access"),
                       F.when(F.rlike(text, F.lit(r"[0-9a-f]{16}")), spans(text, "hex", HEX, 16)).otherwise(empty).alias("hex"),
                       F.when(F.rlike(text, F.lit(TOKEN)), spans(text, "token", TOKEN, 20)).otherwise(empty).alias("token"))
    base = F.array_sort(F.concat("assign", "access", "hex"))
    rows = rows.select("doc_id", "key", "owner", "repository", base.alias("base"), "assign", "token")
    mixed = F.filter("token", lambda s: F.rlike(s["value"], F.lit("[a-z]")) & F.rlike(s["value"], F.lit("[A-Z]")) & F.rlike(s["value"], F.lit("[0-9]")))
    # Access keys and hexadecimal runs have characters of tokens only, so one that meets a token stands inside it.
    alone = F.filter(mixed, lambda s: ~F.rlike(s["value"], F.lit(f"{ACCESS}|{HEX}")))
    apart = F.filter(alone, lambda s: ~F.exists("assign", lambda b: (s["start"] < b["stop"]) & (b["start"] < s["stop"])))
    return rows.select("doc_id", "key", "owner", "repository", "base", apart.alias("added"))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def number(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def scan(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), max_owners: int = 1, max_repositories: int = 3) -> DataFrame:
    """Per row: counts by kind, ``base_sha256``, ``spans``, ``n_live`` and ``n_copied`` (candidates by ownership)."""
    rows = common.stage(candidates(docs, owner, repository))  # spans only, no texts
    each = (rows.select("doc_id", "key", "owner", "repository", F.explode(F.concat("base", "added")).alias("span"))
            .select("doc_id", "key", "owner", "repository", "span", F.sha2(F.col("span.value"), 256).alias("hash")))
    # One row per hash, owner and repository leaves a task, whatever the number of copies.
    holders = each.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    ownership = holders.groupBy("hash").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repository").alias("repositories"))
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    judged = each.select("doc_id", "key", "span", "hash").distinct().join(ownership.select("hash", live.alias("live")), "hash")
    is_token = F.col("span.kind") == "token"
    per_doc = judged.groupBy("doc_id", "key").agg(
        F.collect_list(F.when(is_token & F.col("live"), F.col("span"))).alias("kept"),
        F.count(F.when(F.col("live"), 1)).alias("n_live"), F.count(F.when(~F.col("live"), 1)).alias("n_copied"))
    per_doc = per_doc.select(F.col("doc_id").alias("of"), F.col("key").alias("of_key"), "kept", "n_live", "n_copied")
    joined = rows.join(per_doc, rows["doc_id"].eqNullSafe(per_doc["of"]) & (rows["key"] == per_doc["of_key"]), "left")
    found = F.array_sort(F.concat("base", F.coalesce("kept", F.array().cast(_SPAN))))
    return joined.select("doc_id", *[number(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(found).alias("spans"),
                         F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))
