"""Line deduplication by content-defined chunks of lines.

A text's lines are hashed; a rolling polynomial over two neighbouring line hashes is taken at every line, and a chunk ends where it has a
local minimum, so a boundary depends on nearby lines only: lines put in or taken out elsewhere do not shift it, and a chunk
has two lines or more but at the ends of a text. Chunks with at least two lines that are not blank are counted over the
whole corpus by hash and bytes. Of a repeated chunk the document with the smallest id keeps its first one; each other
occurrence is compared byte by byte with the counted text and removed. ``dedup`` stops there. In ``dedup_passages`` the rolling hash over two
neighbouring lines that are not blank is counted itself, and a boundary also stands wherever it occurs once only in the corpus. So a passage
is a chunk to its first and last line whatever stands around it: runs of repeated pairs, and single lines, go if they have more than 50 words. Lines
become narrow rows of two hashes and a place; texts are shuffled once, for the comparison of bytes and for the result.

Only DataFrame expressions are used. Equal chunks are combined before they are shuffled, so a chunk in a third of all documents
is one row per task. Null texts count as empty and stay null where nothing is removed. Rows that share an id are one document
and keep what it keeps, rows without an id are together one document with the largest id. Repeated rows agree. Further columns
are carried along whatever their names; an empty table stays empty.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm import common

_PRIME, _BASE, _LOW = 1_048_573, 65_599, 0xFFFFF
_LAST = (1 << 63) - 1
_FULL = r"[^\x20\x09-\x0D]"
#: Repeated passages have more words than this, also those of one line.
MIN_WORDS = 50


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row`` (all columns), ``id``, ``key`` and ``text``."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("text", F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")))
    return rows.select("row", F.coalesce(F.col("row")[id_col].cast("long"), F.lit(_LAST)).alias("id"), common.text_key(F.col("text")).alias("key"), "text")


def _chunked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``lines`` and ``chunks`` (start, number of lines, hash, whether it can be removed) of their ``text``."""
    rows = rows.withColumn("lines", F.split("text", "\n", -1))
    rows = rows.withColumn("hashes", F.transform("lines", lambda line: F.xxhash64(line).bitwiseAND(_LOW)))
    rolling = F.transform("hashes", lambda h, i: (F.coalesce(F.get(F.col("hashes"), i - 1), F.lit(0)) * _BASE + h) % _PRIME)
    rows = rows.withColumn("rolling", rolling)

    def ends(i: Column) -> Column:  # after line i
        here = F.get(F.col("rolling"), i)
        return (here < F.get(F.col("rolling"), i - 1)) & (here <= F.get(F.col("rolling"), i + 1))

    inner = F.when(F.size("lines") > 3, F.filter(F.sequence(F.lit(2), F.size("lines") - 1), lambda i: ends(i - 1))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("starts", F.concat(F.array(F.lit(0)), inner))

    def chunk(start: Column, k: Column) -> Column:
        n = F.coalesce(F.get(F.col("starts"), k + 1), F.size("lines")) - start
        own = F.slice("lines", start + 1, n)
        return F.struct(start.alias("start"), n.alias("n"), F.xxhash64(own).alias("hash"), (F.size(F.filter(own, lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))) >= 2).alias("many"))

    return rows.withColumn("chunks", F.transform("starts", chunk)).drop("hashes", "rolling", "starts")


def _body(start: Column, n: Column) -> Column:
    return F.array_join(F.slice("lines", start + 1, n), "\n")


def repeated_chunks(prepared: DataFrame) -> DataFrame:
    """``hash``, ``body`` and ``first`` (the id that keeps it) of every chunk that occurs twice or more."""
    many = F.filter("chunks", lambda c: c["many"])
    bodies = prepared.select("id", F.explode(F.transform(many, lambda c: F.struct(c["hash"].alias("hash"), _body(c["start"], c["n"]).alias("body")))).alias("c"))
    return bodies.groupBy("c.hash", "c.body").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row``, ``lines``, the ``kept`` chunks and the number of lines ``gone``."""
    keyed = _keyed(docs, id_col, text_col)
    prepared = _chunked(keyed)
    places = prepared.select("id", "key", F.explode(F.filter("chunks", lambda c: c["many"])).alias("c")).select("id", "key", "c.start", "c.n", "c.hash").distinct()
    found = places.join(repeated_chunks(prepared), "hash")
    found = found.groupBy(F.col("id").alias("of"), F.col("key").alias("of_key")).agg(F.collect_list(F.struct("start", "n", "body", "first")).alias("found"))
    rows = keyed.drop("text").join(found, (F.col("id") == F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    rows = _chunked(rows.withColumn("text", F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))))

    def again(f: Column) -> Column:
        elsewhere = f["first"] != F.col("id")
        earlier = F.exists("found", lambda g: (g["start"] < f["start"]) & (g["body"] == f["body"]))
        return (f["body"] == _body(f["start"], f["n"])) & (elsewhere | earlier)

    # Byte comparison of each occurrence with the counted body.
    rows = rows.withColumn("out", F.transform(F.filter("found", again), lambda f: f["start"]))
    kept = F.filter("chunks", lambda c: F.coalesce(~F.array_contains("out", c["start"]), F.lit(True)))
    gone = F.aggregate(F.filter("chunks", lambda c: F.coalesce(F.array_contains("out", c["start"]), F.lit(False))), F.lit(0), lambda a, c: a + c["n"])
    return rows.select("row", "lines", kept.alias("kept"), gone.cast("long").alias("gone"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in ``row`` with the deduplicated text in it, ``n_lines`` before and ``n_removed`` of every row."""
    rest = F.array_join(F.flatten(F.transform("kept", lambda c: F.slice("lines", c["start"] + 1, c["n"]))), "\n")
    text = F.when(F.col("gone") > 0, rest).otherwise(F.col("row")[text_col].cast("string"))
    return _marked(docs, id_col, text_col).select(F.col("row").withField(text_col, text).alias("row"), F.size("lines").cast("long").alias("n_lines"), F.col("gone").alias("n_removed"))


def _line_rows(keyed: DataFrame) -> DataFrame:
    """One row per line of every distinct (``id``, ``key``), in partitions by them: ``pos``, two hashes, whether it is ``full`` (not blank) and ``long``."""
    rows = keyed.select("id", "key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    # 51 words take 101 characters.
    long = F.when(F.length("line") > 2 * MIN_WORDS, _n_words(F.col("line")) > MIN_WORDS).otherwise(False)
    rows = rows.select("id", "key", "pos", *_names(F.col("line")), F.rlike("line", F.lit(_FULL)).alias("full"), long.alias("long")).repartition("id", "key")
    # Rows that agree in id and text are one.
    once = F.row_number().over(Window.partitionBy("id", "key", "pos").orderBy("h")) == 1
    return rows.withColumn("once", once).where("once").drop("once")


def _names(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("c")


def _n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(common.WORD))


_ROW = ["id", "key"]
_UNIT = ["id", "key", "start", "stop", "whole", "u", "v"]


def _chunks(lines: DataFrame) -> DataFrame:
    """Chunks between local minima of the rolling hash, with two or more lines that are not blank."""
    order = Window.partitionBy(*_ROW).orderBy("pos")
    low = F.col("h").bitwiseAND(_LOW)
    rows = lines.withColumn("rolling", (F.coalesce(F.lag(low).over(order), F.lit(0)) * _BASE + low) % _PRIME)
    before = F.lag("rolling").over(order)
    minimum = (before < F.lag("rolling", 2).over(order)) & (before <= F.col("rolling")) & ((F.col("pos") > 2) | F.lead("pos").over(order).isNotNull())
    rows = rows.withColumn("cut", F.when(minimum, F.col("pos")))
    rows = rows.withColumn("start", F.coalesce(F.last("cut", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    place = F.col("pos") - F.col("start")
    found = rows.groupBy(*_ROW, "start").agg(
        F.max("pos").alias("stop"), F.count_if("full").alias("full"), F.bit_xor(F.xxhash64(F.lit(3), "h", "c", place)).alias("u"), F.bit_xor(F.xxhash64(F.lit(4), "c", "h", place)).alias("v"))
    return found.where("full >= 2").withColumn("whole", F.lit(True)).select(*_UNIT)


def _pairs(lines: DataFrame) -> DataFrame:
    """Every two neighbouring lines that are not blank, and every long line."""
    order = Window.partitionBy(*_ROW).orderBy("pos")
    rows = lines.where("full").select("*", F.lead("pos").over(order).alias("then"), F.lead("h").over(order).alias("h2"), F.lead("c").over(order).alias("c2"))
    two = F.when(F.col("then").isNotNull(), F.struct(F.col("then").alias("stop"), F.xxhash64(F.lit(2), "h", "c", "h2", "c2").alias("u"), F.xxhash64(F.lit(5), "c2", "h2", "c", "h").alias("v")))
    one = F.when(F.col("long"), F.struct(F.col("pos").alias("stop"), F.xxhash64(F.lit(1), "h", "c").alias("u"), F.xxhash64(F.lit(6), "c", "h").alias("v")))
    return rows.select(*_ROW, F.col("pos").alias("start"), F.explode(F.array_compact(F.array(two, one))).alias("x")).select(*_ROW, "start", "x.stop", F.lit(False).alias("whole"), "x.u", "x.v")


def _runs(places: DataFrame) -> DataFrame:
    """``runs`` of every (``id``, ``key``), in order: its places put together where they touch, ``a`` to ``b``, with the whole chunks in each."""
    order = Window.partitionBy(*_ROW).orderBy("start", "stop")
    rows = places.withColumn("end", F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("run", F.sum(F.when(F.col("end") >= F.col("start") - 1, 0).otherwise(1)).over(order))
    chunk = F.when(F.col("whole"), F.struct(F.col("start").alias("a"), F.col("stop").alias("b")))
    rows = rows.groupBy(*_ROW, "run").agg(F.min("start").alias("a"), F.max("stop").alias("b"), F.sort_array(F.collect_list(chunk)).alias("chunks"))
    return rows.groupBy(*_ROW).agg(F.sort_array(F.collect_list(F.struct("a", "b", "chunks"))).alias("runs")).select(F.col("id").alias("of"), F.col("key").alias("of_key"), "runs")


def _of(rows: DataFrame, others: DataFrame, how: str = "inner") -> DataFrame:
    return rows.join(others, (F.col("id") == F.col("of")) & (F.col("key") == F.col("of_key")), how).drop("of", "of_key")


def repeated_places(lines: DataFrame) -> DataFrame:
    """Units (chunks, pairs and long lines) that occur twice or more, with the id of the ``first`` document and whether another stands earlier: ``again``."""
    units = _chunks(lines).union(_pairs(lines))
    counted = units.groupBy("u", "v").agg(F.count("*").alias("times"), F.min("id").alias("first")).where("times > 1").drop("times")
    places = units.join(counted, ["u", "v"]).repartition(*_ROW)
    earlier = F.row_number().over(Window.partitionBy(*_ROW, "u", "v").orderBy("start")) > 1
    return places.withColumn("again", (F.col("first") != F.col("id")) | earlier)


def unequal(told: DataFrame) -> DataFrame:
    """Rows (``of``, ``of_key``) that hold a ``line`` whose hashes another line of ``told`` has too, by their bytes."""
    named = told.select("id", "key", "line", *_names(F.col("line")))
    shared = named.select("h", "c", "line").distinct().groupBy("h", "c").agg(F.count("*").alias("lines")).where("lines > 1").select("h", "c")
    return named.select("id", "key", "h", "c").join(shared, ["h", "c"], "left_semi").select(F.col("id").alias("of"), F.col("key").alias("of_key")).distinct()


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``dedup``, and also without repeated passages of more than ``MIN_WORDS`` words wherever their chunks end.

    A passage is a run of lines covered by units (two neighbouring lines, or one long line) that stand earlier in the corpus: in a document with a
    smaller id, or before in the same one. Every line removed has an equal one at an earlier place, so one of each stays. Units are
    told apart by 128 bits over the hashes of their lines; the repeated lines themselves are compared byte by byte, and a document
    with a line that only its hashes repeat stays as it is.
    """
    keyed = _keyed(docs, id_col, text_col)
    places = repeated_places(_line_rows(keyed))
    # Both joins below read this exchange: ``told`` takes the whole row, or Spark would shuffle a narrower one again.
    rows = keyed.select("row", "id", "key").repartition(*_ROW)
    cut = lambda text: F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)
    told = _of(rows, _runs(places)).select("id", "key", "runs", cut(F.element_at(F.array_repeat("row", 1), 1)[text_col]).alias("lines"))
    told = told.select("id", "key", F.explode(F.flatten(F.transform("runs", lambda r: F.slice("lines", r["a"] + 1, r["b"] - r["a"] + 1)))).alias("line"))
    found = _runs(places.where("again"))
    found = found.join(unequal(told), ["of", "of_key"], "left_anti")

    out = _of(rows, found, "left").withColumn("lines", cut(F.col("row")[text_col]))
    body = lambda r: F.array_join(F.slice("lines", r["a"] + 1, r["b"] - r["a"] + 1), "\n")
    gone = F.flatten(F.transform("runs", lambda r: F.when(_n_words(body(r)) > MIN_WORDS, F.array(F.struct(r["a"].alias("a"), r["b"].alias("b")))).otherwise(r["chunks"])))
    out = out.withColumn("gone", F.coalesce(gone, F.array().cast("array<struct<a:int,b:int>>")))
    n_lines = F.size("lines")
    # What stands between the parts that go.
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda g: g["b"] + 1))
    stops = F.concat(F.transform("gone", lambda g: g["a"]), F.array(n_lines))
    left = F.flatten(F.zip_with(starts, stops, lambda a, b: F.slice("lines", a + 1, b - a)))
    out = out.withColumn("left", F.when(F.size("gone") > 0, left))
    out = out.withColumn("rest", F.array_join("left", "\n"))
    # Blank lines that alone are left go too.
    blank = ~F.rlike("rest", F.lit(_FULL))
    text = F.when(F.col("left").isNull(), F.col("row")[text_col].cast("string")).when(blank, F.lit("")).otherwise(F.col("rest"))
    removed = F.when(F.col("left").isNull(), 0).when(blank, n_lines).otherwise(n_lines - F.size("left"))
    return out.select(F.col("row").withField(text_col, text).alias("row"), n_lines.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))
