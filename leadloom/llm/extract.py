"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score +1; tags score below zero, with weights learned from labelled pages: pages that
mark their article with ``<article>`` or ``<main>`` (or ``role=main``) tell for each kind of tag how often it stands inside and
outside. A kind is the tag's name and its classes; a kind that the labelled pages do not show weighs as its single classes do, and
those as the tag's name alone. A linear scan (best sum ending here) finds the contiguous region with the
largest score. Elements that hold no article text by their meaning, or by what the labelled pages show, are cut out before.

Weights come from all labelled pages, summed in Spark by the hash of the kind: the model has ``2**BITS`` slots whatever the number of
kinds, and none is left out. Pages that mark no article use the same weights. What stands inside of articles, marks cannot
teach to tell from the article; there a fixed list of names decides.

Null html counts as empty; pages without text give an empty text. Character references are decoded, white space inside a block
becomes one space, blocks are joined by an empty line. Unclosed tags and comments are closed by what encloses them or by the
end. Repeated rows agree, null ids are kept, further columns are ignored, an empty table stays empty.
"""
from __future__ import annotations

import html as references
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm import common

#: Elements that never hold article text, elements that begin a block, elements without an end tag.
SILENT = frozenset("head script style noscript template iframe svg math canvas object embed audio video map nav footer aside form button select option textarea dialog menu title label input".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
#: Elements of other languages, which may close themselves.
FOREIGN = frozenset("svg math".split())
#: Parts of class, id and role names that mark what stands beside an article.
BESIDE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|advertisement|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice\w*|alert|popup|modal|newsletter|subscribe|"
                    r"sidebar|side|menu\w*|nav\w*|breadcrumb\w*|footer|foot|masthead|site-header|page-header|topbar|comments?|commentlist|disqus|replies|reply|related|share|sharing|social|widget\w*|"
                    r"contentinfo|complementary|navigation|search|toolbar|login|signup|paywall|pagination|pager|skip\w*)(?=$|[\s_-])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
_ATTRIBUTES = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b", re.I)
MARKS = ("article", "main")


class Node:
    """An element being read: its kind, and whether its text is silent."""

    __slots__ = ("name", "kind", "beside", "marked")

    def __init__(self, name: str, kind: str, beside: bool, marked: bool):
        self.name, self.kind, self.beside, self.marked = name, kind, beside, marked


def _opened(name: str, attributes: str) -> tuple[str, bool, bool]:
    """Kind of a tag, whether its names mark something beside the article, and whether it marks the article."""
    classes, beside, marked = "", False, name in MARKS
    if attributes and not attributes.isspace():
        for found in _ATTRIBUTES.finditer(attributes):
            key = (found[1] or found[5]).lower()
            value = found[2] or found[3] or found[4] or ""
            if key in ("class", "id", "role"):
                beside |= bool(BESIDE.search(value))
                if key == "class":
                    classes = ".".join(sorted(set(value.lower().split())))
                elif key == "role":
                    marked |= value.lower() == "main"
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                beside = True
    return (f"{name}.{classes}" if classes else name), beside and not marked, marked


def read(page: str) -> Iterator[tuple[str, str, str, bool, bool]]:
    """(``open``, ``close`` or ``text``; kind or text; tag name; silent; inside a marked article) in page order."""
    stack: list[Node] = []
    at, size = 0, len(page)
    quiet = marked = 0
    while at < size:
        found = _TOKEN.search(page, at)
        begin = found.start() if found else size
        if begin > at:
            yield "text", page[at:begin], "", quiet > 0, marked > 0
        if not found:
            return
        at = found.end()
        if found[2] is None:
            continue
        name = found[2].lower()
        if found[1]:
            if any(n.name == name for n in stack):
                while True:
                    node = stack.pop()
                    quiet -= node.beside
                    marked -= node.marked
                    yield "close", node.kind, node.name, quiet > 0, marked > 0
                    if node.name == name:
                        break
            continue
        kind, beside, mark = _opened(name, found[3])
        if name in VOID or (name in FOREIGN and found[3].endswith("/")):
            yield "open", kind, name, quiet > 0, marked > 0
            continue
        if name in BLOCKS and stack and stack[-1].name == "p":  # a block ends an open paragraph
            node = stack.pop()
            yield "close", node.kind, node.name, quiet > 0, marked > 0
        elif name == "li" and stack and stack[-1].name == "li":
            node = stack.pop()
            quiet -= node.beside
            marked -= node.marked
            yield "close", node.kind, node.name, quiet > 0, marked > 0
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        silent = beside or name in SILENT or (name == "header" and not marked)
        yield "open", kind, name, quiet > 0 or silent, marked > 0
        stack.append(Node(name, kind, silent, mark))
        quiet += silent
        marked += mark


BITS = 20
SLOTS = pa.schema([("slot", pa.int64()), ("inside", pa.int64()), ("outside", pa.int64())])


def slot(kind: str) -> int:
    return zlib.crc32(kind.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def family(kind: str) -> list[str]:
    """A kind, each of its classes alone with the tag's name, and the name; fewer if they are the same."""
    name, *classes = kind.split(".")
    return list(dict.fromkeys([kind, *(f"{name}.{c}" for c in classes), name]))


def learn(pages: DataFrame, flush: int = 200_000) -> np.ndarray:
    """How often each kind, class and name of tag stands inside (row 0) and outside (row 1) of the article in the pages that mark one, by slot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(inside: Counter, outside: Counter) -> pa.RecordBatch:
            slots = sorted(inside.keys() | outside.keys())
            return pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array([inside[k] for k in slots], pa.int64()), pa.array([outside[k] for k in slots], pa.int64())], schema=SLOTS)

        inside, outside = Counter(), Counter()
        for batch in batches:
            for cell in batch.column(0):
                seen = [Counter(), Counter()]
                for what, kind, _, silent, mark in read(cell.as_py()):
                    if what == "open" and not silent:
                        seen[mark][kind] += 1
                if seen[1]:
                    for total, some in ((outside, seen[0]), (inside, seen[1])):
                        for kind, n in some.items():
                            for each in family(kind):
                                total[slot(each)] += n
                if len(inside) + len(outside) > flush:
                    yield told(inside, outside)
                    inside, outside = Counter(), Counter()
        yield told(inside, outside)

    html = pages.select(F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    total = html.mapInArrow(run, "slot long, inside long, outside long").groupBy("slot").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    counts = np.zeros((2, 1 << BITS), np.float32)
    table = total.toArrow()  # a row for each slot at most
    counts[:, table.column("slot").to_numpy()] = np.stack([table.column("inside").to_numpy(), table.column("outside").to_numpy()])
    return counts


class Scorer:
    """Tag weights: -0.1 for inline tags and what no labelled page shows, down to -``steep`` for blocks that only stand outside of articles."""

    def __init__(self, counts: np.ndarray, steep: float = 200.0):
        self.counts, self.steep = counts, steep
        self.known: dict[str, float] = {}

    def share(self, kind: str) -> float:
        """Share of a kind's places outside of articles; of its known classes on average, or of its name, if it was never seen."""
        def of(key: str) -> float | None:
            inside, outside = self.counts[:, slot(key)].tolist()
            return outside / (inside + outside) if inside + outside else None

        whole, *parts = [of(key) for key in family(kind)]
        if whole is not None or not parts:
            return whole or 0.0
        classes = [p for p in parts[:-1] if p is not None]
        return sum(classes) / len(classes) if classes else parts[-1] or 0.0

    def weight(self, kind: str, name: str) -> float:
        found = self.known.get(kind)
        if found is None:
            share = self.share(kind) if name in BLOCKS else 0.0
            found = -self.steep if name in MARKS else -0.1 - self.steep * max(0.0, 2.0 * share - 1.0)
            if len(self.known) < 100_000:
                self.known[kind] = found
        return found

    def text(self, page: str) -> str:
        """The text of the page's best region."""
        # Blocks of words between tags, and the sum of the tags' weights that stands before each.
        pieces: list[tuple[float, str, bool]] = []
        before, breaks = 0.0, True
        for what, value, name, silent, _ in read(page):
            if what == "text":
                if not silent:
                    pieces.append((before, value, breaks))
                    before, breaks = 0.0, False
                continue
            if silent:
                breaks = breaks or name in BLOCKS
                continue
            before += self.weight(value, name)
            if name in BLOCKS:
                breaks = True
            elif name == "br":
                pieces.append((before, " ", breaks))
                before, breaks = 0.0, False
        best, best_from, best_to, total, start = 0.0, 0, 0, 0.0, 0
        for k, (cost, value, _) in enumerate(pieces):
            words = len(value.split())
            if total + cost <= 0:
                total, start = 0.0, k
            else:
                total += cost
            total += words
            if total > best:
                best, best_from, best_to = total, start, k + 1
        blocks: list[list[str]] = []
        for _, value, new in pieces[best_from:best_to]:
            if new or not blocks:
                blocks.append([])
            blocks[-1].append(value)
        shown = (" ".join(references.unescape("".join(block)).split()) for block in blocks)
        return "\n\n".join(block for block in shown if block)


EXTRACTED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, counts: np.ndarray | None = None) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row."""
    scorer = Scorer(learn(pages) if counts is None else counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in batches:
                for page_id, url, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    text = scorer.text(cell.as_py())
                    yield page_id, url, text, len(text)
        return common.batches_of(each(), EXTRACTED, 512)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
