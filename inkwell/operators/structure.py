"""Blocks, sections and chunks of documents."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

# Words that end in a point without ending a sentence.
ABBREVIATIONS = ("dr", "mr", "mrs", "ms", "st", "jr", "sr", "vs", "etc", "prof", "rev", "vol", "no", "p", "pp")
# Words of the four scales of chunks, and the stride of topic windows.
SMALL, MEDIUM, LARGE_MOST = (4, 100), (80, 400), 1500
TOPIC_LEAST, TOPIC_ENOUGH, TOPIC_MOST, TOPIC_STRIDE = 600, 1400, 2800, 700
# Which scales may be the context and the topic of a chunk, the preferred one first.
CONTEXT = {"small": ["medium", "large", "topic"], "medium": ["large", "topic"], "large": ["topic"], "topic": []}
TOPIC = {"small": ["topic", "large", "medium"], "medium": ["topic", "large"], "large": ["topic"], "topic": []}


def block_type(text: Column) -> Column:
    """The first rule that holds: garbage, toc, page_header, list, heading, epigraph, else paragraph."""
    s = F.trim(text)
    words = F.size(F.regexp_extract_all(s, F.lit(r"\S+"), F.lit(0)))
    plain = F.length(F.regexp_replace(s, "[^A-Za-z0-9À-ÿ]", ""))
    quotes = "[\"'“”‘’]"
    return (
        F.when(s == "", "garbage")
        .when(s.rlike(r"\.{4,}"), "toc")
        .when(plain < 0.4 * F.length(s), "garbage")
        .when(s.rlike("^([0-9]{1,4}|[ivxlc]{1,7})$"), "page_header")
        .when(s.rlike("(?i)^(table of )?contents$"), "toc")
        .when(s.rlike(r"^([*+•-]|[0-9]+[.)]|[a-zA-Z][.)]|\([0-9]+\)) "), "list")
        .when((words <= 12) & ~s.rlike("[.?!:;\"”]$") & (s.rlike("(?i)^(step|chapter|tradition|concept|part|section) ") | (s.rlike("[A-Z]") & ~s.rlike("[a-zà-ÿ]"))), "heading")
        .when((words <= 45) & s.rlike(f"^{quotes}") & s.rlike(f"{quotes}.?$"), "epigraph")
        .otherwise("paragraph")
    )


def in_order(by: str = "doc_id", at: str = "ord") -> Window:
    return Window.partitionBy(by).orderBy(at)


def with_heading(blocks: DataFrame, is_heading: Column) -> DataFrame:
    """Carry the last heading forward over a document's blocks."""
    return blocks.withColumn("heading", F.last(F.when(is_heading, F.col("text")), ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, 0)))


def with_section(blocks: DataFrame, starts: Column) -> DataFrame:
    """Number the sections: a block that starts one opens the next; blocks before the first are 0."""
    return blocks.withColumn("section", F.sum(starts.cast("int")).over(in_order().rowsBetween(Window.unboundedPreceding, 0)))


def collapse_doubled(line: Column) -> Column:
    """Undo a doubled text layer: where over 60 % of characters have an equal neighbour, runs are halved."""
    runs = F.regexp_extract_all(line, F.lit(r"(?s)((.)\2*)"), F.lit(1))
    doubled = F.aggregate(runs, F.lit(0), lambda n, x: n + F.when(F.length(x) > 1, F.length(x)).otherwise(0))
    halved = F.array_join(F.transform(runs, lambda x: F.substring(x, F.lit(1), F.greatest(F.lit(1), F.floor(F.length(x) / 2).cast("int")))), "")
    return F.when((F.length(line) >= 5) & (doubled > 0.6 * F.length(line)), halved).otherwise(line)


#: Ends of sentences are marked before they are cut; a closed point is one that ends none. What may end a
#: sentence, close it and open the next (QUOTES and the classes in sentence_patterns) are fixed values.
CLOSED, CUT = "\x01", "\x02"
QUOTES = "\"'”“’‘"


def sentence_patterns() -> tuple[str, str]:
    """Patterns, for Java's and RE2's dialect: a point that an abbreviation or an initial ends in, and
    the end of a sentence with the first character of the next."""
    known = "|".join(ABBREVIATIONS)
    word = f"(?i:{known})|[A-Z]|(?:[A-Za-z][.])+[A-Za-z]"
    return f"(^|[\\s(\\[{QUOTES}])((?:{word})[.][{QUOTES})]?)(\\s)", f"([.!?][{QUOTES})]?)\\s+([A-Z\"“‘])"


def sentences(text: Column) -> Column:
    """Sentences of a paragraph; a point after an abbreviation or an initial ends none.

    Neighbouring abbreviations share the blank between them, so points are closed in two passes.
    """
    closed, end = sentence_patterns()
    for _ in range(2):
        text = F.regexp_replace(text, closed, f"$1$2{CLOSED}$3")
    parts = F.split(F.regexp_replace(text, end, f"$1{CUT}$2"), CUT)
    return F.filter(F.transform(parts, lambda x: F.trim(F.translate(x, CLOSED, ""))), lambda x: x != "")


def _shared(words: list[str], most: int) -> list[list[str]]:
    """Words in as few pieces of `most` at most as hold them, of sizes as equal as can be."""
    n = -(-len(words) // most)
    edges = [len(words) * k // n for k in range(n + 1)]
    return [words[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def _long_pieces(paragraph: str) -> list[list[str]]:
    """A paragraph of over MEDIUM words in pieces: clauses gathered while they fit, over-long ones cut evenly."""
    clauses = [c.split() for c in re.split(r"(?<=[.!?])\s+", paragraph)]
    out: list[list[str]] = []
    for words in (piece for c in clauses if c for piece in _shared(c, MEDIUM[1])):
        if out and len(out[-1]) + len(words) <= MEDIUM[1]:
            out[-1] += words
        else:
            out.append(list(words))
    if len(out) > 1 and len(out[-1]) < MEDIUM[0]:  # even out a short last piece with the one before
        both = out.pop(-2) + out.pop()
        out += _shared(both, MEDIUM[1])
    return out


def medium_chunks(paragraphs: list[str]) -> tuple[list, list]:
    """Chunks (first, last, words) of the medium scale, and small ones that found no other place.

    A paragraph of enough words stands alone and one of too many is cut; shorter ones gather until they
    have enough. Short ones left before a stop join the chunk before, if there is one.
    """
    done, small, held = [], [], []

    def settle() -> None:
        words = [w for _, text in held for w in text]
        if len(words) >= MEDIUM[0]:
            done.append([held[0][0], held[-1][0], words])
        elif held and done:
            done[-1][1] = held[-1][0]
            done[-1][2] = done[-1][2] + words
        elif len(words) >= SMALL[0]:
            small.append([held[0][0], held[-1][0], words])
        held.clear()

    for n, paragraph in enumerate(paragraphs):
        words = paragraph.split()
        if len(words) < MEDIUM[0]:
            held.append((n, words))
            if sum(len(w) for _, w in held) >= MEDIUM[0]:
                settle()
        else:
            settle()
            done += [[n, n, piece] for piece in ([words] if len(words) <= MEDIUM[1] else _long_pieces(paragraph))]
    settle()
    return done, small


def large_spans(sizes: list[int]) -> list[tuple[int, int]]:
    """Paragraphs gathered while LARGE_MOST words hold them; the last span only if it is more than a medium chunk."""
    out, first, total = [], 0, 0
    for n, size in enumerate(sizes):
        if n > first and total + size > LARGE_MOST:
            out.append((first, n - 1))
            first, total = n, 0
        total += size
    return out + [(first, len(sizes) - 1)] if sizes and total > MEDIUM[1] else out


def topic_spans(sizes: list[int]) -> list[tuple[int, int]]:
    """Overlapping windows: TOPIC_ENOUGH words at least where there are so many, going on while TOPIC_MOST
    holds the next paragraph; the next window starts TOPIC_STRIDE words later."""
    upto = [0, *accumulate(sizes)]
    out: list[tuple[int, int]] = []
    first = 0
    while upto[-1] > MEDIUM[1] and first < len(sizes):
        enough = bisect_left(upto, upto[first] + TOPIC_ENOUGH, first + 1)
        stop = min(max(enough, bisect_right(upto, upto[first] + TOPIC_MOST) - 1), len(sizes))
        words = upto[stop] - upto[first]
        if words >= TOPIC_LEAST or (not out and words > MEDIUM[1]):
            out.append((first, stop - 1))
        if stop == len(sizes):
            break
        first = min(max(bisect_left(upto, upto[first] + TOPIC_STRIDE, first + 1), first + 1), stop)
    return out


def chunks(docs: DataFrame) -> DataFrame:
    """Chunks of a document's lines at four scales: (doc_id, scale, chunk_index, start, end, words, text).

    Every line is a paragraph. A document is one row of input, so each is cut in its own task batch
    and none is gathered; null and blank texts have no chunk.
    """

    def of_document(text: str | None) -> Iterator[tuple]:
        paragraphs = [x.strip() for x in (text or "").split("\n") if x.strip()]
        words = [x.split() for x in paragraphs]
        sizes = [len(w) for w in words]
        medium, left = medium_chunks(paragraphs)
        small = [(n, n, w) for n, w in enumerate(words) if SMALL[0] <= len(w) <= SMALL[1]] + left
        spans = {"large": large_spans(sizes), "topic": topic_spans(sizes)}
        found = {"small": small, "medium": medium} | {k: [(a, b, [w for x in words[a : b + 1] for w in x]) for a, b in v] for k, v in spans.items()}
        for scale, parts in found.items():
            yield from ((scale, i, a, b, len(w), " ".join(w)) for i, (a, b, w) in enumerate(parts))

    names = ["doc_id", "scale", "chunk_index", "start", "end", "words", "text"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                rows += [(doc_id, *chunk) for chunk in of_document(text)]
                if len(rows) > 5000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return docs.select("doc_id", "text").mapInPandas(cut, "doc_id long, scale string, chunk_index int, start int, end int, words int, text string")


def covering(parts: DataFrame) -> DataFrame:
    """Context and topic of every chunk: the first chunk that covers its lines, of the first scale in its
    order of preference that has one; the chunk itself where none has.

    (doc_id, scale, chunk_index, context_scale, context_index, topic_scale, topic_index)
    """
    own = parts.select("doc_id", "scale", "chunk_index", "start", "end")
    other = parts.select("doc_id", F.col("scale").alias("at"), F.col("chunk_index").alias("k"), F.col("start").alias("a"), F.col("end").alias("b"))
    # a chunk that covers another holds its first line: they meet by lines, not by pairs of a document's chunks
    lines = other.withColumn("start", F.explode(F.sequence("a", "b")))
    near = own.join(lines, ["doc_id", "start"]).where("at <> scale AND b >= end")

    def place(order: dict[str, list[str]]) -> Column:
        of = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
        at = F.array_position(of[F.col("scale")], F.col("at"))
        return F.min(F.when(at > 0, F.struct(at.alias("n"), "k", "at")))

    best = near.groupBy("doc_id", "scale", "chunk_index").agg(place(CONTEXT).alias("c"), place(TOPIC).alias("t"))
    names = [F.coalesce(f"{x}.{y}", z).alias(f"{n}_{m}") for x, n in (("c", "context"), ("t", "topic")) for y, z, m in (("at", "scale", "scale"), ("k", "chunk_index", "index"))]
    return own.join(best, ["doc_id", "scale", "chunk_index"], "left").select("doc_id", "scale", "chunk_index", *names)


#: Blocks that a task holds before it hands them on: characters and rows.
HELD_CHARS, HELD_ROWS = 1 << 21, 5000


class _Blocks(HTMLParser):
    TAGS = {"h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "p", "pre"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.tag, self.held, self.skip = None, [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in self.TAGS:
            self._close()
            self.tag = tag

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == self.tag:
            self._close()

    def handle_data(self, data):
        if self.tag and not self.skip:
            self.held.append(data)

    def _close(self):
        text = " ".join("".join(self.held).split())
        if self.tag and text:
            kind = "heading" if self.tag[0] == "h" and self.tag[1:].isdigit() else {"li": "list", "blockquote": "epigraph"}.get(self.tag, "paragraph")
            self.found.append((kind, text))
        self.tag, self.held = None, []


def html_blocks(pages: DataFrame) -> DataFrame:
    """Typed blocks of web pages in order: (page_id, ord, type, text)."""

    schema = StructType.fromDDL("page_id long, ord int, type string, text string")
    arrow = to_arrow_schema(schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, chars = [], 0
            for page_id, html in zip(batch.column(0), batch.column(1), strict=True):  # one page at a time leaves Arrow's memory
                parser = _Blocks()
                parser.feed(html.as_py() or "")
                parser._close()
                rows += [(page_id.as_py(), n, kind, text) for n, (kind, text) in enumerate(parser.found)]
                chars += sum(len(text) for _, text in parser.found)
                if chars > HELD_CHARS or len(rows) > HELD_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                    rows, chars = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return pages.select("page_id", "html").mapInArrow(parse, schema)


PASSAGE = (120, 260, 25)  # words: enough, most, least kept


def passages(docs: DataFrame, heading_chars: int = 80) -> DataFrame:
    """Lines gathered to passages inside their section: (doc_id, passage, section, start, end, words).

    A passage closes when it has enough words, when a line would carry it past the most, or when the
    section (opened by a line of heading_chars or fewer) ends; very short ones are left out.
    """
    enough, most, least = PASSAGE

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                section, held, found = 0, None, []
                for n, line in enumerate(x for x in (text or "").split("\n") if x.strip()):
                    size = len(line.split())
                    if len(line) <= heading_chars:
                        section += 1
                        continue
                    if held and (held[0] != section or held[3] >= enough or held[3] + size > most):
                        found.append(held)
                        held = None
                    held = [section, held[1], n, held[3] + size] if held else [section, n, n, size]
                found += [held] if held else []
                rows += [(doc_id, k, *p) for k, p in enumerate(p for p in found if p[3] >= least)]
            yield pd.DataFrame(rows, columns=["doc_id", "passage", "section", "start", "end", "words"])

    return docs.select("doc_id", "text").mapInPandas(cut, "doc_id long, passage int, section int, start int, end int, words int")
