"""Where a snippet stands in a rendered page, whatever markup is between its words; and spans of text that are put in place of others."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Words of three characters or more count; how many of them, and what gap between two of them in characters, is tried in turn; the gap and
# the words of a stride after that, how far a stride is looked for, and how far after one that was missed; how often a stride may be missed.
TRIES = ((10, 50), (8, 60), (6, 80), (4, 120), (3, 160))
STRIDE, STRIDE_GAP, REACH, FAR, MISSES = 8, 80, 4000, 9000, 2
HEADS = 8
#: What may part a word in two: a hyphen or none, then blanks and markup.
BREAK = r"(?:[-­]?(?:<[^>]{0,80}>|\s){1,8})?"


RUN = re.compile(r"[-­]?(?:\s|<[^>]{0,80}>)+")
SHORT = re.compile(r"[-­]?(?:<[^>]{0,80}>|\s){1,8}")


class _Small(dict):
    """Small letters one by one, so that places stay; what has none of its own length stays as it is."""

    def __missing__(self, code: int) -> int:
        low = chr(code).lower()
        self[code] = ord(low) if len(low) == 1 else code
        return self[code]


SMALL = _Small()


class Page:
    """A page's text, in which words are looked for.

    What may part a word is left out of a copy, in which words are looked for as they are; a longer run of markup stays a mark there.
    """

    def __init__(self, text: str):
        self.text = text
        runs = [m.span() for m in RUN.finditer(text)]
        # a run of eight characters is no longer than eight blanks and tags
        marks = ["" if b - a <= 8 or SHORT.fullmatch(text, a, b) else "\0" for a, b in runs]
        self.far = [0, *(b for _, b in runs)]
        parts = [text[at:start] + mark for at, (start, _), mark in zip(self.far, runs, marks, strict=False)]
        self.near = [0, *accumulate(map(len, parts))]
        parts.append(text[self.far[-1] :])
        close = "".join(parts)
        self.close = close.lower() if close.isascii() else close.translate(SMALL)

    def original(self, at: int) -> int:
        """The place in the text of a place in the copy."""
        k = bisect_right(self.near, at) - 1
        return self.far[k] + at - self.near[k]

    def copied(self, at: int) -> int:
        k = bisect_right(self.far, at) - 1
        return min([self.near[k] + at - self.far[k], *self.near[k + 1 : k + 2]])

    def edge(self, at: int) -> bool:
        """Whether a word begins or ends here."""
        inside = lambda k: 0 <= k < len(self.text) and (self.text[k].isalnum() or self.text[k] == "_")
        return inside(at - 1) != inside(at)

    def chains(self, words: list[str], gap: int, closed: bool, low: int = 0, high: int | None = None) -> Iterator[tuple[int, int]]:
        """(start, end) of the words in order, each at most `gap` characters after the one before and as near as can be; the first begins a
        word and, if closed, the last ends one. What follows a place is remembered, so a page costs its occurrences, not their combinations."""
        high = len(self.text) if high is None else high
        lows, find = [w.lower() for w in words], self.close.find
        if any(w not in self.close for w in lows):
            return
        known: list[dict[int, int | None]] = [{} for _ in words]

        def end_of(k: int, at: int) -> int | None:
            """Where the chain ends that goes on from the k-th word at a place of the copy; none if it does not."""
            if at in known[k]:
                return known[k][at]
            over, end = at + len(lows[k]), None
            stop = self.original(over - 1) + 1
            if stop <= high and k == len(words) - 1:
                end = stop if not closed or self.edge(stop) else None
            elif stop <= high:
                word, most = lows[k + 1], min(stop + gap, high)
                limit = over + most - stop + len(word)  # in the copy nothing is farther apart than in the text
                later = find(word, over, limit)
                while end is None and later >= 0 and (start := self.original(later)) <= most:
                    end = end_of(k + 1, later) if start > stop else None
                    later = find(word, later + 1, limit)
            known[k][at] = end
            return end

        after, at = low, find(lows[0], self.copied(low))
        while at >= 0 and (start := self.original(at)) <= high:
            end = end_of(0, at) if start >= after and self.edge(start) else None
            if end is not None:
                yield start, end
                after = end
            at = find(lows[0], at + 1)


def locate(snippet: str | None, text: str | None) -> tuple[int, int, int] | None:
    """(start, end, words found) of the place that holds most of a snippet; null for none.

    The first words are looked for with ever fewer words and wider gaps; from each of the first places that hold them the
    rest is followed in strides, two of which in a row may be missing. Of places that hold as much the first counts.
    """
    words = [w for w in re.findall("[A-Za-z0-9]+", snippet or "") if len(w) >= 3]
    page = Page(text or "")
    heads: list[tuple[int, int]] = []
    for count, gap in TRIES:
        if 2 <= count <= min(len(words), TRIES[0][0]):
            heads = [span for _, span in zip(range(HEADS), page.chains(words[:count], gap, True), strict=False)]
            if heads:
                break
    best = None
    for start, end in heads:
        seen, missed, position = min(TRIES[0][0], len(words)), 0, end
        for at in range(TRIES[0][0], len(words), STRIDE):
            stride = words[at : at + STRIDE]
            if len(stride) < 3 or missed > MISSES:
                break
            reach = position + (FAR if missed else REACH)
            found = next(page.chains(stride, STRIDE_GAP, False, position, reach), None)
            if found:
                position = end = found[1]
                seen, missed = seen + len(stride), 0
            else:
                missed += 1
        if best is None or seen > best[2]:
            best = (start, end, seen)
    return best


def located(rows: DataFrame, keys: list[str], snippet: str, text: str) -> DataFrame:
    """(keys..., start, end, words): null where the snippet is not found. One row is one page: nothing is shuffled."""
    schema = StructType([*(rows.schema[k] for k in keys), *StructType.fromDDL("start long, end long, words long").fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            spans = [locate(s, t) or (None, None, None) for s, t in zip(frame["_snippet"], frame["_text"], strict=True)]
            yield frame[keys].assign(**{name: pd.array([s[k] for s in spans], "Int64") for k, name in enumerate(("start", "end", "words"))})

    return rows.select(*keys, F.col(snippet).alias("_snippet"), F.col(text).alias("_text")).mapInPandas(run, schema)


# How a text points at the first or the second of two passages, by a number after its kind or before it; letters and blanks are ASCII's.
_BLANK = r"[ \t\n\x0b\f\r]"
POINTERS = {
    "after": rf"\b(?ai:source{_BLANK}*[12](?:['’]s)?)\b",
    "before": rf"\b(?ai:(?:first|second){_BLANK}+(?:source|reading)(?:['’]s)?|(?:first|second){_BLANK}+(?:work|selection)|(?:1st|2nd){_BLANK}+(?:source|reading))\b",
}
_END = r"(?:\r\n|(?<!\r)\n|[\r\x85\u2028\u2029])?\Z"  # a last line end may follow
POINTER, ARTICLE, OWNED = [re.compile(p) for p in POINTERS.values()], re.compile(f" the{_BLANK}{_END}"), re.compile(f"[sS]{_END}")


def outermost(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of spans (start, end) that overlap, the longest, and of equally long ones the first; in order.

    Spans are sorted by length and taken if none taken before overlaps them, so a long span beats all that it meets."""
    taken: list[tuple[int, int]] = []
    for span in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
        k = bisect_left(taken, span)
        if (k == 0 or taken[k - 1][1] <= span[0]) and (k == len(taken) or span[1] <= taken[k][0]):
            taken.insert(k, span)
    return taken


def titled(text: str | None, first: str | None, second: str | None) -> str | None:
    """One text, in one walk over its pointers; null if a title asked for is."""
    if not isinstance(text, str):
        return None
    out, at = [], 0
    for start, end in outermost([m.span() for p in POINTER for m in p.finditer(text)]):
        said = text[start:end]
        title = first if re.search("first|1", said.lower()) else second
        if not isinstance(title, str):
            return None
        before = text[at:start]
        if len(before) >= 4 and ARTICLE.search(text, max(0, start - 8), start) and not title.lower().startswith("the "):
            before = before[:-4]
        own = ("'" if OWNED.search(title) else "'s") if re.search("['’]s$", said) else ""
        out += [before, title, own]
        at = end
    return "".join(out) + text[at:] if out else text


def _titled(texts: pd.Series, firsts: pd.Series, seconds: pd.Series) -> pd.Series:
    return pd.Series([titled(*row) for row in zip(texts, firsts, seconds, strict=True)], dtype=object)


def with_titles(text: Column, first: Column, second: Column) -> Column:
    """Pointers at the first or second passage replaced by its title, with the genitive that they had; "the" before a pointer goes with it."""
    return F.pandas_udf(_titled, "string")(text, first, second)
