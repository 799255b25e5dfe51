"""Candidates for concepts out of passages: phrases of two to four words, proper names, sayings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators.graph import staged
from inkwell.operators.matching import tokens

#: Frequent grams are broadcast to prune the next longer ones up to so many; beyond, the longer ones are counted unpruned.
BROADCAST_GRAMS = 1_000_000
#: Words found often enough are numbered and broadcast up to so many; beyond, grams are counted as strings.
NUMBERED_WORDS = 1 << 21
#: Windows of words that a task numbers at a time, and those of a group that are counted together, about.
HELD_WORDS, GROUP_WINDOWS = 1 << 20, 1 << 20

# A name is capitalised words, some joined by a small one, not at the start of a sentence; a saying is a quoted sentence.
NAME = r"(?<![.!?:;“\"]\s)(?<!^)\b((?:(?:Dr|St|Mr|Mrs)\.\s)?[A-Z][a-z’']+(?:\s(?:of|the|and|de|von)\s[A-Z][a-z’']+|\s[A-Z][a-z’']+|\s[A-Z]\.){0,3})"
SAYING = r"[“\"]([A-Z][^”\"]{6,60}?)[.!,]?[”\"]"


def _columns(n: int) -> list[str]:
    return [f"t{k}" for k in range(1, n + 1)]


def gram_rows(passages: DataFrame, n: int, book: str, words: str = "w") -> DataFrame:
    """(book, t1..tn): every run of n words of a passage."""
    shifted = [F.slice(words, F.lit(k), F.greatest(F.size(words) - (n - 1), F.lit(0))).alias(f"t{k}") for k in range(1, n + 1)]
    return passages.select(book, F.explode(F.arrays_zip(*shifted)).alias("g")).select(book, "g.*")


def counted(rows: DataFrame, by: list[str], book: str, least: int) -> DataFrame:
    """Counts and books of grams: counted within a book first, so that a gram's rows are few when they meet."""
    per = rows.groupBy(*by, book).agg(F.count("*").alias("n"))
    return per.groupBy(*by).agg(F.sum("n").alias("count"), F.count("*").alias("books")).where(F.col("count") >= least)


def frequent(passages: DataFrame, book: str, least: int, longest: int = 4) -> dict[int, DataFrame]:
    """Grams of two to `longest` words found `least` times, level by level: a longer one is counted only where both its
    parts of one word less are frequent, as it can be no more frequent than they are. passages: book, w (words)."""
    levels: dict[int, DataFrame] = {}
    for n in range(2, longest + 1):
        rows = gram_rows(passages, n, book)
        if n > 2 and levels[n - 1].count() <= BROADCAST_GRAMS:
            known = levels[n - 1].select(_columns(n - 1))
            for shift in (0, 1):
                part = known.select(*[F.col(f"t{k}").alias(f"t{k + shift}") for k in range(1, n)])
                rows = rows.join(F.broadcast(part), part.columns, "left_semi").select(book, *_columns(n))
        levels[n] = staged(counted(rows, _columns(n), book, least), f"grams-{n}")
    return levels


def _slices(batches: Iterator[pa.RecordBatch], split: Callable[[str], list[str]] | None, most: int) -> Iterator[tuple[list[str], list[int], list]]:
    """Words of texts (lists of words, if there is no `split`), an empty one after each text; how many; and its book: about `most` words at a time."""
    words, sizes, books = [], [], []
    for batch in batches:
        for book, text in zip(batch.column(0), batch.column(1), strict=True):
            found = [] if not text.is_valid else split(text.as_py()) if split else text.as_py()
            words += found
            words.append("")
            sizes.append(len(found) + 1)
            books.append(book.as_py())
            if len(words) >= most:
                yield words, sizes, books
                words, sizes, books = [], [], []
    if words:
        yield words, sizes, books


def word_counts(texts: DataFrame, text: str, split: Callable[[str], list[str]] | None) -> DataFrame:
    """(word, n): counted within a task's texts before they meet."""

    def run(batches):
        for words, _, _ in _slices(batches, split, HELD_WORDS):
            values, n = pa.array(words, pa.string()).value_counts().flatten()
            found = pa.RecordBatch.from_arrays([values, n], names=["word", "n"])
            yield found.filter(pc.not_equal(found.column(0), ""))

    rows = texts.select(F.lit("").alias("book"), text).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _runs(first: np.ndarray, rest: np.ndarray, book: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted windows, where runs of one gram of n words begin that has `least` of them; their counts and books."""
    valid = np.ones(len(first), bool) if n == 2 else (rest >> 32 > 0) if n == 3 else (rest & 0xFFFFFFFF > 0)
    at = np.flatnonzero(valid)
    key = (rest[at] >> 32) if n == 3 else rest[at]
    new = np.ones(len(at), bool)
    new[1:] = first[at[1:]] != first[at[:-1]]
    if n > 2:
        new[1:] |= key[1:] != key[:-1]
    begins = np.flatnonzero(new)
    count = np.diff(np.append(begins, len(at)))
    often = count >= least
    number = np.cumsum(often) - 1
    inside = np.repeat(often, count)
    pairs = np.unique(np.repeat(number, count)[inside] * (book.max(initial=0) + 1) + book[at][inside])
    books = np.bincount(pairs // (book.max(initial=0) + 1), minlength=int(often.sum()))
    return at[begins[often]], count[often], books


def counted_grams(texts: DataFrame, text: str, split: Callable[[str], list[str]] | None, words: DataFrame, least: int, longest: int, book: str | None = None, stop: tuple[str, ...] = ()) -> DataFrame | None:
    """(parts, words, count, books): runs of two to `longest` words (four at most) of a text that occur `least` times, those that begin or end
    with a stop word left out. words: `word_counts` of the texts. None if too many words are frequent to be numbered.

    A word of a gram is at least as frequent as the gram, so rarer ones part the texts. Each window of `longest` words
    is shuffled once, as numbers, to the group of its first two words; all its grams are counted there.
    """
    often = words.where(F.col("n") >= least)
    known = often.orderBy(F.desc("n"), "word").limit(NUMBERED_WORDS + 1).select("word").toArrow().column(0).combine_chunks().cast(pa.string())
    if len(known) > NUMBERED_WORDS:
        return None
    total = often.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-total // GROUP_WINDOWS))
    stopped = np.append(np.isin(np.array(known.to_pylist(), object), list(stop)), False)  # the last place is that of rare words
    shared = texts.sparkSession.sparkContext.broadcast((known, stopped))

    def windows(batches):
        known, stopped = shared.value
        for found, sizes, names in _slices(batches, split, HELD_WORDS):
            ids = pc.fill_null(pc.index_in(pa.array(found, pa.string()), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = np.append(ids, [-1] * 3)
            w = [ids[k : len(ids) - 3 + k].copy() for k in range(longest)] + [np.full(len(ids) - 3, -1)] * (4 - longest)
            for k in range(1, 4):
                w[k] = np.where(w[k - 1] < 0, -1, w[k])
            for k in range(3, 0, -1):  # a stop word at the end of a window is the end of no gram
                ends = w[k + 1] < 0 if k < 3 else True
                w[k] = np.where(stopped[w[k]] & ends, -1, w[k])
            place = {b: i for i, b in enumerate(dict.fromkeys(names))}
            books = np.repeat([place[b] for b in names], sizes)
            keep = (w[0] >= 0) & (w[1] >= 0) & ~stopped[w[0]]
            first, rest, books = (w[0] << 32 | w[1])[keep], ((w[2] + 1) << 32 | (w[3] + 1))[keep], books[keep]
            group = ((first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % groups
            order = np.lexsort((rest, first, group))
            edges = np.flatnonzero(np.diff(group[order], prepend=-1))
            offsets = pa.array(np.append(edges, len(order)), pa.int32())
            columns = [first >> 32, first & 0xFFFFFFFF, rest >> 32, rest & 0xFFFFFFFF][:longest] + [books]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(c[order], pa.int32())) for c in columns]
            several = pa.array([list(place)] * len(edges), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(group[order][edges], pa.int64()), several, *lists], names=["g", "names", *_columns(longest), "book"])

    def count(table: pa.Table) -> pa.Table:
        known, stopped = shared.value
        flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        all_books: dict = {}
        named = [np.array([all_books.setdefault(b, len(all_books)) for b in names], np.int64) for names in table.column("names").to_pylist()]
        sizes = pc.list_value_length(table.column("book")).to_numpy()
        starts = np.repeat(np.cumsum([0, *map(len, named)])[:-1], sizes)
        book = np.concatenate(named)[starts + flat("book")]
        w = [flat(c) for c in _columns(longest)]
        first = w[0] << 32 | w[1]
        rest = (w[2] << 32 if longest > 2 else np.zeros(len(first), np.int64)) | (w[3] if longest > 3 else 0)
        order = np.lexsort((rest, first))
        first, rest, book = first[order], rest[order], book[order]
        out = []
        for n in range(2, longest + 1):
            at, times, books = _runs(first, rest, book, n, least)
            ids = np.stack([first[at] >> 32, first[at] & 0xFFFFFFFF, (rest[at] >> 32) - 1, (rest[at] & 0xFFFFFFFF) - 1], 1)[:, :n]
            good = ~stopped[ids[:, -1]]
            parts = pa.ListArray.from_arrays(pa.array(np.arange(0, n * int(good.sum()) + 1, n), pa.int32()), known.take(pa.array(ids[good].ravel())))
            out.append(pa.table([parts, pa.array(np.full(int(good.sum()), n), pa.int32()), pa.array(times[good]), pa.array(books[good])], names=["parts", "words", "count", "books"]))
        return pa.concat_tables(out)

    lists = ", ".join(f"{c} array<int>" for c in [*_columns(longest), "book"])
    rows = texts.select((F.col(book) if book else F.lit("")).alias("book"), text).mapInArrow(windows, f"g long, names array<string>, {lists}")
    # as many partitions as groups would be many small tasks: Spark deals the groups to its own
    return rows.groupBy("g").applyInArrow(count, "parts array<string>, words int, count long, books long")


def string_grams(passages: DataFrame, book: str, stop: list[str], least: int, longest: int) -> DataFrame:
    """The rows of `counted_grams` for any number of words."""
    stopped = F.array(*[F.lit(w) for w in stop]).cast("array<string>")
    either = None
    for n, grams in frequent(passages, book, least, longest).items():
        good = ~F.array_contains(stopped, F.col("t1")) & ~F.array_contains(stopped, F.col(f"t{n}"))
        level = grams.where(good).select(F.array(*_columns(n)).alias("parts"), F.lit(n).alias("words"), "count", "books")
        either = level if either is None else either.unionByName(level)
    return either


def phrases(passages: DataFrame, book: str, stop: list[str], least: int = 8, longest: int = 4, alone: int = 20, strength: float = 3.0, w: str = "w", split: Callable[[str], list[str]] | None = None) -> DataFrame:
    """(phrase, words, count, books, pmi): frequent phrases that neither begin nor end with a stop word and hold two other words at
    least, found in two books (or `alone` times in one), and far more often than their words would meet by chance.

    passages: book, w (words, or a text that `split` makes words of, as `tokens` would). A phrase that is part of a longer one
    about as frequent is left out; longer ones are settled first.
    """
    words = staged(word_counts(passages, w, split), "mined-words")
    total = words.agg(F.sum("n").cast("double").alias("total"))
    grams = counted_grams(passages, w, split, words, least, longest, book, tuple(stop))
    if grams is None:
        grams = string_grams(staged(passage_words(passages, book, w) if split else passages.select(book, F.col(w).alias("w")), "mined-passages"), book, stop, least, longest)
    either = staged(grams.where((F.col("books") >= 2) | (F.col("count") >= alone)).select(F.array_join("parts", " ").alias("phrase"), "parts", "words", "count", "books"), "grams")
    words = words.withColumn("n", F.col("n").cast("double"))
    # the chance of each phrase: the sum of its words' log shares
    each = either.select("phrase", F.explode("parts").alias("word")).join(words, "word").crossJoin(F.broadcast(total))  # one row
    chance = each.groupBy("phrase").agg(F.sum(F.log(F.col("n") / F.col("total"))).alias("log_share"), F.first("total").alias("total"))
    pmi = F.log("count") - F.greatest(F.log("total") + F.col("log_share"), F.log(F.lit(1e-9)))
    found = either.join(chance, "phrase").withColumn("pmi", pmi).where(F.col("pmi") >= strength).select("phrase", "parts", "words", "count", "books", "pmi")
    return without_fragments(staged(found, "phrases"), longest)


def without_fragments(found: DataFrame, longest: int) -> DataFrame:
    """Phrases that no longer phrase, itself kept, holds nearly as often (0.8 of their count)."""
    kept = found
    for n in range(longest, 2, -1):
        long = kept.where(F.col("words") == n)
        spans = [F.slice("parts", F.lit(at), F.lit(size)) for size in range(2, n) for at in range(1, n - size + 2)]
        held = long.select("count", F.explode(F.array(*spans)).alias("s")).groupBy(F.array_join("s", " ").alias("phrase")).agg(F.max("count").alias("longer"))
        kept = staged(kept.join(held, "phrase", "left").where(F.col("longer").isNull() | (F.col("longer") < 0.8 * F.col("count"))).drop("longer"), "phrases")
    return kept.select("phrase", "words", "count", "books", "pmi")


def _listed(texts: DataFrame, found: Column, book: str, least: int, alone: int) -> DataFrame:
    rows = texts.select(book, F.explode(found).alias("said"))
    both = (F.col("books") >= 2) | (F.col("count") >= alone)
    return counted(rows, ["said"], book, least).where(both)


def proper_names(texts: DataFrame, book: str, stop: list[str], text: str = "text", least: int = 6, alone: int = 15) -> DataFrame:
    """(name, count, books): runs of capitalised words within sentences; those that begin with a stop word are left out."""
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(NAME), F.lit(1)), lambda x: F.trim(x)), lambda x: F.length(x) >= 4)
    named = _listed(texts, found, book, least, alone)
    return named.where(~F.lower(F.split("said", " ")[0]).isin(stop)).select(F.col("said").alias("name"), "count", "books")


def sayings(texts: DataFrame, book: str, text: str = "text", least: int = 4) -> DataFrame:
    """(saying, count, books): quoted sentences of two to eight words that two books hold at least, in small letters."""
    whole = F.transform(F.regexp_extract_all(text, F.lit(SAYING), F.lit(1)), lambda x: F.trim(x))
    sized = F.filter(whole, lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")).between(2, 8))
    bare = F.transform(sized, lambda x: F.regexp_replace(F.lower(x), "[.!,]+$", ""))
    return _listed(texts, bare, book, least, 1 << 60).where("books >= 2").select(F.col("said").alias("saying"), "count", "books")


def passage_words(texts: DataFrame, book: str, text: str = "text") -> DataFrame:
    return texts.select(book, tokens(F.col(text)).alias("w"))
