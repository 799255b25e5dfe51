"""Phrases, names and sayings against plain counts."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from inkwell.operators import mining
from inkwell.operators.matching import tokens

STOP = ["of", "the", "a", "and"]


def plain_phrases(texts, least, alone, strength):
    grams, books, single = Counter(), defaultdict(set), Counter()
    for book, text in texts:
        w = re.findall(r"[a-z0-9]+(?:'[a-z]+)?", (text or "").lower())
        single.update(w)
        for n in (2, 3, 4):
            for i in range(len(w) - n + 1):
                g = tuple(w[i : i + n])
                if g[0] not in STOP and g[-1] not in STOP and sum(x in STOP for x in g) <= n - 2:
                    grams[g] += 1
                    books[g].add(book)
    total, found = sum(single.values()), {}
    for g, c in grams.items():
        if c >= least and (len(books[g]) >= 2 or c >= alone):
            expected = total * math.prod(single[x] / total for x in g)
            if math.log(c / max(expected, 1e-9)) >= strength:
                found[g] = (c, len(books[g]))
    for n in (4, 3):
        for long in [g for g in found if len(g) == n]:
            for size in range(2, n):
                for i in range(n - size + 1):
                    part = long[i : i + size]
                    if part in found and found[long][0] >= 0.8 * found[part][0]:
                        del found[part]
    return {" ".join(g): v for g, v in found.items()}


def test_phrases_equal_plain_counts(spark, monkeypatch):
    r = np.random.default_rng(9)
    words = [f"w{k}" for k in range(60)] + STOP
    set_phrases = ["state of mind", "big blue book", "one day at last", "w1 w2"]
    texts = [(f"b{i % 4}", " ".join(str(r.choice(set_phrases)) if r.random() < 0.15 else str(r.choice(words)) for _ in range(60))) for i in range(120)] + [(None, None), ("b1", "")]
    rows = spark.createDataFrame(texts, "book string, text string").select("book", tokens(F.col("text")).alias("w"))
    want = plain_phrases(texts, 5, 9, 2.0)
    assert "state of mind" in want and "big blue book" in want and "blue book" not in want
    for limit in (1_000_000, 0):
        monkeypatch.setattr(mining, "BROADCAST_GRAMS", limit)
        got = {x.phrase: (x["count"], x.books) for x in mining.phrases(rows, "book", STOP, 5, alone=9, strength=2.0).collect()}
        assert got == want


def test_names_and_sayings(spark):
    texts = [("a", "So we met Bill Wilson and Dr. Bob Smith in the House of Peace. Later Bill Wilson left; it was John D. who came."), ("b", "then Bill Wilson said “Easy does it.” and “Live and let live!” but “No” or “it is small”"),
             ("c", 'we said "Easy does it" to The Man and to Bill Wilson\'s wife'), ("d", None)]
    rows = spark.createDataFrame(texts, "book string, text string")
    want, books = Counter(), defaultdict(set)
    for book, text in texts:
        for m in re.finditer(mining.NAME, text or ""):
            want[m.group(1).strip()] += 1
            books[m.group(1).strip()].add(book)
    got = {r.name: (r["count"], r.books) for r in mining.proper_names(rows, "book", STOP, least=1, alone=1).collect()}
    assert got == {n: (c, len(books[n])) for n, c in want.items() if len(n) >= 4 and n.split()[0].lower() not in STOP}
    assert got["Bill Wilson"][0] >= 2 and "House of Peace" in got
    assert [(r.saying, r["count"], r.books) for r in mining.sayings(rows, "book", least=1).collect()] == [("easy does it", 2, 2)]


def test_grams_of_numbered_words_equal_counts(spark, monkeypatch):
    """Windows of words in several slices and groups give the counts of all grams, and so do strings where words are too many."""
    monkeypatch.setattr(mining, "HELD_WORDS", 50)
    monkeypatch.setattr(mining, "GROUP_WINDOWS", 200)
    r = np.random.default_rng(3)
    texts = [(f"b{i % 3}" if i % 7 else None, " ".join(r.choice(["of", "x", "y", "z", "u", "v"] + [f"rare{i}"], int(r.integers(0, 40))))) for i in range(90)] + [("b9", None), ("b9", "")]
    want, books = Counter(), defaultdict(set)
    for book, text in texts:
        w = (text or "").split()
        for n in (2, 3, 4):
            for i in range(len(w) - n + 1):
                if w[i] != "of" and w[i + n - 1] != "of":
                    want[tuple(w[i : i + n])] += 1
                    books[tuple(w[i : i + n])].add(book)
    rows = spark.createDataFrame(texts, "book string, text string")
    words = mining.word_counts(rows, "text", str.split)
    for longest in (2, 3, 4):
        grams = mining.counted_grams(rows, "text", str.split, words, 4, longest, "book", ("of",))
        assert {tuple(x.parts): (x.words, x["count"], x.books) for x in grams.collect()} == {g: (len(g), n, len(books[g])) for g, n in want.items() if n >= 4 and len(g) <= longest}
    monkeypatch.setattr(mining, "NUMBERED_WORDS", 3)
    assert mining.counted_grams(rows, "text", str.split, words, 4, 4, "book", ("of",)) is None
    by_string = mining.string_grams(rows.select("book", F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != "").alias("w")), "book", ["of"], 4, 4)
    assert {tuple(x.parts): (x["count"], x.books) for x in by_string.collect()} == {g: (n, len(books[g])) for g, n in want.items() if n >= 4}
