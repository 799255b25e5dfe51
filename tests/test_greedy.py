"""Choices in rounds equal the plain loops."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from inkwell.operators import greedy


def words_of(text):
    return set(re.sub(r"[^\w\s]", " ", (text or "").strip()[:120].lower()).split())


def plain_facts(rows, share):
    kept = []
    for owner, at, text in sorted(rows, key=lambda r: r[1]):
        mine = words_of(text)
        if mine and not any(o == owner and len(mine & w) >= share * len(mine | w) for o, _, w in kept):
            kept.append((owner, at, mine))
    return {(o, a) for o, a, _ in kept}


def test_facts_equal_plain_loop(spark):
    r = np.random.default_rng(11)
    vocabulary = [f"w{k}" for k in range(14)]
    for share in (0.5, 0.8):
        rows = [(f"o{i % 3}", i, " ".join(r.choice(vocabulary, int(r.integers(1, 9))))) for i in range(150)]
        rows += [("o1", 200, None), ("o1", 201, " .,! "), ("o2", 202, "W1, w2; W3"), ("o2", 203, "w3 w2 w1"), ("o4", 204, "x " * 200 + "lost beyond the limit")]
        facts = spark.createDataFrame(rows, "owner string, at long, text string").select("owner", "at", greedy.fact_tokens(F.col("text")).alias("words"))
        got = {(x.owner, x["at"]) for x in greedy.keep_first(facts.where("words IS NOT NULL"), share).collect()}
        assert got == plain_facts(rows, share)


def test_chains_and_no_facts(spark):
    # each resembles the one before alone: the loop keeps every other one
    rows = [("o", i, [f"w{i + k}" for k in range(4)]) for i in range(30)]
    facts = spark.createDataFrame(rows, "owner string, at long, words array<string>")
    assert sorted(x["at"] for x in greedy.keep_first(facts, 0.6).collect()) == list(range(0, 30, 2))
    assert greedy.keep_first(facts.limit(0), 0.6).count() == 0


def plain_edges(edges, quota):
    count, kept = Counter(), set()
    for a, b, w in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if count[a] < quota or count[b] < quota:
            kept.add((a, b, w))
            count[a] += 1
            count[b] += 1
    return kept


def test_edge_quota_equals_plain_loop(spark):
    r = np.random.default_rng(12)
    for quota, n in ((1, 12), (2, 25), (3, 60)):
        edges = {(int(a), int(b)) for a, b in r.integers(0, n, (n * 6, 2)) if a < b}
        rows = [(a, b, float(r.integers(0, 9))) for a, b in sorted(edges)] + [(0, 1000 + k, 5.0) for k in range(20)]
        got = greedy.quota_edges(spark.createDataFrame(rows, "a long, b long, weight double"), quota)
        assert {tuple(x) for x in got.collect()} == plain_edges(rows, quota)
    assert greedy.quota_edges(spark.createDataFrame([], "a long, b long, weight double"), 2).count() == 0
