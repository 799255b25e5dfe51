"""Retrieval against a plain loop, and nearest vectors against all pairs."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.operators import retrieve as rv
from inkwell.operators import vectors

WEIGHTS = rv.Weights(categories={"a": 1.4, "b": 0.8}, works=[(["big book"], ["big book - aa"])], priors=[(["big book - aa"], 1.22), (["daily"], 0.88)])
TEXTS = ["plain prose about a matter that goes on for a good many words, so that it is no header at all, as one can see",
         "THE HEADER 12\nfew words", "Abstinence, 4, 12, 19, 30 and more", "see ibid 4, ibid 5, ibid 6 of this long line of notes that has words enough to be a text",
         "Step One: x Step Two: y Step Three. z Tradition One 5 CONTENTS", "1. We admitted 2. Came to believe 3. Made a decision 4. Humbly asked 5. Became willing and so on and on and on"]
SOURCES = ["Big Book - AA.pdf", "Daily Notes", "Other", "More"]


def plain(chunks, sem, kw, questions, k, categories):
    picks = {}
    for qid, question in questions:
        scope = {c["key"]: c for c in chunks if not categories or c["category"] in categories}
        s = {x: v for q, x, v in sem if q == qid and x in scope}
        w = {x: v for q, x, v in kw if q == qid and x in scope}
        named = [p for phrases, parts in WEIGHTS.works for p in parts if any(x in question.lower() for x in phrases)]
        rows = []
        for key in set(s) | set(w):
            c = scope[key]
            score = 0.7 * s.get(key, 0) / max(max(s.values(), default=1), 1e-6) + 0.3 * w.get(key, 0) / max(max(w.values(), default=1), 1e-6)
            score *= rv.SCALES.get(c["scale"], 1) * WEIGHTS.categories.get(c["category"], 1)
            is_named = any(p in c["source"].lower() for p in named)
            prior = next((f for parts, f in WEIGHTS.priors if any(p in c["source"].lower() for p in parts)), 1.0)
            score *= 3.0 if is_named else 1.0 if named else prior
            text = c["text"]
            if len(re.findall(rv.INDEX_RUN, text)) or len(re.findall(rv.INDEX_ENTRY, text)) >= 5 or len(re.findall(rv.ENDNOTE, text)) >= 3:
                score *= 0.2
            elif len(re.findall(rv.ENUMERATION, text)) + 3 * bool(re.search("CONTENTS", text)) >= 5:
                score *= 0.45
            if c["scale"] == "small" and len(re.findall("[A-Za-z0-9]+", re.sub(rv.HEADER, "", text))) < 15:
                score *= 0.35
            rows.append((round(score, 9), key, c, 4 if is_named else 2))
        rows.sort(key=lambda r: (-r[0], r[1]))
        best = rows[0][0] if rows else 0
        seen, used, out = set(), Counter(), []
        queues = {b: [r for r in rows if r[0] >= 0.5 * best and ("large" if r[2]["scale"] == "topic" else r[2]["scale"]) == b] for b in ("small", "medium", "large")}
        free = lambda r: r[2]["context_id"] not in seen and used[r[2]["source"].lower()] < r[3]

        def add(r):
            seen.add(r[2]["context_id"])
            used[r[2]["source"].lower()] += 1
            out.append(r[1])

        moved = True
        while moved and len(out) < k:
            moved = False
            for q in queues.values():
                while q and len(out) < k:
                    r = q.pop(0)
                    if free(r):
                        add(r)
                        moved = True
                        break
        for r in rows:
            if len(out) < k and free(r):
                add(r)
        picks.update({(qid, i + 1): key for i, key in enumerate(out)})
    return picks


@pytest.mark.parametrize("categories", [None, ["a"]])
def test_retrieve_equals_plain_loop(spark, categories):
    r = np.random.default_rng(17)
    chunks = [{"key": i, "text": TEXTS[int(r.integers(0, 6))], "context": None, "scale": str(r.choice(["small", "medium", "large", "topic"])), "category": str(r.choice(["a", "b", "c"])),
               "source": SOURCES[int(r.integers(0, 4))], "context_id": f"c{int(r.integers(0, 40))}"} for i in range(80)]
    questions = [(1, "what does the Big Book say"), (2, "plain"), (3, "")]
    sem = [(q, int(k), float(r.random())) for q in (1, 2) for k in r.choice(80, 30, replace=False)]
    kw = [(q, int(k), float(r.random() * 20)) for q in (1, 2, 3) for k in r.choice(80, 30, replace=False)]
    make = spark.createDataFrame
    got = rv.retrieve(make(chunks, "key long, text string, context string, scale string, category string, source string, context_id string"), make(sem, "qid int, key long, sem double"),
                      make(kw, "qid int, key long, kw double"), make(questions, "qid int, text string"), 8, WEIGHTS, categories)
    assert {(x.qid, x.pick): x.key for x in got.collect()} == plain(chunks, sem, kw, questions, 8, categories)


def test_factors_look_at_the_context(spark):
    rows = spark.createDataFrame([("prose", "Abstinence, 4, 12, 19"), ("prose", None), (None, None)], "t string, c string")
    assert [x.f for x in rows.select(rv.listed_factor(F.col("t"), F.col("c")).alias("f")).collect()] == [0.2, 1.0, 1.0]


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    r = np.random.default_rng(18)
    x = np.round(r.normal(size=(100, 6)), 1)
    x[50:60] = x[40]
    rows = [(i, x[i].tolist()) for i in range(100)] + [(200, None), (201, [0.0] * 6), (202, [float("nan")] * 6), (203, [None] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for row in vectors.nearest_rows(table, table.where("vec_id % 10 = 0"), 5).collect():
        got.setdefault(row.qid, {})[row["rank"]] = (row.vec_id, row.sim)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 9)
    for q in range(0, 100, 10):
        order = sorted((i for i in range(100) if i != q), key=lambda i: (-sims[q, i], i))[:5]
        assert got[q] == {n + 1: (i, pytest.approx(sims[q, i], abs=1e-9)) for n, i in enumerate(order)}
    assert vectors.nearest_rows(table.limit(0), table, 3).count() == 0
