"""The best documents of a query batch, block by block, against all scores at once."""

import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import retrieval
from inkwell.plans.catalog import QUERIES
from inkwell.plans.search import keyword_side

WORDS = [f"w{i}" for i in range(40)]


@pytest.mark.parametrize("common", [None, 12])
def test_best_of_a_batch_over_many_blocks(spark, monkeypatch, common):
    monkeypatch.setattr(retrieval, "BLOCK_POSTINGS", 60)
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 10)
    pick = random.Random(5)
    texts = [" ".join(pick.choices(WORDS, weights=range(1, 41), k=pick.randrange(3, 30))) for _ in range(150)]
    texts[50:90] = [texts[50]] * 40  # copies: ties are cut by key
    texts[3] = None
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = [(q, w) for q in range(0, 150, 4) for w in pick.sample(WORDS + ["none"], 4)] + [(1000, w) for w in WORDS[-3:]] + [(1001, w) for w in WORDS[-3:]]
    queries = spark.createDataFrame(asked, "qid long, token string")
    every = retrieval.batch_bm25(docs, queries, common=common).where("doc_id <> qid").withColumn("score", F.round("score", 6))
    want = {}
    for r in every.collect():
        want.setdefault(r.qid, []).append((-r.score, r.doc_id))
    want = {(q, n + 1): (d, pytest.approx(-s)) for q, rows in want.items() for n, (s, d) in enumerate(sorted(rows)[:7])}
    got = {(r.qid, r["rank"]): (r.doc_id, r.score) for r in retrieval.batch_top(docs, queries, 7, common=common).collect()}
    assert got == want


def test_the_keyword_side_makes_no_row_a_pair(spark, monkeypatch):
    """A join of postings with the queries' words would make a row for each query and document that share a word."""
    monkeypatch.setattr(retrieval, "batch_bm25", None)
    assert keyword_side(spark, "/root/testdata/sf0.001", 3).count() > 0


def test_texts_are_weighed_once_a_chunk(spark):
    """Patterns run below the join of candidates with chunks, so texts do not travel with each question."""
    plan = QUERIES["retrieved_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Tradition") > plan.index("Join Inner, (key")


@pytest.mark.parametrize("few", [5, 200_000])
def test_many_words_give_the_same_as_few(spark, monkeypatch, few):
    """Words beyond FEW_WORDS meet the documents by a join; a word twice in a text, empty texts and a word nobody holds."""
    monkeypatch.setattr(retrieval, "FEW_WORDS", few)
    docs = spark.createDataFrame([(1, "B b a c d e f"), (2, "a g"), (3, ""), (4, None), (5, "g f e")], "doc_id long, text string")
    queries = spark.createDataFrame([(9, w) for w in "abcdefgx"], "qid long, token string")
    index = retrieval.batch_index(docs, queries)
    words = {r.tid: r.token for r in index.words.collect()}
    held = {r.doc_id: (r.len, {words[t]: n for t, n in zip(r.tids, r.tfs, strict=True)}) for r in index.held.collect()}
    assert held == {1: (7, {"a": 1, "b": 2, "c": 1, "d": 1, "e": 1, "f": 1}), 2: (2, {"a": 1, "g": 1}), 3: (1, {}), 4: (1, {}), 5: (3, {"e": 1, "f": 1, "g": 1})}
    want = {(r.qid, r.doc_id): round(r.score, 6) for r in retrieval.batch_bm25(docs, queries).collect()}
    assert {(r.qid, r.doc_id): r.score for r in retrieval.batch_top(docs, queries, 5).collect()} == pytest.approx(want)


def test_rounds_of_blocks_leave_a_few_times_k_rows_a_query(spark, monkeypatch):
    """An eighth of the blocks at once left k rows a query and block: a table as large as the square of the input."""
    monkeypatch.setattr(retrieval, "BLOCK_POSTINGS", 300)
    pick, counted, top = random.Random(3), [], retrieval.top
    docs = spark.createDataFrame([(i, " ".join(pick.choices(WORDS, k=6))) for i in range(2500)], "doc_id long, text string")
    queries = spark.createDataFrame([(q, w) for q in range(10_000, 10_020) for w in pick.sample(WORDS, 4)], "qid long, token string")

    def counting(rows, k, by, *order, rank="rank"):
        counted.append(rows.count())
        return top(rows, k, by, *order, rank=rank)

    monkeypatch.setattr(retrieval, "top", counting)
    assert retrieval.batch_top(docs, queries, 10).count() == 20 * 10
    assert max(counted) <= 6 * 20 * 10


def test_terms_of_a_query_graph_come_from_the_index(spark):
    """The words of all texts were shuffled once more to find the asked ones among them."""
    plan = QUERIES["query_graph"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_frequent_words_of_a_text(spark):
    docs = spark.createDataFrame([(1, "The pear fig PEAR fig kiwi apple it's of"), (2, None), (3, "of the")], "doc_id long, text string")
    assert [tuple(r) for r in retrieval.frequent_words(docs, 3).collect()] == [(1, "fig"), (1, "pear"), (1, "apple")]


def test_candidates_meet_chunks_once_and_are_dealt_by_query_once(spark):
    """Both sides met the chunks by key before they met each other, and again with the base of their scores."""
    df = QUERIES["retrieved_scores"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and plan.count("Join Inner, (key") == 1
