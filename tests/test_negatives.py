"""Hard negatives: the scores of items and documents arise in tasks of bounded size."""

import re

from inkwell.plans import curation

SF = "/root/testdata/sf0.001"


def test_scores_are_dealt_by_their_number_and_not_shuffled(spark, monkeypatch):
    want = sorted(tuple(r) for r in curation.hard_negatives(spark, SF).collect())
    monkeypatch.setattr(curation, "SCORES_A_TASK", 1000, raising=False)
    found = curation.hard_negatives(spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(item_id#\d+L?, doc_id#", plan)
    items = max(spark.read.parquet(f"{SF}/benchmark.parquet").count(), curation.LEAST_ITEMS)
    parts = spark.read.parquet(f"{SF}/documents.parquet").count() * items // 1000 + 1
    assert parts > 4 and re.search(rf"Exchange hashpartitioning\(doc_id#\d+L?, {parts}\), REPARTITION_BY_NUM", plan)
    assert sorted(tuple(r) for r in found.collect()) == want
    monkeypatch.setattr(curation, "BROADCAST_WEIGHTS", 0, raising=False)
    assert sorted(tuple(r) for r in curation.hard_negatives(spark, SF).collect()) == want


def test_held_items_are_left_out(spark):
    tf = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (2, "a", 1.0), (3, "b", 1.0)], "doc_id long, token string, tf double")
    weights = spark.createDataFrame([(7, "a", 2.0), (8, "b", 2.0)], "item_id long, token string, df double")
    for held in ([(1, 7), (3, 7), (9, 8)], []):
        rows = curation.negative_scores(tf, weights, spark.createDataFrame(held, "doc_id long, item_id long"), 3).collect()
        want = {(7, 1), (7, 2), (8, 1), (8, 3)} - {(i, d) for d, i in held}
        assert {(r.item_id, r.doc_id) for r in rows} == want and {r.score for r in rows} == {0.5}
