"""Pairs of words within a row."""

from collections import Counter

from inkwell.plans.graphs import bigrams
from inkwell.plans.phrases import mined_forms

TEXTS = ["a b a b a b", "a b c", "c", "", None, "don't stop don't stop"]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_pairs_and_their_documents_by_one_shuffle(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = bigrams(spark, str(tmp_path), 1)
    assert plan(found)[1].count("Exchange hashpartitioning") == 1
    n, docs = Counter(), Counter()
    for t in TEXTS:
        w = (t or "").split()
        n.update(zip(w, w[1:], strict=False))
        docs.update(set(zip(w, w[1:], strict=False)))
    assert {(r.a, r.b): (r.n, r.docs) for r in found.collect()} == {p: (n[p], docs[p]) for p in n}
    assert bigrams(spark, str(tmp_path), 3).count() == 1


def test_pairs_of_a_text_are_made_distinct_as_strings(spark, tmp_path):
    """array_distinct compares structs each with each, so a long text took the square of its words."""
    spark.createDataFrame([(1, "one two three one two three of it"), (2, "two three")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    forms = mined_forms(spark, str(tmp_path))
    assert "array_distinct(arrays_zip" not in plan(forms)[0]
    assert {r.form for r in forms.collect()} == {"one two", "two three", "three one", "three"}
