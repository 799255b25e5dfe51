"""Edges of words in patterns are those of ASCII words."""

from pyspark.sql import functions as F

from inkwell.functions.text import ascii_edges
from inkwell.operators.retrieve import listed_factor
from inkwell.plans.catalog import QUERIES


def test_edges_beside_other_letters(spark):
    df = spark.createDataFrame([("élection",), ("mot tioné",), ("x",)], "t string")
    got = [r[0] for r in df.select(F.regexp_extract("t", ascii_edges(r"\b\w*tion\b"), 0)).collect()]
    assert got == ["lection", "tion", ""]


def test_topics_of_turns_beside_other_letters(spark, tmp_path):
    rows = [(1, 0, "user", "éring"), (1, 1, "user", "der nationé"), (1, 2, "user", "der")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((r.turn, r.topic) for r in QUERIES["topics_of_turns"](spark, str(tmp_path)).collect())
    assert got == [(0, "present"), (1, "motion"), (2, "present")]


def test_marks_of_lists_beside_other_letters(spark):
    df = spark.createDataFrame([("éibid éibid éibid",)], "t string")
    assert df.select(listed_factor(F.col("t"))).first()[0] == 0.2
