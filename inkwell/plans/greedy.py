"""Choices of a loop over the whole tables: facts that are new, edges within a quota. SQL has no such loop; tests compare with it."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import greedy
from inkwell.plans.phrases import mined_edges
from inkwell.plans.registry import query
from inkwell.sources.tables import lines_of, table


@query()
def kept_facts(spark, sf_dir):
    """Lines of a source as facts about it, in order: those that resemble no kept one before (nine words of ten)."""
    lines = lines_of(table(spark, sf_dir, "documents"))
    facts = lines.select(F.coalesce("source", F.lit("")).alias("owner"), F.struct("doc_id", "ord").alias("at"), greedy.fact_tokens(F.col("text")).alias("words"))
    return greedy.keep_first(facts, 0.9).select("owner", "at.doc_id", "at.ord")


@query()
def quota_concept_edges(spark, sf_dir):
    """The map of mined concepts: associations from the strongest down, as long as an end has fewer than six."""
    return greedy.quota_edges(mined_edges(spark, sf_dir).select("a", "b", F.col("npmi").alias("weight")), 6)
