"""Choices that a plain loop makes row after row, made in rounds over whole tables with the loop's very result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.operators.graph import staged


def fact_tokens(text: Column, longest: int = 120) -> Column:
    """A fact's distinct words: the first `longest` characters in small letters, without punctuation."""
    plain = F.regexp_replace(F.lower(F.left(F.trim(text), F.lit(longest))), r"[^\p{L}\p{N}\s]", " ")
    return F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda w: w != ""))


def _prefixed(sets: DataFrame, share: float) -> DataFrame:
    """Sets with the rare words that one of `share` Jaccard with them must share: all but share * size - 1 of them, rarest first."""
    seen = sets.select("owner", F.explode("words").alias("word")).groupBy("owner", "word").agg(F.count("*").alias("n"))
    words = sets.select("owner", "at", F.size("words").alias("size"), F.explode("words").alias("word"))
    ranked = words.join(seen, ["owner", "word"]).withColumn("rank", F.row_number().over(Window.partitionBy("owner", "at").orderBy("n", "word")))
    return ranked.where(F.col("rank") <= F.col("size") - F.ceil(F.lit(share) * F.col("size") - F.lit(1e-9)) + 1).select("owner", "at", "size", "word")


def similar_pairs(sets: DataFrame, share: float) -> DataFrame:
    """(owner, early, late) of sets of an owner with at least `share` Jaccard. sets: owner, at, words (distinct, not empty)."""
    prefix = staged(_prefixed(sets, share), "fact-prefixes")
    early, late = prefix.select("owner", "word", F.col("at").alias("early"), F.col("size").alias("n")), prefix.select("owner", "word", F.col("at").alias("late"), F.col("size").alias("m"))
    fits = (F.col("early") < F.col("late")) & (F.least("n", "m") >= F.lit(share) * F.greatest("n", "m") - F.lit(1e-9))
    pairs = early.join(late, ["owner", "word"]).where(fits).select("owner", "early", "late").distinct()
    both = pairs.join(sets.select("owner", F.col("at").alias("early"), F.col("words").alias("x")), ["owner", "early"]).join(
        sets.select("owner", F.col("at").alias("late"), F.col("words").alias("y")), ["owner", "late"]
    ).withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.where(F.col("common") >= F.lit(share) * (F.size("x") + F.size("y") - F.col("common")) - F.lit(1e-9)).select("owner", "early", "late")


def keep_first(facts: DataFrame, share: float, rounds: int = 200) -> DataFrame:
    """(owner, at) of facts that no kept earlier fact of their owner resembles. facts: owner, at (a place in the order, unique within the owner), words.

    The loop "keep a fact unless it resembles one kept before" is the first independent set of the graph of
    similar facts. A fact is kept once all earlier neighbours are known to be gone, and gone once one is kept; each round
    decides all that can be. Facts of the same words are one, its first; facts without words go.
    """
    sets = facts.where(F.size("words") > 0).groupBy("owner", F.array_sort("words").alias("words")).agg(F.min("at").alias("at"))
    sets = staged(sets, "facts")
    edges = staged(similar_pairs(sets, share), "similar")
    ends = edges.select("owner", F.explode(F.array("early", "late")).alias("at")).distinct()
    kept, open_ = sets.select("owner", "at").join(ends, ["owner", "at"], "left_anti"), edges
    for _ in range(rounds):
        if open_.isEmpty():
            return kept
        late = open_.select("owner", F.col("late").alias("at")).distinct()
        first = staged(open_.select("owner", F.col("early").alias("at")).distinct().join(late, ["owner", "at"], "left_anti"), "first")
        gone = staged(open_.join(first.withColumnRenamed("at", "early"), ["owner", "early"], "left_semi").select("owner", F.col("late").alias("at")).distinct(), "gone")
        kept = kept.unionByName(first)
        # edges of what is decided go; who loses the last earlier neighbour thereby is kept
        left = open_.join(first.withColumnRenamed("at", "early"), ["owner", "early"], "left_anti").join(gone.withColumnRenamed("at", "late"), ["owner", "late"], "left_anti")
        rest = staged(left.join(gone.withColumnRenamed("at", "early"), ["owner", "early"], "left_anti").select("owner", "early", "late"), "similar")
        alone = left.select("owner", F.explode(F.array("early", "late")).alias("at")).distinct().join(gone, ["owner", "at"], "left_anti")
        still = rest.select("owner", F.explode(F.array("early", "late")).alias("at")).distinct()
        kept = staged(kept.unionByName(alone.join(still, ["owner", "at"], "left_anti")), "kept")
        open_ = rest
    raise RuntimeError("facts did not settle")


def quota_edges(edges: DataFrame, quota: int, rounds: int = 200) -> DataFrame:
    """Edges (a, b, weight) that a loop from the heaviest down keeps, if it keeps an edge while either end has fewer than
    `quota` kept ones. Equal weights go by (a, b).

    For every open edge the kept edges before it at an end are bounded: those known to be kept, and these and the open ones. An edge is
    kept once the greater bound of an end is below the quota, and gone once the lesser bounds of both ends reach it.
    The first open edge is decided in each round, and mostly nearly all of them.
    """
    state = staged(edges.select("a", "b", "weight", F.lit(None).cast("boolean").alias("kept")), "quota")
    for _ in range(rounds):
        ends = state.select("*", F.explode(F.array("a", "b")).alias("end"))
        before = Window.partitionBy("end").orderBy(F.desc("weight"), "a", "b").rowsBetween(Window.unboundedPreceding, -1)
        sure = F.coalesce(F.sum(F.coalesce(F.col("kept"), F.lit(False)).cast("int")).over(before), F.lit(0))
        most = F.coalesce(F.sum(F.coalesce(F.col("kept"), F.lit(True)).cast("int")).over(before), F.lit(0))
        bounds = ends.withColumns({"sure": sure, "most": most}).groupBy("a", "b", "weight", "kept").agg(F.min("most").alias("most"), F.min("sure").alias("sure"))
        decided = F.when(F.col("most") < quota, True).when(F.col("sure") >= quota, False)
        state = staged(bounds.select("a", "b", "weight", F.coalesce("kept", decided).alias("kept")), "quota")
        if state.where("kept IS NULL").isEmpty():
            return state.where("kept").select("a", "b", "weight")
    raise RuntimeError("edges did not settle")
