"""Mixing sources to target weights by capped water-filling (DataFrame functions only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.common import WORD, staged

WEIGHTS = (3.0, 1.0, 2.0)
#: A table of so many sources at most is broadcast (a few MB); a longer one is joined by shuffle.
BROADCAST_SOURCES = 20_000


def words_in(text: str = "text") -> Column:
    """Number of words of a text; null counts as none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: int, *columns: str) -> Column:
    """A repeatable number in [0, 1) from a seed and the row's columns."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def water_fill(sizes: DataFrame, total: float, max_epochs: float, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Targets per source: (source, source_size, weight, target).

    sizes has a row per source: source, source_size. Sources take the weights in
    turn, by code point, null last. `total` (a multiple of all sizes) is shared by
    weight; a source that would pass max_epochs times its size stops there and its
    excess goes to the others by weight, until none is above. The clamped sources
    are a prefix of the order by size over weight, so that one running sum over the
    list of sources gives the level at which the rounds of resharing come to rest.
    Only the list of sources (a row each) is ordered, never the rows they hold.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("pos", F.row_number().over(order))
    weight = reduce(
        lambda other, i: F.when((F.col("pos") - 1) % len(weights) == i, F.lit(float(weights[i]))).otherwise(other),
        range(len(weights)), F.lit(None).cast("double"),
    )
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "pos")
    whole = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(total)))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    # at its turn a source is clamped if an equal share by weight of what is left would pass its cap
    ranked = ranked.withColumn("share", (F.col("budget") - F.col("cap_before")) / F.col("weight_left"))
    ranked = ranked.withColumn("clamped", F.col("share") * F.col("weight") >= F.col("cap"))
    level = F.min(F.when(~F.col("clamped"), F.col("share"))).over(whole)
    first_free = F.min(F.when(~F.col("clamped"), F.struct(F.col("cap") / F.col("weight"), "pos", "share"))).over(whole)
    ranked = ranked.withColumn("level", F.coalesce(first_free["share"], level))
    target = F.when(F.col("clamped") | F.col("level").isNull(), F.col("cap")).otherwise(
        F.least(F.col("level") * F.col("weight"), F.col("cap"))
    )
    return ranked.select("source", "source_size", "weight", target.cast("double").alias("target"))


def mix(
    docs: DataFrame, total: float = 1.5, max_epochs: float = 2.0, weights: tuple[float, ...] = WEIGHTS,
    seed: int = 42, text: str = "text", source: str = "source", doc_id: str = "doc_id",
) -> DataFrame:
    """Add mix_size, mix_source_size, mix_target, mix_taken and mix_copies to every row.

    Repetitions of a document are target / source size: its whole part takes all
    words that often; of the rest a seeded rounding takes that share of the words,
    so that a source's sum is within about the root of its row count of the target.
    mix_copies counts whole copies, the fractional one kept or left by a seeded draw,
    for callers that repeat rows. Null texts have size 0 and take nothing; a null
    source is a source of its own; a source without words has target 0. Sizes are
    summed per source (partial sums first) before anything is joined back; the table of
    sources is counted, and broadcast only when short. Columns of the input that begin
    with mix_ are replaced.
    """
    sized = docs.withColumn("mix_size", words_in(text)).withColumn("mix_key", F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")))
    sizes = (
        sized.groupBy(F.col(source).alias("source"), "mix_key").agg(F.sum("mix_size").alias("source_size"))
    )
    filled = water_fill(sizes.select("source", "source_size"), total, max_epochs, weights)
    filled = filled.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("mix_key"),
        F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"),
    )
    filled = staged(filled, "targets")
    if filled.count() <= BROADCAST_SOURCES:
        filled = F.broadcast(filled)
    out = sized.join(filled, "mix_key", "left").drop("mix_key")
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    draw = uniform(seed, doc_id)
    return out.withColumn(
        "mix_taken",
        F.least(F.floor(rate * F.col("mix_size") + draw), F.floor(F.col("mix_size") * F.lit(float(max_epochs)))).cast("long"),
    ).withColumn(
        "mix_copies", (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row as often as mix_copies says, without the mix's own columns."""
    keep = [c for c in mixed.columns if not c.startswith("mix_")]
    copies = F.explode(F.sequence(F.lit(1), F.col("mix_copies")))
    return mixed.where("mix_copies > 0").withColumn("mix_turn", copies).select(keep)
