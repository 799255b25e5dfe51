"""Seeded picks that a rerun repeats: places within strata, weighted picks with quotas, samples of right and wrong passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.operators.training import BITS, first_by_hash


def seeded_hash(seed: str, *parts: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]).cast("binary"))


def drawn(hashed: Column) -> Column:
    """A number between 0 and 1, neither included, from the first eight digits of a hash."""
    return (F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def numbered(rows: DataFrame, stratum: str, hashed: Column, tie: str) -> DataFrame:
    """Rows with `at`, their place from 0 in their stratum in the order of a hash, and `of`, its size.

    Rows of each bucket of the hash are counted; a row's place is what the buckets before hold and its rank in its own, so no
    stratum is sorted in one task."""
    keyed = rows.withColumn("_hash", hashed).withColumn("_bucket", F.substring("_hash", 1, BITS))
    counts = keyed.groupBy(stratum, "_bucket").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(stratum)
    counts = counts.withColumn("_before", F.sum("_n").over(w.orderBy("_bucket")) - F.col("_n")).withColumn("of", F.sum("_n").over(w))
    counts = counts.select(F.col(stratum).alias("_s"), F.col("_bucket").alias("_b"), "_before", "of")
    placed = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy(stratum, "_bucket").orderBy("_hash", tie)))
    found = placed.join(counts, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return found.select(*rows.columns, (F.col("_before") + F.col("_rank") - 1).alias("at"), "of")


def weighted_picks(candidates: DataFrame, recent: DataFrame, k: int, each: int = 1, seed: str = "picks") -> DataFrame:
    """(owner, item, stratum, pick): up to k items an owner, drawn without replacement by weight, at most `each` of a stratum first.

    candidates: owner, item, stratum, weight (above 0); recent: owner, item, which are left out. An item's key is -ln(u) / weight with u
    from a seeded hash, and least keys are drawn, so every item comes first with the chance of its weight. Where strata are too few
    to give k, the next of each follow. Candidates are an owner's own list; owners are dealt over tasks.
    """
    open_ = candidates.where("weight > 0").join(recent.select("owner", "item"), ["owner", "item"], "left_anti")
    keyed = open_.withColumn("key", -F.log(drawn(seeded_hash(seed, "owner", "item"))) / F.col("weight"))
    turn = F.ceil(F.row_number().over(Window.partitionBy("owner", "stratum").orderBy("key", "item")) / each)
    ranked = keyed.withColumn("turn", turn).withColumn("pick", F.row_number().over(Window.partitionBy("owner").orderBy("turn", "key", "item")))
    return ranked.where(F.col("pick") <= k).select("owner", "item", "stratum", "pick")


def kinds(seeds: DataFrame, shares: dict[str, float], rest: str, seed: str = "kinds") -> DataFrame:
    """Seeds (id, ...) with `kind`: each share of all, rounded down, to a row, by the order of a seeded hash; the others are `rest`."""
    left, out = seeds.withColumn("_all", F.lit(0)), None
    total = seeds.count()
    for name, share in shares.items():
        chosen = first_by_hash(left, "_all", seeded_hash(f"{seed}-{name}", "id"), F.lit(int(total * share + 1e-9)), "id")
        part = chosen.where("chosen").drop("chosen").withColumn("kind", F.lit(name))
        out = part if out is None else out.unionByName(part)
        left = chosen.where("NOT chosen").drop("chosen")
    named = left.withColumn("kind", F.lit(rest))
    return (named if out is None else out.unionByName(named)).drop("_all")


def assembled(samples: DataFrame, passages: DataFrame, size: int = 4, most_gold: int = 2, seed: str = "samples") -> DataFrame:
    """(id, passage, stratum, gold, at): the passages of each sample, one or two right ones and wrong ones up to `size`, each of another
    stratum, in a seeded order.

    samples: id; passages: passage, stratum, gold. Strata are numbered and so are each one's right and wrong passages; a sample begins at a
    stratum by its hash, takes the next ones in turn, and in each the passage at a place by its hash. So picks meet passages by
    an equi-join on places, however large a stratum is. A stratum that has none of the kind asked for gives no passage.
    """
    groups = passages.groupBy("stratum", "gold").agg(F.count("*").alias("n"))
    strata = groups.select("stratum").distinct()
    total = strata.count()
    strata = strata.withColumn("s", F.row_number().over(Window.orderBy("stratum")) - 1)  # a row a stratum
    places = numbered(passages.withColumn("both", F.struct("stratum", "gold")), "both", seeded_hash(seed, "passage"), "passage")
    h = seeded_hash(seed, "id")
    number = lambda a: F.conv(F.substring(h, a, 7), 16, 10).cast("long")
    picks = samples.select("id", (1 + number(1) % most_gold).alias("right"), number(8).alias("start")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(min(size, max(total, 1)) - 1))))
    picks = picks.select("id", (F.col("j") < F.col("right")).alias("gold"), "j", ((F.col("start") + F.col("j")) % max(total, 1)).alias("s")).join(strata, "s")
    picks = picks.join(groups, ["stratum", "gold"]).withColumn("at", F.conv(F.substring(seeded_hash(seed, "id", "j"), 1, 7), 16, 10).cast("long") % F.col("n"))
    found = picks.join(places.select("stratum", "gold", "at", "passage"), ["stratum", "gold", "at"]).withColumn("h", seeded_hash(seed + "-order", "id", "passage"))
    order = F.row_number().over(Window.partitionBy("id").orderBy("h", "passage")) - 1
    return found.select("id", "passage", "stratum", "gold", order.alias("at"))
