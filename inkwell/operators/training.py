"""Training sets: splits, packed sequences, flaws, prompts, pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BITS = 4  # hex digits of a hash that pick its bucket: 65 536 buckets


def first_by_hash(rows: DataFrame, group: str, hashed: Column, quota: Column, *tie: str) -> DataFrame:
    """Rows with `chosen`: whether a row is among the first of its group in the order of a hex hash, then `tie`.

    quota: how many, as an expression of `size`, the group's number of rows. Buckets of the hash are counted,
    so that only the rows of the one bucket in which the quota ends are ranked, not whole groups.
    """
    keyed = rows.withColumn("_hash", hashed).withColumn("_bucket", F.substring("_hash", 1, BITS))
    counts = keyed.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(group).orderBy("_bucket")  # 16 ** BITS rows a group at most
    run = counts.withColumn("_upto", F.sum("_n").over(w)).withColumn("size", F.sum("_n").over(Window.partitionBy(group)))
    run = run.withColumn("_quota", quota).withColumn("_left", F.col("_quota") - (F.col("_upto") - F.col("_n")))
    ends = run.where("_left > 0 AND _left < _n").select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), "_left")  # a row a group
    last = run.where("_left >= _n").groupBy(F.col(group).alias("_g")).agg(F.max("_bucket").alias("_last"))
    joined = keyed.join(last, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g").join(ends, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")
    border = joined.where("_bucket = _b").withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy("_hash", *tie)))
    whole = joined.where("_b IS NULL OR _bucket <> _b")
    chosen = whole.withColumn("chosen", F.coalesce(F.col("_bucket") <= F.col("_last"), F.lit(False))).select(*rows.columns, "chosen")
    return chosen.unionByName(border.withColumn("chosen", F.col("_rank") <= F.col("_left")).select(*rows.columns, "chosen"))


def packed(rows: DataFrame, key: str, size: str, length: int, shard: int = 10_000) -> DataFrame:
    """(key, shard, pack, start, taken): rows laid one after another into sequences of `length`, in the order of their keys.

    A row that does not fit begins the next sequence; one longer than a sequence is cut to it. Sequences do not
    cross shards of `shard` consecutive keys, each of which is packed as one group. Rows without a size count as empty.
    """

    def lay(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key", kind="stable")
        pack, filled, packs, starts, taken = 0, 0, [], [], []
        for n in part["size"]:
            if filled and filled + n > length:
                pack, filled = pack + 1, 0
            packs.append(pack)
            starts.append(filled)
            taken.append(min(n, length))
            filled += n
        return pd.DataFrame({"key": part["key"], "shard": part["shard"], "pack": packs, "start": starts, "taken": taken})

    sized = rows.select(F.col(key).cast("long").alias("key"), F.floor(F.col(key) / shard).cast("long").alias("shard"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"))
    return sized.groupBy("shard").applyInPandas(lay, "key long, shard long, pack long, start long, taken long").withColumnRenamed("key", key)


def seeded(key: Column, n: Column | int) -> Column:
    """A number below n that keys are dealt evenly to, the same on every run."""
    return F.pmod(F.shiftright(F.pmod(key, F.lit(1 << 30)) * F.lit(2654435761), 7), n)


def compatible(flaws: Column, crisis: Column, passages: Column) -> Column:
    """Flaws that suit a sample: no needless hotline where there is a crisis, no ignored passages where there are none."""
    return F.filter(flaws, lambda f: ~((f == "needless_hotline") & crisis) & ~((f == "ignores_passages") & ~passages))


def prompt(question: Column, passages: Column | None = None) -> Column:
    """A question with its numbered passages ahead, or alone."""
    if passages is None:
        return F.concat(F.lit("Question: "), question)
    listed = F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p))
    return F.concat(F.lit("Passages:\n"), F.array_join(listed, "\n\n"), F.lit("\n\nQuestion: "), question)


def fitting(sections: Column, limit: int) -> Column:
    """The sections, in order of priority, up to the last at which all still fit `limit` characters with line feeds between."""
    none = F.struct(F.lit(-1).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("on"))

    def add(s, x):
        used = s["used"] + 1 + F.length(x)
        on = s["on"] & (used <= limit)
        return F.struct(F.when(on, used).otherwise(s["used"]).alias("used"), (s["n"] + on.cast("int")).alias("n"), on.alias("on"))

    return F.slice(sections, F.lit(1), F.aggregate(sections, none, add, lambda s: s["n"]))


def clean_prompt(text: Column) -> Column:
    """A question or request of 22 to 118 characters with one blank between words and a capital, else null."""
    s = F.trim(F.regexp_replace(text, r"\s+", " "))
    s = F.when(s.rlike(r'^(".*"|\'.*\')$') & (F.length(s) > 1), F.trim(F.substr(s, F.lit(2), F.length(s) - 2))).otherwise(s)
    asks = s.rlike(r"[.?]$") & ~s.rlike(r"(?i)\b(what year did|how many copies|which edition|isbn|copyright)\b")
    return F.when(F.length(s).between(22, 118) & asks, F.concat(F.upper(F.left(s, F.lit(1))), F.substr(s, F.lit(2))))


def pairs_across(rows: DataFrame, key: str, work: str, n: int, seed: str) -> DataFrame:
    """(pair, a, b): up to n pairs of rows of two different works, picked by a seeded hash."""
    h = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"))
    bucket = F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(n))
    dealt = rows.where(F.col(work).isNotNull()).select(bucket.alias("pair"), work, F.struct(h.alias("h"), F.col(key).alias("k")).alias("x"))
    firsts = dealt.groupBy("pair", work).agg(F.min("x").alias("x"))
    w = Window.partitionBy("pair").orderBy("x")  # one row a work
    ranked = firsts.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("x").over(w)).where("r = 1 AND next IS NOT NULL")
    return ranked.select("pair", F.col("x.k").alias("a"), F.col("next.k").alias("b"))
