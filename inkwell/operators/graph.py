"""Co-occurrence graphs, merging and ranking of nodes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many edges, about, are dealt to one task.
EDGES_A_TASK = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors and the driver see; one of our own where none is set on a single machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write to the folder that all executors share and read back: cuts the lineage of a loop."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cooccurrence(hits: DataFrame, passage: str, node: str, shared: int, floor: float) -> DataFrame:
    """(a, b, shared, npmi) of nodes that share passages. hits: a row per passage and node.

    Nodes of a passage meet once (a < b); the counts are summed before the shuffle. The number of
    passages and each node's count come from the same rows, which are written once and read for each.
    """
    one = staged(hits.select(passage, node).distinct(), "hits")
    total = one.select(passage).distinct().agg(F.count("*").cast("double").alias("n"))
    count = one.groupBy(node).agg(F.count("*").cast("double").alias("c"))
    left, right = one.withColumnRenamed(node, "a"), one.withColumnRenamed(node, "b")
    pairs = left.join(right, passage).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= shared)
    joined = pairs.join(count.select(F.col(node).alias("a"), F.col("c").alias("ca")), "a").join(
        count.select(F.col(node).alias("b"), F.col("c").alias("cb")), "b"
    ).crossJoin(F.broadcast(total))  # one row
    p = F.col("shared") / F.col("n")
    npmi = F.log(p / (F.col("ca") / F.col("n") * (F.col("cb") / F.col("n")))) / -F.log(p)
    return joined.where("shared < n").withColumn("npmi", npmi).where(F.col("npmi") > floor).select("a", "b", "shared", "npmi")


def spread(edges: DataFrame, label: DataFrame, parts: int) -> DataFrame:
    """(a, root): b's root for each edge (a, b). Both sides are dealt by b into `parts` tasks; where edges have a `part`, a node of very
    many is dealt in several parts of its own, of which label (id, root, parts) has the number."""
    key, known = ["b"], label.select(F.col("id").alias("b"), "root", "parts")
    if "part" in edges.columns:
        key, known = ["b", "part"], known.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return edges.repartition(parts, *key).join(known.drop("parts").repartition(parts, *key), key).select("a", "root")


def merged(pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, root): each id of the pairs (a, b) with the smallest id it is connected with; pairs may repeat.

    Labels spread along edges and jump to their own label's label, until none changes. Pairs are counted first, since a
    task's memory follows the edges it is dealt: there are as many tasks as their number asks for.
    """
    parts = 2 * pairs.count() // EDGES_A_TASK + 1
    low, high = F.when(F.col("a") > F.col("b"), F.col("b")).otherwise(F.col("a")), F.when(F.col("a") > F.col("b"), F.col("a")).otherwise(F.col("b"))
    once = pairs.select(low.alias("a"), high.alias("b")).repartition(parts, "a", "b").distinct()
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = staged(once.select(F.inline(ways)), "merge-edges")
    first = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"), F.ceil(F.count("*") / EDGES_A_TASK).cast("int").alias("parts"))
    label = staged(first.select("id", F.least("id", "m").alias("root"), "parts"), "merge")
    hubs = label.where("parts > 1").select(F.col("id").alias("b"), "parts")  # at most one for EDGES_A_TASK edges
    if not hubs.isEmpty():
        part = F.coalesce(F.expr("CAST(pmod(xxhash64(a), parts) AS INT)"), F.lit(0))
        edges = edges.join(F.broadcast(hubs), "b", "left").select("a", "b", part.alias("part"))
    for _ in range(rounds):
        seen = spread(edges, label, parts).groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        step = label.join(seen, "id", "left").select("id", F.least("root", F.coalesce("near", "root")).alias("next"), "root", "parts")
        jump = step.select(F.col("id").alias("next"), F.col("next").alias("far"))
        new = step.join(jump, "next", "left").select("id", F.least("next", F.coalesce("far", "next")).alias("to"), "root", "parts")
        new = staged(new, "merge")
        done = new.where("`to` <> root").isEmpty()
        label = new.select("id", F.col("to").alias("root"), "parts")
        if done:
            return label.select("id", "root")
    raise RuntimeError("labels did not settle")


def page_rank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, rank), highest 1. edges: a, b, weight, taken in both directions."""
    both = edges.select("a", "b", "weight").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    out = both.groupBy("a").agg(F.sum("weight").alias("total"))
    share = staged(both.join(out, "a").select("a", "b", (F.col("weight") / F.col("total")).alias("share")), "rank-edges")
    nodes = staged(share.select(F.col("a").alias("node")).distinct(), "rank-nodes")
    n = nodes.count()
    rank = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for k in range(rounds):
        got = share.join(rank.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("in"))
        rank = nodes.join(got, "node", "left").select("node", (F.lit((1 - damping) / n) + F.lit(damping) * F.coalesce("in", F.lit(0.0))).alias("rank"))
        if k % 5 == 4:
            rank = staged(rank, "rank")
    top = rank.agg(F.max("rank").alias("top"))
    return rank.crossJoin(F.broadcast(top)).select("node", (F.col("rank") / F.col("top")).alias("rank"))
