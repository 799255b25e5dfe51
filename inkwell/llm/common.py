"""Helpers that several operators share: shared storage, columns, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than blank, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver see. Where none is set, one of our own on a single
    machine; on a cluster that is an error, since executors would not see each other's files."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: str = "text") -> Column:
    """A text as UTF-8 bytes, empty where it is null."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"").cast("binary"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node that has an edge, as (id, component).

    edges: two long columns a, b, in any direction, repeats allowed. Every round
    each node hands its whole neighbourhood to the smallest neighbour (first for
    larger, then for smaller neighbours), so that paths shrink by half or better;
    the edge list never grows beyond its first length. Each round is staged, and
    the loop ends when the edges form stars.
    """
    norm = edges.select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).where("u <> v").distinct()
    state = staged(norm, "cc")
    before = None
    for _ in range(max_rounds):
        both = state.select("u", "v").union(state.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        # larger neighbours of u move to u's smallest neighbour
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # then smaller neighbours, and u itself
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("x"), "m", "u")
        nxt = small.select(F.col("x").alias("u"), F.col("m").alias("v")).union(
            small.select("u", F.col("m").alias("v"))
        )
        state = staged(nxt.where("u <> v").distinct(), "cc")
        sums = state.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")
        ).first()
        if tuple(sums) == before and sums[0] == sums[2]:
            break
        before = tuple(sums)
    else:
        raise RuntimeError("components did not settle")
    return state.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        state.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
