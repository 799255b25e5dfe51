"""Writers: versioned builds behind a pointer, and tables folded to their last state."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_version(df: DataFrame, folder: str, version: str) -> None:
    """Write a build beside the others; readers follow the newest pointer, which is added last. No pointer is
    ever taken away, so a reader finds one at any time, and a write that fails leaves the one before."""
    df.write.mode("overwrite").parquet(f"{folder}/version={version}")
    spark = df.sparkSession
    spark.createDataFrame([(time.time_ns(), version)], "at long, version string").coalesce(1).write.mode("append").parquet(f"{folder}/_pointer")


def read_current(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/version={current_version(spark, folder)}")


def current_version(spark: SparkSession, folder: str) -> str:
    return spark.read.parquet(f"{folder}/_pointer").agg(F.max_by("version", "at")).first()[0]


def latest(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The last row of each key: what an upsert leaves."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def newest(rows: DataFrame, n: int, *order) -> DataFrame:
    """A capped list: the first n rows in the given order."""
    return rows.orderBy(*order).limit(n)


def remove_old(spark: SparkSession, folder: str, keep: int = 2, older_than: int = 0) -> list[str]:
    """Remove builds that the last `keep` pointers do not name and that were replaced `older_than` seconds ago, so that a
    reader that took a pointer before has had that long to finish. The builds that are removed are told."""
    pointers = spark.read.parquet(f"{folder}/_pointer")
    named = pointers.groupBy("version").agg(F.max("at").alias("at")).orderBy(F.desc("at")).collect()  # a row a build that is still pointed at
    gone = [r["version"] for k, r in enumerate(named) if k >= keep and time.time_ns() - named[k - 1]["at"] >= older_than * 1_000_000_000]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for version in gone:
        path = hadoop.Path(f"{folder}/version={version}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def write_manifests(blocks: DataFrame, path: str) -> None:
    """Manifests as JSON, one line a document, in folders by category. blocks: doc_id, title, category, ord and the fields of a block.

    A document's blocks meet in its manifest, as its text does in its row."""
    block = F.struct("ord", F.col("block_id").alias("id"), "type", "text", "printed_page", "physical_page", "level")
    per = blocks.groupBy("doc_id", "title", "category").agg(F.array_sort(F.collect_list(block)).alias("_all"))
    listed = F.transform("_all", lambda b: F.struct(b["id"].alias("id"), b["type"].alias("type"), b["text"].alias("text"), b["printed_page"].alias("printed_page"), b["physical_page"].alias("physical_page"), b["level"].alias("level")))
    text = F.array_join(F.transform("_all", lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    whole = per.select(F.lit(1).alias("schema_version"), "doc_id", F.sha2(text.cast("binary"), 256).alias("content_sha256"), "title", "category", listed.alias("blocks"))
    whole.write.partitionBy("category").json(path)


def newest_packs(files: DataFrame, name: str = "path") -> DataFrame:
    """(pack, version, path, sha256) of the newest file of each pack: files: path ("search-v12.zip"), content. Versions are numbers, so 12 comes after 9."""
    parts = F.regexp_extract(name, r"([^/]*?)-v([0-9]+)[.][a-z]+$", 1), F.regexp_extract(name, r"-v([0-9]+)[.][a-z]+$", 1)
    named = files.select(parts[0].alias("pack"), parts[1].try_cast("int").alias("version"), F.col(name).alias("path"), "content").where("version IS NOT NULL")
    best = named.groupBy("pack").agg(F.max(F.struct("version", "path")).alias("b")).select("pack", "b.version", "b.path")
    return named.join(best, ["pack", "version", "path"]).select("pack", "version", "path", F.sha2("content", 256).alias("sha256"))
