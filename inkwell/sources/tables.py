"""Readers: the given tables and file formats of a document library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, folder: str, patterns: str = "*.{txt,md,epub,pdf,html}") -> DataFrame:
    """Supported files below a folder, hidden ones and side-car folders left out: path, category, modified, size, content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", patterns).load(folder)
    inside = F.substring_index(F.col("path"), folder.rstrip("/") + "/", -1)
    found = found.withColumn("inside", inside).where(~F.col("inside").rlike(r"(^|/)[.@]"))
    category = F.when(F.instr("inside", "/") > 0, F.substring_index("inside", "/", 1)).otherwise(F.lit(""))
    return found.select("path", category.alias("category"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Whole text files: path, text; blank ones are left out."""
    read = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder)
    return read.select(F.input_file_name().alias("path"), F.col("value").alias("text")).where(F.length(F.trim("text")) > 0)


MANIFEST = T.StructType([
    T.StructField("schema_version", T.IntegerType()), T.StructField("doc_id", T.StringType()), T.StructField("source_file", T.StringType()),
    T.StructField("content_sha256", T.StringType()), T.StructField("title", T.StringType()), T.StructField("author", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("blocks", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("text", T.StringType()),
        T.StructField("printed_page", T.StringType()), T.StructField("physical_page", T.IntegerType()), T.StructField("level", T.IntegerType()),
    ]))),
    T.StructField("_corrupt", T.StringType()),
])


def manifests(spark: SparkSession, folder: str, sink: str | None = None, lines: bool = False) -> DataFrame:
    """Manifest files, one a document (or, with `lines`, files of one a line, in folders by category); missing fields are null. A file that is no JSON, or has no doc_id, goes to the sink, if one is given."""
    from inkwell.sources.landing import quarantined, split_good

    read = spark.read.schema(MANIFEST).option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    found = read.json(folder, pathGlobFilter="*.json").withColumn("_file", F.input_file_name())
    reasons = {"no JSON": "_corrupt IS NOT NULL", "no doc_id": "doc_id IS NULL"}
    good = split_good(found, reasons)[0] if sink is None else quarantined(found, reasons, sink)
    return good.drop("_corrupt", "_file")


def manifest_blocks(found: DataFrame) -> DataFrame:
    """A row per block: doc_id, ord, block_id, type, text, printed_page, physical_page, level."""
    return found.select("doc_id", F.posexplode("blocks").alias("ord", "block")).select("doc_id", "ord", F.col("block.id").alias("block_id"), "block.type", "block.text", "block.printed_page", "block.physical_page", "block.level")


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank and broken lines are left out."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(wide).option("columnNameOfCorruptRecord", "_corrupt").json(path).where("_corrupt IS NULL").drop("_corrupt")


def lines_of(docs: DataFrame) -> DataFrame:
    """Blocks of documents: a row per line that is not blank, in order (doc_id, source, lang, ord, text)."""
    split = docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return split.where(F.length(F.trim("text")) > 0)
