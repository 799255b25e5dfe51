"""The corpus pipeline: quality rules, near-dedup, passage dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of
documents. Every stage works on all rows that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.chosen_path import near_duplicates
from inkwell.llm.common import staged
from inkwell.llm.line_rules import passed
from inkwell.llm.mixing import mix, repeated
from inkwell.llm.piece_index import encode
from inkwell.llm.suffix_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that failed. Empty and null texts fail."""
    return _with_length(passed(docs.select(COLUMNS)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the document of the smallest id. Rows that repeat
    an id are documents of their own; all but one of them count as later than all other ids. Rows
    without an id all stay."""
    rows = docs.select(COLUMNS).withColumn("row", F.col("doc_id").cast("long"))
    twice = rows.where("row IS NOT NULL").groupBy("row").count().where("count > 1").select("row")
    if not twice.isEmpty():
        again = staged(rows.join(twice, "row", "left_semi").withColumn("at", F.monotonically_increasing_id()), "repeated")
        first = again.groupBy("row").agg(F.min("at").alias("first"))
        later = F.lit(rows.agg(F.max("row")).first()[0] + 1) + F.col("at")
        again = again.join(first, "row").withColumn("row", F.when(F.col("at") == F.col("first"), F.col("row")).otherwise(later))
        rows = staged(rows.join(twice, "row", "left_anti").unionByName(again.drop("at", "first")), "rows")
    found = staged(near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), words=5, percent=80), "near-dedup")
    # a merge at any size: the ids to drop grow with the documents
    gone = found.where("NOT kept").select(F.col("doc_id").alias("row")).hint("merge")
    return rows.join(gone, "row", "left_anti").select(COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document holds are cut; a document of which no
    word is left goes."""
    cut = remove_repeats(docs.select(COLUMNS))
    return _with_length(cut).where(F.length(F.trim(F.translate("text", "\t\n\x0b\x0c\r", ""))) > 0)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: whole copies, the fractional one by a seeded draw."""
    return repeated(mix(docs.select(COLUMNS))).select(COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row, with the columns of documents but the text."""
    coded = encode(docs.select(COLUMNS), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "lang", "source", "n_chars", "n_pieces", "piece_ids")


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: Suffix sorting and the pieces' merges are beyond SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = staged(docs, f"pipeline-{number}")
    return docs
