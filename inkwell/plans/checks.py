"""Checks, gates and score factors over blocks, turns and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators.feeds import minutes_of
from inkwell.operators.ranking import bm25, top
from inkwell.operators.retrieve import ENDNOTE, ENUMERATION, HEADER, HEADER_FACTOR, HEADER_WORDS, INDEX_ENTRY, INDEX_FACTOR, INDEX_RUN, LIST_FACTOR, header_factor, listed_factor
from inkwell.operators.structure import block_type
from inkwell.plans.registry import query
from inkwell.plans.search import SQL_BM25, asked
from inkwell.plans.structure import SQL_LINES
from inkwell.sources.tables import lines_of, table

# What an instruction to the model, and a turn that needs a person at once, look like.
INJECTION = r"(?i)ignore (all |the )?(previous|prior|above) instructions|system prompt|you are now"
CRISIS = r"(?i)kill myself|suicid|end my life|overdos"


def sql(pattern: str) -> str:
    return pattern.replace("'", "''")


@query(f"""WITH {SQL_LINES}, c AS (SELECT doc_id, ord, len(regexp_extract_all(text, '{sql(INDEX_RUN)}')) AS runs, len(regexp_extract_all(text, '{sql(INDEX_ENTRY)}')) AS entries, len(regexp_extract_all(text, '{sql(ENDNOTE)}')) AS notes,
 len(regexp_extract_all(text, '{sql(ENUMERATION)}')) + CASE WHEN regexp_matches(text, '\\bCONTENTS\\b') THEN 3 ELSE 0 END AS marks, len(regexp_extract_all(regexp_replace(text, '{sql(HEADER)}', ''), '[A-Za-z0-9]+')) AS words FROM ln)
SELECT doc_id, ord, CASE WHEN runs >= 1 OR entries >= 5 OR notes >= 3 THEN {INDEX_FACTOR}::DOUBLE WHEN marks >= 5 THEN {LIST_FACTOR}::DOUBLE ELSE 1.0::DOUBLE END AS list_factor, CASE WHEN words < {HEADER_WORDS} THEN {HEADER_FACTOR}::DOUBLE ELSE 1.0::DOUBLE END AS header_factor FROM c""")
def block_factors(spark, sf_dir):
    """What a block's score is multiplied by: less for indexes, endnotes, lists of contents and bare headers."""
    lines = lines_of(table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "ord", listed_factor(F.col("text")).alias("list_factor"), header_factor(F.col("text"), F.lit("small")).alias("header_factor"))


SQL_BLOCKS = SQL_BM25.replace("2.5::DOUBLE", "2.2::DOUBLE").replace("1.5::DOUBLE *", "1.2::DOUBLE *").replace(
    "SELECT doc_id, lang, list_transform(regexp_extract_all(text, '[A-Za-z0-9'']+'), lambda x: lower(x)) AS w FROM documents", "SELECT doc_id * 10000000 + ord AS doc_id, lang, list_transform(regexp_extract_all(text, '[A-Za-z0-9'']+'), lambda x: lower(x)) AS w FROM ln"
)


@query(f"""WITH {SQL_LINES}, {SQL_BLOCKS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM b)
SELECT qid, doc_id AS block, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""")
def block_search(spark, sf_dir, k: int = 8):
    """Rank search at the grain of blocks, with the saturation of a full-text index (k1 = 1.2)."""
    blocks = lines_of(table(spark, sf_dir, "documents")).select((F.col("doc_id") * 10000000 + F.col("ord")).alias("block"), "text")
    scored = bm25(blocks, asked(spark), key="block", k1=1.2).withColumn("score", F.round("score", 6))
    return top(scored, k, ["qid"], F.desc("score"), "block").select("qid", "block", "score", "rank")


@query(f"""WITH {SQL_LINES}, s AS (SELECT source, trim(text) AS s, length(regexp_replace(trim(text), '[^A-Za-z0-9À-ÿ]', '', 'g')) AS p FROM ln)
SELECT source, count(*) AS blocks, round(count(*) FILTER (NOT regexp_matches(s, '\\.{{4,}}') AND p < 0.4 * length(s)) / count(*), 6) AS garbage FROM s GROUP BY source""")
def garbage_report(spark, sf_dir):
    """Share of garbage blocks by source."""
    kinds = lines_of(table(spark, sf_dir, "documents")).select("source", block_type(F.col("text")).alias("type"))
    return kinds.groupBy("source").agg(F.count("*").alias("blocks"), F.round(F.count_if(F.col("type") == "garbage") / F.count("*"), 6).alias("garbage"))


@query("SELECT doc_id, quality, toxic FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)")
def orphan_labels(spark, sf_dir):
    """References to documents that are not there."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_anti").select("doc_id", "quality", "toxic")


@query(f"""SELECT role, count(*) AS turns, count(*) FILTER (regexp_matches(text, '{sql(INJECTION)}')) AS injections, count(*) FILTER (regexp_matches(text, '{sql(CRISIS)}')) AS crises FROM conversations GROUP BY role""")
def gated_turns(spark, sf_dir):
    """Turns that a gate stops, by role."""
    t = F.col("text")
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.count_if(t.rlike(INJECTION)).alias("injections"), F.count_if(t.rlike(CRISIS)).alias("crises"))


@query("""WITH g AS (SELECT d.source, count(*) AS gold FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND l.toxic = 0 GROUP BY d.source),
s AS (SELECT source, count(*) AS docs FROM documents GROUP BY source) SELECT s.source, docs, coalesce(gold, 0) AS gold FROM s LEFT JOIN g ON s.source = g.source""")
def gold_by_source(spark, sf_dir):
    """Gold documents of each source, with a default where a source has none."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    gold = docs.join(labels, "doc_id").groupBy("source").agg(F.count("*").alias("gold"))
    return docs.groupBy("source").agg(F.count("*").alias("docs")).join(gold, "source", "left").select("source", "docs", F.coalesce("gold", F.lit(0)).alias("gold"))


@query("""SELECT event_id, CAST(extract(hour FROM ts) * 60 + extract(minute FROM ts) AS INTEGER) AS minutes FROM events""")
def delivery_times(spark, sf_dir):
    """Times as subscribers write them, read back."""
    said = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "h:mm a").alias("said"))
    return said.select("event_id", minutes_of(F.col("said")).alias("minutes"))
