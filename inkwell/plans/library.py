"""Manifests, packs and look-ups of a library; judgements given twice; suggestions and query graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.operators import repair
from inkwell.operators.graph import shared_folder
from inkwell.operators.ranking import bm25, top
from inkwell.operators.retrieval import batch_index, batch_top
from inkwell.plans.registry import query
from inkwell.plans.search import SQL_BATCH, SQL_BM25, asked, batch
from inkwell.plans.structure import SHORT, SQL_LINES
from inkwell.sources import sinks, tables
from inkwell.sources.tables import lines_of, table

SQL_LEVEL = "CASE WHEN regexp_matches(text, '(?i)^(Part|Section)\\b') THEN 1 WHEN regexp_matches(text, '(?i)^(Step|Chapter|Tradition)\\b') THEN 2 ELSE 3 END"


@query(f"""WITH {SQL_LINES}, b AS (SELECT *, {SHORT} AS head FROM ln)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang AS category, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (head) AS headings, CAST(sum(CASE WHEN head THEN {SQL_LEVEL} END) AS BIGINT) AS levels FROM b GROUP BY doc_id, lang""")
def manifests_read_back(spark, sf_dir):
    """Documents as manifests in folders by language, written and read back block by block."""
    path = f"{shared_folder(spark)}/manifests-{uuid.uuid4().hex}"
    lines = lines_of(table(spark, sf_dir, "documents"))
    head, none = F.expr(SHORT), F.lit(None)
    blocks = lines.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("title"), F.col("lang").alias("category"), "ord", F.concat_ws("-", "doc_id", "ord").alias("block_id"),
        F.when(head, "heading").otherwise("paragraph").alias("type"), "text", none.cast("string").alias("printed_page"), none.cast("int").alias("physical_page"),
        F.when(head, repair.heading_level(F.col("text"))).alias("level"))
    sinks.write_manifests(blocks, path)
    back = tables.manifests(spark, path, lines=True).select("doc_id", "category", F.explode("blocks").alias("b"))
    return back.groupBy("doc_id", "category").agg(F.count("*").alias("blocks"), F.sum(F.length("b.text")).alias("chars"), F.count_if(F.col("b.type") == "heading").alias("headings"), F.sum("b.level").alias("levels"))


@query("""WITH f AS (SELECT source, CAST(doc_id % 37 AS INTEGER) AS version, 'packs/' || source || '-v' || (doc_id % 37) || '.zip' AS path, text, doc_id FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY doc_id) AS k FROM f)
SELECT source AS pack, version, path, sha256(text) AS sha256 FROM n WHERE k = 1 QUALIFY row_number() OVER (PARTITION BY source ORDER BY version DESC) = 1""")
def newest_packs(spark, sf_dir):
    """The newest version of each pack with its digest; documents stand for files, the first of a name counting."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("packs/"), "source", F.lit("-v"), (F.col("doc_id") % 37).cast("string"), F.lit(".zip"))
    files = docs.groupBy(path.alias("path")).agg(F.min_by("text", "doc_id").cast("binary").alias("content"))
    return sinks.newest_packs(files)


@query(f"""WITH {SQL_BM25}, c AS (SELECT qid, source, b.doc_id, n_chars, round(score, 6) AS score FROM b JOIN documents d ON d.doc_id = b.doc_id)
SELECT qid, source, doc_id, score FROM c QUALIFY row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, n_chars, doc_id) = 1""")
def best_of_sources(spark, sf_dir):
    """For each asked list the best document of each source; of equal scores the shorter."""
    docs = table(spark, sf_dir, "documents")
    found = bm25(docs, asked(spark)).withColumn("score", F.round("score", 6)).join(docs.select("doc_id", "source", "n_chars"), "doc_id")
    return top(found, 1, ["qid", "source"], F.desc("score"), "n_chars", "doc_id").select("qid", "source", "doc_id", "score")


SQL_JUDGED = r"""
j AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS words, len(regexp_extract_all(coalesce(text, ''), '[.!?]')) AS ends, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS marks FROM documents),
k AS (SELECT doc_id, words >= 50 AND 40 * ends >= words AND marks = 0 AS strict, words >= 30 AND 80 * ends >= words AND 50 * marks <= words AS lenient FROM j)"""


@query(f"WITH {SQL_JUDGED} SELECT doc_id, CASE WHEN strict THEN 'kept' WHEN lenient THEN 'second chance' ELSE 'dropped' END AS verdict FROM k")
def second_chance(spark, sf_dir):
    """Texts judged strictly; those dropped are judged once more, leniently, and join the kept ones."""
    text = F.coalesce("text", F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    rows = table(spark, sf_dir, "documents").select("doc_id", count(r"\S+").alias("words"), count("[.!?]").alias("ends"), count("[#*$%&|<>]").alias("marks"))
    strict = F.expr("words >= 50 AND 40 * ends >= words AND marks = 0")
    again = rows.where(~strict).withColumn("verdict", F.when(F.expr("words >= 30 AND 80 * ends >= words AND 50 * marks <= words"), "second chance").otherwise("dropped"))
    return rows.where(strict).withColumn("verdict", F.lit("kept")).unionByName(again).select("doc_id", "verdict")


@query(f"""WITH {SQL_BATCH}, r AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM b WHERE doc_id <> qid QUALIFY rank <= 3)
SELECT 'q' || qid AS a, 'p' || doc_id AS b, 'passage' AS kind FROM r UNION ALL SELECT DISTINCT 'p' || r.doc_id, 't' || p.token, 'term' FROM r JOIN q USING (qid) JOIN p ON p.doc_id = r.doc_id AND p.token = q.token""")
def query_graph(spark, sf_dir):
    """Edges from each asking document to its three best passages, and from those to the asked terms in them."""
    docs = table(spark, sf_dir, "documents")
    index = batch_index(docs, batch(spark, sf_dir))
    found = batch_top(docs, None, 3, index=index).select("qid", "doc_id")
    asked = found.join(index.queries.join(index.words, "token"), "qid").join(index.held.select("doc_id", "tids"), "doc_id").where(F.array_contains("tids", F.col("tid")))
    held = asked.select(F.concat(F.lit("p"), "doc_id").alias("a"), F.concat(F.lit("t"), "token").alias("b"), F.lit("term").alias("kind")).distinct()
    return found.select(F.concat(F.lit("q"), "qid").alias("a"), F.concat(F.lit("p"), "doc_id").alias("b"), F.lit("passage").alias("kind")).unionByName(held)


@query("""WITH c AS (SELECT conv_id, turn, role, md5(lower(trim(text))) AS h FROM conversations), s AS (SELECT DISTINCT h FROM c WHERE role = 'assistant' AND turn = 1)
SELECT conv_id, turn, h IN (SELECT h FROM s) AS saved FROM c""")
def saved_turns(spark, sf_dir):
    """Turns whose text is a saved one: what assistants said first, anywhere."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.md5(F.lower(F.trim("text")).cast("binary")).alias("h"))
    saved = turns.where("role = 'assistant' AND turn = 1").select("h").distinct().withColumn("saved", F.lit(True))
    return turns.join(saved, "h", "left").select("conv_id", "turn", F.coalesce("saved", F.lit(False)).alias("saved"))


@query(f"""WITH {SQL_LINES}, b AS (SELECT doc_id, source, ord, text, length(text) >= 200 AS medium FROM ln), n AS (SELECT *, bool_or(medium) OVER (PARTITION BY doc_id) AS held FROM b)
SELECT doc_id, ord, held FROM n WHERE medium OR NOT held""")
def scale_or_all(spark, sf_dir):
    """Blocks of the wanted scale (200 characters or more), or all of a document that has none of it."""
    lines = lines_of(table(spark, sf_dir, "documents")).withColumn("medium", F.length("text") >= 200)
    rows = lines.withColumn("held", F.max("medium").over(Window.partitionBy("doc_id")))
    return rows.where("medium OR NOT held").select("doc_id", "ord", "held")
