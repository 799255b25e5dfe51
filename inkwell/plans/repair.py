"""Text repair and outlines over the corpus; lines of documents stand for a page's lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import repair
from inkwell.operators.outline import outline
from inkwell.plans.registry import query
from inkwell.plans.structure import SHORT, SQL_LINES
from inkwell.sources.tables import lines_of, table

KNOWN = "|".join(repair.ABBREVIATIONS)
SQL_ENDS = f"""b AS (SELECT doc_id, ord, text, regexp_replace(trim(text), '["''”“’‘)\\]}}]+$', '') AS s FROM ln),
e AS (SELECT *, regexp_matches(s, '(^|[^\\p{{L}}\\p{{N}}_])((?:[A-Za-z][.])+[A-Za-z]|[A-Z]|(?i:{KNOWN}))[.]$') AS abbreviation FROM b),
f AS (SELECT *, regexp_matches(s, '([?!:;]|[.]{{3}})$') OR (s LIKE '%.' AND NOT abbreviation) AS terminal FROM e)"""


@query(f"WITH {SQL_LINES}, {SQL_ENDS} SELECT doc_id, ord, terminal, abbreviation FROM f")
def sentence_ends(spark, sf_dir):
    lines = lines_of(table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "ord", repair.ends_sentence(F.col("text")).alias("terminal"), repair.ends_in_abbreviation(F.col("text")).alias("abbreviation"))


@query()
def hyphen_repair(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repair.repair_hyphens(docs).select("doc_id", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query()
def ligature_repair(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repair.repair_ligatures(docs).select("doc_id", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query()
def reflowed(spark, sf_dir):
    return repair.reflow(lines_of(table(spark, sf_dir, "documents")))


SQL_UNCOUNTED = ", ".join(f"'{w}'" for w in repair.UNCOUNTED)


@query(f"""WITH {SQL_LINES}, w AS (SELECT doc_id, ord, text, regexp_extract_all(text, '[A-Za-z]+') AS w FROM ln),
c AS (SELECT *, list_filter(w, lambda x: lower(x) NOT IN ({SQL_UNCOUNTED})) AS c FROM w)
SELECT doc_id, ord, CASE WHEN len(w) = 0 THEN false WHEN len(c) = 0 THEN regexp_matches(text, '^\\p{{Lu}}') ELSE len(list_filter(c, lambda x: regexp_matches(x, '^[A-Z]'))) >= 0.75 * len(c) END AS title_like,
 regexp_matches(trim(text), '^[a-zA-Z\\s-]+,?\\s*[0-9]+[\\s,0-9-]*$') AS index_like FROM c""")
def title_and_index_lines(spark, sf_dir):
    lines = lines_of(table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "ord", repair.is_title_like(F.col("text")).alias("title_like"), repair.is_index(F.col("text")).alias("index_like"))


@query()
def clean_headings(spark, sf_dir):
    """Short lines as headings: their titles, and whether a page number marks a running header."""
    lines = lines_of(table(spark, sf_dir, "documents")).where(SHORT)
    return lines.select("doc_id", "ord", repair.clean_heading(F.col("text")).alias("h")).where("h IS NOT NULL").select("doc_id", "ord", "h.title", "h.running")


@query()
def outlines(spark, sf_dir):
    """Chapters of documents, short lines being their headings; long ones are cut."""
    kind = F.when(F.expr(SHORT), "heading").otherwise("paragraph").alias("type")
    none = F.lit(None).cast("string")
    lines = lines_of(table(spark, sf_dir, "documents"))
    return outline(lines.select("doc_id", "ord", F.col("ord").cast("string").alias("block_id"), kind, "text", none.alias("printed_page"), none.alias("physical_page")))
