"""Retrieval over documents as chunks: every factor in the score, then a varied choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import retrieve as rv
from inkwell.plans.registry import query
from inkwell.plans.search import SQL_SIDES, keyword_side, semantic_side
from inkwell.sources.tables import table

WEIGHTS = rv.Weights(
    categories={"en": 1.4, "fr": 1.05, "de": 0.85}, works=[(["src0"], ["src0"]), (["src2", "the second"], ["src2", "src4"])], priors=[(["src1"], 1.22), (["src3"], 0.88)],
)
SCOPE = ["en", "fr", "de"]
Q = lambda s: s.replace("'", "''")


def chunks(spark, sf_dir):
    size = F.when(F.col("n_chars") < 800, "small").when(F.col("n_chars") < 3000, "medium").when(F.col("n_chars") < 8000, "large").otherwise("topic")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("key"), "text", F.lit(None).cast("string").alias("context"), size.alias("scale"), F.col("lang").alias("category"), "source",
        F.md5(F.substring("text", 1, 80).cast("binary")).alias("context_id"))


def questions(spark, sf_dir):
    """What each asking document says: every second one names its source."""
    text = F.when(F.col("doc_id") % 40 == 0, F.concat(F.lit("What does "), F.initcap("source"), F.lit(" say?"))).otherwise(F.lit("tell me more"))
    return table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), text.alias("text"))


def sides(spark, sf_dir):
    named = lambda df: df.drop("rank").withColumnRenamed("doc_id", "key")
    return named(semantic_side(spark, sf_dir)), named(keyword_side(spark, sf_dir))


@query(f"""WITH {SQL_SIDES}, ch AS (SELECT doc_id, text, lang, lower(source) AS source, CASE WHEN n_chars < 800 THEN 'small' WHEN n_chars < 3000 THEN 'medium' WHEN n_chars < 8000 THEN 'large' ELSE 'topic' END AS scale FROM documents WHERE lang IN ('en', 'fr', 'de')),
s1 AS (SELECT sem.qid, sem.doc_id, sem FROM sem SEMI JOIN ch USING (doc_id)), k1 AS (SELECT kw.qid, kw.doc_id, kw FROM kw SEMI JOIN ch USING (doc_id)),
f AS (SELECT coalesce(s1.qid, k1.qid) AS qid, coalesce(s1.doc_id, k1.doc_id) AS doc_id, coalesce(sem, 0)::DOUBLE AS sem, coalesce(kw, 0)::DOUBLE AS kw FROM s1 FULL JOIN k1 ON s1.doc_id = k1.doc_id AND s1.qid = k1.qid),
g AS (SELECT qid, doc_id, 0.7::DOUBLE * sem / greatest(max(sem) OVER (PARTITION BY qid), 1e-6) + 0.3::DOUBLE * kw / greatest(max(kw) OVER (PARTITION BY qid), 1e-6) AS base FROM f),
qs AS (SELECT doc_id AS qid, CASE WHEN doc_id % 40 = 0 THEN lower('What does ' || source || ' say?') ELSE 'tell me more' END AS t FROM documents WHERE doc_id % 20 = 0),
w AS (SELECT qid, CASE WHEN contains(t, 'src0') THEN ['src0'] ELSE [] END || CASE WHEN contains(t, 'src2') OR contains(t, 'the second') THEN ['src2', 'src4'] ELSE [] END AS works FROM qs),
m AS (SELECT g.qid, g.doc_id, base, ch.*, coalesce(w.works, []) AS works, len(list_filter(coalesce(w.works, []), lambda x: contains(source, x))) > 0 AS named,
  len(regexp_extract_all(text, '{Q(rv.INDEX_RUN)}')) >= 1 OR len(regexp_extract_all(text, '{Q(rv.INDEX_ENTRY)}')) >= 5 OR len(regexp_extract_all(text, '{Q(rv.ENDNOTE)}')) >= 3 AS listed,
  len(regexp_extract_all(text, '{Q(rv.ENUMERATION)}')) + CASE WHEN regexp_matches(text, '{rv.CONTENTS}') THEN 3 ELSE 0 END >= 5 AS steps,
  scale = 'small' AND len(regexp_extract_all(regexp_replace(text, '{Q(rv.HEADER)}', ''), '[A-Za-z0-9]+')) < 15 AS header
  FROM g JOIN ch ON ch.doc_id = g.doc_id LEFT JOIN w ON w.qid = g.qid)
SELECT qid, doc_id, round(base * CASE scale WHEN 'medium' THEN 0.97::DOUBLE WHEN 'large' THEN 0.95::DOUBLE WHEN 'topic' THEN 0.96::DOUBLE ELSE 1 END * CASE lang WHEN 'en' THEN 1.4::DOUBLE WHEN 'fr' THEN 1.05::DOUBLE ELSE 0.85::DOUBLE END
  * CASE WHEN named THEN 3.0::DOUBLE WHEN len(works) > 0 THEN 1 WHEN contains(source, 'src1') THEN 1.22::DOUBLE WHEN contains(source, 'src3') THEN 0.88::DOUBLE ELSE 1 END
  * CASE WHEN listed THEN 0.2::DOUBLE WHEN steps THEN 0.45::DOUBLE ELSE 1 END * CASE WHEN header THEN 0.35::DOUBLE ELSE 1 END, 6) AS score, named FROM m""")
def retrieved_scores(spark, sf_dir):
    """Candidates of three categories with all factors: sides, scale, category, works named by title, priors, lists and headers."""
    semantic, keyword = sides(spark, sf_dir)
    found = rv.scored(chunks(spark, sf_dir), semantic, keyword, questions(spark, sf_dir), WEIGHTS, SCOPE)
    return found.select("qid", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), "named")


@query()
def retrieved(spark, sf_dir):
    """Eight results a question, varied by size, source and context; tests compare the choice with a plain loop."""
    semantic, keyword = sides(spark, sf_dir)
    found = rv.retrieve(chunks(spark, sf_dir), semantic, keyword, questions(spark, sf_dir), 8, WEIGHTS, SCOPE)
    return found.select("qid", F.col("key").alias("doc_id"), "pick")
