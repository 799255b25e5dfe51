"""Literal text analytics: counts, snippets, clean-up and facts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.text import e164
from inkwell.operators.contain import contained
from inkwell.plans.registry import query
from inkwell.sources.tables import lines_of, table


@query("""WITH h AS (SELECT source, lang, len(regexp_extract_all(lower(text), 'tion')) AS tion, len(regexp_extract_all(lower(text), 'keit')) AS keit FROM documents)
SELECT source, lang, CAST(sum(tion) AS BIGINT) AS tion, CAST(sum(keit) AS BIGINT) AS keit FROM h GROUP BY ROLLUP (source, lang)""")
def exact_counts(spark, sf_dir):
    """Exact counts of terms in all, by book, and by book and category."""
    count = lambda t: F.sum(F.regexp_count(F.lower("text"), F.lit(t))).alias(t)
    return table(spark, sf_dir, "documents").rollup("source", "lang").agg(count("tion"), count("keit"))


@query("""SELECT doc_id, strpos(lower(text), 'thre') AS at, substr(text, CAST(greatest(strpos(lower(text), 'thre') - 40, 1) AS BIGINT), 100) AS snippet FROM documents WHERE contains(lower(text), 'thre')""")
def snippets(spark, sf_dir):
    """Text around the first hit."""
    at = F.instr(F.lower("text"), "thre")
    found = table(spark, sf_dir, "documents").select("doc_id", "text", at.alias("at")).where("at > 0")
    return found.select("doc_id", F.col("at").cast("long").alias("at"), F.expr("substring(text, greatest(at - 40, 1), 100)").alias("snippet"))


@query(r"""SELECT doc_id, CAST(min(y) AS INTEGER) AS first, count(*) AS n FROM (SELECT doc_id, CAST(unnest(regexp_extract_all(text, '(19|20)[0-9][0-9]')) AS INTEGER) AS y FROM documents) GROUP BY doc_id""")
def years(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("((19|20)[0-9][0-9])"), F.lit(1))).alias("y"))
    return found.groupBy("doc_id").agg(F.min(F.col("y").cast("int")).alias("first"), F.count("*").alias("n"))


@query(r"""WITH p AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}')), '[^0-9]', '', 'g') AS d FROM documents) SELECT DISTINCT doc_id, '+' || d AS phone FROM p""")
def phones(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"), F.lit(0))).alias("p"))
    return found.select("doc_id", e164(F.col("p")).alias("phone")).distinct()


@query("""WITH c AS (SELECT doc_id, left(text, 300) AS t, length(text) > 300 AS long FROM documents) SELECT doc_id, CASE WHEN long AND contains(t, ' ') THEN left(t, length(t) - strpos(reverse(t), ' ')) ELSE t END AS excerpt FROM c""")
def excerpts(spark, sf_dir):
    """At most 300 characters, cut at a word."""
    t = F.substring("text", 1, 300)
    cut = F.expr("CASE WHEN length(text) > 300 AND contains(t, ' ') THEN left(t, length(t) - instr(reverse(t), ' ')) ELSE t END")
    return table(spark, sf_dir, "documents").select("doc_id", "text", t.alias("t")).select("doc_id", cut.alias("excerpt"))


@query(r"""WITH w AS (SELECT doc_id, array_to_string(regexp_extract_all(text, '\S+')[1:320], ' ') AS t FROM documents) SELECT doc_id, 'doc: ' || CASE WHEN length(t) > 2000 THEN left(left(t, 2000), 2000 - strpos(reverse(left(t, 2000)), ' ')) ELSE t END AS prepared FROM w""")
def embedding_text(spark, sf_dir):
    """Text as an embedder takes it: 320 words and 2000 characters at most, with a prefix."""
    t = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), 1, 320), " ")
    cut = F.expr("CASE WHEN length(t) > 2000 THEN left(t, 2000 - instr(reverse(left(t, 2000)), ' ')) ELSE t END")
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.concat(F.lit("doc: "), cut).alias("prepared"))


@query("""WITH d AS (SELECT doc_id, source, n_chars, text FROM documents), c AS (SELECT *, sum(length(left(text, 400)) + 2) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM d)
SELECT source, count(*) AS parts, CAST(sum(length(left(text, 400))) AS BIGINT) AS chars FROM c WHERE upto <= 12000 GROUP BY source""")
def context_budget(spark, sf_dir):
    """What fits a context of 12 000 characters, in order, by running sum."""
    part = F.length(F.substring("text", 1, 400))
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", part.alias("n"))
    # a part costs two characters at least: no more than 6000 of a source can fit, whatever their order is
    first = Window.partitionBy("source").orderBy("doc_id")
    rows = rows.withColumn("at", F.row_number().over(first)).where("at <= 6000")
    upto = F.sum(F.col("n") + 2).over(first)
    return rows.withColumn("upto", upto).where("upto <= 12000").groupBy("source").agg(F.count("*").alias("parts"), F.sum("n").alias("chars"))


@query(r"""WITH b AS (SELECT item_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS q FROM benchmark), d AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS t FROM documents)
SELECT item_id, count(*) AS found, min(doc_id) AS first FROM b JOIN d ON contains(t, q) WHERE length(q) >= 40 GROUP BY item_id""")
def verified_quotes(spark, sf_dir):
    """Quotes found in evidence, letters only on both sides: forty letters of a quote lead to the texts that may hold it."""
    tight = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    quotes = table(spark, sf_dir, "benchmark").select("item_id", tight("text").alias("text")).where("length(text) >= 40")
    docs = table(spark, sf_dir, "documents").select("doc_id", tight("text").alias("text"))
    return contained(docs, quotes).groupBy("item_id").agg(F.count("*").alias("found"), F.min("doc_id").alias("first"))


@query("""SELECT source AS category, upper(left(source, 1)) || substr(source, 2) AS label, count(*) AS docs FROM documents GROUP BY source""")
def categories(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("category")).agg(F.count("*").alias("docs")).withColumn("label", F.initcap("category"))


@query(r"""WITH l AS (SELECT doc_id, i, l[i] AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))
SELECT doc_id, count(*) FILTER (trim(t) = '') AS blank, count(*) FILTER (regexp_matches(t, '[|#*$%&]')) AS marked, count(*) AS lines, count(*) FILTER (regexp_matches(t, '[|#*$%&]')) > 0.05::DOUBLE * count(*) AS flagged FROM l GROUP BY doc_id""")
def lint_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("t"))
    marked = F.count_if(F.col("t").rlike("[|#*$%&]"))
    return lines.groupBy("doc_id").agg(F.count_if(F.trim("t") == "").alias("blank"), marked.alias("marked"), F.count("*").alias("lines"), (marked > F.lit(0.05) * F.count("*")).alias("flagged"))


@query("""WITH l AS (SELECT doc_id, i, trim(l[i]) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)) SELECT source, t AS line, count(*) AS n FROM l JOIN documents USING (doc_id) WHERE length(t) > 20 GROUP BY ALL HAVING count(*) >= 3""")
def repeated_lines(spark, sf_dir):
    lines = lines_of(table(spark, sf_dir, "documents")).select("source", F.trim("text").alias("line")).where("length(line) > 20")
    return lines.groupBy("source", "line").agg(F.count("*").alias("n")).where("n >= 3")
