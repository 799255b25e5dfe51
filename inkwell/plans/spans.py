"""Snippets found again in rendered pages, and pointers replaced by titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import spans
from inkwell.operators import structure as st
from inkwell.plans.registry import query
from inkwell.sources.tables import table


@query()
def highlight_spans(spark, sf_dir):
    """Each web page's longest block, found again in the page's html: where a reader's highlight goes."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    longest = st.html_blocks(pages).groupBy("page_id").agg(F.max_by("text", F.struct(F.length("text"), -F.col("ord"))).alias("snippet"))
    return spans.located(pages.join(longest, "page_id"), ["page_id"], "snippet", "html")


@query()
def rendered_spans(spark, sf_dir):
    """Each document's longest line, found again in the document as it is rendered: line ends are tags, words of over eight letters are parted."""
    docs = table(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.length(x).alias("chars"), (-i).alias("back"), x.alias("line")))
    longest = F.array_max(F.filter(lines, lambda x: F.length(F.trim(x["line"])) > 0))["line"]
    html = F.regexp_replace(F.replace("text", F.lit("\n"), F.lit("<br>\n")), r"\b([A-Za-z]{6})([A-Za-z]{3,})", "$1- $2")
    return spans.located(docs.select("doc_id", html.alias("html"), longest.alias("snippet")).where("snippet IS NOT NULL"), ["doc_id"], "snippet", "html")


@query(r"""WITH d AS (SELECT doc_id, string_split(text, chr(10))[1] AS t1, 'The ' || source AS t2, replace(replace(text, ' the ', ' the first source '), ' la ', ' la 2nd reading ') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract(t1, '^([A-Za-z]+)', 1) AS t1, t2, text FROM d), n AS (SELECT doc_id, CASE WHEN t1 = '' THEN 'None' ELSE t1 END AS t1, t2, text FROM w)
SELECT doc_id, length(replace(replace(text, 'the first source', t1), '2nd reading', t2)) AS chars, md5(replace(replace(text, 'the first source', t1), '2nd reading', t2)) AS digest FROM n""")
def titles_for_pointers(spark, sf_dir):
    """Documents whose articles point at a source; the pointers become titles: the document's first word, and its source."""
    docs = table(spark, sf_dir, "documents")
    first = F.regexp_extract("text", r"^([A-Za-z]+)", 1)
    pointed = F.replace(F.replace("text", F.lit(" the "), F.lit(" the first source ")), F.lit(" la "), F.lit(" la 2nd reading "))
    rows = docs.select("doc_id", F.when(first == "", "None").otherwise(first).alias("t1"), F.concat(F.lit("The "), "source").alias("t2"), pointed.alias("text"))
    done = rows.select("doc_id", spans.with_titles(F.col("text"), F.col("t1"), F.col("t2")).alias("text"))
    return done.select("doc_id", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))
