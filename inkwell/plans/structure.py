"""Structure of documents: block types, headings, sections, windows, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.operators import structure as st
from inkwell.plans.registry import query
from inkwell.sources.tables import lines_of, table

SQL_LINES = """
ln AS (SELECT doc_id, source, lang, CAST(i - 1 AS INTEGER) AS ord, l[i] AS text FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE length(trim(l[i])) > 0)
"""
SHORT = "length(text) <= 80"


@query(f"""WITH {SQL_LINES}, s AS (SELECT *, trim(text) AS s, len(regexp_extract_all(trim(text), '\\S+')) AS n, length(regexp_replace(trim(text), '[^A-Za-z0-9À-ÿ]', '', 'g')) AS p FROM ln)
SELECT doc_id, ord, CASE WHEN s = '' THEN 'garbage' WHEN regexp_matches(s, '\\.{{4,}}') THEN 'toc' WHEN p < 0.4 * length(s) THEN 'garbage'
 WHEN regexp_matches(s, '^([0-9]{{1,4}}|[ivxlc]{{1,7}})$') THEN 'page_header' WHEN regexp_matches(s, '(?i)^(table of )?contents$') THEN 'toc'
 WHEN regexp_matches(s, '^([*+•-]|[0-9]+[.)]|[a-zA-Z][.)]|\\([0-9]+\\)) ') THEN 'list'
 WHEN n <= 12 AND NOT regexp_matches(s, '[.?!:;"”]$') AND (regexp_matches(s, '(?i)^(step|chapter|tradition|concept|part|section) ') OR (regexp_matches(s, '[A-Z]') AND NOT regexp_matches(s, '[a-zà-ÿ]'))) THEN 'heading'
 WHEN n <= 45 AND regexp_matches(s, '^["''“”‘’]') AND regexp_matches(s, '["''“”‘’].?$') THEN 'epigraph' ELSE 'paragraph' END AS type FROM s""")
def block_types(spark, sf_dir):
    return lines_of(table(spark, sf_dir, "documents")).select("doc_id", "ord", st.block_type(F.col("text")).alias("type"))


@query(f"WITH {SQL_LINES} SELECT doc_id, ord, last_value(CASE WHEN {SHORT} THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM ln")
def heading_context(spark, sf_dir):
    return st.with_heading(lines_of(table(spark, sf_dir, "documents")), F.expr(SHORT)).select("doc_id", "ord", "heading")


SQL_SECTIONS = f"""{SQL_LINES}, se AS (SELECT *, CAST(sum(CASE WHEN {SHORT} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS BIGINT) AS section FROM ln)"""


@query(f"""WITH {SQL_SECTIONS} SELECT doc_id, section, min(ord) AS start, max(ord) + 1 AS "end", count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars FROM se GROUP BY doc_id, section""")
def sections(spark, sf_dir):
    parts = st.with_section(lines_of(table(spark, sf_dir, "documents")), F.expr(SHORT))
    return parts.groupBy("doc_id", "section").agg(F.min("ord").alias("start"), (F.max("ord") + 1).alias("end"), F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))


@query(f"""WITH {SQL_SECTIONS}, g AS (SELECT doc_id, section, min(ord) AS start, count(*) AS blocks FROM se GROUP BY ALL), k AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY blocks DESC, start) <= 5)
SELECT doc_id, section, start, lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS stop FROM k""")
def longest_sections(spark, sf_dir):
    """The longest sections of each document, their ends moved to the next one kept."""
    parts = st.with_section(lines_of(table(spark, sf_dir, "documents")), F.expr(SHORT)).groupBy("doc_id", "section").agg(F.min("ord").alias("start"), F.count("*").alias("blocks"))
    ranked = parts.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("blocks"), "start"))).where("r <= 5")
    return ranked.select("doc_id", "section", "start", F.lead("start").over(Window.partitionBy("doc_id").orderBy("start")).alias("stop"))


@query(f"""WITH {SQL_LINES} SELECT doc_id, ord, CAST(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY ord) AS BIGINT) AS upto,
 round((row_number() OVER (PARTITION BY doc_id ORDER BY ord))::DOUBLE / count(*) OVER (PARTITION BY doc_id), 6) AS position FROM ln""")
def running_content(spark, sf_dir):
    """Content up to each block, and the block's place in its document."""
    w, whole = st.in_order(), Window.partitionBy("doc_id")
    lines = lines_of(table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "ord", F.sum(F.length("text")).over(w).alias("upto"), F.round(F.row_number().over(w) / F.count("*").over(whole), 6).alias("position"))


@query(f"""WITH {SQL_LINES}, f AS (SELECT *, CASE WHEN regexp_matches(lag(text) OVER (PARTITION BY doc_id ORDER BY ord), '[.?!:;]["”]?\\s*$') OR lag(text) OVER (PARTITION BY doc_id ORDER BY ord) IS NULL THEN 1 ELSE 0 END AS opens FROM ln),
g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY ord) AS para FROM f)
SELECT doc_id, CAST(para AS BIGINT) AS para, string_agg(text, ' ' ORDER BY ord) AS text, count(*) AS pieces FROM g GROUP BY doc_id, para""")
def merged_paragraphs(spark, sf_dir):
    """Join a block to the one before where that does not end a sentence, and number anew."""
    w = st.in_order()
    lines = lines_of(table(spark, sf_dir, "documents")).withColumn("before", F.lag("text").over(w))
    opens = F.col("before").isNull() | F.col("before").rlike(r'[.?!:;]["”]?\s*$')
    numbered = lines.withColumn("para", F.sum(opens.cast("int")).over(w))
    parts = numbered.groupBy("doc_id", "para").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("p"), F.count("*").alias("pieces"))
    return parts.select("doc_id", "para", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"), "pieces")


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(0, (len(w) + 399) // 400)) AS piece FROM w)
SELECT doc_id, CAST(piece AS INTEGER) AS piece, len(w[piece * 400 + 1 : piece * 400 + 400]) AS words, md5(array_to_string(w[piece * 400 + 1 : piece * 400 + 400], ' ')) AS digest FROM p""")
def long_pieces(spark, sf_dir):
    """Texts without sentence ends in pieces of 400 words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)).alias("w")).where(F.size("w") > 0)
    pieces = docs.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 400).cast("int"))).alias("piece"))
    part = F.slice("w", F.col("piece") * 400 + 1, F.lit(400))
    return pieces.select("doc_id", "piece", F.size(part).cast("long").alias("words"), F.md5(F.array_join(part, " ").cast("binary")).alias("digest"))


@query(f"""WITH {SQL_LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM ln), h AS (SELECT doc_id, n FROM r WHERE contains(text, 'onthe')),
k AS (SELECT DISTINCT r.doc_id, r.ord, r.n FROM r JOIN h ON r.doc_id = h.doc_id AND r.n BETWEEN h.n - 1 AND h.n + 1)
SELECT doc_id, ord, lag(ord) OVER (PARTITION BY doc_id ORDER BY n) AS prev, lead(ord) OVER (PARTITION BY doc_id ORDER BY n) AS next FROM k""")
def reader_window(spark, sf_dir):
    """Blocks within one of a hit, with their neighbours in the window."""
    w = st.in_order()
    near = lambda k: F.coalesce(F.lag(F.col("text").contains("onthe"), k).over(w), F.lit(False))
    kept = lines_of(table(spark, sf_dir, "documents")).withColumn("near", near(1) | near(0) | near(-1)).where("near")
    return kept.select("doc_id", "ord", F.lag("ord").over(w).alias("prev"), F.lead("ord").over(w).alias("next"))


@query(f"""WITH {SQL_LINES}, n AS (SELECT regexp_replace(text, '[0-9]+', '#', 'g') AS pattern, doc_id FROM ln WHERE length(text) <= 200)
SELECT pattern, count(DISTINCT doc_id) AS docs FROM n GROUP BY pattern HAVING count(DISTINCT doc_id) >= 3""")
def running_headers(spark, sf_dir):
    """Lines, digits masked, that stand on three documents or more."""
    lines = lines_of(table(spark, sf_dir, "documents")).where("length(text) <= 200").select(F.regexp_replace("text", "[0-9]+", "#").alias("pattern"), "doc_id")
    return lines.groupBy("pattern").agg(F.countDistinct("doc_id").alias("docs")).where("docs >= 3")


@query(f"""WITH {SQL_LINES} SELECT source, count(*) AS blocks, count(*) FILTER (len(regexp_extract_all(text, '\\S+')) < 3) AS fragments, count(*) FILTER (regexp_matches(text, '^[a-zà-ÿ]')) AS low_starts, count(*) FILTER (length(text) > 2000) AS oversize FROM ln GROUP BY source""")
def manifest_audit(spark, sf_dir):
    lines = lines_of(table(spark, sf_dir, "documents"))
    return lines.groupBy("source").agg(
        F.count("*").alias("blocks"), F.count_if(F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))) < 3).alias("fragments"),
        F.count_if(F.col("text").rlike("^[a-zà-ÿ]")).alias("low_starts"), F.count_if(F.length("text") > 2000).alias("oversize"))


@query("""WITH t AS (SELECT page_id, regexp_extract(html, '(?i)<title>([^<]*)</title>', 1) AS title, url FROM pages)
SELECT page_id, title, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS slug, substr(sha1(url), 1, 16) AS key, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM t""")
def page_keys(spark, sf_dir):
    from inkwell.functions.text import short_hash, slug

    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(?i)<title>([^<]*)</title>", 1).alias("title"), "url")
    return pages.select("page_id", "title", slug(F.col("title")).alias("slug"), short_hash(F.col("url"), 16).alias("key"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


@query()
def page_blocks(spark, sf_dir):
    return st.html_blocks(table(spark, sf_dir, "pages"))


@query()
def chunk_scales(spark, sf_dir):
    return st.chunks(table(spark, sf_dir, "documents"))


@query()
def chunk_parents(spark, sf_dir):
    return st.covering(st.chunks(table(spark, sf_dir, "documents")))


SQL_CLOSED, SQL_END = (x.replace("'", "''") for x in st.sentence_patterns())


@query(f"""WITH {SQL_LINES}, c AS (SELECT doc_id, ord, regexp_replace(text, '{SQL_CLOSED}', '\\1\\2' || chr(1) || '\\3', 'g') AS t FROM ln),
d AS (SELECT doc_id, ord, regexp_replace(t, '{SQL_CLOSED}', '\\1\\2' || chr(1) || '\\3', 'g') AS t FROM c),
p AS (SELECT doc_id, ord, list_filter(list_transform(string_split(regexp_replace(t, '{SQL_END}', '\\1' || chr(2) || '\\2', 'g'), chr(2)), lambda x: trim(replace(x, chr(1), ''))), lambda x: x <> '') AS s FROM d)
SELECT doc_id, ord, CAST(i - 1 AS INTEGER) AS n, s[i] AS sentence FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM p)""")
def sentence_split(spark, sf_dir):
    lines = lines_of(table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "ord", F.posexplode(st.sentences(F.col("text"))).alias("n", "sentence"))


@query()
def doubled_layers(spark, sf_dir):
    lines = lines_of(table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "ord", st.collapse_doubled(F.col("text")).alias("text"))


@query()
def chunk_audit(spark, sf_dir):
    """Chunks and their words by scale."""
    found = st.chunks(table(spark, sf_dir, "documents"))
    return found.groupBy("scale").agg(F.count("*").alias("chunks"), F.round(F.avg("words"), 6).alias("words"))


@query()
def section_passages(spark, sf_dir):
    return st.passages(table(spark, sf_dir, "documents"))
