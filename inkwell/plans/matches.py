"""Results placed in their documents: passages, blocks, pages, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions.text import tokens
from inkwell.operators.ranking import top
from inkwell.operators.retrieval import page_score, resolved
from inkwell.plans.registry import query
from inkwell.plans.structure import SQL_LINES
from inkwell.sources.tables import lines_of, table

SQL_MARK = f"""{SQL_LINES}, n AS (SELECT doc_id, ord, text, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, ord) AS n FROM ln),
hi AS (SELECT doc_id, ord AS marked, list_distinct(x) AS d, x FROM (SELECT doc_id, ord, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9'']+'), lambda t: lower(t)), lambda t: length(t) >= 2) AS x FROM n WHERE n = 1)),
tm AS (SELECT doc_id, marked, list_filter(x, lambda t, i: list_position(x, t) = i)[1:12] AS terms FROM hi)"""


def marked(spark, sf_dir):
    """(doc_id, marked, terms): the longest block of each document as a highlight, its first twelve different words."""
    blocks = lines_of(table(spark, sf_dir, "documents"))
    longest = blocks.groupBy("doc_id").agg(F.max_by(F.struct("ord", "text"), F.struct(F.length("text"), -F.col("ord"))).alias("x"))
    words = F.slice(F.array_distinct(F.filter(tokens(F.col("x.text")), lambda t: F.length(t) >= 2)), 1, 12)
    return longest.select("doc_id", F.col("x.ord").alias("marked"), words.alias("terms"))


@query(f"""WITH RECURSIVE {SQL_MARK}, b AS (SELECT doc_id, ord, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS low FROM ln), c AS (SELECT * FROM b JOIN tm USING (doc_id) WHERE len(terms) > 0),
o AS (SELECT doc_id, ord, low, terms, 0 AS hits, 1 AS pos, true AS going FROM c
 UNION ALL SELECT doc_id, ord, low, terms, hits + CASE WHEN instr(low[pos:], terms[hits + 1]) > 0 THEN 1 ELSE 0 END, pos + instr(low[pos:], terms[hits + 1]) - 1 + length(terms[hits + 1]), instr(low[pos:], terms[hits + 1]) > 0 FROM o WHERE going AND hits < least(len(terms), 8)),
h AS (SELECT doc_id, ord, max(hits) AS ordered FROM o GROUP BY ALL),
s AS (SELECT c.doc_id, c.ord, len(terms) AS n, CASE WHEN contains(low, array_to_string(terms, ' ')) THEN 250 ELSE 0 END + CASE WHEN contains(low, array_to_string(terms[1:8], ' ')) THEN 160 ELSE 0 END
 + 14 * len(list_filter(terms, lambda t: contains(low, t))) + 20 * ordered + 6 * len(list_filter(terms[1:6], lambda t: contains(substr(low, 1, 900), t))) AS score FROM c JOIN h ON h.doc_id = c.doc_id AND h.ord = c.ord)
SELECT doc_id, CAST(ord AS INTEGER) AS page, CAST(score AS INTEGER) AS score FROM s WHERE score >= greatest(36, 14 * least(n, 4)) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) = 1""")
def best_pages(spark, sf_dir):
    """The page (block) of a document that fits a highlight best, if any fits well enough."""
    low = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    rows = lines_of(table(spark, sf_dir, "documents")).select("doc_id", "ord", low.alias("low")).join(marked(spark, sf_dir).where(F.size("terms") > 0), "doc_id")
    scored = rows.select("doc_id", "ord", F.size("terms").alias("n"), page_score(F.col("low"), F.col("terms")).alias("score"))
    fits = scored.where(F.col("score") >= F.greatest(F.lit(36), 14 * F.least("n", F.lit(4))))
    return top(fits, 1, ["doc_id"], F.desc("score"), "ord").select("doc_id", F.col("ord").alias("page"), "score")


SQL_RESULTS = f"""{SQL_LINES}, ps AS (SELECT doc_id, ord // 4 AS passage, doc_id * 1000000 + ord // 4 AS pid, list(ord ORDER BY ord) AS blocks, string_agg(text, ' ' ORDER BY ord) AS body FROM ln GROUP BY ALL),
rs AS (SELECT doc_id * 10 + ord % 3 AS result, doc_id, ord, CASE WHEN ord % 3 = 0 THEN doc_id * 1000000 + ord // 4 END AS pid, CASE WHEN ord % 3 = 1 THEN ord END AS block, text[:80] AS head FROM ln WHERE ord BETWEEN 3 AND 5)"""


@query(f"""WITH {SQL_RESULTS}, h AS (SELECT result, ps.pid, 1 AS p FROM rs JOIN ps ON ps.pid = rs.pid UNION ALL SELECT result, ps.pid, 2 FROM rs JOIN ps ON ps.doc_id = rs.doc_id AND list_contains(blocks, block) UNION ALL SELECT result, ps.pid, 3 FROM rs JOIN ps ON ps.doc_id = rs.doc_id AND contains(body, head))
SELECT result, pid AS passage, CASE p WHEN 1 THEN 'id' WHEN 2 THEN 'block' ELSE 'text' END AS by FROM h QUALIFY row_number() OVER (PARTITION BY result ORDER BY p, pid) = 1""")
def result_passages(spark, sf_dir):
    """Results at any grain onto passages of four blocks: by id, else by a shared block, else by how their text begins."""
    blocks = lines_of(table(spark, sf_dir, "documents"))
    part = F.floor(F.col("ord") / 4)
    pid = (F.col("doc_id") * 1000000 + part).cast("long")
    passages = blocks.groupBy("doc_id", pid.alias("passage")).agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("b"))  # four blocks
    passages = passages.select("doc_id", "passage", F.col("b.ord").alias("blocks"), F.array_join("b.text", " ").alias("body"))
    results = blocks.where("ord BETWEEN 3 AND 5").select(
        (F.col("doc_id") * 10 + F.col("ord") % 3).alias("result"), "doc_id", F.when(F.col("ord") % 3 == 0, pid).alias("own"), F.when(F.col("ord") % 3 == 1, F.col("ord")).alias("block"), F.substring("text", 1, 80).alias("head"))
    ways = [("id", F.col("own") == F.col("passage")), ("block", F.array_contains("blocks", F.col("block"))), ("text", F.contains("body", F.col("head")))]
    found = results.join(passages, "doc_id").withColumn("way", F.coalesce(*[F.when(test, k) for k, (_, test) in enumerate(ways)]))
    names = F.array(*[F.lit(n) for n, _ in ways])
    return top(found.where("way IS NOT NULL"), 1, ["result"], "way", "passage").select("result", "passage", F.get(names, F.col("way")).alias("by"))


SQL_NAMES = """
ct AS (SELECT p_name AS title, min(p_partkey) AS id FROM part GROUP BY p_name),
ak AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'The ' || upper(p_name) || '!' WHEN 1 THEN p_name[:3] || p_name[5:] WHEN 2 THEN p_name[:7] ELSE reverse(p_name) END AS name FROM part),
ky AS (SELECT name, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '', 'g'), '^the(....)', '\\1') AS k FROM ak), bk AS (SELECT regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), '^the(....)', '\\1') AS b, min(id) AS id FROM ct GROUP BY ALL),
ex AS (SELECT name, id, 'exact' AS how FROM ky JOIN bk ON k = b), ot AS (SELECT * FROM ky WHERE name NOT IN (SELECT name FROM ex) AND k <> ''),
pt AS (SELECT name, min(id) AS id, 'part' AS how FROM ot JOIN bk ON contains(b, k) AND length(k) >= 5 GROUP BY name HAVING count(*) = 1),
cl AS (SELECT name, id, 'close' AS how FROM ot JOIN bk ON 1 - levenshtein(k, b)::DOUBLE / greatest(length(k), length(b)) >= 0.82::DOUBLE WHERE name NOT IN (SELECT name FROM pt)
 QUALIFY row_number() OVER (PARTITION BY name ORDER BY levenshtein(k, b)::DOUBLE / greatest(length(k), length(b)), b) = 1)
"""


@query(f"WITH {SQL_NAMES} SELECT * FROM ex UNION ALL SELECT * FROM pt UNION ALL SELECT * FROM cl")
def book_names(spark, sf_dir):
    """Names as people write them onto a catalog: with an article and marks, with a letter gone, cut short, or unknown."""
    part = table(spark, sf_dir, "part")
    n, k = F.col("p_name"), F.col("p_partkey") % 4
    said = F.when(k == 0, F.concat(F.lit("The "), F.upper(n), F.lit("!"))).when(k == 1, F.concat(F.left(n, F.lit(3)), F.substr(n, F.lit(5)))).when(k == 2, F.left(n, F.lit(7))).otherwise(F.reverse(n))
    catalog = part.groupBy(n.alias("title")).agg(F.min("p_partkey").alias("id"))
    return resolved(part.select(said.alias("name")), catalog)


@query(f"""WITH {SQL_LINES}, a AS (SELECT doc_id, min(ord) AS anchor FROM ln WHERE contains(lower(text), 'tion') GROUP BY doc_id) SELECT ln.doc_id, ord, abs(ord - anchor) <= 3 AS near FROM ln JOIN a ON a.doc_id = ln.doc_id AND ord BETWEEN anchor - 20 AND anchor + 20""")
def page_window(spark, sf_dir):
    """The blocks around the first hit of a document: twenty each way, the nearest three marked."""
    blocks = lines_of(table(spark, sf_dir, "documents"))
    anchor = blocks.where(F.lower("text").contains("tion")).groupBy("doc_id").agg(F.min("ord").alias("anchor"))
    away = F.abs(F.col("ord") - F.col("anchor"))
    return blocks.join(anchor, "doc_id").where(away <= 20).select("doc_id", "ord", (away <= 3).alias("near"))


@query("""SELECT page_id, trim(regexp_replace(regexp_extract(url, '^https?://([^/]+)', 1), '[_-]+', ' ', 'g')) AS host, CASE WHEN contains(t, ' ') THEN split_part(t, ' ', 1) ELSE t END AS title, CASE WHEN contains(t, ' ') THEN trim(substr(t, strpos(t, ' ') + 1)) ELSE '' END AS author
FROM (SELECT page_id, url, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS t FROM pages WHERE html IS NOT NULL AND url IS NOT NULL)""")
def titles_and_authors(spark, sf_dir):
    """A page's title parted at its first blank, as file names are parted at a dash."""
    t = F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    host = F.trim(F.regexp_replace(F.regexp_extract("url", "^https?://([^/]+)", 1), "[_-]+", " "))
    rows = table(spark, sf_dir, "pages").where("html IS NOT NULL AND url IS NOT NULL").select("page_id", host.alias("host"), F.split(t, " ", 2).alias("p"))
    return rows.select("page_id", "host", F.col("p")[0].alias("title"), F.trim(F.coalesce(F.get("p", F.lit(1)), F.lit(""))).alias("author"))
