"""Concepts over passages: peers, places, scopes, votes, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions.text import ascii_edges
from inkwell.operators import concepts as cn
from inkwell.operators.graph import cooccurrence
from inkwell.operators.ranking import top
from inkwell.plans.graphs import SQL_EDGES, SQL_PASSAGES, topic_hits
from inkwell.plans.registry import query
from inkwell.sources.tables import lines_of, table

SQL_PEERS = f"""{SQL_EDGES.replace("count(*) >= 5", "count(*) >= 2")}, bo AS (SELECT a AS node, b AS peer, shared, npmi FROM ed WHERE npmi > 0.02 UNION ALL SELECT b, a, shared, npmi FROM ed WHERE npmi > 0.02)"""


@query(f"""WITH {SQL_PEERS}, s AS (SELECT node, peer, shared, round(npmi * (1 + 0.15::DOUBLE * ln(1 + shared::DOUBLE)), 6) AS strength FROM bo)
SELECT node, peer, shared, strength, CAST(row_number() OVER (PARTITION BY node ORDER BY strength DESC, peer) AS INTEGER) AS rank FROM s QUALIFY rank <= 800""")
def concept_peers(spark, sf_dir):
    return cn.peers(topic_hits(spark, sf_dir), "pid", "topic")


@query(f"""WITH {SQL_EDGES}, e AS (SELECT a, b, round(npmi, 6) AS weight FROM ed WHERE npmi > 0.02), x AS (SELECT a, b, weight, a AS n FROM e UNION ALL SELECT a, b, weight, b FROM e)
SELECT DISTINCT a, b, weight FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY n ORDER BY weight DESC, a, b) <= 2)""")
def strongest_topic_edges(spark, sf_dir):
    """Edges among the two strongest of either topic."""
    edges = cooccurrence(topic_hits(spark, sf_dir), "pid", "topic", 5, 0.02).select("a", "b", F.round("npmi", 6).alias("weight"))
    return cn.strongest_edges(edges, 2)


@query(f"""WITH {SQL_PASSAGES}, c AS (SELECT topic, source AS book, pid // 10000000 AS chapter, count(*) AS "count" FROM th GROUP BY ALL), b AS (SELECT topic, book, CAST(sum("count") AS BIGINT) AS in_book FROM c GROUP BY ALL),
k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY topic ORDER BY "count" DESC, book, chapter) <= 150) SELECT topic, book, chapter, "count", in_book FROM k JOIN b USING (topic, book)""")
def concept_places(spark, sf_dir):
    """The chapters (documents) where a concept occurs most, with its count in the book (source)."""
    hits = topic_hits(spark, sf_dir).select("topic", F.col("source").alias("book"), F.floor(F.col("pid") / 10000000).cast("long").alias("chapter"))
    return cn.places(hits, "topic", "book", "chapter")


@query(f"WITH {SQL_PASSAGES} SELECT topic, source, pid // 10000000 AS doc_id, count(*) AS passages FROM th GROUP BY ALL")
def topic_sections(spark, sf_dir):
    """Passages of a topic by book and by section in one pass: documents stand for sections."""
    hits = topic_hits(spark, sf_dir).withColumn("doc_id", F.floor(F.col("pid") / 10000000).cast("long"))
    return hits.groupBy("topic", "source", "doc_id").agg(F.count("*").alias("passages"))


@query(f"""WITH {SQL_PASSAGES}, l AS (SELECT pid, lang FROM pa WHERE lang IN ('en', 'fr'))
SELECT topic, count(*) AS passages, CAST(sum(hits) AS BIGINT) AS mentions FROM th JOIN l USING (pid) GROUP BY topic""")
def scoped_topics(spark, sf_dir, categories=("en", "fr")):
    """Topics within some categories."""
    books = cn.in_scope(table(spark, sf_dir, "documents").select("doc_id", "lang"), list(categories), "lang")
    hits = topic_hits(spark, sf_dir).withColumn("doc_id", F.floor(F.col("pid") / 10000000).cast("long"))
    return hits.join(books, "doc_id").groupBy("topic").agg(F.count("*").alias("passages"), F.sum("hits").alias("mentions"))


@query(f"""WITH {SQL_PASSAGES}, f AS (SELECT pid, topic, row_number() OVER (PARTITION BY pid ORDER BY hits DESC, topic) AS n FROM th)
SELECT pid // 10000000 AS doc_id, topic, count(*) AS votes FROM f WHERE n <= 4 GROUP BY ALL""")
def topic_votes(spark, sf_dir):
    """What the passages of a document vote for: each for its first four topics."""
    firsts = top(topic_hits(spark, sf_dir), 4, ["pid"], F.desc("hits"), "topic")
    return firsts.groupBy(F.floor(F.col("pid") / 10000000).cast("long").alias("doc_id"), "topic").agg(F.count("*").alias("votes"))


TOPIC_PATTERNS = {"motion": r"\b\w*(?:tion|ontion)\b", "present": r"\b\w+ing\b", "quality": r"\b\w+(?:keit|heit)\b"}
TOPIC_WORDS = {"motion": ["mot", "que"], "present": ["pre", "der"], "quality": ["qual", "und"]}


@query("WITH t AS (SELECT conv_id, turn, text, lower(text) AS low FROM conversations), m AS (" + " UNION ALL ".join(f"SELECT conv_id, turn, '{t}' AS topic, regexp_matches(low, '{p}') AS hit, " + " OR ".join(f"contains(low, '{w}')" for w in TOPIC_WORDS[t]) + " AS word FROM t" for t, p in TOPIC_PATTERNS.items())
       + "), a AS (SELECT *, bool_or(hit) OVER (PARTITION BY conv_id, turn) AS matched FROM m) SELECT conv_id, turn, topic FROM a WHERE hit OR (NOT matched AND word)")
def topics_of_turns(spark, sf_dir):
    """A text's topics by their patterns; by plain words only if no pattern is found."""
    low = F.lower("text")
    pattern = F.array_compact(F.array(*[F.when(low.rlike(ascii_edges(p)), t) for t, p in TOPIC_PATTERNS.items()]))
    word = F.array_compact(F.array(*[F.when(F.greatest(*[low.contains(w) for w in ws]), t) for t, ws in TOPIC_WORDS.items()]))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", pattern.alias("p"), word.alias("w"))
    return turns.select("conv_id", "turn", F.explode(F.when(F.size("p") > 0, F.col("p")).otherwise(F.col("w"))).alias("topic"))


@query("""WITH l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS ord, regexp_replace(trim(regexp_replace(l[i], '\\s+', ' ', 'g')), '\\s*\\([^)]*\\)', '', 'g') AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE length(trim(l[i])) BETWEEN 1 AND 80),
c AS (SELECT doc_id, ord, regexp_replace(t, '^[''"“”‘’ ]+|[.,;:·''"“”‘’ ]+$', '', 'g') AS label FROM l), k AS (SELECT *, list_filter(regexp_extract_all(lower(label), '[a-z0-9]+'), lambda w: w NOT IN ('the', 'a', 'an', 'this', 'that', 'our', 'of', 'to', 'and', '&')) AS w FROM c WHERE label <> '')
SELECT doc_id, ord, label, array_to_string(list_transform(w, lambda x: CASE WHEN x LIKE '%ss' THEN x WHEN x LIKE '%ing' AND length(x) >= 6 THEN x[:-4] WHEN x LIKE '%ies' AND length(x) >= 5 THEN x[:-4] || 'y' WHEN x LIKE '%es' AND length(x) >= 6 THEN x[:-3] WHEN x LIKE '%s' AND length(x) >= 4 THEN x[:-2] WHEN x LIKE '%ed' AND length(x) >= 6 THEN x[:-3] ELSE x END), ' ') AS key FROM k""")
def label_keys(spark, sf_dir):
    """Short lines as labels, with the key that unites their variants."""
    lines = lines_of(table(spark, sf_dir, "documents")).where("length(trim(text)) <= 80").select("doc_id", "ord", cn.clean_label(F.col("text")).alias("label"))
    bare = lines.where(~F.col("label").rlike(r"^['\"“”‘’ .,;:·]*$"))
    return bare.select("doc_id", "ord", "label", cn.merge_key(F.col("label")).alias("key"))


@query("""WITH w AS (SELECT DISTINCT unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9'']+'), lambda x: lower(x))) AS token FROM documents)
SELECT token, regexp_matches(token, '[0-9]|\\b(?:ibid|doi|pp?|vol|ed|eds|isbn|www|http)\\b') AS junk FROM w""")
def junk_terms(spark, sf_dir):
    """Terms that can be no concept."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.expr("transform(regexp_extract_all(text, \"[A-Za-z0-9']+\", 0), x -> lower(x))")).alias("token")).distinct()
    return words.select("token", cn.junk(F.col("token")).alias("junk"))
