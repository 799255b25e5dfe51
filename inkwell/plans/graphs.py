"""Topic and concept graphs over the lines of documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.text import tokens
from inkwell.operators import mining
from inkwell.operators.graph import cooccurrence, merged, page_rank, staged
from inkwell.operators.matching import matches, plain_tokens, prepared
from inkwell.operators.ranking import top
from inkwell.plans.registry import query
from inkwell.sources.tables import lines_of, table

#: id, group, terms; a trailing star stands for any ending
TOPICS = [
    ("motion", "verbs", ["tion", "hation", "ontion"]), ("article", "words", ["the", "la", "der"]), ("present", "verbs", ["ing*"]),
    ("other", "words", ["other*", "er"]), ("quality", "nouns", ["keit*", "heit*"]), ("relative", "words", ["that", "que"]),
]
FORMS = [(t, w) for t, _, ws in TOPICS for w in ws]
SQL_FORMS = "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{w}')" for t, w in FORMS) + ") AS f(topic, form)"
SQL_PASSAGES = r"""
ln AS (SELECT doc_id, source, lang, i - 1 AS ord, l[i] AS text FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
pa AS (SELECT doc_id * 10000000 + ord AS pid, source, lang, text, len(regexp_extract_all(text, '\S+')) AS words FROM ln WHERE len(regexp_extract_all(text, '\S+')) >= 25),
tk AS (SELECT pid, source, words, token, count(*) AS tf FROM (SELECT pid, source, words, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9'']+'), lambda x: lower(x))) AS token FROM pa) GROUP BY ALL),
th AS (SELECT pid, source, words, topic, CAST(sum(tf) AS BIGINT) AS hits FROM tk JOIN (""" + SQL_FORMS + r""") f ON (token = form OR (form LIKE '%*' AND starts_with(token, replace(form, '*', '')))) GROUP BY ALL)
"""


def passages(spark, sf_dir):
    lines = lines_of(table(spark, sf_dir, "documents"))
    found = lines.select((F.col("doc_id") * 10000000 + F.col("ord")).alias("pid"), "doc_id", "ord", "source", "lang", "text", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("words"))
    return found.where("words >= 25")


def topic_hits(spark, sf_dir):
    """(pid, source, words, topic, hits): passages are walked where they are read, only hits leave the row."""
    forms = prepared(spark.createDataFrame(FORMS, "concept string, form string"), numbers=False)
    return matches(passages(spark, sf_dir), forms, ["pid", "source", "words"], split=plain_tokens).withColumnRenamed("concept", "topic")


@query(f"WITH {SQL_PASSAGES} SELECT topic, count(*) AS passages, CAST(sum(hits) AS BIGINT) AS mentions, count(DISTINCT source) AS books FROM th GROUP BY topic")
def topic_stats(spark, sf_dir):
    return topic_hits(spark, sf_dir).groupBy("topic").agg(F.count("*").alias("passages"), F.sum("hits").alias("mentions"), F.countDistinct("source").alias("books"))


@query(f"""WITH {SQL_PASSAGES}, n AS (SELECT source, count(*) AS n FROM pa GROUP BY source)
SELECT topic, source, count(*) AS passages, round(100.0::DOUBLE * count(*) / any_value(n), 6) AS density FROM th JOIN n USING (source) GROUP BY topic, source HAVING count(*) >= 2""")
def topic_book_density(spark, sf_dir):
    books = passages(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    counts = topic_hits(spark, sf_dir).groupBy("topic", "source").agg(F.count("*").alias("passages")).where("passages >= 2")
    return counts.join(books, "source").select("topic", "source", "passages", F.round(F.lit(100.0) * F.col("passages") / F.col("n"), 6).alias("density"))


SQL_EDGES = f"""{SQL_PASSAGES},
c AS (SELECT topic, count(*)::DOUBLE AS c FROM th GROUP BY topic), n AS (SELECT count(DISTINCT pid)::DOUBLE AS n FROM th),
pr AS (SELECT x.topic AS a, y.topic AS b, count(*) AS shared FROM th x JOIN th y ON x.pid = y.pid AND x.topic < y.topic GROUP BY ALL HAVING count(*) >= 5),
ed AS (SELECT a, b, shared, ln((shared / n) / ((ca.c / n) * (cb.c / n))) / -ln(shared / n) AS npmi FROM pr JOIN c ca ON ca.topic = a JOIN c cb ON cb.topic = b, n WHERE shared < n)
"""


@query(f"WITH {SQL_EDGES} SELECT a, b, shared, round(npmi, 6) AS npmi FROM ed WHERE npmi > 0.02")
def topic_edges(spark, sf_dir):
    return cooccurrence(topic_hits(spark, sf_dir), "pid", "topic", 5, 0.02).select("a", "b", "shared", F.round("npmi", 6).alias("npmi"))


@query(f"""WITH {SQL_EDGES}, bo AS (SELECT a AS node, b AS peer, npmi FROM ed WHERE npmi > 0.02 UNION ALL SELECT b, a, npmi FROM ed WHERE npmi > 0.02)
SELECT node, peer, CAST(row_number() OVER (PARTITION BY node ORDER BY round(npmi, 6) DESC, peer) AS INTEGER) AS rank FROM bo QUALIFY rank <= 3""")
def related_topics(spark, sf_dir):
    edges = cooccurrence(topic_hits(spark, sf_dir), "pid", "topic", 5, 0.02)
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("peer"), "npmi").union(edges.select("b", "a", "npmi"))
    return top(both, 3, ["node"], F.desc(F.round("npmi", 6)), "peer").select("node", "peer", "rank")


@query(f"""WITH {SQL_PASSAGES}, s AS (SELECT topic, source, pid, round(least(hits / sqrt(words::DOUBLE), 2.5::DOUBLE) * (1 + 0.15::DOUBLE * least(hits, 6)), 6) AS score FROM th)
SELECT topic, source, pid, score, CAST(row_number() OVER (PARTITION BY topic, source ORDER BY score DESC, pid) AS INTEGER) AS rank FROM s QUALIFY rank <= 3""")
def topic_passages(spark, sf_dir):
    score = F.least(F.col("hits") / F.sqrt(F.col("words").cast("double")), F.lit(2.5)) * (1 + F.lit(0.15) * F.least("hits", F.lit(6)))
    scored = topic_hits(spark, sf_dir).select("topic", "source", "pid", F.round(score, 6).alias("score"))
    return top(scored, 3, ["topic", "source"], F.desc("score"), "pid")


@query(f"""WITH {SQL_PASSAGES}, s AS (SELECT pid, round(least(hits / sqrt(greatest(words / 60.0::DOUBLE, 1)), 3.0::DOUBLE), 6) AS score, count(*) OVER () AS total FROM th WHERE topic = 'motion')
SELECT pid, score, total FROM s ORDER BY score DESC, pid LIMIT 10 OFFSET 10""")
def passage_page(spark, sf_dir):
    """The second page of a topic's passages, with the number of all."""
    hits = topic_hits(spark, sf_dir).where("topic = 'motion'")
    score = F.least(F.col("hits") / F.sqrt(F.greatest(F.col("words") / F.lit(60.0), F.lit(1.0))), F.lit(3.0))
    total = hits.agg(F.count("*").alias("total"))
    return hits.select("pid", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "pid").offset(10).limit(10).crossJoin(F.broadcast(total))


@query(f"""WITH {SQL_PASSAGES} SELECT x.pid, CAST(least(x.hits, y.hits) AS BIGINT) AS weight FROM th x JOIN th y USING (pid) WHERE x.topic = 'motion' AND y.topic = 'present'""")
def concept_meet(spark, sf_dir):
    hits = topic_hits(spark, sf_dir)
    left, right = hits.where("topic = 'motion'").select("pid", F.col("hits").alias("h1")), hits.where("topic = 'present'").select("pid", F.col("hits").alias("h2"))
    return left.join(right, "pid").select("pid", F.least("h1", "h2").alias("weight"))


@query(f"""WITH {SQL_PASSAGES}, k AS (SELECT source, topic, count(*)::DOUBLE AS k FROM th GROUP BY ALL)
SELECT source, topic, round(k * ln(1 + (k / sum(k) OVER (PARTITION BY source)) / (sum(k) OVER (PARTITION BY topic) / sum(k) OVER ())), 6) AS over FROM k""")
def over_representation(spark, sf_dir):
    k = topic_hits(spark, sf_dir).groupBy("source", "topic").agg(F.count("*").cast("double").alias("k"))
    book, topic = k.groupBy("source").agg(F.sum("k").alias("kb")), k.groupBy("topic").agg(F.sum("k").alias("kt"))
    total = k.agg(F.sum("k").alias("ka"))
    lift = (F.col("k") / F.col("kb")) / (F.col("kt") / F.col("ka"))
    return k.join(book, "source").join(topic, "topic").crossJoin(F.broadcast(total)).select("source", "topic", F.round(F.col("k") * F.log(1 + lift), 6).alias("over"))


@query(f"WITH {SQL_PASSAGES} SELECT (SELECT count(DISTINCT topic) FROM th) AS nodes, (SELECT count(*) FROM pa) AS passages, (SELECT count(DISTINCT source) FROM pa) AS books, (SELECT count(DISTINCT lang) FROM pa) AS categories")
def corpus_stats(spark, sf_dir):
    counts = passages(spark, sf_dir).agg(F.count("*").alias("passages"), F.countDistinct("source").alias("books"), F.countDistinct("lang").alias("categories"))
    return topic_hits(spark, sf_dir).agg(F.countDistinct("topic").alias("nodes")).crossJoin(F.broadcast(counts))


SQL_GRAMS = r"""
t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9'']+'), lambda x: lower(x)) AS w FROM documents),
u AS (SELECT token, count(*)::DOUBLE AS c FROM (SELECT unnest(w) AS token FROM t) GROUP BY token),
p AS (SELECT doc_id, unnest(list_zip(w[:-2], w[2:])) AS p FROM t WHERE len(w) > 1),
g AS (SELECT p[1] AS a, p[2] AS b, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM (SELECT doc_id, p, count(*) AS n FROM p GROUP BY doc_id, p) GROUP BY p HAVING sum(n) >= 20)
"""


def bigrams(spark, sf_dir, least: int):
    """(a, b, n, docs) of adjacent tokens: pairs are made, and made distinct, inside the row, and summed within a task before the one shuffle."""
    docs = table(spark, sf_dir, "documents").select(tokens(F.col("text")).alias("w"))
    # as strings, which Spark makes distinct by a hash set; the last token has none after it and makes null
    docs = docs.select(F.array_compact(F.zip_with("w", F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))).alias("p"))
    docs = docs.where("size(p) > 0").select(F.explode(F.array(F.struct(F.col("p"), F.lit(1).alias("n")), F.struct(F.array_distinct("p").alias("p"), F.lit(0).alias("n")))).alias("g"))
    rows = docs.select(F.explode("g.p").alias("pair"), F.col("g.n").alias("n"))
    found = rows.groupBy("pair").agg(F.sum("n").alias("n"), F.sum(1 - F.col("n")).alias("docs")).where(F.col("n") >= least)
    return found.select(F.substring_index("pair", " ", 1).alias("a"), F.substring_index("pair", " ", -1).alias("b"), "n", "docs")


@query(f"WITH {SQL_GRAMS} SELECT a, b, n, docs FROM g")
def ngram_counts(spark, sf_dir):
    return bigrams(spark, sf_dir, 20)


@query(f"""WITH {SQL_GRAMS}, m AS (SELECT sum(c) AS total FROM u)
SELECT a, b, n, round(ln((n / total) / ((x.c / total) * (y.c / total))), 6) AS pmi FROM g JOIN u x ON x.token = a JOIN u y ON y.token = b, m WHERE docs >= 5""")
def collocations(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").cast("double").alias("c"))
    total = words.agg(F.sum("c").alias("total"))
    pairs = bigrams(spark, sf_dir, 20).where("docs >= 5")
    both = pairs.join(words.select(F.col("token").alias("a"), F.col("c").alias("ca")), "a").join(words.select(F.col("token").alias("b"), F.col("c").alias("cb")), "b").crossJoin(F.broadcast(total))
    return both.select("a", "b", "n", F.round(F.log((F.col("n") / F.col("total")) / (F.col("ca") / F.col("total") * (F.col("cb") / F.col("total")))), 6).alias("pmi"))


@query(f"""WITH {SQL_GRAMS}, h AS (SELECT p[1] AS a, p[2] AS b, p[3] AS c, count(*) AS n3 FROM (SELECT unnest(list_zip(w[:-3], w[2:-2], w[3:])) AS p FROM t WHERE len(w) > 2) GROUP BY p HAVING count(*) >= 20)
SELECT a, b, n FROM g WHERE NOT EXISTS (SELECT 1 FROM h WHERE ((h.a = g.a AND h.b = g.b) OR (h.b = g.a AND h.c = g.b)) AND h.n3 >= 0.8 * g.n)""")
def fragment_free(spark, sf_dir):
    """Pairs that are not merely part of a triple that is about as frequent."""
    docs = table(spark, sf_dir, "documents")
    words = staged(mining.word_counts(docs, "text", plain_tokens), "words")
    grams = mining.counted_grams(docs, "text", plain_tokens, words, 20, 3)
    if grams is None:
        grams = mining.string_grams(docs.select(F.lit("").alias("book"), tokens(F.col("text")).alias("w")), "book", [], 20, 3)
    grams = staged(grams.select("words", "count", *[F.get("parts", F.lit(k)).alias(c) for k, c in enumerate("abc")]), "grams")
    triples = grams.where("words = 3").withColumnRenamed("count", "n3")
    parts = triples.select("a", "b", "n3").union(triples.select("b", "c", "n3")).groupBy("a", "b").agg(F.max("n3").alias("n3"))
    pairs = grams.where("words = 2").select("a", "b", F.col("count").alias("n")).join(parts, ["a", "b"], "left")
    return pairs.where((F.col("n3") < 0.8 * F.col("n")) | F.col("n3").isNull()).select("a", "b", "n")


@query(f"""WITH {SQL_GRAMS} SELECT a, b, n, kind FROM (SELECT a, b, n, CASE WHEN length(a) <= 3 THEN 'short' ELSE 'long' END AS kind FROM g)
QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, a, b) <= CASE kind WHEN 'short' THEN 50 ELSE 38 END""")
def kind_quotas(spark, sf_dir):
    kinds = bigrams(spark, sf_dir, 20).withColumn("kind", F.when(F.length("a") <= 3, "short").otherwise("long"))
    ranked = kinds.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "a", "b"))).where("r <= 50")  # a kind's first fifty are all that is shuffled
    return ranked.where(F.col("r") <= F.when(F.col("kind") == "short", 50).otherwise(38)).select("a", "b", "n", "kind")


@query(f"""WITH {SQL_PASSAGES} SELECT source, lang AS category, n FROM (SELECT source, lang, count(*) AS n FROM pa GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1""")
def book_category(spark, sf_dir):
    """A book's category: the most frequent one of its passages."""
    counts = passages(spark, sf_dir).groupBy("source", F.col("lang").alias("category")).agg(F.count("*").alias("n"))
    return top(counts, 1, ["source"], F.desc("n"), "category").drop("rank")


@query()
def merged_groups(spark, sf_dir):
    """Union-find over links between keys: every key with the smallest it is connected with.

    All lineitems are one component nearly, for which SQL's closure is too slow: tested against union-find."""
    lines = table(spark, sf_dir, "lineitem")
    return merged(lines.select(F.col("l_partkey").alias("a"), (F.lit(100000000) + F.col("l_suppkey")).alias("b")))


@query()
def concept_rank(spark, sf_dir):
    """PageRank over the topic graph; iterative, so its rows are tested against a plain version."""
    edges = cooccurrence(topic_hits(spark, sf_dir), "pid", "topic", 2, -1.0).select("a", "b", (F.col("npmi") + 1).alias("weight"))
    return page_rank(edges)


@query("""WITH t AS (SELECT doc_id, source, unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9'']+'), lambda x: lower(x)))) AS label FROM documents),
n AS (SELECT label, count(DISTINCT source) AS books FROM t GROUP BY label HAVING count(*) >= 5)
SELECT label, CAST(CASE WHEN label = 'the' THEN 3 WHEN starts_with(label, 'the') THEN 2 ELSE 1 END AS INTEGER) AS score, books FROM n WHERE contains(label, 'the')""")
def label_search(spark, sf_dir, asked: str = "the", least: int = 5):
    """The corpus's own terms as labels: those that hold what is asked, the same one before its extensions."""
    words = table(spark, sf_dir, "documents").select("source", F.explode(F.array_distinct(tokens(F.col("text")))).alias("label")).where(F.col("label").contains(asked))
    labels = words.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("source").alias("books")).where(F.col("n") >= least)
    score = F.when(F.col("label") == asked, 3).when(F.col("label").startswith(asked), 2).otherwise(1)
    return labels.select("label", score.alias("score"), "books")
