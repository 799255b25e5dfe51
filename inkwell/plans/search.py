"""Keyword and vector search."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.text import tokens
from inkwell.operators.graph import staged
from inkwell.operators.ranking import bm25, diversified, fused, postings, quantized, top
from inkwell.operators.retrieval import STOP_WORDS, asked_terms, batch_top, best_window, frequent_words, fresh, hybrid, merged_results
from inkwell.operators.vectors import nearest_products, nearest_rows
from inkwell.plans.registry import query
from inkwell.sources.tables import lines_of, table

ASKED = {"q1": ["the", "ering", "onthe"], "q2": ["der", "und", "keit"], "q3": ["que", "de", "ciones"]}
SQL_ASKED = "SELECT * FROM (VALUES " + ", ".join(f"('{q}', '{t}')" for q, ts in ASKED.items() for t in ts) + ") AS v(qid, token)"
SQL_BM25 = f"""
q AS ({SQL_ASKED}),
t AS (SELECT doc_id, lang, list_transform(regexp_extract_all(text, '[A-Za-z0-9'']+'), lambda x: lower(x)) AS w FROM documents),
p AS (SELECT doc_id, token, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(w) AS token FROM t) GROUP BY ALL),
l AS (SELECT doc_id, greatest(len(w), 1)::DOUBLE AS len FROM t), s AS (SELECT count(*)::DOUBLE AS n, avg(len) AS avgdl FROM l),
d AS (SELECT token, count(*)::DOUBLE AS df FROM p GROUP BY token),
b AS (SELECT qid, doc_id, sum(ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE
   / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl))) AS score
   FROM p JOIN q USING (token) JOIN d USING (token) JOIN l USING (doc_id), s GROUP BY qid, doc_id)
"""


def asked(spark):
    return spark.createDataFrame([(q, t) for q, ts in ASKED.items() for t in ts], "qid string, token string")


@query(f"""WITH {SQL_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM b)
SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def bm25_top10(spark, sf_dir):
    scored = bm25(table(spark, sf_dir, "documents"), asked(spark)).withColumn("score", F.round("score", 6))
    return top(scored, 10, ["qid"], F.desc("score"), "doc_id").select("qid", "doc_id", "score", "rank")


@query("""WITH t AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9'']+'), lambda x: lower(x))) AS token FROM documents)
SELECT token, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY token""")
def inverted_index(spark, sf_dir):
    return postings(table(spark, sf_dir, "documents")).groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(f"""WITH {SQL_BM25.replace("FROM documents)", "FROM documents WHERE lang IN ('en', 'fr'))")}
SELECT qid, doc_id, round(score, 6) AS score FROM b WHERE score >= 0.5 * (SELECT max(x.score) FROM b x WHERE x.qid = b.qid)""")
def bm25_scope_ratio(spark, sf_dir):
    """Search within categories, then only scores of half the best or more."""
    docs = table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "fr"))
    scored = bm25(docs, asked(spark))
    best = F.max("score").over(Window.partitionBy("qid"))
    return scored.withColumn("best", best).where(F.col("score") >= 0.5 * F.col("best")).select("qid", "doc_id", F.round("score", 6).alias("score"))


@query("""WITH b AS (SELECT doc_id, i - 1 AS ord, l[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
m AS (SELECT doc_id, ord, len(regexp_extract_all(text, '\\S+')) AS words, len(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9'']+'), lambda x: lower(x)), lambda x: x = 'onthe' OR x = 'ering')) AS tf FROM b WHERE length(text) >= 80),
h AS (SELECT * FROM m WHERE tf > 0), n AS (SELECT (SELECT count(*) FROM m)::DOUBLE AS n, (SELECT count(*) FROM h)::DOUBLE AS df)
SELECT doc_id, CAST(ord AS INTEGER) AS ord, round((1 + ln(tf::DOUBLE)) * ln(1 + n / df) / sqrt(words / 60.0::DOUBLE + 1), 6) AS score FROM h, n""")
def tfidf_paragraphs(spark, sf_dir):
    lines = lines_of(table(spark, sf_dir, "documents")).where(F.length("text") >= 80)
    tf = F.size(F.filter(tokens(F.col("text")), lambda x: x.isin("onthe", "ering")))
    counted = lines.select("doc_id", "ord", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("words"), tf.alias("tf"))
    stats = counted.agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("tf") > 0).cast("double").alias("df"))
    score = (1 + F.log(F.col("tf").cast("double"))) * F.log(1 + F.col("n") / F.col("df")) / F.sqrt(F.col("words") / F.lit(60.0) + 1)
    return counted.where("tf > 0").crossJoin(F.broadcast(stats)).select("doc_id", "ord", F.round(score, 6).alias("score"))


SQL_KNN = """
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
k AS (SELECT a.vec_id AS qid, b.vec_id AS vec_id, a.label AS qlabel, b.label, round(list_cosine_similarity(a.v, b.v), 9) AS sim FROM e a, e b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS rank FROM k)
"""


def nearest(spark, sf_dir, k: int):
    """Exact neighbours of a stated query set against all rows, in blocks."""
    rows = table(spark, sf_dir, "embeddings")
    found = nearest_rows(rows, rows.where("vec_id % 20 = 0"), k)
    label = rows.select("vec_id", "label")
    return found.join(label, "vec_id").join(label.select(F.col("vec_id").alias("qid"), F.col("label").alias("qlabel")), "qid")


@query(f"WITH {SQL_KNN} SELECT qid, vec_id, sim, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8")
def knn_cosine(spark, sf_dir):
    return nearest(spark, sf_dir, 8).select("qid", "vec_id", "sim", "rank")


@query(f"""WITH {SQL_KNN}, h AS (SELECT qid, qlabel, rank, label = qlabel AS hit FROM r WHERE rank <= 8)
SELECT qlabel AS kind, round(avg(CASE WHEN a4 THEN 1.0::DOUBLE ELSE 0 END), 6) AS any_at_4, round(avg(f8), 6) AS share_at_8 FROM
(SELECT qid, qlabel, bool_or(hit AND rank <= 4) AS a4, avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END) AS f8 FROM h GROUP BY ALL) GROUP BY qlabel""")
def recall_by_kind(spark, sf_dir):
    """Any-hit and fraction recall over ranked neighbours, by kind of query."""
    hit = nearest(spark, sf_dir, 8).withColumn("hit", F.col("label") == F.col("qlabel"))
    per = hit.groupBy("qid", "qlabel").agg(
        F.max((F.col("hit") & (F.col("rank") <= 4)).cast("double")).alias("a4"), F.avg(F.col("hit").cast("double")).alias("f8")
    )
    return per.groupBy(F.col("qlabel").alias("kind")).agg(F.round(F.avg("a4"), 6).alias("any_at_4"), F.round(F.avg("f8"), 6).alias("share_at_8"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT vec_id, list_transform(v, lambda x: CAST(round_even(x / sqrt(list_sum(list_transform(v, lambda y: y * y))) * 127.0::DOUBLE, 0) AS INTEGER)) AS q FROM e)
SELECT vec_id, CAST(list_sum(list_transform(q, lambda x: x * x)) AS BIGINT) AS norm2, CAST(q[1] AS INTEGER) AS first, CAST(list_max(q) AS INTEGER) AS largest, array_to_string(q, ',') AS codes FROM u""")
def int8_pack(spark, sf_dir):
    q = table(spark, sf_dir, "embeddings").select("vec_id", quantized(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x * x).alias("norm2"), F.col("q")[0].alias("first"), F.array_max("q").alias("largest"), F.array_join(F.transform("q", lambda x: x.cast("string")), ",").alias("codes"))


TERMS = 5  # words a query asks for: the most frequent of its document
SQL_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
SQL_INDEX = SQL_BM25.split("),\n", 1)[1]
SQL_BATCH = f"""
q AS (SELECT doc_id AS qid, token FROM (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9'']+'), lambda x: lower(x))) AS token FROM documents WHERE doc_id % 20 = 0)
 WHERE length(token) > 2 AND token NOT IN ({SQL_STOP}) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, token) <= {TERMS}),
{SQL_INDEX}"""
SQL_SIDES = f"""{SQL_BATCH}, {SQL_KNN},
sem AS (SELECT qid, vec_id AS doc_id, greatest(sim, 0) AS sem, rank FROM r WHERE rank <= 100),
kr AS (SELECT qid, doc_id, round(score, 6) AS kw, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM b WHERE doc_id <> qid), kw AS (SELECT * FROM kr WHERE rank <= 100)
"""


def batch(spark, sf_dir):
    """(qid, token): every document whose id is divisible by 20 asks for its most frequent words."""
    asking = table(spark, sf_dir, "documents").where("doc_id % 20 = 0")
    return frequent_words(asking, TERMS).withColumnRenamed("doc_id", "qid")


def keyword_side(spark, sf_dir, k: int = 100, common: int | None = None):
    found = batch_top(table(spark, sf_dir, "documents"), batch(spark, sf_dir), k, common=common)
    return found.select("qid", "doc_id", F.col("score").alias("kw"), "rank")


def semantic_side(spark, sf_dir, k: int = 100):
    return nearest(spark, sf_dir, k).select("qid", F.col("vec_id").alias("doc_id"), F.greatest("sim", F.lit(0.0)).alias("sem"), "rank")


@query(f"""WITH {SQL_SIDES}, f AS (SELECT coalesce(sem.qid, kw.qid) AS qid, coalesce(sem.doc_id, kw.doc_id) AS doc_id, coalesce(sem, 0) AS sem, coalesce(kw, 0) AS kw FROM sem FULL JOIN kw ON sem.doc_id = kw.doc_id AND sem.qid = kw.qid),
g AS (SELECT *, max(sem) OVER (PARTITION BY qid) AS ms, max(kw) OVER (PARTITION BY qid) AS mk FROM f)
SELECT qid, g.doc_id, round((CASE WHEN ms > 0 THEN 0.7::DOUBLE * sem / ms ELSE 0 END + CASE WHEN mk > 0 THEN 0.3::DOUBLE * kw / mk ELSE 0 END) * CASE WHEN d.lang = 'en' THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score
FROM g JOIN documents d ON d.doc_id = g.doc_id""")
def hybrid_score(spark, sf_dir):
    """Semantic and keyword candidates (the best hundred each) of a query batch, each side by its best, with a category boost."""
    found = hybrid(semantic_side(spark, sf_dir).drop("rank"), keyword_side(spark, sf_dir).drop("rank"))
    boost = F.when(F.col("lang") == "en", 1.1).otherwise(1.0)
    return found.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("qid", "doc_id", F.round(F.col("score") * boost, 6).alias("score"))


@query(f"""WITH {SQL_SIDES} SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf FROM (SELECT qid, doc_id, rank FROM sem UNION ALL SELECT qid, doc_id, rank FROM kw) GROUP BY ALL""")
def rank_fusion(spark, sf_dir):
    """Reciprocal ranks of both sides of the query batch, summed."""
    return fused([semantic_side(spark, sf_dir), keyword_side(spark, sf_dir)], "doc_id").select("qid", "doc_id", F.round("rrf", 9).alias("rrf"))


COMMON = 60
SQL_RARE = f"""{SQL_BATCH}, rr AS (SELECT qid, token, df <= {COMMON} AS rare FROM q JOIN d USING (token)), sm AS (SELECT qid, bool_or(rare) AS anyrare FROM rr GROUP BY qid),
hd AS (SELECT DISTINCT qid, doc_id FROM p JOIN rr USING (token) WHERE rare)"""


@query(f"""WITH {SQL_RARE}, k AS (SELECT b.qid, b.doc_id, round(score, 6) AS score FROM b JOIN sm USING (qid) LEFT JOIN hd ON hd.qid = b.qid AND hd.doc_id = b.doc_id WHERE (hd.doc_id IS NOT NULL OR NOT anyrare) AND b.doc_id <> b.qid)
SELECT qid, doc_id, score AS kw, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM k QUALIFY rank <= 20""")
def rare_first(spark, sf_dir):
    """Keyword search in which common words count only for documents that hold a rarer one of the query."""
    return keyword_side(spark, sf_dir, 20, COMMON)


@query(f"""WITH {SQL_SIDES}, kn AS (SELECT qid, doc_id FROM sem WHERE rank <= 20)
SELECT kw.qid, kw.doc_id, CAST(row_number() OVER (PARTITION BY kw.qid ORDER BY kw DESC, kw.doc_id) AS INTEGER) AS rank FROM kw LEFT JOIN kn ON kn.qid = kw.qid AND kn.doc_id = kw.doc_id WHERE kw.rank <= 20 AND kn.doc_id IS NULL QUALIFY rank <= 2""")
def fresh_results(spark, sf_dir):
    """Two results of a second search that the first one did not bring."""
    known, found = semantic_side(spark, sf_dir, 20), keyword_side(spark, sf_dir, 20).drop("rank")
    return fresh(known, found, ["doc_id"], 2, F.desc("kw"), "doc_id").select("qid", "doc_id", "rank")


@query(f"""WITH {SQL_SIDES}, a AS (SELECT qid, doc_id, rank FROM sem WHERE rank <= 5), n AS (SELECT qid, count(*) AS n FROM a GROUP BY qid),
z AS (SELECT kw.qid, kw.doc_id, coalesce(n, 0) + row_number() OVER (PARTITION BY kw.qid ORDER BY kw.rank) AS rank FROM kw LEFT JOIN n ON n.qid = kw.qid LEFT JOIN a ON a.qid = kw.qid AND a.doc_id = kw.doc_id WHERE kw.rank <= 20 AND a.doc_id IS NULL)
SELECT qid, doc_id, CAST(rank AS INTEGER) AS rank FROM (SELECT * FROM a UNION ALL SELECT * FROM z WHERE rank <= 12)""")
def merged_lists(spark, sf_dir):
    """One list whole, then what a second one adds, twelve in all."""
    return merged_results(semantic_side(spark, sf_dir, 5), keyword_side(spark, sf_dir, 20), ["doc_id"], 12).select("qid", "doc_id", "rank")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT vec_id, list_transform(v, lambda x: CAST(round_even(x / sqrt(list_sum(list_transform(v, lambda y: y * y))) * 127.0::DOUBLE, 0) AS INTEGER)) AS q FROM e)
SELECT a.vec_id AS qid, b.vec_id, CAST(list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[]) AS BIGINT) AS score, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[]) DESC, b.vec_id) AS INTEGER) AS rank
FROM u a JOIN u b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id QUALIFY rank <= 8""")
def int8_nearest(spark, sf_dir, k: int = 8):
    """Exact neighbours by the dot product of packed vectors, in whole numbers."""
    packed = table(spark, sf_dir, "embeddings").select("vec_id", quantized(F.col("embedding")).cast("array<double>").alias("q"))
    packed = staged(packed, "packed")  # products of whole numbers of this size are exact in doubles
    asking = staged(packed.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid"), "asked")
    return nearest_products(packed, asking, k, "vec_id", "q", 0).select("qid", "vec_id", F.col("sim").cast("long").alias("score"), "rank")


@query(f"""WITH t AS (SELECT item_id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9'']+'), lambda x: lower(x)), lambda x: length(x) > 2 AND x NOT IN ({SQL_STOP})) AS w FROM benchmark)
SELECT item_id, token, count(*) > 0 AS asked FROM (SELECT item_id, unnest(w) AS token FROM t) GROUP BY ALL""")
def question_terms(spark, sf_dir):
    """The words that questions look for."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(asked_terms(F.col("text"))).alias("token")).withColumn("asked", F.lit(True))


@query(f"""WITH {SQL_SIDES}, ql AS (SELECT qid, list(token) AS terms FROM q GROUP BY qid), x AS (SELECT kw.qid, kw.doc_id, lower(d.text) AS low, terms FROM kw JOIN documents d USING (doc_id) JOIN ql ON ql.qid = kw.qid WHERE rank <= 3),
w AS (SELECT qid, doc_id, low, terms, unnest(range(0, length(low), 50)) AS start FROM x), h AS (SELECT qid, doc_id, start, len(list_filter(terms, lambda t: contains(substr(low, start + 1, 125), t))) AS hits FROM w)
SELECT qid, doc_id, CAST(start AS INTEGER) AS start, CAST(hits AS INTEGER) AS hits FROM h QUALIFY row_number() OVER (PARTITION BY qid, doc_id ORDER BY hits DESC, start) = 1""")
def query_windows(spark, sf_dir):
    """Where the words of a query lie closest in its three best documents."""
    terms = batch(spark, sf_dir).groupBy("qid").agg(F.collect_list("token").alias("terms"))  # TERMS of a query
    rows = keyword_side(spark, sf_dir, 3).join(terms, "qid").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("qid", "doc_id", best_window(F.col("text"), F.col("terms")).alias("w")).select("qid", "doc_id", "w.start", "w.hits")


@query("""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9'']+'), lambda x: lower(x)) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM t WHERE list_contains(w, 'in') AND list_contains(w, 'the'))
SELECT doc_id, count(*) AS hits FROM p WHERE w[i] = 'in' AND w[i + 1] = 'the' GROUP BY doc_id""")
def phrase_hits(spark, sf_dir):
    """Documents with a phrase: those with all its tokens first, then the adjacent places."""
    docs = table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("w"))
    both = docs.where(F.array_contains("w", "in") & F.array_contains("w", "the"))
    pairs = F.zip_with("w", F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))), lambda a, b: (a == "in") & (b == "the"))
    hits = F.size(F.filter(pairs, lambda x: x))
    return both.select("doc_id", hits.cast("long").alias("hits")).where("hits > 0")


@query("""WITH t AS (SELECT unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9'']+'), lambda x: lower(x))) AS token FROM documents)
SELECT token, count(*) AS n FROM t WHERE token LIKE 'ther%' GROUP BY token""")
def prefix_terms(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(tokens(F.col("text"))).alias("token"))
    return words.where(F.col("token").startswith("ther")).groupBy("token").agg(F.count("*").alias("n"))


@query()
def diverse_results(spark, sf_dir):
    """The hundred best documents of each asked list, picked by length bucket and source."""
    docs = table(spark, sf_dir, "documents")
    ranked = top(bm25(docs, asked(spark)).withColumn("score", F.round("score", 6)), 100, ["qid"], F.desc("score"), "doc_id")
    bucket = F.when(F.col("n_chars") < 800, "small").when(F.col("n_chars") < 3000, "medium").otherwise("large")
    rows = ranked.join(docs.select("doc_id", "source", bucket.alias("bucket"), F.md5(F.substring("text", 1, 80).cast("binary")).alias("context")), "doc_id")
    return diversified(rows.withColumnRenamed("doc_id", "key"), 8, 2, ["small", "medium", "large"])
