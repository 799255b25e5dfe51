"""Building and checking training and evaluation sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions.text import tokens
from inkwell.operators.graph import staged
from inkwell.operators.ranking import top
from inkwell.operators.training import first_by_hash
from inkwell.operators.contain import contained
from inkwell.plans.registry import query
from inkwell.sources.tables import lines_of, table

SQL_BLOCKS = """
ln AS (SELECT doc_id, source, lang, CAST(i - 1 AS INTEGER) AS ord, l[i] AS text FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE length(trim(l[i])) > 0),
go AS (SELECT l.doc_id, l.ord, min(b.item_id) AS item_id FROM ln l JOIN (SELECT item_id, unnest(string_split(text, chr(10))) AS text FROM benchmark) b ON trim(l.text) = trim(b.text) AND length(trim(b.text)) > 20 GROUP BY ALL)
"""


def blocks(spark, sf_dir):
    return lines_of(table(spark, sf_dir, "documents"))


def gold(spark, sf_dir):
    """(doc_id, ord, item_id): blocks that are lines of benchmark items."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", "\n")).alias("key")).select("item_id", F.trim("key").alias("key")).where("length(key) > 20")
    lines = blocks(spark, sf_dir).select("doc_id", "ord", F.trim("text").alias("key"))
    return lines.join(items, "key").groupBy("doc_id", "ord").agg(F.min("item_id").alias("item_id"))


@query(f"WITH {SQL_BLOCKS} SELECT source, count(*) AS blocks FROM ln WHERE NOT EXISTS (SELECT 1 FROM go WHERE go.doc_id = ln.doc_id AND go.ord = ln.ord) GROUP BY source")
def leak_free(spark, sf_dir):
    """Blocks that are no gold of the evaluation, by document and block together."""
    return blocks(spark, sf_dir).join(gold(spark, sf_dir), ["doc_id", "ord"], "left_anti").groupBy("source").agg(F.count("*").alias("blocks"))


@query(f"WITH {SQL_BLOCKS} SELECT doc_id, ord, item_id FROM go")
def leaks(spark, sf_dir):
    return gold(spark, sf_dir)


@query(f"WITH {SQL_BLOCKS} SELECT count(*) AS left_over FROM ln WHERE NOT EXISTS (SELECT 1 FROM go WHERE go.doc_id = ln.doc_id AND abs(go.ord - ln.ord) <= 2)")
def far_from_gold(spark, sf_dir):
    """Blocks more than two away from every gold block of their document."""
    around = gold(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.col("ord") - 2, F.col("ord") + 2)).alias("ord")).distinct()
    return blocks(spark, sf_dir).join(around, ["doc_id", "ord"], "left_anti").agg(F.count("*").alias("left_over"))


SQL_SHINGLES = """
sh AS (SELECT doc_id, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] || ' ' || w[i+5] || ' ' || w[i+6] || ' ' || w[i+7] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9'']+'), lambda x: lower(x)) AS w FROM documents))),
bs AS (SELECT DISTINCT item_id, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] || ' ' || w[i+5] || ' ' || w[i+6] || ' ' || w[i+7] AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT item_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9'']+'), lambda x: lower(x)) AS w FROM benchmark)))
"""


def shingles(rows, key: str, n: int):
    """(key, g): runs of n tokens as hashes, made inside the row."""
    w = rows.select(key, tokens(F.col("text")).alias("w")).where(F.size("w") >= n)
    parts = [F.slice("w", F.lit(k + 1), F.greatest(F.size("w") - (n - 1), F.lit(0))) for k in range(n)]
    zipped = F.arrays_zip(*[p.alias(f"t{k}") for k, p in enumerate(parts)])
    return w.select(key, F.explode(zipped).alias("z")).select(key, F.xxhash64(*[F.col(f"z.t{k}") for k in range(n)]).alias("g"))


@query(f"WITH {SQL_SHINGLES} SELECT doc_id, item_id, count(DISTINCT g) AS shared FROM sh JOIN bs USING (g) GROUP BY ALL HAVING count(DISTINCT g) >= 3")
def overlap_with_benchmark(spark, sf_dir):
    """Documents that share three or more runs of eight tokens with a benchmark item. The items' runs
    are the small side of the join; a document's runs are made distinct before they are sent."""
    items = shingles(table(spark, sf_dir, "benchmark"), "item_id", 8).distinct()
    runs = shingles(table(spark, sf_dir, "documents"), "doc_id", 8)
    return runs.join(items, "g").groupBy("doc_id", "item_id").agg(F.countDistinct("g").alias("shared")).where("shared >= 3")


SQL_SPLIT = """
sp AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS n, count(*) OVER (PARTITION BY lang) AS size FROM documents)
"""


def split(spark, sf_dir):
    """2 % of each group of 50 or more for validation, one at least, in the order of a seeded hash."""
    h = F.md5(F.concat(F.lit("42|"), F.col("doc_id").cast("string")).cast("binary"))
    quota = F.when(F.col("size") >= 50, F.greatest(F.lit(1), F.bround(F.lit(0.02) * F.col("size")))).otherwise(0)
    rows = first_by_hash(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", h, quota, "doc_id")
    return rows.withColumn("part", F.when(F.col("chosen"), "val").otherwise("train"))


@query(f"WITH {SQL_SPLIT} SELECT doc_id, lang, CASE WHEN n <= CASE WHEN size >= 50 THEN greatest(1, round_even(0.02::DOUBLE * size, 0)) ELSE 0 END THEN 'val' ELSE 'train' END AS part FROM sp")
def stratified_split(spark, sf_dir):
    return split(spark, sf_dir).select("doc_id", "lang", "part")


@query(f"WITH {SQL_SPLIT}, p AS (SELECT lang, n <= CASE WHEN size >= 50 THEN greatest(1, round_even(0.02::DOUBLE * size, 0)) ELSE 0 END AS val FROM sp) SELECT lang, count(*) FILTER (NOT val) AS train, count(*) FILTER (val) AS val FROM p GROUP BY lang")
def split_report(spark, sf_dir):
    return split(spark, sf_dir).groupBy("lang").agg(F.count_if(F.col("part") == "train").alias("train"), F.count_if(F.col("part") == "val").alias("val"))


@query("""SELECT doc_id FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 100""")
def seeded_sample(spark, sf_dir):
    return table(spark, sf_dir, "documents").orderBy(F.md5(F.concat(F.lit("7|"), F.col("doc_id").cast("string")).cast("binary")), "doc_id").limit(100).select("doc_id")


@query("""SELECT lang, count(*) FILTER (verdict = 'KEEP') AS kept, count(*) FILTER (verdict = 'DROP') AS dropped, round(count(*) FILTER (verdict = 'DROP') / count(*)::DOUBLE, 6) AS rate
FROM (SELECT lang, CASE WHEN quality = 0 OR toxic = 1 THEN 'DROP' ELSE 'KEEP' END AS verdict FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY ROLLUP (lang)""")
def filter_report(spark, sf_dir):
    """Judged rows by category and in all: a failed axis drops, a missing judgement keeps."""
    judged = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    drop = F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))
    return judged.rollup("lang").agg(F.count_if(~drop).alias("kept"), F.count_if(drop).alias("dropped"), F.round(F.count_if(drop) / F.count("*"), 6).alias("rate"))


@query("""WITH r AS (SELECT unnest(string_split(concat_ws('; ', CASE WHEN quality = 0 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END), '; ')) AS reason FROM labels WHERE quality = 0 OR toxic = 1) SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def drop_reasons(spark, sf_dir):
    reason = F.concat_ws("; ", F.when(F.col("quality") == 0, "quality"), F.when(F.col("toxic") == 1, "toxic"))
    return table(spark, sf_dir, "labels").where("quality = 0 OR toxic = 1").select(F.explode(F.split(reason, "; ")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT md5(text) AS h, lang FROM documents), c AS (SELECT h, lang, count(*) AS n FROM h GROUP BY ALL) SELECT a.lang AS left_lang, b.lang AS right_lang, CAST(sum(least(a.n, b.n)) AS BIGINT) AS shared FROM c a JOIN c b ON a.h = b.h AND a.lang < b.lang GROUP BY ALL
UNION ALL SELECT lang, lang, CAST(sum(n - 1) AS BIGINT) FROM c WHERE n > 1 GROUP BY lang""")
def duplicate_rows(spark, sf_dir):
    """Equal contents between and within categories, from counts per content."""
    counts = table(spark, sf_dir, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("h"), "lang").agg(F.count("*").alias("n"))
    a, b = counts.withColumnRenamed("lang", "left_lang"), counts.select("h", F.col("lang").alias("right_lang"), F.col("n").alias("m"))
    across = a.join(b, "h").where("left_lang < right_lang").groupBy("left_lang", "right_lang").agg(F.sum(F.least("n", "m")).alias("shared"))
    return across.union(counts.where("n > 1").groupBy(F.col("lang").alias("left_lang"), F.col("lang").alias("right_lang")).agg(F.sum(F.col("n") - 1).alias("shared")))


@query(r"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '(^| )(que|qui|what|who)( |$)') THEN 'phrase' WHEN regexp_matches(lower(text), '(^| )(the|la|der)( |$)') THEN 'doctrine' WHEN regexp_matches(lower(text), '(^| )(i|je|ich)( |$)') THEN 'personal' ELSE 'practical' END AS kind,
 regexp_matches(text, '\?') OR len(regexp_extract_all(text, '\S+')) > 14 AS needs_research FROM conversations WHERE role = 'user'""")
def question_kinds(spark, sf_dir):
    text = F.lower("text")
    kind = F.when(text.rlike("(^| )(que|qui|what|who)( |$)"), "phrase").when(text.rlike("(^| )(the|la|der)( |$)"), "doctrine").when(text.rlike("(^| )(i|je|ich)( |$)"), "personal").otherwise("practical")
    research = F.col("text").rlike(r"\?") | (F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))) > 14)
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", kind.alias("kind"), research.alias("needs_research"))


@query("""WITH c AS (SELECT l_suppkey AS candidate, avg(l_discount) AS recall, avg(CASE WHEN l_tax > 0.01 THEN l_tax END) AS cite, avg(l_quantity) / 10 AS quality FROM lineitem GROUP BY ALL), b AS (SELECT * FROM c WHERE candidate = 1)
SELECT c.candidate, round(c.recall, 6) AS recall, round(c.cite, 6) AS cite, round(c.quality, 6) AS quality, c.cite >= b.cite AND c.recall >= b.recall - 0.002 AND c.quality >= b.quality - 0.2 AS pass FROM c, b""")
def gate_scores(spark, sf_dir):
    """Means over values that are there, and the decision against a base candidate."""
    tax = F.when(F.col("l_tax") > 0.01, F.col("l_tax"))
    means = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("candidate")).agg(F.avg("l_discount").alias("recall"), F.avg(tax).alias("cite"), (F.avg("l_quantity") / 10).alias("quality"))
    base = means.where("candidate = 1").select(F.col("recall").alias("r"), F.col("cite").alias("c"), F.col("quality").alias("q"))
    passed = (F.col("cite") >= F.col("c")) & (F.col("recall") >= F.col("r") - F.lit(0.002)) & (F.col("quality") >= F.col("q") - F.lit(0.2))
    return means.crossJoin(F.broadcast(base)).select("candidate", F.round("recall", 6).alias("recall"), F.round("cite", 6).alias("cite"), F.round("quality", 6).alias("quality"), passed.alias("pass"))


@query("""WITH p AS (SELECT o_custkey AS q, list(DISTINCT o_orderpriority) AS got FROM orders GROUP BY ALL), g AS (SELECT c_custkey AS q, ['1-URGENT', '2-HIGH'] AS gold FROM customer)
SELECT q, round(len(list_intersect(gold, coalesce(got, []))) / 2.0::DOUBLE, 6) AS recall, len(list_intersect(gold, coalesce(got, []))) > 0 AS hit FROM g LEFT JOIN p USING (q)""")
def recall_fraction(spark, sf_dir):
    got = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("q")).agg(F.collect_set("o_orderpriority").alias("got"))
    gold_set = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))
    both = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("q")).join(got, "q", "left")
    n = F.size(F.array_intersect(gold_set, F.coalesce("got", F.array().cast("array<string>"))))
    return both.select("q", F.round(n / F.lit(2.0), 6).alias("recall"), (n > 0).alias("hit"))


@query("""WITH d AS (SELECT doc_id FROM documents), o AS (SELECT doc_id FROM labels) SELECT count(*) AS to_do, CAST(coalesce(min(doc_id), -1) AS BIGINT) AS next FROM d WHERE doc_id NOT IN (SELECT doc_id FROM o)""")
def resume_point(spark, sf_dir):
    rest = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return rest.agg(F.count("*").alias("to_do"), F.coalesce(F.min("doc_id"), F.lit(-1)).cast("long").alias("next"))


@query("""WITH k AS (SELECT doc_id, source, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS key FROM documents) SELECT key, min(doc_id) AS doc_id, count(*) AS n FROM k GROUP BY key""")
def prompt_keys(spark, sf_dir):
    """Texts made distinct by a normalised key of all of them, the first of each kept."""
    key = F.md5(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")).cast("binary"))
    return table(spark, sf_dir, "documents").groupBy(key.alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


#: Scores of an item and a document that one task sums, at most about (as if there were so many items at least, for the documents' own
#: tokens); tokens of items with their weights are broadcast up to so many.
SCORES_A_TASK = 1_000_000
LEAST_ITEMS = 100
BROADCAST_WEIGHTS = 200_000

SQL_NEGATIVES = """
it AS (SELECT item_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9'']+')[1:12], lambda x: lower(x))) AS w FROM benchmark),
iq AS (SELECT item_id, unnest(w) AS token FROM it), pt AS (SELECT doc_id, token, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9'']+'), lambda x: lower(x))) AS token FROM documents) GROUP BY ALL),
df AS (SELECT token, count(*)::DOUBLE AS df FROM pt GROUP BY token), sc AS (SELECT item_id, doc_id, round(sum((1 + ln(tf)) / df), 9) AS score FROM iq JOIN pt USING (token) JOIN df USING (token) GROUP BY ALL),
po AS (SELECT d.doc_id, b.item_id FROM documents d, benchmark b WHERE contains(d.text, b.text))
"""


@query(f"WITH {SQL_NEGATIVES}, n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE NOT EXISTS (SELECT 1 FROM po WHERE po.doc_id = sc.doc_id AND po.item_id = sc.item_id)) SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank FROM n WHERE rank <= 4")
def hard_negatives(spark, sf_dir):
    """For each item the four best keyword matches that do not hold it. The items' tokens (twelve
    each) are the small side; documents that hold an item are found by anchors of forty characters."""
    first = F.array_distinct(F.slice(tokens(F.col("text")), 1, 12))
    asked = table(spark, sf_dir, "benchmark")
    items = asked.select("item_id", F.explode(first).alias("token"))
    docs = table(spark, sf_dir, "documents")
    tf = docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("token")).join(items.select("token").distinct(), "token", "left_semi")
    parts = docs.count() * max(asked.count(), LEAST_ITEMS) // SCORES_A_TASK + 1
    tf = staged(tf.repartition(parts, "doc_id").groupBy("doc_id", "token").agg(F.count("*").cast("double").alias("tf")), "negatives-tf")
    df = tf.groupBy("token").agg(F.count("*").cast("double").alias("df"))
    weights = staged(items.join(df, "token"), "negatives-weights")
    held = contained(docs.select("doc_id", "text"), asked.select("item_id", "text"))
    scored = negative_scores(tf, weights, held, parts)
    return top(scored, 4, ["item_id"], F.desc("score"), "doc_id").select("item_id", "doc_id", "rank")


def negative_scores(tf, weights, held, parts):
    """(item_id, doc_id, score) of the items and documents that share tokens, without those held. Documents are dealt into
    `parts` tasks with their tokens and the items they hold, and meet the items there: the scores, up to
    documents x items, are summed where they arise and not shuffled (with very many items, by an ordinary join)."""
    if weights.limit(BROADCAST_WEIGHTS + 1).count() <= BROADCAST_WEIGHTS:
        weights = F.broadcast(weights)
    held = held.groupBy("doc_id").agg(F.collect_set("item_id").alias("held"))
    dealt = tf.repartition(parts, "doc_id").join(held.repartition(parts, "doc_id"), "doc_id", "left")
    met = dealt.join(weights, "token").where(F.col("held").isNull() | ~F.array_contains("held", F.col("item_id")))
    return met.groupBy("item_id", "doc_id").agg(F.round(F.sum((1 + F.log("tf")) / F.col("df")), 9).alias("score"))
