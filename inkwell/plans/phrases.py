"""Thousands of mined words, stems and phrases looked for in every passage."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import matching
from inkwell.plans.graphs import passages
from inkwell.plans.registry import query
from inkwell.sources.tables import table

WORDS, STEMS, PHRASES = 1200, 400, 600
TOKENS = "regexp_extract_all(replace(replace(lower(text), '’', ''''), '‘', ''''), '[a-z0-9]+(?:''[a-z]+)?')"
SQL_MINED = f"""
dt AS (SELECT doc_id, {TOKENS} AS w FROM documents),
dw AS (SELECT DISTINCT doc_id, unnest(w) AS token FROM dt),
f1 AS (SELECT token AS form FROM dw WHERE length(token) >= 5 GROUP BY token ORDER BY count(*) DESC, token LIMIT {WORDS}),
f2 AS (SELECT stem || '*' AS form FROM (SELECT DISTINCT doc_id, substr(token, 1, 6) AS stem FROM dw WHERE length(token) >= 8) GROUP BY stem ORDER BY count(*) DESC, stem LIMIT {STEMS}),
f3 AS (SELECT p[1] || ' ' || p[2] AS form FROM (SELECT DISTINCT doc_id, unnest(list_zip(w[:-2], w[2:])) AS p FROM dt WHERE len(w) > 1) WHERE length(p[1]) >= 3 AND length(p[2]) >= 3 GROUP BY p ORDER BY count(*) DESC, form LIMIT {PHRASES}),
fm AS (SELECT form FROM f1 UNION ALL SELECT form FROM f2 UNION ALL SELECT form FROM f3)"""
SQL_HITS = SQL_MINED + f""",
lw AS (SELECT form, form LIKE '%*' AS open, regexp_extract(form, '(\\S*)$', 1) AS l FROM fm),
vr AS (SELECT form, open, form AS v FROM lw UNION ALL SELECT form, open, regexp_replace(form, '\\S*$', '') || CASE WHEN regexp_matches(l, '^.{{2,}}ies$') THEN l[:-4] || 'y'
  WHEN regexp_matches(l, '^.{{2,}}[^s]s$') THEN l[:-2] WHEN regexp_matches(l, '^.{{2,}}[^aeiou]y$') THEN l[:-2] || 'ies' WHEN regexp_matches(l, '^\\p{{L}}{{3,}}$') AND l NOT LIKE '%s' THEN l || 's' END FROM lw WHERE NOT open),
pf AS (SELECT form AS concept, open, regexp_extract_all(v, '[a-z0-9]+(?:''[a-z]+)?') AS k FROM vr WHERE v IS NOT NULL),
sg AS (SELECT DISTINCT concept, k[1] AS k1 FROM pf WHERE len(k) = 1 AND NOT open), st AS (SELECT DISTINCT concept, k[1] AS k1 FROM pf WHERE open), ph AS (SELECT concept, k[1] AS k1, k[2] AS k2 FROM pf WHERE len(k) = 2),
lx AS (SELECT doc_id, i - 1 AS ord, l[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
ps AS (SELECT doc_id, ord, {TOKENS} AS w FROM lx WHERE len(regexp_extract_all(text, '\\S+')) >= 25),
tk AS (SELECT doc_id, ord, unnest(w) AS a, unnest(w[2:] || [NULL]) AS b FROM ps),
ht AS (SELECT doc_id, ord, concept, sum(n) AS hits FROM (
  SELECT doc_id, ord, concept, count(*) AS n FROM tk JOIN sg ON a = k1 GROUP BY ALL UNION ALL SELECT doc_id, ord, concept, count(*) FROM tk JOIN st ON substr(a, 1, 6) = k1 GROUP BY ALL
  UNION ALL SELECT doc_id, ord, concept, count(*) FROM tk JOIN ph ON a = k1 AND b = k2 GROUP BY ALL) GROUP BY ALL)"""


def mined_forms(spark, sf_dir):
    """(concept, form): the words, stems and pairs found in most documents; each names its own concept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", matching.tokens(F.col("text")).alias("w"))
    words = docs.select(F.explode(F.array_distinct("w")).alias("token"))
    longer = words.where("length(token) >= 5").groupBy("token").count().orderBy(F.desc("count"), "token").limit(WORDS)
    stems = F.array_distinct(F.transform(F.filter("w", lambda t: F.length(t) >= 8), lambda t: F.substring(t, 1, 6)))
    stem = docs.select(F.explode(stems).alias("stem")).groupBy("stem").count().orderBy(F.desc("count"), "stem").limit(STEMS)
    held = lambda a, b: F.when((F.length(a) >= 3) & (F.length(b) >= 3), F.concat_ws(" ", a, b))
    # as strings, which Spark makes distinct by a hash set; structs it would compare each with each
    pairs = F.array_distinct(F.array_compact(F.zip_with("w", F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))), held)))
    pair = docs.select(F.explode(pairs).alias("form")).groupBy("form").count().orderBy(F.desc("count"), "form").limit(PHRASES)
    forms = longer.select(F.col("token").alias("form")).union(stem.select(F.concat("stem", F.lit("*")))).union(pair.select("form"))
    return forms.select(F.col("form").alias("concept"), "form")


def concept_hits(spark, sf_dir):
    rows = passages(spark, sf_dir)
    return matching.matches(rows, matching.prepared(mined_forms(spark, sf_dir)), ["doc_id", "ord"])


@query(f"WITH {SQL_HITS} SELECT concept, count(*) AS passages, CAST(sum(hits) AS BIGINT) AS mentions FROM ht GROUP BY concept")
def mined_concepts(spark, sf_dir):
    """Every mined form's passages and mentions; plurals and singulars count as one."""
    return concept_hits(spark, sf_dir).groupBy("concept").agg(F.count("*").alias("passages"), F.sum("hits").alias("mentions"))


@query(f"WITH {SQL_HITS} SELECT doc_id, ord, count(*) AS concepts, CAST(sum(hits) AS BIGINT) AS mentions FROM ht GROUP BY doc_id, ord")
def concepts_of_passages(spark, sf_dir):
    """How many concepts a passage holds, and how often."""
    return concept_hits(spark, sf_dir).groupBy("doc_id", "ord").agg(F.count("*").alias("concepts"), F.sum("hits").alias("mentions"))


@query(f"""WITH {SQL_HITS}, c AS (SELECT concept, count(*)::DOUBLE AS c FROM ht GROUP BY concept), n AS (SELECT count(*)::DOUBLE AS n FROM (SELECT DISTINCT doc_id, ord FROM ht)),
kp AS (SELECT concept FROM c ORDER BY c DESC, concept LIMIT 200), hk AS (SELECT doc_id, ord, concept FROM ht SEMI JOIN kp USING (concept)), m AS (SELECT count(*)::DOUBLE AS m FROM (SELECT DISTINCT doc_id, ord FROM hk)),
pr AS (SELECT x.concept AS a, y.concept AS b, count(*) AS shared FROM hk x JOIN hk y ON x.doc_id = y.doc_id AND x.ord = y.ord AND x.concept < y.concept GROUP BY ALL HAVING count(*) >= 5)
SELECT a, b, shared, round(npmi, 6) AS npmi FROM (SELECT a, b, shared, ln((shared / m) / ((ca.c / m) * (cb.c / m))) / -ln(shared / m) AS npmi FROM pr JOIN c ca ON ca.concept = a JOIN c cb ON cb.concept = b, m WHERE shared < m) WHERE npmi > 0.02""")
def mined_edges(spark, sf_dir):
    """Associations of the two hundred concepts found in most passages."""
    from inkwell.operators.graph import cooccurrence, staged

    hits = staged(concept_hits(spark, sf_dir).select("doc_id", "ord", "concept"), "concepts")
    most = hits.groupBy("concept").count().orderBy(F.desc("count"), "concept").limit(200)
    kept = hits.join(F.broadcast(most.select("concept")), "concept", "left_semi").select(F.struct("doc_id", "ord").alias("passage"), "concept")
    return cooccurrence(kept, "passage", "concept", 5, 0.02).select("a", "b", "shared", F.round("npmi", 6).alias("npmi"))


@query()
def concept_map(spark, sf_dir):
    """Places of the mined concepts on a map; iterative, so tests compare its operator with a dense decomposition."""
    from inkwell.operators.layout import layout

    placed = layout(mined_edges(spark, sf_dir).select("a", "b", F.col("npmi").alias("weight")))
    return placed.select(F.col("node").alias("concept"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))
