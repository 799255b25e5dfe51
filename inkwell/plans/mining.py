"""Phrases and proper names mined from the passages of documents; sources stand for books."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import mining
from inkwell.operators.matching import text_tokens
from inkwell.operators.retrieval import STOP_WORDS
from inkwell.plans.graphs import passages
from inkwell.plans.phrases import TOKENS
from inkwell.plans.registry import query

SQL_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(STOP_WORDS))


def _level(n: int) -> str:
    shifts = ", ".join(f"w[{k}:-{n - k + 1}]" if k < n else f"w[{n}:]" for k in range(1, n + 1))
    words = [f"g[{k}]" for k in range(1, n + 1)]
    inner = " + ".join(f"({w} IN ({SQL_STOP}))::INT" for w in words)
    return f"""SELECT [{", ".join(words)}] AS p, {n} AS words, CAST(sum(n) AS BIGINT) AS "count", count(*) AS books
  FROM (SELECT source, g, count(*) AS n FROM (SELECT source, unnest(list_zip({shifts})) AS g FROM ps WHERE len(w) >= {n}) GROUP BY source, g)
  WHERE g[1] NOT IN ({SQL_STOP}) AND g[{n}] NOT IN ({SQL_STOP}) AND {inner} <= {n - 2} GROUP BY g HAVING sum(n) >= 8 AND (count(*) >= 2 OR sum(n) >= 20)"""


SQL_PHRASES = f"""
lx AS (SELECT source, unnest(string_split(text, chr(10))) AS text FROM documents),
ps AS (SELECT source, {TOKENS} AS w FROM lx WHERE len(regexp_extract_all(text, '\\S+')) >= 25),
un AS (SELECT word, count(*)::DOUBLE AS n FROM (SELECT unnest(w) AS word FROM ps) GROUP BY word), tt AS (SELECT sum(len(w))::DOUBLE AS total FROM ps),
gr AS ({_level(2)} UNION ALL {_level(3)} UNION ALL {_level(4)}),
ch AS (SELECT p, sum(ln(n / total)) AS share, any_value(total) AS total FROM (SELECT p, unnest(p) AS word FROM gr) JOIN un USING (word), tt GROUP BY p),
f4 AS (SELECT gr.*, ln("count") - greatest(ln(total) + share, ln(1e-9)) AS pmi FROM gr JOIN ch USING (p) WHERE pmi >= 3.0),
h4 AS (SELECT s, max("count") AS longer FROM (SELECT "count", unnest([p[1:2], p[2:3], p[3:4], p[1:3], p[2:4]]) AS s FROM f4 WHERE words = 4) GROUP BY s),
f3 AS (SELECT f4.* FROM f4 LEFT JOIN h4 ON s = p WHERE longer IS NULL OR longer < 0.8 * "count"),
h3 AS (SELECT s, max("count") AS longer FROM (SELECT "count", unnest([p[1:2], p[2:3]]) AS s FROM f3 WHERE words = 3) GROUP BY s)
SELECT array_to_string(p, ' ') AS phrase, words, "count", books, round(pmi, 6) AS pmi FROM f3 LEFT JOIN h3 ON s = p WHERE longer IS NULL OR longer < 0.8 * "count" """


@query(f"WITH {SQL_PHRASES}")
def mined_phrases(spark, sf_dir):
    """Phrases of two to four words that occur far more often than by chance, without parts of longer ones."""
    found = mining.phrases(passages(spark, sf_dir), "source", sorted(STOP_WORDS), w="text", split=text_tokens)
    return found.select("phrase", "words", "count", "books", F.round("pmi", 6).alias("pmi"))


@query()
def names_in_passages(spark, sf_dir):
    """Runs of capitalised words within sentences. The pattern looks behind, which DuckDB's cannot: tests hold its cases."""
    return mining.proper_names(passages(spark, sf_dir), "source", sorted(STOP_WORDS))
