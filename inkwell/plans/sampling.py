"""Seeded picks and samples over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.operators import sampling as sp
from inkwell.plans.registry import query
from inkwell.sources.tables import table

SQL_U = "(('0x' || substr(md5('picks|' || user_id || '|' || item), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE"


@query(f"""WITH e AS (SELECT user_id, event_type, event_type || ' ' || props AS item, ts, event_id FROM events),
c AS (SELECT user_id, event_type, item, sqrt(count(*)::DOUBLE) AS weight FROM e GROUP BY ALL),
r AS (SELECT DISTINCT user_id, item FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20)),
k AS (SELECT *, -ln({SQL_U}) / weight AS key FROM c ANTI JOIN r USING (user_id, item)),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY key, item) AS turn FROM k)
SELECT user_id AS owner, item, event_type AS stratum, CAST(row_number() OVER (PARTITION BY user_id ORDER BY turn, key, item) AS INTEGER) AS pick FROM t QUALIFY pick <= 5""")
def starter_picks(spark, sf_dir):
    """Five things a user is offered: one of a kind first, by how often they were met, none of the last twenty."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("event_type").alias("stratum"), F.concat_ws(" ", "event_type", "props").alias("item"), "ts", "event_id")
    candidates = events.groupBy("owner", "stratum", "item").agg(F.sqrt(F.count("*").cast("double")).alias("weight"))
    last = events.withColumn("n", F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("ts"), F.desc("event_id")))).where("n <= 20")
    return sp.weighted_picks(candidates, last.select("owner", "item").distinct(), 5)


SQL_HEX = lambda h, a, n: f"('0x' || substr({h}, {a}, {n}))::BIGINT"
SQL_KINDS = """
s0 AS (SELECT conv_id AS id, count(*) OVER () AS total FROM (SELECT DISTINCT conv_id FROM conversations)),
s1 AS (SELECT *, row_number() OVER (ORDER BY md5('kinds-refusal|' || id), id) <= floor(total * 0.05::DOUBLE + 1e-9) AS refusal FROM s0),
s2 AS (SELECT id, CASE WHEN refusal THEN 'refusal' WHEN row_number() OVER (PARTITION BY refusal ORDER BY md5('kinds-bare|' || id), id) <= floor(total * 0.10::DOUBLE + 1e-9) THEN 'bare' ELSE 'passages' END AS kind FROM s1)"""


def sample_kinds(spark, sf_dir):
    seeds = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).distinct()
    return sp.kinds(seeds, {"refusal": 0.05, "bare": 0.10}, "passages")


@query(f"WITH {SQL_KINDS} SELECT id, kind FROM s2")
def kinds_of_samples(spark, sf_dir):
    """Of all conversations 5 % refusals, 10 % without passages, the rest with: exact to a row."""
    return sample_kinds(spark, sf_dir)


@query(f"""WITH {SQL_KINDS}, p AS (SELECT d.doc_id AS passage, coalesce(source, '') AS stratum, coalesce(l.quality, 0) = 1 AS gold FROM documents d LEFT JOIN labels l USING (doc_id)),
st AS (SELECT stratum, row_number() OVER (ORDER BY stratum) - 1 AS s, count(*) OVER () AS total FROM (SELECT DISTINCT stratum FROM p)),
pl AS (SELECT *, row_number() OVER (PARTITION BY stratum, gold ORDER BY md5('samples|' || passage), passage) - 1 AS "at", count(*) OVER (PARTITION BY stratum, gold) AS n FROM p),
gr AS (SELECT DISTINCT stratum, gold, n FROM pl), tt AS (SELECT any_value(total) AS total FROM st),
pk AS (SELECT id, unnest(range(least(4, total))) AS j, md5('samples|' || id) AS h, total FROM s2, tt WHERE kind = 'passages'),
pj AS (SELECT id, j, j < 1 + {SQL_HEX('h', 1, 7)} % 2 AS gold, ({SQL_HEX('h', 8, 7)} + j) % total AS s FROM pk),
pa AS (SELECT id, j, pj.gold, stratum, {SQL_HEX("md5('samples|' || id || '|' || j)", 1, 7)} % n AS "at" FROM pj JOIN st USING (s) JOIN gr USING (stratum, gold))
SELECT id, passage, stratum, gold, CAST(row_number() OVER (PARTITION BY id ORDER BY md5('samples-order|' || id || '|' || passage), passage) - 1 AS INTEGER) AS "at" FROM pa JOIN pl USING (stratum, gold, "at")""")
def passages_of_samples(spark, sf_dir):
    """The passages of each sample that has some: one or two good documents, the others not, each of another source."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    passages = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(F.col("doc_id").alias("passage"), F.coalesce("source", F.lit("")).alias("stratum"), (F.coalesce("quality", F.lit(0)) == 1).alias("gold"))
    return sp.assembled(sample_kinds(spark, sf_dir).where("kind = 'passages'").select("id"), passages)
