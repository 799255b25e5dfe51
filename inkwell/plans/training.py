"""Training sets from documents, turns and parts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.operators import training as tr
from inkwell.operators.ranking import top
from inkwell.plans.curation import SQL_SHINGLES, shingles
from inkwell.plans.graphs import SQL_PASSAGES, passages
from inkwell.plans.registry import query
from inkwell.sources.tables import table

FLAWS = ["needless_hotline", "ignores_passages", "rambles", "made_up_experience", "bracket_citations"]
SQL_LIST = "list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0)"


def lines():
    return F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)


@query("""SELECT doc_id, source, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY md5('s|' || doc_id), doc_id) <= greatest(1, CAST(floor(0.98::DOUBLE * count(*) OVER (PARTITION BY source)) AS BIGINT)) THEN 'train' ELSE 'val' END AS part FROM documents""")
def split_by_share(spark, sf_dir):
    """98 % of each group for training, rounded down, one at least."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    h = F.md5(F.concat(F.lit("s|"), F.col("doc_id").cast("string")).cast("binary"))
    rows = tr.first_by_hash(docs, "source", h, F.greatest(F.lit(1), F.floor(F.lit(0.98) * F.col("size"))), "doc_id")
    return rows.select("doc_id", "source", F.when(F.col("chosen"), "train").otherwise("val").alias("part"))


@query()
def packed_sequences(spark, sf_dir):
    """Documents laid into sequences of 2048 words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("n"))
    return tr.packed(docs, "doc_id", "n", 2048)


@query("""SELECT DISTINCT p_brand AS intent, p_type AS difficulty, p_name AS seed, p_brand IN ('Brand#11', 'Brand#12') AS adjacent FROM part""")
def flattened_taxonomy(spark, sf_dir):
    """Seeds of a nested taxonomy (intent, then difficulty) as rows."""
    part = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.collect_set("p_name").alias("seeds"))  # names are few
    nested = part.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "seeds"))).alias("levels"))
    flat = nested.select("p_brand", F.explode("levels").alias("difficulty", "seeds")).select(F.col("p_brand").alias("intent"), "difficulty", F.explode("seeds").alias("seed"))
    return flat.withColumn("adjacent", F.col("intent").isin("Brand#11", "Brand#12"))


@query("""WITH c AS (SELECT doc_id, list_filter(['needless_hotline', 'ignores_passages', 'rambles', 'made_up_experience', 'bracket_citations'], lambda f: NOT (f = 'needless_hotline' AND toxic = 1) AND NOT (f = 'ignores_passages' AND quality = 0)) AS f FROM labels WHERE toxic IS NOT NULL AND quality IS NOT NULL)
SELECT doc_id, f[1 + (((doc_id % 1073741824) * 2654435761) >> 7) % len(f)] AS flaw FROM c""")
def assigned_flaws(spark, sf_dir):
    """A flaw for each sample among those that suit it, dealt evenly by its key."""
    rows = table(spark, sf_dir, "labels").where("toxic IS NOT NULL AND quality IS NOT NULL")
    fits = tr.compatible(F.array(*[F.lit(f) for f in FLAWS]), F.col("toxic") == 1, F.col("quality") == 1)
    return rows.select("doc_id", fits.alias("f")).select("doc_id", F.element_at("f", (tr.seeded(F.col("doc_id"), F.size("f")) + 1).cast("int")).alias("flaw"))


@query(f"""WITH p AS (SELECT doc_id, source, {SQL_LIST} AS l FROM documents), j AS (SELECT doc_id, source, 'Passages:' || chr(10) || array_to_string(list_transform(l, lambda x, i: '[' || i || '] ' || x), chr(10) || chr(10)) || chr(10) || chr(10) || 'Question: about ' || source AS full_prompt FROM p)
SELECT doc_id, md5(full_prompt) AS digest, length(full_prompt) AS chars, 'Question: about ' || source AS bare FROM j""")
def sample_prompts(spark, sf_dir):
    """Prompts with numbered passages, and without."""
    ask = F.concat(F.lit("about "), F.col("source"))
    rows = table(spark, sf_dir, "documents").select("doc_id", tr.prompt(ask, lines()).alias("p"), tr.prompt(ask).alias("bare"))
    return rows.select("doc_id", F.md5(F.col("p").cast("binary")).alias("digest"), F.length("p").cast("long").alias("chars"), "bare")


@query(f"""WITH l AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {SQL_LIST} AS l FROM documents)), c AS (SELECT doc_id, i, sum(length(l[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS used FROM l)
SELECT d.doc_id, coalesce(k, 0)::INTEGER AS kept, CAST(coalesce(used, 0) AS INTEGER) AS chars FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS k, max(used) AS used FROM c WHERE used <= 400 GROUP BY doc_id) USING (doc_id) WHERE d.text IS NOT NULL""")
def memory_snapshot(spark, sf_dir):
    """The first sections that fit four hundred characters."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", tr.fitting(lines(), 400).alias("s"))
    return rows.select("doc_id", F.size("s").alias("kept"), F.length(F.array_join("s", "\n")).alias("chars"))


@query("""WITH s AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM conversations)
SELECT conv_id, turn, upper(s[1]) || s[2:] AS prompt FROM s WHERE length(s) BETWEEN 22 AND 118 AND regexp_matches(s, '[.?]$') AND NOT regexp_matches(s, '(?i)\\b(what year did|how many copies|which edition|isbn|copyright)\\b')""")
def valid_prompts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tr.clean_prompt(F.col("text")).alias("prompt")).where("prompt IS NOT NULL")


@query("""WITH h AS (SELECT ('0x' || substr(md5('x|' || doc_id), 1, 8))::BIGINT % 100 AS pair, source, doc_id, md5('x|' || doc_id) AS h FROM documents WHERE source IS NOT NULL), f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY pair, source ORDER BY h, doc_id) = 1),
r AS (SELECT pair, doc_id AS a, lead(doc_id) OVER (PARTITION BY pair ORDER BY h, doc_id) AS b, row_number() OVER (PARTITION BY pair ORDER BY h, doc_id) AS n FROM f) SELECT pair, a, b FROM r WHERE n = 1 AND b IS NOT NULL""")
def cross_pairs(spark, sf_dir, n: int = 100):
    """Pairs of documents of different sources."""
    return tr.pairs_across(table(spark, sf_dir, "documents"), "doc_id", "source", n, "x|")


@query(f"WITH {SQL_SHINGLES}, o AS (SELECT g FROM sh JOIN bs USING (g) GROUP BY g HAVING count(DISTINCT doc_id) = 1) SELECT item_id, count(DISTINCT g) AS single FROM bs JOIN o USING (g) GROUP BY item_id")
def single_homes(spark, sf_dir):
    """Wordings of benchmark items that stand in exactly one document."""
    items, runs = shingles(table(spark, sf_dir, "benchmark"), "item_id", 8).distinct(), shingles(table(spark, sf_dir, "documents"), "doc_id", 8)
    homes = runs.join(items.select("g").distinct(), "g", "left_semi").groupBy("g").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low = high")
    return items.join(homes, "g").groupBy("item_id").agg(F.countDistinct("g").alias("single"))


@query("""WITH q AS (SELECT conv_id, turn, lower(regexp_extract(text, '[A-Za-z]+ [A-Za-z]+')) AS title FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, lower(text) AS low FROM conversations WHERE role = 'assistant')
SELECT a.conv_id, a.turn, bool_or(contains(low, split_part(title, ' ', 2)) OR contains(low, title)) AS cited FROM a JOIN q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1 WHERE title <> '' GROUP BY ALL""")
def citation_hits(spark, sf_dir):
    """Whether an answer names any of the titles that its question stands for."""
    turns = table(spark, sf_dir, "conversations")
    title = F.lower(F.regexp_extract("text", "[A-Za-z]+ [A-Za-z]+", 0))
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.array(title, F.element_at(F.split(title, " "), -1)).alias("titles")).where("titles[0] <> ''")
    answers = turns.where("role = 'assistant'").select("conv_id", "turn", F.lower("text").alias("low"))
    hit = F.exists("titles", lambda t: F.contains(F.col("low"), t))
    return answers.join(asked, ["conv_id", "turn"]).groupBy("conv_id", "turn").agg(F.max(hit).alias("cited"))


@query(f"""WITH {SQL_PASSAGES}, k AS (SELECT pid, lang, row_number() OVER (PARTITION BY md5(lower(substr(text, 1, 120))) ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, pid) AS n FROM pa) SELECT pid, lang FROM k WHERE n = 1""")
def distinct_passages(spark, sf_dir):
    """Passages with one signature once, those of the preferred category first."""
    signed = passages(spark, sf_dir).select("pid", "lang", F.md5(F.lower(F.substring("text", 1, 120)).cast("binary")).alias("s"), F.when(F.col("lang") == "en", 0).otherwise(1).alias("p"))
    return signed.groupBy("s").agg(F.min_by(F.struct("pid", "lang"), F.struct("p", "pid")).alias("x")).select("x.pid", "x.lang")


@query("""WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 40 ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, event_id % 40 AS thread, event_id, event_type <> 'purchase' AS unresolved FROM l QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 12""")
def open_threads(spark, sf_dir):
    """The twelve threads of a user that were touched last, as their latest update leaves them."""
    latest = table(spark, sf_dir, "events").groupBy("user_id", F.pmod("event_id", F.lit(40)).alias("thread")).agg(F.max_by(F.struct("event_id", "ts", "event_type"), F.struct("ts", "event_id")).alias("e"))
    kept = top(latest.select("user_id", "thread", "e.*"), 12, ["user_id"], F.desc("ts"), F.desc("event_id"))
    return kept.select("user_id", "thread", "event_id", (F.col("event_type") != "purchase").alias("unresolved"))


@query("""SELECT user_id, count(*) FILTER (value >= 50) AS unseen, count(*) FILTER (value < 50) AS purged FROM events WHERE event_type = 'error' GROUP BY user_id""")
def report_counts(spark, sf_dir):
    """Reports by user: those not seen yet, and those that a purge of seen ones takes."""
    reports = table(spark, sf_dir, "events").where("event_type = 'error'")
    return reports.groupBy("user_id").agg(F.count_if(F.col("value") >= 50).alias("unseen"), F.count_if(F.col("value") < 50).alias("purged"))


@query(f"""WITH w AS (SELECT doc_id, i AS ord, len(regexp_extract_all(l[i], '\\S+')) AS n FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {SQL_LIST} AS l FROM documents))),
c AS (SELECT doc_id, ord, n, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
SELECT doc_id, CAST(before // 300 AS BIGINT) AS part, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS words FROM c GROUP BY ALL""")
def reading_parts(spark, sf_dir, words: int = 300):
    """Documents in parts of about three hundred words: a block belongs to the part in which it begins."""
    blocks = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines()).alias("ord", "line")).select("doc_id", "ord", F.size(F.regexp_extract_all("line", F.lit(r"\S+"), F.lit(0))).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumn("part", F.floor(before / words)).groupBy("doc_id", "part").agg(F.count("*").alias("blocks"), F.sum("n").alias("words"))
