"""Normalizers, times, state and small rules of a reading service."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.text import tokens
from inkwell.operators import structure as st
from inkwell.operators.ranking import top
from inkwell.operators.vectors import best_by_kind
from inkwell.plans.registry import query
from inkwell.sources.sinks import latest
from inkwell.sources.tables import lines_of, table

SQL_LINES = """
ln AS (SELECT doc_id, source, lang, CAST(i - 1 AS INTEGER) AS ord, l[i] AS text FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE length(trim(l[i])) > 0)
"""


@query(f"""WITH {SQL_LINES} SELECT doc_id, ord, CASE WHEN regexp_matches(trim(text), '^[0-9]{{1,3}}$') THEN trim(text) WHEN regexp_matches(trim(text), '^[ivxlc]{{1,10}}$') THEN trim(text)
 WHEN regexp_matches(trim(text), '^[0-9]{{1,3}} ') THEN regexp_extract(trim(text), '^([0-9]{{1,3}}) ', 1) WHEN regexp_matches(trim(text), ' [0-9]{{1,3}}$') THEN regexp_extract(trim(text), ' ([0-9]{{1,3}})$', 1) END AS page FROM ln""")
def page_numbers(spark, sf_dir):
    """A line's page number: alone, roman, before or after a header."""
    t = F.trim("text")
    page = (
        F.when(t.rlike("^[0-9]{1,3}$"), t).when(t.rlike("^[ivxlc]{1,10}$"), t)
        .when(t.rlike("^[0-9]{1,3} "), F.regexp_extract(t, "^([0-9]{1,3}) ", 1)).when(t.rlike(" [0-9]{1,3}$"), F.regexp_extract(t, " ([0-9]{1,3})$", 1))
    )
    return lines_of(table(spark, sf_dir, "documents")).select("doc_id", "ord", page.alias("page"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), '^(economy|small)') THEN 1 WHEN regexp_matches(lower(p_type), '^(standard|medium)') THEN 2 ELSE 3 END AS level,
 array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS title, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key FROM part""")
def title_keys(spark, sf_dir):
    title = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000)))), " ")
    level = F.when(F.lower("p_type").rlike("^(economy|small)"), 1).when(F.lower("p_type").rlike("^(standard|medium)"), 2).otherwise(3)
    return table(spark, sf_dir, "part").select("p_partkey", level.alias("level"), title.alias("title"), F.regexp_replace(F.lower("p_name"), "[^a-z0-9]", "").alias("key"))


@query(f"WITH {SQL_LINES}, b AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY ord) AS before FROM ln) SELECT doc_id, ord, CASE WHEN length(trim(before)) <= 3 THEN trim(before) || text ELSE text END AS text FROM b")
def drop_caps(spark, sf_dir):
    """A very short line before is the capital that was dropped from this one."""
    before = F.trim(F.lag("text").over(st.in_order()))
    lines = lines_of(table(spark, sf_dir, "documents")).withColumn("before", before)
    return lines.select("doc_id", "ord", F.when(F.length("before") <= 3, F.concat("before", "text")).otherwise(F.col("text")).alias("text"))


@query("""WITH m AS (SELECT o_orderkey, CAST((o_orderkey * 7) % 1440 AS INTEGER) AS start, CAST((o_orderkey * 3) % 200 AS INTEGER) AS length FROM orders)
SELECT o_orderkey, lpad(CAST(start // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(start % 60 AS VARCHAR), 2, '0') AS starts,
 lpad(CAST(((start + length) % 1440) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((start + length) % 60 AS VARCHAR), 2, '0') AS ends,
 CAST(CASE WHEN (start // 60) % 12 = 0 THEN 12 ELSE (start // 60) % 12 END AS VARCHAR) || ':' || lpad(CAST(start % 60 AS VARCHAR), 2, '0') || CASE WHEN start < 720 THEN ' AM' ELSE ' PM' END AS shown FROM m""")
def clock_times(spark, sf_dir):
    """Start, end (start and duration over midnight) and the 12-hour form."""
    m = table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") * 7) % 1440).cast("int").alias("start"), ((F.col("o_orderkey") * 3) % 200).cast("int").alias("length"))
    clock = lambda c: F.format_string("%02d:%02d", F.floor(c / 60).cast("int"), (c % 60).cast("int"))
    hour = F.floor(F.col("start") / 60).cast("int") % 12
    shown = F.format_string("%d:%02d%s", F.when(hour == 0, 12).otherwise(hour), F.col("start") % 60, F.when(F.col("start") < 720, " AM").otherwise(" PM"))
    return m.select("o_orderkey", clock(F.col("start")).alias("starts"), clock((F.col("start") + F.col("length")) % 1440).alias("ends"), shown.alias("shown"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '(^|[ \\n])[0-9]+[.)] ')) AS marks, CASE WHEN len(regexp_extract_all(text, '[|#*$%&]')) >= 5 THEN 0.2::DOUBLE WHEN len(regexp_extract_all(text, '(^|[ \\n])[0-9]+[.)] ')) >= 3 THEN 0.45::DOUBLE ELSE 1.0::DOUBLE END AS penalty FROM documents""")
def enumeration_penalty(spark, sf_dir):
    marks = F.regexp_count("text", F.lit(r"(^|[ \n])[0-9]+[.)] "))
    penalty = F.when(F.regexp_count("text", F.lit("[|#*$%&]")) >= 5, 0.2).when(marks >= 3, 0.45).otherwise(1.0)
    return table(spark, sf_dir, "documents").select("doc_id", marks.cast("long").alias("marks"), penalty.alias("penalty"))


@query("""SELECT user_id, event_id, CAST((dayofyear(CAST(ts AS DATE)) - 1) % 12 AS INTEGER) AS item, CASE WHEN hour(ts) >= 4 AND hour(ts) < 11 THEN 'morning' WHEN hour(ts) >= 11 AND hour(ts) < 17 THEN 'day' WHEN hour(ts) >= 17 AND hour(ts) < 22 THEN 'evening' ELSE 'night' END AS part,
 CASE WHEN lower(event_type) IN ('error') THEN 'alert' WHEN value > 90 THEN 'high' ELSE 'normal' END AS kind FROM events""")
def daily_items(spark, sf_dir):
    h = F.hour("ts")
    part = F.when((h >= 4) & (h < 11), "morning").when((h >= 11) & (h < 17), "day").when((h >= 17) & (h < 22), "evening").otherwise("night")
    kind = F.when(F.lower("event_type") == "error", "alert").when(F.col("value") > 90, "high").otherwise("normal")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.pmod(F.dayofyear("ts") - 1, F.lit(12)).alias("item"), part.alias("part"), kind.alias("kind"))


@query("""WITH p AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '\\S+'), lambda w: length(w)) AS ids FROM conversations), q AS (SELECT conv_id, turn, ids[1:64] AS ids, least(len(ids), 8) AS n FROM p)
SELECT conv_id, turn, CAST(len(ids) AS INTEGER) AS size, list_transform(range(1, len(ids) + 1), lambda i: CAST(CASE WHEN i <= n THEN -100 ELSE ids[i] END AS INTEGER)) AS labels FROM q""")
def masked_labels(spark, sf_dir):
    """Labels of a prompt and an answer cut to 64: the prompt's part is masked."""
    ids = F.transform(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), F.length)
    q = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.slice(ids, 1, 64).alias("ids"), F.least(F.size(ids), F.lit(8)).alias("n"))
    return q.select("conv_id", "turn", F.size("ids").alias("size"), F.transform("ids", lambda x, i: F.when(i < F.col("n"), F.lit(-100)).otherwise(x)).alias("labels"))


@query("""WITH l AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey)[1:3] AS docs, list(o_orderpriority ORDER BY o_orderkey)[1:5] AS blocks FROM orders GROUP BY o_custkey), z AS (SELECT o_custkey, unnest(range(1, len(blocks) + 1)) AS i, docs, blocks FROM l)
SELECT o_custkey, CAST(i AS INTEGER) AS pos, coalesce(docs[i], docs[1]) AS doc, blocks[i] AS block FROM z""")
def gold_pairs(spark, sf_dir):
    """Documents and blocks of an item side by side; missing documents are the first one."""
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("p"))
    lists = lists.select("o_custkey", F.slice(F.transform("p", lambda x: x["o_orderkey"]), 1, 3).alias("docs"), F.slice(F.transform("p", lambda x: x["o_orderpriority"]), 1, 5).alias("blocks"))
    pairs = lists.select("o_custkey", F.col("docs")[0].alias("first"), F.posexplode(F.arrays_zip("docs", "blocks")).alias("i", "z"))
    return pairs.where("z.blocks IS NOT NULL").select("o_custkey", (F.col("i") + 1).alias("pos"), F.coalesce("z.docs", "first").alias("doc"), F.col("z.blocks").alias("block"))


@query("""WITH v AS (SELECT label, list(embedding ORDER BY vec_id) AS e FROM embeddings GROUP BY label), c AS (SELECT label, round(avg(embedding[1]::DOUBLE), 9) AS x, round(avg(embedding[2]::DOUBLE), 9) AS y FROM embeddings GROUP BY label),
p AS (SELECT a.label, b.label AS peer, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) * CASE WHEN a.label % 2 = b.label % 2 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END AS d FROM c a JOIN c b ON a.label <> b.label)
SELECT label, peer, CAST(row_number() OVER (PARTITION BY label ORDER BY round(d, 6), peer) AS INTEGER) AS rank FROM p QUALIFY rank <= 6""")
def layout_peers(spark, sf_dir):
    """The six nearest groups by layout, those of the same kind a little nearer; a row per group."""
    c = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.round(F.avg(F.col("embedding")[0].cast("double")), 9).alias("x"), F.round(F.avg(F.col("embedding")[1].cast("double")), 9).alias("y"))
    other = c.select(F.col("label").alias("peer"), F.col("x").alias("px"), F.col("y").alias("py"))
    d = F.sqrt(F.pow(F.col("x") - F.col("px"), F.lit(2)) + F.pow(F.col("y") - F.col("py"), F.lit(2))) * F.when(F.col("label") % 2 == F.col("peer") % 2, 0.85).otherwise(1.0)
    pairs = c.join(other, F.col("label") != F.col("peer")).select("label", "peer", F.round(d, 6).alias("d"))
    return top(pairs, 6, ["label"], "d", "peer").select("label", "peer", "rank")


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 20 = 0),
p AS (SELECT q.vec_id AS qid, max(CASE WHEN e.label = q.label THEN round(list_cosine_similarity(q.v, e.v), 9) END) AS pos, max(CASE WHEN e.label <> q.label THEN round(list_cosine_similarity(q.v, e.v), 9) END) AS neg FROM q JOIN e ON e.vec_id <> q.vec_id GROUP BY q.vec_id)
SELECT qid, pos > neg AS first, round(1 / (1 + exp(-10 * (pos - neg))), 6) AS margin FROM p""")
def rank_at_one(spark, sf_dir):
    """Whether the best neighbour of a query's own kind beats all others, and a squashed margin."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    best = best_by_kind(rows, rows.where("vec_id % 20 = 0"))
    return best.select("qid", (F.col("pos") > F.col("neg")).alias("first"), F.round(1 / (1 + F.exp(-10 * (F.col("pos") - F.col("neg")))), 6).alias("margin"))


@query("""WITH n AS (SELECT event_id, user_id, ((CAST(strftime(ts, '%w') AS INTEGER) * 1440 + hour(ts) * 60 + minute(ts)) - (user_id % 7) * 1440 - (user_id * 37) % 1440 + 20160) % 10080 AS since FROM events)
SELECT event_id, CAST(since AS INTEGER) AS since, CASE WHEN since <= 90 THEN 'live' WHEN since >= 10080 - 120 THEN 'soon' ELSE 'later' END AS status FROM n""")
def live_now(spark, sf_dir):
    """Minutes since a weekly start in local time: live for 90, soon for the two hours before."""
    now = (F.dayofweek("ts") - 1) * 1440 + F.hour("ts") * 60 + F.minute("ts")
    since = F.pmod(now - (F.col("user_id") % 7) * 1440 - (F.col("user_id") * 37) % 1440, F.lit(10080)).cast("int")
    return table(spark, sf_dir, "events").select("event_id", since.alias("since")).withColumn("status", F.when(F.col("since") <= 90, "live").when(F.col("since") >= 10080 - 120, "soon").otherwise("later"))


@query("""WITH s AS (SELECT c_custkey, CAST((c_custkey * 11) % 1440 AS INTEGER) AS due, CASE c_nationkey % 4 WHEN 0 THEN -300 WHEN 1 THEN -360 WHEN 2 THEN -420 ELSE -480 END AS shift, c_custkey % 5 = 0 AS sent FROM customer)
SELECT c_custkey, CAST((900 + shift - due + 2880) % 1440 AS INTEGER) AS late FROM s WHERE NOT sent AND (900 + shift - due + 2880) % 1440 <= 120""")
def due_subscribers(spark, sf_dir):
    """Subscribers whose local time is at most two hours past their hour, not sent to yet; now is 15:00 UTC."""
    shift = F.when(F.col("c_nationkey") % 4 == 0, -300).when(F.col("c_nationkey") % 4 == 1, -360).when(F.col("c_nationkey") % 4 == 2, -420).otherwise(-480)
    late = F.pmod(F.lit(900) + shift - (F.col("c_custkey") * 11) % 1440, F.lit(1440)).cast("int")
    return table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select("c_custkey", late.alias("late")).where("late <= 120")


@query("""WITH d AS (SELECT doc_id, source, dayofyear(make_date(2024, CAST(1 + doc_id % 12 AS INTEGER), CAST(1 + doc_id % 28 AS INTEGER))) + 10 AS page FROM documents), p AS (SELECT page_id, CAST(page_id % 366 AS BIGINT) AS page FROM pages)
SELECT doc_id, d.page, count(page_id) AS pages FROM d LEFT JOIN p ON p.page = d.page GROUP BY doc_id, d.page""")
def daily_reading(spark, sf_dir):
    """A month and day (leap year's count) to the page of a book of days, with an offset."""
    day = F.make_date(F.lit(2024), (1 + F.col("doc_id") % 12).cast("int"), (1 + F.col("doc_id") % 28).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.dayofyear(day) + 10).cast("long").alias("page"))
    pages = table(spark, sf_dir, "pages").groupBy((F.col("page_id") % 366).alias("page")).agg(F.count("page_id").alias("pages"))
    return docs.join(F.broadcast(pages), "page", "left").select("doc_id", "page", F.coalesce("pages", F.lit(0)).alias("pages"))  # 366 rows


@query("""WITH j AS (SELECT user_id AS job, ts, event_id, event_type AS status FROM events) SELECT job, arg_max(status, (ts, event_id)) AS status, count(*) AS steps, max(ts) < TIMESTAMP '2024-01-29 12:00:00' AS orphaned FROM j GROUP BY job""")
def job_status(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.groupBy(F.col("user_id").alias("job")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("steps"), (F.max("ts") < F.expr("timestamp_ntz'2024-01-29 12:00:00'")).alias("orphaned"))


@query("""WITH o AS (SELECT DISTINCT sha256(regexp_replace(text, '[0-9]+', '#', 'g')) AS h FROM documents WHERE text IS NOT NULL) SELECT source, count(*) AS changed FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT h FROM o) GROUP BY source""")
def changed_documents(spark, sf_dir):
    """Documents whose content an earlier build, which masked all numbers, does not hold."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    rows = docs.select("doc_id", "source", F.sha2("text", 256).alias("h"))
    known = docs.select(F.sha2(F.regexp_replace("text", "[0-9]+", "#"), 256).alias("h")).distinct()
    return rows.join(known, "h", "left_anti").groupBy("source").agg(F.count("*").alias("changed"))


@query("""SELECT user_id, CAST(ts AS DATE)::VARCHAR AS day, min(ts) AS sent FROM events GROUP BY ALL""")
def sent_once(spark, sf_dir):
    """The batch form of a once-a-day guard."""
    rows = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), "ts", "event_id")
    return latest(rows, ["user_id", "day"], "ts", "event_id").select("user_id", "day", F.col("ts").alias("sent"))


@query("""WITH v AS (SELECT l_suppkey AS collection, count(*) AS n FROM lineitem GROUP BY ALL) SELECT arg_max(collection, (n, -collection)) AS collection, max(n) AS n FROM v WHERE n > 0 AND CAST(collection AS VARCHAR) LIKE '1%'""")
def largest_collection(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("collection")).agg(F.count("*").alias("n")).where(F.col("collection").cast("string").startswith("1"))
    return counts.agg(F.max_by("collection", F.struct("n", -F.col("collection"))).alias("collection"), F.max("n").alias("n"))


@query("""WITH c AS (SELECT p_brand AS key, p_partkey AS id, p_retailprice AS score FROM part), b AS (SELECT key, arg_max(id, (score, -id)) AS id, max(score) AS score FROM c GROUP BY key) SELECT key, id, score FROM b WHERE key || 's' NOT IN (SELECT key FROM b)""")
def best_candidates(spark, sf_dir):
    """Of each key the best candidate; keys whose plural is a key as well are left out."""
    best = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("key")).agg(F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("id"), F.max("p_retailprice").alias("score"))
    plural = best.where(F.col("key").endswith("s")).select(F.expr("left(key, length(key) - 1)").alias("key")).join(best.select("key"), "key", "left_semi").distinct()
    return best.join(plural, "key", "left_anti")


@query("""WITH k AS (SELECT user_id, CASE WHEN event_type = 'view' THEN 1.0::DOUBLE WHEN event_type = 'click' THEN 1.5::DOUBLE ELSE 1.85::DOUBLE END AS w, event_type, count(*) AS n, max(ts) AS seen FROM events GROUP BY ALL)
SELECT user_id, round(sum(w * least(n, 3) * exp(-date_diff('day', CAST(seen AS DATE), DATE '2024-01-31') / 14.0::DOUBLE)), 6) AS interest FROM k GROUP BY user_id""")
def interest_scores(spark, sf_dir):
    """Hits by kind, three at most, weighed and decayed by days since the last."""
    weight = F.when(F.col("event_type") == "view", 1.0).when(F.col("event_type") == "click", 1.5).otherwise(1.85)
    kinds = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("seen"))
    days = F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("seen"))
    return kinds.groupBy("user_id").agg(F.round(F.sum(weight * F.least("n", F.lit(3)) * F.exp(-days / F.lit(14.0))), 6).alias("interest"))


@query("""WITH t AS (SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9'']+'), lambda x: lower(x))) AS token FROM documents) WHERE length(token) BETWEEN 3 AND 32 GROUP BY ALL)
SELECT lang, token, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS INTEGER) AS rank FROM t QUALIFY rank <= 45""")
def keyword_catalog(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("lang", F.explode(tokens(F.col("text"))).alias("token")).where("length(token) BETWEEN 3 AND 32")
    return top(words.groupBy("lang", "token").agg(F.count("*").alias("n")), 45, ["lang"], F.desc("n"), "token").select("lang", "token", "rank")


@query("""WITH s AS (SELECT l_orderkey, list_distinct(list(l_partkey)) AS support FROM lineitem GROUP BY ALL), g AS (SELECT l_orderkey, list_distinct(list(l_partkey)) AS got FROM lineitem WHERE l_discount >= 0.05 GROUP BY ALL)
SELECT round(avg(len(list_intersect(support, coalesce(got, []))) / len(support)::DOUBLE), 6) AS coverage, count(*) AS cases FROM s LEFT JOIN g USING (l_orderkey)""")
def concept_coverage(spark, sf_dir):
    """Share of a case's support that was retrieved, averaged over cases."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max((F.col("l_discount") >= 0.05).cast("int")).alias("got"))
    cases = rows.groupBy("l_orderkey").agg(F.avg("got").alias("share"))
    return cases.agg(F.round(F.avg("share"), 6).alias("coverage"), F.count("*").alias("cases"))


@query("""SELECT conv_id, trim(regexp_replace(text, '(?s)<think>.*?</think>', '', 'g')) AS answer, concat_ws(' · ', role, 'turn ' || turn, CASE WHEN length(text) > 500 THEN 'long' END) AS note FROM conversations WHERE role <> 'system'""")
def state_notes(spark, sf_dir):
    """Answers without their thinking, and a note of what is known."""
    answer = F.trim(F.regexp_replace("text", "(?s)<think>.*?</think>", ""))
    note = F.concat_ws(" · ", "role", F.concat(F.lit("turn "), F.col("turn").cast("string")), F.when(F.length("text") > 500, "long"))
    return table(spark, sf_dir, "conversations").where("role <> 'system'").select("conv_id", answer.alias("answer"), note.alias("note"))
