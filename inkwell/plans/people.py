"""Meetings derived from customers and suppliers, and activity over events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.text import identity
from inkwell.operators import schedule as sc
from inkwell.operators.ranking import top
from inkwell.plans.registry import query
from inkwell.sources.sinks import latest
from inkwell.sources.tables import table

SQL_MEETINGS = """
mt AS (SELECT c_custkey AS id, c_name AS name, 'c' AS feed, CAST(c_custkey % 7 AS INTEGER) AS day, CAST((c_custkey * 37) % 1440 AS INTEGER) AS minute, CAST(30 + (c_custkey * 13) % 1000 / 100.0::DOUBLE AS DOUBLE) AS lat, CAST(-120 + (c_custkey * 29) % 2000 / 100.0::DOUBLE AS DOUBLE) AS lng, c_mktsegment AS kind FROM customer
UNION ALL SELECT s_suppkey, s_name, 's', CAST(s_suppkey % 7 AS INTEGER), CAST((s_suppkey * 37) % 1440 AS INTEGER), CAST(30 + (s_suppkey * 13) % 1000 / 100.0::DOUBLE AS DOUBLE), CAST(-120 + (s_suppkey * 29) % 2000 / 100.0::DOUBLE AS DOUBLE), 'BUILDING' FROM supplier)
"""


def meetings(spark, sf_dir):
    """The tables hold no places: weekday, minute and coordinates come from the keys by a fixed rule."""

    def placed(rows, key, name, kind, feed):
        k = F.col(key)
        return rows.select(
            k.alias("id"), F.col(name).alias("name"), F.lit(feed).alias("feed"), (k % 7).cast("int").alias("day"), ((k * 37) % 1440).cast("int").alias("minute"),
            (F.lit(30) + (k * 13) % 1000 / F.lit(100.0)).alias("lat"), (F.lit(-120) + (k * 29) % 2000 / F.lit(100.0)).alias("lng"), kind.alias("kind"))

    customers = placed(table(spark, sf_dir, "customer"), "c_custkey", "c_name", F.col("c_mktsegment"), "c")
    return customers.unionByName(placed(table(spark, sf_dir, "supplier"), "s_suppkey", "s_name", F.lit("BUILDING"), "s"))


PLACES = [(1, 34.05, -118.24), (2, 37.77, -112.42), (3, 39.5, -105.0)]
SQL_NEAR = f"""{SQL_MEETINGS}, q AS (SELECT * FROM (VALUES {', '.join(f'({q}, {a}::DOUBLE, {b}::DOUBLE)' for q, a, b in PLACES)}) AS v(qid, qlat, qlng)),
ha AS (SELECT *, 2 * 3958.8::DOUBLE * asin(least(sqrt(pow(sin(radians(lat - qlat) / 2), 2) + cos(radians(qlat)) * cos(radians(lat)) * pow(sin(radians(lng - qlng) / 2), 2)), 1)) AS miles FROM mt, q)
"""


def near(spark, sf_dir, miles: float):
    asked = spark.createDataFrame(PLACES, "qid int, qlat double, qlng double")
    return sc.within(F.broadcast(asked), meetings(spark, sf_dir), miles)


@query(f"""WITH {SQL_NEAR}, n AS (SELECT *, ((day - 2) * 1440 + minute - 600 + 10080) % 10080 AS until FROM ha WHERE miles <= 60)
SELECT qid, feed, id, round(miles, 6) AS miles, CAST(until AS INTEGER) AS until, CASE WHEN minute // 60 BETWEEN 5 AND 11 THEN 'morning' WHEN minute // 60 BETWEEN 12 AND 16 THEN 'afternoon' WHEN minute // 60 BETWEEN 17 AND 20 THEN 'evening' ELSE 'late' END AS part,
 CAST(row_number() OVER (PARTITION BY qid ORDER BY until, round(miles, 6), feed, id) AS INTEGER) AS rank FROM n QUALIFY rank <= 20""")
def meetings_near(spark, sf_dir):
    """Within 60 miles, the soonest from Tuesday 10:00 on."""
    found = near(spark, sf_dir, 60.0).withColumn("until", sc.minutes_until(F.col("day"), F.col("minute"), 2, 600).cast("int")).withColumn("miles", F.round("miles", 6))
    found = found.withColumn("part", sc.day_part(F.col("minute")))
    return top(found, 20, ["qid"], "until", "miles", "feed", "id").select("qid", "feed", "id", "miles", "until", "part", "rank")


@query(f"""WITH {SQL_MEETINGS}, k AS (SELECT *, row_number() OVER (PARTITION BY day, minute, round(lat, 3), round(lng, 3), kind ORDER BY feed, id) AS n FROM mt) SELECT feed, id, day, minute, kind FROM k WHERE n = 1""")
def meetings_distinct(spark, sf_dir):
    """The same meeting from several feeds once, the first feed's row."""
    keyed = meetings(spark, sf_dir).withColumn("y", F.round("lat", 3)).withColumn("x", F.round("lng", 3))
    return latest(keyed, ["day", "minute", "y", "x", "kind"], "feed", "id").select("feed", "id", "day", "minute", "kind")


@query(f"""WITH {SQL_NEAR}, r AS (SELECT unnest([10, 30, 60, 120]) AS radius), c AS (SELECT qid, radius, count(*) AS n FROM ha JOIN r ON miles <= radius GROUP BY ALL)
SELECT qid, min(radius) AS radius FROM c WHERE n >= 5 GROUP BY qid""")
def widened_radius(spark, sf_dir):
    """The smallest radius with five meetings or more."""
    found = near(spark, sf_dir, 120.0)
    radius = F.explode(F.array(*[F.lit(r) for r in (10, 30, 60, 120)]))
    counts = found.select("qid", "miles", radius.alias("radius")).where("miles <= radius").groupBy("qid", "radius").agg(F.count("*").alias("n"))
    return counts.where("n >= 5").groupBy("qid").agg(F.min("radius").alias("radius"))


@query(f"""WITH {SQL_MEETINGS}, d AS (SELECT feed, day, count(*) AS n FROM mt GROUP BY ALL), l AS (SELECT *, lag(n) OVER (PARTITION BY feed ORDER BY day) AS before FROM d)
SELECT feed, day, n, before, CASE WHEN n = 0 THEN 'empty' WHEN before IS NOT NULL AND n <= 0.5 * before THEN 'dropped' ELSE 'ok' END AS status FROM l""")
def feed_health(spark, sf_dir):
    counts = meetings(spark, sf_dir).groupBy("feed", "day").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.lag("n").over(Window.partitionBy("feed").orderBy("day")))
    return counts.withColumn("status", F.when(F.col("n") == 0, "empty").when(F.col("n") <= 0.5 * F.col("before"), "dropped").otherwise("ok"))


@query(f"""WITH {SQL_MEETINGS} SELECT kind, round(lat, 0) AS y, count(*) AS n, string_agg(DISTINCT CAST(day AS VARCHAR), ',' ORDER BY CAST(day AS VARCHAR)) AS days FROM mt GROUP BY kind, round(lat, 0)""")
def meeting_groups(spark, sf_dir):
    groups = meetings(spark, sf_dir).groupBy("kind", F.round("lat", 0).alias("y"))
    return groups.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("day").cast("string"))), ",").alias("days"))


def activity(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"), "ts", "user_id", F.col("event_type").alias("channel"), "value", "props")


@query("""WITH a AS (SELECT CAST(ts AS DATE) AS day, user_id, event_type FROM events)
SELECT CAST(day AS VARCHAR) AS day, count(DISTINCT user_id) AS users, count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS viewers, count(*) AS events FROM a GROUP BY day""")
def daily_active(spark, sf_dir):
    viewer = F.when(F.col("channel") == "view", F.col("user_id"))
    return activity(spark, sf_dir).groupBy("day").agg(F.countDistinct("user_id").alias("users"), F.countDistinct(viewer).alias("viewers"), F.count("*").alias("events")).withColumn("day", F.col("day").cast("string"))


@query("""WITH a AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events), d AS (SELECT DISTINCT day FROM a)
SELECT CAST(d.day AS VARCHAR) AS day, count(DISTINCT user_id) FILTER (a.day > d.day - 7) AS week, count(DISTINCT user_id) AS month FROM d JOIN a ON a.day <= d.day AND a.day > d.day - 30 GROUP BY d.day""")
def rolling_active(spark, sf_dir):
    """Exact distinct users of the last 7 and 30 days: a user-day counts towards the days it reaches."""
    one = activity(spark, sf_dir).select("day", "user_id").distinct()
    known = one.agg(F.max("day").alias("last"))
    reach = one.crossJoin(F.broadcast(known)).select("user_id", F.col("day").alias("seen"), F.explode(F.sequence("day", F.least(F.date_add("day", 29), "last"))).alias("day"))
    near = reach.groupBy("day", "user_id").agg(F.max("seen").alias("seen"))
    days = one.select("day").distinct()
    return near.join(days, "day", "left_semi").groupBy("day").agg(F.count_if(F.datediff("day", "seen") < 7).alias("week"), F.count("*").alias("month")).withColumn("day", F.col("day").cast("string"))


@query()
def rolling_sketches(spark, sf_dir):
    """The same from daily sketches: unions of at most 30 small sketches a day; estimates."""
    daily = activity(spark, sf_dir).groupBy("day").agg(F.hll_sketch_agg("user_id", F.lit(12)).alias("sketch"))
    known = daily.agg(F.max("day").alias("last"))
    reach = daily.crossJoin(F.broadcast(known)).select("sketch", F.col("day").alias("seen"), F.explode(F.sequence("day", F.least(F.date_add("day", 29), "last"))).alias("day"))
    week = F.when(F.datediff("day", "seen") < 7, F.col("sketch"))
    return reach.groupBy("day").agg(F.hll_sketch_estimate(F.hll_union_agg(week)).alias("week"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("month"))


@query("""WITH a AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS g FROM a),
r AS (SELECT user_id, min(day) AS start, max(day) AS stop, count(*) AS length FROM i GROUP BY user_id, g)
SELECT user_id, CAST(max(length) AS BIGINT) AS best, CAST(coalesce(max(CASE WHEN stop >= DATE '2024-01-29' THEN length END), 0) AS BIGINT) AS current FROM r GROUP BY user_id""")
def streaks(spark, sf_dir):
    runs = sc.runs(activity(spark, sf_dir), "user_id", "day")
    current = F.coalesce(F.max(F.when(F.col("end") >= F.lit("2024-01-29").cast("date"), F.col("length"))), F.lit(0))
    return runs.groupBy("user_id").agg(F.max("length").alias("best"), current.cast("long").alias("current"))


@query("""WITH u AS (SELECT DISTINCT user_id FROM events), g AS (SELECT user_id, CAST(d AS DATE) AS day FROM u, (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS d)),
m AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_max(value, (ts, event_id)) AS mood FROM events GROUP BY ALL)
SELECT user_id, CAST(day AS VARCHAR) AS day, mood FROM g LEFT JOIN m USING (user_id, day)""")
def calendar_grid(spark, sf_dir):
    """Every day of the month for each user with the day's last value, null where there is none."""
    acts = activity(spark, sf_dir)
    days = F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date")))
    grid = acts.select("user_id").distinct().select("user_id", days.alias("day"))
    mood = acts.groupBy("user_id", "day").agg(F.max_by("value", F.struct("ts", "event_id")).alias("mood"))
    return grid.join(mood, ["user_id", "day"], "left").withColumn("day", F.col("day").cast("string"))


@query("""SELECT user_id, event_id, event_type AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_state(spark, sf_dir):
    """What upserts leave: each user's last row."""
    return latest(activity(spark, sf_dir), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", F.col("channel").alias("status"))


@query("""SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100""")
def recent_reports(spark, sf_dir):
    return activity(spark, sf_dir).where("channel = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "user_id")


@query("""SELECT user_id, props, ts FROM (SELECT user_id, props, max(ts) AS ts FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, props) <= 12""")
def recency_list(spark, sf_dir):
    """Each user's last twelve distinct items, moved to the front when seen again."""
    seen = activity(spark, sf_dir).groupBy("user_id", "props").agg(F.max("ts").alias("ts"))
    return top(seen, 12, ["user_id"], F.desc("ts"), "props").drop("rank")


@query("""WITH o AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM o) SELECT user_id, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, n""")
def user_sessions(spark, sf_dir):
    """Sessions that end after four hours without an event."""
    acts = activity(spark, sf_dir)
    return acts.groupBy("user_id", F.session_window("ts", "4 hours")).agg(F.min("ts").alias("start"), F.count("*").alias("events")).select("user_id", "start", "events")


@query("""WITH d AS (SELECT ts, event_id, CASE WHEN event_type IN ('signup', 'view') THEN 1 ELSE -1 END AS step, user_id FROM events), r AS (SELECT user_id, greatest(sum(step) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS live FROM d)
SELECT user_id, CAST(max(live) AS BIGINT) AS most, CAST(count(*) FILTER (live > 2) AS BIGINT) AS refused FROM r GROUP BY user_id""")
def concurrency_gate(spark, sf_dir):
    step = F.when(F.col("channel").isin("signup", "view"), 1).otherwise(-1)
    live = F.greatest(F.sum(step).over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.lit(0))
    return activity(spark, sf_dir).select("user_id", live.alias("live")).groupBy("user_id").agg(F.max("live").alias("most"), F.count_if(F.col("live") > 2).alias("refused"))


@query("""SELECT user_id, substr(sha256('sc-user:' || user_id), 1, 24) AS identity, CAST(count(DISTINCT CAST(ts AS DATE)) AS BIGINT) AS days FROM events GROUP BY user_id""")
def user_identity(spark, sf_dir):
    return activity(spark, sf_dir).groupBy("user_id").agg(F.countDistinct("day").alias("days")).select("user_id", identity(F.col("user_id")).alias("identity"), "days")


@query("""WITH s AS (SELECT user_id, CAST(min(ts) AS DATE) AS since FROM events GROUP BY user_id), m AS (SELECT unnest([1, 7, 14, 30, 60, 90]) AS days), d AS (SELECT user_id, date_diff('day', since, DATE '2024-02-10') AS n FROM s)
SELECT user_id, n, max(days) FILTER (days <= n) AS reached, min(days) FILTER (days > n) AS next FROM d, m GROUP BY user_id, n""")
def milestones(spark, sf_dir):
    since = activity(spark, sf_dir).groupBy("user_id").agg(F.min("day").alias("since"))
    marks = F.array(*[F.lit(d) for d in (1, 7, 14, 30, 60, 90)])
    n = F.datediff(F.lit("2024-02-10").cast("date"), "since")
    rows = since.select("user_id", n.cast("long").alias("n"), marks.alias("m"))
    return rows.select("user_id", "n", F.array_max(F.filter("m", lambda d: d <= F.col("n"))).alias("reached"), F.array_min(F.filter("m", lambda d: d > F.col("n"))).alias("next"))


@query("""WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'user')
SELECT conv_id, string_agg(left(text, 80), ' | ' ORDER BY n) AS context, count(*) AS turns FROM r WHERE n <= 4 GROUP BY conv_id""")
def follow_up_context(spark, sf_dir):
    """A conversation's last four questions, latest first."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    last = top(turns, 4, ["conv_id"], F.desc("turn"))
    parts = last.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.substring("text", 1, 80).alias("t")))).alias("p"), F.count("*").alias("turns"))
    return parts.select("conv_id", F.array_join(F.transform("p", lambda x: x["t"]), " | ").alias("context"), "turns")
