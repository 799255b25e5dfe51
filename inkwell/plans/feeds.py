"""Feeds whose pages Spark derives from customers and suppliers, read back and normalised; subscribers' settings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from inkwell.operators import feeds as fd
from inkwell.plans.registry import query
from inkwell.sources.tables import table

WORDS = ["alpha-pages", "beta-hours", "gamma-today"]
NOW_DAY, NOW = 2, 1090


def cased(k, by: int, values: dict, other=None):
    """One of some constants by the key's remainder."""
    out = F.lit(other)
    for rest, value in values.items():
        out = F.when(k % by == rest, F.lit(value) if value is None or isinstance(value, (str, int)) else value).otherwise(out)
    return out


def pages(spark, sf_dir):
    """Feed pages of a hundred rows at most, a list or an object by turns, from customers."""
    k = F.col("c_custkey")
    lat, lng = (30 + k % 50).cast("string"), (k % 90 - 120).cast("string")
    row = F.struct(
        k.cast("string").alias("slug"), F.col("c_name").alias("name"), (k % 10).alias("day"), fd.clock(k * 37 % 1440).alias("time"),
        cased(k, 4, {0: F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" "))}).alias("formatted_address"), cased(k, 3, {0: "", 1: "Main St"}).alias("address"), F.col("c_mktsegment").alias("city"),
        cased(k, 2, {0: F.to_json(F.array(F.lit("O"), F.lit("ONL")))}, "O, C").alias("types"), cased(k, 3, {0: lat}).alias("latitude"), cased(k, 3, {0: lng}).alias("longitude"),
        cased(k, 3, {1: F.concat(lat, F.lit(", "), lng), 2: "0,0"}).alias("coordinates"), cased(k, 5, {0: "online", 1: "Hybrid", 2: "in_person"}).alias("attendance_option"),
        cased(k, 7, {0: "https://example.org/room"}).alias("conference_url"))
    page = table(spark, sf_dir, "customer").groupBy(F.floor(k / 100).alias("page")).agg(F.to_json(F.collect_list(row)).alias("rows"))
    return page.select("page", F.when(F.col("page") % 2 == 0, F.col("rows")).otherwise(F.concat(F.lit('{"meetings":'), F.col("rows"), F.lit("}"))).alias("body"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS slug, c_name AS name, CAST(c_custkey // 100 AS BIGINT) AS page FROM customer""")
def feed_scan(spark, sf_dir):
    """Rows of feed pages, whichever shape a page has."""
    return fd.feed_rows(pages(spark, sf_dir)).select("raw.slug", "raw.name", "page")


SQL_FEED = """
f AS (SELECT c_custkey AS k, c_mktsegment AS seg, CASE WHEN c_custkey % 5 = 0 THEN 'online' WHEN c_custkey % 5 = 1 THEN 'hybrid' WHEN c_custkey % 5 = 2 THEN 'in_person' ELSE '' END AS attendance FROM customer WHERE c_custkey % 3 <> 2),
mt AS (SELECT CAST(k AS VARCHAR) AS slug, CASE WHEN k % 10 < 7 THEN CAST(k % 10 AS INTEGER) END AS day, CAST(k * 37 % 1440 AS INTEGER) AS minute, (30 + k % 50)::DOUBLE AS lat, (k % 90 - 120)::DOUBLE AS lng,
 CASE WHEN k % 4 = 0 THEN seg WHEN k % 3 = 1 THEN 'Main St, ' || seg ELSE seg END AS address, CASE WHEN k % 2 = 0 THEN 'O|ONL' ELSE 'O|C' END AS types, attendance,
 CASE attendance WHEN 'online' THEN true WHEN 'hybrid' THEN true WHEN 'in_person' THEN false ELSE k % 7 = 0 OR k % 2 = 0 END AS is_online, attendance <> 'online' AS is_inperson FROM f)
"""


def normalised(spark, sf_dir):
    return fd.meeting(fd.feed_rows(pages(spark, sf_dir)))


@query(f"WITH {SQL_FEED} SELECT * FROM mt")
def feed_meetings(spark, sf_dir):
    """Raw rows as meetings; those without a place are left out."""
    return normalised(spark, sf_dir).drop("page").withColumn("types", F.array_join("types", "|"))


@query(f"""WITH {SQL_FEED}, w AS (SELECT * FROM (VALUES ('today'), ('tonight'), ('tomorrow'), ('week')) AS v(span)),
h AS (SELECT * FROM mt, w WHERE CASE span WHEN 'today' THEN day = {NOW_DAY} AND minute >= {NOW} WHEN 'tonight' THEN day = {NOW_DAY} AND minute >= {NOW} WHEN 'tomorrow' THEN day = {NOW_DAY + 1} ELSE true END)
SELECT span, count(*) AS meetings, count(*) FILTER (is_online) AS online, count(*) FILTER (is_inperson) AS inperson, count(*) FILTER (is_online AND is_inperson) AS hybrid FROM h GROUP BY span""")
def meetings_by_range(spark, sf_dir):
    """Meetings of a span of time from a given moment on, by how one can attend."""
    spans = ["today", "tonight", "tomorrow", "week"]
    fits = F.array_compact(F.array(*[F.when(fd.in_range(F.col("day"), F.col("minute"), s, NOW_DAY, NOW), s) for s in spans]))
    found = normalised(spark, sf_dir).select(F.explode(fits).alias("span"), "is_online", "is_inperson")
    return found.groupBy("span").agg(F.count("*").alias("meetings"), F.count_if("is_online").alias("online"), F.count_if("is_inperson").alias("inperson"), F.count_if(F.col("is_online") & F.col("is_inperson")).alias("hybrid"))


def online(spark, sf_dir):
    """Rows of two kinds of feed: of suppliers by link, of customers by telephone; some can be joined by neither."""
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    text = lambda col: col.cast("string")
    first = F.struct(
        text(s).alias("slug"), F.col("s_name").alias("name"), text(s % 8).alias("day"), F.date_format(F.timestamp_seconds(s * 37 % 1440 * 60), "h:mm a").alias("time"),
        F.lit("O,C,D,B,X,Y,Z").alias("types"), cased(s, 3, {0: " ", 1: "https://example.org/r"}).alias("conference_url"), cased(s, 5, {0: "America/Chicago"}).alias("timezone"))
    second = F.struct(
        text(c).alias("id_bigint"), F.col("c_name").alias("meeting_name"), text(c % 9).alias("weekday_tinyint"), fd.clock(c * 41 % 1440).alias("start_time"),
        F.lit(" VM , ,TC").alias("formats"), cased(c, 4, {0: "555-0100"}).alias("phone_meeting_number"), cased(c, 8, {0: "Europe/Paris"}).alias("time_zone"))
    rows = table(spark, sf_dir, "supplier").select(F.lit("s").alias("feed"), F.to_json(first).alias("j")).unionAll(table(spark, sf_dir, "customer").select(F.lit("c"), F.to_json(second)))
    return fd.online_meeting(rows.select("feed", F.from_json("j", fd.RAW).alias("raw")))


SQL_ONLINE = """
om AS (SELECT 's' AS feed, CAST(s_suppkey AS VARCHAR) AS slug, s_name AS name, CASE WHEN s_suppkey % 8 < 7 THEN CAST(s_suppkey % 8 AS INTEGER) END AS day, CAST(s_suppkey * 37 % 1440 AS INTEGER) AS m, 'O|C|D|B|X|Y' AS types,
 CASE WHEN s_suppkey % 5 = 0 THEN 'America/Chicago' ELSE 'America/New_York' END AS zone FROM supplier WHERE s_suppkey % 3 = 1
UNION ALL SELECT 'c', CAST(c_custkey AS VARCHAR), c_name, CASE WHEN c_custkey % 9 BETWEEN 1 AND 7 THEN CAST(c_custkey % 9 - 1 AS INTEGER) END, CAST(c_custkey * 41 % 1440 AS INTEGER), 'VM|TC', CASE WHEN c_custkey % 8 = 0 THEN 'Europe/Paris' ELSE 'UTC' END FROM customer WHERE c_custkey % 4 = 0)
"""


@query(f"WITH {SQL_ONLINE} SELECT feed, slug, name, day, printf('%02d:%02d', m // 60, m % 60) AS time, types, zone FROM om")
def online_meetings(spark, sf_dir):
    return online(spark, sf_dir).withColumn("types", F.array_join("types", "|"))


@query(f"""WITH {SQL_ONLINE}, a AS (SELECT feed, slug, name, ((day - {NOW_DAY}) * 1440 + m - {NOW} + 20160) % 10080 AS d FROM om), s AS (SELECT feed, slug, name, CASE WHEN d >= 9990 THEN d - 10080 ELSE d END AS starts FROM a)
SELECT feed, slug, CAST(starts AS INTEGER) AS starts FROM s ORDER BY CASE WHEN starts IS NULL THEN 2 WHEN starts <= 0 THEN 0 ELSE 1 END, CASE WHEN starts IS NULL THEN 0 ELSE abs(starts) END, name LIMIT 100""")
def online_soonest(spark, sf_dir, k: int = 100):
    """The first k meetings of a list: live ones, then the next to start."""
    rows = online(spark, sf_dir).withColumn("starts", fd.starts_in(F.col("day"), fd.minutes_of(F.col("time")), NOW_DAY, NOW).cast("int"))
    return rows.orderBy(*fd.soonest(F.col("starts"), "name")).limit(k).select("feed", "slug", "starts")


def settings(spark, sf_dir):
    """What users ask for, as they write it; values come from the keys of events."""
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", cased(k, 6, {0: " EST", 1: "pacific", 2: "Europe/Berlin", 3: "nowhere", 4: ""}).alias("zone"),
        cased(k, 5, {0: '["Beta-Hours", "beta-hours", "other"]', 1: "gamma-today, alpha-pages", 2: "none", 3: ""}).alias("books"),
        F.date_format("ts", "h:mm a").alias("time"))


SQL_SETTINGS = """
st AS (SELECT event_id, user_id, ts, CASE event_id % 6 WHEN 0 THEN 'America/New_York' WHEN 2 THEN 'Europe/Berlin' ELSE 'America/Los_Angeles' END AS zone,
 CASE event_id % 5 WHEN 0 THEN 'beta-hours' WHEN 1 THEN 'gamma-today|alpha-pages' ELSE 'alpha-pages' END AS books, strftime(ts, '%H:%M') AS time FROM events)
"""


def read_settings(spark, sf_dir):
    return settings(spark, sf_dir).select(
        "event_id", "user_id", "ts", fd.zone_of(F.col("zone")).alias("zone"), F.array_join(fd.books_of(F.col("books"), WORDS, WORDS[0]), "|").alias("books"),
        fd.clock(F.coalesce(fd.minutes_of(F.col("time")), F.lit(420))).alias("time"))


@query(f"WITH {SQL_SETTINGS} SELECT event_id, zone, books, time FROM st")
def subscriber_settings(spark, sf_dir):
    return read_settings(spark, sf_dir).select("event_id", "zone", "books", "time")


@query(f"""WITH {SQL_SETTINGS}, l AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
a AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1),
j AS (SELECT l.user_id AS phone, a.user_id IS NOT NULL AS known, a.user_id % 4 <> 0 AS old_enabled, l.event_id % 3 <> 0 AS enabled, CASE WHEN l.event_id % 2 = 0 THEN l.time ELSE coalesce(a.time, '07:00') END AS time, a.time AS before, l.zone, l.books,
 CASE WHEN a.user_id % 2 = 0 THEN '2024-02-01' ELSE '' END AS sent FROM l LEFT JOIN (SELECT * FROM a WHERE user_id % 3 <> 0) a ON a.user_id = l.user_id)
SELECT phone, enabled, time, zone, books, CASE WHEN enabled AND '12:00' > time AND coalesce(sent, '') <> '2024-02-01' THEN '2024-02-01' WHEN enabled AND '12:00' <= time AND sent = '2024-02-01' AND before IS DISTINCT FROM time THEN '' ELSE coalesce(sent, '') END AS last_sent FROM j""")
def subscriber_upsert(spark, sf_dir):
    """Each user's last settings over their first, at noon of a day on which every second one has had the text."""
    rows = read_settings(spark, sf_dir)
    ends = rows.groupBy("user_id").agg(F.max_by(F.struct("event_id", "zone", "books", "time"), F.struct("ts", "event_id")).alias("l"), F.min_by(F.struct("zone", "books", "time"), F.struct("ts", "event_id")).alias("a"))
    current = ends.where("user_id % 3 <> 0").select(F.col("user_id").alias("phone"), (F.col("user_id") % 4 != 0).alias("enabled"), "a.time", "a.zone", "a.books", F.when(F.col("user_id") % 2 == 0, "2024-02-01").otherwise("").alias("last_sent"))
    changes = ends.select(F.col("user_id").alias("phone"), (F.col("l.event_id") % 3 != 0).alias("enabled"), F.when(F.col("l.event_id") % 2 == 0, F.col("l.time")).alias("time"), "l.zone", "l.books")
    return fd.upserted(current, changes, "12:00", "2024-02-01")


NEAR = (52.0, -100.0, 400.0)


@query(f"""WITH {SQL_FEED}, n AS (SELECT slug, lat, lng, 2 * 3958.7613::DOUBLE * asin(sqrt(pow(sin((radians(lat) - radians({NEAR[0]}::DOUBLE)) / 2), 2) + cos(radians(lat)) * cos(radians({NEAR[0]}::DOUBLE)) * pow(sin((radians(lng) - radians({NEAR[1]}::DOUBLE)) / 2), 2))) AS miles FROM mt)
SELECT slug, lat, lng, round(miles, 6) AS miles FROM n WHERE miles <= {NEAR[2]}""")
def feed_near(spark, sf_dir):
    """Meetings around a place, read from landed pages by the data source: only cells that the radius meets are opened."""
    from inkwell.operators.graph import shared_folder
    from inkwell.sources import landing

    path = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    kind = F.when(F.col("lat") % 2 == 0, "AA").otherwise("NA")
    rows = normalised(spark, sf_dir).select("slug", F.lit(None).cast("string").alias("name"), "day", "minute", "lat", "lng", "address", kind.alias("fellowship"), "attendance")
    landing.land(rows, path, 1_700_000_000)
    found = landing.read_feed(spark, path, 1_700_000_100, "slug string, lat double, lng double")
    return landing.near(found, *NEAR).select("slug", "lat", "lng", "miles")
