"""Messages that ask for meetings, told by events: a user's texts, their places being nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import asks
from inkwell.plans.registry import query
from inkwell.sources.tables import table

#: What an event says, by its id; {} is a nation's name.
TEXTS = [
    "where's a meeting", "any AA meetings tonight in {}?", "more", "{}", "tomorrow?", "I went to a meeting today in {}", "NA meeting near {}", "online", "never mind",
    "I'm about to drink, where's a meeting", "visiting {} this week", "meeting right now near 94110",
]
SQL_SAID = """
nk AS (SELECT n_nationkey AS k, 'Nation' || chr(97 + n_nationkey) AS name FROM nation),
sd AS (SELECT event_id, user_id, epoch(ts)::BIGINT AS at, replace([""" + ", ".join("'" + t.replace("'", "''") + "'" for t in TEXTS) + """][(event_id * 7 + user_id) % 12 + 1], '{}', name) AS t
  FROM events JOIN nk ON k = event_id % 25)"""


def name_of():
    """A nation's name in letters, as people write places."""
    return F.concat(F.lit("Nation"), F.char(F.col("n_nationkey") + 97))


def said(spark, sf_dir):
    """(phone, at, text, area, event_id): events are many, nations 25."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), name_of().alias("name"))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    texts = F.array(*[F.lit(t) for t in TEXTS])
    named = events.withColumn("k", F.col("event_id") % 25).join(F.broadcast(nations), "k")
    text = F.replace(F.get(texts, ((F.col("event_id") * 7 + F.col("user_id")) % 12).cast("int")), F.lit("{}"), F.col("name"))
    area = F.when(F.col("user_id") % 3 == 0, F.col("name"))
    return named.select(F.col("user_id").cast("string").alias("phone"), "at", text.alias("text"), area.alias("area"), "event_id")


def places(spark, sf_dir):
    """Four of five nations: the fifth is a place that nobody knows."""
    return table(spark, sf_dir, "nation").where("n_nationkey % 5 < 4").select(F.lower(name_of()).alias("key"), name_of().alias("label"))


SQL_FIRST = lambda t: "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in t.items()) + " END"
QUOTED = lambda s: s.replace("'", "''")
SQL_PLACE = f"""CASE WHEN regexp_matches(t, '{asks.ZIP}') THEN regexp_extract(t, '{asks.ZIP}', 1) WHEN p0 <> '' AND lower(p0) NOT IN ({", ".join(f"'{w}'" for w in asks.NO_PLACE)}) AND NOT regexp_matches(p0, '{asks.MEETING}') THEN p0 END"""


@query(f"""WITH {SQL_SAID}, a AS (SELECT *, regexp_replace(regexp_extract(t, '{QUOTED(asks.PLACE)}', 1), '^[ ,.''-]+|[ ,.''-]+$', '', 'g') AS p0 FROM sd
  WHERE regexp_matches(t, '{asks.MEETING}') AND NOT regexp_matches(t, '{asks.TOLD}') AND (regexp_matches(t, '{QUOTED(asks.SEEKING)}') OR regexp_matches(t, '{asks.TIMED}') OR len(regexp_extract_all(t, '\\S+')) <= 4))
SELECT event_id, coalesce({SQL_FIRST(asks.WITHIN)}, 'upcoming') AS within, {SQL_FIRST(asks.FELLOWSHIPS)} AS fellowship, regexp_matches(t, '{asks.ONLINE}') AS online, {SQL_PLACE} AS place,
  regexp_matches(t, '{QUOTED(asks.URGENT)}') AS urgent FROM a""")
def meeting_asks(spark, sf_dir):
    """The messages that ask for a meeting, and what they ask."""
    return said(spark, sf_dir).select("event_id", asks.ask(F.col("text")).alias("a")).where("a IS NOT NULL").select("event_id", "a.*")


@query(f"""WITH {SQL_SAID} SELECT event_id, regexp_matches(t, '{asks.MORE}') AS more, {SQL_FIRST(asks.WITHIN)} AS within, {SQL_FIRST(asks.FELLOWSHIPS)} AS fellowship, regexp_matches(t, '{asks.ONLINE}') AS online
FROM sd WHERE len(regexp_extract_all(t, '\\S+')) <= 5""")
def ask_changes(spark, sf_dir):
    """What short messages change in an answer."""
    found = said(spark, sf_dir).select("event_id", asks.refinement(F.col("text")).alias("c")).where("c IS NOT NULL")
    return found.select("event_id", "c.more", "c.within", "c.fellowship", "c.online")


@query()
def talks(spark, sf_dir):
    """Replies to all messages, each user's in order: questions, answers, refinements. A fold over messages, so tests hold its cases."""
    return asks.replies(asks.read(said(spark, sf_dir), places(spark, sf_dir)))


@query("""WITH s AS (SELECT s_suppkey AS k, s_name, s_suppkey || ' ' || n_name || ' Street, Town' AS s_address, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey),
m AS (SELECT *, k % 7 AS day, (k * 37) % 1440 AS minute, (((k % 7) - 5) * 1440 + (k * 37) % 1440 - 1110 + 20160) % 10080 AS until FROM s),
c AS (SELECT *, (CASE WHEN (minute // 60) % 12 = 0 THEN 12 ELSE (minute // 60) % 12 END) || ':' || lpad((minute % 60)::VARCHAR, 2, '0') || CASE WHEN minute >= 720 THEN ' PM' ELSE ' AM' END AS clock FROM m),
w AS (SELECT *, CASE WHEN until = 0 THEN 'starting now (' || clock || ')' WHEN until <= 60 THEN 'in ' || until || ' min (' || clock || ')' WHEN day = 5 THEN clock || CASE WHEN minute >= 1020 THEN ' tonight' ELSE ' today' END
  WHEN day = 6 THEN clock || ' tomorrow' ELSE clock || ' ' || ['Sunday', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday'][day + 1] END AS whn,
  trim(regexp_replace(s_name, '\\s+', ' ', 'g')) AS nm, trim(regexp_replace(string_split(s_address, ',')[1], '\\s+', ' ', 'g')) AS st FROM c)
SELECT k AS s_suppkey, whn || ': ' || CASE WHEN length(nm) <= 36 THEN nm ELSE rtrim(nm[1:35]) || '…' END || ' (AA)' || CASE WHEN n_name <> '' THEN ', ' || n_name ELSE '' END
  || CASE WHEN st <> '' AND lower(st) <> lower(n_name) THEN ', ' || CASE WHEN length(st) <= 30 THEN st ELSE rtrim(st[1:29]) || '…' END ELSE '' END AS line FROM w""")
def meeting_lines(spark, sf_dir):
    """Suppliers as weekly meetings, each as a reply's line on a Friday at half past six."""
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("s_nationkey"))
    day, minute = (F.col("s_suppkey") % 7).cast("int"), ((F.col("s_suppkey") * 37) % 1440).cast("int")
    line = asks.meeting_line(F.col("s_name"), F.lit(None).cast("string"), day, minute, F.col("n_name"), F.concat_ws(" ", F.col("s_suppkey").cast("string"), "n_name", F.lit("Street, Town")), F.lit(None).cast("double"), F.lit(5), F.lit(1110))
    return s.select("s_suppkey", line.alias("line"))
