"""Asks for meetings and talks over several messages."""

import tempfile

import pytest
from pyspark.sql import functions as F

from inkwell.operators import asks

PLACES = [("94110", "San Francisco, CA"), ("oakland", "Oakland, CA"), ("berkeley", "Berkeley, CA")]
START = 1_600_000_000
MESSAGES = "phone string, at long, text string, area string"
#: (phone, minute, text, area) -> kind, place, guess, saved, skip, within, fellowship
TALKS = [
    ("p1", 0, "where's a meeting", None, ("which place", None, None, False, 0, "upcoming", None)),
    ("p1", 1, "94110", None, ("meetings", "San Francisco, CA", None, True, 0, "upcoming", None)),
    ("p1", 9, "wheres a meeting", None, ("meetings", "San Francisco, CA", None, False, 0, "upcoming", None)),
    ("p2", 0, "any AA meetings tonight in Oakland?", None, ("meetings", "Oakland, CA", None, True, 0, "tonight", "AA")),
    ("p3", 0, "meeting near 94110", None, ("meetings", "San Francisco, CA", None, True, 0, "upcoming", None)),
    ("p3", 1, "more", None, ("meetings", "San Francisco, CA", None, False, 3, "upcoming", None)),
    ("p3", 2, "tomorrow?", None, ("meetings", "San Francisco, CA", None, False, 0, "tomorrow", None)),
    ("p3", 3, "thanks!", None, None),
    ("p3", 60, "more", None, None),  # half an hour later the answer is forgotten
    ("p5", 0, "online meeting now", None, ("online", None, None, False, 0, "now", None)),
    ("p7", 0, "where's a meeting", None, ("which place", None, None, False, 0, "upcoming", None)),
    ("p7", 1, "never mind", None, None), ("p7", 2, "94110", None, None),
    ("p8", 0, "meeting in Atlantis", None, ("unknown place", "Atlantis", None, False, 0, "upcoming", None)),
    ("p8", 1, "94110", None, ("meetings", "San Francisco, CA", None, True, 0, "upcoming", None)),
    ("p9", 0, "I'm in recovery and visiting Oakland this week", None, None), ("p9", 1, "it's hard", None, None),
    ("p9", 2, "wheres a meeting", None, ("meetings", "Oakland, CA", "mention", False, 0, "upcoming", None)),
    ("p13", 0, "wheres a meeting", "Berkeley", ("meetings", "Berkeley, CA", "area", False, 0, "upcoming", None)),
    ("p13", 1, "more", "Berkeley", ("meetings", "Berkeley, CA", None, False, 3, "upcoming", None)),
    ("p13", 2, "in Oakland", "Berkeley", ("meetings", "Oakland, CA", None, True, 0, "upcoming", None)),
    ("p14", 0, None, None, None), ("p14", 0, "", None, None),
    ("p15", 0, "meeting near 94110", None, ("meetings", "San Francisco, CA", None, True, 0, "upcoming", None)),
    ("p15", 31 * 24 * 60, "where is a meeting", None, ("which place", None, None, False, 0, "upcoming", None)),
]


def plain(rows):
    return {(r.phone, r.at): (r.kind, r.place, r.guess, r.saved, r.skip, r.within, r.fellowship) for r in rows}


WANT = {(p, START + m * 60): want for p, m, _, _, want in TALKS if want}


@pytest.fixture(scope="module")
def talk(spark):
    rows = spark.createDataFrame([(p, START + m * 60, t, a) for p, m, t, a, _ in TALKS], MESSAGES)
    return asks.read(rows, spark.createDataFrame(PLACES, "key string, label string"))


def test_what_asks_and_what_does_not(spark):
    yes = ["where's a meeting", "Where is a meeting?", "any meetings tonight?", "NA meeting near 94110", "I need a meeting", "is there a meeting nearby", "meetings?", "meeting",
           "closest meeting", "online meeting now", "where can I find a meeting in Denver", "any AA mtgs around here", "wheres the nearest meetin"]
    no = ["I went to a meeting today and it was great", "how do I share at a meeting?", "I'm scared to go to my first meeting", "what happens at an AA meeting",
          "my home group meeting was tense tonight", "what does the book say about fear", "I feel so alone tonight", "", None]
    rows = spark.createDataFrame([(t,) for t in yes + no], "t string").select("t", asks.ask(F.col("t")).alias("a")).collect()
    assert {r.t for r in rows if r.a} == set(yes)
    by = {r.t: r.a for r in rows}
    assert (by["NA meeting near 94110"].fellowship, by["NA meeting near 94110"].place) == ("NA", "94110")
    assert by["where can I find a meeting in Denver"].place == "Denver" and by["online meeting now"].online and by["any meetings tonight?"].within == "tonight"


def test_talks(talk):
    assert plain(asks.replies(talk).collect()) == WANT


def test_large_tables_of_places_are_joined(spark, monkeypatch):
    monkeypatch.setattr(asks, "BROADCAST_PLACES", 0)
    rows = spark.createDataFrame([(p, START + m * 60, t, a) for p, m, t, a, _ in TALKS], MESSAGES)
    assert plain(asks.replies(asks.read(rows, spark.createDataFrame(PLACES, "key string, label string"))).collect()) == WANT


def test_talks_on_a_stream(spark, talk):
    folder, out, mark = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    rows = talk.withColumn("ts", F.col("at").cast("timestamp"))
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(folder)
    for k, part in enumerate((rows.where(F.col("at") < START + 60), rows.where(F.col("at") == START + 60), rows.where(F.col("at") > START + 60))):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/part={k}")
        query = asks.reply_stream(stream).writeStream.format("parquet").option("checkpointLocation", mark).option("path", out).trigger(availableNow=True).start()
        query.awaitTermination()
    assert plain(spark.read.parquet(out).collect()) == WANT


def test_labels_and_lines(spark):
    rows = spark.createDataFrame([("94110, San Francisco, California",), ("Oakland",), ("94110",), ("A, B, C",), ("",), (None,)], "l string")
    assert [r.s for r in rows.select(asks.short_label(F.col("l")).alias("s")).collect()] == ["San Francisco, CA", "Oakland", "94110", "A, B", "", None]
    meeting = "name string, f string, day int, minute int, venue string, address string, miles double"
    rows = [("Early  Birds", None, 5, 19 * 60, "Hall", "1 Oak St, City", 2.5), ("Late", "NA", 5, 23 * 60, "", "Hall, City", 3.0), ("Next", "AA", 6, 7 * 60, "X", "x", 12.25), ("N" * 40, "AA", 0, 0, None, None, None)]
    line = asks.meeting_line(*[F.col(c) for c in ("name", "f", "day", "minute", "venue", "address", "miles")], F.lit(5), F.lit(18 * 60 + 30))
    got = [r.s for r in spark.createDataFrame(rows, meeting).select(line.alias("s")).collect()]
    assert got == ["in 30 min (7:00 PM): Early Birds (AA), Hall, 1 Oak St, 2.5 mi", "11:00 PM tonight: Late (NA), Hall, 3 mi", "7:00 AM tomorrow: Next (AA), X, 12.25 mi", f"12:00 AM Sunday: {'N' * 35}… (AA)"]
