"""Feeds, messages, names, windows and packing on fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from inkwell.operators import concepts as cn
from inkwell.operators import feeds as fd
from inkwell.operators import retrieval as rt
from inkwell.operators import training as tr


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("said, want", [
    ("7:30 am", 450), ("8pm", 1200), ("12 a.m.", 0), ("19:05", 1145), ("99:99", 23 * 60 + 59), ("7:5", None), ("1:23:45", None), ("123", None), ("8 p.m.", 1200), ("13 pm", 780), ("0 pm", 720), ("noon", None), ("", None), (None, None)])
def test_clock_times(spark, said, want):
    assert one(spark, said, fd.minutes_of) == want


@pytest.mark.parametrize("text, action, time, zone", [
    ("PAUSE daily", "pause", None, None), ("send now", "send_now", None, None), ("My Schedule", "status", None, None), ("daily 7:00 AM pt", "subscribe", "07:00", "America/Los_Angeles"),
    ("Please send me the daily reflection at 7:30am EST", "subscribe", "07:30", "America/New_York"), ("what is the daily reflection at 7 am", None, None, None), ("hello", None, None, None), (None, None, None, None),
    ("Subscribe 24 hours a day at 8", "subscribe", None, None), ("DAILY", "subscribe", None, None), ("daily at 19:15, utc", "subscribe", "19:15", "UTC"), ("text me a meditation every morning at 6 a.m.", "subscribe", "06:00", None),
    ("at 6 am I like the daily text; text me", None, None, None), ("send me the reflection", None, None, None), ("how do I subscribe", None, None, None), ("subscribe 12pm mountain", "subscribe", "12:00", "America/Denver"), ("", None, None, None)])
def test_commands(spark, text, action, time, zone):
    got = one(spark, text, fd.command)
    assert (got is None and action is None) or (got["action"], got["time"], got["zone"]) == (action, time, zone)


def test_zones_and_books(spark):
    assert [one(spark, z, fd.zone_of) for z in (" EST", "Europe/Berlin", "Foo/Bar", "pacific", None)] == ["America/New_York", "Europe/Berlin", fd.ZONE, "America/Los_Angeles", fd.ZONE]
    books = {"first": ["reflection"], "second": ["24 hour", "twenty four"]}
    named = lambda x: fd.named_books(x, books, ["all", "both"])
    assert [one(spark, t, named) for t in ("Both please", "Twenty Four and reflection", "nothing", None)] == [["first", "second"], ["first", "second"], None, None]


def test_feed_pages_of_any_shape(spark):
    row = {"slug": "a", "latitude": "34.5", "longitude": "-118", "types": ["O", "ONL"], "day": 3, "time": "19:30", "city": "Ojai", "address": "1 Main"}
    nowhere = {"slug": "b", "latitude": "0", "longitude": "0"}
    bodies = [json.dumps([row, nowhere]), json.dumps({"meetings": [dict(row, slug="c", types="O, C", coordinates="1,2", latitude=None)]}), "[]", "", "oops", None]
    got = fd.meeting(fd.feed_rows(spark.createDataFrame([(b,) for b in bodies], "body string"))).orderBy("slug").collect()
    assert [r["slug"] for r in got] == ["a", "c"]
    assert (got[0]["types"], got[0]["address"], got[0]["is_online"], got[0]["minute"]) == (["O", "ONL"], "1 Main, Ojai", True, 1170)
    assert (got[1]["types"], got[1]["lat"], got[1]["lng"], got[1]["is_online"], got[1]["is_inperson"]) == (["O", "C"], 1.0, 2.0, False, True)


def test_tonight_after_midnight(spark):
    rows = spark.createDataFrame([(2, 100), (2, 300), (2, 1200), (3, 60)], "day int, minute int")
    keep = lambda *a: [tuple(r) for r in rows.where(fd.in_range(F.col("day"), F.col("minute"), *a)).collect()]
    assert keep("tonight", 2, 90) == [(2, 100)]
    assert keep("tonight", 2, 600) == [(2, 1200)]
    assert keep("tomorrow", 2, 600) == [(3, 60)]


def test_upsert(spark):
    columns = "phone long, enabled boolean, time string, zone string, books string, last_sent string"
    current = spark.createDataFrame([(1, True, "07:00", "UTC", "a", "d"), (2, True, "07:00", "UTC", "a", "d"), (3, True, "07:00", "UTC", "a", "")], columns)
    changes = spark.createDataFrame([(1, True, "18:00", None, None), (3, True, None, None, "b"), (4, False, None, None, None)], "phone long, enabled boolean, time string, zone string, books string")
    got = {r["phone"]: tuple(r)[1:] for r in fd.upserted(current, changes, "12:00", "d").collect()}
    assert got == {1: (True, "18:00", "UTC", "a", ""), 2: (True, "07:00", "UTC", "a", "d"), 3: (True, "07:00", "UTC", "b", "d"), 4: (False, "07:00", fd.ZONE, "", "")}


def test_names_of_one_person(spark):
    people = spark.createDataFrame([("Jung", 9), ("Carl Jung", 4), ("C. Jung", 2), ("Dr. Smith", 5), ("Bob Smith", 1), ("Anne Smith", 1), ("Carl Jung's", 1), ("", 1)], "label string, count int")
    got = {r["label"]: r["person"] for r in cn.folded_names(people).collect()}
    assert got == {"Jung": "Carl Jung", "Carl Jung": "Carl Jung", "C. Jung": "Carl Jung", "Carl Jung's": "Carl Jung", "Dr. Smith": "Dr. Smith", "Bob Smith": "Bob Smith", "Anne Smith": "Anne Smith"}


@pytest.mark.parametrize("label, key, sane", [
    ("Character Defects", "character defect", True), ("Carrying the Message", "carry message", True), ("Wait, no", "wait no", False), ("a b a b a b a", "b b b", False), ("1234 x", "1234 x", False), ("Is it?", "is it", False)])
def test_labels(spark, label, key, sane):
    assert one(spark, label, cn.merge_key) == key
    assert one(spark, label, cn.sane_label) is sane


def test_best_window_is_the_plain_one(spark):
    text = "x" * 130 + "Alpha beta " + "y" * 90 + "gamma" + "z" * 300 + "alpha gamma beta"
    terms = ["alpha", "beta", "gamma"]
    want = max(((sum(t in text.lower()[p:p + 125] for t in terms), -p) for p in range(0, len(text), 50)))
    rows = spark.createDataFrame([(text, terms), ("", terms), (None, terms)], "text string, terms array<string>")
    got = [r["w"] for r in rows.select(rt.best_window(F.col("text"), F.col("terms")).alias("w")).collect()]
    assert (got[0]["hits"], got[0]["start"]) == (want[0], -want[1])
    assert (got[1]["hits"], got[1]["start"]) == (0, 0)


def test_packing_is_the_greedy_one(spark):
    sizes = [5, 3, 9, 0, 25, 1, 10, None, 2]
    got = [tuple(r) for r in tr.packed(spark.createDataFrame(list(enumerate(sizes)), "id long, n int"), "id", "n", 10, shard=6).orderBy("id").collect()]
    want, pack, filled = [], 0, 0
    for i, n in enumerate(sizes):
        n = n or 0
        if i % 6 == 0:
            pack, filled = 0, 0
        if filled and filled + n > 10:
            pack, filled = pack + 1, 0
        want.append((i, i // 6, pack, filled, min(n, 10)))
        filled += n
    assert got == want


def test_first_by_hash_is_the_ranked_one(spark):
    rows = spark.range(700).select("id", F.when(F.col("id") % 7 != 0, F.col("id") % 3).alias("g"))
    h = F.md5(F.floor(F.col("id") / 5).cast("string").cast("binary"))  # ties of five
    got = {r["id"] for r in tr.first_by_hash(rows, "g", h, F.floor(F.lit(0.37) * F.col("size")), "id").where("chosen").collect()}
    groups = {}
    for r in rows.withColumn("h", h).collect():
        groups.setdefault(r["g"], []).append((r["h"], r["id"]))
    assert got == {i for g in groups.values() for _, i in sorted(g)[:int(0.37 * len(g))]}
