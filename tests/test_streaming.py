"""Streams drained once against their batch twins."""

import os

import pytest
from pyspark.sql import functions as F

from inkwell.streaming import activity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def drained(stream, name, mode):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    return stream.sparkSession.sql(f"SELECT * FROM {name}")


def test_daily_users(spark):
    got = {r.day.date(): r.events for r in drained(activity.daily_users(activity.event_stream(spark, SF)), "daily", "complete").collect()}
    want = {r.d: r.n for r in spark.read.parquet(f"{SF}/events.parquet").groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_once_a_day(spark):
    got = drained(activity.once_a_day(activity.event_stream(spark, SF)), "once", "append").count()
    assert got == spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.to_date("ts")).distinct().count()


def test_rate_limit(spark):
    rows = drained(activity.rate_limited(activity.event_stream(spark, SF), 2, 86400), "rate", "append").collect()
    assert sum(r.seen for r in rows) == spark.read.parquet(f"{SF}/events.parquet").count()
    assert all(r.refused == max(0, r.seen - 2) for r in rows)


def test_snapshot(spark, tmp_path):
    events = activity.event_stream(spark, SF)
    activity.keep_snapshot(events, str(tmp_path / "s"), str(tmp_path / "c"), ["user_id"], "ts").awaitTermination(120)
    from inkwell.sources.sinks import read_current

    assert read_current(spark, str(tmp_path / "s")).count() == spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().count()
