"""Structured Streaming over an events stream: windows, once-a-day sends, rate limits, snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events from a folder of parquet files; the zone-less times become instants for watermarks."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    read = spark.readStream.schema(schema).option("pathGlobFilter", "events*").parquet(folder)
    return read.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_users(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Users and events of each day, by sketch; rows later than the watermark are left out."""
    day = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"))
    return day.agg(F.approx_count_distinct("user_id", 0.02).alias("users"), F.count("*").alias("events")).select(F.col("window.start").alias("day"), "users", "events")


def sessions(events: DataFrame, gap: str = "4 hours", late: str = "1 day") -> DataFrame:
    """Each user's sessions, closed after `gap` without an event."""
    found = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("events"))
    return found.select("user_id", F.col("session_window.start").alias("start"), "events")


def once_a_day(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The first event of each user and day: what a guarded sender would send."""
    return events.withWatermark("ts", late).withColumn("day", F.to_date("ts")).dropDuplicatesWithinWatermark(["user_id", "day"])


def rate_limited(events: DataFrame, most: int = 3, seconds: int = 3600, late: str = "1 day") -> DataFrame:
    """Fixed windows that open with a user's first event: (user_id, start, seen, refused), a row per batch and window touched.

    A window's state goes once the watermark has passed its end."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, seen = state.get if state.exists else (None, 0)
        rows: dict[int, list[int]] = {}
        for at in sorted(t for f in frames for t in f["second"]):
            if start is None or at >= start + seconds:
                start, seen = int(at), 0
            seen += 1
            got = rows.setdefault(start, [0, 0])
            got[0] += 1
            got[1] += seen > most
        state.update((start, seen))
        state.setTimeoutTimestamp(max((start + seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], s, n, r) for s, (n, r) in rows.items()], columns=["user_id", "start", "seen", "refused"])

    keyed = events.withWatermark("ts", late).select("user_id", F.unix_timestamp("ts").alias("second"), "ts").groupBy("user_id")
    return keyed.applyInPandasWithState(step, "user_id long, start long, seen long, refused long", "start long, seen long", "append", GroupStateTimeout.EventTimeTimeout)


def keep_snapshot(changes: DataFrame, folder: str, checkpoint: str, keys: list[str], order: str):
    """Fold each batch into the last state per key, in versions beside each other behind a pointer; the last two stay."""
    from inkwell.sources.sinks import current_version, latest, read_current, remove_old, write_version

    def fold(batch: DataFrame, number: int) -> None:
        rows = batch
        if number > 0:
            if int(current_version(batch.sparkSession, folder)) >= number:
                return  # the batch is replayed: its version is there already
            rows = read_current(batch.sparkSession, folder).unionByName(batch)
        write_version(latest(rows, keys, F.desc(order)), folder, str(number))
        remove_old(batch.sparkSession, folder)

    return changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
