"""Meetings by place and time, and runs of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EARTH_MILES = 3958.8


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2))
    return F.lit(2 * EARTH_MILES) * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def within(asked: DataFrame, meetings: DataFrame, miles: float, cell: float = 1.0) -> DataFrame:
    """Meetings within a distance of each asked place, joined by grid cell.

    asked: qid, qlat, qlng; meetings: lat, lng and more. A place asks the cells that its box
    touches (longitude wraps), so that the join is by equal keys at any size.
    """
    span = miles / 69.0
    wide = F.lit(span) / F.greatest(F.cos(F.radians("qlat")), F.lit(0.01))
    lat_cells = F.sequence(F.floor((F.col("qlat") - span) / cell).cast("int"), F.floor((F.col("qlat") + span) / cell).cast("int"))
    lng_cells = F.sequence(F.floor((F.col("qlng") - wide) / cell).cast("int"), F.floor((F.col("qlng") + wide) / cell).cast("int"))
    around = int(360 / cell)
    cells = asked.withColumn("cy", F.explode(lat_cells)).withColumn("x", F.explode(lng_cells)).withColumn("cx", F.pmod("x", F.lit(around))).drop("x")
    cells = cells.dropDuplicates(["qid", "cy", "cx"])
    placed = meetings.withColumn("cy", F.floor(F.col("lat") / cell).cast("int")).withColumn("cx", F.pmod(F.floor(F.col("lng") / cell).cast("int"), F.lit(around)))
    near = placed.join(cells, ["cy", "cx"]).withColumn("miles", haversine(F.col("qlat"), F.col("qlng"), F.col("lat"), F.col("lng")))
    return near.where(F.col("miles") <= miles).drop("cy", "cx")


def minutes_until(day: Column, minute: Column, now_day: int, now_minute: int) -> Column:
    """Minutes to the next weekly occurrence."""
    return F.pmod((day - now_day) * 1440 + minute - now_minute, F.lit(7 * 1440))


def day_part(minute: Column) -> Column:
    hour = F.floor(minute / 60)
    return F.when(hour.between(5, 11), "morning").when(hour.between(12, 16), "afternoon").when(hour.between(17, 20), "evening").otherwise("late")


def runs(days: DataFrame, user: str, day: str) -> DataFrame:
    """Runs of consecutive days: (user, start, end, length)."""
    w = Window.partitionBy(user).orderBy(day)
    one = days.select(user, day).distinct().withColumn("island", F.date_sub(F.col(day), F.row_number().over(w)))
    return one.groupBy(user, "island").agg(F.min(day).alias("start"), F.max(day).alias("end"), F.count("*").alias("length")).drop("island")
