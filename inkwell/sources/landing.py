"""Landed feed pages as a Spark data source: cells and versions as partitions, projection and filters pushed to the files, stale rows on error."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FIELDS = "slug string, name string, day int, minute int, lat double, lng double, address string, fellowship string, attendance string"
#: Seconds for which a landed version is fresh.
FRESH = 6 * 3600
BATCH = 5000


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def cell(lat: float, lng: float) -> str:
    """A square of one degree: the unit by which pages land and are left out."""
    return f"{math.floor(lat)}_{math.floor(lng)}"


def land(meetings: DataFrame, path: str, version: int) -> None:
    """Write meetings by cell under a version: the second at which they were fetched. Files are JSON lines."""
    at = F.concat_ws("_", F.floor("lat").cast("string"), F.floor("lng").cast("string"))
    rows = meetings.select(at.alias("cell"), F.lit(version).alias("version"), F.to_json(F.struct(*meetings.columns)).alias("value"))
    rows.repartition("cell").write.mode("append").partitionBy("cell", "version").text(path)


class Page(InputPartition):
    """A cell and its versions, newest first."""

    def __init__(self, cell: str, versions: list[tuple[int, list[str]]]):
        self.cell, self.versions = cell, versions


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.now, self.schema = options["path"], int(options["now"]), schema
        self.fresh = int(options.get("fresh", FRESH))
        self.pushed: list[Filter] = []
        self.bounds = {"lat": [-math.inf, math.inf], "lng": [-math.inf, math.inf]}
        self.equal: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of a place choose cells, so no file beyond them is opened, and rows outside go before they are built;
        equalities do so with rows. Spark evaluates the others."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.bounds and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.bounds[name][0] = max(self.bounds[name][0], f.value)
            elif name in self.bounds and isinstance(f, (LessThan, LessThanOrEqual)):
                self.bounds[name][1] = min(self.bounds[name][1], f.value)
            elif name in ("slug", "fellowship", "attendance", "day") and isinstance(f, (EqualTo, In)):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.equal[name] = self.equal.get(name, asked) & asked
                self.pushed.append(f)
                continue  # exactly this is done by read()
            else:
                yield f
                continue
            self.pushed.append(f)
            yield f  # strict bounds are looked at once more

    def partitions(self) -> list[Page]:
        system, path = _at(self.path)
        found = []
        for info in system.get_file_info(fs.FileSelector(path)):
            name = info.base_name.removeprefix("cell=")
            if info.type != fs.FileType.Directory or name == info.base_name:
                continue
            lat, lng = (int(x) for x in name.split("_"))
            if not all(low < at + 1 and at <= high for at, (low, high) in ((lat, self.bounds["lat"]), (lng, self.bounds["lng"]))):
                continue
            versions = []
            for version in system.get_file_info(fs.FileSelector(info.path)):
                files = [f.path for f in system.get_file_info(fs.FileSelector(version.path)) if not f.base_name.startswith(("_", "."))]
                versions.append((int(version.base_name.removeprefix("version=")), sorted(files)))
            found.append(Page(name, sorted(versions, reverse=True)))
        return found

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        """The newest version whose files can all be read; rows of an older one, or of one no longer fresh, are stale."""
        system, _ = _at(self.path)
        arrow = to_arrow_schema(self.schema)
        for number, (version, files) in enumerate(partition.versions):
            try:
                rows = [row for file in files for row in self._rows(system, file)]
            except (OSError, ValueError):
                continue
            stale = number > 0 or self.now - version > self.fresh
            named = [{**row, "landed": version, "stale": stale} for row in rows]
            for a in range(0, len(named), BATCH):
                part = [{name: row.get(name) for name in self.schema.names} for row in named[a : a + BATCH]]
                yield pa.RecordBatch.from_pylist(part, schema=arrow)
            return

    def _rows(self, system: fs.FileSystem, file: str) -> Iterator[dict]:
        with system.open_input_stream(file) as stream:
            for line in stream.read().decode().splitlines():
                row = json.loads(line)
                if not isinstance(row, dict):
                    raise ValueError("a page is no list of meetings")
                if all(row.get(k) in v for k, v in self.equal.items()):
                    yield row


class MeetingFeed(DataSource):
    """format("meeting_feed"): options path, now (a second) and fresh. The schema asked for is the projection: other fields are never built."""

    @classmethod
    def name(cls) -> str:
        return "meeting_feed"

    def schema(self) -> str:
        return FIELDS + ", landed long, stale boolean"

    def reader(self, schema: StructType) -> FeedReader:
        return FeedReader(dict(self.options), schema)


def read_feed(spark: SparkSession, path: str, now: int, schema: str | None = None, fresh: int = FRESH) -> DataFrame:
    spark.dataSource.register(MeetingFeed)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    read = spark.read.format("meeting_feed").option("now", now).option("fresh", fresh)
    return (read.schema(schema) if schema else read).load(path)


def near(meetings: DataFrame, lat: float, lng: float, miles: float) -> DataFrame:
    """Meetings within a radius, nearest first within equal distance by slug: a box that the source prunes by, then the true distance."""
    up = miles / 69.0
    side = miles / (69.0 * max(math.cos(math.radians(min(abs(lat) + up, 89.0))), 0.01))
    box = meetings.where(f"lat >= {lat - up} AND lat <= {lat + up} AND lng >= {lng - side} AND lng <= {lng + side}")
    a = F.pow(F.sin((F.radians("lat") - math.radians(lat)) / 2), F.lit(2.0)) + F.cos(F.radians("lat")) * math.cos(math.radians(lat)) * F.pow(F.sin((F.radians("lng") - F.radians(F.lit(lng))) / 2), F.lit(2.0))
    return box.withColumn("miles", F.round(2 * 3958.7613 * F.asin(F.sqrt(a)), 6)).where(F.col("miles") <= miles)


def split_good(rows: DataFrame, reasons: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones with the first rule (name: SQL condition) that they break: nothing is dropped in silence."""
    reason = F.coalesce(*[F.when(F.expr(rule), name) for name, rule in reasons.items()])
    marked = rows.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def quarantined(rows: DataFrame, reasons: dict[str, str], sink: str) -> DataFrame:
    """The good rows; the bad ones are added to the sink with their reason and the time."""
    good, bad = split_good(rows, reasons)
    bad.withColumn("seen", F.current_timestamp()).write.mode("append").parquet(sink)
    return good
