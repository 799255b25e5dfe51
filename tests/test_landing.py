"""Landed pages as a data source, rows in quarantine, builds that go."""

import glob
import json
import tempfile

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, StringContains

from inkwell.sources import landing, sinks, tables

MEETINGS = [("a", "Early", 1, 400, 40.2, -73.9, "Main", "AA", "online"), ("b", "Late", 2, 1300, 40.9, -73.1, "Side", "NA", "in_person"), ("c", "Far", 3, 600, 51.5, 0.1, "High", "AA", "hybrid"),
            ("d", "South", None, None, -33.9, 151.2, None, "NA", "in_person")]


@pytest.fixture()
def landed(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/feed"
    rows = spark.createDataFrame(MEETINGS, landing.FIELDS)
    landing.land(rows, path, 1000)
    landing.land(rows.where("slug <> 'b'").replace("Early", "Earlier"), path, 2000)
    return path


def reader(path, filters, now=2500):
    found = landing.FeedReader({"path": path, "now": str(now)}, landing.StructType.fromDDL("slug string, stale boolean"))
    return found, list(found.pushFilters(filters))


def test_filters_choose_cells_and_rows(landed):
    bounds = [GreaterThanOrEqual(("lat",), 40.0), LessThan(("lat",), 41.0)]
    other, equal, some = StringContains(("name",), "a"), EqualTo(("fellowship",), "AA"), In(("day",), (1, 2))
    found, left = reader(landed, [*bounds, other, equal, some])
    assert left == [*bounds, other] and found.pushed == [*bounds, equal, some]
    assert [p.cell for p in found.partitions()] == ["40_-74"]
    assert [b.to_pylist() for p in found.partitions() for b in found.read(p)] == [[{"slug": "a", "stale": False}]]
    assert len(reader(landed, [])[0].partitions()) == 3


def test_newest_version_that_can_be_read(spark, landed):
    read = lambda now: {r.slug: (r.name, r.landed, r.stale) for r in landing.read_feed(spark, landed, now).collect()}
    fresh = {"a": ("Earlier", 2000, False), "c": ("Far", 2000, False), "d": ("South", 2000, False)}
    assert read(2500) == fresh
    assert read(2001 + landing.FRESH) == {k: (n, v, True) for k, (n, v, _) in fresh.items()}
    (broken,) = glob.glob(f"{landed}/cell=40_-74/version=2000/part-*")
    with open(broken, "w") as f:
        f.write('{"slug": "a"}\n<html>bad gateway</html>\n')
    import os

    os.remove(f"{os.path.dirname(broken)}/.{os.path.basename(broken)}.crc")
    assert read(2500) == {**fresh, "a": ("Early", 1000, True), "b": ("Late", 1000, True)}


def test_projection_and_filters_reach_the_source(spark, landed):
    few = landing.read_feed(spark, landed, 2500, "slug string, lat double, lng double, fellowship string")
    plan = few.where("lat >= 40 AND lat < 41 AND fellowship = 'AA'")._jdf.queryExecution().executedPlan().toString()
    assert few.columns == ["slug", "lat", "lng", "fellowship"] and "AA" not in plan.split("Filter")[1].split("\n")[0]
    assert few.where("lat >= 40 AND lat < 41").rdd.getNumPartitions() == 1
    near = landing.near(landing.read_feed(spark, landed, 2500), 40.5, -74.0, 30.0)
    assert [r.slug for r in near.collect()] == ["a"]


def test_bad_rows_land_beside_the_good_ones(spark):
    folder, sink = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-") + "/bad"
    for name, body in {"good": json.dumps({"doc_id": "g", "title": "T", "blocks": []}), "broken": '{"doc_id": "x", "blocks": [', "nameless": json.dumps({"title": "no id"})}.items():
        with open(f"{folder}/{name}.json", "w") as f:
            f.write(body)
    assert [r.doc_id for r in tables.manifests(spark, folder, sink).collect()] == ["g"]
    assert sorted((r.reason, r._file.rsplit("/", 1)[1]) for r in spark.read.parquet(sink).collect()) == [("no JSON", "broken.json"), ("no doc_id", "nameless.json")]
    assert [r.doc_id for r in tables.manifests(spark, folder).collect()] == ["g"]


def test_three_builds_leave_two(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    for k in range(3):
        sinks.write_version(spark.range(k + 1), folder, f"v{k}")
    assert sinks.remove_old(spark, folder, older_than=3600) == []
    assert sinks.remove_old(spark, folder) == ["v0"]
    assert sorted(p.rsplit("=", 1)[1] for p in glob.glob(f"{folder}/version=*")) == ["v1", "v2"]
    assert sinks.read_current(spark, folder).count() == 3 and sinks.remove_old(spark, folder) == ["v0"]
