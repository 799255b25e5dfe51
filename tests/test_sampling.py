"""Seeded picks: quotas, chances and reruns."""

from collections import Counter

from pyspark.sql import functions as F

from inkwell.operators import sampling as sp


def test_places_are_dense(spark):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else f"s{i % 3}") for i in range(400)], "i long, s string")
    got = {}
    for r in sp.numbered(rows, "s", sp.seeded_hash("x", "i"), "i").collect():
        got.setdefault(r.s, []).append((r["at"], r["of"]))
    assert {s: sorted(v) for s, v in got.items()} == {s: [(k, len(v)) for k in range(len(v))] for s, v in got.items()} and len(got) == 4


def test_weighted_picks(spark):
    rows = [(o, f"i{k}", f"s{k % 3}", 9.0 if k == 0 else 1.0) for o in range(600) for k in range(9)] + [(1, "none", "s0", 0.0), (9999, "i1", "s1", 1.0)]
    candidates = spark.createDataFrame(rows, "owner long, item string, stratum string, weight double")
    recent = spark.createDataFrame([(o, "i1") for o in range(0, 600, 2)], "owner long, item string")
    got = sp.weighted_picks(candidates, recent, 5).collect()
    assert got and sorted(map(tuple, got)) == sorted(map(tuple, sp.weighted_picks(candidates.repartition(3), recent, 5).collect()))
    per = Counter(r.owner for r in got)
    assert all(per[o] == 5 for o in range(600)) and per[9999] == 1
    assert not any(r.item == "i1" and r.owner % 2 == 0 and r.owner < 600 for r in got) and not any(r.item == "none" for r in got)
    firsts = [r for r in got if r["pick"] <= 3 and r.owner < 600]
    assert len({(r.owner, r.stratum) for r in firsts}) == len(firsts) == 1800  # one of each stratum first
    heavy = sum(1 for r in got if r.item == "i0" and r["pick"] <= 3) / 600
    assert 0.75 < heavy < 0.88  # nine of eleven


def test_quotas_and_passages(spark):
    seeds = spark.range(1234).withColumnRenamed("id", "id")
    kinds = Counter(r.kind for r in sp.kinds(seeds, {"refusal": 0.05, "bare": 0.10}, "passages").collect())
    assert kinds == {"refusal": 61, "bare": 123, "passages": 1050}
    passages = spark.createDataFrame([(i, f"s{i % 6}", i % 4 == 0) for i in range(600)] + [(700 + i, "huge", False) for i in range(900)], "passage long, stratum string, gold boolean")
    got = sp.assembled(seeds, passages).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert len(by) == 1234
    for rows in by.values():
        assert sorted(r["at"] for r in rows) == list(range(len(rows))) and len(rows) <= 4
        assert len({r.stratum for r in rows}) == len(rows) and sum(r.gold for r in rows) <= 2
    assert sorted(map(tuple, got)) == sorted(map(tuple, sp.assembled(seeds.repartition(2), passages.repartition(5)).collect()))
    assert len({r.passage for r in got if r.stratum == "huge"}) > 300
    assert sp.assembled(seeds, passages.limit(0)).count() == 0 and sp.assembled(seeds.limit(0), passages).count() == 0
