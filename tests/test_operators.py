"""Operators on small fixtures with known results."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from inkwell.functions.text import e164, slug
from inkwell.operators import graph, repair, schedule, structure
from inkwell.operators.ranking import bm25
from inkwell.sources import sinks, tables


def column(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "n int, x string")
    return [r.y for r in rows.select("n", f(F.col("x")).alias("y")).orderBy("n").collect()]


def test_doubled_layers_and_sentences(spark):
    assert column(spark, structure.collapse_doubled, ["AABBCC", "ordinary prose", None, "", "aaaa"]) == ["ABC", "ordinary prose", None, "", "aaaa"]
    got = column(spark, structure.sentences, ["He met Dr. Bob there. Then A.A. Grew. Bill W. Spoke.", "By J. R. R. Hall. So! “Yes.” No", None, "  "])
    assert got == [["He met Dr. Bob there.", "Then A.A. Grew.", "Bill W. Spoke."], ["By J. R. R. Hall.", "So!", "“Yes.”", "No"], None, []]


def test_repair(spark):
    docs = spark.createDataFrame([
        (1, "practi-\ncal self-\nsufficiency. self self sufficiency sufficiency"), (5, "PRACTI-\nCAL Cau- tious"), (2, "fi rst and suffi cient; a fl y fi sh"), (3, None), (4, "")], "doc_id long, text string")
    mended = {r.doc_id: r.text for r in repair.repair_hyphens(docs).collect()}
    assert mended == {1: "practical self-sufficiency. self self sufficiency sufficiency", 5: "PRACTICAL Cautious", 2: "fi rst and suffi cient; a fl y fi sh", 3: None, 4: ""}
    assert {r.doc_id: r.text for r in repair.repair_ligatures(docs).collect()}[2] == "first and sufficient; a fly fi sh"
    lines = ["It was", "late. He", "Went home to Dr.", "Bob and slept.", "Next day", "", "1. item", "more of it", "THE END", "So it was."]
    rows = spark.createDataFrame([(7, n, x) for n, x in enumerate(lines)], "doc_id long, ord int, text string")
    got = [(r.paragraph, r.lines, r.text) for r in repair.reflow(rows).orderBy("paragraph").collect()]
    assert got == [(1, 4, "It was late. He Went home to Dr. Bob and slept."), (2, 1, "Next day"), (3, 2, "1. item more of it"), (4, 1, "THE END"), (5, 1, "So it was.")]
    cases = {
        ("1. first item", "goes on here", "Then another line"): ["1. first item goes on here", "Then another line"],
        ("As we go the first steps,", "we get ready.", "", "Step Ten", "Went on with it", "and when wrong said so.", "* Item one", "* Item two", "1. First", "2. Second", "This is text", "and more that joins.", "But this ends so.", "This starts after, so it stays."):
            ["As we go the first steps, we get ready.", "Step Ten", "Went on with it and when wrong said so.", "* Item one", "* Item two", "1. First", "2. Second", "This is text and more that joins.", "But this ends so.", "This starts after, so it stays."],
        ("It never dawned on me how long Dr.", "Bob and Bill had been. Had I known it was a short", "while, I might not. When Bill D. came, Dr. Bob had", "been there three weeks."): ["It never dawned on me how long Dr. Bob and Bill had been. Had I known it was a short while, I might not. When Bill D. came, Dr. Bob had been there three weeks."],
        ("LOUD HEAD", "joined in small", "Not parted", "nor this"): ["LOUD HEAD joined in small Not parted nor this"],
        ("Step 4 began", "small", "Other A", "Other B", "2) item", "Other C"): ["Step 4 began small", "Other A Other B", "2) item", "Other C"],
    }
    rows = spark.createDataFrame([(d, n, x) for d, case in enumerate(cases) for n, x in enumerate(case)], "doc_id long, ord int, text string")
    got = repair.reflow(rows).orderBy("doc_id", "paragraph").collect()
    for d, want in enumerate(cases.values()):
        assert [r.text for r in got if r.doc_id == d] == want


def test_headings(spark):
    got = column(spark, repair.clean_heading, ["6 BUILDING A NEW LIFE 476", "A", "22 STEP ONE", "PIONEERS OF A.A.", "Step 5", "THE DOCTOR'S OPINION xxv", "mentally ill", None, "", "How It Works"])
    assert [g and (g.title, g.running) for g in got] == [None, None, ("Step One", True), ("Pioneers of A.A.", False), ("Step 5", False), ("The Doctor's Opinion", True), None, None, None, ("How It Works", False)]
    assert column(spark, repair.is_title_like, ["The Way of Life", "the way of life", "of the", "12"]) == [True, False, False, False]
    assert column(spark, repair.is_index, ["Abstinence, 4, 12\nAcceptance 12", "It was so.", ""]) == [True, False, False]


@pytest.mark.parametrize("sizes", [[401], [405], [419], [420], [805], [1205], [30, 30, 30, 500, 10], [3], [90, 20], [450, 900, 60, 2000, 700, 10], [200] * 40])
def test_chunks_keep_every_word(spark, sizes):
    words = iter(range(10**6))
    lines = [" ".join(f"w{next(words)}." if k % 17 == 16 else f"w{next(words)}" for k in range(n)) for n in sizes]
    text = "\n".join(lines)
    parts = structure.chunks(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect()
    assert {p.doc_id for p in parts} <= {1} and all(p.words == len(p.text.split()) for p in parts)
    by = {k: [p for p in parts if p.scale == k] for k in ("small", "medium", "large", "topic")}
    if sum(sizes) >= 80:
        assert " ".join(p.text for p in by["medium"]).split() == text.split()
    assert all(80 <= p.words <= 400 or p.end > p.start or len(by["medium"]) == 1 for p in by["medium"])
    assert all(4 <= p.words <= 100 for p in by["small"])
    if sum(sizes) > 400:
        seen = {n for p in by["topic"] for n in range(p.start, p.end + 1)}
        assert seen and by["topic"][0].start == 0 and all(a.start < b.start <= a.end + 1 for a, b in zip(by["topic"], by["topic"][1:]))
        assert all(p.words <= 2800 or p.start == p.end for p in by["topic"])
    assert all(p.words <= 1500 or p.start == p.end for p in by["large"])


def test_covering(spark):
    rows = [("small", 0, 0, 0), ("small", 1, 9, 9), ("medium", 0, 0, 2), ("medium", 1, 0, 5), ("large", 0, 0, 5), ("topic", 0, 0, 4), ("topic", 1, 3, 9)]
    parts = spark.createDataFrame([(1, s, k, a, b) for s, k, a, b in rows], "doc_id long, scale string, chunk_index int, start int, end int")
    got = {(r.scale, r.chunk_index): (r.context_scale, r.context_index, r.topic_scale, r.topic_index) for r in structure.covering(parts).collect()}
    order = {"small": (("medium", "large", "topic"), ("topic", "large", "medium")), "medium": (("large", "topic"), ("topic", "large")), "large": (("topic",), ("topic",)), "topic": ((), ())}
    for s, k, a, b in rows:
        want = []
        for prefer in order[s]:
            want += next(((t, j) for p in prefer for t, j, c, d in rows if t == p and c <= a and d >= b), (s, k))
        assert got[s, k] == tuple(want)


def test_block_types(spark):
    cases = {"": "garbage", "Chapter One .... 15": "toc", "#### %%%": "garbage", "12": "page_header", "1. first item": "list", "HOW IT WORKS": "heading",
             "Step One": "heading", '"Be still."': "epigraph", "An ordinary line of prose that ends here.": "paragraph"}
    rows = spark.createDataFrame([(k,) for k in cases], "text string").select("text", structure.block_type(F.col("text")).alias("type")).collect()
    assert {r.text: r.type for r in rows} == cases





def test_html_blocks(spark):
    html = "<h1>Title &amp; more</h1><script>var x='<p>no</p>'</script><p>One <b>two</b></p><ul><li>item</ul><blockquote>q</blockquote>"
    rows = structure.html_blocks(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("ord").collect()
    assert [(r.type, r.text) for r in rows] == [("heading", "Title & more"), ("paragraph", "One two"), ("list", "item"), ("epigraph", "q")]


def test_bm25_prefers_rare_terms(spark):
    docs = [(i, "god god grace") for i in range(30)] + [(100 + i, "resentment resentment god") for i in range(3)]
    asked = spark.createDataFrame([("q", "resentment"), ("q", "god")], "qid string, token string")
    rows = bm25(spark.createDataFrame(docs, "doc_id long, text string"), asked).orderBy(F.desc("score"), "doc_id").collect()
    assert [r.doc_id for r in rows[:3]] == [100, 101, 102] and len(rows) == 33


def test_npmi_bounds_and_merge(spark):
    hits = spark.createDataFrame([(p, n) for p in range(40) for n in ("a", "b", "c") if n == "a" or (p % 2 == 0 and n == "b") or (p % 3 == 0 and n == "c")], "pid int, node string")
    rows = graph.cooccurrence(hits, "pid", "node", 1, -2.0).collect()
    assert rows and all(-1 <= r.npmi <= 1 for r in rows)
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "a long, b long")
    roots = {r.id: r.root for r in graph.merged(chain).collect()}
    assert set(roots[i] for i in range(21)) == {0} and roots[101] == 100


def test_page_rank_against_plain_version(spark):
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "d", 0.5), ("a", "d", 1.5)]
    got = {r.node: r.rank for r in graph.page_rank(spark.createDataFrame(edges, "a string, b string, weight double"), 10).collect()}
    both = edges + [(b, a, w) for a, b, w in edges]
    total = {n: sum(w for a, _, w in both if a == n) for n in "abcd"}
    rank = {n: 0.25 for n in "abcd"}
    for _ in range(10):
        rank = {n: 0.15 / 4 + 0.85 * sum(rank[a] * w / total[a] for a, b, w in both if b == n) for n in "abcd"}
    top = max(rank.values())
    assert all(abs(got[n] - rank[n] / top) < 1e-9 for n in "abcd")


def test_radius_join_and_wrap(spark):
    asked = spark.createDataFrame([(1, 37.25, -121.88), (2, 0.0, 179.9)], "qid int, qlat double, qlng double")
    meetings = spark.createDataFrame([(1, 37.3, -121.9), (2, 38.25, -121.88), (3, 0.0, -179.9)], "id int, lat double, lng double")
    rows = schedule.within(asked, meetings, 30.0).collect()
    assert {(r.qid, r.id) for r in rows} == {(1, 1), (2, 3)}


def test_runs_of_days(spark):
    days = [dt.date(2024, 1, d) for d in (1, 2, 3, 5, 6)]
    rows = schedule.runs(spark.createDataFrame([(1, d) for d in days + days[:1]], "u int, d date"), "u", "d").collect()
    assert sorted(r.length for r in rows) == [2, 3]


def test_text_functions(spark):
    row = spark.range(1).select(slug(F.lit(" Big Book - A.A. ")).alias("s"), e164(F.lit("(252) 555-8630")).alias("p"), e164(F.lit("12")).alias("n")).first()
    assert (row.s, row.p, row.n) == ("big-book-a-a", "+12525558630", None)


def test_sources_and_versions(spark, tmp_path):
    (tmp_path / "in" / "books").mkdir(parents=True)
    (tmp_path / "in" / "books" / "a.txt").write_text("hello\nthere")
    (tmp_path / "in" / "books" / "b.bin").write_text("no")
    (tmp_path / "in" / "books" / ".c.txt").write_text("hidden")
    rows = tables.files(spark, str(tmp_path / "in")).collect()
    assert [r.category for r in rows] == ["books"]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.json").write_text('{"doc_id": "d", "blocks": [{"id": "b1", "text": "t"}]}')
    (tmp_path / "m" / "y.json").write_text("{broken")
    assert [(r.doc_id, r.block_id, r.text) for r in tables.manifest_blocks(tables.manifests(spark, str(tmp_path / "m"))).collect()] == [("d", "b1", "t")]
    out = str(tmp_path / "v")
    sinks.write_version(spark.range(3), out, "1")
    sinks.write_version(spark.range(5), out, "2")
    assert sinks.read_current(spark, out).count() == 5


def test_passages_stay_in_their_section(spark):
    line = " ".join(["word"] * 70)
    text = "\n".join([line, line, line, "SECTION", line, "few words of a line that is long enough to be no heading but has few " + "x" * 20])
    rows = structure.passages(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("passage").collect()
    assert [(r.section, r.start, r.end, r.words) for r in rows] == [(0, 0, 1, 140), (0, 2, 2, 70), (1, 4, 5, 87)]


def test_diversified_caps_and_turns(spark):
    from inkwell.operators.ranking import diversified

    rows = [("q", i, "small" if i % 3 else "large", f"s{i % 2}", f"c{i // 2}", 10.0 - i) for i in range(10)]
    got = diversified(spark.createDataFrame(rows, "qid string, key long, bucket string, source string, context string, score double"), 4, 2, ["small", "medium", "large"])
    keys = [r.key for r in got.orderBy("pick").collect()]
    assert keys[:2] == [1, 3] and len(keys) == 4 and len({k // 2 for k in keys}) == 4 and max(sum(k % 2 == s for k in keys) for s in (0, 1)) <= 2


def test_merged_is_union_find(spark):
    import random

    r = random.Random(3)
    edges = [(r.randrange(60), 100 + r.randrange(60)) for _ in range(70)]
    part = {x: x for e in edges for x in e}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        part[high] = low
    got = {x.id: x.root for x in graph.merged(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in part}


def test_merged_deals_edges_by_their_number(spark, monkeypatch):
    """However many edges there are, and even if one node has most of them, a task gets a bounded number."""
    monkeypatch.setattr(graph, "EDGES_A_TASK", 100, raising=False)
    real, most = graph.staged, []

    def tasks(df):
        return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())

    monkeypatch.setattr(graph, "staged", lambda df, tag: (tag == "merge-edges" and most.append(tasks(df)), real(df, tag))[1])
    pairs = [(0, k) for k in range(1, 1500)] + [(k, k) for k in range(5000, 5010)] + [(5000 + k, 6000 + k) for k in range(500)]
    got = {r.id: r.root for r in graph.merged(spark.createDataFrame(pairs + pairs[::-1] + [(b, a) for a, b in pairs], "a long, b long")).collect()}
    assert got == {x: 0 if x < 5000 else 5000 + x % 1000 for p in pairs for x in p}
    assert len(most) == 1 and most[0] <= 300
    edges = spark.createDataFrame([(b, a, b % 15) for a, b in pairs[:1499]] + [(a, b, 0) for a, b in pairs[:1499]], "a long, b long, part int")
    label = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root"), F.ceil(F.count("*") / 100).cast("int").alias("parts"))
    joined = graph.spread(edges, label, 30)
    assert joined.count() == edges.count() and tasks(joined) <= 500


def test_rolling_sketches_are_near_the_exact_counts(spark):
    from inkwell.plans import catalog

    sf = "/root/testdata/sf0.001"
    exact = {r.day: r for r in catalog.QUERIES["rolling_active"](spark, sf).collect()}
    rows = [r for r in catalog.QUERIES["rolling_sketches"](spark, sf).collect() if str(r.day) in exact]
    assert rows and {str(r.day) for r in rows} == set(exact)
    assert all(abs(r[c] - exact[str(r.day)][c]) <= 0.05 * exact[str(r.day)][c] + 1 for r in rows for c in ("week", "month"))


def test_minutes_of(spark):
    from inkwell.operators.feeds import minutes_of

    assert column(spark, minutes_of, ["7:30 am", "8pm", "19:05", "12 am", "12:15 PM", "99:99", "soon", "", None]) == [450, 1200, 1145, 0, 735, 23 * 60 + 59, None, None, None]


def test_headers_levels_and_ligatures(spark):
    keys = ["theopinion", "stepone"]
    rows = spark.createDataFrame([("comes at once by THE OPINION xxix taking a few", keys), ("by 22 STEP ONE 23 and by OTHER WORDS 7 here", keys), ("none", keys), ("", keys), (None, keys)], "t string, k array<string>")
    assert [r.o for r in rows.select(repair.without_headers(F.col("t"), F.col("k")).alias("o")).collect()] == ["comes at once by  taking a few", "by  and by OTHER WORDS 7 here", "none", "", None]
    said = ["a sacrifi ce and confi dence", "off course, Staff meets; puff pastry", "diffi culties if so", "fl ow", None]
    assert column(spark, repair.joined_ligatures, said) == ["a sacrifice and confidence", "off course, Staff meets; puff pastry", "difficulties if so", "flow", None]
    assert column(spark, repair.heading_level, ["Part One", "section 2", "Step 1", "Chapters", "TRADITION", None]) == [1, 1, 2, 3, 2, 3]


def test_newest_packs(spark):
    files = spark.createDataFrame([("x/search-v9.zip", bytearray(b"a")), ("x/search-v12.zip", bytearray(b"b")), ("embed-v3.zip", bytearray(b"c")), ("readme.txt", bytearray(b"d"))], "path string, content binary")
    got = {r.pack: (r.version, r.path) for r in sinks.newest_packs(files).collect()}
    assert got == {"search": (12, "x/search-v12.zip"), "embed": (3, "embed-v3.zip")}
