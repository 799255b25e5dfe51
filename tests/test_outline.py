"""Chapters from headings, from the contents, and page ranges of long ones."""

from inkwell.operators.outline import outline

BLOCKS = "doc_id long, ord int, block_id string, type string, text string, printed_page string, physical_page string"


def chapters(spark, docs, **options):
    rows = [(d, n, f"b{n}", kind, text, page, None) for d, blocks in docs.items() for n, (kind, text, page) in enumerate(blocks)]
    found = outline(spark.createDataFrame(rows, BLOCKS), **options).orderBy("doc_id", "start").collect()
    return {d: [r for r in found if r.doc_id == d] for d in docs}


def h(text, page=None):
    return ("heading", text, page)


def p(n, text="Some plain text about the matter.", page=None):
    return [("paragraph", text, page)] * n


def test_headings_open_chapters(spark):
    listing = [("paragraph", f"Story number {i} {170 + i}", None) for i in range(1, 6)]
    docs = {
        1: [h("A LONG STORY", "1"), h("W"), *p(6), h("THERE IS A WAY", "17"), h("“T"), *p(5)],
        2: [h("Step One", "21"), h("W"), *p(4), h("22 STEP ONE", "22"), *p(4), h("Step Two", "25"), *p(4)],
        3: [h("Early Ones"), *listing, h("The First Tale", "171"), *p(5)],
        4: [*p(3)],
        5: [h("Short"), *p(2), *[x for _ in range(5) for x in (h("Daily Note"), *p(4))], h("Last One"), *p(3)],
        6: [h("Twice Told"), *p(3), h("Middle"), *p(3), h("Twice Told"), *p(25)],
    }
    got = chapters(spark, docs)
    assert [r.title for r in got[1]] == ["A Long Story", "There Is a Way"]
    assert [(r.title, r.content_blocks) for r in got[2]] == [("Step One", 8), ("Step Two", 4)]
    assert [(r.title, r.printed_page, r.block_id) for r in got[3]] == [("The First Tale", "171", "b6")]
    assert got[4] == []
    assert [(r.title, r.start, r.end) for r in got[5]] == [("Short", 0, 28), ("Last One", 28, 32)]
    assert [(r.title, r.start) for r in got[6]] == [("Middle", 4), ("Twice Told", 8)]


def test_contents_find_titles_glued_to_text(spark):
    numbered = ("toc", "Contents 1 Using this booklet 2 Staying away from it 3 Using the day plan", None)
    glued = [numbered, *p(1, "1 Using this booklet This is no plan."), *p(4), *p(1, "2 Staying away from it Words that are heard."), *p(3), *p(1, "3 Using the day plan Here we look at today."), *p(3)]
    dots = ("toc", "The Beginning ..... 3 The Middle Part . . . . 9 The very end .... 12 Never Found .... 20", None)
    # entries are found after one another: the early mention of the end is not its chapter
    ordered = [dots, *p(1, "The beginning of it all"), *p(3), *p(1, "THE MIDDLE PART is here"), *p(3), h("The Very End"), *p(5)]
    back = [dots, *p(1, "The very end is near"), *p(3), *p(1, "The beginning of it"), *p(3), *p(1, "The middle part"), *p(3), *p(1, "The very end"), *p(3)]
    two = [("toc", "One Title ..... 3 Two Title .... 9", None), *p(3), *p(1, "One title here"), *p(3)]
    got = chapters(spark, {1: glued, 2: ordered, 3: back, 4: two, 5: []})
    assert [r.title for r in got[1]] == ["Using this booklet", "Staying away from it", "Using the day plan"]
    assert [(r.title, r.start) for r in got[2]] == [("The Beginning", 1), ("The Middle Part", 5), ("The Very End", 9)]
    assert [(r.title, r.start) for r in got[3]] == [("The Beginning", 5), ("The Middle Part", 9), ("The very end", 13)]
    assert got[4] == []


def test_long_chapters_are_cut_at_pages(spark):
    long = [h("One Long Chapter", "1"), *[("paragraph", "text", str(1 + i // 10)) for i in range(1, 301)]]
    plain = [("paragraph", "text", None)] * 25
    got = chapters(spark, {1: long, 2: plain}, most=100)
    assert len(got[1]) == 3 and all(r.content_blocks <= 110 for r in got[1]) and sum(r.content_blocks for r in got[1]) == 300
    assert got[1][0].title.startswith("One Long Chapter (pp. 1–") and [a.end for a in got[1][:-1]] == [b.start for b in got[1][1:]]
    assert all(long[r.start][2] != long[r.start - 1][2] for r in got[1][1:])
    got = chapters(spark, {2: plain}, most=10)[2]
    assert [r.title for r in got] == ["Text (part 1 of 3)", "Text (part 2 of 3)", "Text (part 3 of 3)"] and sum(r.content_blocks for r in got) == 25


def test_no_blocks(spark):
    assert outline(spark.createDataFrame([], BLOCKS)).count() == 0


def test_slow_patterns_meet_likely_blocks_alone(spark):
    """Blocks without three points or the word for a list are left out before the patterns of entries; the entries stay the same."""
    from pyspark.sql import functions as F

    from inkwell.operators.outline import listed_titles

    text = ["Contents", "First Part . . . 1", "Second Part....2", "Third  Part .\t. . iv", "Plain. Text. Here. 5", "TABLE OF CONTENTS 1 One Thing 2 Other Thing 3 Last Thing", "contents 1 Alpha 3 Beta", "no"]
    b = spark.createDataFrame([(1, i, 8, t) for i, t in enumerate(text)], "doc_id long, i int, n long, text string")
    found = listed_titles(b).orderBy("k")
    assert [r.title for r in found.collect()] == ["First Part", "Second Part", "Third Part", "One Thing", "Other Thing", "Last Thing"]
    assert "contains(lower(text" in found._jdf.queryExecution().optimizedPlan().toString().lower()
