"""Words, stems and phrases by the trie and by joins, against a plain search."""

import numpy as np
from pyspark.sql import functions as F

from inkwell.operators import matching


def hits(rows):
    return {(r.n, r.concept): r.hits for r in rows.collect()}


def both(spark, texts, forms, monkeypatch, numbers=True):
    passages = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    ready = matching.prepared(spark.createDataFrame(forms, "concept string, form string"), numbers)
    walked = hits(matching.matches(passages, ready, ["n"]))
    monkeypatch.setattr(matching, "BROADCAST_FORMS", 0)
    assert hits(matching.matches(passages, ready, ["n"])) == walked
    monkeypatch.undo()
    return walked


def test_plurals_stems_and_phrases(spark, monkeypatch):
    forms = [("a", "resentment"), ("b", "resent*"), ("c", "offer myself to thee"), ("d", "big book*"), ("e", "re*"), ("f", " Don’t  Drink "), ("g", "duties"), ("g", "duty"), ("h", "bill wilson"), ("h", "bill wilson"), ("i", ""), ("i", None), ("j", "*")]
    texts = ["Resentments, resented. God, I offer myself to Thee", "The big bookshelf, the BIG books; don't drink", "my duty, my duties; Bill Wilsons and bill wilson", None, "", "offer myself to"]
    got = both(spark, texts, forms, monkeypatch)
    assert got == {(0, "a"): 1, (0, "b"): 2, (0, "c"): 1, (1, "d"): 2, (1, "f"): 1, (2, "g"): 2, (2, "h"): 4}


def test_other_number(spark):
    words = ["city", "cities", "day", "step", "steps", "class", "as", "ties", "x1", "an", "ox"]
    rows = spark.createDataFrame(list(enumerate(words)), "n int, w string")
    got = [r.o for r in rows.select("n", matching.other_number(F.col("w")).alias("o")).orderBy("n").collect()]
    assert got == ["cities", "city", "days", "steps", "step", None, None, "tie", None, None, None]


def test_random_forms_equal_plain_search(spark, monkeypatch):
    r = np.random.default_rng(4)
    words = ["".join(r.choice(list("abc"), r.integers(1, 6))) for _ in range(60)]
    texts = [" ".join(r.choice(words, r.integers(0, 40))) for _ in range(60)]
    forms = [(f"c{i % 25}", " ".join(r.choice(words, r.integers(1, 4))) + ("*" if r.random() < 0.3 else "")) for i in range(80)]
    want = {}
    singles = set()
    for concept, form in forms:
        parts, is_open = form.rstrip("*").split(), form.endswith("*")
        if len(parts) == 1 and ((concept, form) in singles or (is_open and len(parts[0]) < 3)):
            continue
        singles.add((concept, form))
        for n, text in enumerate(texts):
            t = text.split()
            for i in range(len(t) - len(parts) + 1):
                at = t[i : i + len(parts)]
                if at[:-1] == parts[:-1] and (at[-1] == parts[-1] or (is_open and at[-1].startswith(parts[-1]))):
                    want[n, concept] = want.get((n, concept), 0) + 1
    assert both(spark, texts, forms, monkeypatch, numbers=False) == want


def test_a_task_holds_little(spark, monkeypatch):
    """Words that a task remembers and blocks that it holds stay few, whatever the input; small limits change no row."""
    from inkwell.operators import matching, structure

    assert matching.REMEMBERED <= 1 << 16 and structure.HELD_CHARS <= 1 << 21
    pages = spark.createDataFrame([(k, f"<h1>t{k}</h1>" + "<p>x</p><li>y</li>" * k if k % 5 else None) for k in range(40)], "page_id long, html string")
    want = [(k, n, t, x) for k in range(40) if k % 5 for n, (t, x) in enumerate([("heading", f"t{k}")] + [("paragraph", "x"), ("list", "y")] * k)]
    for rows in (structure.HELD_ROWS, 3):
        monkeypatch.setattr(structure, "HELD_ROWS", rows)
        assert sorted(tuple(r) for r in structure.html_blocks(pages).collect()) == want
