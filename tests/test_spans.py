"""Snippets in pages against a plain search, and pointers replaced by titles."""

import re
import time

import numpy as np
from pyspark.sql import functions as F

from inkwell.operators import spans


def plain(snippet, text):
    """The head of a snippet by one pattern over the page, as a slow search would look for it."""
    words = [w for w in re.findall("[A-Za-z0-9]+", snippet) if len(w) >= 3]
    for count, gap in spans.TRIES:
        if 2 <= count <= min(len(words), 10):
            pattern = r"\b" + (r"[\s\S]{1,%d}?" % gap).join(spans.BREAK.join(w) for w in words[:count]) + r"\b"
            found = re.search(pattern, text, re.I)
            if found:
                return found.span()
    return None


def test_places_equal_plain_search():
    r = np.random.default_rng(6)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "al", "alphabet"]
    for _ in range(300):
        said = r.choice(words, int(r.integers(1, 9))).tolist()
        joins = [" ", "<br>\n", ", ", " &amp; ", "</p><p>"]
        page = "".join(w + str(r.choice(joins)) for w in [*r.choice(words, 12), *said, *r.choice(words, 12)])
        got, want = spans.locate(" ".join(said), page), plain(" ".join(said), page)
        assert (got and got[:2]) == want, (said, page)


def test_parted_words_and_followed_strides():
    rest = " ".join(f"word{k:03d}" for k in range(60))
    page = "<h1>We were told so</h1><p>We had suffi-<br>cient rea<b>son</b> to believe; " + rest[:200] + " <sup>[1] a note put in here</sup> " + rest[200:] + "</p>"
    start, end, seen = spans.locate("We had sufficient reason to believe " + rest, page)
    assert page[start:end].startswith("had suffi-<br>cient") and page[start:end].endswith("word059") and seen > 50
    said = "one two three four five six seven eight nine ten"
    twice = f"{said}. " + "filler " * 800 + f"{said} eleven twelve thirteen fourteen"
    assert spans.locate(f"{said} eleven twelve thirteen fourteen", twice)[0] == twice.rindex("one")
    assert spans.locate("nothing of this", page) is None and spans.locate(None, None) is None and spans.locate("", "") is None and spans.locate("word", "word") is None


def test_long_pages_take_linear_time():
    page = "again and again " * 40000
    assert spans.locate("again and again and again and never", page) is not None
    assert spans.locate("again never ever", page) is None


def test_located_rows(spark):
    rows = spark.createDataFrame([(1, "alpha beta gamma", "xx alpha <i>beta</i> gamma"), (2, None, "x"), (3, "alpha beta", None), (4, "no such words", "alpha")], "k long, s string, t string")
    assert {r.k: (r.start, r.end, r.words) for r in spans.located(rows, ["k"], "s", "t").collect()} == {1: (3, 26, 3), 2: (None,) * 3, 3: (None,) * 3, 4: (None,) * 3}


def test_pointers_become_titles(spark):
    cases = {
        "In the first source it says; source 2 agrees.": "In Big Book it says; Steps agrees.",
        "the first source's view, the Second Reading’s view": "the Big Book's view, Steps' view",
        "1st source  1's claim": "1st Big Book's claim", "first source 1 said": "Big Book 1 said", "SOURCE1 and source 22": "Big Book and source 22",
        "no pointer": "no pointer", "": "", None: None, "(the 2nd source)": "(the Steps)", "a the first work": "a Big Book",
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "n int, t string")
    got = [r.o for r in rows.select("n", spans.with_titles(F.col("t"), F.lit("Big Book"), F.lit("Steps")).alias("o")).orderBy("n").collect()]
    assert got == list(cases.values())


def test_places_of_crowded_pages_in_linear_time():
    """Words that stand everywhere, in pages whose letters have no small one of their own length; thousands of pointers in a text."""
    page = "the one and " * 30000 + "İ the İ one"
    began = time.time()
    assert spans.locate("the one and the one and the one and the one never", page)[2] >= 10
    assert spans.Page("AİB ẞ c").close == "aİbßc"
    text = " the first source and  the source 2's" * 20000
    assert spans.titled(text, "Big Book", "Steps") == " Big Book and  Steps'" * 20000
    assert time.time() - began < 20


def test_rendered_spans_take_the_longest_line_in_the_row(spark, tmp_path):
    from inkwell.plans.spans import rendered_spans

    texts = [(1, "one two three\n\nfour five sixteen"), (2, "alpha beta\n" + " " * 40 + "\ngamma delta nineteens"), (3, None), (4, " \n "), (5, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = rendered_spans(spark, str(tmp_path))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.words for r in found.collect()} == {1: 3, 2: 3}
