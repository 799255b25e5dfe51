"""Items in texts against a plain search."""

import numpy as np

from inkwell.operators import contain


def test_contained_equals_plain_search(spark, monkeypatch):
    r = np.random.default_rng(3)
    letters = list("abcé ")
    texts = ["".join(r.choice(letters, int(r.integers(0, 300)))) for _ in range(40)] + [None, "", "🙂" * 60]
    items = []
    for _ in range(60):
        source = texts[int(r.integers(0, 40))]
        n = int(r.choice([1, 3, 5, 9, 12, 25, 40, 90]))
        at = int(r.integers(0, max(len(source) - n, 0) + 1))
        items.append(source[at : at + n] if r.random() < 0.8 else source[at : at + n] + "x")
    items += ["", None, "🙂" * 45, texts[5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    asked = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(d, i) for d, t in enumerate(texts) for i, q in enumerate(items) if t is not None and q and q in t}
    for limit in (1_000_000, 0):
        monkeypatch.setattr(contain, "BROADCAST_ANCHORS", limit)
        assert {tuple(x) for x in contain.contained(docs, asked).collect()} == want
    assert contain.contained(docs, asked.limit(0)).count() == 0
