"""Names onto a catalog against all pairs."""

import numpy as np

from inkwell.operators.retrieval import similar_keys


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_close_keys_equal_all_pairs(spark):
    r = np.random.default_rng(23)
    books = sorted({"".join(r.choice(list("abcd"), int(r.integers(1, 26)))) for _ in range(80)})
    keys = set()
    for _ in range(120):
        word = list(str(r.choice(books)))
        for _ in range(int(r.integers(0, 4))):
            at = int(r.integers(0, len(word) + 1))
            word[at : at + int(r.integers(0, 2))] = str(r.choice(list("abcd")))
        keys.add("".join(word))
    frame = lambda values, name: spark.createDataFrame([(v,) for v in sorted(values)], f"{name} string")
    for least in (0.82, 0.6):
        got = {(x.key, x.book) for x in similar_keys(frame(keys, "key"), frame(books, "book"), least).collect()}
        want = {(k, b) for k in keys for b in books if 1 - edits(k, b) / max(len(k), len(b)) >= least and int(len(k) * (1 - least) / least + 1e-9) >= 0}
        assert got == want
    assert similar_keys(frame([], "key"), frame(books, "book"), 0.82).count() == 0
