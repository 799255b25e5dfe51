"""Operators on small fixtures against brute force, with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from inkwell.llm import arc, brown_lm, chosen_path, line_crf, line_rules, mixing, multi_index, piece_index, suffix_dedup, token_files
from inkwell.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts() -> list[str | None]:
    r = np.random.default_rng(1)
    words = ["".join(r.choice(list("abcdefgh"), r.integers(2, 7))) for _ in range(80)]
    prose = lambda n: " ".join(r.choice(words, n)) + "."
    base = prose(120)
    near = base.split()
    near[60] = "changed"
    passage = prose(30)
    return [
        None, "", " \n ", "one", base, base, " ".join(near), base.upper(), prose(60) + "\n" + passage + "\n" + prose(20), prose(40) + " " + passage,
        "a" * 300, "a" * 300, "\n".join([prose(9)] * 6), "É🙂 日本 " * 40, "x | y | z | " * 30, "WOW!! BUY!! NOW!! " * 30, prose(4000), "nul\0byte  double  blank",
    ]


def documents(spark, extra=False):
    rows = [(i, t, "en", None if i % 7 == 3 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts())]
    rows += [(4, texts()[4], "en", "s1", 1), (None, "no id " * 20, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    edges = [(9, 8), (8, 7), (7, 6), (6, 5), (20, 21), (21, 22), (20, 22), (30, 30)] + [(100, k) for k in range(101, 140)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in (5, 6, 7, 8, 9)} == {5} and {got[k] for k in (20, 21, 22)} == {20} and got[139] == 100
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1


def test_arc_versions_and_errors():
    for version in (1, 2):
        data = arc.filedesc(version, "20000101000000") + arc.arc_record(version, "http://a b/ü", "20000102030405", b"HTTP/1.1 200 OK\r\n\r\nhi\n\nthere")
        (fields, body), = arc.read_arc(data)
        assert fields["url"] == "http://a%20b/%C3%BC" and body.endswith(b"hi\n\nthere")
        (headers, block), = arc.read_warc(arc.warc_record(fields, body))
        assert headers["warc-type"] == "response" and headers["warc-date"] == "2000-01-02T03:04:05Z" and block == body
    with pytest.raises(ValueError):
        list(arc.read_arc(data[:-10]))
    with pytest.raises(ValueError):
        list(arc.read_arc(b"http://a 0.0.0.0 2000 text/html 3\nabc\n"))


def test_pages_round_trip(spark):
    big = "<p>é</p>" * 200
    rows = [(1, "http://a/", big), (2, None, big), (3, "u", big), (4, "u", None), (5, "u", ""), (6, "u", "x"), (7, "u", "x"), (None, "u", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in arc.read_archives(arc.archive_pages(pages)).collect()}
    assert len(got) == 8
    for page_id, _, html in rows:
        payload = (html or "").encode()
        kind = "revisit" if page_id in (1, 2) else "response"
        r = got[page_id]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(payload), hashlib.sha1(payload).hexdigest(), kind, 3 if kind == "revisit" else None)
        assert kind == "revisit" or r.payload == payload
    assert arc.read_archives(arc.archive_pages(pages.limit(0))).count() == 0


def test_arc_files(spark, tmp_path):
    data = arc.filedesc(1, "20000101000000") + b"".join(arc.arc_record(1, f"http://h/{i}", "20000101000000", b"HTTP/1.0 200 OK\r\n\r\n" + bytes([65 + i]) * 5) for i in range(3))
    (tmp_path / "a.arc").write_bytes(data)
    found = spark.read.format("binaryFile").load(str(tmp_path))
    files = arc.convert_arc(found, str(tmp_path / "out"))
    assert sorted(r.payload for r in arc.read_archives(files).collect()) == [b"AAAAA", b"BBBBB", b"CCCCC"]


# 2


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 40)
    r = np.random.default_rng(2)
    rows = []
    for label in (0, 1):
        for c in r.normal(size=(12, 16)):
            rows += [(len(rows) + k, label, (c + r.normal(size=16) * 0.12).astype(float).tolist()) for k in range(10)]
    rows += [(1000 + k, 1, rows[130][2]) for k in range(5)]
    odd = [None, [], [0.0] * 16, [None] * 16, [float("nan")] * 16, [1.0] * 8]
    rows += [(2000 + k, 1, v) for k, v in enumerate(odd)] + [(3000, None, rows[0][2])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {x.vec_id: x for x in multi_index.near_vectors(table).collect()}
    assert len(got) == len(rows)
    good = [(i, lab, np.array(v) / np.linalg.norm(v)) for i, lab, v in rows if lab is not None and v and len(v) == 16 and all(x is not None and x == x for x in v) and any(v)]
    want = collections.Counter()
    for i, a, v in good:
        want[i] = sum(j != i and a == b and float(v @ w) >= 0.93 for j, b, w in good)
    assert sum(x.n_links for x in got.values()) >= 0.9 * sum(want.values())
    assert all(x.n_links <= want[i] for i, x in got.items()) and all(got[2000 + k].kept for k in range(6))
    assert {got[1000 + k].component_id for k in range(5)} == {got[130].component_id}
    assert multi_index.near_vectors(table.limit(0)).count() == 0


def test_index_recall_in_a_hot_cluster():
    """A third of the sample is one cluster over many cells: the cells to visit must reach the target there as well."""
    r = np.random.default_rng(3)
    hot = r.normal(size=16) + r.normal(size=(1300, 16)) * 0.25
    x = np.concatenate([hot, r.normal(size=(2700, 16))])
    x /= np.sqrt((x * x).sum(1))[:, None]
    index = multi_index.MultiIndex(x, np.zeros(len(x), np.int64), 0.93)
    close = x @ x.T >= 0.93
    np.fill_diagonal(close, False)
    visited = np.zeros((len(x), len(index.books[0]) * len(index.books[1])), bool)
    np.put_along_axis(visited, index.visits(x), True, 1)
    found = visited[:, index.cell(x)]
    assert close.sum() > 500_000 and (close & found).sum() >= multi_index.TARGET * close.sum()


# 3


def test_pieces_equal_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    some = [*texts(), "  two  blanks ", "aaaa aaa aaaaa", "▁", "tab\tand\nline", "\0\x01", "z" * 3000]
    rows = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").withColumnRenamed("doc_id", "n_pieces")
    got = {r.text: r for r in piece_index.encode(rows, path, with_decoded=True).collect()}
    for t in some:
        r = got[t]
        if t is None:
            assert r.piece_ids is None and r.piece_text is None
        else:
            assert r.piece_ids == model.encode(t), t[:40]
            assert r.piece_text == t.replace("▁", " ") or "▁" in t
    assert piece_index.encode(rows.limit(0), path).count() == 0


# 4


def test_mixing(spark):
    docs = documents(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    by = {r.source: (r.mix_source_size, r.mix_target) for r in rows}
    assert abs(sum(t for _, t in by.values()) - 1.5 * sum(s for s, _ in by.values())) < 1e-6
    assert all(t <= 2 * s + 1e-9 for s, t in by.values()) and all(0 <= r.mix_taken <= 2 * r.mix_size for r in rows)
    for source, (_, target) in by.items():
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.mix_taken for r in own) - target) <= len(own)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(2)).collect()))
    assert mixing.mix(empty(spark)).count() == 0 and mixing.repeated(mixing.mix(docs)).columns == docs.columns


# 5


def test_line_crf(spark):
    r = np.random.default_rng(5)
    good = lambda: "\n".join(" ".join(r.choice(["alpha", "beta", "gamma", "delta"], 8)) + "." for _ in range(5))
    bad = lambda: "\n".join(" ".join(w.upper() + "!!" for w in r.choice(["buy", "now", "win"], 8)) for _ in range(5))
    rows = [(i, good() if i % 2 else bad()) for i in range(80)]
    docs = spark.createDataFrame(rows + [(90, None), (91, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(70, None), (None, 1)], "doc_id long, quality int")
    model = line_crf.fit(docs, labels)
    got = {x.doc_id: x.score for x in line_crf.score(docs, model).collect()}
    assert all((got[i] >= 0.3) == (i % 2 == 1) for i in range(60, 80)) and got[90] == got[91] == model.prior
    none = line_crf.fit(docs, labels.limit(0))
    assert all(0 <= x.score <= 1 for x in line_crf.score(docs, none).collect()) and line_crf.score(docs.limit(0), model).count() == 0


def test_messages_against_enumeration():
    chain = line_crf.Chain()
    chain.pairs = np.array([[0.7, -0.3], [0.1, 0.4]])
    e, p = np.array([0.3, -1.0, 0.5, 2.0]), np.exp(chain.pairs)
    forward, backward = chain.messages(e, np.array([3, 0, 1]))
    total, ones = 0.0, np.zeros(3)
    for k in range(8):
        y = [(k >> i) & 1 for i in range(3)]
        weight = np.exp(sum(e[i] for i in range(3) if y[i])) * p[y[0], y[1]] * p[y[1], y[2]]
        total += weight
        ones += weight * np.array(y)
    assert np.allclose(1 / (1 + np.exp(-(forward + backward)[:3])), ones / total) and np.isclose(forward[3], 2.0)


def test_quality_of_held_out_documents(spark):
    """Learnt from the other rows, the scores rank held-out documents of label 1 above those of label 0."""
    from inkwell.llm import queries

    sf = "/root/testdata/sf0.01"
    rows = queries.op5_line_crf(spark, sf).where("held_out").join(queries.table(spark, sf, "labels"), "doc_id").select("score", "predicted", "quality").toPandas()
    good, bad = (rows["score"][rows["quality"] == k].to_numpy() for k in (1, 0))
    assert len(good) and len(bad) and (good[:, None] > bad).mean() > 0.9 and (rows["predicted"] == rows["quality"]).mean() > 0.9


# 6


def test_line_rules(spark):
    rows = {r.doc_id: r for r in line_rules.clean(documents(spark)).where("doc_id IS NOT NULL").collect()}
    for i, t in enumerate(texts()):
        w = (t or "").encode().split()
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {k + j for k in range(len(w) - 2) if tri[(w[k], w[k + 1], w[k + 2])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        r = rows[i]
        assert (r.q_n_words, r.q_n_repeat_words, r.q_n_dup_lines) == (len(w), len(hit), len(lines) - len(set(lines))), i
    assert rows[4].q_kept and not rows[14].q_kept and not rows[15].q_kept and not rows[0].q_kept
    assert line_rules.passed(documents(spark)).columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert line_rules.clean(empty(spark)).count() == 0


# 7


def plain_cut(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - 49):
            k = b[s : s + 50]
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = True
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_suffix_dedup(spark, monkeypatch, small):
    if small:  # many chunks; runs and blocks of a few tuples
        monkeypatch.setattr(suffix_dedup, "CHUNK", 900)
        monkeypatch.setattr(suffix_dedup.SuffixQueue.__init__, "__defaults__", (60, 8))
    rows = list(enumerate(texts())) + [(4, texts()[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == plain_cut(rows)
    whole = suffix_dedup.remove_repeats(documents(spark).withColumnRenamed("n_chars", "n_bytes"))
    assert whole.count() == documents(spark).count()
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


# 8


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "LEAF", 4)
    r = np.random.default_rng(8)
    words = [f"w{k}" for k in range(500)]
    rows = [(i, t) for i, t in enumerate(texts())]
    for c in range(6):
        base = r.choice(words, 150).tolist()
        for k in range(12):
            copy = list(base)
            for at in r.integers(0, 150, k % 4):
                copy[at] = "edit"
            rows.append((100 + 20 * c + k, " ".join(copy)))
    docs = spark.createDataFrame(rows + [(None, "x y z"), (4, texts()[4])], "doc_id long, text string")
    got = {x.doc_id: x for x in chosen_path.near_duplicates(docs, words=4).collect()}
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert {i: (got[i].n_shingles, got[i].component_id, got[i].kept) for i in sets} == {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}
    assert got[None].kept and chosen_path.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("main", [1, 90])
def test_large_leaf_is_compared_in_blocks(spark, monkeypatch, main):
    """No group holds more than about two blocks, however many documents are outside the largest
    component; the links join what brute force joins, and no group gives more of them than documents."""
    apply = GroupedData.applyInPandas

    def bounded(self, f, schema):
        def run(key, rows: pd.DataFrame) -> pd.DataFrame:
            out = f(rows)
            assert len(rows) <= 64 and ("left" in out.columns or len(out) < len(rows))
            return out

        return apply(self, run, schema)

    monkeypatch.setattr(chosen_path, "BLOCK", 16)
    monkeypatch.setattr(GroupedData, "applyInPandas", bounded)
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 62, 100)
    sets = []
    for _ in range(240):  # one value in seventeen changed: pairs are just below or above the similarity
        one = base.copy()
        at = r.random(100) < 0.06
        one[at] = r.integers(0, 1 << 62, at.sum())
        sets.append(np.unique(one))
    marks = [chosen_path.signature(s).astype(np.uint8).tobytes() for s in sets]
    leaf = [(7, i, len(sets[i]), 240, True) for i in range(240)] + [(9, i, len(sets[i]), 200, True) for i in range(200)]
    nodes = spark.createDataFrame(leaf, "node long, rep long, n long, size long, leaf boolean")
    reps = spark.createDataFrame([(i, bytearray(m), len(s)) for i, (m, s) in enumerate(zip(marks, sets, strict=True))], "rep long, marks binary, n long")
    full = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)], "rep long, set array<bigint>")
    components = spark.createDataFrame([(i, 0) for i in range(main)], "id long, component long")
    rows = chosen_path.staged(chosen_path._brought(chosen_path.blocks(nodes, reps, components), 60, 80), "rows")
    assert {x.node for x in rows.collect()} == {7}  # the other leaf has no pair of its own
    links = [(x.a, x.b) for x in chosen_path._linked(rows, full, 60, 80).collect()]
    alike = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))
    assert all(alike(a, b) for a, b in links)
    start = [(0, i) for i in range(main)]
    pairs = [(a, b) for a in range(240) for b in range(a + 1, 240) if alike(a, b)]
    assert len(pairs) > 1000
    assert union(240, start + links) == union(240, start + pairs)


def union(n: int, links) -> list[int]:
    """The smallest member of each one's component."""
    part = list(range(n))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        part[high] = low
    return [root(x) for x in range(n)]


# 9


def brown_score(texts, learnt, class_of):
    """Base and model score of each text by plain counting, given the class of every training word."""
    tokens = [t.encode().lower().split() + [b"\n"] for t in texts]
    count = collections.Counter(w for t, ok in zip(tokens, learnt, strict=True) if ok for w in t)
    n, v = sum(count.values()), len(count)
    kinds = sorted({*class_of.values()})
    unknown, end = max(kinds, default=-1) + 1, max(kinds, default=-1) + 2
    kind = lambda w: end if w == b"\n" else class_of.get(w, unknown)
    steps, size = collections.Counter(), collections.Counter()
    for t, ok in zip(tokens, learnt, strict=True):
        for a, b in zip([b"\n", *t], t, strict=False):
            if ok:
                steps[kind(a), kind(b)] += 1
                size[kind(b)] += 1
    return tokens, count, n, v, kind, steps, size


def test_brown_model(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "LEAST", 3)
    r = np.random.default_rng(4)
    # two kinds of words that follow each other in turn, with a few rare ones
    odd, even = [f"a{k}" for k in range(20)], [f"b{k}" for k in range(20)]
    texts = ["", "A0 b0", "unknown words here"]
    for k in range(120):
        words = [str(r.choice(odd if i % 2 else even)) for i in range(r.integers(2, 40))]
        texts.append(" ".join([*words, f"rare{k // 2}"]))
    learnt = [i % 5 != 2 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, ok, 1) for i, (t, ok) in enumerate(zip(texts, learnt, strict=True))], "doc_id long, text string, ok boolean, learn int")
    held = {}
    keep = brown_lm.in_classes
    monkeypatch.setattr(brown_lm, "in_classes", lambda rows, others, shared, n: held.update(others=others.collect(), shared=shared.value) or keep(rows, others, shared, n))
    number = brown_lm.numbered
    monkeypatch.setattr(brown_lm, "numbered", lambda rows, words: held.update(words=words.value.words.split(b"\n")) or number(rows, words))
    values = []
    run = brown_lm.cluster
    monkeypatch.setattr(brown_lm, "cluster", lambda *a: values.append(run(*a)) or values[0])
    c = 4
    got = {x.doc_id: x for x in brown_lm.score(docs, F.col("ok"), n_classes=c).collect()}
    rising = values[0][2]
    assert len(rising) > 1 and all(a < b for a, b in zip(rising, rising[1:], strict=False))
    class_of = {w: int(k) for w, k in zip(held["words"], held["shared"][0], strict=True)} | {bytes(x.word): x.kind for x in held["others"]}
    tokens, count, n, v, _, _, _ = brown_score(texts, learnt, class_of)
    assert set(class_of) == set(count) - {b"\n"} and set(class_of.values()) <= set(range(c))
    # every class, the unknown word's and the end's, as the docstring has it
    kind = lambda w: c + 1 if w == b"\n" else class_of.get(w, c)
    steps, types = np.zeros((c + 2, c + 2)), np.zeros(c + 2)
    for t, ok in zip(tokens, learnt, strict=True):
        for a, b in zip([b"\n", *t], t, strict=False):
            steps[kind(a), kind(b)] += ok
    for k in class_of.values():
        types[k] += 1
    types[c:] = 1
    total = steps.sum(0)
    prior = (total + 0.5) / (total + 0.5).sum()
    p = (steps + (c + 2) * prior) / (steps.sum(1, keepdims=True) + c + 2)
    assert np.allclose(p.sum(1), 1)
    for i, t in enumerate(tokens):
        base = sum(np.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        own = sum(np.log10(p[kind(a), kind(b)] * (count[b] + 0.5) / (total[kind(b)] + 0.5 * types[kind(b)])) for a, b in zip([b"\n", *t], t, strict=False))
        x = got[i]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(t), sum(w in count for w in t), n)
        assert np.isclose(x.base_score, base) and np.isclose(x.score, own)
    out = [x for x in got.values() if not learnt[x.doc_id]]
    assert sum(x.score for x in out) > sum(x.base_score for x in out)  # a better guess of what it has not seen
    assert brown_lm.score(docs.limit(0), F.lit(True)).count() == 0
    unseen = brown_lm.score(docs, F.lit(None).cast("boolean")).collect()
    assert len(unseen) == len(texts) and all(x.n_known == 0 and np.isfinite(x.score) for x in unseen)


def test_exchange_moves_one_word_at_a_time():
    """What a move is said to gain is what the likelihood of counts made anew gains, for every class."""
    r = np.random.default_rng(2)
    text = r.integers(0, 12, 600)
    kinds, c = r.integers(0, 3, 12), 3
    words = [*text.tolist(), -1]

    def counted(kinds):
        seq = np.array([4 if w < 0 else kinds[w] for w in words])
        steps = np.zeros((5, 5))
        np.add.at(steps, (np.concatenate([[4], seq[:-1]]), seq), 1)
        return steps, seq

    before_all = None
    for w in range(12):
        steps, seq = counted(kinds)
        left = np.concatenate([[4], seq[:-1]])
        right = np.concatenate([seq[1:], [4]])
        at = np.flatnonzero(np.array(words) == w)
        twice = sum(words[i] == w == words[i - 1] for i in range(1, len(words)))
        before, after = (np.bincount(x[at], minlength=5).astype(float) for x in (left, right))
        best = max(range(c), key=lambda d: brown_lm.likelihood(counted(np.where(np.arange(12) == w, d, kinds))[0]))
        state = brown_lm.Exchange(steps, c)
        to = state.move(int(kinds[w]), before, after, float(twice))
        kinds = np.where(np.arange(12) == w, to, kinds)
        now = brown_lm.likelihood(counted(kinds)[0])
        assert np.isclose(now, brown_lm.likelihood(counted(np.where(np.arange(12) == w, best, kinds))[0]))
        assert np.allclose(state.n, counted(kinds)[0]) and (before_all is None or now >= before_all - 1e-9)
        before_all = now


# 10


def test_code_lengths_are_best_and_limited():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    free, tight = token_files.code_lengths(counts, 15), token_files.code_lengths(counts, 4)
    assert abs(sum(2.0 ** -free.astype(float)) - 1) < 1e-12 and tight.max() <= 4 and sum(2.0 ** -tight.astype(float)) <= 1
    heap, cost = counts.tolist(), 0  # the plain construction: its cost is the sum of all joined weights
    while len(heap) > 1:
        heap.sort()
        cost += heap[0] + heap[1]
        heap = [heap[0] + heap[1], *heap[2:]]
    assert (free * counts).sum() == cost and (tight * counts).sum() >= cost
    code = token_files.Code(np.arange(10), tight)
    ids, own = np.random.default_rng(0).integers(0, 10, 3000), np.array([1, 0, 1500, 1499])
    data, first, bits = code.encode(ids, own)
    docs = [(k, int(n), data[a:b], bits[x:y]) for k, (n, a, b, x, y) in enumerate(zip(own, first, [*first[1:], len(data)], np.cumsum([0, 1, 0, 3]), np.cumsum([1, 0, 3, 3])))]
    doc_id, n, back = token_files.read_file(token_files.pack_file(docs, code))
    assert (back == ids).all() and n.tolist() == own.tolist()


def test_token_files(spark, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())] + [(50, "a <|endoftext|> b"), (51, " x  \n y "), (None, "z")], "doc_id long, text string").repartition(3)
    got = token_files.read_token_files(token_files.write_token_files(docs, path)).collect()
    start = 0
    for r in sorted(got, key=lambda r: -1 if r.doc_id is None else r.doc_id):
        t = "z" if r.doc_id is None else {50: "a <|endoftext|> b", 51: " x  \n y "}.get(r.doc_id) if r.doc_id >= 50 else texts()[r.doc_id]
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        assert r.start == start and np.frombuffer(r.ids, "<u4").tolist() == ids
        start += len(ids)
    assert len(got) == docs.count() and zlib.crc32(got[0].ids) >= 0
    assert token_files.read_token_files(token_files.write_token_files(docs.limit(0), path)).count() == 0
