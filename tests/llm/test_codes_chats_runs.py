"""Chat parts, vector codes and word runs on small fixtures against plain versions."""

import hashlib
import math
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import chat_parts, gnat_codes, word_runs

CHATS = f"conv_id long, turn long, role string, content array<{chat_parts.PART}>, block string, task int"


def part(kind=None, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def chats():
    rows = [
        (1, 0, "user", [part("text", "look \\<image>\n</turn>\n"), part("image", ref="a.png", width=29, height=28), None, part("text", " and <b"), part("audio", ref="s.wav", seconds=1.5)], "x", 1),
        (1, 1, "assistant", [part("text", "fine \\\\ <turn user>\n"), part("document", ref="d.pdf", pages=3), part(None, "odd kind"), part("video", "as text")], "x", 1),
        (2, 0, "we\\ird>\nrole<", [part("text", None)], None, None), (2, None, "assistant", [part("text", "last")], None, None),
        (2, 0, "assistant", [part("text", "é🙂")], None, None), (2, 0, "assistant", [part("text", "é🙂")], None, None),
        (3, 5, None, None, None, None), (3, 6, "user", [], None, None), (None, 0, "assistant", [part("text", "no id")], None, None), (None, 1, "user", [part("text", "no id")], None, None),
        (4, 0, "assistant", [part("text", "<\\>" * 700_000)], None, None),
    ]
    return rows + [(9, k, "assistant" if k % 2 else "user", [part("text", f"turn {k} <")], None, None) for k in range(300)]


def plain(rows):
    """Digests per conversation, by sorting everything in memory."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", str(r[3])))
        turns, loss = "", ""
        for _, _, role, content, *_ in mine:
            texts = [p[1] or "" for p in content or [] if p and p[0] not in ("image", "audio", "document")]
            turns += f"{role or ''}\n{''.join(texts)}\n"
            loss += "".join(texts) if role == "assistant" else ""
        out[conv] = (len(mine), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("block_chars", [1 << 20, 200])
def test_chats_come_back(spark, block_chars):
    turns = spark.createDataFrame(chats(), CHATS).repartition(5)
    path = tempfile.mkdtemp(prefix="spark-") + "/chats"
    chat_parts.format_chats(turns, block_chars).write.parquet(path)
    got = {r.conv_id: r for r in chat_parts.digests(spark, path).collect()}
    assert {k: tuple(r)[1:5] for k, r in got.items()} == plain(chats())
    written = spark.read.parquet(path).orderBy("conv_id", "block").collect()
    for conv, row in got.items():
        assert row.formatted_chars == sum(len(w.formatted) for w in written if w.conv_id == conv)
    if block_chars == 200:
        assert sum(1 for w in written if w.conv_id == 9) > 10


def test_parts_become_ordered_placeholders(spark):
    turns = spark.createDataFrame(chats()[:2], CHATS)
    (row,) = chat_parts.format_chats(turns).collect()
    kinds = [(a.type, a.ref, a.tokens) for a in row.attachments]
    assert kinds == [("image", "a.png", 2), ("audio", "s.wav", math.ceil(1.5 * chat_parts.FRAMES)), ("document", "d.pdf", 3 * chat_parts.PAGE)]
    assert all(row.formatted[a.at :].startswith(f"<{a.type}>\n") for a in row.attachments)
    assert row.expanded_tokens == sum(k[2] for k in kinds) + 3 + 2 + 4 + 2 + 2  # words of the text parts
    (user, first), (assistant, second) = chat_parts.read_turns(row.formatted)
    assert (user, assistant) == ("user", "assistant")
    assert first == [("text", "look \\<image>\n</turn>\n"), ("image", ""), ("text", " and <b"), ("audio", "")]
    assert second == [("text", "fine \\\\ <turn user>\n"), ("document", ""), ("text", "odd kindas text")]
    assert "".join(chat_parts.learnt(row.formatted, row.loss)) == "fine \\\\ <turn user>\nodd kindas text"


def test_no_chats(spark):
    path = chat_parts.write_chats(spark.createDataFrame([], CHATS))
    assert chat_parts.digests(spark, path).count() == 0


# vector codes


VECTORS = "vec_id long, embedding array<float>, label int, code string, error string"


def vectors():
    r = np.random.default_rng(5)
    x = np.round(r.normal(size=(700, 8)) * 4) / 4  # many equal parts: ties everywhere
    rows = [(int(i), [float(v) for v in x[i]], int(i) % 3 if i % 5 else None, "c", "e") for i in range(700)]
    rows += [(701, None, 1, None, None), (702, [1.0, None] * 4, 1, None, None), (703, [float("nan")] * 8, 1, None, None), (704, [float("inf")] * 8, 1, None, None)]
    return rows + [(705, [], 1, None, None), (706, [0.5] * 4, 1, None, None), (None, rows[3][1], None, None, None), (5, rows[6][1], 0, None, None), (707, [3e38] + [-1e-9] * 7, 2, None, None)]


def plain_codes(rows):
    kept = [r for r in rows if r[1] and len(r[1]) == 8 and all(v is not None and math.isfinite(v) for v in r[1])]
    most = gnat_codes.limit(8)
    ints = [[max(-most, min(most, math.floor(float(np.float32(v)) * 1024))) for v in r[1]] for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, ints[i]))[:256]
    books = [[ints[i][2 * p : 2 * p + 2] for i in order] for p in range(4)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(4):
        for p in range(4):
            at = {}
            for v in ints:
                at.setdefault(nearest(v[2 * p : 2 * p + 2], p)[1], []).append(v[2 * p : 2 * p + 2])
            books[p] = [[sum(c) // len(at[k]) for c in zip(*at[k], strict=True)] if k in at else e for k, e in enumerate(books[p])]
    found = [[nearest(v[2 * p : 2 * p + 2], p) for p in range(4)] for v in ints]
    flat = ",".join(str(c) for book in books for e in book for c in e)
    errors = [sum(d for d, _ in f) for f in found]
    sums = {}
    for r, e in zip(kept, errors, strict=True):
        sums[r[2]] = sums.get(r[2], 0) + e
    key = lambda t: (t[0] is None, *map(str, t))
    sha = hashlib.sha256(flat.encode()).hexdigest()
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in f), e, sums[r[2]], sha) for r, f, e in zip(kept, found, errors, strict=True)), key=key)


def test_codes_equal_plain_version(spark):
    got = gnat_codes.vector_codes(spark.createDataFrame(vectors(), VECTORS).repartition(3))
    rows = [(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()]
    assert sorted(rows, key=lambda t: (t[0] is None, *map(str, t))) == plain_codes(vectors())


def test_labels_join_by_shuffle_too(spark, monkeypatch):
    monkeypatch.setattr(gnat_codes, "BROADCAST_LABELS", 0)
    rows = [r for r in vectors() if r[0] is not None and r[0] < 60]
    got = gnat_codes.vector_codes(spark.createDataFrame(rows, VECTORS).withColumn("vec_id", F.col("vec_id").cast("int")))
    assert sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()) == sorted(plain_codes(rows))


def test_no_vectors(spark):
    for rows in ([], [(1, None, 1, None, None)]):
        assert gnat_codes.vector_codes(spark.createDataFrame(rows, VECTORS)).count() == 0


def test_nearest_breaks_ties_by_index_and_skips_subtrees():
    r = np.random.default_rng(3)
    for scale in (1, 10**4, 10**8):
        entries = r.integers(-4, 5, (256, 3)).astype(np.int64) * scale
        queries = r.integers(-5, 6, (500, 3)).astype(np.int64) * scale
        search = gnat_codes.Search(entries)
        at, distance = search.nearest(queries)
        every = gnat_codes.squared(queries, entries)
        assert (at == every.argmin(1)).all() and (distance == every.min(1)).all()
        assert search.compared < every.size
    same = gnat_codes.Search(np.zeros((256, 4), np.int64))
    assert same.nearest(np.ones((3, 4), np.int64))[0].tolist() == [0, 0, 0]


# word runs


def plain_runs(words, least=12):
    found = {}
    for period in range(1, len(words) // 2 + 1):
        i = 0
        while i + period < len(words):
            start = i
            while i + period < len(words) and words[i] == words[i + period]:
                i += 1
            length = i - start + period
            if i > start and length >= max(least, 2 * period):
                found.setdefault((start, length), period)
            i = max(i, start + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def run_texts():
    r = np.random.default_rng(8)
    texts = [None, "", " \n\x0b ", "one", "a " * 5000, "a b " * 11 + "a", "x " + "a b c d e f " * 2 + "y", "É🙂 日本\t" * 9, "a" * 300_000]
    for _ in range(150):
        low = r.integers(0, int(r.integers(1, 4)) + 1, int(r.integers(0, 90)))
        base = r.integers(0, 30, int(r.integers(1, 20))).tolist() * int(r.integers(1, 8))
        texts += [" ".join(f"w{v}" for v in low), "  ".join(f"w{v}" for v in [7, *base, 9, 9])]
    texts.append(" ".join(f"u{i} home about contact us log in" for i in range(3000)))
    return texts


def test_runs_equal_plain_version(spark):
    texts = run_texts()
    rows = [(i, t, "n", 1) for i, t in enumerate(texts)] + [(None, texts[6], "n", 1), (6, texts[6], "n", 1)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_words string, runs int").repartition(4)
    got = word_runs.word_runs(docs).collect()
    assert len(got) == len(rows)
    for row in got:
        words = (texts[6 if row.doc_id is None else row.doc_id] or "").split()
        assert row.n_words == len(words)
        if len(words) < 5000:
            want = plain_runs(words)
            assert [tuple(r) for r in row.runs] == want and row.collapsed == plain_collapsed(words, want)
    many = next(r for r in got if r.doc_id == 4)
    assert [tuple(r) for r in many.runs] == [(0, 5000, 1)] and many.collapsed == "a"


def test_runs_of_other_lengths():
    r = np.random.default_rng(2)
    for least in (1, 2, 5, 30):
        lists = [r.integers(0, 3, int(n)).tolist() for n in r.integers(0, 80, 60)]
        got = word_runs.find(np.array(sum(lists, []), np.int32), np.array([len(w) for w in lists]), least)
        assert [got.get(k, []) for k in range(len(lists))] == [plain_runs(w, least) for w in lists]


def test_no_documents(spark):
    assert word_runs.word_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# near copies: large clusters


def cluster(n: int, others: int):
    r = np.random.default_rng(21)
    base = [f"b{k}" for k in range(400)]
    texts = []
    for i in range(n):
        words = list(base)
        for at in r.integers(0, 400, 3):
            words[int(at)] = f"x{i}"
        texts.append(" ".join(words))
    return texts + [" ".join(f"o{i}w{k}" for k in range(40)) for i in range(others)]


def test_cluster_of_near_copies_does_not_multiply(spark, monkeypatch):
    from inkwell.llm import chosen_path

    monkeypatch.setattr(chosen_path, "LEAF", 8)
    monkeypatch.setattr(chosen_path, "LARGE", 32)
    texts = cluster(500, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    seen = []
    plain = chosen_path.trees

    def counted(*args):
        seen.append(plain(*args))
        return seen[-1]

    monkeypatch.setattr(chosen_path, "trees", counted)
    got = {x.doc_id: x.component_id for x in chosen_path.near_duplicates(docs, words=4).collect()}
    assert all(got[i] == (0 if i < 500 else i) for i in range(560))
    assert seen[0].count() < 20 * chosen_path.TREES * 560
