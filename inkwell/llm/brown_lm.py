"""Brown class-based bigram model: exchange clustering, class transitions, word emissions.

    P(text) = prod P(class_i | class_i-1) * P(word_i | class_i)

Words and one end per document are tokens; the class before the first word is that of the end.

1. Training words are counted. The FREQUENT most frequent ones seen LEAST times (a bounded table,
   so it may be broadcast) get numbers, and every text becomes a list of numbers, once; other words
   stay beside it as they are. What follows reads only that table.
2. Exchange clustering of the numbered words. They start from the most frequent ones as seeds. A
   round counts the classes before and after every word over all training texts; then each task
   takes a span of words, one word at a time: the word leaves its class, the likelihood of the
   class bigrams is worked out for every class it may join, it joins the best, and the counts
   change before the next word. Spans move on copies of the round's counts of their own, so a round
   is kept only if the likelihood, counted anew, has risen; else the rounds end.
3. Every other training word joins the class that fits its neighbours best, the classes being fixed.
4. With all classes known each token gets its own, and transitions are counted over all training
   texts. Every class is smoothed by 0.5 for each of its words; words that training has not are one
   word of a class of their own, so probabilities sum to one over the training words and it.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import staged, text_bytes

END = b"\n"  # no word holds white space
FREQUENT, CLASSES, ROUNDS = 1 << 18, 32, 3
LEAST = 5  # words seen less often tell too little to move others; they are placed afterwards
SPAN = 8192
FAN_IN = 64  # parts that are added up at once
_worker: dict = {}


def tokens_of(data: bytes) -> list[bytes]:
    """Words of a text, A-Z in lower case. bytes.split cuts at exactly blank, TAB, LF, VT, FF, CR."""
    return data.lower().split()


def _count_words(batches):
    found: Counter = Counter()

    def out():
        words, counts = list(found), list(found.values())
        for at in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(words[at : at + 50_000], pa.binary()), pa.array(counts[at : at + 50_000], pa.int64())], ["word", "n"]
            )
        found.clear()

    for batch in batches:
        for data in batch.column(0):
            found.update(tokens_of(data.as_py()))
        found[END] += batch.num_rows
        if len(found) > 250_000:
            yield from out()
    yield from out()


class Vocabulary:
    """The numbered words, as every task holds them: one joined string, and one dict in a worker."""

    def __init__(self, words: list[bytes]):
        self.words, self.key = END.join(words), uuid.uuid4().hex

    def index(self) -> dict[bytes, int]:
        if _worker.get("key") != self.key:
            _worker.clear()
            _worker.update(index={w: i for i, w in enumerate(self.words.split(END))} if self.words else {}, key=self.key)
        return _worker["index"]


def _slices(batch: pa.RecordBatch, column: int, most: int = 1_000_000):
    """Rows of a batch in runs of about `most` bytes: (first, end)."""
    sizes = np.array([len(x) for x in batch.column(column).to_pylist()], np.int64)
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most)))
        yield at, min(to, len(sizes))
        at = to


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def numbered(docs: DataFrame, vocabulary) -> DataFrame:
    """(uid, doc_id, learn, n_tokens, ids, others) of docs (doc_id, text, learn): a text's words by number,
    -1 for other words, which `others` holds in order. The end is not in the list."""

    def run(batches):
        index = vocabulary.value.index()
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for a, b in _slices(batch, 1):
                part = batch.slice(a, b - a)
                ids, others, ends, n = [], [], [0], []
                for data in part.column(1).to_pylist():
                    words = tokens_of(data)
                    own = np.fromiter((index.get(w, -1) for w in words), "<i4", len(words))
                    others += [words[i] for i in np.flatnonzero(own < 0).tolist()]
                    ends.append(len(others))
                    ids.append(own.tobytes())
                    n.append(len(words) + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(uid, uid + len(n))), part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(ids, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(others, pa.binary()))],
                    ["uid", "doc_id", "learn", "n_tokens", "ids", "others"],
                )
                uid += len(n)

    rows = docs.select("doc_id", text_bytes().alias("text"), "learn")
    return rows.mapInArrow(run, "uid long, doc_id long, learn boolean, n_tokens long, ids binary, others array<binary>")


def _joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of some texts in a row, -2 for each end, and the places behind the ends."""
    n = np.array([len(x) // 4 + 1 for x in ids], np.int64)
    ends = np.cumsum(n)
    out = np.full(int(ends[-1]) if len(ends) else 0, -2, np.int64)
    inner = np.ones(len(out), bool)
    inner[ends - 1] = False
    out[inner] = np.frombuffer(b"".join(ids), "<i4")
    return out, ends


def kinds_of(numbers: np.ndarray, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """Class of every token: that of its word, n_classes for other words, n_classes + 1 for an end."""
    known = classes[np.maximum(numbers, 0)].astype(np.int64) if len(classes) else np.zeros(len(numbers), np.int64)
    return np.where(numbers >= 0, known, np.where(numbers == -1, n_classes, n_classes + 1))


def context_counts(texts: DataFrame, shared, n_words: int, n_classes: int, tasks: int) -> DataFrame:
    """(span, cells, counts): per span of SPAN words, how often each class stands before and after each
    word, and each word after itself; span -1 has the class transitions. texts: ids. Added up within a
    task, then over FAN_IN tasks at a time, so that no task gathers more parts than that."""
    k = n_classes + 2

    def run(batches):
        classes = shared.value
        size = n_words * k
        near = np.zeros(2 * size, np.uint16)  # full cells move to `spill`
        twice = np.zeros(n_words, np.int64)
        spill: list[np.ndarray] = []
        steps = np.zeros(k * k, np.int64)
        for batch in batches:
            for a, b in _slices(batch, 0, 2_000_000):
                ids, ends = _joined(batch.column(0).slice(a, b - a).to_pylist())
                kinds = kinds_of(ids, classes, n_classes)
                before = np.concatenate([[n_classes + 1], kinds[:-1]])
                after = np.concatenate([kinds[1:], [n_classes + 1]])
                steps += np.bincount(before * k + kinds, minlength=k * k)
                known = np.flatnonzero(ids >= 0)
                same = known[known > 0]
                same = same[ids[same] == ids[same - 1]]
                twice += np.bincount(ids[same], minlength=n_words)
                for side, other in enumerate((before, after)):
                    cells, n = np.unique(ids[known] * k + other[known], return_counts=True)
                    full = near[side * size + cells] + n
                    over = full > 60_000
                    spill.append(np.stack([side * size + cells[over], full[over]]))
                    near[side * size + cells] = np.where(over, 0, full)
        part = TaskContext.get().partitionId()
        extra = np.concatenate(spill, 1) if spill else np.zeros((2, 0), np.int64)
        rows = [(-1, part, _packed(np.arange(k * k, dtype="<u4")), _packed(steps.astype("<i8")))]
        for first in range(0, n_words, SPAN):
            last = min(first + SPAN, n_words)
            half = (last - first) * k
            both = np.concatenate([near[s * size + first * k : s * size + last * k] for s in (0, 1)] + [twice[first:last]]).astype(np.int64)
            for s in (0, 1):
                own = extra[:, (extra[0] >= s * size + first * k) & (extra[0] < s * size + last * k)]
                np.add.at(both, own[0] - s * size - first * k + s * half, own[1])
            cells = np.flatnonzero(both)
            rows.append((first // SPAN, part, _packed(cells.astype("<u4")), _packed(both[cells].astype("<i8"))))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
            ["span", "part", "cells", "counts"],
        )

    def add(table: pa.Table) -> pa.Table:
        cells = [_unpacked(x, "<u4") for x in table.column("cells").to_pylist()]
        counts = [_unpacked(x, "<i8") for x in table.column("counts").to_pylist()]
        total = np.bincount(np.concatenate(cells), weights=np.concatenate(counts))
        kept = np.flatnonzero(total)
        return pa.table({
            "span": table.column("span")[:1], "part": table.column("part")[:1],
            "cells": pa.array([_packed(kept.astype("<u4"))], pa.binary()),
            "counts": pa.array([_packed(total[kept].astype("<i8"))], pa.binary()),
        })

    schema = "span int, part int, cells binary, counts binary"
    parts = texts.mapInArrow(run, schema)
    while True:
        tasks = -(-tasks // FAN_IN)
        parts = parts.withColumn("part", F.pmod("part", F.lit(tasks))).groupBy("span", "part").applyInArrow(add, schema)
        if tasks == 1:
            return parts


def _transitions(contexts: DataFrame, k: int) -> np.ndarray:
    row = contexts.where("span = -1").first()
    out = np.zeros(k * k)
    if row is not None:
        out[_unpacked(row["cells"], "<u4")] = _unpacked(row["counts"], "<i8")
    return out.reshape(k, k)


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(steps: np.ndarray) -> float:
    """Log likelihood of the class bigrams and of the words' shares of their classes, but for what depends
    on no class."""
    return float(_h(steps).sum() - _h(steps.sum(1)).sum() - _h(steps.sum(0)).sum())


class Exchange:
    """Class bigram counts, from which one word at a time is taken out and put into its best class."""

    def __init__(self, steps: np.ndarray, n_classes: int):
        self.n, self.c = steps.astype(np.float64).copy(), n_classes
        self.tokens = (self.n.sum(0) + self.n.sum(1)) / 2
        self.corner = self.n.ravel()[:: len(self.n) + 1]  # a view of the diagonal

    def move(self, kind: int, before: np.ndarray, after: np.ndarray, twice: float) -> int:
        """Move a word of the class `kind` to its best one. before and after count its neighbours' classes,
        itself among them, `twice` how often it follows itself. Only the classes beside it are looked at:
        nothing else changes."""
        c, counts, tokens = self.c, self.n, self.tokens
        if twice:
            before, after = before.copy(), after.copy()
            before[kind] -= twice
            after[kind] -= twice
        left, right = np.flatnonzero(before), np.flatnonzero(after)
        n_left, n_right = before[left], after[right]
        n = n_right.sum() + twice
        # out of its class; neighbours that moved before it leave rests, hence no less than nothing
        counts[kind, right] = np.maximum(counts[kind, right] - n_right, 0)
        counts[left, kind] = np.maximum(counts[left, kind] - n_left, 0)
        counts[kind, kind] = max(counts[kind, kind] - twice, 0)
        tokens[kind] -= n
        # into every class
        out, into = counts[:c].take(right, 1), counts[:, :c].take(left, 0)
        own_left, own_right, corner, size = before[:c], after[:c], self.corner[:c], tokens[:c]
        parts = [(out + n_right).ravel(), out.ravel(), (into + n_left[:, None]).ravel(), into.ravel()]
        parts += [corner + own_left + own_right + twice, corner + own_left, corner + own_right, corner, size + n, size]
        value = _h(np.concatenate(parts))
        x, y, at = c * len(right), c * len(left), 2 * c * (len(right) + len(left))
        gain = (value[:x] - value[x : 2 * x]).reshape(c, -1).sum(1) + (value[2 * x : 2 * x + y] - value[2 * x + y : at]).reshape(-1, c).sum(0)
        rest = value[at:].reshape(6, c)
        gain += rest[0] - rest[1] - rest[2] + rest[3] - 2 * (rest[4] - rest[5])
        best = int(gain.argmax())
        if kind < c and gain[kind] >= gain[best]:
            best = kind
        counts[best, right] += n_right
        counts[left, best] += n_left
        counts[best, best] += twice
        tokens[best] += n
        return best


def exchanged(contexts: DataFrame, steps: np.ndarray, n_words: int, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """One round: the class of every word after its move. Spans of words are moved side by side."""
    k = n_classes + 2

    def run(batches):
        for batch in batches:
            for span, cells, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                first = span * SPAN
                n = min(SPAN, n_words - first)
                both = np.zeros(2 * n * k + n)
                both[_unpacked(cells, "<u4")] = _unpacked(counts, "<i8")
                before, after, twice = both[: n * k].reshape(n, k), both[n * k : 2 * n * k].reshape(n, k), both[2 * n * k :]
                state = Exchange(steps, n_classes)
                out = [state.move(int(classes[first + i]), before[i], after[i], twice[i]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([span], pa.int32()), pa.array([np.array(out, "<i2").tobytes()], pa.binary())], ["span", "classes"])

    moved = classes.copy()
    spans = contexts.where("span >= 0").select("span", "cells", "counts").mapInArrow(run, "span int, classes binary")
    for row in spans.collect():  # two bytes for each of the bounded number of numbered words
        some = np.frombuffer(row["classes"], "<i2")
        moved[row["span"] * SPAN : row["span"] * SPAN + len(some)] = some
    return moved


def cluster(texts: DataFrame, n_words: int, n_classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of the numbered words, the class transitions that go with them (other words as one class),
    and the likelihood before the first round and after each one that was kept."""
    spark = texts.sparkSession
    tasks = texts.rdd.getNumPartitions()
    k = n_classes + 2

    def counted(classes: np.ndarray) -> tuple[DataFrame, np.ndarray]:
        shared = spark.sparkContext.broadcast(classes)
        contexts = staged(context_counts(texts, shared, n_words, n_classes, tasks), "contexts")
        shared.destroy()
        return contexts, _transitions(contexts, k)

    classes = np.full(n_words, n_classes, np.int16)  # all but the seeds wait with the other words
    classes[:n_classes] = np.arange(min(n_classes, n_words))
    contexts, steps = counted(classes)
    values = [likelihood(steps)]
    for _ in range(rounds if n_words else 0):
        new = exchanged(contexts, steps, n_words, classes, n_classes)
        if (new == classes).all():
            break
        contexts, new_steps = counted(new)
        if likelihood(new_steps) <= values[-1]:
            break
        classes, steps = new, new_steps
        values.append(likelihood(steps))
    return classes, steps, values


def placed(texts: DataFrame, classes: np.ndarray, steps: np.ndarray, n_classes: int) -> DataFrame:
    """(word, n, kind) of the training words without a number: each joins the class that fits the classes
    beside it best. texts: ids, others. What stands beside a word is counted before words are gathered, so a
    word brings at most one row per pair of classes."""
    k = n_classes + 2
    shared = texts.sparkSession.sparkContext.broadcast(classes)
    smooth = steps + 0.1
    gain = np.log(smooth * smooth.sum() / np.outer(smooth.sum(1), smooth.sum(0)))

    def beside(batches):
        for batch in batches:
            for a, b in _slices(batch, 0, 2_000_000):
                part = batch.slice(a, b - a)
                ids, _ = _joined(part.column(0).to_pylist())
                kinds = kinds_of(ids, shared.value, n_classes)
                before = np.concatenate([[n_classes + 1], kinds[:-1]])
                after = np.concatenate([kinds[1:], [n_classes + 1]])
                at = np.flatnonzero(ids == -1)
                yield pa.RecordBatch.from_arrays([part.column(1).flatten(), pa.array((before[at] * k + after[at]).astype(np.int32))], ["word", "pair"])

    def best(batches):
        for batch in batches:
            lists = batch.column(2)
            pairs, times = (lists.flatten().field(i).to_numpy() for i in (0, 1))
            rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            value = np.zeros((batch.num_rows, n_classes))
            np.add.at(value, rows, times[:, None] * (gain[pairs // k, :n_classes] + gain[:n_classes, pairs % k].T))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value.argmax(1).astype(np.int32))], ["word", "n", "kind"])

    found = texts.select("ids", "others").mapInArrow(beside, "word binary, pair int").groupBy("word", "pair").agg(F.count("*").alias("times"))
    lists = found.groupBy("word").agg(F.sum("times").alias("n"), F.collect_list(F.struct("pair", "times")).alias("at"))
    return lists.mapInArrow(best, "word binary, n long, kind int")


def in_classes(rows: DataFrame, others: DataFrame, shared, n_classes: int) -> DataFrame:
    """(doc_id, learn, n_tokens, n_known, counts_log, kinds): the class of every token, one byte each, and the
    sum of log10(count + 0.5). rows: numbered(); others: word, n, kind."""
    said = rows.select("uid", F.posexplode("others").alias("k", "word")).join(others, "word", "left")
    back = said.groupBy("uid").agg(F.collect_list(F.struct("k", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kind", F.lit(n_classes)).alias("kind"))).alias("said"))

    def run(batches):
        classes, log_n, n_end = shared.value
        for batch in batches:
            for a, b in _slices(batch, 3, 2_000_000):
                part = batch.slice(a, b - a)
                ids, ends = _joined(part.column(3).to_pylist())
                kinds, logs, known = kinds_of(ids, classes, n_classes), np.zeros(len(ids)), ids >= 0
                logs[known] = log_n[ids[known]]
                logs[ends - 1], known[ends - 1] = np.log10(n_end + 0.5), n_end > 0
                lists = part.column(4)
                sizes = np.array([0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()], np.int64)
                if sizes.sum():
                    k, n, kind = (lists.flatten().field(i).to_numpy() for i in range(3))
                    order = np.lexsort((k, np.repeat(np.arange(len(sizes)), sizes)))
                    at = np.flatnonzero(ids == -1)
                    kinds[at], logs[at], known[at] = kind[order], np.log10(n[order] + 0.5), n[order] > 0
                begins = np.concatenate([[0], ends[:-1]])
                packed = kinds.astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(np.add.reduceat(known.astype(np.int64), begins)), pa.array(np.add.reduceat(logs, begins)),
                     pa.array([packed[x:y].tobytes() for x, y in zip(begins, ends, strict=True)], pa.binary())],
                    ["doc_id", "learn", "n_tokens", "n_known", "counts_log", "kinds"],
                )

    both = rows.drop("others").join(back, "uid", "left").select("doc_id", "learn", "n_tokens", "ids", "said")
    return both.mapInArrow(run, "doc_id long, learn boolean, n_tokens long, n_known long, counts_log double, kinds binary")


def _steps(kinds: bytes, k: int) -> np.ndarray:
    """Class transitions of texts that follow each other; all texts end in the same class."""
    own = np.frombuffer(kinds, np.uint8).astype(np.int64)
    return np.concatenate([[k - 1], own[:-1]]) * k + own


def score(docs: DataFrame, learn: Column, n_classes: int = CLASSES, frequent: int = FREQUENT, rounds: int = ROUNDS) -> DataFrame:
    """Learn from the rows of docs (doc_id, text) where `learn` holds, and score all of them.

    Returns a row per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score.
    A null or empty text is one end token. Repeated doc_ids are scored row by row; a null `learn`
    counts as false, other columns are left out, whatever their names. Texts are read whole, one at a
    time. Words of equal count are ranked by their bytes, and a word that two classes fit alike joins
    the first. With no training rows every token is unknown and scores as 0.5 / (0.5 * (V + 1)) would
    have it. n_classes may be 250 at most.
    """
    if not 1 <= n_classes <= 250:
        raise ValueError("1 to 250 classes")
    spark = docs.sparkSession
    k = n_classes + 2
    rows = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    words = rows.where("learn").select(text_bytes().alias("text")).mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = staged(words, "word-counts")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("n"))), F.lit(0))).first()
    n_all, n_types, n_end = map(int, total)
    plain = words.where(F.col("word") != F.lit(END))
    top = plain.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "word").limit(frequent).toPandas()
    counts = top["n"].to_numpy(np.int64)
    vocabulary = spark.sparkContext.broadcast(Vocabulary([bytes(w) for w in top["word"]]))
    coded = staged(numbered(rows, vocabulary), "numbered")
    texts = coded.where("learn").select("ids", "others")
    classes, steps, _ = cluster(texts.select("ids"), len(top), n_classes, rounds)
    others = staged(placed(texts, classes, steps, n_classes), "placed")
    shared = spark.sparkContext.broadcast((classes, np.log10(counts + 0.5), n_end))
    said = staged(in_classes(coded, others, shared, n_classes), "classes")

    def count(batches):
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for a, b in _slices(batch, 0, 4_000_000):
                total += np.bincount(_steps(b"".join(batch.column(0).slice(a, b - a).to_pylist()), k), minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    steps = np.zeros(k * k)
    for cell, n in said.where("learn").select("kinds").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():  # k * k rows at most
        steps[cell] = n
    steps = steps.reshape(k, k)
    types = np.bincount(classes, minlength=k).astype(np.float64)
    for kind, n in others.groupBy("kind").count().collect():  # a row per class
        types[kind] += n
    types[n_classes], types[n_classes + 1] = 1, 1
    tokens = steps.sum(0)
    prior = (tokens + 0.5) / (tokens + 0.5).sum()
    moves = np.log10((steps + k * prior) / (steps.sum(1, keepdims=True) + k))
    emit = np.log10(np.maximum(tokens + 0.5 * types, 0.5))
    table = spark.sparkContext.broadcast((moves - emit).ravel())
    base_room = float(np.log10(n_all + 0.5 * (n_types + 1)))

    def run(batches):
        for batch in batches:
            for a, b in _slices(batch, 4, 4_000_000):
                part = batch.slice(a, b - a)
                kinds = part.column(4).to_pylist()
                ends = np.cumsum([len(x) for x in kinds])
                own = np.add.reduceat(table.value[_steps(b"".join(kinds), k)], np.concatenate([[0], ends[:-1]]))
                logs = part.column(3).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(3)), pa.array(logs - part.column(1).to_numpy() * base_room), pa.array(logs + own)],
                    ["doc_id", "n_tokens", "n_known", "base_score", "score"],
                )

    scored = said.select("doc_id", "n_tokens", "n_known", "counts_log", "kinds").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
