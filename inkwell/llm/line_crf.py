"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is good or bad. Its score takes binned measures of the line and of its
neighbours; one 2 x 2 table of weights joins neighbours' labels. Forward-backward gives each
line's chance of being good; the mean by line length, through a logistic fit, is the document's
score. Weights are learnt from a bounded sample of labelled documents (SAMPLE of each label,
picked by a hash of the id), whose lines take their document's label. Scoring covers every line
of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import text_bytes

SAMPLE = 1500
STEPS = 80
SLICE = 6_000_000
SHARES = np.array([1e-9, 0.01, 0.03, 0.08, 0.15, 0.3, 0.6])
LENGTHS = np.array([2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 12.0])
WORDS = np.array([2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0])
BINS = 9  # the last stands for a neighbour that is not there
MEASURES = 9


def _classes() -> np.ndarray:
    """Per byte: 1 upper, 2 digit, 4 symbol, 8 shout, 16 end mark, 32 white space."""
    kind = np.zeros(256, np.uint8)
    kind[65:91] |= 1
    kind[48:58] |= 2
    for c in b"#*$%&|<>=_~^{}[]\\@/+":
        kind[c] |= 4
    for c in b"!?":
        kind[c] |= 8
    for c in b".!?;:\"'":
        kind[c] |= 16
    for c in (*range(9, 14), 32):
        kind[c] |= 32
    return kind


KIND = _classes()
_random = np.random.default_rng(5)
MIX, POWER = _random.integers(1, 1 << 62, 256), _random.integers(1, 1 << 62, 64) | 1


def line_measures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins (lines x MEASURES), bytes in words of each line, and lines of each text. Lines without words are left out."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = KIND[data]
    line_end = np.flatnonzero(data == 10)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    doc_end = np.cumsum([len(t) + 1 for t in texts])

    def per_line(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, line_start, dtype=np.int64)

    letters = (kind & 32) == 0
    starts = letters.copy()
    starts[1:] &= ~letters[:-1]
    first = np.flatnonzero(starts)
    words, size = per_line(starts), per_line(letters)
    chars = size - per_line((data & 0xC0) == 0x80)
    upper = (kind & 1).astype(bool)
    upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    # words as hashes, to find those that repeat the one before
    same = np.zeros(len(data), bool)
    if len(first) > 1:
        at = np.flatnonzero(letters)
        word = np.cumsum(starts[at]) - 1
        with np.errstate(over="ignore"):
            value = MIX[data[at]] * POWER[(at - first[word]) & 63]
        hashes = np.add.reduceat(value, np.searchsorted(at, first))
        line_of = np.searchsorted(line_end, first)
        same[first[1:]] = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
    # whether the last character that is not white space is an end mark
    mark = np.zeros(len(line_end), np.int64)
    last = np.maximum.accumulate(np.where(letters, np.arange(len(data)), -1))[line_end]
    there = (last >= line_start) & (words > 0)
    mark[there] = (kind[last[there]] & 16) > 0
    n, w = np.maximum(chars, 1), np.maximum(words, 1)
    columns = [
        np.searchsorted(SHARES, per_line(upper) / n, side="right"),
        np.searchsorted(SHARES, per_line((kind & 2) > 0) / n, side="right"),
        np.searchsorted(SHARES, per_line((kind & 4) > 0) / n, side="right"),
        np.searchsorted(SHARES, per_line((kind & 8) > 0) / w, side="right"),
        np.searchsorted(SHARES, per_line(same) / w, side="right"),
        np.searchsorted(LENGTHS, chars / w, side="right"),
        np.searchsorted(WORDS, words, side="right"),
        mark,
        np.searchsorted(SHARES, per_line(data == 124) / w, side="right"),
    ]
    full = words > 0
    bins = np.stack(columns, 1).astype(np.int8)[full]
    return bins, size[full], np.bincount(np.searchsorted(doc_end, line_start[full], side="right"), minlength=len(texts))


def with_neighbours(bins: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Own bins, those of the line before, and those of the line after, within each document."""
    none = np.full((1, bins.shape[1]), BINS - 1, np.int8)
    before, after = np.concatenate([none, bins[:-1]]), np.concatenate([bins[1:], none])
    ends = np.cumsum(lines)[lines > 0]
    if len(ends):
        after[ends - 1] = BINS - 1
        before[np.concatenate([[0], ends[:-1]])] = BINS - 1
    return np.concatenate([bins, before, after], 1)


class Chain:
    """Weights of lines (3 * MEASURES x BINS) and of label pairs (2 x 2)."""

    def __init__(self) -> None:
        self.lines, self.bias, self.pairs = np.zeros((3 * MEASURES, BINS)), 0.0, np.array([[0.5, -0.5], [-0.5, 0.5]])

    def emission(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum(self.lines[f][x[:, f]] for f in range(x.shape[1])) if len(x) else np.zeros(0)

    def messages(self, e: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward (with the line's own score) and backward log odds, all documents in step."""
        t = np.exp(self.pairs)
        order = np.argsort(-lines, kind="stable")
        count, first = lines[order], (np.cumsum(lines) - lines)[order]
        forward, backward = e.copy(), np.zeros_like(e)
        live = np.searchsorted(-count, -np.arange(1, int(count[0]) + 1 if len(count) else 1), side="right")
        for k in range(1, len(live)):
            at = first[: live[k]] + k
            r = np.exp(np.clip(forward[at - 1], -30, 30))
            forward[at] += np.log((t[0, 1] + t[1, 1] * r) / (t[0, 0] + t[1, 0] * r))
        for k in range(len(live) - 2, -1, -1):
            at = first[: live[k + 1]] + k
            r = np.exp(np.clip(e[at + 1] + backward[at + 1], -30, 30))
            backward[at] = np.log((t[1, 0] + t[1, 1] * r) / (t[0, 0] + t[0, 1] * r))
        return forward, backward

    def marginals(self, x: np.ndarray, lines: np.ndarray) -> np.ndarray:
        forward, backward = self.messages(self.emission(x), lines)
        return 1 / (1 + np.exp(-np.clip(forward + backward, -30, 30)))

    def fit(self, x: np.ndarray, lines: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> None:
        """Ascend the conditional likelihood, documents of both labels weighing alike, with a ridge."""
        y = np.repeat(labels, lines).astype(float)
        share = np.array([max((y == k).sum(), 1) for k in (0, 1)])
        weight = np.repeat(0.5 / share[labels.astype(int)], lines)
        inner = np.ones(len(y), bool)
        inner[np.cumsum(lines)[lines > 0] - 1] = False
        a = np.flatnonzero(inner)
        speed = [np.zeros_like(self.lines), 0.0, np.zeros((2, 2))]
        for _ in range(steps):
            e = self.emission(x)
            forward, backward = self.messages(e, lines)
            p = 1 / (1 + np.exp(-np.clip(forward + backward, -30, 30)))
            off = (y - p) * weight
            d_lines = np.stack([np.bincount(x[:, f], weights=off, minlength=BINS) for f in range(x.shape[1])]) - 2e-4 * self.lines
            # chances of label pairs of neighbouring lines
            f, b = np.clip(forward[a], -30, 30), np.clip((e + backward)[a + 1], -30, 30)
            joint = np.exp(self.pairs)[None] * np.stack([np.ones_like(f), np.exp(f)], 1)[:, :, None] * np.stack([np.ones_like(b), np.exp(b)], 1)[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            d_pairs = -(joint * weight[a][:, None, None]).sum(0)
            for k in (0, 1):
                d_pairs[k, k] += weight[a][y[a] == k].sum()
            d_pairs -= 2e-2 * self.pairs
            for i, d in enumerate((d_lines, off.sum(), d_pairs)):
                speed[i] = 0.8 * speed[i] + d
            self.lines += 4.0 * speed[0]
            self.bias += 1.0 * speed[1]
            self.pairs = np.clip(self.pairs + 0.5 * speed[2], -2, 2)


def document_means(p: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Mean chance by line length; NaN for documents without lines."""
    doc = np.repeat(np.arange(len(lines)), lines)
    total = np.bincount(doc, weights=size, minlength=len(lines))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.bincount(doc, weights=p * size, minlength=len(lines)) / total


class Quality:
    """A fitted chain and the logistic fit from its means to scores."""

    def __init__(self, chain: Chain, slope: float, shift: float, prior: float):
        self.chain, self.slope, self.shift, self.prior = chain, slope, shift, prior

    def scores(self, texts: list[bytes]) -> np.ndarray:
        bins, size, lines = line_measures(texts)
        mean = document_means(self.chain.marginals(with_neighbours(bins, lines), lines), size, lines)
        return np.where(np.isnan(mean), self.prior, 1 / (1 + np.exp(-(self.slope * np.nan_to_num(mean) + self.shift))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Quality:
    """Learn from at most `sample` documents of each label. docs: doc_id, text; labels: doc_id, quality
    (other values than 0 and 1, and nulls, are left out). Without both labels every score is the prior."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "quality")
    counts = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    picks = None
    for k in (0, 1):
        some = known.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picks = some if picks is None else picks.union(some)
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", text_bytes().alias("text"))
    chosen = texts.join(F.broadcast(picks), "doc_id").select("doc_id", "quality", "text")  # 2 * sample ids

    def measure(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            bins, size, lines = line_measures(batch.column(2).to_pylist())
            ends = np.cumsum(lines)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([bins[b - n : b].tobytes() for n, b in zip(lines, ends, strict=True)], pa.binary()),
                 pa.array([size[b - n : b].astype("<i4").tobytes() for n, b in zip(lines, ends, strict=True)], pa.binary())],
                ["doc_id", "quality", "bins", "sizes"],
            )

    rows = chosen.mapInArrow(measure, "doc_id long, quality int, bins binary, sizes binary").toPandas()
    rows = rows[rows["bins"].map(len) > 0].sort_values(["doc_id", "bins"])
    chain = Chain()
    if rows["quality"].nunique() < 2:
        return Quality(chain, 0.0, float(np.log(prior / (1 - prior))), prior)
    bins = np.frombuffer(b"".join(rows["bins"]), np.int8).reshape(-1, MEASURES)
    lines = rows["bins"].map(len).to_numpy() // MEASURES
    size = np.frombuffer(b"".join(rows["sizes"]), "<i4")
    y = rows["quality"].to_numpy()
    x = with_neighbours(bins, lines)
    chain.fit(x, lines, y)
    mean = document_means(chain.marginals(x, lines), size, lines)
    # logistic fit on the same documents, weighted back to the labels' shares
    weight = np.where(y == 1, prior / max((y == 1).mean(), 1e-9), (1 - prior) / max((y == 0).mean(), 1e-9))
    design, theta = np.stack([mean, np.ones_like(mean)], 1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ theta))
        slope = design.T @ ((y - p) * weight) - 1e-2 * theta
        bend = (design * (p * (1 - p) * weight)[:, None]).T @ design + 1e-2 * np.eye(2)
        theta += np.clip(np.linalg.solve(bend, slope), -5, 5)
    return Quality(chain, float(theta[0]), float(theta[1]), prior)


def score(docs: DataFrame, model: Quality) -> DataFrame:
    """(doc_id, score) of every row of docs (doc_id, text); a null or empty text gets the share of label 1."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            size = np.cumsum([len(x) for x in batch.column(1).to_pylist()])
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE)))
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(part.column(1).to_pylist()))], ["doc_id", "score"])
                at = to

    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(run, "doc_id long, score double")
